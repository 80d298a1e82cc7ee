r"""Personal data by weak supervision.

Every text is read once. Fixed patterns give the base spans, which always stay.
Further candidates come from looser patterns and from lists of names and street
words. Four labelers vote on each span, yes, no or nothing: the format's own
checks, gazetteers, words nearby, and the characters at its edges. Spans are
counted by kind, votes and length class; the table of counts has a fixed size
whatever the corpus. Expectation-maximisation over it estimates how far each
labeler can be trusted and how often each kind is meant. Its posteriors train a
logistic classifier on votes, kind and length and on the text itself: hashed
words before and after the span, and its shape. So words that are in no list
count too, where they keep company with spans that labelers agree on. The
classifier learns from ``SAMPLE`` spans at most, an equal number of each kind,
chosen by hash; counts and posteriors are of all. The candidates that it
accepts, and that touch no base span, are added.

Defined cases: a null text counts as empty and has no spans; repeated rows are
judged one by one; an empty table, or one without candidates, adds nothing;
patterns take time in proportion to the text, also for long runs of digits or
address characters; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from datetime import date
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise

KINDS = ("email", "ip", "card", "phone", "local_phone", "national_id", "iban", "person", "long_phone", "address", "birth_date", "account")
BASE = KINDS[:4]
VOTERS = ("format", "gazetteer", "context", "edges")
#: Characters on either side that the context labeler reads.
NEAR = 48
LENGTH_CLASSES = 4
#: Spans that the classifier learns from, at most; columns of hashed words and shapes; words read on either side.
SAMPLE, HASHED, NEAR_WORDS = 8_400, 512, 4
#: Share of the candidates of a kind that are taken as meant before any vote is seen, and how many spans that is worth.
MEANT, MEANT_WORTH = {"local_phone": 0.5, "national_id": 0.3, "iban": 0.5, "person": 0.4, "long_phone": 0.5, "address": 0.4, "birth_date": 0.1, "account": 0.1}, 10
#: A labeler's votes (no, nothing, yes) where a span is meant before any is seen, the reverse where it is not; how many spans that is worth.
TRUSTED, TRUST_WORTH = (0.25, 0.0, 0.75), 10

# Fixed values. A look-behind stands where an earlier start would give the same
# match, so that long runs are read once.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Gazetteers.
GIVEN_NAMES = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Hans Peter Wolfgang Klaus Jürgen Dieter Manfred Uwe Günter Helmut Ursula Monika Petra Sabine Renate Helga Karin Brigitte Ingrid Erika "
    "Jean Pierre Michel André Philippe Alain Jacques Bernard Nathalie Isabelle Sylvie Catherine Françoise Monique Nicole Chantal "
    "José Antonio Manuel Francisco Juan Javier Carlos Miguel María Carmen Josefa Isabel Dolores Pilar Teresa Ana Lucía".split()
)
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "421")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
#: Length of an account number by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io")
TOWNS = frozenset("London Paris Berlin Madrid Vienna Wien Zürich Hamburg München Köln Frankfurt Lyon Marseille Toulouse Nice Barcelona Valencia Sevilla Boston Chicago Houston Seattle Denver Dallas Springfield".split())
WORDS_FOR = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "account"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "national_id": ("ssn", "social", "security", "id"),
    "iban": ("iban", "bank", "account", "transfer"),
    "person": ("name", "dear", "contact", "signed", "patient"),
    "long_phone": ("phone", "call", "tel", "mobile", "fax", "contact", "telefon", "téléphone", "teléfono"),
    "address": ("address", "lives", "living", "resident", "ship", "deliver", "wohnt", "anschrift", "habite", "adresse", "vive", "domicilio"),
    "birth_date": ("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "né", "née", "naissance", "nacido", "nacida", "nacimiento"),
    "account": ("account", "customer", "konto", "kontonummer", "kunde", "compte", "client", "cuenta", "cliente"),
}
WORDS_AGAINST = ("version", "isbn", "order", "invoice", "figure", "table", "serial", "model", "build")

_MORE = {
    "local_phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "person": re.compile(r"(?<!\w)(?:(?:%s)\.?|(?:%s))\x20[A-Z][a-zß-ÿ]{1,30}(?:[\x20-][A-Z][a-zß-ÿ]{1,30})?(?!\w)" % ("|".join(TITLES), "|".join(sorted(GIVEN_NAMES)))),
    "long_phone": re.compile(r"(?<![0-9+])\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{2,4}\))?(?:[\x20.-][0-9]{2,4}){2,4}(?![.-]?[0-9])"),
    "address": re.compile(
        r"(?<!\w)(?:[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square)"
        r"|[A-ZÄÖÜ][a-zäöüß]{2,20}(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{1,4}[a-z]?"
        r"|[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place|chemin)\x20(?:(?:de|du|des|la)\x20){0,2}[A-ZÀ-Ý][a-zß-ÿ]{1,20}"
        r"|(?:Calle|Avenida|Plaza|Paseo)\x20(?:(?:de|del|la|los)\x20){0,2}[A-ZÀ-Ý][a-zß-ÿ]{1,20},?\x20[0-9]{1,4})(?!\w)"
    ),
    "birth_date": re.compile(r"(?<![0-9./-])(?:(?P<day>[0-9]{1,2})[./-](?P<month>[0-9]{1,2})[./-](?P<year>(?:19|20)[0-9]{2})|(?P<y>(?:19|20)[0-9]{2})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2}))(?![0-9./-]*[0-9])"),
    "account": re.compile(r"(?<![0-9A-Za-z+.-])[0-9]{8,19}(?![0-9A-Za-z.-])"),
}
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-zß-ÿ]+")
_TOKEN = re.compile(r"[^\W_]+")
_SHAPE = ((re.compile(r"[0-9]"), "9"), (re.compile(r"[A-ZÀ-Þ]"), "A"), (re.compile(r"[a-zß-ÿ]+"), "a"))


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        last = m.end() if m else at + 1
        if m:
            yield start, last
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 14 <= len(d := "".join(_DIGITS.findall(m[0]))) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def more_candidates(text: str) -> list[tuple[int, int, int]]:
    """Sorted spans of the looser patterns, which only the classifier can accept."""
    out = []
    digits = _DIGITS.search(text) is not None
    for kind, pattern in _MORE.items():
        if digits or kind == "person":
            out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[0], -x[2], x[1]))


def firsts(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans that overlap, the first."""
    kept, last = [], 0
    for x in spans:
        if x[0] >= last:
            kept.append(x)
            last = x[2]
    return kept


def apart(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of ``more`` that overlap none of the sorted ``base``: by search in the running greatest end."""
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    return [x for x in more if not (k := bisect_left(starts, x[2])) or ends[k - 1] <= x[0]]


def _checked_date(hit: str) -> int:
    m = _MORE["birth_date"].match(hit)
    day, month, year = (int(m[a] or m[b]) for a, b in (("day", "d"), ("month", "m"), ("year", "y")))
    try:
        date(year, month, day)
    except ValueError:
        return 0
    return 1


def _near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Words in the ``NEAR`` characters before and after a span."""
    return _WORD.findall(text[max(0, start - NEAR) : start].lower()), _WORD.findall(text[end : end + NEAR].lower())


def votes(text: str, start: int, rank: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote: 2 yes, 0 no, 1 nothing."""
    kind, hit = KINDS[rank], text[start:end]
    digits = "".join(_DIGITS.findall(hit))
    form = gaz = 1
    if kind == "email":
        form = 2 if hit.rsplit(".", 1)[1].isalpha() and ".." not in hit else 0
        gaz = 2 if hit.rsplit(".", 1)[1].lower() in TOP_DOMAINS else 1
    elif kind == "ip":
        form = 2 if all(str(int(x)) == x for x in hit.split(".")) else 0
        gaz = 0 if hit.startswith(("0.", "127.", "255.")) else 1
    elif kind == "card":
        form, gaz = 2, 2 if digits.startswith(ISSUERS) else 1
    elif kind in ("phone", "long_phone"):
        form, gaz = 2 if 8 <= len(digits) <= 15 else 0, 2 if digits.startswith(CALLING_CODES) else 0
    elif kind == "local_phone":
        form = 2 if digits[0] > "1" and digits[3] > "1" else 0
    elif kind == "national_id":
        form = 0 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 2
    elif kind == "iban":
        solid = hit.replace(" ", "")
        form = 2 if int("".join(str(int(c, 36)) for c in solid[4:] + solid[:4])) % 97 == 1 else 0
        gaz = 2 if IBAN_LENGTHS.get(solid[:2]) == len(solid) else 0 if solid[:2] in IBAN_LENGTHS else 1
    elif kind == "person":
        parts = re.split(r"[.\x20-]+", hit)
        form = 2 if parts[0] in TITLES else 1
        gaz = 2 if any(x in GIVEN_NAMES for x in parts) else 0 if any(x in TOWNS for x in parts[1:]) else 1
    elif kind == "address":
        gaz = 2 if any(w in TOWNS for w in _TOKEN.findall(text[end : end + NEAR])) else 1
    elif kind == "birth_date":
        form = _checked_date(hit)
    else:
        form = 0 if len(digits) >= 14 or len(set(digits)) < 3 else 1
    before, after = _near(text, start, end)
    near = {*before, *after}
    context = 2 if any(w in near for w in WORDS_FOR[kind]) else 0 if any(w in near for w in WORDS_AGAINST) else 1
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    edges = 0 if any(c.isalnum() or c in "_@/=#" for c in beside) else 2
    return form, gaz, context, edges


def hashed(text: str, start: int, rank: int, end: int) -> list[int]:
    """Columns, below ``HASHED``, of the words around a span and of its shape, each with its kind."""
    shape = text[start:end]
    for pattern, sign in _SHAPE:
        shape = pattern.sub(sign, shape)
    before, after = _near(text, start, end)
    said = [f"s{shape[:40]}", *(f"b{w}" for w in before[-NEAR_WORDS:]), *(f"a{w}" for w in after[:NEAR_WORDS])]
    return sorted({zlib.crc32(f"{rank}{x}".encode()) % HASHED for x in said})


def _pattern(rank: int, vote: tuple[int, ...], length: int) -> int:
    code = rank
    for v in vote:
        code = 3 * code + v
    return code * LENGTH_CLASSES + min(LENGTH_CLASSES - 1, length // 8)


def _unpacked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, votes, length class) of pattern codes."""
    length, code = code % LENGTH_CLASSES, code // LENGTH_CLASSES
    vote = np.zeros((len(code), len(VOTERS)), int)
    for i in reversed(range(len(VOTERS))):
        vote[:, i], code = code % 3, code // 3
    return code, vote, length


_SCHEMA = "doc_id bigint, n array<bigint>, base_sha256 string, base string, starts array<int>, ends array<int>, patterns array<int>, columns array<array<int>>"


def _scan(batches):
    kind = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.list_(pa.int64())), ("base_sha256", pa.string()), ("base", pa.string()), *((c, pa.list_(pa.int32())) for c in ("starts", "ends", "patterns")), ("columns", pa.list_(pa.list_(pa.int32())))]
    )
    for batch in batches:
        out = {k: [] for k in kind.names}
        for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = value.as_py() or ""
            base = base_spans(text)
            said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
            seen = base + firsts(apart(more_candidates(text), base))
            made = [(k, votes(text, a, k, b), b - a) for a, k, b in seen]
            out["doc_id"].append(doc_id)
            n = Counter(k for _, k, _ in base)
            out["n"].append([n[i] for i in range(len(BASE))])
            out["base_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
            out["base"].append(said)
            out["starts"].append([a for a, _, _ in seen])
            out["ends"].append([b for _, _, b in seen])
            out["patterns"].append([_pattern(*x) for x in made])
            out["columns"].append([_plain_columns(*x) + [_PLAIN + c for c in hashed(text, a, k, b)] for x, (a, k, b) in zip(made, seen, strict=True)])
        yield pa.RecordBatch.from_pydict(out, schema=kind)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: (posterior of each pattern, labelers' reliabilities [class, labeler, vote]).

    Labelers are taken as independent given the class, and one that says nothing
    tells nothing; each kind has a share of its own that is meant. The start
    trusts each labeler a little; pseudo-counts keep every vote possible and
    hold the share of a rare kind near ``MEANT``.
    """
    rank, vote, _ = _unpacked(patterns)
    start = np.array([TRUSTED[::-1], TRUSTED])[:, None, :] * np.ones((1, len(VOTERS), 1))
    trust, share = start, np.array([MEANT.get(k, 0.9) for k in KINDS])
    prior = share
    one_hot = np.eye(3)[vote]
    one_hot[:, :, 1] = 0
    post = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.einsum("nlv,clv->nc", one_hot, np.log(np.maximum(trust, 1e-12))) + np.log([1 - prior[rank], prior[rank]]).T
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        seen = np.stack([np.einsum("n,nlv->lv", p * counts, one_hot) for p in (1 - post, post)]) + TRUST_WORTH * start
        trust = seen / seen.sum(2, keepdims=True)
        held = np.bincount(rank, post * counts, len(KINDS)) + MEANT_WORTH * share
        prior = held / (np.bincount(rank, counts, len(KINDS)) + MEANT_WORTH)
    return post, trust


#: Columns of kind, votes and length class; those of hashed words and shapes come after.
_PLAIN = len(KINDS) + 3 * len(VOTERS) + LENGTH_CLASSES


def _plain_columns(rank: int, vote: tuple[int, ...], length: int) -> list[int]:
    return [rank, *(len(KINDS) + 3 * i + v for i, v in enumerate(vote) if v != 1), len(KINDS) + 3 * len(VOTERS) + min(LENGTH_CLASSES - 1, length // 8)]


def _features(patterns: np.ndarray) -> np.ndarray:
    rank, vote, length = _unpacked(patterns)
    return np.hstack([np.eye(len(KINDS))[rank], (np.eye(3) * [1, 0, 1])[vote].reshape(len(patterns), -1), np.eye(LENGTH_CLASSES)[length]])


def train(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray, steps: int = 30, ridge: float = 1.0, x: np.ndarray | None = None) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the posteriors, by Newton's method.

    Without ``x`` the features are those of the patterns alone.
    """
    x = _features(patterns) if x is None else x
    w = np.zeros(x.shape[1])
    scale = counts / max(1.0, counts.sum()) * min(1000.0, counts.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (scale * (p - post)) + ridge * w
        hess = (x * (scale * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(scanned: DataFrame) -> np.ndarray:
    """The classifier's weights: posteriors from counts over all scanned spans (a few thousand rows), features of a sample."""
    spans = scanned.select("doc_id", F.explode(F.arrays_zip("starts", "patterns", "columns")).alias("x"))
    rows = spans.groupBy(F.col("x.patterns").alias("p")).count().orderBy("p").collect()
    patterns, counts = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], float)
    if not len(rows):
        return np.zeros(_PLAIN + HASHED)
    post, _ = estimate(patterns, counts)
    kind = F.floor(F.col("x.patterns") / F.lit(LENGTH_CLASSES * 3 ** len(VOTERS)))
    order = Window.partitionBy(kind).orderBy(F.xxhash64("doc_id", "x.starts", "x.patterns"), "doc_id", "x.starts")
    held = spans.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE // len(KINDS)).select("x.patterns", "x.columns").collect()
    held = sorted((r.patterns, r.columns) for r in held)
    x = np.zeros((len(held), _PLAIN + HASHED))
    for k, (_, columns) in enumerate(held):
        x[k, columns] = 1
    own = np.array([p for p, _ in held], int)
    meant = post[np.searchsorted(patterns, own)]
    return train(own, (2 * meant - 1) ** 2, meant, x=x)  # spans of which the labelers know little teach little


def private_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, digest of the base spans, all spans."""
    scanned = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, _SCHEMA), "private")
    weights = F.array(*[F.lit(float(w)) for w in fit(scanned)])
    rank = lambda p: F.floor(p / F.lit(LENGTH_CLASSES * 3 ** len(VOTERS))).cast("int")
    names = F.array(*[F.lit(k) for k in KINDS])
    odds = lambda columns: F.aggregate(columns, F.lit(0.0), lambda s, c: s + F.get(weights, c))
    spans = F.filter(F.arrays_zip("starts", "ends", "patterns", "columns"), lambda x: (rank(x["patterns"]) < len(BASE)) | (odds(x["columns"]) >= 0))
    spans = F.array_sort(F.transform(spans, lambda x: F.struct(x["starts"].alias("a"), rank(x["patterns"]).alias("k"), x["ends"].alias("b"))))
    said = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"], x["b"])), ",")
    return scanned.select("doc_id", *[F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(BASE)], "base_sha256", said.alias("spans"))
