r"""Secret scan: fixed patterns, and entropy of sliding windows over candidate strings.

Only built-in expressions. A pattern's matches come from ``regexp_extract_all``
and the text between them from ``split``; running sums of their lengths, made
by doubling, give positions in code points. Over each candidate folds slide a
window: the count of the entering and of the leaving character change two cells
of a packed table of counts and the sum of c*log2(c), kept as a whole number, so
no rounding adds up. A long candidate is folded in blocks of windows, whose hot
spans are then joined. A window whose entropy reaches its class's threshold is
hot; hot windows that overlap or touch make one span. A candidate's class is
that of its characters; signs between runs of letters and digits of one case,
as in ``key-3ax6...``, do not count for it, but runs that are words, numbers or
UUIDs are no evidence: slugs have no class, nor have names in camel case.

Defined cases: a null text counts as empty; an empty text has no spans and the
digest of the empty string; repeated rows are scanned one by one; an empty table
gives an empty result; other columns are ignored. Patterns repeat single
characters only, never groups, so that the matcher does not recurse: a candidate
costs time in proportion to its length, and a text of n hits n*log(n) steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Lengths are checked after the match, except
# where a longer minimum gives the same matches (runs that can't start later).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 6

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
WINDOW = 20
#: Character class, its pattern over a whole candidate, and the bits a window needs.
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$|^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", 3.5),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 3.7),
)
#: Letters and digits of one case with signs, where the runs that mix both have so many characters together; the bits.
SEPARATED = r"^[0-9a-z+/_=-]+$|^[0-9A-Z+/_=-]+$"
SEPARATED_LEAST, SEPARATED_BITS = 12, 3.5
PLAIN_RUN = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|(?<![A-Za-z0-9])(?:[A-Za-z]+|[0-9]+)(?![A-Za-z0-9])|[+/_=-]"
#: Letters of both cases without a digit, but for those that are nothing but words in camel case; the bits.
LETTERS = r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z+/_=-]+$"
CAMEL_WORD = r"^[a-z]+|(?<![A-Z])[A-Z][a-z]+|(?<![A-Z])[A-Z]{2,5}[a-z]{3,}|(?<![A-Z])[A-Z]{1,5}$|[+/_=-]"
LETTERS_BITS = 3.7
#: Candidates that are never secrets: UUIDs, words joined by signs, counted runs, examples.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?=.*[+/_=-][A-Za-z])[A-Za-z+/_=-]*+[0-9]{0,4}$",
    r"(?i)0123456789|abcdefghij",
    r"(?i)example|placeholder|changeme|xxxxxxxx",
)


def _running(values: Column, step) -> Column:
    """The running ``step`` (sum or greatest) over an array, by doubling: n*log(n) steps and no array that grows."""
    size = F.char_length(F.bin(F.greatest(F.size(values) - 1, F.lit(0)).cast("long")))
    before = lambda acc, i, k: F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(F.sequence(F.lit(0), size - 1), values, lambda acc, k: F.transform(acc, lambda v, i: step(v, before(acc, i, k))))


def _spans(text: Column, pattern: str, kind: str, ok=None) -> Column:
    """Array of (start, rank, end, kind, hit) for a pattern's matches that pass ``ok``."""
    kind_of = "array<struct<start:int,rank:int,end:int,kind:string,hit:string>>"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # An array in an array stands for a name: what a lambda is given is made once.
    made = F.transform(
        F.array(F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("g"))),
        lambda x: F.struct(
            F.transform(x, lambda y: y["h"]).alias("h"),
            _running(F.transform(x, lambda y: F.char_length(y["g"]) + F.char_length(y["h"])), lambda v, w: v + F.coalesce(w, F.lit(0))).alias("e"),
        ),
    )
    placed = F.flatten(
        F.transform(
            made,
            lambda x: F.transform(
                F.arrays_zip(x["h"].alias("h"), x["e"].alias("e")),
                lambda y: F.struct((y["e"] - F.char_length(y["h"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), y["e"].alias("end"), F.lit(kind).alias("kind"), y["h"].alias("hit")),
            ),
        )
    ).cast(kind_of)
    placed = F.filter(placed, ok) if ok else placed
    return F.when(F.regexp_like(text, F.lit(pattern)), placed).otherwise(F.array().cast(kind_of))


def _class_bits(run: Column) -> Column:
    """Bits that a window of this candidate needs; null if it has no class or is allowed."""
    mixed = F.char_length(F.regexp_replace(run, PLAIN_RUN, ""))
    bits = F.when(run.rlike(SEPARATED) & (mixed >= SEPARATED_LEAST), F.lit(SEPARATED_BITS)).when(run.rlike(LETTERS) & (F.regexp_replace(run, CAMEL_WORD, "") != ""), F.lit(LETTERS_BITS))
    for _, pattern, least in reversed(CLASSES):
        bits = F.when(run.rlike(pattern), F.lit(least)).otherwise(bits)
    for pattern in ALLOWED:
        bits = F.when(run.rlike(pattern), F.lit(None).cast("double")).otherwise(bits)
    return bits


_UNIT = 1 << 20
#: c*log2(c) for counts up to the window, as whole numbers.
_TERMS = [round(_UNIT * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]
#: Counts are packed: bits of one (the window's size fits), counts in one number.
_BITS, _PACKED = 5, 12
#: Windows that one fold slides over.
BLOCK = 1024


def _hot() -> str:
    """SQL of the folds over ``x.codes`` (places in the alphabet) with threshold ``x.bits``: hot spans (start, end) in order.

    State: i (characters read), n (counts by character, packed), s (sum of c*log2(c)), a and e (open span, -1 if none), out.
    """
    terms = "array(" + ",".join(f"{t}L" for t in _TERMS) + ")"
    most = round(_UNIT * WINDOW * math.log2(WINDOW))
    kind = "struct<i:int,n:array<bigint>,s:bigint,a:int,e:int,out:array<struct<start:int,end:int>>>"
    count = lambda c: f"cast(shiftright(get(t.n, {c} div {_PACKED}), {_BITS} * ({c} % {_PACKED})) & {(1 << _BITS) - 1} as int)"
    one = lambda c: f"if(j = {c} div {_PACKED}, shiftleft(1L, {_BITS} * ({c} % {_PACKED})), 0L)"
    term = lambda n: f"get({terms}, {n})"
    hot = f"(u.i >= {WINDOW} and {most}L - u.s >= x.bits * {WINDOW * _UNIT})"
    fold = f"""aggregate(
      slice(x.codes, b * {BLOCK} + 1, {BLOCK + WINDOW - 1}),
      cast(named_struct('i', 0, 'n', array_repeat(0L, {-(-len(ALPHABET) // _PACKED)}), 's', 0L, 'a', -1, 'e', -1, 'out', array()) as {kind}),
      (t, c) -> aggregate(
        transform(array(if(t.i >= {WINDOW}, get(x.codes, b * {BLOCK} + t.i - {WINDOW}), -1)), o -> named_struct(
          'i', t.i + 1,
          'n', if(o = c, t.n, transform(t.n, (v, j) -> v + {one('c')} - if(o >= 0, {one('o')}, 0L))),
          's', if(o = c, t.s, t.s + {term(count('c') + ' + 1')} - {term(count('c'))} + if(o >= 0, {term(count('o') + ' - 1')} - {term(count('o'))}, 0L)))),
        t,
        (_, u) -> cast(named_struct(
          'i', u.i, 'n', u.n, 's', u.s,
          'a', if({hot} and t.e < u.i - {WINDOW}, u.i - {WINDOW}, t.a),
          'e', if({hot}, u.i, t.e),
          'out', if({hot} and t.e >= 0 and t.e < u.i - {WINDOW}, concat(t.out, array(named_struct('start', t.a, 'end', t.e))), t.out)) as {kind})),
      t -> transform(if(t.e >= 0, concat(t.out, array(named_struct('start', t.a, 'end', t.e))), t.out), w -> named_struct('start', b * {BLOCK} + w.start, 'end', b * {BLOCK} + w.end)))"""
    return f"flatten(transform(sequence(0, (size(x.codes) - {WINDOW}) div {BLOCK}), b -> {fold}))"


def _entropy_spans(name: str) -> str:
    """SQL that turns the candidate array column ``name`` into spans of kind entropy.

    Spans of neighbouring blocks that overlap or touch become one: those with a gap before them and those with a gap behind pair up.
    """
    codes = f"transform(split(c.hit, ''), y -> instr('{ALPHABET}', y) - 1)"
    joined = """zip_with(filter(h, (w, i) -> i = 0 or w.start > get(h, i - 1).end), filter(h, (w, i) -> i = size(h) - 1 or get(h, i + 1).start > w.end),
        (p, q) -> named_struct('start', x.start + p.start, 'rank', 3, 'end', x.start + q.end, 'kind', 'entropy'))"""
    return f"""flatten(transform(filter({name}, c -> c.bits is not null), c -> flatten(transform(array(named_struct('start', c.start, 'bits', c.bits, 'codes', {codes})),
      x -> flatten(transform(array({_hot()}), h -> {joined}))))))"""


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_spans(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``base`` and ``spans``: sorted arrays of (start, rank, end, kind).

    Entropy spans within a base span are left to it.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*kept, F.coalesce(text, F.lit("")).alias("_t"))
    long_enough = lambda x: F.char_length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= ASSIGN_LEAST
    df = df.select(
        *kept,
        _spans(F.col("_t"), ASSIGN, "assign", long_enough).alias("_assign"),
        _spans(F.col("_t"), ACCESS, "access").alias("_access"),
        _spans(F.col("_t"), HEX, "hex").alias("_hex"),
        F.transform(_spans(F.col("_t"), CANDIDATE, "entropy"), lambda x: F.struct(x["start"].alias("start"), x["hit"].alias("hit"), _class_bits(x["hit"]).alias("bits"))).alias("_runs"),
    )
    slim = lambda x: F.struct(*[x[k].alias(k) for k in ("start", "rank", "end", "kind")])
    df = df.select(*kept, F.array_sort(F.transform(F.concat("_assign", "_access", "_hex"), slim)).alias("base"), F.expr(_entropy_spans("_runs")).alias("_more"))
    df = df.select(*kept, "base", F.when(F.size("_more") > 0, F.array_sort(F.concat("base", "_more"))).otherwise(F.col("base")).alias("_all"), (F.size("_more") > 0).alias("_new"))
    # In order, a base span that holds an entropy span comes before it: the greatest end so far tells.
    held = _running(F.transform("_all", lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(-1)), lambda v, w: F.greatest(v, F.coalesce(w, F.lit(-1))))
    free = F.flatten(
        F.transform(
            F.array(F.struct(F.col("_all").alias("all"), held.alias("ends"))),
            lambda z: F.filter(z["all"], lambda x, i: (x["rank"] < 3) | (F.get(z["ends"], i) < x["end"])),
        )
    )
    return df.select(*kept, "base", F.when(F.col("_new"), free).otherwise(F.col("base")).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, digest of the base spans, all spans."""
    found = secret_spans(docs.select("doc_id", "text"), F.col("text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))
