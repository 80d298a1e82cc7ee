"""Quality rules with thresholds learnt per language and source.

Signals are whole numbers made with built-in expressions only. Their
distribution is kept per (language, source) in a quantile sketch: a count for
each value cut to its seven leading bits. Such counts add up, so sketches of
partitions merge exactly, in any order, and each quantile is at most 1/64 below
the true one. The fences that come from the quantiles replace fixed cutoffs.

Defined cases: a null or empty text has no words and fails the base rule; null
languages and sources form groups of their own; repeated rows count as often
as they come; an empty table gives an empty result; other columns are ignored
by :func:`quality_report` and kept as they are by :func:`quality_filter`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import BLANKS, materialise, small, words

#: Fewer words than this fail.
MIN_WORDS = 50
#: A text fails if its repeated words are more than this share, in percent.
MAX_REPEATED_PERCENT = 50
#: A fence lies this many spreads beyond the quartile.
REACH = 3
#: Signals with the spread that a group has at least (so that a constant group
#: doesn't reject the next value): symbols and repeated words per 1000 words,
#: repeated lines per 1000 lines, hundredths of a character per word.
LEAST_SPREAD = {"symbol_rate": 30, "dup_line_rate": 150, "repeat_rate": 100, "word_length": 100}
#: Signals for which small values are suspect too.
TWO_SIDED = ("word_length",)
SYMBOLS = "#*$%&|<>"
_POSITION_BITS = 21


def _windows(ws: Column, n: Column):
    """The 3-word windows as longs that hold 43 bits of a hash and the position.

    Also the functions that give a word by position and a long's position. Once
    sorted, neighbours that agree are compared word by word; if any differ, or the
    text has too many words for the position, the windows themselves are sorted.
    """
    mask = (1 << _POSITION_BITS) - 1
    at = lambda i, k: F.get(ws, (i + k).cast("int"))
    pos = lambda x: x.bitwiseAND(F.lit(mask))
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.shiftleft(F.shiftright(F.xxhash64(at(i, 0), at(i, 1), at(i, 2)), _POSITION_BITS), _POSITION_BITS).bitwiseOR(i.cast("long")),
    )
    return packed, at, pos


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows at sorted, distinct positions."""
    return F.when(F.size(positions) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(
            positions,
            F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), p - s["last"])).alias("n")),
            lambda s: s["n"],
        )
    )


def with_signals(df: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words (long).

    Each step is its own projection, so that no array is made twice.
    """
    p = lambda name: f"{prefix}{name}"
    kept = list(df.columns)
    df = df.withColumn(p("_t"), F.coalesce(text, F.lit("")))
    df = df.withColumn(p("_w"), words(F.col(p("_t"))))
    ws, n = F.col(p("_w")), F.size(F.col(p("_w")))
    bare = F.array_join(ws, "")
    cut = F.col(p("_j"))
    for s in SYMBOLS:
        cut = F.replace(cut, F.lit(s), F.lit(""))
    lines = F.filter(F.split(F.col(p("_t")), "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    packed, at, pos = _windows(ws, n)
    df = df.withColumns({p("_j"): bare, p("_l"): lines, p("_s"): F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))})
    s, m = F.col(p("_s")), F.size(F.col(p("_s")))
    df = df.withColumns(
        {
            p("n_words"): n.cast("long"),
            p("word_chars"): F.char_length(F.col(p("_j"))).cast("long"),
            p("n_symbols"): (F.octet_length(F.col(p("_j"))) - F.octet_length(cut)).cast("long"),
            p("n_lines"): F.size(F.col(p("_l"))).cast("long"),
            p("n_dup_lines"): (F.size(F.col(p("_l"))) - F.size(F.array_distinct(F.col(p("_l"))))).cast("long"),
            p("_k"): F.when(
                m >= 2,
                F.filter(F.sequence(F.lit(0), m - 2), lambda k: F.shiftright(F.get(s, k), _POSITION_BITS) == F.shiftright(F.get(s, k + 1), _POSITION_BITS)),
            ).otherwise(F.array().cast("array<int>")),
        }
    )
    k = F.col(p("_k"))
    a, b = lambda x: pos(F.get(s, x)), lambda x: pos(F.get(s, x + 1))
    differ = F.exists(k, lambda x: ~((at(a(x), 0) == at(b(x), 0)) & (at(a(x), 1) == at(b(x), 1)) & (at(a(x), 2) == at(b(x), 2))))
    fast = F.sort_array(F.array_distinct(F.flatten(F.transform(k, lambda x: F.array(a(x), b(x))))))
    whole = F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(at(i, 0).alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c"), i.cast("long").alias("i"))))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    slow = F.sort_array(
        F.transform(
            F.filter(whole, lambda x, i: ((i > 0) & same(x, F.get(whole, i - 1))) | F.coalesce(same(x, F.get(whole, i + 1)), F.lit(False))),
            lambda x: x["i"],
        )
    )
    df = df.withColumn(p("_d"), F.when((n > (1 << _POSITION_BITS)) | differ, slow).otherwise(fast))
    # The zero comes from the row number: the optimiser moves no filter below a
    # projection that isn't deterministic, and so never unfolds these steps into one.
    zero = F.least(F.monotonically_increasing_id(), F.lit(0).cast("long"))
    df = df.withColumn(p("n_repeat_words"), _covered(F.col(p("_d"))) + zero)
    return df.select(*[F.col(c) for c in kept], *[F.col(p(c)) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The base rule: too few words, or too many of them in repeated windows."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def rates(c) -> dict[str, Column]:
    """The signals that get fences, as whole numbers; ``c`` maps a count's name to its column."""
    over = lambda x, y: F.call_function("div", x, F.greatest(y, F.lit(1)))
    return {
        "symbol_rate": over(1000 * c("n_symbols"), c("n_words")),
        "dup_line_rate": over(1000 * c("n_dup_lines"), c("n_lines")),
        "repeat_rate": over(1000 * c("n_repeat_words"), c("n_words")),
        "word_length": over(100 * c("word_chars"), c("n_words")),
    }


def cell(v: Column) -> Column:
    """``v`` cut to its seven leading bits."""
    cut = F.greatest(F.char_length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, cut), cut)


def sketch(signals: DataFrame) -> DataFrame:
    """Counts of each cell per group and signal: one row for (lang, source, signal, cell).

    Partial sums are made before the shuffle, so a hot group costs a row for
    each cell and task, not for each document.
    """
    made = rates(F.col)
    passing = signals.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), cell(v).alias("cell")) for k, v in made.items()]))
    long = passing.select("lang", "source", pairs.alias("x")).select("lang", "source", "x.signal", "x.cell")
    return long.groupBy("lang", "source", "signal", "cell").agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of several: counts add up."""
    out = sketches[0]
    for more in sketches[1:]:
        out = out.unionByName(more)
    return out.groupBy("lang", "source", "signal", "cell").agg(F.sum("n").alias("n"))


def fences(counts: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per (lang, source): ``<signal>_low`` and ``<signal>_high`` from the quartiles."""
    by = ["lang", "source", "signal"]
    w = Window.partitionBy(*by)
    run = counts.withColumns({"upto": F.sum("n").over(w.orderBy("cell")), "of": F.sum("n").over(w)})
    q = lambda pct: F.min(F.when(100 * F.col("upto") >= pct * F.col("of"), F.col("cell")))
    each = run.groupBy(*by).agg(q(25).alias("q1"), q(75).alias("q3"))
    out = []
    for name, least in LEAST_SPREAD.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least).cast("long"))
        own = F.col("signal") == name
        out.append(F.max(F.when(own, F.col("q3") + reach * spread)).alias(f"{name}_high"))
        if name in TWO_SIDED:
            out.append(F.max(F.when(own, F.col("q1") - reach * spread)).alias(f"{name}_low"))
    return each.groupBy("lang", "source").agg(*out)


def _inside(c) -> Column:
    """Whether all signals lie within the fences; a group without fences has none to break."""
    ok = F.lit(True)
    for name, v in rates(c).items():
        ok = ok & F.coalesce(v <= F.col(f"fence.{name}_high"), F.lit(True))
        if name in TWO_SIDED:
            ok = ok & F.coalesce(v >= F.col(f"fence.{name}_low"), F.lit(True))
    return ok


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Fences of all of ``docs``, written to shared scratch (a row per group)."""
    slim = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    return materialise(fences(sketch(with_signals(slim, F.col("text")).drop("text"))), "fences")


def _judged(df: DataFrame, limits: DataFrame, lang: Column, source: Column) -> DataFrame:
    """``df`` joined to its group's fences as a struct column; broadcast if they are few."""
    side = small(limits.select(F.struct("*").alias("fence")))
    return df.join(side, lang.eqNullSafe(F.col("fence.lang")) & source.eqNullSafe(F.col("fence.source")), "left")


def quality_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed and kept.

    The counts are made once, written to shared scratch (a few dozen bytes a
    document) and read for the sketch and for the verdict.
    """
    counted = materialise(with_signals(docs.select("doc_id", "lang", "source", "text"), F.col("text")).drop("text"), "signals")
    limits = materialise(fences(sketch(counted)), "fences")
    fail = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return _judged(counted, limits, F.col("lang"), F.col("source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fail.alias("base_failed"), (~fail & _inside(F.col)).alias("kept")
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Signals are made once, written to shared scratch with their rows and read
    for the sketch (without texts) and for the verdict; nothing is shuffled but
    sketch cells. Rows are carried as one struct, so names of other columns
    can't clash.
    """
    held = materialise(with_signals(docs.select(F.struct("*").alias("row")), F.col("row.text")), "signals")
    limits = materialise(fences(sketch(held.withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")}))), "fences")
    judged = _judged(held, limits, F.col("row.lang"), F.col("row.source"))
    fail = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judged.filter(F.coalesce(~fail & _inside(F.col), F.lit(False))).select("row.*")


def _sql_rates(prefix: str = "") -> dict[str, str]:
    over = lambda x, y: f"({x}) // greatest({prefix}{y}, 1)"
    p = prefix
    return {
        "symbol_rate": over(f"1000 * {p}n_symbols", "n_words"),
        "dup_line_rate": over(f"1000 * {p}n_dup_lines", "n_lines"),
        "repeat_rate": over(f"1000 * {p}n_repeat_words", "n_words"),
        "word_length": over(f"100 * {p}word_chars", "n_words"),
    }


def oracle() -> str:
    """The report as SQL for DuckDB."""
    rates = _sql_rates()
    cells = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS signal, {v} AS v FROM c WHERE NOT base_failed" for k, v in rates.items())
    spread = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST_SPREAD.items())
    limits = ", ".join(f"max(CASE WHEN signal = '{k}' THEN high END) AS {k}_high" + (f", max(CASE WHEN signal = '{k}' THEN low END) AS {k}_low" if k in TWO_SIDED else "") for k in rates)
    inside = " AND ".join(f"coalesce({v} <= f.{k}_high, true)" + (f" AND coalesce({v} >= f.{k}_low, true)" if k in TWO_SIDED else "") for k, v in _sql_rates("c.").items())
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k+2], ' '))) AS x FROM w WHERE len(w) >= 3),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g), (VALUES (0), (1), (2)) t(k) WHERE n > 1 GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(array_to_string(w, '')) - length(translate(array_to_string(w, ''), '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
c AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM b),
v AS (SELECT lang, source, signal, ((v::BIGINT >> greatest(length(bin(v::BIGINT)) - 7, 0)) << greatest(length(bin(v::BIGINT)) - 7, 0)) AS cell FROM ({cells})),
s AS (SELECT lang, source, signal, cell, count(*) AS n FROM v GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, signal ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY lang, source, signal) AS total FROM s),
q AS (SELECT lang, source, signal, min(cell) FILTER (100 * upto >= 25 * total) AS q1, min(cell) FILTER (100 * upto >= 75 * total) AS q3 FROM u GROUP BY ALL),
e AS (SELECT lang, source, signal, q3 + {REACH} * greatest(q3 - q1, CASE signal {spread} END) AS high, q1 - {REACH} * greatest(q3 - q1, CASE signal {spread} END) AS low FROM q),
f AS (SELECT lang, source, {limits} FROM e GROUP BY lang, source)
SELECT c.doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed, NOT c.base_failed AND {inside} AS kept
FROM c LEFT JOIN f ON f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source
"""
