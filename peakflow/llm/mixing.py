"""Mixing sources to target weights by Pareto order sampling.

Every source has a weight; the targets share the words of all documents, none
above ``MOST`` times its source's size (the excess goes to the others by
weight). A document first gets the whole copies that its source's ratio makes
certain. The fraction left is drawn: documents are ranked by the odds of a
keyed random number over the odds of their inclusion, which differ by source,
and taken in that order up to the size wanted in words. The number is a digest
of seed and id, so reruns agree on any cluster.

The cut in rank is found in two steps that no source's size can swamp: sums of
words in bins of the rank, then an exact order within the one bin that holds
the cut. Applying the plan is a look-up by source; texts are never shuffled.

Defined cases: a null text has no words and is taken as often as its source's
plan says, for 0 words; a null source is a source of its own, ordered last; a
null id is drawn as the text ``null``; rows that repeat an id are drawn
together; an empty table gives an empty result; other columns are ignored by
:func:`mix_report` and kept by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise, small, words

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
MOST = 3
BINS = 4096
_TOP = 1 << 52


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.size(words(text)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> tuple[Column, Column]:
    """(u, tie): a number in (0, 1) from a digest of seed and id, and the digest."""
    tie = F.sha2(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(tie, 1, 13), 16, 10).cast("long")
    return (h.cast("double") + 0.5) / F.lit(float(_TOP)), tie


def rank(u: Column, share: Column) -> Column:
    """Pareto rank in (0, 1): random odds over inclusion odds x, as x / (1 + x)."""
    x = F.try_divide(u / (1 - u), F.try_divide(share, 1 - share))
    return x / (1 + x)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size); one row a source.

    Sources are levelled in the order of size over weight: each that can't take
    its share gives the excess to those behind it.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("at", F.row_number().over(order) - 1)
    each = each.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")).cast("long"))
    full = 1
    for w in set(weights):
        full *= w
    up = Window.orderBy(F.call_function("div", F.col("source_size") * full, F.col("w")), "at").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    each = each.withColumns(
        {
            "left_words": F.sum("source_size").over(all_) - most * F.coalesce(F.sum("source_size").over(up), F.lit(0)),
            "left_weight": F.sum("w").over(all_) - F.coalesce(F.sum("w").over(up), F.lit(0)),
        }
    )
    each = each.withColumn("capped", most * F.col("source_size") * F.col("left_weight") <= F.col("w") * F.col("left_words"))
    open_ = ~F.col("capped")
    each = each.withColumns({"open_words": F.max(F.when(open_, F.col("left_words"))).over(all_), "open_weight": F.max(F.when(open_, F.col("left_weight"))).over(all_)})
    share = F.col("open_words").cast("double") * F.col("w").cast("double") / F.col("open_weight").cast("double")
    return each.select("source", "source_size", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row a source: source_size, target, whole copies, share left, and the rank where it is cut.

    ``docs`` has doc_id, source, size. A document is drawn if (rank, tie) is at most (cut, cut_tie).
    """
    by = materialise(targets(docs), "targets")
    ratio = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    by = by.withColumn("whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("long"))
    by = by.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    by = by.withColumn("share", F.coalesce(F.col("left") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0)))
    u, tie = draw(F.col("doc_id"), seed)
    side = small(by.select(F.struct("*").alias("of")))
    placed = docs.join(side, F.col("source").eqNullSafe(F.col("of.source"))).filter(F.col("of.share") > 0)
    placed = placed.select("source", "size", "of", rank(u, F.col("of.share")).alias("rank"), tie.alias("tie")).withColumn("bin", F.floor(F.col("rank") * BINS))
    bins = placed.groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("of.left").alias("left"))
    run = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("before", F.sum("n").over(run) - F.col("n"))
    edge = bins.filter((F.col("before") < F.col("left")) & (F.col("before") + F.col("n") >= F.col("left"))).select("source", "bin", "before")
    edge = materialise(edge, "edges")
    inside = placed.alias("p").join(small(edge).alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")) & (F.col("p.bin") == F.col("e.bin")))
    order = Window.partitionBy("p.source").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.select(F.col("p.source").alias("source"), "rank", "tie", "size", F.col("of.left").alias("left"), (F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))).alias("upto"))
    last = inside.filter(2 * F.col("upto") + F.col("size") <= 2 * F.col("left")).groupBy("source").agg(F.max(F.struct("rank", "tie")).alias("last"))
    e, p = edge.alias("e"), by.alias("b")
    out = p.join(e, F.col("b.source").eqNullSafe(F.col("e.source")), "left").join(last.alias("l"), F.col("b.source").eqNullSafe(F.col("l.source")), "left")
    floor_ = F.coalesce(F.col("e.bin") / F.lit(float(BINS)), F.when(F.col("b.share") > 0, F.lit(2.0)).otherwise(F.lit(-1.0)))
    return materialise(out.select("b.*", F.coalesce(F.col("l.last.rank"), floor_).alias("cut"), F.coalesce(F.col("l.last.tie"), F.lit("")).alias("cut_tie")), "mix")


def _copies(doc_id: Column, seed: str) -> Column:
    u, tie = draw(doc_id, seed)
    at = rank(u, F.col("of.share"))
    drawn = (F.col("of.share") > 0) & ((at < F.col("of.cut")) | ((at == F.col("of.cut")) & (tie <= F.col("of.cut_tie"))))
    return F.col("of.whole") + F.when(drawn, 1).otherwise(0)


def mix_report(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, words taken."""
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    side = small(plan(sized, seed).select(F.struct("*").alias("of")))
    out = sized.join(side, F.col("source").eqNullSafe(F.col("of.source")))
    return out.select("doc_id", "size", "of.source_size", "of.target", (F.col("size") * _copies(F.col("doc_id"), seed)).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    side = small(plan(sized, seed).select(F.struct("*").alias("of")))
    held = docs.select(F.struct("*").alias("row")).join(side, F.col("row.source").eqNullSafe(F.col("of.source")))
    times = held.withColumn("copies", _copies(F.col("row.doc_id"), seed)).filter("copies > 0")
    return times.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS size,
         sha256('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS tie FROM documents
), u AS (
  SELECT *, (CAST(('0x' || substr(tie, 1, 13)) AS BIGINT)::DOUBLE + 0.5) / {float(_TOP)!r} AS u FROM d
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END)::BIGINT AS w FROM s0
), s2 AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER up, 0) AS lw, sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS lg
  FROM s1 WINDOW up AS (ORDER BY source_size * 6 // w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (SELECT *, 3 * source_size * lg <= w * lw AS capped FROM s2
), s4 AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
    ELSE (max(lw) FILTER (NOT capped) OVER ())::DOUBLE * w::DOUBLE / (max(lg) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s4
), s6 AS (
  SELECT *, target - whole * source_size AS rest, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0 END AS share FROM s5
), r AS (
  SELECT u.doc_id, u.size, s6.source_size, s6.target, s6.whole, s6.rest, s6.share,
    sum(u.size) OVER (PARTITION BY u.source ORDER BY (u.u / (1 - u.u)), u.tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - u.size AS before
  FROM u JOIN s6 ON u.source IS NOT DISTINCT FROM s6.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (whole + CASE WHEN share > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
