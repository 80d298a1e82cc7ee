"""The engine's tables made from the driver's star-schema tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")
    line, quad = F.col("l_linenumber"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("int") - 2)
    return table(spark, sf_dir, "lineitem").select(
        F.when(line == 1, 1).otherwise(2).alias("ms_level"), quad.alias("quad_major"), F.when(line > 1, 0).alias("quad_sub"), day.alias("frame_index"), (day * 0.5).alias("rt"),
        (F.col("l_suppkey") % 100).cast("bigint").alias("scan_index"), F.col("l_partkey").cast("bigint").alias("tof_index"), (F.col("l_quantity") * F.col("l_quantity")).cast("bigint").alias("intensity"),
    )


def quads(spark: SparkSession) -> DataFrame:
    q = F.col("id").cast("int")
    return spark.range(6).select(
        q.alias("quad_major"), F.lit(0).alias("quad_sub"), (q * 15).cast("bigint").alias("scan_start"), (q * 15 + 30).cast("bigint").alias("scan_end"), (901.0 + 18 * q).alias("isolation_mz"), F.lit(20.0).alias("isolation_width"),
        (891.0 + 18 * q).alias("isolation_low"), (911.0 + 18 * q).alias("isolation_high"), F.lit(0.0).alias("collision_energy"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    keys = F.explode(F.sequence(F.lit(-1), F.lit(4)))
    t = part.crossJoin(F.broadcast(n)).select("p_partkey", "p_retailprice", "p_size", "n", keys.alias("k"))
    key, size, k, price = F.col("p_partkey").cast("bigint"), F.col("p_size").cast("bigint"), F.col("k"), F.col("p_retailprice").cast("double")
    tof = (key + 37 * (k + 1)) % F.col("n")
    rt = lambda x: (x.cast("float") * 0.5).cast("float")
    return t.select(
        key.alias("eg_id"), F.when(k < 0, 1).otherwise(2).alias("ms_level"), k.cast("string").alias("transition_key"), (tof - 2).alias("tof_lo"), (tof + 2).alias("tof_hi"), (key % 100 - 20).alias("scan_lo"), (key % 100 + 20).alias("scan_hi"),
        (size * 40 - 200).alias("frame_lo"), (size * 40 + 200).alias("frame_hi"), rt(size * 40 - 200).alias("rt_lo"), rt(size * 40 + 200).alias("rt_hi"), (price - 0.1).alias("iso_lo"), (price + 0.1).alias("iso_hi"), (k + 2).cast("double").alias("expected_intensity"),
    )


def csr_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All peaks as CSR frames, one for each instant, MS level and quad."""
    from ..operators.expand import collect_frames

    return collect_frames(peaks(spark, sf_dir), ("quad_major",))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an elution group: two precursors, three fragments, some expected intensities."""
    mz = F.col("p_retailprice").cast("double")
    few = lambda *x: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in x])
    single = lambda v: F.lit(v).cast("float")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("bigint").alias("id"), F.col("p_size").cast("float").alias("mobility"), (F.col("p_size") * 40).cast("float").alias("rt_seconds"), F.array(mz, mz + 0.5).alias("precursor_mzs"),
        few("b1", mz / 2, "b2", mz / 2 + 10, "y1", mz / 3 + 100).alias("fragment_mzs"), few("b1", single(2.0), "y1", single(5.0)).alias("expected_fragment_intensity"), F.array(single(1.0)).alias("expected_precursor_intensity"),
    )
