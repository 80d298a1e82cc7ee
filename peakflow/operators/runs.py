"""Several runs in one table: where a table has a ``run_id``, it is part of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = "run_id"


def keys(df: DataFrame, *names: str) -> list[str]:
    """``names``, after the run's if ``df`` has one."""
    return [RUN, *names] if RUN in df.columns else list(names)


def same_run(a: DataFrame, b: DataFrame) -> list[str]:
    """The run's name if both tables have it: what they are also joined on."""
    return [RUN] if RUN in a.columns and RUN in b.columns else []


def in_run(a: str, b: str, names: list[str]) -> list[Column]:
    """Null-safe conditions that two aliases agree in ``names``."""
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on plain ``names`` and, null-safe, on the run if both have it; the left side's keys are kept."""
    run = same_run(left, right)
    if not run:
        return left.join(right, names, how)
    right = right.withColumnsRenamed({c: f"_{c}" for c in (*names, RUN)})
    on = [left[c] == right[f"_{c}"] for c in names] + [left[RUN].eqNullSafe(right[f"_{RUN}"])]
    return left.join(right, on, how).drop(*[f"_{c}" for c in (*names, RUN)])


def with_runs(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Each row once for each run of ``runs``, if it does not say its own; runs are few rows."""
    if RUN not in runs.columns or RUN in df.columns:
        return df
    return df.crossJoin(F.broadcast(runs.select(RUN).distinct()))
