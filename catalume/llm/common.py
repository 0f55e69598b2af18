"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009..U+000D (Java and DuckDB regex).
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, made from ``names`` (Spark ignores case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, group: list[str], bucket: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 in the order (bucket, order), without a hot task.

    A window over a whole group would put it into one task. Here equal rows are first counted
    (before the shuffle), each (group, bucket) is ordered on its own, and the counts of the
    buckets, few rows, give where each bucket starts. ``df`` must be narrow: all its columns are
    grouping keys. Returns one row per distinct row of ``df`` with ``out`` (number of the first)
    and ``n_rows`` (how many equal rows follow each other from there).
    """
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n_rows"))
    sums = g.groupBy(*group, *bucket).agg(F.sum("n_rows").alias("_in_bucket"))
    w = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_s_{c}") for c in (*group, *bucket)], F.coalesce(F.sum("_in_bucket").over(w), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = g.withColumn("_inside", F.coalesce(F.sum("n_rows").over(inside), F.lit(0)))
    on = None
    for c in (*group, *bucket):
        same = rows[c].eqNullSafe(starts[f"_s_{c}"])
        on = same if on is None else on & same
    return rows.join(starts, on).select(*df.columns, "n_rows", (F.col("_start") + F.col("_inside")).alias(out))
