"""Quotas, interleaving, first-wins and seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.runtime import shuffle_parts, staged


def seeded(seed: int, *keys: str) -> Column:
    """An order that looks random and is the same on any engine: the MD5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def quota(df: DataFrame, group: str, n: int, order: list) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, numbered in ``place``."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def interleave(df: DataFrame, group: str, order: list, limit: int | None = None) -> DataFrame:
    """Rows of the groups in turn: first rows of all groups by name, then second ones; ``turn`` is a row's number in its group. ``limit`` cuts after that.

    Rows are cut into ranges of group and order, counted, and numbered within their range; so a group
    that a third of all rows are is numbered by many tasks. A null group is a group.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = staged(df.repartitionByRange(shuffle_parts(df.sparkSession), F.col(group), *keys).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*keys))
    numbered = placed.withColumn("_in", inside).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    out = numbered.withColumn("turn", (F.col("_start") + F.col("_in")).cast("int")).select(*df.columns, "turn")
    return out if limit is None else out.orderBy("turn", F.col(group).asc_nulls_first()).limit(limit)
