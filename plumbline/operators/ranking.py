"""Ranks over a whole table without one task that sorts it all.

Approximate quantiles of a numeric key cut the table into ranges; a range's rows are ranked by themselves and shifted by the
number of rows in the ranges before. The only window over everything has one row for each range. The table is read more than
once, so that what it holds must not change from one reading to the next (as ids of partitions may)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, STEP = 256, 16


def _ranged(df: DataFrame, key: Column, weight: Column, ranges: int) -> DataFrame:
    """Adds __r, the range of the key, and __base, the weight of all ranges before. A null key has a range of its own, the last."""
    cuts = df.agg(F.percentile_approx(key.cast("double"), [i / ranges for i in range(1, ranges)], 10_000).alias("__cuts"))
    cuts = cuts.select(F.array_distinct("__cuts").alias("__cuts"))
    # every STEP-th cut first, then the STEP cuts after the last of those under the key
    cuts = cuts.withColumn("__coarse", F.filter("__cuts", lambda c, i: i % STEP == STEP - 1))
    rows = df.crossJoin(F.broadcast(cuts))  # one row
    under = lambda cs: F.size(F.filter(cs, lambda c: c < key.cast("double")))
    rows = rows.withColumn("__at", under(F.col("__coarse")) * STEP)
    at = F.col("__at") + under(F.slice("__cuts", F.col("__at") + 1, F.lit(STEP)))
    rows = rows.withColumn("__r", F.when(key.isNull(), ranges).otherwise(F.coalesce(at, F.lit(0)))).drop("__cuts", "__coarse", "__at")
    sums = rows.groupBy("__r").agg(F.sum(weight).alias("__w"))
    base = sums.select("__r", (F.sum("__w").over(Window.orderBy("__r")) - F.col("__w")).alias("__base"))  # at most ranges + 1 rows
    return rows.join(F.broadcast(base), "__r")


def numbered(df: DataFrame, key: str, *ties: str, into: str = "place", ranges: int = RANGES) -> DataFrame:
    """Adds the place, from 1, of each row by a numeric key (nulls last) and then the other columns, which should make rows unique."""
    rows = _ranged(df, F.col(key), F.lit(1), ranges)
    own = F.row_number().over(Window.partitionBy("__r").orderBy(F.col(key).asc_nulls_last(), *ties))
    return rows.withColumn(into, own + F.col("__base")).drop("__r", "__base")


def average_ranks(df: DataFrame, key: str, into: str = "rank", ranges: int = RANGES) -> DataFrame:
    """(key, n, rank): distinct values of a numeric column that are not null, how many rows have each, and their average rank."""
    groups = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    rows = _ranged(groups, F.col(key), F.col("n"), ranges)
    upto = F.sum("n").over(Window.partitionBy("__r").orderBy(key))
    return rows.select(key, "n", (F.col("__base") + upto - F.col("n") + (F.col("n") + 1) / 2).alias(into))


def sorted_entries(entries: Column, by: str = "value", falling: bool = True) -> Column:
    """A map's entries, array<struct<key, value>>, by value or key; equal ones keep their order."""
    rows = F.transform(F.map_entries(entries), lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    sign = -1 if falling else 1
    order = lambda a, b: F.when(a["e"][by] < b["e"][by], -sign).when(a["e"][by] > b["e"][by], sign).otherwise(a["i"] - b["i"])
    return F.transform(F.array_sort(rows, order), lambda r: r["e"])
