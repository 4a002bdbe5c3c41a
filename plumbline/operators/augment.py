"""Correct candidates as additional training items, and holdouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered

STATUS = ["skipped_below_min_count", "skipped_parse_or_distance_error", "skipped_same_as_gold", "skipped_over_max_distance", "deduped_correct_candidates", "over_cap", "augmented"]


def augmentation(candidates: DataFrame, keys: list[str] = ["sample_id"], min_count: int = 1, max_distance: float | None = None, most: int = 1) -> DataFrame:  # noqa: B006
    """Candidates (keys, pos, sql, count, normalized, gold_normalized, distance) with status and, for augmented ones, rank.

    Of those with one normal form the nearest counts, then the most frequent, then the first. They are ranked by distance,
    frequency and length of the text; with most > 0 only the first ranks are augmented. A null count is 1; a null normal form
    or distance is an error."""
    n = F.coalesce("count", F.lit(1))
    status = F.when(n < min_count, STATUS[0]).when(F.col("normalized").isNull(), STATUS[1]).when(F.col("normalized") == F.col("gold_normalized"), STATUS[2]).when(F.col("distance").isNull(), STATUS[1])
    if max_distance is not None:
        status = status.when(F.col("distance") > max_distance, STATUS[3])
    rows = candidates.withColumns({"count": n, "status": status})
    fit = F.col("status").isNull()
    near = [F.col("distance"), F.desc("count")]
    first = F.row_number().over(Window.partitionBy(*keys, "normalized", fit).orderBy(*near, "pos"))
    rows = rows.withColumn("status", F.when(fit & (first > 1), STATUS[4]).otherwise(F.col("status")))
    place = F.row_number().over(Window.partitionBy(*keys, F.col("status").isNull()).orderBy(*near, F.length("sql"), "pos"))
    rows = rows.withColumn("rank", F.when(F.col("status").isNull(), place))
    over = F.lit(False) if most <= 0 else F.col("rank") > most
    return rows.withColumn("status", F.coalesce("status", F.when(over, STATUS[5]).otherwise(STATUS[6]))).withColumn("rank", F.when(F.col("status") == STATUS[6], F.col("rank")))


def with_augmented(items: DataFrame, augmented: DataFrame) -> DataFrame:
    """Items followed by augmented ones; columns that one side lacks are null there."""
    return items.unionByName(augmented, allowMissingColumns=True)


def holdout_size(n: int, ratio: float) -> int:
    """ceil(n * ratio), at least 1 and at most n - 1; none for a ratio of 0 or less or fewer than 2 rows."""
    if ratio >= 1:
        raise ValueError("the ratio must be under 1")
    return 0 if ratio <= 0 or n < 2 else max(1, min(n - 1, -int(-(n * ratio) // 1)))


def holdout(df: DataFrame, ratio: float, seed: int, key: str) -> DataFrame:
    """df with held_out: the first holdout_size rows by md5 of `key:seed` (ties by key). Deterministic; keys should be unique."""
    size = holdout_size(df.count(), ratio)
    if not size:
        return df.withColumn("held_out", F.lit(False))
    marked = df.withColumn("__m", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("__k", F.conv(F.left("__m", F.lit(13)), 16, 10).cast("long"))
    return numbered(marked, "__k", "__m", key, into="__n").withColumn("held_out", F.col("__n") <= size).drop("__m", "__k", "__n")
