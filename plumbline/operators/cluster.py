"""Candidate queries grouped by their text, and ordered de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.response import strip


def flattened(records: DataFrame, sqls: str = "all_sqls") -> DataFrame:
    """One row for each candidate of records (sample_id, record_index, all_sqls): adds sql_index from 0 and sql, stripped.

    Null and empty candidates are dropped; their places still count."""
    rows = records.select("*", F.posexplode(sqls).alias("sql_index", "__sql")).drop(sqls)
    return rows.withColumn("sql", strip(F.col("__sql"))).drop("__sql").filter(F.length("sql") > 0)


def clusters(candidates: DataFrame, keys: list[str] = ["sample_id"], text: str = "sql", places: list[str] = ["record_index", "sql_index"], occurrences: bool = True) -> DataFrame:  # noqa: B006
    """One row for each key and distinct text: count, occurrences in order, and first, the place where it was first seen.

    Partial counts are made before the shuffle; sort by the keys and `first` for first-seen order. A list of occurrences is a
    row, as long as its text is common: without `occurrences` there are only numbers and first places."""
    place = F.struct(*places)
    lists = [F.array_sort(F.collect_list(place)).alias("occurrences")] if occurrences else []
    return candidates.groupBy(*keys, text).agg(F.count("*").alias("count"), *lists, F.min(place).alias("first"))


def members(candidates: DataFrame, keys: list[str] = ["sample_id"], text: str = "sql", places: list[str] = ["record_index", "sql_index"]) -> DataFrame:  # noqa: B006
    """Each candidate beside its cluster's count and first place: what `occurrences` lists, as rows, however common a text is.

    Clusters are aggregated and joined again by a digest of the text, in a join that adaptive execution can split at a hot one."""
    rows = candidates.withColumn("__d", F.sha2(F.col(text), 256))
    by = [*keys, "__d"]
    found = clusters(rows, keys, "__d", places, occurrences=False).toDF(*[f"__k{i}" for i in range(len(by))], "count", "first")
    return rows.join(found, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)]).select(*candidates.columns, "count", "first")


def first_seen(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by `order`; nulls are a key too. An aggregate, so that a frequent key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]))
    return rows.groupBy(*keys).agg(best.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*rows.columns)


def first_value(value: str, order: str) -> Column:
    """The first value that is not null, by order."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))
