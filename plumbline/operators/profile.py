"""Column profiles, values and samples of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parts of names of columns that are not profiled, and the profile's limits.
SKIPPED_PARTS = ["_id", " id", "url", "email", "web", "time", "phone", "date", "address"]
NAME_TOTAL, OTHER_TOTAL, OTHER_MEAN = 5_000_000, 2_000_000, 25
SKIP_TOTAL, SKIP_MEAN = 50_000, 20


def profiled_columns(df: DataFrame, keys: list[str] = []) -> list[str]:  # noqa: B006
    """Text columns that are no keys and whose names don't look like ids, addresses or times."""
    low = {k.lower() for k in keys}
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name.lower() not in low and not any(p in f.name.lower() for p in SKIPPED_PARTS) and not f.name.endswith(("Id", "id"))]


def keep_rule(name: Column, total: Column, mean: Column) -> Column:
    """Whether a column's distinct values are worth keeping."""
    return (F.contains(F.lower(name), F.lit("name")) & (total < NAME_TOTAL)) | ((total < OTHER_TOTAL) & (mean < OTHER_MEAN))


def skip_rule(name: Column, total: Column, mean: Column) -> Column:
    """Whether a column's values are too long to search."""
    return ~F.contains(F.lower(name), F.lit("name")) & (total > SKIP_TOTAL) & (mean > SKIP_MEAN)


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) of several columns in one scan, nulls dropped."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))).filter("value is not null")


def column_profile(df: DataFrame, columns: list[str] | None = None, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(column_name, sum_of_lengths, count_distinct, average_length, kept) over distinct values that are not null; columns without any are left out."""
    columns = profiled_columns(df, keys) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, sum_of_lengths long, count_distinct long, average_length double, kept boolean")
    out = long_values(df, columns).distinct().groupBy("column_name").agg(F.sum(F.length("value")).alias("sum_of_lengths"), F.count("*").alias("count_distinct"))
    out = out.withColumn("average_length", F.col("sum_of_lengths") / F.col("count_distinct"))
    return out.withColumn("kept", keep_rule(F.col("column_name"), F.col("sum_of_lengths"), F.col("average_length")))


def unique_values(df: DataFrame, keys: list[str] = [], every: bool = False) -> DataFrame:  # noqa: B006
    """(column_name, value): distinct values of the columns that the profile keeps; with every, of all columns that it looks at, however many and long."""
    columns = profiled_columns(df, keys)
    if every and columns:
        return long_values(df, columns).distinct()
    kept = column_profile(df, columns).filter("kept").select("column_name")
    return long_values(df, columns).distinct().join(F.broadcast(kept), "column_name")  # a row for each column


def distinct_total(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("total"))


def top_values(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """(value, total) of the n most frequent values, a null among them; ties by value, nulls first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), F.col("value").asc_nulls_first()).limit(n)


def different_content(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(diff_total, values): the number of distinct values and the n most frequent ones as array<struct<value,total>>, in order."""
    top = top_values(df, column, n).agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("o"), "value", "total"))).alias("v"))
    total = distinct_total(df, column)
    return total.crossJoin(F.broadcast(top)).select(F.col("total").alias("diff_total"), F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["total"].alias("total"))).alias("values"))


def entity_exact(df: DataFrame, column: str, entity: str) -> DataFrame:
    """Distinct values that equal the entity, ignoring case."""
    return df.filter(F.lower(column) == F.lower(F.lit(entity))).select(F.col(column).alias("value")).distinct()


def value_exists(df: DataFrame, column: str, value: str) -> DataFrame:
    """At most one row: the least value that contains the text, ignoring case. The text is no pattern."""
    found = df.filter(F.contains(F.lower(F.col(column).cast("string")), F.lower(F.lit(value)))).agg(F.min(column).alias("value"))
    return found.filter("value is not null")


def column_contents(df: DataFrame, column: str, n: int = 5, most: int = 25) -> DataFrame:
    """Of the first n distinct values, in order, those that are not empty and have at most `most` characters, as trimmed text."""
    first = df.filter(F.col(column).isNotNull()).select(F.col(column)).distinct().orderBy(column).limit(n)
    return first.select(F.trim(F.col(column).cast("string")).alias("value")).filter((F.length("value") > 0) & (F.length("value") <= most))


def sample_rows(df: DataFrame, n: int, seed: int, *ids: str, first: int | None = None) -> DataFrame:
    """n rows in the order of a hash of their ids and the seed; with first, of the first rows by id only."""
    rows = df.orderBy(*ids).limit(first) if first else df
    mark = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))
    return rows.withColumn("__m", mark).orderBy("__m", *ids).limit(n).drop("__m")
