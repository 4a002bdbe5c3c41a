"""Summaries that merge: exact heavy hitters from Misra-Gries candidates, and bottom-k samples of all columns in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import delete, scratch

#: Counters that a task keeps, and candidates that are counted exactly at most.
COUNTERS, CANDIDATES = 2_000, 100_000
#: Values that a task counts at once.
ROWS = 200_000


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Misra-Gries over a task's values: what is left of `most` counters, and how many each may have lost. Counts of ROWS values are
    added at once."""
    held, rows, lost, kind = [], 0, 0, None

    def merged_counts() -> pa.Table:
        nonlocal lost
        found = pa.concat_tables(held).group_by("v").aggregate([("n", "sum")]).rename_columns(["v", "n"])
        n = found.column("n").to_numpy()
        if len(n) <= most:
            return found
        cut = int(np.partition(n, len(n) - most - 1)[len(n) - most - 1])
        lost += cut
        stay = n > cut
        return pa.table([found.column("v").filter(pa.array(stay)), pa.array(n[stay] - cut, pa.int64())], ["v", "n"])

    for batch in batches:
        kind = batch.column(0).type
        held.append(pa.table([batch.column(0), pa.array(np.ones(batch.num_rows, np.int64))], ["v", "n"]))
        rows += batch.num_rows
        if rows >= ROWS:
            held, rows = [merged_counts()], 0
    if kind is not None:
        kept = merged_counts()
        m = kept.num_rows
        values = pa.concat_arrays([pa.nulls(1, kind), *kept.column("v").chunks])
        yield pa.RecordBatch.from_arrays([values, pa.array([lost, *[0] * m], pa.int64()), pa.array([0, *kept.column("n").to_pylist()], pa.int64()), pa.array([True, *[False] * m])], ["value", "lost", "n", "sum"])


def heavy_candidates(df: DataFrame, column: str, counters: int = COUNTERS) -> tuple[DataFrame, int, str]:
    """(value, least), what all tasks have lost, and where the counters lie that tasks have written: a value occurs between least and
    least + lost times; others at most lost times."""
    kind, spark = df.schema[column].dataType.simpleString(), df.sparkSession
    schema = f"value {kind}, lost long, n long, sum boolean"
    df.select(F.col(column).alias("value")).mapInArrow(lambda b: _counted(b, counters), schema).write.parquet(path := scratch(spark))
    found = spark.read.schema(schema).parquet(path)
    lost = found.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]
    return found.filter("not sum").groupBy("value").agg(F.sum("n").alias("least")), lost, path


def top_values(df: DataFrame, column: str, n: int = 100, counters: int = COUNTERS, candidates: int = CANDIDATES) -> DataFrame:
    """profile.top_values, (value, total) of the n most frequent values, ties by value and nulls first, without shuffling all values.

    Two passes: tasks keep `counters` values each, and what these sums prove to be possible winners is counted exactly. Where
    they prove nothing (values about as frequent as each other, over `candidates` of them possible) all values are counted. The
    first pass runs at once; its totals and at most `candidates` values come to the driver."""
    from .profile import top_values as all_counted

    if n <= 0:
        return all_counted(df, column, n)
    found, lost, path = heavy_candidates(df, column, counters)
    try:
        least = found.orderBy(F.desc("least")).limit(n).agg(F.min("least"), F.count("*")).first()
        bound = least[0] if least[1] == n else 0  # n values occur as often as that
        if lost and lost >= bound:
            return all_counted(df, column, n)
        possible = found.filter(F.col("least") + lost >= bound).select(F.col("value").alias("__v")).limit(candidates + 1).toArrow()
    finally:
        delete(df.sparkSession, path)
    if possible.num_rows > candidates:
        return all_counted(df, column, n)
    some = df.sparkSession.createDataFrame(possible, df.select(F.col(column).alias("__v")).schema)
    rows = df.select(F.col(column).alias("value")).join(F.broadcast(some), F.col("value").eqNullSafe(F.col("__v")), "left_semi")
    return all_counted(rows, "value", n)


def least_hashes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(column_name, hash, value), the k least hashes of each column that a task meets."""
    kept: dict[str, dict[str, str]] = {}
    border: dict[str, str] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for name in pc.unique(batch.column(0)).to_pylist():
            rows = table.filter(pc.equal(table["column_name"], name))
            if name in border:
                rows = rows.filter(pc.less(rows["hash"], border[name]))
            mine = kept.setdefault(name, {})
            mine.update(zip(rows["hash"].to_pylist(), rows["value"].to_pylist(), strict=True))
            if len(mine) > k:
                mine = kept[name] = dict(sorted(mine.items())[:k])
            if len(mine) == k:
                border[name] = max(mine)
    out = [(c, h, v) for c, mine in kept.items() for h, v in mine.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["column_name", "hash", "value"])


def bottom_k(df: DataFrame, columns: list[str] | None = None, k: int = 64, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(column_name, hash, value): of each column the k distinct values (as text, not null) of the least md5, in one pass over df.

    A sketch of the distinct values: those of parts of a table merge by taking the k least again (merged). A task gives k rows
    a column at most, however many values it reads. Columns are those that a profile reads, unless they are named."""
    from .profile import long_values, profiled_columns

    columns = profiled_columns(df, keys) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, hash string, value string")
    rows = long_values(df, columns).select("column_name", F.md5("value").alias("hash"), "value")
    return merged(rows.mapInArrow(lambda b: least_hashes(b, k), "column_name string, hash string, value string"), k)


def merged(sketches: DataFrame, k: int = 64) -> DataFrame:
    """The sketch of all that the sketches are of."""
    once = sketches.groupBy("column_name", "hash").agg(F.first("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("hash"))
    return once.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def distinct_estimate(sketch: DataFrame, k: int = 64) -> DataFrame:
    """(column_name, distinct): how many distinct values a column has; exact under k, else k - 1 over the k-th hash as a share of all."""
    share = (F.conv(F.substring(F.max("hash"), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    n = F.count("*")
    return sketch.groupBy("column_name").agg(F.when(n < k, n.cast("double")).otherwise((k - 1) / share).alias("distinct"))


def sampled_contents(df: DataFrame, columns: list[str] | None = None, k: int = 6, most: int = 25) -> DataFrame:
    """(column_name, contents): up to k values of each column for a prompt, trimmed, not empty and of `most` characters at most, in order of the sketch."""
    from .profile import long_values, profiled_columns

    columns = profiled_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, contents array<string>")
    fit = df.select(*[F.when(F.length(v).between(1, most), v).alias(c) for c in columns for v in [F.trim(F.col(c).cast("string"))]])
    found = bottom_k(fit, columns, k)
    return found.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("hash", "value"))), lambda x: x["value"]).alias("contents"))
