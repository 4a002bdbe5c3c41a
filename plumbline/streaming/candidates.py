"""Candidates that arrive as files: clusters and verdict counts kept up to date by Structured Streaming. An extension, no parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.response import strip

ARRIVAL = "sample_id long, record_index int, sql_index int, sql string, arrived timestamp"


def arrivals(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """A stream of JSON lines (see ARRIVAL) from a folder."""
    rows = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_each).json(folder)
    return rows.withColumn("sql", strip(F.col("sql"))).filter(F.length("sql") > 0)


def streamed_clusters(stream: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Counts for each hour of arrival, sample and text; an hour is closed, and its state dropped, once the watermark passes it."""
    seen = stream.withWatermark("arrived", late)
    return seen.groupBy(F.window("arrived", window), "sample_id", "sql").agg(F.count("*").alias("count"), F.min(F.struct("record_index", "sql_index")).alias("first"))


def first_arrivals(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each sample's texts once, as long as the watermark remembers them."""
    return stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["sample_id", "sql"])
