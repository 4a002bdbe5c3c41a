"""What is kept of files as long as they do not change: samples of each, and a split of them all."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.augment import holdout
from ..operators.compare import digest
from ..operators.sketch import least_hashes, merged
from .blocks import numbered_lines, strict_lines

KEY = ["path", "length", "modified"]
FILES = "path string, length long, modified timestamp"
SKETCHES = f"{FILES}, column_name string, hash string, value string"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of a folder's files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def refresh(spark: SparkSession, folder: str, cache: str, schema: str, form: str = "json", columns: list[str] | None = None, k: int = 64) -> int:
    """Reads the files of a folder that are new or have another size or time than when they were read, and keeps a bottom-k sketch of each
    column of each (columns, or all of the schema that are text). Returns how many were read; files without a byte don't count.

    A sketch is of its file alone, so that it serves as long as the file does. A file counts as read once its sketches are
    written; what is kept of older states is not used. The names of changed files come to the driver, as Spark's own list does."""
    known = _kept(spark, f"{cache}/files", FILES)
    changed = listed(spark, folder).join(known, KEY, "left_anti").collect()
    if not changed:
        return 0
    paths = [r.path for r in changed]
    meta = F.col("_metadata")
    rows = spark.read.format(form).schema(schema).load(paths)
    columns = columns or [n for n, kind in rows.dtypes if kind == "string"]
    rows = rows.select(*columns, F.to_json(F.struct(meta["file_path"].alias("path"), meta["file_size"].alias("length"), F.unix_micros(meta["file_modification_time"]).alias("modified"))).alias("__file"))
    values = rows.select("__file", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))).filter("value is not null")
    keyed = values.select(F.concat("__file", F.lit("\n"), "column_name").alias("column_name"), F.md5("value").alias("hash"), "value")
    sketches = merged(keyed.mapInArrow(lambda b: least_hashes(b, k), "column_name string, hash string, value string"), k)
    file = F.from_json(F.substring_index("column_name", "\n", 1), "path string, length long, modified long")
    sketches = sketches.select(file.alias("f"), F.substring_index("column_name", "\n", -1).alias("column_name"), "hash", "value")
    sketches = sketches.select("f.path", "f.length", F.timestamp_micros("f.modified").alias("modified"), "column_name", "hash", "value")
    sketches.write.mode("append").parquet(f"{cache}/sketches")
    spark.createDataFrame(changed, FILES).write.mode("append").parquet(f"{cache}/files")
    return len(paths)


def samples(spark: SparkSession, folder: str, cache: str, k: int = 64) -> DataFrame:
    """(column_name, hash, value): the bottom-k sketch of all files of a folder as they are now, from what refresh() has kept."""
    now = listed(spark, folder).join(_kept(spark, f"{cache}/sketches", SKETCHES), KEY)
    return merged(now.select("column_name", "hash", "value"), k)


PAIR = "prompt string, chosen string, rejected string, margin double, sample_id string"


def preference_rows(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """Preference pairs of JSON lines, for training: blank lines skipped, the prompt's end one line feed, chosen and rejected texts
    trimmed. Adds key, the line's file and number. A line that is no JSON is an error that names both."""
    strict_lines(spark, path, schema)  # the check alone
    lines = numbered_lines(spark, path).filter("length(trim(value)) > 0")
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.concat_ws(":", "file", "line_number").alias("key")).select("r.*", "key")
    space = lambda c: F.regexp_replace(F.coalesce(c, F.lit("None")), r"^\s+|\s+$", "")
    return rows.withColumns({"prompt": F.concat(F.regexp_replace(F.coalesce("prompt", F.lit("None")), r"\s+$", ""), F.lit("\n")), "chosen": space(F.col("chosen")), "rejected": space(F.col("rejected"))})


def kept_split(spark: SparkSession, path: str, cache: str, ratio: float = 0.05, seed: int = 42, schema: str = PAIR, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(train, held out): preference_rows split by augment.holdout, kept under the files' names, sizes and times, the ratio, the seed, the
    schema and the key.

    The same files give the kept split again without being read; a file that changes gives another one. A split counts as
    kept when it is wholly written."""
    name, n = digest(listed(spark, path)).first(), hashlib.sha256(repr((ratio, seed, schema, key)).encode()).hexdigest()[:16]
    folder = f"{cache}/split-{name.n}-{name.a or 0}-{name.b or 0}-{n}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        holdout(preference_rows(spark, path, schema), ratio, seed, key).write.mode("overwrite").parquet(folder)
    kept = spark.read.schema(f"{schema}, key string, held_out boolean").parquet(folder)
    return kept.filter("not held_out").drop("held_out"), kept.filter("held_out").drop("held_out")
