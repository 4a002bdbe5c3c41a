"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a session of one machine names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Bytes of a Parquet row group of scratch tables: what a writing task holds in the JVM.
ROW_GROUP = 16 << 20

#: The setting by which a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths that stored() has written and nothing has deleted, in order.
_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    _written.append(path)
    return out


def forget(*frames: DataFrame | None) -> None:
    """Deletes what stored() wrote for frames that nothing reads any more."""
    for df in frames:
        if df is not None and (path := getattr(df, "_plumbline_path", None)):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """stored(make()), after which what make() itself stored is deleted: it serves nothing else."""
    known = set(_written)
    out = stored(make())
    for path in [p for p in _written if p not in known and p != out._plumbline_path]:
        _delete(out.sparkSession, path)
    return out


def sweep(spark: SparkSession) -> None:
    """Deletes every table that stored() has written, once no DataFrame that reads one is needed any more: results are lazy, so
    that only their user knows when."""
    for path in list(_written):
        _delete(spark, path)


#: Rows and bytes of an Arrow batch at most, in place of Spark's 10,000 and 64 MB: whole texts pass through Python, and each batch is held several times.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, where they are larger; Spark reads the settings when a
    plan is run, so that they can't be an operator's own."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores before it as it needs to be none of docs' columns, in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as Spark reads it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow where make() builds, once per task, the function that turns one batch into batches. Columns go by place: Spark
    looks the columns of mapInArrow up by name, which fails for names with dots."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    places = [f"c{i}" for i in range(max(len(df.columns), len(schema)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for out in step(batch):
                yield pa.RecordBatch.from_arrays(out.columns, places[: out.num_columns])

    bounded(df.sparkSession)
    made = df.toDF(*places[: len(df.columns)]).mapInArrow(run, T.StructType([T.StructField(n, f.dataType) for n, f in zip(places, schema.fields, strict=False)]))
    return made.toDF(*schema.fieldNames())


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(col(column).cast("string").cast("binary")) % parts
