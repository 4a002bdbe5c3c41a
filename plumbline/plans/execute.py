"""Running candidate queries: on Spark's own tables, and on SQLite files in tasks; then judging them against gold queries."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import InheritableThread, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import error_kind
from ..operators.compare import bag_equal, set_equal, strict_equal
from ..sources.shared import delete, scratch

TIMEOUT = 30.0

# ---- Spark


class TimedOut(RuntimeError):
    pass


def with_timeout(spark: SparkSession, work, seconds: float = TIMEOUT):
    """work()'s value; its jobs are cancelled, and TimedOut raised, when the time is over."""
    group, out = f"plumbline-{uuid.uuid4().hex}", {}

    def run():
        spark.sparkContext.setJobGroup(group, "candidate query", True)
        try:
            out["value"] = work()
        except Exception as e:  # given to the caller below
            out["error"] = e

    t = InheritableThread(run)
    t.daemon = True
    t.start()
    t.join(seconds)
    if t.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        t.join(10)
        raise TimedOut(f"the query took more than {seconds:g} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


def fetch(df: DataFrame, how: str | int = "all", seed: int = 0) -> list:
    """Rows by mode: all, one, random (one of the first ten) or a number of them."""
    if how == "all":
        return df.collect()
    if how == "one":
        return df.limit(1).collect()
    if how == "random":
        rows = df.limit(10).collect()
        return [rows[seed % len(rows)]] if rows else []
    return df.limit(int(how)).collect()


def executable(spark: SparkSession, sql: str) -> str | None:
    """None if the query can be analysed, else the error; nothing is run."""
    if not sql.strip():
        return "Error: empty string"
    try:
        _ = spark.sql(sql).schema
    except Exception as e:
        return str(e)
    return None


def _placed(df: DataFrame) -> tuple[DataFrame, str]:
    """Rows with __place, their place in the result's order, which no key tells: that of their partition, then that within it. The
    result is written once to the shared folder with both, so that no lost executor can bring another order; and where it lies."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    odd = (T.NullType, T.CalendarIntervalType)  # what Parquet doesn't hold
    flat = flat.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, odd) else F.col(f.name) for f in flat.schema])

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64()), pa.array(range(at, at + b.num_rows), pa.int64())], [*b.schema.names, "__part", "__at"])
            at += b.num_rows

    placed = flat.mapInArrow(place, T.StructType([*flat.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__at", T.LongType())]))
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    sizes = rows.groupBy("__part").agg((F.max("__at") + 1).alias("__n"))  # a row for each partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn("__place", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before"), path


def _same(gold: DataFrame, pred: DataFrame, mode: str, empty_matches: bool) -> bool:
    if len(gold.columns) != len(pred.columns):
        return False
    if mode == "strict":
        (left, a), (right, b) = _placed(gold), _placed(pred)
        try:
            return bool(strict_equal(left, right, "__place").first()["equal"])
        finally:
            for path in (a, b):
                delete(gold.sparkSession, path)
    if mode == "set" and not empty_matches and gold.isEmpty():
        return False
    return bool({"bag": bag_equal, "set": set_equal}[mode](gold, pred).first()["equal"])


def same_result(spark: SparkSession, gold_sql: str, sql: str, mode: str = "bag", empty_matches: bool = True) -> bool:
    """Whether two queries give the same result in mode strict, bag or set. Both results stay distributed."""
    return _same(spark.sql(gold_sql), spark.sql(sql), mode, empty_matches)


VERDICT = "case_id long, gold_sql string, sql string, status string, detail string, is_correct boolean"


def verdicts(spark: SparkSession, cases: Iterable[tuple[int, str, str]], mode: str = "bag", timeout: float = TIMEOUT, empty_matches: bool = True, at_once: int = 4) -> DataFrame:
    """One row for each case (id, gold query, candidate): status success, error, timeout or gold_error, an error's message, and the
    verdict; a candidate that fails is wrong, and without a gold result there is none, whether it fails when it is analysed, while
    it runs, or by its time.

    Queries run against the session's views, that is as jobs of the driver: `at_once` gold queries side by side, each run once and
    kept on disk for all of its candidates. For many candidates over files, sqlite_results runs queries in tasks."""
    by: dict[str, list[tuple[int, str]]] = {}
    for case, gold_sql, sql in cases:
        by.setdefault(gold_sql, []).append((case, sql))

    def run(gold_sql: str):
        gold = spark.sql(gold_sql).persist(StorageLevel.DISK_ONLY)
        gold.count()
        return gold

    def judge(gold_sql: str) -> list[tuple]:
        mine, out = by[gold_sql], []
        problem, gold = executable(spark, gold_sql), None
        if not problem:
            try:
                gold = with_timeout(spark, lambda: run(gold_sql), timeout)
            except Exception as e:
                problem = str(e)[:2000]
        if problem:
            return [(case, gold_sql, sql, "gold_error", problem, None) for case, sql in mine]
        try:
            for case, sql in mine:
                status, detail, correct = "success", None, False
                if bad := executable(spark, sql):
                    status, detail = "error", bad
                else:
                    try:
                        correct = with_timeout(spark, lambda s=sql: _same(gold, spark.sql(s), mode, empty_matches), timeout)
                    except TimedOut as e:
                        status, detail = "timeout", str(e)
                    except Exception as e:
                        status, detail = "error", str(e)[:2000]
                out.append((case, gold_sql, sql, status, detail, correct))
        finally:
            gold.unpersist()
        return out

    with ThreadPoolExecutor(at_once) as pool:
        return spark.createDataFrame([r for rows in pool.map(judge, by) for r in rows], VERDICT)


# ---- SQLite

RESULT = "status string, detail string, row_count long, rows array<string>, strict_hash string, bag_hash string, set_hash string"
#: Rows of a result that are kept as text.
SHOWN = 1000


def _cell(x, plain: bool):
    """A value for hashing; plain ones are alike where Python's equality holds, so that 1.0 is 1 however large."""
    if isinstance(x, bytes):
        return x.hex()
    return int(x) if plain and isinstance(x, float) and x.is_integer() else x


def _set_cell(x):
    """A plain value in set mode, where a blob is none of its hexadecimal text."""
    return {"blob": x.hex()} if isinstance(x, bytes) else _cell(x, True)


class _Digests:
    """Hashes of a result row by row: in order, as a bag, and as a set, whose distinct rows are kept as 16 bytes each."""

    def __init__(self) -> None:
        self.ordered, self.bag, self.n = hashlib.sha256(), 0, 0
        self.known, self.fresh = np.empty((0, 2), "<u8"), bytearray()

    def _merge(self) -> None:
        self.known = np.unique(np.concatenate((self.known, np.frombuffer(bytes(self.fresh), "<u8").reshape(-1, 2))), axis=0)
        self.fresh = bytearray()

    def add(self, typed: str, plain: str, distinct: str) -> None:
        short = lambda text: hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.ordered.update(short(plain))
        self.fresh += short(distinct)
        self.bag = (self.bag + int.from_bytes(short(typed), "little")) % (1 << 128)
        self.n += 1
        if len(self.fresh) > 1 << 22:
            self._merge()

    def texts(self) -> tuple[str, str, str]:
        self._merge()
        return f"{self.n}:{self.ordered.hexdigest()}", f"{self.n}:{self.bag:x}", f"{len(self.known)}:{hashlib.sha256(self.known.tobytes()).hexdigest()}"


def run_sqlite(db: sqlite3.Connection, sql: str, timeout: float = TIMEOUT) -> tuple:
    """The fields of RESULT: status, error, row count, the first SHOWN rows as JSON arrays (blobs as hexadecimal), and hashes of the
    whole result: in order and as a set, where 1.0 is 1, and as a bag, where it is not; as a set a blob is not its hexadecimal
    text. Rows are read one by one and only their hashes kept, so that a result may have any size."""
    end = time.monotonic() + timeout
    db.set_progress_handler(lambda: int(time.monotonic() > end), 10_000)
    rows, digests = [], _Digests()
    try:
        for r in db.execute(sql):
            typed, plain, distinct = (json.dumps(list(map(f, r)), ensure_ascii=False) for f in (lambda x: _cell(x, False), lambda x: _cell(x, True), _set_cell))
            digests.add(typed, plain, distinct)
            if len(rows) < SHOWN:
                rows.append(typed)
            if not digests.n % 4096 and time.monotonic() > end:
                return "timeout", "interrupted", None, None, None, None, None
    except sqlite3.Error as e:
        late = time.monotonic() > end and "interrupted" in str(e)
        return ("timeout" if late else "error"), str(e), None, None, None, None, None
    finally:
        db.set_progress_handler(None, 0)
    return "success", None, digests.n, rows, *digests.texts()


def sqlite_rows(path: str, sql: str, timeout: float = TIMEOUT) -> list[tuple]:
    """The rows of one query on one file, in the driver; an error is raised, never an empty result in its place."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    end = time.monotonic() + timeout
    db.set_progress_handler(lambda: int(time.monotonic() > end), 10_000)
    try:
        return db.execute(sql).fetchall()
    finally:
        db.close()


def sqlite_results(queries: DataFrame, path: str = "db_path", sql: str = "sql", timeout: float = TIMEOUT) -> DataFrame:
    """queries with the columns of RESULT. Files are opened read-only, one connection for each file and task; a file that can't be
    opened gives an error. Only distinct (file, query) pairs are run, dealt by both, so that a popular file is many tasks' work.
    The files must be where every executor sees them."""
    once = queries.select(F.col(path).alias("p"), F.col(sql).alias("q")).distinct().repartition("p", "q").sortWithinPartitions("p")
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_path, db = None, None
        for batch in batches:
            rows = []
            for p, q in zip(batch["p"], batch["q"], strict=True):
                if p != open_path:
                    if db:
                        db.close()
                    open_path, db = p, None
                    try:
                        db = sqlite3.connect(f"file:{p}?mode=ro", uri=True)
                    except sqlite3.Error:
                        pass
                rows.append((p, q, *(run_sqlite(db, q, timeout) if db and q is not None else ("error", "unable to open database file", None, None, None, None, None))))
            yield pd.DataFrame(rows, columns=["p", "q", *names])

    done = once.mapInPandas(run, f"p string, q string, {RESULT}")
    return queries.join(done, queries[path].eqNullSafe(done["p"]) & queries[sql].eqNullSafe(done["q"]), "left").drop("p", "q")


def with_error_kind(results: DataFrame) -> DataFrame:
    """Adds kind: the kind of error, null for results without one."""
    return results.withColumn("kind", F.when(F.col("status") == "error", error_kind(F.col("detail"))))


def evaluated(clusters: DataFrame, items: DataFrame, mode: str = "bag", timeout: float = TIMEOUT, empty_matches: bool = True) -> DataFrame:
    """Clusters (sample_id, sql, count, occurrences) judged against items (sample_id, db_id, db_path, gold_sql): adds the candidate's
    status, detail and row_count, the gold's, is_correct, and error where the item or its gold result is missing; then is_correct is null.

    bag compares typed rows (1 is not 1.0), strict and set plain ones. Results are compared by the hashes of whole results."""
    key = f"{mode}_hash"
    met = clusters.join(items.select("sample_id", "db_id", "db_path", "gold_sql"), "sample_id", "left")
    gold = sqlite_results(items.select("sample_id", "db_path", "gold_sql"), sql="gold_sql", timeout=timeout)
    gold = gold.select("sample_id", F.col("status").alias("gold_status"), F.col("detail").alias("gold_detail"), F.col("row_count").alias("gold_row_count"), F.col(key).alias("__gold"))
    out = sqlite_results(met.filter("db_path is not null"), timeout=timeout).unionByName(met.filter("db_path is null"), allowMissingColumns=True).join(gold, "sample_id", "left")
    error = F.when(F.col("db_path").isNull(), "no item at this place").when(F.col("gold_status") != "success", F.concat(F.lit("gold: "), F.col("gold_detail")))
    same = F.coalesce(F.col("__gold") == F.col(key), F.lit(False)) & (F.lit(empty_matches or mode != "set") | (F.col("gold_row_count") > 0))
    verdict = F.when(error.isNull(), (F.col("status") == "success") & same)
    return out.withColumns({"error": error, "is_correct": verdict}).drop("__gold", "rows", "strict_hash", "bag_hash", "set_hash")


def run_summary(records: DataFrame) -> DataFrame:
    """One row: samples, clusters, candidates and how many of each verdict, and samples with an error."""
    n = F.coalesce("count", F.lit(1))
    return records.agg(
        F.count_distinct("sample_id").alias("total_files"), F.count("*").alias("total_clusters"), F.sum(n).alias("total_candidates"), F.count_if("is_correct").alias("correct_total"),
        F.count_if(~F.col("is_correct")).alias("wrong_total"), F.count_distinct(F.when(F.col("is_correct").isNull(), F.col("sample_id"))).alias("error_total"),
    )


def per_sample(records: DataFrame) -> DataFrame:
    """One row for each sample in the nested layout: metadata, correct_set, wrong_set, each in first-seen order."""
    one = F.struct("first", "sql", "count", "occurrences", "status", "row_count", "is_correct")
    pick = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_correct") == ok, one))), lambda x: x.dropFields("first"))
    return records.groupBy("sample_id").agg(F.struct(F.first("db_id").alias("db_id"), F.first("gold_sql").alias("gold_sql"), F.max("error").alias("error")).alias("metadata"), pick(True).alias("correct_set"), pick(False).alias("wrong_set"))
