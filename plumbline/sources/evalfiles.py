"""Files of judged candidates: one JSON object for each sample, with metadata, correct_set and wrong_set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cluster import first_seen
from ..plans.distance import parsed_records
from .readers import file_name, sample_id_of

#: Fixed value: names of such files; the number is the sample's.
EVAL_FILES = r"^(\d+)_.*_eval\.json$"
SETS = ("correct_set", "wrong_set")


def eval_files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(sample_id, name, path) of a folder's files, by number and name; no limit where it is None or 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_eval.json").load(folder).select("path")
    rows = files.withColumn("name", file_name(F.col("path"))).filter(F.rlike("name", F.lit(EVAL_FILES)))
    rows = rows.select(sample_id_of(F.col("name")).alias("sample_id"), "name", "path").orderBy("sample_id", "name")
    return rows.limit(limit) if limit else rows


def eval_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, value) of a folder's files."""
    text = spark.read.option("pathGlobFilter", "*_eval.json").text(folder, wholetext=True).select(file_name().alias("file"), "value")
    return text.filter(F.rlike("file", F.lit(EVAL_FILES)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str) -> Column:
    """A JSON string; null for what is none."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(v, path, "string"))


def eval_records(texts: DataFrame) -> DataFrame:
    """One row for each judged candidate of texts (file, value): file, sample_id (of the metadata, else of the first record), meta_db_id,
    set_name, record_index, sql, gold_sql, db_id, count and is_correct; for a file that can't be read, one row with error.

    correct_set must be there, sets lists of objects (a missing wrong_set is empty) and every sql a string."""
    v = F.try_parse_json("value")
    rows = texts.select("file", v.alias("v"))
    sets = [F.try_variant_get("v", f"$.{s}", "array<variant>") for s in SETS]
    raw = [F.try_variant_get("v", f"$.{s}", "variant") for s in SETS]
    rows = rows.select("file", "v", *[x.alias(n) for n, x in zip(SETS, sets, strict=True)], *[x.alias(f"raw_{n}") for n, x in zip(SETS, raw, strict=True)])
    bad = lambda s, test: F.exists(F.coalesce(F.col(s), F.array().cast("array<variant>")), test)
    no_object = lambda x: ~F.startswith(_kind(x), F.lit("OBJECT"))
    no_sql = lambda x: _text(x, "$.sql").isNull()
    error = F.when(F.col("v").isNull(), "load error: no JSON").when(F.col("raw_correct_set").isNull(), "correct_set is missing")
    for s in SETS:
        error = error.when(F.col(f"raw_{s}").isNotNull() & F.col(s).isNull(), f"{s} is no list").when(bad(s, no_object), f"an item of {s} is no object").when(bad(s, no_sql), f"an sql of {s} is no string")
    numbered = lambda s, ok: F.transform(F.coalesce(F.col(s), F.array().cast("array<variant>")), lambda x, i: F.struct(F.lit(s).alias("set_name"), i.alias("record_index"), F.lit(ok).alias("is_correct"), x.alias("r")))
    both = F.concat(numbered("correct_set", True), numbered("wrong_set", False))
    rows = rows.select("file", "v", error.alias("error"), F.when(error.isNull(), both).alias("a"))
    own = F.try_variant_get("v", "$.metadata.sample_id", "long")
    first = F.try_variant_get(F.get("a", F.lit(0))["r"], "$.sample_id", "long")
    rows = rows.select("file", F.coalesce(own, first).alias("sample_id"), _text(F.col("v"), "$.metadata.db_id").alias("meta_db_id"), "error", F.explode_outer("a").alias("a"))
    r = F.col("a.r")
    return rows.select(
        "file", "sample_id", "meta_db_id", "a.set_name", "a.record_index", _text(r, "$.sql").alias("sql"), _text(r, "$.gold_sql").alias("gold_sql"), _text(r, "$.db_id").alias("db_id"),
        F.try_variant_get(r, "$.count", "long").alias("count"), "a.is_correct", "error",
    )


def parsed_eval(records: DataFrame, deduplicate: bool = False) -> DataFrame:
    """(file, set_name, place, sql, normalized_sql, error) of eval_records: the distinct gold queries of each file in first-seen order
    (set_name gold), and the candidates of both sets, of equal ones the first alone with `deduplicate`. error (type, message) stands
    where a text is no query. Each distinct text is parsed once."""
    known = records.filter("sql is not null").select("file", "set_name", "record_index", "sql", "gold_sql")
    gold = known.filter("gold_sql is not null").groupBy("file", F.col("gold_sql").alias("sql")).agg(F.min(F.struct("set_name", "record_index")).alias("at"))  # correct_set comes first
    gold = gold.select("file", F.lit("gold").alias("set_name"), F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("place"), "sql")
    rows = first_seen(known.drop("gold_sql"), ["file", "set_name", "sql"], ["record_index"]) if deduplicate else known
    rows = rows.select("file", "set_name", F.row_number().over(Window.partitionBy("file", "set_name").orderBy("record_index")).alias("place"), "sql")
    return parsed_records(gold.unionAll(rows).withColumn("place", F.col("place") - 1))


def parsed_summary(parsed: DataFrame) -> DataFrame:
    """One row for each file of parsed_eval: how many gold, correct and wrong queries there are and are parsed, and the errors."""
    kinds = (("gold", "gold"), ("correct", "correct_set"), ("wrong", "wrong_set"))
    good = F.col("error").isNull()
    counts = [F.count_if(F.col("set_name") == s).alias(f"{n}_count") for n, s in kinds] + [F.count_if((F.col("set_name") == s) & good).alias(f"parsed_{n}_count") for n, s in kinds]
    return parsed.groupBy("file").agg(*counts, F.count_if(good).alias("parsed_count"), F.count_if(~good).alias("error_count"))


def parsed_dataset(records: DataFrame, keys: list[str], sqls: str = "all_sqls", deduplicate: bool = False) -> DataFrame:
    """records with normalized_sqls, array<struct<sql, normalized_sql, error>>: each text of the array `sqls`, in order, of equal ones
    the first alone with `deduplicate`; null where there is no array. The keys tell records apart."""
    texts = records.select(*keys, F.posexplode(F.array_distinct(sqls) if deduplicate else F.col(sqls)).alias("at", "sql"))
    one = F.struct("at", "sql", "normalized_sql", "error")
    done = parsed_records(texts).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("at")).alias("normalized_sqls"))
    return records.join(done, keys, "left")
