"""Readers with explicit schemas for items, candidates, eval records, pairs, packed SQL and schema metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import flattened
from .blocks import json_elements, numbered_lines, strict_lines

ITEM = "db_id string, question string, evidence string, SQL string, query string, difficulty string, question_id string"
CANDIDATE = "all_sqls array<string>"
CANDIDATE_FILES = r"^(\d+)_.*\.json$"
# What separates a query from its database in packed lines, the first that occurs counts.
SEPARATORS = ["\t----- bird -----\t", "\t----- SQL-EVAL -----\t", "\t"]
METADATA = "db_id string, table_names_original array<string>, column_names_original array<array<string>>, column_types array<string>, primary_keys array<string>, foreign_keys array<array<int>>"


def location(spark: SparkSession, path: str, required: list[str]) -> dict[str, str]:
    """A key=value file: blank lines and those that begin with # are skipped; ValueError if a required key is missing."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).filter("length(v) > 0 and not startswith(v, '#') and contains(v, '=')").collect()
    out = {k.strip(): v.strip() for k, v in (r.v.split("=", 1) for r in rows)}
    if missing := [k for k in required if k not in out]:
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    return out


def file_name(column: Column | None = None) -> Column:
    return F.element_at(F.split(F.input_file_name() if column is None else column, "/"), -1)


def sample_id_of(name: Column) -> Column:
    """The number that a candidate file's name begins with; null for other names."""
    return F.regexp_extract(name, r"^(\d+)_", 1).try_cast("long")


def items(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of items with sample_id, its place from 0, and SQL, for which `query` may stand. A long array is many tasks' work."""
    rows = json_elements(spark, path).select(F.col("place").alias("sample_id"), F.from_json("value", ITEM, {"mode": "FAILFAST"}).alias("i"))
    return rows.select("sample_id", "i.*").withColumn("SQL", F.coalesce("SQL", "query")).drop("query")


def sample_files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(sample_id, name, path) of candidate files, those of trees (_ast.json) left out, by number and name; a limit of 0 is nothing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
    rows = files.withColumn("name", file_name(F.col("path"))).filter(F.rlike("name", F.lit(CANDIDATE_FILES)) & ~F.endswith("name", F.lit("_ast.json")))
    rows = rows.select(sample_id_of(F.col("name")).alias("sample_id"), "name", "path").orderBy("sample_id", "name")
    return rows if limit is None else rows.limit(limit)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each candidate of a folder's files: sample_id, file, record_index, sql_index, sql."""
    text = spark.read.option("pathGlobFilter", "[0-9]*_*.json").text(folder, wholetext=True).select(file_name().alias("file"), "value")
    text = text.filter(F.rlike("file", F.lit(CANDIDATE_FILES)) & ~F.endswith("file", F.lit("_ast.json")))
    rows = text.select(sample_id_of(F.col("file")).alias("sample_id"), "file", F.posexplode(F.from_json("value", "array<struct<all_sqls:array<string>>>")).alias("record_index", "r"))
    return flattened(rows.select("sample_id", "file", "record_index", F.col("r.all_sqls").alias("all_sqls")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that must all be right: ValueError names the file and line number of the first that is not."""
    return strict_lines(spark, path, schema)


def tolerant_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value, file, line_number) of text files, for cascade.parsed_lines; line grows with the place in a block of a file, line_number is the place in the file."""
    return numbered_lines(spark, path).select(F.monotonically_increasing_id().alias("line"), "value", "file", "line_number")


def packed_sql(lines: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """(index, sql, db_id) of lines (index, value): query, separator, database. A line without one separator takes the database at its
    place in databases (index, db_id). Blank lines are dropped and keep their places."""
    value = F.regexp_replace("value", r"\s+$", "")
    mark = F.lit(None).cast("string")
    for s in reversed(SEPARATORS):
        mark = F.when(F.contains(value, F.lit(s)), s).otherwise(mark)
    rows = lines.filter(F.length(value) > 0).select("index", value.alias("v"), mark.alias("m"))
    parts = F.split(F.replace("v", "m", F.lit("\u0001")), "\u0001")
    rows = rows.select("index", "v", F.when(F.col("m").isNotNull() & (F.size(parts) == 2), parts).alias("p"))
    rows = rows.select("index", F.coalesce(F.col("p")[0], F.trim("v")).alias("sql"), F.col("p")[1].alias("db_id"))
    if databases is None:
        return rows
    return rows.join(databases.select("index", F.col("db_id").alias("__d")), "index", "left").withColumn("db_id", F.coalesce("db_id", "__d")).drop("__d")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of schema metadata, one row for each database; nested pairs are read as text."""
    return json_elements(spark, path).select(F.from_json("value", METADATA).alias("d")).select("d.*")


def catalog_columns(meta: DataFrame) -> DataFrame:
    """(db_id, table_name, column_name, col_type, is_pk, ordinal) from metadata's parallel arrays; the `*` entry is left out.

    ordinal is the column's place in the metadata, which keys refer to; types are upper-cased, TEXT where they are missing."""
    rows = meta.select("db_id", "table_names_original", "column_types", "primary_keys", F.posexplode("column_names_original").alias("ordinal", "c"))
    at = F.col("c")[0].cast("int")
    rows = rows.filter(at >= 0)
    keys = F.col("primary_keys")
    inner = F.exists(keys, lambda k: (k == F.col("ordinal").cast("string")) | F.array_contains(F.from_json(k, "array<int>"), F.col("ordinal")))
    return rows.select("db_id", F.get("table_names_original", at).alias("table_name"), F.col("c")[1].alias("column_name"), F.upper(F.coalesce(F.get("column_types", F.col("ordinal")), F.lit("TEXT"))).alias("col_type"), F.coalesce(inner, F.lit(False)).alias("is_pk"), "ordinal")


def catalog_keys(meta: DataFrame) -> DataFrame:
    """(db_id, from_table, from_column, to_table, to_column); keys with an unknown end are dropped."""
    columns = catalog_columns(meta).select("db_id", "table_name", "column_name", "ordinal")
    pairs = meta.select("db_id", F.explode("foreign_keys").alias("k")).select("db_id", F.col("k")[0].alias("a"), F.col("k")[1].alias("b"))
    a = columns.select("db_id", F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), F.col("ordinal").alias("a"))
    b = columns.select("db_id", F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"), F.col("ordinal").alias("b"))
    return pairs.join(a, ["db_id", "a"]).join(b, ["db_id", "b"]).select("db_id", "from_table", "from_column", "to_table", "to_column")


def schema_map(columns: DataFrame) -> DataFrame:
    """(db_id, tables map<string, array<string>>): a database's tables in lower case, columns in order."""
    each = columns.groupBy("db_id", F.lower("table_name").alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]).alias("c"))
    return each.groupBy("db_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "c")))).alias("tables"))


def database_path(root: Column, db_id: Column, exists: Column | None = None) -> Column:
    """root/db/db.sqlite; where exists, an array of known paths, lacks it but has root/db.sqlite, that one."""
    nested, flat = F.concat(root, F.lit("/"), db_id, F.lit("/"), db_id, F.lit(".sqlite")), F.concat(root, F.lit("/"), db_id, F.lit(".sqlite"))
    return nested if exists is None else F.when(~F.array_contains(exists, nested) & F.array_contains(exists, flat), flat).otherwise(nested)


def tree_file_name(name: Column) -> Column:
    """The name of the file that a batch run writes for an input: without _eval, with _ast."""
    return F.concat(F.regexp_replace(F.regexp_replace(name, r"\.json$", ""), "_eval$", ""), F.lit("_ast.json"))


def few_shots(lines: DataFrame, train: DataFrame) -> DataFrame:
    """(index, examples array<struct<question, sql, evidence>>) of lines (index, value) of comma-separated places: the line's own, which must
    be its index, then those of its examples in train (sample_id, question, SQL, evidence), in order; error where the first differs."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("long"))
    rows = lines.select("index", parts.alias("p")).withColumn("error", F.when(F.col("p")[0] != F.col("index"), "the line's number is not its place"))
    named = rows.select("index", "error", F.posexplode_outer(F.slice("p", 2, F.size("p"))).alias("i", "sample_id"))
    met = named.join(train.select("sample_id", "question", "SQL", "evidence"), "sample_id", "left")
    one = F.when(F.col("question").isNotNull(), F.struct("i", "question", F.col("SQL").alias("sql"), "evidence"))
    return met.groupBy("index", "error").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("i")).alias("examples"))
