"""Prompts put together from a database's schema, sampled values, evidence and values that a question finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .sketch import sampled_contents

CONTENTS = "array<string>"


def database_tables(tables: dict[str, DataFrame], k: int = 6, keys: dict[str, list[str]] | None = None, comments: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """One row with tables, for text.schema_sequence: every column of every table with its type and up to k sampled values.

    Values come from bottom-k sketches, one pass over each table for all of its columns that a profile reads."""
    keys, comments = keys or {}, comments or {}
    rows = [(t, i, j, f.name, f.dataType.simpleString().upper(), f.name in keys.get(t, []), comments.get((t, f.name), "")) for i, (t, df) in enumerate(tables.items()) for j, f in enumerate(df.schema)]
    spark = next(iter(tables.values())).sparkSession
    columns = spark.createDataFrame(rows, "name string, nth int, place int, column_name string, type string, is_pk boolean, comment string")  # a row for each column
    found = None
    for t, df in tables.items():
        part = sampled_contents(df, k=k).withColumn("name", F.lit(t))
        found = part if found is None else found.unionByName(part)
    met = columns.join(found, ["name", "column_name"], "left")
    one = F.struct("place", F.col("column_name").alias("name"), "type", "is_pk", "comment", F.coalesce("contents", F.array().cast(CONTENTS)).alias("contents"))
    each = met.groupBy("nth", "name").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("place")).alias("columns"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name", "columns"))), lambda x: x.dropFields("nth")).alias("tables"))


def question_text(question: Column, evidence: Column | None) -> Column:
    """Evidence, a line feed and the question; the question alone where evidence is null or blank."""
    if evidence is None:
        return question
    return F.when(F.length(F.trim(F.coalesce(evidence, F.lit("")))) > 0, F.concat(evidence, F.lit("\n"), question)).otherwise(question)


def found_contents(hits: DataFrame, question_id: str, values: DataFrame, k: int = 6) -> DataFrame:
    """(question_id, matches), for text.matched_sequence: of each question's hits (question_id, id, score) the k best of each column, ties by
    id, with values (id, table_name, column_name, value)."""
    met = hits.join(values, "id")
    best = met.groupBy(question_id, "table_name", "column_name").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "value"))), 1, k).alias("v"))  # hits are few: k of each run of words
    one = F.struct("table_name", "column_name", F.array_distinct(F.transform("v", lambda x: x["value"])).alias("contents"))
    return best.groupBy(question_id).agg(F.array_sort(F.collect_list(one)).alias("matches"))


def assembled(questions: DataFrame, question: str, tables: DataFrame, evidence: str | None = None, keys: Column | None = None, matches: str | None = None, into: str = "prompt") -> DataFrame:
    """questions with a prompt: the schema of database_tables (one row) with its sampled values, foreign keys and the question's matches,
    then evidence before the question."""
    none = F.lit(None).cast("array<struct<table_name:string,column_name:string,contents:array<string>>>")
    links = F.array().cast("array<struct<from_table:string,from_column:string,to_table:string,to_column:string>>") if keys is None else keys
    rows = questions.crossJoin(F.broadcast(tables.select(F.col("tables").alias("__t"))))  # one row, of k values for each column
    schema = F.concat_ws("\n", text.schema_sequence(F.col("__t"), links), text.matched_sequence(none if matches is None else F.col(matches)))
    asked = question_text(F.col(question), None if evidence is None else F.col(evidence))
    return rows.withColumn(into, text.prompt(asked, schema)).drop("__t")
