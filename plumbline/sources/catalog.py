"""Catalogues: columns and foreign keys of Spark's views and of SQLite files."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "db_id string, table_name string, column_name string, col_type string, is_pk boolean, not_null boolean, ordinal int"
KEYS = "db_id string, from_table string, from_column string, to_table string, to_column string"


def spark_columns(spark: SparkSession, db_id: str = "spark") -> DataFrame:
    """Columns of the session's tables and views. Spark knows no keys: is_pk is false."""
    rows = [(db_id, t.name, c.name, c.dataType.upper(), False, not c.nullable, i) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, COLUMNS)


def _described(path: str) -> tuple[list[tuple], list[tuple]]:
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    columns, keys = [], []
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name <> 'sqlite_sequence' ORDER BY rowid").fetchall():
            for i, name, kind, not_null, _, pk in db.execute(f"PRAGMA table_info({quote(table)})"):
                columns.append((table, name, (kind or "TEXT").upper(), pk > 0, bool(not_null), i))
            for _, _, to, a, b, *_ in db.execute(f"PRAGMA foreign_key_list({quote(table)})"):
                if to and a and b:  # incomplete ones are dropped
                    keys.append((table, a, to, b))
    finally:
        db.close()
    return columns, keys


def sqlite_columns(databases: DataFrame) -> DataFrame:
    """Columns of SQLite files, databases (db_id, db_path), read in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *r) for d, p in zip(batch["db_id"], batch["db_path"], strict=True) for r in _described(p)[0]]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in COLUMNS.split(", ")])

    return databases.select("db_id", "db_path").mapInPandas(run, COLUMNS)


def sqlite_keys(databases: DataFrame) -> DataFrame:
    """Foreign keys of SQLite files, those without a column on either side left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *r) for d, p in zip(batch["db_id"], batch["db_path"], strict=True) for r in _described(p)[1]]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in KEYS.split(", ")])

    return databases.select("db_id", "db_path").mapInPandas(run, KEYS)


def table_counts(columns: DataFrame) -> DataFrame:
    """(db_id, n_tables, n_columns, n_keys)."""
    return columns.groupBy("db_id").agg(F.count_distinct("table_name").alias("n_tables"), F.count("*").alias("n_columns"), F.count_if("is_pk").alias("n_keys"))


def schema_text(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(db_id, schema): tables and foreign keys of each database as lines of text, in the catalogue's order."""
    from ..functions.text import schema_section

    cols = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"])
    tables = columns.groupBy("db_id", "table_name").agg(cols.alias("columns"))
    tables = tables.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct(F.col("table_name").alias("name"), "columns"))).alias("t"))
    links = keys.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct(F.col("from_column").alias("column"), "to_table", "to_column"))).alias("k"))
    return tables.join(links, "db_id", "left").select("db_id", schema_section(F.col("t"), F.col("k")).alias("schema"))
