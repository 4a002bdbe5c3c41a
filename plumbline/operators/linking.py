"""Schema linking: merging predicted columns, restoring their spelling, and penalties for names that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unquoted
from .cluster import first_seen

TABLE_PENALTY, COLUMN_PENALTY = 0.2, 0.1  # fixed values


def merged_columns(predicted: DataFrame, selected: DataFrame, keys: list[str] = ["question_id"]) -> DataFrame:  # noqa: B006
    """(keys, table_name, columns): the columns of each table over all predictions (keys, pos, table_name, column_name), in order of
    first sight, ignoring case and backquotes, the first spelling kept; only tables of `selected` (keys, table_name), any case.

    Two spellings of a table stay two tables."""
    rows = predicted.withColumns({"table_name": unquoted(F.col("table_name")), "column_name": unquoted(F.col("column_name"))}).withColumn("__t", F.lower("table_name"))
    wanted = selected.select(*keys, F.lower("table_name").alias("__t")).distinct()
    rows = rows.join(wanted, [*keys, "__t"], "left_semi").withColumn("__c", F.lower("column_name"))
    once = first_seen(rows.select(*keys, "table_name", "__c", "column_name", "pos"), [*keys, "table_name", "__c"], ["pos", "column_name"])
    return once.groupBy(*keys, "table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "column_name"))), lambda x: x["column_name"]).alias("columns"))


def restored_columns(tentative: DataFrame, catalog: DataFrame, keys: list[str] = ["question_id"]) -> DataFrame:  # noqa: B006
    """(keys, table_name, columns): predicted columns in the catalogue's spelling and the predictions' order; unknown ones are dropped,
    a table without known columns keeps an empty list.

    tentative has (keys, table_name, columns), catalog (table_name, column_name, ordinal). A table is looked up as spelt, then in
    lower case; a column as spelt, then ignoring case, where the catalogue's last such column counts."""
    rows = tentative.select(*keys, "table_name", F.posexplode_outer("columns").alias("__i", "__name"))
    known = catalog.select(F.col("table_name").alias("__kt"), F.col("column_name").alias("__kc"), F.col("ordinal").alias("__o"))
    tables = known.select("__kt").distinct()
    named = rows.join(tables.select(F.col("__kt").alias("__exact")), rows["table_name"] == F.col("__exact"), "left").withColumn("__kt", F.coalesce("__exact", F.lower("table_name"))).drop("__exact")
    met = named.withColumn("__low", F.lower("__name")).join(known.withColumn("__low", F.lower("__kc")), ["__kt", "__low"], "left")
    best = met.groupBy(*keys, "table_name", "__i").agg(F.max_by("__kc", F.struct((F.col("__kc") == F.col("__name")).cast("int"), "__o")).alias("__c"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("__c").isNotNull(), F.struct("__i", "__c"))))
    return best.groupBy(*keys, "table_name").agg(F.transform(pairs, lambda x: x["__c"]).alias("columns"))


def linked_tables(predictions: DataFrame, key: str = "index", tables: str = "tables") -> DataFrame:
    """(index, tables): the union of predicted tables over several files' rows, sorted."""
    return predictions.select(key, F.explode(tables).alias("t")).groupBy(key).agg(F.array_sort(F.collect_set("t")).alias(tables))


def linked_schema(predictions: DataFrame, key: str = "index", schema: str = "tentative_schema") -> DataFrame:
    """(index, tentative_schema): the union of predicted columns (map<table, array<column>>) over several files' rows, sorted."""
    rows = predictions.select(key, F.explode(schema).alias("t", "cs")).select(key, "t", F.explode("cs").alias("c"))
    each = rows.groupBy(key, "t").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "cs")))).alias(schema))


def penalty(tables: Column, columns: Column, valid_tables: Column, valid_columns: Column) -> Column:
    """Penalty, at most 1, for distinct unknown tables and unknown qualified columns (`table.column`); `*.column` is not judged."""
    bad_tables = F.size(F.array_except(F.array_distinct(tables), valid_tables))
    qualified = F.filter(F.array_distinct(columns), lambda c: ~F.startswith(c, F.lit("*.")))
    return F.least(F.lit(1.0), TABLE_PENALTY * bad_tables + COLUMN_PENALTY * F.size(F.array_except(qualified, valid_columns)))
