"""Structural distance between queries: component F1, tree edits and names that do not exist."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linking import merged_columns, penalty, restored_columns
from ..operators.metrics import WEIGHTS, component_f1
from .analysis import columns_used, components, lineage, qualified, simplify, tables_used, tree_for
from .shapes import Filled, Memo, bare, marked, shape
from .sqltree import Node, SqlError, parse, text_of


@dataclass(frozen=True)
class Weights:
    component: float = 0.5
    ted: float = 0.3
    schema: float = 0.2


def _numbered(tree: Node):
    """Labels, leftmost leaves and key roots of a tree in post-order."""
    labels: list[str] = []
    left: list[int] = []

    def go(n: Node) -> int:
        first = -1
        for c in n.children:
            leaf = go(c)
            first = leaf if first < 0 else first
        labels.append(f"{n.kind}:{n.label}")
        left.append(first if first >= 0 else len(labels) - 1)
        return left[-1]

    go(tree)
    return labels, left, sorted({leaf: i for i, leaf in enumerate(left)}.values())


def tree_edits(a: Node, b: Node) -> int:
    """The least number of nodes to insert, delete or rename (Zhang and Shasha, 1989)."""
    la, fa, ka = _numbered(a)
    lb, fb, kb = _numbered(b)
    done = np.zeros((len(la), len(lb)), np.int32)
    for i in ka:
        for j in kb:
            p, q = fa[i], fb[j]
            grid = [[0] * (j - q + 2) for _ in range(i - p + 2)]
            for x in range(1, i - p + 2):
                grid[x][0] = x
            grid[0] = list(range(j - q + 2))
            for x in range(1, i - p + 2):
                here, above, s = grid[x], grid[x - 1], p + x - 1
                for y in range(1, j - q + 2):
                    t = q + y - 1
                    least = min(above[y], here[y - 1]) + 1
                    if fa[s] == p and fb[t] == q:
                        least = min(least, above[y - 1] + (la[s] != lb[t]))
                        done[s, t] = least
                    else:
                        least = min(least, grid[fa[s] - p][fb[t] - q] + int(done[s, t]))
                    here[y] = least
    return int(done[-1, -1])


def size(tree: Node) -> int:
    return sum(1 for _ in tree.walk())


def normalized_edits(a: Node | None, b: Node | None) -> float:
    """Edits over the larger tree's size, within 0 and 1; 1 if a tree is missing."""
    if a is None or b is None:
        return 1.0
    return min(1.0, tree_edits(a, b) / max(size(a), size(b)))


COMPONENTS = "struct<" + ",".join(f"{k}:array<string>" for k in WEIGHTS) + ">"
SIDE = f"struct<parsed:boolean,normalized:string,components:{COMPONENTS},tables:array<string>,columns:array<string>>"


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all tasks: a table may be one file, or a shuffle's result few partitions, whose texts one task would read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _catalog(c) -> tuple | None:
    return None if c is None else tuple((k, tuple(v)) for k, v in dict(c).items())


def _described(tree: Node | None, text: str | None, parity: bool) -> tuple:
    if tree is None:
        return False, (text or "").strip(), {k: [] for k in WEIGHTS}, [], []
    return True, text_of(tree), components(tree), tables_used(tree, parity), columns_used(tree, parity)


def _simplified(tree: Node, catalog: dict | None) -> Node:
    return simplify(qualified(tree, catalog))


class Describer:
    """What described() says of a query; queries of one shape are read once."""

    def __init__(self, parity: bool = True) -> None:
        self.parity, self.shapes, self.texts = parity, Memo(), Memo()

    def _shape(self, between, at, literals, catalog) -> tuple | None:
        tree = marked(between, at, literals)
        if tree is None:
            return None
        _, text, parts, tables, columns = _described(_simplified(tree, catalog and dict(catalog)), None, self.parity)
        if any("\x01" in x for x in (*tables, *columns)):
            return None
        return Filled(text), {k: [Filled(x) for x in xs] for k, xs in parts.items()}, tables, columns

    def __call__(self, text: str | None, catalog: tuple | None) -> tuple:
        cut = shape(text)
        if cut:
            [between], at, literals = cut
            made = self.shapes((between, at, tuple(x[0] == "'" for x in literals), catalog), lambda: self._shape(between, at, literals, catalog))
            if made:
                plain, parts, tables, columns = made
                values = bare(literals)
                low = [x.lower() for x in values]
                return True, plain(values), {k: [x(low) for x in xs] for k, xs in parts.items()}, tables, columns
        return self.texts((text, catalog), lambda: _described(tree_for(text, catalog and dict(catalog)), text, self.parity))


def described(df: DataFrame, sql: str, into: str, catalog: str | None = None, parity: bool = True) -> DataFrame:
    """Adds a struct: whether the query parses, its normal form, components, tables and columns. catalog names a column
    map<string, array<string>> of the tables that its database has."""

    @F.pandas_udf(SIDE)
    def describe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        describer = Describer(parity)
        for texts, known in batches:
            yield pd.DataFrame([describer(t, _catalog(c)) for t, c in zip(texts, known, strict=True)], columns=["parsed", "normalized", "components", "tables", "columns"])

    known = F.col(catalog) if catalog else F.lit(None).cast("map<string,array<string>>")
    return _spread(df).withColumn(into, describe(F.col(sql), known))


class Measurer:
    """normalized_edits of two queries; pairs of one shape, with the same literals equal, are compared once."""

    def __init__(self) -> None:
        self.shapes, self.texts = Memo(), Memo()

    def _shape(self, between, at, literals, catalog) -> float | None:
        n = len(between[0]) - 1
        trees = [marked(between[0], at[:n], literals), marked(between[1], at[n:], literals)]
        if None in trees:
            return None
        return normalized_edits(*[_simplified(t, catalog and dict(catalog)) for t in trees])

    def __call__(self, a: str | None, b: str | None, catalog: tuple | None) -> float:
        cut = shape(a, b)
        if cut:
            between, at, literals = cut
            made = self.shapes((*between, at, tuple(x[0] == "'" for x in literals), catalog), lambda: self._shape(between, at, literals, catalog))
            if made is not None:
                return made
        c = catalog and dict(catalog)
        return self.texts((a, b, catalog), lambda: normalized_edits(tree_for(a, c), tree_for(b, c)))


def edit_distances(df: DataFrame, a: str, b: str, into: str = "ted", catalog: str | None = None) -> DataFrame:
    """Adds the normalised tree edit distance of two queries."""

    @F.pandas_udf("double")
    def edits(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        measure = Measurer()
        for x, y, known in batches:
            yield pd.Series([measure(p, q, _catalog(c)) for p, q, c in zip(x, y, known, strict=True)], dtype="float64")

    known = F.col(catalog) if catalog else F.lit(None).cast("map<string,array<string>>")
    return _spread(df).withColumn(into, edits(F.col(a), F.col(b), known))


def distances(pairs: DataFrame, pred: str = "sql", gold: str = "gold_sql", catalog: str | None = None, weights: Weights = Weights(), parity: bool = True) -> DataFrame:  # noqa: B008
    """pairs with component_f1, ted, schema_penalty (all distances from 0 to 1), parse_failed and composite.

    Only distinct pairs are parsed and compared. A query that can't be parsed has distance 1 throughout. Without a catalogue
    nothing is penalised and the weights stay as they are. catalog as in described()."""
    keys = [pred, gold, *([catalog] if catalog else [])]
    # a map can't be a grouping key; its entries can
    prepared = pairs.withColumn("__c", F.array_sort(F.map_entries(catalog))) if catalog else pairs.withColumn("__c", F.lit(None).cast("array<struct<key:string,value:array<string>>>"))
    once = prepared.select(*[k for k in keys if k != catalog], "__c").distinct().withColumn("__m", F.map_from_entries("__c"))
    one = described(described(once, pred, "__p", "__m" if catalog else None, parity), gold, "__g", "__m" if catalog else None, parity)
    one = edit_distances(one, pred, gold, "ted", "__m" if catalog else None)
    failed = ~(F.col("__p.parsed") & F.col("__g.parsed"))
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    valid_tables = low(F.map_keys("__m"))
    valid_columns = F.flatten(F.transform(F.map_entries("__m"), lambda e: F.transform(e["value"], lambda c: F.concat(F.lower(e["key"]), F.lit("."), F.lower(c)))))
    bad = penalty(F.col("__p.tables"), F.col("__p.columns"), valid_tables, valid_columns) if catalog else F.lit(0.0)
    one = one.withColumns({"parse_failed": failed, "component_f1": F.when(failed, 1.0).otherwise(component_f1(F.col("__p.components"), F.col("__g.components"))), "ted": F.when(failed, 1.0).otherwise(F.col("ted")), "schema_penalty": F.when(failed, 1.0).otherwise(bad)})
    whole = weights.component * F.col("component_f1") + weights.ted * F.col("ted") + weights.schema * F.col("schema_penalty")
    one = one.withColumn("composite", F.when(failed, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)))).drop("__p", "__g", "__m")
    same = [k for k in keys if k != catalog]
    found = one.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*same, "__c"])], "component_f1", "ted", "schema_penalty", "parse_failed", "composite")
    rows = prepared.drop("component_f1", "ted", "schema_penalty", "parse_failed", "composite")
    joined = rows.join(found, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*same, "__c"])], "left")
    return joined.drop("__c", *[f"__k{i}" for i in range(len(same) + 1)])


class Reader:
    """(normalized_sql, error) of a text; queries of one shape are read once."""

    def __init__(self) -> None:
        self.shapes, self.texts = Memo(), Memo()

    def _one(self, text: str | None) -> tuple:
        try:
            return text_of(parse(text)), None
        except SqlError as e:
            return None, {"type": "SqlError", "message": str(e)}

    def __call__(self, text: str | None) -> tuple:
        cut = shape(text)
        if cut:
            [between], at, literals = cut
            made = self.shapes((between, at, tuple(x[0] == "'" for x in literals)), lambda: (tree := marked(between, at, literals)) and Filled(text_of(tree)))
            if made:
                return made(bare(literals)), None
        return self.texts(text, lambda: self._one(text))


def parsed_records(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds normalized_sql, or error (type and message) where the text is no query. Texts that a task has read lately are not parsed again."""

    @F.pandas_udf("struct<normalized_sql:string,error:struct<type:string,message:string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for texts in batches:
            yield pd.DataFrame([reader(t) for t in texts], columns=["normalized_sql", "error"])

    return _spread(df).withColumn("__p", read(F.col(sql))).select("*", "__p.*").drop("__p")


class Tracer:
    """Table and column of all that a query reads, in order; queries of one shape are read once."""

    def __init__(self) -> None:
        self.shapes, self.texts = Memo(), Memo()

    def _one(self, text: str | None, catalog: tuple) -> list[dict]:
        return [{"table_name": t, "column_name": c} for t, cs in lineage(text, dict(catalog)).items() for c in cs]

    def __call__(self, text: str | None, catalog: tuple) -> list[dict]:
        cut = shape(text)
        if cut:
            [between], at, literals = cut
            key = between, at, tuple(x[0] == "'" for x in literals), catalog
            made = self.shapes(key, lambda: None if marked(between, at, literals) is None else self._one(text, catalog))
            if made is not None:
                return made
        return self.texts((text, catalog), lambda: self._one(text, catalog))


def lineage_rows(df: DataFrame, keys: list[str], sql: str, pos: str, catalog: str) -> DataFrame:
    """(keys, pos, table_name, column_name): what each query reads of its database's tables (catalog: map<string, array<string>>), in order."""

    @F.pandas_udf("array<struct<table_name:string,column_name:string>>")
    def trace(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tracer = Tracer()
        for texts, known in batches:
            yield pd.Series([tracer(s, _catalog(m) or ()) for s, m in zip(texts, known, strict=True)])

    rows = _spread(df).select(*keys, F.struct(F.col(pos).alias("p")).alias("at"), trace(F.col(sql), F.col(catalog)).alias("r"))
    return rows.select(*keys, "at", F.posexplode("r").alias("i", "r")).select(*keys, F.struct("at.p", "i").alias("pos"), "r.table_name", "r.column_name")


def merged_schema(df: DataFrame, catalog_columns: DataFrame, keys: list[str], sql: str, pos: str, catalog: str) -> DataFrame:
    """(keys, table_name, columns): the columns that several queries of a question read, merged in order and in the catalogue's spelling."""
    traced = lineage_rows(df, keys, sql, pos, catalog)
    known = traced.select(*keys, "table_name").distinct()
    return restored_columns(merged_columns(traced, known, keys), catalog_columns, keys)
