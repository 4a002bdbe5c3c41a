"""Queries read by their shape against queries read one by one."""

import pytest

from plumbline.plans import distance
from plumbline.plans.analysis import tree_for
from plumbline.plans.shapes import shape
from plumbline.plans.sqltree import text_of

CATALOG = (("t", ("a", "b", "c")), ("u", ("d",)))
QUERIES = [
    "select A from t where a = {0} and b = {1} and a = {0} limit {1}", "select a {2} from t", "select a from t where 'It''s' = a or a > {0} or a > -{0}", "select a1.5 from t where b = .5 and c in (1.5.3, {1})",
    "select interval {0} day, date {2} from t", "select cast(a as decimal({0}, {1})) from t -- {0}", 'select "a 1" from t where `b` = {0}', "select a from t where a = 'open", "selec {0}", "select é from t where a = {0}", "", None,
    "select count(*) from t, u where a = d and a = {2} group by b having count(*) > {0} order by {1}",
]
VALUES = [("1", "2", "'x'"), ("1", "1", "'X y'"), ("1E5", "1.0", "''"), ("007", "7", "'a''b'")]


@pytest.mark.parametrize("catalog", [CATALOG, None])
def test_shapes_give_what_single_queries_give(catalog):
    describe, measure, read, trace = distance.Describer(), distance.Measurer(), distance.Reader(), distance.Tracer()
    tree = lambda q: tree_for(q, catalog and dict(catalog))
    filled = [q and q.format(*v) for q in QUERIES for v in VALUES]
    for q in filled:
        assert describe(q, catalog) == distance._described(tree(q), q, True)
        assert read(q) == read._one(q) and trace(q, CATALOG) == trace._one(q, CATALOG)
        for other in filled[::3]:
            assert measure(q, other, catalog) == distance.normalized_edits(tree(q), tree(other))


def test_queries_of_one_shape_are_parsed_once(spark, monkeypatch):
    describe, asked = distance.Describer(), []
    monkeypatch.setattr(distance, "text_of", lambda n: asked.append(n) or text_of(n))
    for i in range(500):
        assert describe(f"select a from t where a = {i} and b = 'x{i}'", CATALOG)[1] == f"SELECT a FROM t WHERE a = {i} AND b = 'x{i}'".replace("a ", "t.a ", 0).replace("SELECT a", "SELECT t.a").replace("WHERE a", "WHERE t.a").replace("AND b", "AND t.b")
    assert len(asked) == 1 and shape("select 1") and not shape("select 1 -- x")


def test_rows_of_one_partition_are_read_by_many_tasks(spark):
    rows = spark.range(100).coalesce(1).selectExpr("id", "'select 1 from t where a = ' || id AS sql")
    for done in (distance.described(rows, "sql", "d"), distance.parsed_records(rows), distance.edit_distances(rows, "sql", "sql")):
        assert done.rdd.getNumPartitions() > 1
