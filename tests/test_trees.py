"""The parser, what it says of a query, and distances."""

import pytest

from plumbline.plans.analysis import catalog_tables, columns_used, components, lineage, normalize, tables_used
from plumbline.plans.distance import described, distances, normalized_edits, tree_edits
from plumbline.plans.sqltree import SqlError, parse, parsed_or_none, plain_normal, text_of

MOVIES = {"movies": ["movie_id", "movie_title", "release_year", "movie_popularity"], "ratings": ["rating_id", "movie_id", "rating_score", "user_id"]}
GOLD = "SELECT movie_title FROM movies WHERE release_year = 1945 ORDER BY movie_popularity DESC"
NEAR = "SELECT movie_title FROM movies WHERE release_year = 1945"
FAR = "SELECT COUNT(*) FROM ratings GROUP BY user_id"

ROUND = [
    GOLD, NEAR, FAR, "select a, b as x from t where a = 1 and b<>'x' limit 5 offset 2", "select * from a join b using (x, y) left outer join c on c.z = a.z cross join d, e",
    "with c(n) as (select 1 union all select n+1 from c where n<5) select * from c", "select case when a between 1 and 2 then 'p' else null end from (select * from q) s where not exists (select 1 from z)",
    "select sum(x) filter (where y > 1) over (partition by a order by b desc nulls last rows between 1 preceding and current row) from t", "select (a + 1) * 2 - -3, a - (b - c) from t intersect select 1, 2 except all select 3, 4",
    "select `a b`, \"c\", [d] from [e f] where x = 'it''s' -- note\n /* more */;", "select cast(a as decimal(10,2)), b::int, date '2020-01-01', interval '1 day' from t where a is not distinct from b", "select count(distinct a), group_concat(b, ',') from t where a in (1, 2) or b not in (select c from d)",
]


@pytest.mark.parametrize("sql", ROUND)
def test_text_of_a_tree_is_stable(sql):
    once = text_of(parse(sql))
    assert text_of(parse(once)) == once


@pytest.mark.parametrize("sql", ["", "   ", None, "how many films are there", "select", "select a from", "select a from t where", "select (a from t", "drop table t", "select 'x from t", "select " + "(" * 500 + "1" + ")" * 500])
def test_what_is_no_query(sql):
    assert parsed_or_none(sql) is None
    assert plain_normal(sql) is None
    with pytest.raises(SqlError):
        parse(sql)


def test_precedence():
    assert text_of(parse("select a from t where x = 1 or y = 2 and not z = 3")) == "SELECT a FROM t WHERE x = 1 OR y = 2 AND NOT z = 3"
    assert text_of(parse("select a from t where (x = 1 or y = 2) and z = 3")) == "SELECT a FROM t WHERE (x = 1 OR y = 2) AND z = 3"
    assert text_of(parse("select a union select b union select c").children[0]) == "SELECT a UNION SELECT b"


def test_normal_forms():
    a = normalize("select m.Movie_Title from movies as m where 1945 = m.release_year", MOVIES)
    assert a == normalize("SELECT movie_title FROM movies WHERE release_year = 1945 AND release_year = 1945", MOVIES)
    assert normalize("select a where true and x", None) == "SELECT a WHERE x"
    assert normalize("  no query ", MOVIES) == "no query"
    assert normalize("select a.x from t a join t b on a.y = b.y") == "SELECT a.x FROM t AS a JOIN t AS b ON a.y = b.y"


def test_components():
    c = components(parse("SELECT DISTINCT t.a, max(b) m, *, a + 1 FROM t1 t JOIN t2 ON t.x = t2.x WHERE a = 1 AND (b = 2 OR c = 3) GROUP BY t.g HAVING count(*) > 1 ORDER BY z DESC, a LIMIT 3"))
    assert c["select"] == ["column||a", "aggregate|max|b", "star||*", "expression||a + 1"]
    assert c["where"] == ["a = 1", "b = 2 or c = 3"] and c["groupby"] == ["g"] and c["having"] == ["count(*) > 1"]
    assert c["orderby"] == ["(z,desc)", "(a,asc)"] and c["limit"] == ["3"] and c["join"] == ["t1", "t2"]
    assert components(None) is None
    assert all(v == [] for k, v in components(parse("select 1")).items() if k != "select")


def test_names():
    tree = parse("WITH w AS (SELECT 1) SELECT m.movie_title, release_year FROM movies m JOIN w ON 1 = 1")
    assert tables_used(tree) == ["movies", "w"] or set(tables_used(tree)) == {"movies", "w"}
    assert tables_used(tree, parity=False) == ["movies"]
    assert set(columns_used(tree)) == {"m.movie_title", "*.release_year"}
    assert set(columns_used(tree, parity=False)) == {"movies.movie_title", "*.release_year"}
    assert catalog_tables("select * from Movies, other", MOVIES) == ["movies"]


def test_lineage():
    got = lineage("select movie_title, (select max(rating_score) from ratings r where r.movie_id = m.movie_id) from movies m", MOVIES)
    assert {k: set(v) for k, v in got.items()} == {"movies": {"movie_title", "movie_id"}, "ratings": {"rating_score", "movie_id"}}
    assert lineage("nonsense", MOVIES) == {}


def test_tree_edits():
    a, b = parse(GOLD), parse(NEAR)
    assert tree_edits(a, a) == 0 and normalized_edits(a, a) == 0
    assert tree_edits(a, b) == tree_edits(b, a) == 3  # orderby, ordered and its column
    assert 0 < normalized_edits(a, b) < normalized_edits(a, parse(FAR)) <= 1
    assert normalized_edits(None, a) == normalized_edits(a, None) == 1


def _scores(spark, sqls, parity=True, catalog=MOVIES):
    df = spark.createDataFrame([(i, s, GOLD, catalog) for i, s in enumerate(sqls)], "i int, sql string, gold_sql string, c map<string,array<string>>")
    return [r.asDict() for r in distances(df, catalog="c", parity=parity).orderBy("i").collect()]


def test_composite(spark):
    same, near, far, junk, unknown, many = _scores(spark, [GOLD, NEAR, FAR, "not sql at all", "SELECT * FROM nowhere", "SELECT 1 FROM a, b, c, d, e, f"])
    assert same["composite"] == 0 and not same["parse_failed"]
    assert 0 < near["composite"] < far["composite"] <= 1
    assert junk["parse_failed"] and junk["composite"] == junk["ted"] == junk["component_f1"] == junk["schema_penalty"] == 1
    assert unknown["schema_penalty"] == pytest.approx(0.2) and many["schema_penalty"] == 1
    for r in (same, near, far):
        assert r["composite"] == pytest.approx(0.5 * r["component_f1"] + 0.3 * r["ted"] + 0.2 * r["schema_penalty"])


def test_aliases_are_penalised_only_for_parity(spark):
    sql = "SELECT a.movie_title FROM movies a JOIN movies b ON a.movie_id = b.movie_id"
    assert _scores(spark, [sql])[0]["schema_penalty"] == pytest.approx(0.3)
    assert _scores(spark, [sql], parity=False)[0]["schema_penalty"] == 0


def test_without_catalogue_nothing_is_penalised(spark):
    df = spark.createDataFrame([("SELECT * FROM nowhere", GOLD), (None, GOLD), (NEAR, None)], "sql string, gold_sql string")
    rows = {r.sql: r for r in distances(df).collect() if r.gold_sql}
    assert rows["SELECT * FROM nowhere"].schema_penalty == 0 and rows[None].composite == 1
    assert described(df, "sql", "d").count() == 3
