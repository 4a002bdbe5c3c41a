"""Readers, catalogues, execution on SQLite files and streams."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cluster
from plumbline.plans import execute
from plumbline.sources import catalog, readers, writers
from plumbline.streaming import candidates as streams


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "films.sqlite"
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE film (id INTEGER PRIMARY KEY, name TEXT NOT NULL, score REAL, raw BLOB); CREATE TABLE vote (film_id INTEGER, n, FOREIGN KEY (film_id) REFERENCES film (id)); INSERT INTO film VALUES (1, 'a', 1.0, x'AB'), (2, 'b', 2.5, NULL); INSERT INTO vote VALUES (1, 3), (1, 4);")
    con.commit()
    con.close()
    return str(path)


def test_items_and_candidates(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps([{"db_id": "d", "question": "q", "SQL": "s"}, {"db_id": "d", "query": "t"}]))
    assert [(r.sample_id, r.SQL) for r in readers.items(spark, str(tmp_path / "items.json")).orderBy("sample_id").collect()] == [(0, "s"), (1, "t")]
    folder = tmp_path / "c"
    folder.mkdir()
    for name, value in (("12_x.json", [{"all_sqls": [" a ", "a"]}, {"all_sqls": ["b"]}]), ("3_y.json", [{"all_sqls": ["c"]}]), ("3_y_ast.json", []), ("note.json", [])):
        (folder / name).write_text(json.dumps(value))
    assert [(r.sample_id, r.name) for r in readers.sample_files(spark, str(folder)).collect()] == [(3, "3_y.json"), (12, "12_x.json")]
    assert readers.sample_files(spark, str(folder), 0).count() == 0
    rows = readers.candidates(spark, str(folder))
    assert {(r.sample_id, r.record_index, r.sql_index, r.sql) for r in rows.collect()} == {(12, 0, 0, "a"), (12, 0, 1, "a"), (12, 1, 0, "b"), (3, 0, 0, "c")}
    assert cluster.clusters(rows).count() == 3


def test_packed_and_location(spark, tmp_path):
    lines = spark.createDataFrame([(0, "q1\t----- bird -----\td1"), (1, "q2\t----- SQL-EVAL -----\td2"), (2, "q3\td3  "), (3, "q4"), (4, "  ")], "index long, value string")
    dbs = spark.createDataFrame([(3, "d4")], "index long, db_id string")
    assert {(r["index"], r.sql, r.db_id) for r in readers.packed_sql(lines, dbs).collect()} == {(0, "q1", "d1"), (1, "q2", "d2"), (2, "q3", "d3"), (3, "q4", "d4")}
    (tmp_path / "where").write_text("# note\n\na = 1\nb=x=y\n")
    assert readers.location(spark, str(tmp_path / "where"), ["a", "b"]) == {"a": "1", "b": "x=y"}
    with pytest.raises(ValueError):
        readers.location(spark, str(tmp_path / "where"), ["c"])


def test_metadata(spark, tmp_path):
    meta = [{"db_id": "d", "table_names_original": ["T", "u"], "table_names": [], "column_names_original": [[-1, "*"], [0, "Id"], [1, "t_id"]], "column_types": ["text", "number"], "primary_keys": [1], "foreign_keys": [[2, 1], [9, 1]]}]
    (tmp_path / "tables.json").write_text(json.dumps(meta))
    m = readers.metadata(spark, str(tmp_path / "tables.json"))
    assert [(r.table_name, r.column_name, r.col_type, r.is_pk) for r in readers.catalog_columns(m).orderBy("ordinal").collect()] == [("T", "Id", "NUMBER", True), ("u", "t_id", "TEXT", False)]
    assert [tuple(r) for r in readers.catalog_keys(m).collect()] == [("d", "u", "t_id", "T", "Id")]
    assert readers.schema_map(readers.catalog_columns(m)).first().tables == {"t": ["Id"], "u": ["t_id"]}


def test_json_lines(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n{"a": null}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{oops\n')
    assert readers.json_lines(spark, str(tmp_path / "ok.jsonl"), "a int").count() == 2
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    df = spark.createDataFrame([(1, "é", None)], "sample_id long, x string, y string")
    writers.json_lines(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"sample_id":1,"x":"é","y":null}'
    writers.by_sample(df, str(tmp_path / "parts"))
    assert spark.read.json(str(tmp_path / "parts")).filter("sample_id = 1").count() == 1
    assert writers.as_json(df.select("x")).first().json == '{"x":"é"}'


def test_sqlite_catalog(spark, db):
    dbs = spark.createDataFrame([("films", db)], "db_id string, db_path string")
    columns = catalog.sqlite_columns(dbs)
    assert {(r.table_name, r.column_name, r.col_type, r.is_pk) for r in columns.collect()} == {("film", "id", "INTEGER", True), ("film", "name", "TEXT", False), ("film", "score", "REAL", False), ("film", "raw", "BLOB", False), ("vote", "film_id", "INTEGER", False), ("vote", "n", "TEXT", False)}
    keys = catalog.sqlite_keys(dbs)
    assert [tuple(r) for r in keys.collect()] == [("films", "vote", "film_id", "film", "id")]
    assert catalog.schema_text(columns, keys).first().schema == "Table film(id, name, score, raw)\nTable vote(film_id, n)\nFK: film_id -> film.id"
    assert tuple(catalog.table_counts(columns).first()) == ("films", 2, 6, 1)
    spark.range(1).createOrReplaceTempView("one_view")
    assert catalog.spark_columns(spark).filter("table_name = 'one_view'").first().col_type == "BIGINT"


def test_sqlite_results(spark, db):
    sqls = ["SELECT score, raw FROM film ORDER BY id", "SELECT nope FROM film", "SELECT * FROM nope", "selec", "DELETE FROM film", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT count(*) FROM r"]
    df = spark.createDataFrame([(i, db, s) for i, s in enumerate(sqls)] + [(9, "/no/such/file", "SELECT 1")], "i int, db_path string, sql string")
    got = {r.i: r for r in execute.with_error_kind(execute.sqlite_results(df, timeout=1.0)).collect()}
    assert got[0].rows == ['[1.0, "ab"]', "[2.5, null]"] and got[0].row_count == 2
    assert [got[i].kind for i in (1, 2, 3)] == ["no such column", "no such table", "syntax error"]
    assert got[4].status == "error" and got[5].status == "timeout" and got[9].status == "error"


def test_evaluated(spark, db):
    cands = spark.createDataFrame([(0, "SELECT name FROM film", 3), (0, "SELECT name FROM film ORDER BY id DESC", 1), (0, "SELECT 1", 1), (0, "oops", 1), (1, "SELECT 1", 1), (7, "SELECT 1", 1)], "sample_id long, sql string, count long").withColumn("first", F.struct("count")).withColumn("occurrences", F.array("first"))
    items = spark.createDataFrame([(0, "films", db, "SELECT name FROM film ORDER BY id"), (1, "films", db, "SELECT broken")], "sample_id long, db_id string, db_path string, gold_sql string")
    for mode, want in (("bag", [True, True, False, False]), ("strict", [True, False, False, False])):
        got = {(r.sample_id, r.sql): r for r in execute.evaluated(cands, items, mode).collect()}
        assert [got[0, s].is_correct for s in ("SELECT name FROM film", "SELECT name FROM film ORDER BY id DESC", "SELECT 1", "oops")] == want
        assert got[1, "SELECT 1"].is_correct is None and got[1, "SELECT 1"].error.startswith("gold") and got[7, "SELECT 1"].error == "no item at this place"
    done = execute.evaluated(cands, items)
    s = execute.run_summary(done).first()
    assert (s.total_files, s.total_clusters, s.total_candidates, s.correct_total, s.wrong_total, s.error_total) == (3, 6, 8, 2, 2, 2)
    nested = {r.sample_id: r for r in execute.per_sample(done).collect()}
    assert len(nested[0].correct_set) == 2 and len(nested[0].wrong_set) == 2


def test_spark_execution(spark):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string").createOrReplaceTempView("t_exec")
    assert execute.same_result(spark, "SELECT * FROM t_exec ORDER BY k", "SELECT k, v FROM t_exec ORDER BY k", "strict")
    assert not execute.same_result(spark, "SELECT k FROM t_exec ORDER BY k", "SELECT k FROM t_exec ORDER BY k DESC", "strict")
    assert not execute.same_result(spark, "SELECT k FROM t_exec", "SELECT DISTINCT k FROM t_exec", "bag") and execute.same_result(spark, "SELECT k FROM t_exec", "SELECT DISTINCT k FROM t_exec", "set")
    assert not execute.same_result(spark, "SELECT k FROM t_exec WHERE k > 9", "SELECT k FROM t_exec WHERE k > 9", "set", empty_matches=False)
    assert execute.executable(spark, " ") == "Error: empty string" and execute.executable(spark, "SELECT 1") is None
    df = spark.table("t_exec").orderBy("k")
    assert len(execute.fetch(df)) == 3 and execute.fetch(df, "one")[0].k == 1 and len(execute.fetch(df, 2)) == 2 and len(execute.fetch(df, "random")) == 1
    with pytest.raises(execute.TimedOut):
        execute.with_timeout(spark, lambda: spark.range(10**11).selectExpr("sum(sqrt(id) % 7)").collect(), 1.0)
    got = {r.case_id: (r.status, r.is_correct) for r in execute.verdicts(spark, [(1, "SELECT 1", "SELECT 1"), (2, "SELECT 1", "SELECT x"), (3, "SELECT x", "SELECT 1"), (4, "SELECT 1", "SELECT 1, 2")]).collect()}
    assert got == {1: ("success", True), 2: ("error", False), 3: ("gold_error", None), 4: ("success", False)}


def test_streamed_clusters(spark, tmp_path):
    rows = [(1, 0, 0, " a ", "2024-01-01T00:10:00"), (1, 0, 1, "a", "2024-01-01T00:20:00"), (1, 1, 0, "b", "2024-01-01T00:30:00"), (1, 1, 1, "", "2024-01-01T00:40:00"), (2, 0, 0, "a", "2024-01-01T02:00:00")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("sample_id", "record_index", "sql_index", "sql", "arrived"), r, strict=True))) for r in rows))
    out = streams.streamed_clusters(streams.arrivals(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.sample_id, r.sql, r["count"]) for r in spark.table("seen").collect()} == {(1, "a", 2), (1, "b", 1), (2, "a", 1)}
    first = streams.first_arrivals(streams.arrivals(spark, str(tmp_path / "in")))
    q = first.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 3


def test_few_shots_and_names(spark):
    lines = spark.createDataFrame([(0, "0,1,0"), (1, "7,0"), (2, "2")], "index long, value string")
    train = spark.createDataFrame([(0, "q0", "s0", ""), (1, "q1", "s1", None)], "sample_id long, question string, SQL string, evidence string")
    got = {r["index"]: r for r in readers.few_shots(lines, train).collect()}
    assert [e.question for e in got[0].examples] == ["q1", "q0"] and got[0].error is None and got[1].error and got[2].examples == []
    names = spark.createDataFrame([("3_x_eval.json",), ("gold.json",)], "n string")
    assert [r.x for r in names.select(readers.tree_file_name(F.col("n")).alias("x")).collect()] == ["3_x_ast.json", "gold_ast.json"]
    assert spark.range(1).select(readers.database_path(F.lit("/r"), F.lit("d")).alias("p")).first().p == "/r/d/d.sqlite"
    flat = readers.database_path(F.lit("/r"), F.lit("d"), F.array(F.lit("/r/d.sqlite")))
    assert spark.range(1).select(flat.alias("p")).first().p == "/r/d.sqlite"


def test_results_of_any_size(spark, db):
    """Hashes of whole results: order, repeats and 1.0 against 1, by mode; a large result keeps its first rows only."""
    sqls = ["SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 2", "SELECT 2 UNION ALL SELECT 1 UNION ALL SELECT 2", "SELECT 1 UNION ALL SELECT 2", "SELECT 1.0 UNION ALL SELECT 2 UNION ALL SELECT 2", "SELECT 1 WHERE 0", "SELECT 2 WHERE 0", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r LIMIT 20000) SELECT n FROM r"]
    df = spark.createDataFrame([(i, db, s) for i, s in enumerate(sqls)], "i int, db_path string, sql string")
    got = {r.i: r for r in execute.sqlite_results(df).collect()}
    same = lambda k, a, b: got[a][f"{k}_hash"] == got[b][f"{k}_hash"]
    assert [same(k, 0, 1) for k in ("strict", "bag", "set")] == [False, True, True]
    assert [same(k, 0, 2) for k in ("strict", "bag", "set")] == [False, False, True]
    assert [same(k, 0, 3) for k in ("strict", "bag", "set")] == [True, False, True]
    assert [same(k, 4, 5) for k in ("strict", "bag", "set")] == [True, True, True]
    assert got[6].row_count == 20000 and len(got[6].rows) == execute.SHOWN
    assert execute.sqlite_rows(db, "SELECT count(*) FROM film") == [(2,)]
    with pytest.raises(Exception, match="nope"):
        execute.sqlite_rows(db, "SELECT nope FROM film")


def test_eval_files(spark, tmp_path):
    from plumbline.sources import evalfiles

    good = {"metadata": {"sample_id": 12}, "correct_set": [{"sql": "SELECT a FROM t", "gold_sql": "SELECT b FROM t", "db_id": "d", "count": 2}, {"sql": "SELECT a FROM t", "gold_sql": "SELECT b FROM t"}], "wrong_set": [{"sql": "oops at all", "gold_sql": "SELECT c FROM t", "sample_id": 5}]}
    files = {"12_x_eval.json": json.dumps(good), "3_y_eval.json": json.dumps({"correct_set": [], "wrong_set": [{"sql": "SELECT 1", "sample_id": 3}], "metadata": {"db_id": "m"}}), "4_eval.json": "{}", "a_b_eval.json": "{}", "5_b_eval.json": "{no", "6_b_eval.json": "{}", "7_b_eval.json": '{"correct_set": {}}', "8_b_eval.json": '{"correct_set": [1]}', "9_b_eval.json": '{"correct_set": [], "wrong_set": [{"sql": 4}]}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    assert [r.sample_id for r in evalfiles.eval_files(spark, str(tmp_path)).collect()] == [3, 5, 6, 7, 8, 9, 12]
    assert evalfiles.eval_files(spark, str(tmp_path), 2).count() == 2 and evalfiles.eval_files(spark, str(tmp_path), 0).count() == 7
    records = evalfiles.eval_records(evalfiles.eval_texts(spark, str(tmp_path)))
    rows = records.collect()
    assert {r.file[0]: r.error for r in rows if r.error} == {"5": "load error: no JSON", "6": "correct_set is missing", "7": "correct_set is no list", "8": "an item of correct_set is no object", "9": "an sql of wrong_set is no string"}
    assert sorted((r.sample_id, r.set_name, r.record_index, r.sql, r.db_id, r["count"], r.is_correct) for r in rows if not r.error and r.sample_id == 12) == [
        (12, "correct_set", 0, "SELECT a FROM t", "d", 2, True), (12, "correct_set", 1, "SELECT a FROM t", None, None, True), (12, "wrong_set", 0, "oops at all", None, None, False)]
    assert [(r.sample_id, r.meta_db_id) for r in rows if r.sample_id == 3] == [(3, "m")]
    parsed = evalfiles.parsed_eval(records.filter("error is null"))
    got = sorted((r.set_name, r.place, r.sql, r.normalized_sql) for r in parsed.filter("file like '12%'").collect())
    assert got == [("correct_set", 0, "SELECT a FROM t", "SELECT a FROM t"), ("correct_set", 1, "SELECT a FROM t", "SELECT a FROM t"), ("gold", 0, "SELECT b FROM t", "SELECT b FROM t"), ("gold", 1, "SELECT c FROM t", "SELECT c FROM t"), ("wrong_set", 0, "oops at all", None)]
    s = evalfiles.parsed_summary(evalfiles.parsed_eval(records.filter("error is null"), deduplicate=True)).filter("file like '12%'").first()
    assert (s.gold_count, s.correct_count, s.wrong_count, s.parsed_count, s.error_count) == (2, 1, 1, 3, 1)
    data = spark.createDataFrame([(1, ["select 1", "select 1", "x y z"]), (2, None), (3, [])], "k int, all_sqls array<string>")
    done = {r.k: r.normalized_sqls for r in evalfiles.parsed_dataset(data, ["k"]).collect()}
    assert [x.normalized_sql for x in done[1]] == ["SELECT 1", "SELECT 1", None] and done[2] is None
    assert len(evalfiles.parsed_dataset(data, ["k"], deduplicate=True).filter("k = 1").first().normalized_sqls) == 2


def test_gold_that_fails_late(spark):
    spark.createDataFrame([(0,), (1,)], "z int").createOrReplaceTempView("late_view")
    late, fine = "SELECT 1 div (z - z) AS x FROM late_view", "SELECT z FROM late_view"
    cases = [(1, late, fine), (2, fine, late), (3, fine, fine), (4, late, late)]
    got = {r.case_id: (r.status, r.is_correct) for r in execute.verdicts(spark, cases, "strict").collect()}
    assert got == {1: ("gold_error", None), 2: ("error", False), 3: ("success", True), 4: ("gold_error", None)}
    slow = "SELECT sum(sqrt(id) % 7) AS s FROM range(100000000000)"
    got = {r.case_id: (r.status, r.is_correct) for r in execute.verdicts(spark, [(1, slow, fine), (2, fine, slow.replace("s FROM", "z FROM"))], timeout=6.0, at_once=1).collect()}
    assert got == {1: ("gold_error", None), 2: ("timeout", False)}


def test_files_of_given_names(spark, tmp_path):
    rows = [(f"{i}_x_eval.json", f'{{"é": {i}}}') for i in range(20)] + [("empty.json", None)]
    df = spark.createDataFrame(rows, "name string, value string").repartition(3)
    for folder in (f"file://{tmp_path}/a", str(tmp_path / "b")):
        assert writers.named_files(df, folder) == writers.named_files(df, folder) == 21  # again: the same files
    for sub in "ab":
        assert {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / sub).iterdir() if not p.name.endswith(".crc")} == {n: v or "" for n, v in rows}
    assert writers.named_files(df.limit(0), str(tmp_path / "none")) == 0
    with pytest.raises(Exception, match="no name for a file"):
        writers.named_files(spark.createDataFrame([("a/b", "x")], "name string, value string"), str(tmp_path / "c"))
