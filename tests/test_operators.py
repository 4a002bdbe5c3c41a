"""Worked cases of the operators, edge cases first."""

import decimal
import random
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions import losses, response, text
from plumbline.plans import execute
from plumbline.operators import augment, cascade, cluster, compare, linking, metrics, pairs, profile, ranking, search, vote


def one(spark, column, **values):
    kinds = {k: v[1] for k, v in values.items()}
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def of(spark, f, value):
    return one(spark, f(F.col("v")), v=(value, "string"))


@pytest.mark.parametrize("given, want", [
    ("a<answer> x </answer> b", "x"), ("<answer>1</answer><answer>2", "2"), ("none", "none"), ("", ""), (None, None),
])
def test_answer_text(spark, given, want):
    assert of(spark, response.answer_text, given) == want


@pytest.mark.parametrize("given, want", [
    ("<answer>SELECT 1;</answer>", "SELECT 1"), ("x ```sql\nSELECT 1\n``` y ```sql\nSELECT\n2;\n```", "SELECT\n2;"), ("<think>z</think> SELECT 3;</s>", "SELECT 3"), ("", ""),
])
def test_sql_of(spark, given, want):
    assert of(spark, response.sql_of, given) == want


@pytest.mark.parametrize("given, want", [
    ('{"choose": "b"}', "B"), ("{bad}", "A"), ("b", "B"), ("a or b", "A"), ("The correct candidate is B", "B"), ("Candidate B is the correct one", "B"), ("nothing", "A"), ("", "A"), ('{"choose": "the correct answer is B"} so', "B"),
])
def test_choice(spark, given, want):
    assert of(spark, response.choice, given) == want


def test_tables_of(spark):
    assert of(spark, response.tables_of, "<answer> a, b ,, c</answer>") == ["a", "b", "c"]


@pytest.mark.parametrize("f, given, want", [
    (text.error_kind, "no such column: x", "no such column"), (text.error_kind, "boom", "others"), (text.without_quotes, '`a"b`', "ab"), (text.needs_quotes, "a b", True), (text.needs_quotes, "ab", False), (text.quoted_if_needed, "a-b", "`a-b`"),
    (text.is_number, "1e3", True), (text.is_number, "x", False), (text.artifact_name, " a/b! ", "a-b"), (text.artifact_name, "//", "eval-artifact"), (text.without_space, " a\tb\n", "ab"), (text.has_cjk, "a中", True), (text.has_other_than_cjk, "中", False),
    (text.create_statements, "x CREATE TABLE a\n(b); CREATE VIEW c;", ["CREATE TABLE a\n(b);", "CREATE VIEW c;"]), (text.words_of_sql, " A b  a\nC ", ["a", "b", "c"]), (text.spark_error_kind, "[TABLE_OR_VIEW_NOT_FOUND] x", "no such table"),
])
def test_text(spark, f, given, want):
    assert of(spark, f, given) == want


def test_pruned_ddl(spark):
    ddl = "CREATE TABLE a (\n x INT,\n y INT,\n PRIMARY KEY (x),\n)\nCREATE TABLE `b` (\n z INT,\n)"
    cut = one(spark, text.pruned_ddl(F.col("d"), F.array(F.lit("A")), F.create_map(F.lit("a"), F.array(F.lit("Y")))), d=(ddl, "string"))
    assert "y INT" in cut and "x INT" not in cut and "PRIMARY KEY" in cut and "`b`" not in cut
    assert one(spark, text.pruned_ddl(F.col("d"), F.array(F.lit("none"))), d=(ddl, "string")) == ddl


def test_pruned_ddl_of_a_wide_table(spark):
    """What belongs to a table is worked out once, not for each of its lines."""
    ddl = "CREATE TABLE a (\n" + "".join(f" c{i} INT,\n" for i in range(5000)) + ")"
    began = time.perf_counter()
    cut = one(spark, text.pruned_ddl(F.col("d"), F.array(F.lit("a")), F.create_map(F.lit("a"), F.transform(F.sequence(F.lit(0), F.lit(4999), F.lit(5)), lambda i: F.concat(F.lit("C"), i)))), d=(ddl, "string"))
    assert cut.count("\n") == 1001 and time.perf_counter() - began < 10


def test_prompts(spark):
    full = one(spark, text.prompt(F.lit("q?"), F.lit("Table t(a)"), F.lit(" hint "), "SQLite"))
    assert "q?\nhint\n" in full and full.startswith("Write one SQLite")
    ex = F.array(F.struct(F.lit("q").alias("question"), F.lit("s").alias("sql"), F.lit("e\nf").alias("evidence")))
    assert "#Example Question: e f\nq\n#Answer: `s`" in one(spark, text.examples_section(ex))


def test_clusters(spark):
    df = spark.createDataFrame([(1, 0, [" a ", "b", None, ""]), (1, 1, ["b", "a\n"]), (2, 0, ["a"])], "sample_id long, record_index int, all_sqls array<string>")
    rows = cluster.clusters(cluster.flattened(df)).orderBy("sample_id", "first").collect()
    assert [(r.sample_id, r.sql, r["count"], [tuple(o) for o in r.occurrences]) for r in rows] == [(1, "a", 2, [(0, 0), (1, 1)]), (1, "b", 2, [(0, 1), (1, 0)]), (2, "a", 1, [(0, 0)])]
    assert cluster.clusters(cluster.flattened(df.limit(0))).count() == 0


def test_first_seen(spark):
    df = spark.createDataFrame([("x", 2, "late"), ("x", 1, "soon"), (None, 3, "null")], "k string, pos int, v string")
    assert {(r.k, r.v) for r in cluster.first_seen(df, ["k"], ["pos"]).collect()} == {("x", "soon"), (None, "null")}


@pytest.mark.parametrize("gold, pred, strict, bag, set_", [
    (["1", "2"], ["1", "2"], True, True, True), (["1", "2"], ["2", "1"], False, True, True), (["1", "1"], ["1"], False, False, True), ([], [], True, True, True), (["1"], ["2"], False, False, False), (["1"], None, False, False, False),
])
def test_results_equal(spark, gold, pred, strict, bag, set_):
    got = [one(spark, compare.results_equal(F.col("g"), F.col("p"), m), g=(gold, "array<string>"), p=(pred, "array<string>")) for m in ("strict", "bag", "set")]
    assert got == [strict, bag, set_]
    assert one(spark, compare.results_equal(F.col("g"), F.col("p"), "set", empty_matches=False), g=(gold, "array<string>"), p=(pred, "array<string>")) == (set_ and gold != [])


def test_frames_equal(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(2, "x"), (1, None)], "c int, d string")
    assert compare.bag_equal(a, a).first()["equal"] and not compare.bag_equal(a, b).first()["equal"] and compare.set_equal(a, b).first()["equal"]
    assert not compare.bag_equal(a, b.select("c")).first()["equal"]
    p = spark.createDataFrame([(1, "x"), (2, None)], "p int, v string")
    assert compare.strict_equal(p, p, "p").first()["equal"] and not compare.strict_equal(p, p.filter("p = 1"), "p").first()["equal"]
    assert compare.bag_equal(a.limit(0), a.limit(0)).first()["equal"]


def _pairs(spark, rows, **kw):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "sample_id long, pos int, sql string, distance double, is_correct boolean")
    return {(r.chosen, r.rejected): (r.margin, r.pair_type) for r in pairs.build_pairs(df, **kw).collect()}


def test_pairs(spark):
    got = _pairs(spark, [("c1", 0.4, True), ("c2", 0.6, True), ("w1", 0.1, False), ("w2", 0.8, False)])
    assert len(got) == 5 and got["c1", "w1"] == (0.0, "correct_wrong") and got["c1", "w2"] == (0.4, "correct_wrong") and got["w1", "w2"] == (0.7, "wrong_wrong")
    wrong = _pairs(spark, [("a", 0.2, False), ("b", 0.5, False), ("c", 0.9, False)], min_margin=0.35)
    assert set(wrong) == {("a", "c"), ("b", "c")}
    ties = _pairs(spark, [("c", 0.1, True), ("d", 0.2, True), ("x", 0.5, False), ("y", 0.5, False)])
    assert len(ties) == 4 and ("x", "y") not in ties
    assert _pairs(spark, [("c", 0.2, True), ("n", 0.4, False), ("f", 0.9, False)], max_pairs=1) == {("c", "f"): (0.7, "correct_wrong")}
    assert _pairs(spark, [("same", 0.1, True), ("same", 0.3, False)]) == {} and _pairs(spark, [("c", None, True), ("w", 0.1, None)]) == {}


def test_cascade(spark):
    good = '{"prompt": "p", "chosen": "%s", "rejected": "%s", "margin": %s, "sample_id": 1, "db_id": "d", "pair_type": "%s", "chosen_is_correct": %s, "rejected_is_correct": %s}'
    lines = [
        "{", '["list"]', good % ("a", "b", '"x"', "correct_wrong", "true", "false"), good % ("a", "b", "null", "correct_wrong", "true", "false"), good % ("a", "b", "0.9", "other", "true", "false"), good % ("a", "b", "0.9", "correct_wrong", "null", "false"),
        good % ("a", "b", "0.9", "correct_wrong", "true", "true"), good % ("a", "b", "0", "correct_wrong", "true", "false"), good % ("a", "b", "0.01", "correct_wrong", "true", "false"), good % (";", "b", "0.9", "correct_wrong", "true", "false"),
        good % ("a  b", "a b;", "0.9", "correct_wrong", "true", "false"), good % ("a", "b", "0.5", "correct_wrong", "true", "false"), good % (" a;", "b", "0.9", "correct_wrong", "true", "false"), good % ("a b c d e f", "b", "0.9", "correct_wrong", "true", "false"),
        good % ("a", "b b b b b b", "0.9", "correct_wrong", "true", "false"), good % ("x", "b", "0.7", "correct_wrong", "true", "false"), good % ("y", "b", "0.6", "correct_wrong", "true", "false"), "  ",
    ]
    df = cascade.parsed_lines(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    rules = cascade.Rules(min_margin=0.05, pair_types=cascade.Rules.types("correct_wrong, wrong_wrong,"), require_chosen_correct=True, require_rejected_wrong=True, max_prompt_tokens=3, max_total_tokens=6, max_pairs_per_prompt=2)
    done = cascade.cascade(df, rules)
    got = {r.line: r.reason for r in done.collect()}
    assert [got[i] for i in range(17)] == [
        "invalid_json", "invalid_json", "invalid_margin", "invalid_margin", "pair_type_filtered", "chosen_not_correct", "rejected_not_wrong", "zero_margin", "low_margin", "parse_fail", "same_normalized_sql", "per_prompt_cap", "duplicate_normalized_pair",
        "chosen_too_long", "rejected_too_long", None, None,
    ]
    assert [r.line for r in cascade.kept(done).orderBy("first_line", "place").collect()] == [15, 16]
    s = cascade.summary(done).first()
    assert (s.total_input_pairs, s.total_output_pairs, s.unique_prompts_before, s.unique_prompts_after) == (17, 2, 1, 1)
    assert sum(r.n for r in cascade.reason_counts(done).collect()) + 2 == 17
    assert cascade.summary(done.limit(0)).first().retention_ratio == 0.0


@pytest.mark.parametrize("results, first, second", [
    ("a", "a", "a"), ("aab", "a", "b"), ("ab", "a", "a"), ("baac", "a", "b"), ("bcaa", "a", "c"), ("aabc", "a", "b"), ("aabbc", "a", "a"), ("-aa-b", "a", "b"),
])
def test_votes(spark, results, first, second):
    df = spark.createDataFrame([(1, i, None if r == "-" else r, f"sql{i}") for i, r in enumerate(results)], "question_id long, pos int, result string, sql string")
    r = vote.majority(df).first()
    assert (r.top1.result, r.top2.result) == (first, second)
    assert r.top1.sql == f"sql{results.index(first)}"


def test_votes_without_valid_results(spark):
    df = spark.createDataFrame([(1, 0, None, "s")], "question_id long, pos int, result string, sql string")
    gold = spark.createDataFrame([(1, None)], "question_id long, gold_result string")
    r = vote.judged(vote.majority(df), gold).first()
    assert r.top1 is None and r.n_results == 0 and r.top1_correct == 0 and vote.pass_at_k(df, gold).first().passed == 0


@pytest.mark.parametrize("a, b, want", [([], [], 1.0), (["x"], [], 0.0), (["x"], ["y"], 0.0), (["x", "x", "y"], ["x", "y", "z"], 2 / 3), (["x", "x"], ["x"], 2 / 3), (None, None, 1.0)])
def test_token_f1(spark, a, b, want):
    f = metrics.token_f1(F.col("a"), F.col("b"))
    df = spark.createDataFrame([(1, a, b)], "i int, a array<string>, b array<string>")
    assert metrics.long_token_f1(df, ["i"], "a", "b").first().f1 == pytest.approx(want)
    assert one(spark, f, a=(a, "array<string>"), b=(b, "array<string>")) == pytest.approx(want)


def test_calibration(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1), (0.2, 0), (0.9, 0), (None, 1)], "d double, c int")
    r = metrics.calibration(df, "d", "c").first()
    assert (r.n_samples, r.n_correct, r.n_wrong) == (4, 2, 2) and r.auc_roc == pytest.approx(0.875) and r.spearman_rho == pytest.approx(-0.7071, abs=1e-4) and r.passed
    flat = metrics.calibration(df.filter("c = 1"), "d", "c").first()
    assert flat.spearman_rho == 0 and flat.auc_roc is None
    assert metrics.calibration(df.limit(0), "d", "c").first().n_samples == 0


def test_ranks(spark):
    values = [5.0, 1.0, 1.0, None, 3.0, 3.0, 3.0, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert {(r.v, r.n, r["rank"]) for r in ranking.average_ranks(df, "v", ranges=3).collect()} == {(1.0, 2, 1.5), (3.0, 3, 4.0), (5.0, 1, 6.0), (9.0, 1, 7.0)}
    got = [r.i for r in ranking.numbered(df, "v", "i", ranges=3).orderBy("place").collect()]
    assert got == [1, 2, 4, 5, 6, 0, 7, 3]
    assert ranking.numbered(df.limit(0), "v", "i").count() == 0


def test_linking_metrics(spark):
    df = spark.createDataFrame([(["A", "b "], ["a", "B"]), (["a"], ["a", "a"]), ([], ["x"]), (["q"], [])], "p array<string>, r array<string>")
    rows = metrics.linking_rows(df, "p", "r").collect()
    assert [(r.exact, r.complete, r.precision, r.recall) for r in rows] == [(1, 1, 1.0, 1.0), (1, 0, 1.0, 1.0), (0, 0, 0.0, 0.0), (0, 1, 0.0, 0.0)]
    assert metrics.linking_summary(metrics.linking_rows(df.limit(0), "p", "r")).first().avg_f1 == 0


def test_columns_merge_and_restore(spark):
    seen = spark.createDataFrame([(1, 0, "`T`", "`b`"), (1, 1, "T", "A"), (1, 2, "T", "a"), (1, 3, "other", "z"), (1, 4, "T", "gone")], "question_id long, pos int, table_name string, column_name string")
    selected = spark.createDataFrame([(1, "t")], "question_id long, table_name string")
    merged = linking.merged_columns(seen, selected)
    assert [(r.table_name, r.columns) for r in merged.collect()] == [("T", ["b", "A", "gone"])]
    catalog = spark.createDataFrame([("t", "B", 0), ("t", "a", 1), ("t", "A", 2)], "table_name string, column_name string, ordinal int")
    assert linking.restored_columns(merged, catalog).first().columns == ["B", "A"]


def test_penalty(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    p = lambda t, c: one(spark, linking.penalty(arr(*t), arr(*c), arr("a"), arr("a.x")))
    assert p(["a"], ["a.x", "*.q"]) == 0 and p(["b", "b"], ["a.y"]) == pytest.approx(0.3) and p(list("bcdefg"), []) == 1


def test_profile(spark):
    df = spark.createDataFrame([("ann", "u1", "x" * 30), ("bob", "u2", None), ("ann", "u3", "y" * 30)], "first_name string, user_id string, note string")
    got = {r.column_name: (r.sum_of_lengths, r.count_distinct, r.kept) for r in profile.column_profile(df).collect()}
    assert got == {"first_name": (6, 2, True), "note": (60, 2, False)}
    assert {r.value for r in profile.unique_values(df).collect()} == {"ann", "bob"}
    assert [(r.value, r.total) for r in profile.top_values(df, "note", 2).collect()] == [(None, 1), ("x" * 30, 1)]
    assert profile.different_content(df, "first_name").first()["values"][0] == ("ann", 2)
    assert profile.value_exists(df, "first_name", "NN").first().value == "ann" and profile.value_exists(df, "first_name", "%").first() is None
    assert [r.value for r in profile.column_contents(df, "note").collect()] == []
    assert profile.sample_rows(df, 2, 3, "user_id").collect() == profile.sample_rows(df.orderBy("note"), 2, 3, "user_id").collect()


def test_every_unique_value(spark):
    """Names of more than five million characters in all are not kept by the profile, but are values."""
    df = spark.range(60).select(F.concat(F.repeat(F.lit("x"), 100_000), F.col("id").cast("string")).alias("name"))
    assert profile.unique_values(df).count() == 0 and profile.unique_values(df, every=True).count() == 60


def test_postings_of_values_stay_off_the_driver(spark):
    from plumbline.operators import lookup

    values = spark.createDataFrame([("Ann 7",), ("Bob 77",)], "v string")
    found = lookup.containing(values, "v", spark.createDataFrame([(1, "7"), (2, "77"), (3, "b")], "id long, n string"), "id", "n")
    assert sorted((r.id, r.value, r.matches) for r in found.collect()) == [(1, "Ann 7", 2), (2, "Bob 77", 1), (3, "Bob 77", 1)]
    assert "strategy=merge" in found._jdf.queryExecution().logical().toString()


def test_augmentation(spark):
    rows = [(0, "g1", 5, "g", "g", 0.0), (1, "a1", 1, "a", "g", 0.2), (2, "a2", 3, "a", "g", 0.2), (3, "bb", 2, "b", "g", 0.1), (4, "c", 2, None, "g", 0.1), (5, "d", 0, "d", "g", 0.1), (6, "e", 2, "e", "g", 0.9), (7, "f", None, "f", "g", 0.3)]
    df = spark.createDataFrame([(1, *r) for r in rows], "sample_id long, pos int, sql string, count int, normalized string, gold_normalized string, distance double")
    got = {r.pos: (r.status, r["rank"]) for r in augment.augmentation(df, max_distance=0.5, most=2).collect()}
    assert got == {0: ("skipped_same_as_gold", None), 1: ("deduped_correct_candidates", None), 2: ("augmented", 2), 3: ("augmented", 1), 4: ("skipped_parse_or_distance_error", None), 5: ("skipped_below_min_count", None), 6: ("skipped_over_max_distance", None), 7: ("over_cap", None)}


@pytest.mark.parametrize("n, ratio, want", [(100, 0.05, 5), (10, 0, 0), (1, 0.5, 0), (3, 0.99, 2), (1000, 0.0001, 1), (10, 0.11, 2)])
def test_holdout_size(n, ratio, want):
    assert augment.holdout_size(n, ratio) == want


def test_holdout(spark):
    df = spark.range(100)
    a, b = augment.holdout(df, 0.05, 1, "id"), augment.holdout(df.repartition(7), 0.05, 1, "id")
    held = {r.id for r in a.filter("held_out").collect()}
    assert len(held) == 5 and held == {r.id for r in b.filter("held_out").collect()} and a.count() == 100
    assert augment.holdout(df, 0, 1, "id").filter("held_out").count() == 0
    with pytest.raises(ValueError):
        augment.holdout(df, 1, 1, "id")


def test_schema_text(spark):
    column = lambda n, pk, note, values: F.struct(F.lit(n).alias("name"), F.lit("text").alias("type"), F.lit(pk).alias("is_pk"), F.lit(note).alias("comment"), (F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")).alias("contents"))
    tables = F.array(F.struct(F.lit("a b").alias("name"), F.array(column("x", True, "", []), column("y", False, "why", ["1", "2"])).alias("columns")))
    keys = F.array(F.struct(F.lit("a b").alias("from_table"), F.lit("x").alias("from_column"), F.lit("c").alias("to_table"), F.lit("z").alias("to_column")))
    assert one(spark, text.schema_sequence(tables, keys)) == "database schema :\ntable `a b` , columns = [ `a b`.x ( text | primary key ) , `a b`.y ( text | comment : why | values : 1 , 2 ) ]\nforeign keys :\n`a b`.x = c.z"
    found = F.array(F.struct(F.lit("t").alias("table_name"), F.lit("c d").alias("column_name"), F.array(F.lit("v")).alias("contents")))
    assert one(spark, text.matched_sequence(found)) == "matched contents :\nt.`c d` ( v )" and one(spark, text.matched_sequence(F.filter(found, lambda x: F.lit(False)))) == "matched contents : None"


def test_votes_can_be_held(spark):
    for sqls, want in ((["select 1 from t", "SELECT 2 from t"], True), (["select 1 from t"], False), (["select 1 from t", None], False), (["select 1", "select 1 from t"], False), (["with x as y", "select 1 from t"], False)):
        assert one(spark, vote.valid_candidates(F.col("s")), s=(sqls, "array<string>")) is want


def test_top2_for_prompt(spark):
    df = spark.createDataFrame([(1, i, r, f"s{r}") for i, r in enumerate("aab")], "question_id long, pos int, result string, sql string")
    results = spark.createDataFrame([(1, "sa", "[1]"), (1, "sa", "[1]")], "question_id long, sql string, shown string")
    r = vote.top2_for_prompt(vote.majority(df), results).first()
    assert (r.sql1, r.sql2, r.shown1, r.shown2) == ("sa", "sb", "[1]", "[1]")
    judged = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "place long, ok int")
    assert [x.tp_id for x in vote.true_positives(judged, "place", "ok").collect()] == [1, 3]


def test_search(spark):
    texts = spark.createDataFrame([(1, "Red fox"), (2, "red red wine"), (3, "blue sea"), (4, None), (5, "")], "id long, t string")
    asked = spark.createDataFrame([(1, "RED"), (2, "none"), (3, None), (4, "sea, red")], "q long, t string")
    got = [(r.q, r["rank"], r.id) for r in search.search(search.postings(texts, "id", "t"), asked, "q", "t").orderBy("q", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 1), (4, 1, 3), (4, 2, 2), (4, 3, 1)]
    assert one(spark, search.grams(F.lit("a b c"), 2)) == ["a b c", "a b", "b c", "a", "b", "c"]


def test_losses(spark):
    f = losses.margin_loss(*[F.col(c) for c in "abcdm"], beta=1.0, alpha=1.0)
    values = lambda z, m: {"a": (z, "double"), "b": (0.0, "double"), "c": (0.0, "double"), "d": (0.0, "double"), "m": (m, "double")}
    assert one(spark, f, **values(0.0, 0.0)) == pytest.approx(0.693147, abs=1e-6) and one(spark, f, **values(-1000.0, None)) == 1000 and one(spark, f, **values(2.0, 1.0)) == pytest.approx(0.048587, abs=1e-6)


def test_p_values():
    """Student's t: published two-sided values of correlations."""
    from plumbline.operators.metrics import correlation_p

    for rho, n, want in ((0.0, 10, 1.0), (0.6320, 10, 0.05), (0.7646, 10, 0.01), (0.1966, 100, 0.05), (-0.2565, 100, 0.01), (0.9969, 3, 0.05), (0.062, 1000, 0.05)):
        assert abs(correlation_p(rho, n) - want) < 0.002
    assert correlation_p(0.5, 2) is None and correlation_p(1.0, 9) == 0.0


def test_a_missing_join_costs_its_weight(spark):
    from pyspark.sql import functions as F

    from plumbline.operators.metrics import WEIGHTS, component_f1

    parts = lambda **k: F.struct(*[F.array(*map(F.lit, k.get(n, []))).cast("array<string>").alias(n) for n in WEIGHTS])
    whole = {"select": ["a"], "where": ["b"], "join": ["c"], "groupby": ["d"], "orderby": ["e"], "having": ["f"], "limit": ["g"]}
    for name, weight in (("select", 2), ("where", 2), ("join", 2), ("groupby", 1), ("orderby", 1), ("having", 1), ("limit", 0.5)):
        pred = parts(**{k: v for k, v in whole.items() if k != name})
        assert spark.range(1).select(component_f1(pred, parts(**whole)).alias("d")).first().d == pytest.approx(weight / 9.5)


def test_failed_lines_are_spread_and_quantiles_count_values(spark):
    from plumbline.operators import cascade, metrics

    lines = spark.createDataFrame([(i, "{broken" if i % 2 else '{"prompt": "p", "chosen": "a b", "rejected": "c", "margin": 0.5}') for i in range(40)], "line long, value string")
    got = {r.reason: r["count"] for r in cascade.cascade(cascade.parsed_lines(lines), cascade.Rules(max_pairs_per_prompt=1)).groupBy("reason").count().collect()}
    assert got == {"invalid_json": 20, "duplicate_normalized_pair": 19, None: 1}
    values = [0.0] * 900 + [float(i) for i in range(100)]
    r = metrics.lower_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    values.sort()
    assert (r["count"], r.min, r.max) == (1000, 0.0, 99.0) and [r.p25, r.median, r.p75, r.p90] == [values[int(999 * s)] for s in (0.25, 0.5, 0.75, 0.9)]
    assert metrics.lower_quantiles(spark.createDataFrame([], "v double"), "v").first()["count"] == 0


@pytest.mark.parametrize("k, least", [(1, 0.0), (3, 0.2), (8, 0.0)])
def test_top_pairs_are_the_first_of_all_pairs(spark, k, least):
    """Ties, texts of several distances and verdicts, null keys and positions, margins that round alike."""
    rng = random.Random(k)
    distances = [0.5, 0.25, 0.25004, 0.25005, float("nan"), None, *(round(rng.random(), 3) for _ in range(9))]
    rows = [(s or None, p if p % 6 else None, rng.choice("abcdefghij") if s % 2 else f"q{p}", rng.choice(distances), rng.random() < 0.3) for s in range(16) for p in range(rng.randrange(1, 22))]
    scored = spark.createDataFrame(rows, "sample_id long, pos long, sql string, distance double, is_correct boolean")
    texts = {}
    for s, p, sql, d, ok in rows:
        if s is not None and d is not None and d == d:
            texts.setdefault(s, []).append((d, not ok, p is not None, p or 0, sql))
    want = []
    for s, all_ in texts.items():
        best = {}
        for a in all_:
            for b in all_:
                if b[1] and a[4] != b[4] and (not a[1] or (b[0] - a[0] > 0 and b[0] - a[0] >= least)):
                    best[a[4], b[4]] = min(best.get((a[4], b[4]), (True, (9,), (9,))), (a[1], a, b))
        margin = lambda x: float(decimal.Decimal(repr(max(x[2][0] - x[1][0], 0.0))).quantize(decimal.Decimal("0.0001"), decimal.ROUND_HALF_UP))
        ordered = sorted(best.items(), key=lambda x: (-margin(x[1]), x[1][0], x[1][1][:4], x[1][2][:4]))
        want += [(s, *key, margin(x)) for key, x in ordered[:k]]
    got = pairs.build_pairs(scored, min_margin=least, max_pairs=k).select("sample_id", "chosen", "rejected", "margin").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_top_pairs_of_one_large_sample(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit(1).alias("sample_id"), F.col("id").alias("pos"), F.concat(F.lit("q"), F.col("id")).alias("sql"), ((F.col("id") * 7919 % 100_003) / 100_003).alias("distance"), (F.col("id") % 3 == 0).alias("is_correct"))
    top = pairs.build_pairs(rows, max_pairs=4)
    assert [(r.chosen, r.margin) for r in top.collect()] == [("q0", 1.0)] * 4
    listed = rows.filter("not is_correct and distance >= 0.99995").orderBy("distance", "pos").limit(4).collect()
    assert {r.rejected for r in top.collect()} == {r.sql for r in listed}


@pytest.mark.parametrize("left, right, same", [  # strict, bag, set
    ("1", "1.0", (True, False, True)), ("1152921504606846976", "1152921504606846976.0", (True, False, True)), ("9007199254740993", "9007199254740992.0", (False, False, False)), ("9e18", "9000000000000000000", (True, False, True)), ("'1'", "1", (False, False, False)),
    ("x'6162'", "'6162'", (True, True, False)), ("x'6162'", "x'6162'", (True, True, True)), ("x'6162'", "'ab'", (False, False, False)), ("null", "''", (False, False, False)), ("null", "null", (True, True, True)), ("0.0", "-0.0", (True, False, True)), ("1e400", "1e400", (True, True, True)), ("0.1 + 0.2", "0.3", (False, False, False)),
    ("1 union all select 2", "2 union all select 1", (False, True, True)), ("1 union all select 1", "1", (False, False, True)), ("1, 2", "1", (False, False, False)),
])
def test_equality_of_sqlite_results(left, right, same):
    db = sqlite3.connect(":memory:")
    a, b = (execute.run_sqlite(db, f"select {x}") for x in (left, right))
    assert a[0] == b[0] == "success" and tuple(x == y for x, y in zip(a[4:], b[4:], strict=True)) == same


def test_members_are_the_occurrences(spark):
    rows = [(1, "a", 0), (1, "a", 2), (1, "b", 1), (2, "a", 5), (None, "a", 7), (None, "a", 6), (None, None, 8)]
    df = spark.createDataFrame(rows, "sample_id long, sql string, pos long")
    got = {(r.sample_id, r.sql, r.pos): (r["count"], r["first"].pos) for r in cluster.members(df, places=["pos"]).collect()}
    listed = cluster.clusters(df, places=["pos"]).collect()
    assert got == {(r.sample_id, r.sql, o.pos): (r["count"], r["first"].pos) for r in listed for o in r.occurrences} and len(got) == len(rows)


def test_lengths_in_tokens(spark):
    tokens, tokenizer = pytest.importorskip("plumbline.functions.tokens"), pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    texts = ["Hello world", "", None, "naïve café <|startoftext|>", "x" * 500]
    plain = tokenizer.Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    count = tokens.counter(path)
    assert [r.n for r in df.select("i", count(F.col("t")).alias("n")).orderBy("i").collect()] == [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    line = '{"prompt": "a b c", "chosen": "select 1", "rejected": "select 2 from a long list of words", "margin": 1}'
    lines = cascade.parsed_lines(spark.createDataFrame([(1, line)], "line long, value string"))
    most = len(plain.encode("a b c select 1", add_special_tokens=False).ids)
    assert cascade.cascade(lines, cascade.Rules(max_total_tokens=most, tokens=count)).first().reason == "rejected_too_long"
