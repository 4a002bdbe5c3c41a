"""Sketches, look-ups and digests against plain counting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare, lookup, profile, sketch


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize("n, counters, skewed", [(1, 5, True), (5, 8, True), (5, 50, False), (200, 8, True), (0, 8, True)])
def test_frequent_values_are_those_of_all_values(spark, n, counters, skewed):
    rng = random.Random(n)
    values = [None if (x := rng.random()) < 0.1 else f"w{int(rng.paretovariate(0.8)) if skewed else rng.randrange(300)}" for _ in range(4000)]
    got = [tuple(r) for r in sketch.top_values(frame(spark, values).repartition(7), "v", n, counters).collect()]
    assert got == [tuple(r) for r in profile.top_values(frame(spark, values), "v", n).collect()]


def test_candidates_bound_what_is_lost(spark):
    rng = random.Random(5)
    values = [int(rng.paretovariate(0.7)) for _ in range(5000)]
    found, lost, _ = sketch.heavy_candidates(frame(spark, values, "long").repartition(4), "v", 10)
    counts, least = Counter(values), {r.value: r.least for r in found.collect()}
    assert lost > 0 and all(least[v] <= counts[v] <= least[v] + lost for v in least) and all(counts[v] <= lost for v in counts if v not in least)
    # a value of a third of all rows is proven, so that all values are not counted
    hot = frame(spark, [*values, *[-1] * 2500, *[-2] * 2400], "long")
    found, lost, _ = sketch.heavy_candidates(hot, "v", 200)
    assert {r.value for r in found.filter(F.col("least") > lost).collect()} >= {-1, -2}
    assert [r.value for r in sketch.top_values(hot, "v", 2, 200).collect()] == [r.value for r in profile.top_values(hot, "v", 2).collect()]


def test_ties_at_the_border_and_empty_tables(spark):
    values = ["a"] * 5 + ["b"] * 5 + ["c"] * 5 + [f"x{i}" for i in range(40)]
    assert [tuple(r) for r in sketch.top_values(frame(spark, values), "v", 2, 6).collect()] == [("a", 5), ("b", 5)]
    assert [tuple(r) for r in sketch.top_values(frame(spark, values), "v", 4, 6).collect()] == [("a", 5), ("b", 5), ("c", 5), ("x0", 1)]
    assert sketch.top_values(frame(spark, []), "v", 3).collect() == []
    assert [tuple(r) for r in sketch.top_values(frame(spark, values), "v", 2, 6, candidates=0).collect()] == [("a", 5), ("b", 5)]


def test_least_hashes_of_all_columns(spark):
    import hashlib

    rows = [(f"n{i % 90}", str(i % 5) if i % 3 else None, None, f"  padded {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "name string, few string, none string, note string")
    md5 = lambda v: hashlib.md5(v.encode()).hexdigest()
    want = {(c, md5(v), v) for j, c in enumerate(df.columns) for v in sorted({r[j] for r in rows if r[j] is not None}, key=md5)[:7]}
    assert {tuple(r) for r in sketch.bottom_k(df.repartition(5), df.columns, 7).collect()} == want
    parts = [sketch.bottom_k(df.filter(F.expr(f"hash(name) % 3 {op} 0")), df.columns, 7) for op in ("=", "<>")]
    assert {tuple(r) for r in sketch.merged(parts[0].unionAll(parts[1]), 7).collect()} == want
    told = {r.column_name: r.distinct for r in sketch.distinct_estimate(sketch.bottom_k(df, df.columns, 64), 64).collect()}
    assert told["few"] == 5 and 60 < told["name"] < 140 and 350 < told["note"] < 1000 and "none" not in told
    contents = {r.column_name: r.contents for r in sketch.sampled_contents(df, k=3).collect()}
    assert contents["name"] == sorted({r[0] for r in rows}, key=md5)[:3] and all(v == v.strip() for v in contents["note"]) and sketch.sampled_contents(df, []).collect() == []


def test_many_needles_by_their_rarest_run(spark):
    rng = random.Random(6)
    values = ["".join(rng.choice("abAB%_é 1") for _ in range(rng.randrange(9))) for _ in range(300)] + [None, "", "straße"]
    needles = [(i, "".join(rng.choice("abAB%_é 1") for _ in range(rng.randrange(6)))) for i in range(200)] + [(200, None), (None, "a"), (201, "zzz"), (202, "STRASSE"), (5, "a")]
    low = {v: v.lower() for v in values if v is not None}
    want = sorted((repr(i), min(hits), len(hits)) for i, x in needles if x is not None and (hits := [v for v, w in low.items() if x.lower() in w]))
    got = lookup.containing(frame(spark, values), "v", spark.createDataFrame(needles, "i long, x string"), "i", "x")
    assert sorted((repr(r.i), r.value, r.matches) for r in got.collect()) == want
    one = {x: profile.value_exists(frame(spark, values), "v", x).collect() for x in ("ab", "", "zzz")}
    assert [len(v) for v in one.values()] == [1, 1, 0]
    assert lookup.containing(frame(spark, []), "v", spark.createDataFrame(needles, "i long, x string"), "i", "x").collect() == []


BAG = [(1, None, 0.0, ["a", None]), (None, 1, -0.0, None), (1, None, 0.0, ["a", None]), (2, 2, float("nan"), [])]


@pytest.mark.parametrize("other, same", [
    (BAG[::-1], True), ([(None, 1, 0.0, None), *BAG[:1], *BAG[2:]], True), (BAG[:3], False), ([*BAG[1:], (None, 1, 0.0, ["a", None])], False), ([(1, None, 0.0, [None, "a"]), *BAG[1:]], False), ([(None, 1, 0.0, ["a", None]), *BAG[1:]], False), ([*BAG, BAG[0]], False), ([], False),
])
def test_digests_tell_bags_apart(spark, other, same):
    a = spark.createDataFrame(BAG, "a int, b int, c double, d array<string>")
    b = spark.createDataFrame(other, "p long, q long, r double, s array<string>")  # names and widths differ, positions don't
    assert compare.bag_equal_by_digest(a, b).first() == compare.bag_equal(a, b).first() and compare.bag_equal_by_digest(a, b).first().equal == same
    assert not compare.bag_equal_by_digest(a, b.drop("s")).first().equal
