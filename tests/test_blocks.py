"""Files read in blocks of any size against Python's own reading."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.sources import blocks, readers


@pytest.fixture(params=[("40", 100_000), ("40", 0), ("700", 100_000), ("128m", 100_000)], ids=str)
def block_size(request, spark, monkeypatch):
    size, most = request.param
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    monkeypatch.setattr(blocks, "BLOCKS", most)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    r = rng.random()
    if r < 0.4:
        return rng.choice([rng.randrange(1000), None, True, 1.5, "".join(rng.choice('ab,"[]{}\\\n é') for _ in range(rng.randrange(12)))])
    if depth > 2:
        return "," * rng.randrange(3)
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))] if r < 0.7 else {f'k,{i}"': value(rng, depth + 1) for i in range(rng.randrange(4))}


def test_elements_of_arrays(spark, tmp_path, block_size):
    rng = random.Random(1)
    files = {f"{i}.json": [value(rng) for _ in range(n)] for i, n in enumerate((0, 1, 25, 60, 3))}
    for i, (name, a) in enumerate(files.items()):
        (tmp_path / name).write_text(json.dumps(a, indent=[None, 2, None, 1, None][i], ensure_ascii=bool(i % 2)), encoding="utf-8")
    got = {}
    for r in blocks.json_elements(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], {})[r.place] = json.loads(r.value)
    assert {n: [x[k] for k in sorted(x)] for n, x in got.items()} == {n: a for n, a in files.items() if a}
    assert all(sorted(x) == list(range(len(x))) for x in got.values())


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}', '["a, b]', "[1, 2"])
def test_arrays_that_do_not_end(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="JSON ends inside"):
        blocks.json_elements(spark, str(tmp_path)).collect()


def test_an_array_that_is_blank(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ \n ] ")
    (tmp_path / "b.json").write_text("")
    assert blocks.json_elements(spark, str(tmp_path)).collect() == []
    assert readers.items(spark, str(tmp_path)).columns[0] == "sample_id"


def test_line_numbers(spark, tmp_path, block_size):
    rng = random.Random(2)
    files = {f"{i}.txt": ["" if rng.random() < 0.3 else "é" * rng.randrange(60) + str(j) for j in range(n)] for i, n in enumerate((1, 40, 7))}
    for i, (name, lines) in enumerate(files.items()):
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (i % 2), encoding="utf-8")
    got = {(r.file.rsplit("/", 1)[-1], r.line_number): r.value for r in blocks.numbered_lines(spark, str(tmp_path)).collect()}
    want = {}
    for name in files:
        with open(tmp_path / name, encoding="utf-8") as f:
            want |= {(name, i): line.rstrip("\n") for i, line in enumerate(f, 1)}
    assert got == want


def test_the_first_bad_line_is_named(spark, tmp_path, block_size):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert sorted(r.a for r in blocks.strict_lines(spark, str(tmp_path), "a int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n' + '{"a": 2}\n' * 30 + "{broken\n{worse\n")
    with pytest.raises(ValueError, match=r"b\.jsonl:33: \{broken"):
        blocks.strict_lines(spark, str(tmp_path), "a int")
    assert sorted(r.line_number for r in blocks.bad_lines(spark, str(tmp_path)).collect()) == [33, 34]
    assert {(r.line_number, r.value) for r in readers.tolerant_lines(spark, str(tmp_path / "a.jsonl")).collect()} == {(1, '{"a": 1}'), (2, ""), (3, "  "), (4, '{"a": 2}')}


def test_files_of_metadata_grow_in_number(spark, monkeypatch):
    """More orders are more files, each of which one task writes."""
    from plumbline import catalogue_deep as deep

    paths = []
    monkeypatch.setattr(deep, "ORDERS", 100, raising=False)
    monkeypatch.setattr(deep.readers, "metadata", lambda s, path: paths.append(path) or s.createDataFrame([], deep.readers.METADATA))
    deep.metadata_read(spark, "/root/testdata/sf0.001")
    assert spark.read.text(paths[0]).select("part").distinct().count() > 8


def test_places_go_on_through_files(spark, tmp_path, block_size):
    """An array, or lines, that lie in several files are counted through them, whatever the files' last elements are."""
    rng = random.Random(3)
    parts = [[], ["a"], [1, "]", [2, []]], [], [[], {}], [value(rng) for _ in range(30)], ["x,", "[", [[]]]]
    for i, a in enumerate(parts):
        (tmp_path / f"k=1/part={i}").mkdir(parents=True)
        (tmp_path / f"k=1/part={i}/a.json").write_text(json.dumps(a, indent=i % 3 or None) + "\n" * (i % 2))
    (tmp_path / "k=2/part=0").mkdir(parents=True)
    (tmp_path / "k=2/part=1").mkdir()
    (tmp_path / "k=2/part=0/b.json").write_text("[7,\n8, ]")
    (tmp_path / "k=2/part=1/c.json").write_text("[9]")
    key = F.regexp_extract("file", "k=([^/]*)/", 1)
    got = {"1": {}, "2": {}}
    rows = blocks.json_elements(spark, str(tmp_path), key).select(key.alias("k"), "place", "value").collect()
    for r in rows:
        got[r.k][r.place] = json.loads(r.value)
    assert len(rows) == sum(len(x) for x in got.values())
    assert [got["1"][i] for i in range(len(got["1"]))] == [x for a in parts for x in a] and got["2"] == {0: 7, 1: 8, 2: 9}
    lines = {(r.k, r.line_number): r.value for r in blocks.numbered_lines(spark, str(tmp_path), key).select(key.alias("k"), "line_number", "value").collect()}
    want = "".join(f if f.endswith("\n") else f + "\n" for f in ((tmp_path / f"k=1/part={i}/a.json").read_text() for i in range(len(parts)))).split("\n")[:-1]
    assert [lines["1", i] for i in range(1, len(want) + 1)] == want and lines["2", 3] == "[9]"


@pytest.mark.parametrize("name", ["json_array_elements", "line_numbers", "bad_line_numbers"])
def test_files_of_events_grow_in_number(spark, monkeypatch, name):
    """More events of a type are more files, each of which one task writes; places are those of the type."""
    from plumbline import catalogue_deep as deep

    paths, written, sf = [], deep._event_files, "/root/testdata/sf0.001"
    monkeypatch.setattr(deep, "LINES", 100, raising=False)
    monkeypatch.setattr(deep, "_event_files", lambda *a, **k: paths.append(written(*a, **k)) or paths[-1])
    got = getattr(deep, name)(spark, sf).collect()
    assert spark.read.text(paths[0]).filter("event_type = 'click'").select(F.input_file_name()).distinct().count() > 5
    w = Window.partitionBy("event_type").orderBy("event_id")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("n", F.row_number().over(w))
    if name == "bad_line_numbers":
        want = events.filter("event_id % 7 = 0").groupBy("event_type").agg(F.min("n"), F.count("*"))
    else:
        want = events.select("event_id", "event_type", F.col("n") - 1, "props", "value") if name == "json_array_elements" else events.select("event_id", "event_type", "n")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_blocks_are_scanned_once(spark, tmp_path, monkeypatch):
    """What is summed for blocks is kept: counting them and sending them scans no text again."""
    scans = spark.sparkContext.accumulator(0)
    summed = blocks._summed

    def counted(batches):
        scans.add(1)
        return summed(batches)

    monkeypatch.setattr(blocks, "_summed", counted)
    (tmp_path / "a.json").write_text("[1, 2, 3]")
    assert blocks.json_elements(spark, str(tmp_path)).count() == 3
    assert scans.value == 1
