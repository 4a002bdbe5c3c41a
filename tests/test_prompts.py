"""Prompts from their parts, and samples that are kept."""

import os
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import prompts, sketch
from plumbline.sources import cache


def test_a_prompt_from_its_parts(spark):
    t = spark.createDataFrame([(1, " red ", "x" * 40), (2, "blue", ""), (3, "red", None), (4, "  ", None)], "id long, color string, note string")
    u = spark.createDataFrame([(None,)], "odd string")
    tables = prompts.database_tables({"my t": t, "u": u}, 6, {"my t": ["id"]}, {("u", "odd"): "rarely"})
    asked = spark.createDataFrame([(1, "How many?", "hint"), (2, "Which?", " "), (3, "Who?", None)], "q long, text string, note string")
    hits = spark.createDataFrame([(1, 10, 0.5), (1, 11, 2.0), (1, 12, 2.0), (1, 13, 2.0), (2, 99, 1.0)], "q long, id long, score double")
    values = spark.createDataFrame([(10, "u", "odd", "late"), (11, "u", "odd", "a"), (12, "u", "odd", "a"), (13, "my t", "color", "red")], "id long, table_name string, column_name string, value string")
    made = prompts.assembled(asked.join(prompts.found_contents(hits, "q", values, 2), "q", "left"), "text", tables, "note", matches="matches").collect()
    colors = [r.value for r in sketch.bottom_k(spark.createDataFrame([("red",), ("blue",)], "c string"), ["c"], 6).orderBy("hash").collect()]
    schema = f"database schema :\ntable `my t` , columns = [ `my t`.id ( BIGINT | primary key ) , `my t`.color ( STRING | values : {' , '.join(colors)} ) , `my t`.note ( STRING ) ]\ntable u , columns = [ u.odd ( STRING | comment : rarely ) ]\nforeign keys : None\n"
    text = {r.q: r.prompt for r in made}
    assert f"Schema:\n{schema}matched contents :\n`my t`.color ( red )\nu.odd ( a )\n\nQuestion:\nhint\nHow many?\n" in text[1]
    assert f"{schema}matched contents : None\n\nQuestion:\nWhich?\n" in text[2] and "Question:\nWho?\n" in text[3]
    plain = prompts.assembled(asked, "text", tables).collect()
    assert all("matched contents : None" in r.prompt for r in plain)


def test_only_changed_files_are_read(spark, tmp_path):
    folder, kept = tmp_path / "in", f"file://{tmp_path}/kept"
    folder.mkdir()
    kind = "a string, b string, c int"
    write = lambda name, rows: (folder / name).write_text("\n" + "".join(f'{{"a": "{a}", "b": "{b}", "c": 1}}\n' for a, b in rows))
    rows = {f"{i}.json": [(f"x{j}", str(j % 3 + 10 * i)) for j in range(i * 20, i * 20 + 30)] for i in range(3)} | {"empty.json": []}
    for name, r in rows.items():
        write(name, r)

    def check(read):
        assert cache.refresh(spark, str(folder), kept, kind, k=5) == read
        now = spark.createDataFrame([x for r in rows.values() for x in r], "a string, b string")
        assert sorted(map(tuple, cache.samples(spark, str(folder), kept, 5).collect())) == sorted(map(tuple, sketch.bottom_k(now, ["a", "b"], 5).collect()))

    check(4)
    check(0)
    rows["1.json"] = [("new", "q")]
    write("1.json", rows["1.json"])
    rows["3.json"] = [("y", "z")]
    write("3.json", rows["3.json"])
    check(2)
    os.utime(folder / "0.json", (time.time() + 60, time.time() + 60))  # another time, the same text
    check(1)
    (folder / "2.json").unlink()
    del rows["2.json"]
    check(0)


def test_a_cache_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert cache.refresh(spark, str(tmp_path / "in"), f"file://{tmp_path}/kept", "a string") == 0
    assert cache.samples(spark, str(tmp_path / "in"), f"file://{tmp_path}/kept").collect() == []
    assert prompts.question_text(F.lit("q"), None) is not None


def test_a_split_is_kept_until_a_file_changes(spark, tmp_path):
    folder, kept = tmp_path / "in", f"file://{tmp_path}/kept"
    folder.mkdir()
    line = lambda i: f'{{"prompt": "p{i} \\n", "chosen": " a ", "rejected": "b\\t", "margin": {i}}}\n'
    (folder / "a.jsonl").write_text("".join(map(line, range(20))) + "\n  \n")
    train, held = cache.kept_split(spark, str(folder), kept, 0.2)
    assert (train.count(), held.count()) == (16, 4) and {(r.chosen, r.rejected) for r in train.collect()} == {("a", "b")} and all(r.prompt == f"p{int(r.margin)}\n" for r in train.collect())
    was = sorted(r.prompt for r in held.collect())
    made = sorted(os.listdir(tmp_path / "kept"))
    assert sorted(r.prompt for r in cache.kept_split(spark, str(folder), kept, 0.2)[1].collect()) == was and sorted(os.listdir(tmp_path / "kept")) == made
    assert cache.kept_split(spark, str(folder), kept, 0.5)[1].count() == 10
    (folder / "a.jsonl").write_text("".join(map(line, range(30))))
    assert [x.count() for x in cache.kept_split(spark, str(folder), kept, 0.2)] == [24, 6]
    (folder / "b.jsonl").write_text(line(1) + "{broken\n")
    with pytest.raises(ValueError, match=r"b\.jsonl:2"):
        cache.kept_split(spark, str(folder), kept, 0.2)
