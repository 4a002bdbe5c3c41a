"""Suffix arrays over ids of any type and over rows that repeat."""

import random

from pyspark.sql import functions as F

from plumbline.llm import suffix


def test_ids_of_other_types_give_what_numbers_give(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(60)) for _ in range(4)]
    rows = [(i, f"u{i} {rng.choice(pool)} v{i} {rng.choice(pool)} end") for i in range(40)] + [(40, None), (41, ""), (None, pool[0]), (None, pool[0]), (3, pool[1])]
    name = lambda i: None if i is None else f"k{i:03d}"  # noqa: E731  in the numbers' order
    numbers = spark.createDataFrame(rows, "doc_id long, text string")
    texts = spark.createDataFrame([(name(i), t) for i, t in rows], "doc_id string, text string")
    days = numbers.select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")).alias("doc_id"), "text")
    shown = lambda df: sorted(repr((r.doc_id, r.start_word, r.end_word, r.first, r.first_doc_id)) for r in df.collect())
    want = [(name(r.doc_id), r.start_word, r.end_word, r.first, name(r.first_doc_id)) for r in suffix.repeated_passages(numbers).collect()]
    assert want and shown(suffix.repeated_passages(texts)) == sorted(map(repr, want))
    assert suffix.repeated_passages(days).count() == len(want)
    left = sorted(repr((name(r.doc_id), r.text)) for r in suffix.without_repeats(numbers).collect())
    assert sorted(repr(tuple(r)) for r in suffix.without_repeats(texts).collect()) == left
    assert suffix.repeated_passages(texts.limit(0)).collect() == [] and suffix.without_repeats(texts.limit(0)).collect() == []


def test_many_rows_of_one_id_and_text(spark):
    """A hundred thousand equal rows are one document: they repeat nothing, and another document that shares their passage does."""
    passage = " ".join(f"w{i}" for i in range(60))
    equal = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(passage).alias("text"))
    assert suffix.repeated_passages(equal).count() == 0
    found = suffix.repeated_passages(equal.unionAll(spark.createDataFrame([(9, f"a {passage} b")], "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.first) for r in found) == [(7, 0, 60, True), (9, 1, 61, False)]
    assert suffix.without_repeats(equal).count() == 100_000
