"""Near duplicates of the pipeline against brute force over all pairs."""

import random

import pytest

from plumbline.llm import jaccard
from plumbline.llm.components import Forest

SF = "/root/testdata/sf0.001"


def _set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _kept(rows):
    sets, forest = {d: _set(t) for d, t in rows}, Forest()
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                forest.join(a, b)
    return {d: forest.find(d) for d in sets}


def _invented():
    rng = random.Random(8)
    line = "all rights reserved by the owner of this page and by nobody else in the world at all"
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.choice((3, 5, 9, 60, 200)))) for _ in range(40)]
    texts += [f"{t} {line}" for t in texts[:30]] + [t.upper() for t in texts[:5]]
    for base in texts[3:9] + [" ".join(word() for _ in range(120))] * 40:  # one large group of edited copies
        w = base.split()
        for _ in range(rng.choice((1, 2, 6))):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for n in range(1, 30):  # sizes that differ about as much as is allowed
        w = texts[39].split()
        texts.append(" ".join(w[: max(1, len(w) - 2 * n)]))
    return list(enumerate([*texts, "", None, " \t"]))


@pytest.mark.parametrize("block", [7, 4096])
def test_all_pairs_of_the_similarity(spark, block):
    rows = _invented()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == _kept(rows)


def test_the_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = _kept([(r.doc_id, r.text) for r in docs.collect()])
    kept = c.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert c.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_long_sets(spark):
    """Sets of which a sample is in the bitmap, on both sides of a sampling step, and long texts that share a passage only."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(100000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for n in (505, 520, 1030, 1500, 4000):
        base = [word() for _ in range(n)]
        for edits in (0, 3, n // 60, n // 40, n // 20):
            w = base[:]
            for at in rng.sample(range(n), edits):
                w[at] = word()
            texts.append(" ".join(w + ([word()] * rng.randrange(12))))
        texts.append(" ".join([*passage, *(word() for _ in range(n)), *passage]))
    rows = list(enumerate(texts))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = _kept(rows)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < len(texts)
