"""Token alignment, vector codes and FM-indexes against plain computations."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import alignment, codes, fmindex

A, B, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
NAMES = "a.b c`d id row rid kind pairs times groups key seq least start windows label2 v code n_a n_words window_row window_list kept".split()


def wide(df):
    return df.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(NAMES)])


# ---- alignment

def plain_alignment(texts):
    """Token by token, by the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte_of, counts, found = alignment._byte_of(), Counter(), []
    for text in texts:
        if not text:
            found.append(None)
            continue
        ids = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        said = [bytes(byte_of[c] for c in one.id_to_token(i)) for i in ids[0]], [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(s) != (" " + text).encode() for s in said):
            found.append(None)
            continue
        spans = []
        for side in said:
            at, out = 0, []
            for x in side:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(ids[0][i], ids[1][j]) for i, (s, e) in enumerate(spans[0]) for j, (t, u) in enumerate(spans[1]) if s < u and t < e]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids[k], spans[k], strict=True) if before < e <= end) for k in (0, 1)))
            before = end
        found.append((len(ids[0]), len(ids[1]), len(ends), links, ";".join(groups)))
        counts.update(set(links))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "", "") if x is None else (*x[:3], len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(x[4].encode()).hexdigest(), x[4]) for x in found]


TEXTS = [None, "", " ", "a", "Hello world, hello  there\n\n x", "naïve café — déjà vu 12345", "日本語のテキスト 🙂🙂", "\t\ttabs\x00nul", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁under ▁▁ lines", "é   　", "hello world, hello", "hello world, hello", "x" * 300, " " * 200, "\r\n \r\n"]


@pytest.mark.parametrize("head", [1 << 20, 30, 0])
def test_alignment_token_by_token(spark, head):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["the", "Cat", "sat,", "über", "naïve", "2024", "don't", "foo_bar()", "…"]) for _ in range(rng.randrange(60))) for _ in range(20)]
    rows = [(i % 30 if i % 7 else None, t) for i, t in enumerate(texts)]  # repeated and null ids
    docs = wide(spark.createDataFrame(rows, "doc_id long, text string"))
    got = alignment.align(docs, A, B, PATTERN, with_groups=True, head=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    want = [(i, *x) for (i, _), x in zip(rows, plain_alignment(texts), strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert alignment.align(docs.limit(0), A, B, PATTERN).collect() == []


def test_a_tokenizer_of_another_kind_is_encoded_by_its_own_library():
    data = open(A, "rb").read()
    own, fast = alignment.ByteLevel(data.replace(b'"add_prefix_space":false', b'"add_prefix_space":true').replace(b'"add_prefix_space": false', b'"add_prefix_space": true'), PATTERN), alignment.ByteLevel(data, PATTERN)
    assert own.fast is None and fast.fast is not None
    texts = [" " + t for t in TEXTS if t]
    assert own.encode(texts) == fast.encode(texts)


def test_pairs_pass_on_when_a_task_holds_many(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 3)
    monkeypatch.setattr(alignment, "CHUNK", 20)
    aligner = alignment._aligning(open(A, "rb").read(), open(B, "rb").read(), PATTERN, False, __import__("pyarrow").int32())
    import pyarrow as pa

    texts = [t for t in TEXTS if t]
    out = list(aligner([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["row", "id", "text"])]))
    counts = Counter()
    for batch in out:
        for r in batch.to_pylist():
            if r["kind"] == 1:
                counts.update(dict(zip(r["pairs"], r["times"], strict=True)))
    assert sum(b.column(0)[0].as_py() for b in out if b.num_rows) > 1
    assert counts == Counter(p for b in out for r in b.to_pylist() if r["kind"] == 0 for p in r["pairs"])


# ---- vector codes

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """In Python's integers; rows are (id, vector, label)."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    start = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        start.setdefault(i, v)
    books = [[cut(v, p) for v in list(start.values())[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda j: (far(cut(v, p), books[p][j]), j))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            of = [near(v, p) for _, v, _ in kept]
            new.append([[sum(c) // len(c) for c in zip(*m, strict=True)] if (m := [cut(v, p) for (_, v, _), k in zip(kept, of, strict=True) if k == j]) else e for j, e in enumerate(book)])
        books = new
    out = [(i, [near(v, p) for p in range(parts)], v, lab) for i, v, lab in kept]
    out = [(i, "".join(f"{c:02x}" for c in code), sum(far(cut(v, p), books[p][code[p]]) for p in range(parts)), lab) for i, code, v, lab in out]
    total = Counter()
    for _, _, e, lab in out:
        total[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, total[lab], digest) for i, c, e, lab in out]


@pytest.mark.parametrize("n", [5, 60])
def test_codes_in_plain_integers(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 16) / 7], int(i % 3) if i % 4 else None) for i in rng.permutation(n)]
    rows += [rows[0], (1, rows[0][1], 2), (None, rows[1][1], None), (70, None, 1), (71, [float("nan")] * 16, 1), (72, [None] * 16, 1), (73, [float("inf")] * 16, None)]  # repeated and null ids, vectors that go
    frame = wide(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"))
    got = codes.compressed(frame)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_codes(rows)))
    assert codes.compressed(frame.limit(0)).collect() == [] and codes.compressed(frame.filter("vec_id between 70 and 73")).collect() == []


def test_codes_of_odd_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<float>, label string")
    assert [tuple(r)[:4] for r in codes.compressed(frame([("x", [], None)])).collect()] == [("x", "00" * 8, 0, 0)]
    for rows, said in (([("x", [1.0] * 8, "a"), ("y", [1.0] * 16, "a")], "different lengths"), ([("x", [1.0] * 9, "a")], "equal parts"), ([("x", [1e9] * 8, "a")], "is not under")):
        with pytest.raises(Exception, match=said):
            codes.compressed(frame(rows)).collect()


# ---- FM-indexes

def test_index_by_counting():
    rng = random.Random(7)
    for letters, window in ((1, 3), (2, 4), (3, 13), (40, 5)):
        seqs = [[rng.randrange(letters) for _ in range(window + rng.randrange(9))] for _ in range(60)]
        order = np.array([rng.randrange(30) for _ in seqs])
        least = {}
        for s, o in zip(seqs, order, strict=True):
            for p in range(len(s) - window + 1):
                least[t] = min(least.get(t := tuple(s[p : p + window]), 99), o)
        index = fmindex.Index(np.array([x for s in seqs for x in s], np.int64), np.array([len(s) for s in seqs]), order, window)
        assert index.statistics().tolist() == [least[tuple(s[p : p + window])] for s in seqs for p in range(len(s) - window + 1)]


def plain_windows(rows):
    words = [(t or "").encode().split() for _, t in rows]
    smaller = lambda a, b: a is not None and (b is None or a < b)
    at = {}
    for (i, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - 12):
            at.setdefault(tuple(w[p : p + 13]), set()).add(i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {q for p in range(len(w) - 12) if any(smaller(j, i) for j in at[tuple(w[p : p + 13])]) for q in range(p, p + 13)}
        out.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("group", [0, 3, 1024])
def test_windows_by_counting(spark, group):
    rng = random.Random(group)
    pool = [" ".join(rng.choice("ab") for _ in range(rng.randrange(10, 40))) for _ in range(3)] + [" ".join(f"w{rng.randrange(9)}" for _ in range(30)) for _ in range(3)]
    texts = ["  ".join([f"u{i} é", *(rng.choice(pool) for _ in range(rng.randrange(4))), f"v{i}\t"]) for i in range(60)] + [None, "", " \n", "one two", "a " * 400, "a " * 400, pool[3] + " " + pool[3]]
    rows = [(i % 50 if i % 11 else None, t) for i, t in enumerate(texts)]
    rows += rows[:5]
    docs = wide(spark.createDataFrame(rows, "doc_id long, text string"))
    got = fmindex.deduplicated(docs, group=group)
    assert got.columns == [*docs.columns, "_n_words", "n_removed", "_kept"]
    got = got.select("doc_id", "_n_words", "n_removed", "_kept")
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_windows(rows)
    assert fmindex.deduplicated(docs.limit(0)).collect() == []


def test_windows_of_ids_that_are_text(spark, monkeypatch):
    monkeypatch.setattr(fmindex, "SHARD", 50)
    monkeypatch.setattr(fmindex, "CHUNK", 100)
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(30)) for _ in range(3)]
    rows = [(f"k{i % 17}" if i % 9 else None, f"u{i} {rng.choice(pool)} v{i} {rng.choice(pool)}") for i in range(60)]
    got = fmindex.deduplicated(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_windows(rows)


def test_equal_long_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(" ".join(f"w{i}" for i in range(40))).alias("text"))
    got = {r.doc_id: r.n_removed for r in fmindex.deduplicated(docs).collect()}
    assert got == {i: 40 * (i > 0) for i in range(3000)}
