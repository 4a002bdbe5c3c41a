"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import audio, bpe, langid, packing, pii, quality, simhash, suffix
from plumbline.llm.components import Forest, components

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Ids, texts, clashing and extra columns: what every operator must take.
ODD = [
    (1, "The cat sat. " * 40, "en", "a", 0, "x"), (2, None, None, None, None, None), (None, "No id here at all", "en", "a", 1, "x"), (3, "", "en", "a", 1, "x"), (4, "x", "en", None, 1, "x"), (4, "x", "en", None, 1, "x"), (5, "1 2 3", "xx", "b", 1, "x"),
    (6, "word " * 20000, "en", "b", 1, "x"), (7, "é" * 3000, "fr", "b", 1, "x"), (8, " \t\n ", "en", "b", 1, "x"), (9, "The cat sat. " * 40, "en", "a", 0, "x"), (10, "\u0000\U0001f600  z", "en", "c", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ---- components

def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(50)] + [(5, 5), (None, 7), (-9, 5000), (5000, -9)]
    forest = Forest()
    for u, v in edges:
        if u is not None and u != v:
            forest.join(u, v)
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    assert {(r.id, r.root) for r in components(df).collect()} == {(x, forest.find(x)) for x in forest.parent}
    assert components(df.limit(0)).count() == 0


# ---- SimHash

def _fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    for text in [d[1] for d in docs[:60]] + [r[1] for r in ODD if r[0] != 6]:
        assert simhash.fingerprint(text) % (1 << 64) == _fingerprint(text)


@pytest.mark.parametrize("run", [2, 4096])
def test_links_connect_as_all_pairs_do(spark, run):
    rng = random.Random(run)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps)[:12]:
        for _ in range(12):
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps |= {(7 << 32) | rng.getrandbits(16) for _ in range(150)}  # one crowded segment
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want, got = Forest(), Forest()
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                want.join(a, b)
    for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), run=run).collect():
        assert ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 * 200  # a star: ends are linked, if not directly
        got.join(r.u, r.v)
    assert {x: want.find(x) for x in signed} == {x: got.find(x) for x in signed}


def test_near_duplicates(spark, docs, odd):
    rows = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    fps = {d: _fingerprint(t) for d, t, _ in docs}
    forest = Forest()
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                forest.join(a, b)
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in rows} == {d: (fps[d], forest.find(d)) for d in fps}
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (2, 3, 8)} == {2} and {r.component_id for r in got if r.doc_id in (1, 9)} == {1}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 4, 5, 6, 7, 10]


# ---- language

def test_languages(spark, docs, odd):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    profiles = langid.learn(df.filter("doc_id % 3 <> 1"))
    assert set(profiles) == {d[2] for d in docs} and all(len(p) <= langid.TOP for p in profiles.values())
    held = langid.identify(df.filter("doc_id % 3 = 1"), profiles).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in held)
    got = {r.doc_id: r for r in langid.identify(odd, profiles).collect()}
    assert [got[i].lang_pred for i in (2, 3, 5, 8)] == ["und"] * 4 and got[2].score == 0 and got[1].lang_pred == "en"
    assert langid.identify(odd, {}).first().lang_pred == "und" and langid.learn(odd.limit(0)) == {}


def test_profiles_by_counting(spark):
    texts = ["Ab ab! b", "éa, ab"]
    want = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            padded = f"_{w}_"
            want.update([c for c in w])
            want.update(padded[i : i + 2] for i in range(len(padded) - 1))
            want.update(padded[i : i + 3] for i in range(len(padded) - 2))
    joined = Counter()
    for t in texts:
        codes = langid.ngrams(t)
        joined.update(codes.tolist())
    assert sorted(joined.values()) == sorted(want.values())
    got = langid.learn(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"), top=1000)["x"]
    assert set(got.tolist()) == set(joined) and [joined[c] for c in got.tolist()] == sorted(joined.values(), reverse=True)


# ---- BPE

def test_tokens(spark, docs, odd):
    use = bpe.encoder(PATH, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=use.ranks, special_tokens={})
    rng = random.Random(2)
    texts = [d[1] for d in docs[:80]] + ["".join(rng.choice("ab \n'sé1!😀") for _ in range(rng.randrange(60))) for _ in range(300)] + ["a" * 1500, "<|endoftext|>", "z" * 90 + " " * 300 + "!?" * 200]
    for text, (ids, back) in zip(texts, use.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text) and back == text.encode()
    rows = {r.doc_id: r for r in bpe.digests(odd, PATH, public_tokenizers.PATTERN).collect()}
    assert rows[2].n_tokens == rows[3].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    want = ref.encode_ordinary(ODD[7][1])
    assert rows[6].n_tokens == len(want) and rows[6].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode(odd, PATH, public_tokenizers.PATTERN).filter("doc_id = 4").first().ids == ref.encode_ordinary("x")
    assert bpe.digests(odd.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(KeyError):
        use.decode_ids([[10**6]])


# ---- personal data

LITERAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _literal(text):
    out = []
    for kind, pattern in LITERAL.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_patterns(docs):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab1.@-+ ()9_é%") for _ in range(rng.randrange(45))) for _ in range(4000)]
    for text in made + [d[1] for d in docs]:
        assert pii.base_spans(text) == _literal(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000 + ".2", "1." * 100_000, "+1 " * 60_000, "@" * 100_000):
        pii.base_spans(text)


@pytest.mark.parametrize("text, want", [
    ("call +1 (564) 555-4526 now. later try 555-4526 again", ["+1 (564) 555-4526", "555-4526"]), ("later try 555-4526 again, soon 555-4526", []), ("mail bob.smith7@x.org or bob.smith7@x,org again", ["bob.smith7@x.org", "bob.smith7@x,org"]),
    ("write to jane.doe (at) mail.example.com", ["jane.doe (at) mail.example.com"]), ("version 3.2, 19 of 20, 4467920212765299", []), ("no data at all", []), ("", []), (None, []),
])
def test_repeats_and_other_spellings(text, want):
    assert [text[a:b] for _, a, b in pii.all_spans(text)[1]] == want


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(1)
    n, k = 6, 3
    unary, edges = rng.normal(size=(n, k)), np.array([(0, 1), (1, 2), (1, 3), (3, 4), (3, 5)])
    pots = rng.normal(size=(len(edges), k, k))
    total = np.zeros((n, k))
    for x in np.ndindex(*[k] * n):
        w = np.exp(sum(unary[i, x[i]] for i in range(n)) + sum(pots[e, x[a], x[b]] for e, (a, b) in enumerate(edges)))
        for i in range(n):
            total[i, x[i]] += w
    got = pii.marginals(unary, edges, pots, rounds=200)
    assert np.allclose(got, total / total.sum(1, keepdims=True), atol=1e-3)


def test_pii_rows(spark, docs, odd):
    rows = pii.find(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    for r, (d, t, _) in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs), strict=True):
        base = _literal(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and {pii.joined([s]) for s in base} <= {*r.spans.split(",")} | {""}
    assert pii.find(odd).count() == len(ODD) and pii.find(odd.limit(0)).count() == 0
    assert pii.redact("a b@c.de f", [("email", 2, 8)]) == "a <email> f" and pii.redact("xyz", [("ip", 0, 2), ("card", 1, 3)]) == "<ip>"
    assert [r.text for r in pii.redacted(odd).filter("doc_id in (2, 3)").orderBy("doc_id").collect()] == [None, ""]


# ---- suffixes

def _passages(rows):
    places, spans = defaultdict(list), defaultdict(set)
    for d, t in rows:
        words = (t or "").encode().split()
        for a in range(len(words) - 49):
            places[b" ".join(words[a : a + 50])].append((d, a))
    for found in places.values():
        if len(found) > 1:
            for d, a in found:
                spans[d, (d, a) == min(found)].update(range(a, a + 50))
    return spans


@pytest.mark.parametrize("group", [3, 4096])
def test_passages(spark, docs, group):
    rng = random.Random(group)
    base = [[rng.choice(["ab", "c", "déf", "gh"]) for _ in range(300)] for _ in range(3)]
    made = []
    for i in range(50):
        words = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(250)
            words += rng.choice(base)[a : a + rng.randrange(5, 120)] + [rng.choice("pqr") for _ in range(rng.randrange(9))]
        made.append((1000 + i, " ".join(words)))
    made += [(2000, "x " * 200), (2001, None), (2002, ""), (2003, "y " * 50), (2004, "y " * 49)] + [d[:2] for d in docs]
    got = defaultdict(set)
    for r in suffix.repeated_passages(spark.createDataFrame(made, "doc_id long, text string"), group=group).collect():
        got[r.doc_id, r.first].update(range(r.start_word, r.end_word))
    assert got == _passages(made)


def test_repeats_are_removed(spark, odd):
    left = {r.doc_id: r for r in suffix.without_repeats(odd).collect()}
    assert suffix.without_repeats(odd).columns == odd.columns
    assert 9 not in left and left[1].text == ODD[0][1][: 13 * 17].rstrip() + left[1].text[len(ODD[0][1][: 13 * 17].rstrip()) :] and len(left[6].text.split()) == 50
    assert left[2].text is None and suffix.repeated_passages(odd.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(120))
    rows = spark.createDataFrame([(1, "a " + long), (2, "b " + long + " c")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix.without_repeats(rows).collect()} == {1: "a " + long, 2: "b c"}
    assert suffix.cut("a b  c\nd e", [(1, 3)]) == "a d e" and suffix.removable([(0, 50, True, True), (1, 300, False, True)]) == [(50, 300)]


# ---- packing

def test_packing(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, capacity=300, shard_rows=64).join(docs.select("doc_id", "source", F.md5(F.lower("text")).alias("h")), "doc_id").collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.bin_offset)
        assert sum(r.n_tokens for r in rows) <= 300 and all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in zip(rows, rows[1:], strict=False)) and rows[0].bin_offset == 0
        assert max(Counter(r.source for r in rows).values()) <= 2 and len({r.h for r in rows}) == len(rows)
    words = {r.doc_id: len(r.text.split()) for r in docs.select("doc_id", "text").collect()}
    assert Counter({d: n for d, n in words.items() if n}) == sum((Counter({r.doc_id: r.n_tokens}) for r in got), Counter())
    rows = packing.pack(odd).collect()
    assert sorted(r.n_tokens for r in rows if r.doc_id in (2, 3, 8)) == [0, 0, 0] and all(r.bin_id is None for r in rows if not r.n_tokens)
    assert sum(r.n_tokens for r in rows if r.doc_id == 6) == 20000 and packing.pack(odd.limit(0)).count() == 0
    a, b = (r for r in rows if r.doc_id == 4)
    assert a.bin_id != b.bin_id


def test_the_tightest_compatible_bin():
    rng = random.Random(6)
    packer, bins = packing.Packer(50, 2), []
    for _ in range(800):
        n, s, c = rng.randrange(1, 51), rng.choice([None, *"abcdef"]), rng.choice([None, *range(30)])
        fits = [(50 - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + n <= 50 and (s is None or sum(x[1] == s for x in b) < 2) and (c is None or all(x[2] != c for x in b))]
        k, at = packer.add(n, s, c)
        if fits:
            assert (50 - sum(x[0] for x in bins[k]), k) == min(fits) and at == sum(x[0] for x in bins[k])
        else:
            assert k == len(bins) and at == 0
            bins.append([])
        bins[k].append((n, s, c))
    with pytest.raises(ValueError):
        packer.add(51)


# ---- quality

def test_network_pools_as_a_plain_convolution_does():
    net, rng = quality.Network(), random.Random(1)
    for n in (0, 1, 7, 500, 512, 513, 3000):
        text = "".join(rng.choice("abc !é") for _ in range(n))
        pairs = quality._pairs(text)
        raw = np.stack((pairs >> 8, pairs & 255), 1).reshape(-1)
        out = np.array([sum(net.p["w"][k, raw[2 * i + k]] for k in range(8)) for i in range(len(pairs) - 3)])
        chunks = np.array([out[a : a + 256].max(0) for a in range(0, len(out) - 255, 192)])
        assert raw[: len(text.encode())].astype(np.uint8).tobytes() == text.encode() and len(chunks) * 192 + 64 == len(out)
        assert np.allclose(net.pooled(pairs, net.tables()), chunks, atol=1e-4)


def test_network_learns_and_scores(spark, odd):
    rng = random.Random(2)
    words = lambda: " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(rng.randrange(5, 300)))
    rows = [(i, words() if i % 2 else words().replace(" ", " | ")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(0, 1), (None, 1), (5, None), (900, 7)], "doc_id long, quality int")
    net = quality.learn(docs, labels)
    got = quality.classify(docs.filter("doc_id >= 200"), net).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) > 95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    again = quality.learn(docs.repartition(5), labels)
    assert np.array_equal(net.p["w"], again.p["w"])
    assert quality.classify(odd, net).count() == len(ODD) and quality.classify(odd, net).columns[-2:] == ["score", "predicted"]
    assert quality.learn(docs, labels.limit(0)) is None and quality.classify(odd, None).first().score == 0.5


def test_gradients():
    net, text = quality.Network(), "some text, and more of it | " * 40
    pairs = quality._pairs(text)

    def loss():
        return np.log1p(np.exp(-net.logit(net.pooled(pairs, net.tables()))))

    before = loss()
    net.fit([text], [1], epochs=3, batch=1)
    assert loss() < before


# ---- audio

def test_resampling_is_that_of_the_textbook():
    rng = np.random.default_rng(1)
    for n in (192, 193, 1000):
        for up, down in ((2, 3), (1, 3), (3, 2)):
            x, h = rng.normal(size=n), audio._phases(up, down).T.reshape(-1)
            full = np.zeros(n * up)
            full[::up] = x
            full = np.convolve(full, h)
            at = np.arange(-(-n * up // down)) * down + audio._phases(up, down).shape[1] * up // 2
            assert np.allclose(audio.resample(x, up, down), np.where(at < len(full), full[np.minimum(at, len(full) - 1)], 0), atol=1e-5)


def test_frames_and_segments():
    t = np.arange(16000) / 16000
    tone = np.where((t > 0.25) & (t < 0.5), np.sin(2 * np.pi * 1000 * t), 0).astype(np.float32)
    mels, energy = audio.log_mel(tone, 16000)
    assert mels.shape == (99, audio.MELS)
    ((a, b),) = audio.segments(energy)
    assert abs(a - 24) <= 2 and abs(b - 50) <= 2
    whole = np.abs(np.fft.rfft(tone[40 * 160 : 40 * 160 + 400] * np.hanning(400), 512)) ** 2
    assert np.allclose(mels[40], np.log(whole @ audio._mels(16000) + 1e-6), atol=1e-3)
    assert audio.segments(np.array([1, 3, 2, 2, 0, 2, 0], float), 1.9, 1.1) == [(1, 4)]


def test_media(spark, odd):
    rows = {r.doc_id: r for r in audio.media_column(odd).collect()}
    for i, text, *_ in ODD:
        r, data = rows[i], (text or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert audio.from_wav(r.media) == (payload, audio.RATE) and (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert rows[1].feature == rows[9].feature and rows[1].feature != rows[6].feature and rows[2].feature == rows[3].feature
    table = pa.ipc.open_stream(rows[6].tensors).read_all()
    assert table.schema.field("mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.SPAN, audio.MELS))
    starts, ends = table["start_s"].to_pylist(), table["end_s"].to_pylist()
    assert starts == sorted(starts) and all(a < b for a, b in zip(starts, ends, strict=True)) and starts[0] == 0
    assert audio.media_column(odd.limit(0), with_media=False).count() == 0
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFX" + rows[1].media[4:])


def test_duckdb_is_what_encodes():
    assert "RECURSIVE" in bpe.ENCODE and duckdb.__version__
