"""Every operator and stage beside columns whose names clash with its own, dots and backticks in names, and rows in excess of a bound."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import audio, bpe, html, jaccard, langid, neighbours, packing, pii, quality, simhash, suffix
from plumbline.llm.common import stored

#: Names that operators use inside, and some that need quoting.
NAMES = "a.b c`d id i t y n w r r2 uid rid order pos gram at text_to_hash text_to_compare text_to_identify text_to_score near_id near_row near_row2 passage_id passage_row passage_spans score predicted lang_pred host url2 kind shard copies piece fp component_id key own bits".split()
LONG = " ".join(f"word{i % 97} other{i % 89}" for i in range(60))
ROWS = [(1, f"One text. {LONG}", "en", "s"), (2, f"Another text, {LONG} and an end a@b.org", "en", "s"), (3, None, None, None), (4, "", "fr", "s"), (4, "", "fr", "s"), (None, "bonjour tout le monde", "fr", "t"), (5, "bonjour tout le monde", None, "t")]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def wide(plain):
    return plain.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(NAMES)])


PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
KEYS = {
    "suffix": lambda d: suffix.repeated_passages(d), "identify": lambda d: langid.identify(d, langid.learn(d)).select("doc_id", "lang_pred", "score"), "pack": lambda d: packing.pack(d), "pack by column": lambda d: packing.pack(d, cluster="source"),
    "simhash": lambda d: simhash.near_duplicates(d), "jaccard": lambda d: jaccard.near_duplicates(d), "pii": lambda d: pii.find(d), "audio": lambda d: audio.media_column(d, with_media=False), "bpe": lambda d: bpe.digests(d, PATH, public_tokenizers.PATTERN),
    "quality": lambda d: quality.classify(d, quality.learn(d, d.select("doc_id", F.lit(1).alias("quality"))), "text").select("doc_id", "score", "predicted"),
}


@pytest.mark.parametrize("name", KEYS)
def test_operators_read_only_their_columns(plain, wide, name):
    assert sorted(map(repr, KEYS[name](wide).collect())) == sorted(map(repr, KEYS[name](plain).collect()))


def test_columns_that_pass_through(spark, plain, wide):
    import corpus_pipeline as c

    rewriting = {"suffix": suffix.without_repeats, "simhash": simhash.one_of_each, "jaccard": lambda d: simhash.one_of_each(d, near=jaccard.near_duplicates), "pii": pii.redacted} | {n: lambda d, f=f: f(spark, d, "") for n, f in c.STAGES[:-1]}
    for name, f in rewriting.items():
        left, want = f(wide), f(plain)
        assert left.columns == wide.columns and left.dtypes == wide.dtypes, name
        got = left.collect()
        assert sorted(repr(r[:4]) for r in got) == sorted(repr(tuple(r)) for r in want.collect()), name
        assert {tuple(r)[4:] for r in got} == {tuple(f"x{i}" for i in range(len(NAMES)))}, name
    assert sorted(map(repr, c.bins(spark, wide, "").collect())) == sorted(map(repr, c.bins(spark, plain, "").collect()))


def test_other_id_and_text_names(plain):
    odd = plain.select(F.col("doc_id").alias("the.id"), F.col("text").alias("the`text"), F.col("source").alias("the source"))
    args = {"id_col": "the.id", "text": "the`text"}
    for f in (suffix.repeated_passages, simhash.near_duplicates, jaccard.near_duplicates, pii.find, audio.media_column, lambda d, **a: packing.pack(d, source="the source", **a), lambda d, **a: bpe.digests(d, PATH, public_tokenizers.PATTERN, **a)):
        assert f(odd, **args).count() >= 0
    assert simhash.one_of_each(odd, **args).columns == odd.columns and suffix.without_repeats(odd, **args).columns == odd.columns


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<p>a")], "page_id long, url string, html string").select("*", *[F.lit("x").alias(n) for n in NAMES])
    assert [r.text for r in html.main_text(pages).collect()] == ["a"]
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>").select("*", *[F.lit("x").alias(n) for n in NAMES])
    assert neighbours.nearest(vectors, "id = 0").count() == 1


# ---- bounds

def test_pieces_without_white_space():
    """Pieces of 120 bytes by the thousand, and single ones of any make, as tiktoken encodes them."""
    import base64
    import random

    rng = random.Random(6)
    use = bpe.encoder(PATH, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=use.ranks, special_tokens={})
    cjk = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    texts = [" ".join(cjk(40) for _ in range(9000)), cjk(5000), base64.b64encode(rng.randbytes(9000)).decode(), "=" * 20000, "ab" * 9000, "-=" * 700 + "=" * 4000, "".join(rng.choice("ab") for _ in range(6000)), "aab" * 700, "é" * 3000]
    for text, (ids, back) in zip(texts, use.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text) and back == text.encode()


def test_local_contraction_by_the_plain_rule():
    """Random vocabularies, also such that no training would give: one pair at a time, least rank, leftmost."""
    import base64
    import random
    import tempfile

    for seed in range(6):
        rng = random.Random(seed)
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 300:
            t = b"".join(rng.choice(tokens[97:100] + tokens[256:]) for _ in range(2))
            if t not in tokens and len(t) < 9:
                tokens.append(t)
        rest = tokens[256:]
        rng.shuffle(rest)
        with tempfile.NamedTemporaryFile("w", suffix=".tiktoken") as f:
            f.writelines(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens[:256] + rest))
            f.flush()
            use = bpe.Encoder(f.name, r"[^ ]+")
        for piece in (bytes(rng.choice(b"abc") for _ in range(rng.choice((5, 40, 400)))) for _ in range(6)):
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                r, i = min((use.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if r == 1 << 30:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert use.encode_pieces([piece])[0] == [use.ranks[p] for p in parts]


def test_equal_rows_are_spread_over_shards(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    rows = packing.pack(docs, shard_rows=200).collect()
    assert len(rows) == 3000 and len({r.bin_id >> 26 for r in rows}) > 10 and max(np.unique([r.bin_id for r in rows], return_counts=True)[1]) == 1  # copies share no bin


def test_near_copies_share_no_bin(spark):
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"end{i}"]), f"s{i}") for i in range(30)], "doc_id long, text string, source string")
    clusters = simhash.near_duplicates(docs)
    joined = packing.pack(docs).join(clusters, "doc_id").groupBy("bin_id", "component_id").count()
    assert joined.agg(F.max("count")).first()[0] == 1 and clusters.select("component_id").distinct().count() < 30


def test_a_repeated_labelled_id_is_one_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Network, "fit", lambda self, texts, labels: seen.append((texts, labels)) or self)
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionAll(spark.createDataFrame([(2, "b" * 50), (3, "c")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (4, 5), (None, 1)], "doc_id long, quality int")
    quality.learn(docs, labels)
    assert sorted(zip(*seen[0], strict=True)) == [("b" * 50, 1), ("c", 1), ("text 0", 0)]
    quality.learn(docs, labels, most=1)
    assert len(seen[1][0]) == 1
    quality.learn(docs, labels, chars=12)
    assert sum(map(len, seen[2][0])) <= 12


def test_out_of_place_by_lists(spark):
    """Predictions by the plain definition: ranked lists of strings, distances summed one by one."""
    from collections import Counter

    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()] + [(900, "Ωμέγα και άλφα λέξη", "el"), (901, "Привет мир дорогой", "ru"), (902, "λέξη και", None), (903, "мир", None)]

    def grams(text):
        out, word = Counter(), ""
        for ch in [*(text or "").lower(), " "]:
            if ch.isalpha():
                word += ch
            elif word:
                out.update(word)
                padded = f"\0{word}\0"
                out.update(padded[i : i + 2] for i in range(len(padded) - 1))
                out.update(padded[i : i + 3] for i in range(len(padded) - 2))
                word = ""
        return out

    def listed(counts, top=langid.TOP):  # ties by length, then by characters
        return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:top]

    sums = {}
    for _, t, x in docs:
        if x is not None and t is not None:
            sums.setdefault(x, Counter()).update(grams(t))
    profiles = {x: {g: i for i, g in enumerate(listed(c))} for x, c in sums.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.learn(df)).collect()}
    for i, t, _ in docs:
        own = listed(grams(t))
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        away = sorted((sum(abs(p.get(g, k + langid.TOP) - k) if g in p else langid.TOP for k, g in enumerate(own)), x) for x, p in profiles.items())
        assert got[i][0] == away[0][1] and got[i][1] == pytest.approx(away[1][0] / (away[0][0] + away[1][0]))
    assert got[902][0] == "el" and got[903][0] == "ru"


def test_feature_by_the_textbook(spark):
    """The feature string of whole texts by plain loops: resampling by convolution, frames, filters, runs of frames."""
    for text in ("", "a", "The cat sat on the mat. " * 30, "é" * 999):
        payload, _ = audio.padded(text)
        x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
        h = audio._phases(2, 3).T.reshape(-1)
        full = np.zeros(2 * len(x))
        full[::2] = x
        full = np.convolve(full, h)
        at = np.arange(-(-2 * len(x) // 3)) * 3 + audio._phases(2, 3).shape[1]
        y = np.where(at < len(full), full[np.minimum(at, len(full) - 1)], 0)
        frames = []
        for a in range(0, max(1, len(y)), 160):
            part = y[a : a + 400]
            frames.append(np.pad(part, (0, 400 - len(part))))
            if a + 400 >= len(y):
                break
        frames = np.array(frames) * np.hanning(400)
        mels = np.log(np.abs(np.fft.rfft(frames, 512)) ** 2 @ audio._mels(16000) + 1e-6)
        energy = (frames**2).mean(1)
        got = audio.summary(audio.tensors(audio.features(audio.to_wav(payload)))).split(";")
        assert int(got[0]) == len(frames)
        assert np.allclose([float(v) for v in got[3].split(",")], mels.mean(0), atol=0.06)
        runs, inside = [], None
        for k, e in enumerate([*energy, -1.0]):
            if e > audio.LOW * energy.mean():
                inside = [k, k] if inside is None else [inside[0], k]
            elif inside is not None:
                runs.append(inside)
                inside = None
        runs = [r for r in runs if max(energy[r[0] : r[1] + 1]) > audio.HIGH * energy.mean()]
        assert abs(int(got[1]) - len(runs)) <= 1 and abs(int(got[2]) - sum(b - a + 1 for a, b in runs)) <= max(2, len(frames) // 20)


def test_a_match_reaches_every_repeat(spark):
    """A number matched once, and repeated far more often than messages have rounds, without what the pattern needs."""
    text = "call +49 170 1234567 now. " + "some words between them and 49 170 1234567 here again. " * 3
    many = "write to jo.doe77@mail.org today. " + "then jo.doe77 (at) mail.org came back with more words. " * 80
    base, found = pii.all_spans(many)
    assert len(base) == 1 and len(found) > 70
    assert len(pii.all_spans(text)[0]) == 1
    df = spark.createDataFrame([(1, many)], "doc_id long, text string")
    assert "jo.doe77" not in pii.redacted(stored(df)).first().text.split("more words. ")[-2]
