"""Alignment of two tokenizers' tokens by the bytes at which they end.

Both write the same bytes, so that each byte gets a label: no token ends here, one of A, one of B, or one of either. A regular
expression cuts the string of labels after each byte where both end; a piece's labels say how many tokens of either make a
group. Id pairs whose byte ranges overlap are links. In how many documents a pair is linked is counted over the whole corpus:
the commoner pairs, a bounded number of them, are broadcast, and the others meet their documents in a join."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, col, forget, map_arrow, stored

#: Pairs that are broadcast at most (13 bytes each), and pairs that a task counts before it passes them on.
HEAD, HELD = 1 << 20, 1 << 20
CHUNK = 1 << 20  # bytes of texts that are aligned at once; a longer text is alone
A_END, B_END, BOTH = 1, 2, 3
PIECE = re.compile(rb"[\x00-\x02]*\x03")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: those that can be seen for themselves, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of a tokenizers file: encode(texts), and `entries`, each id's bytes.

    Where ids are ranks of merges the file is encoded by tiktoken, which gives the same ids several times as fast."""

    def __init__(self, data: bytes, pattern: str) -> None:
        self.data, file = data, json.loads(data)
        byte_of = _byte_of()
        vocabulary = file["model"]["vocab"]
        self.entries: list[bytes] = [b""] * (max([*vocabulary.values(), *(t["id"] for t in file["added_tokens"])]) + 1)
        for text, i in vocabulary.items():
            self.entries[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
        special = {t["id"] for t in file["added_tokens"]}
        for t in file["added_tokens"]:
            self.entries[t["id"]] = t["content"].encode()
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in file["model"]["merges"]]
        ids = [vocabulary.get(m, -1) for m in joined]
        before, model = file["pre_tokenizer"] or {}, file["model"]
        plain = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True) and not file["normalizer"] and not model.get("dropout") and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
        ranks = {self.entries[i]: i for i in vocabulary.values() if i not in special}
        self.fast = None
        if plain and ids == sorted(set(ids)) and len(ranks) == len(ids) + 256 and ids[:1] > [255]:
            import tiktoken

            self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def _whole(self, texts: list[str]) -> list[list[int]]:
        if self.slow is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.data.decode())
            self.slow.encode_special_tokens = True
        return [e.ids for e in self.slow.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return self._whole(texts)
        out = []
        for t in texts:
            try:
                out.append(self.fast.encode_ordinary(t))
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # noqa: BLE001  a regular expression's limit of steps, on endless white space, is a panic there
                out += self._whole([t])
        return out


class Pieces:
    """A sentencepiece model: encode(texts), and `entries`, each id's bytes."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.entries = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Counts(dict):
    """How many tokens of A and B end in a piece of labels: A's times 2 ** 32, plus B's."""

    def __missing__(self, piece: bytes) -> int:
        both = piece.count(BOTH)
        n = (piece.count(A_END) + both) << 32 | (piece.count(B_END) + both)
        if len(piece) < 64 and len(self) < 200_000:
            self[piece] = n
        return n


class Aligner:
    """Aligns the tokens of two encoders, A over a space and the text, B over the text, before which it puts a space itself."""

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in e.entries], np.int64) for e in (a, b)]
        self.counts = _Counts()
        name = [[str(i).encode() for i in range(len(e.entries))] for e in (a, b)]
        self.written = [x + end for n, ends in zip(name, ((b",", b"|"), (b",", b";")), strict=True) for end in ends for x in n]

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """The ids of A and of B of each text; none where either's bytes aren't a space and the text, or the text is null or empty."""
        some = [i for i, t in enumerate(texts) if t]
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        spaced = [" " + texts[i] for i in some]
        for i, said, a, b in zip(some, spaced, self.a.encode(spaced), self.b.encode([texts[i] for i in some]), strict=True):
            want = said.encode("utf-8", "surrogatepass")
            if b"".join(map(self.a.entries.__getitem__, a)) == want == b"".join(map(self.b.entries.__getitem__, b)):
                out[i] = a, b
        return out

    def aligned(self, texts: list[str | None]) -> dict:
        """Of each text n_a, n_b, n_groups, n_links and its groups as bytes; and of all `doc`, `pair` (A's id times B's number of
        ids, plus B's) and `times`: how often each text links each pair, in order."""
        both = self.tokens(texts)
        n = [np.array([len(x[side]) for x in both], np.int64) for side in (0, 1)]
        ids = [np.fromiter((i for x in both for i in x[side]), np.int64, int(n[side].sum())) for side in (0, 1)]
        (a, b), (size_a, size_b) = ids, (self.sizes[0][ids[0]], self.sizes[1][ids[1]])
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        labels = np.zeros(int(end_a[-1]) if len(a) else 0, np.uint8)
        labels[end_a - 1] |= A_END
        labels[end_b - 1] |= B_END
        found = np.fromiter(map(self.counts.__getitem__, PIECE.findall(labels.tobytes())), np.int64)
        in_a, in_b = found >> 32, found & 0xFFFFFFFF
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        upto = [np.r_[0, np.cumsum(x)] for x in n]
        groups = np.diff(np.searchsorted(to_a, upto[0], "right"))

        of_a, of_b = np.repeat(np.arange(len(found)), in_a), np.repeat(np.arange(len(found)), in_b)
        text = np.empty(len(a) + len(b), np.int64)  # the places of entries of self.written, A's tokens of a group before B's
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[to_a - 1], last_b[to_b - 1] = 1, 1
        many_a, many_b = len(self.a.entries), len(self.b.entries)
        text[np.arange(len(a)) + (to_b - in_b)[of_a]] = a + last_a * many_a
        text[np.arange(len(b)) + to_a[of_b]] = b + 2 * many_a + last_b * many_b
        whole, cuts = text.tolist(), (upto[0] + upto[1]).tolist()
        written = [b"".join(map(self.written.__getitem__, whole[s:e]))[:-1] for s, e in zip(cuts, cuts[1:], strict=False)]

        first = np.searchsorted(end_b, end_a - size_a, "right")
        many = np.searchsorted(end_b - size_b, end_a, "left") - first
        many[size_a == 0] = 0
        with_b = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        doc = np.repeat(np.arange(len(texts)), n[0])
        links = np.bincount(doc, many, len(texts)).astype(np.int64)
        pair = np.repeat(doc, many) << 40 | np.repeat(a, many) * many_b + b[with_b]
        pair, times = np.unique(pair, return_counts=True)
        return {"n_a": n[0], "n_b": n[1], "n_groups": groups, "n_links": links, "groups": written, "doc": pair >> 40, "pair": pair & ((1 << 40) - 1), "times": times}


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype())))


def _chunks(texts: list):
    first, size = 0, 0
    for i, t in enumerate(texts):
        now = 4 * len(t or "") if not (t or "").isascii() else len(t or "")
        if i > first and size + now > CHUNK:
            yield first, i
            first, size = i, 0
        size += now
    if len(texts) > first:
        yield first, len(texts)


FIELDS = ["kind", "row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"]


def _aligning(a_file: bytes, b_file: bytes, pattern: str, with_groups: bool, kind: pa.DataType):
    """For mapInArrow of (row, id, text): a row for each text (kind 0), and the pairs that the task has met with how many texts hold each (kind 1)."""

    def run(batches):
        aligner = Aligner(ByteLevel(a_file, pattern), Pieces(b_file))
        id_kind = pa.int64()
        met: list[tuple[np.ndarray, np.ndarray]] = []  # pairs and how many texts hold each

        def merged() -> tuple[np.ndarray, np.ndarray]:
            known, of = np.unique(np.concatenate([x[0] for x in met]), return_inverse=True)
            return known, np.bincount(of, np.concatenate([x[1] for x in met]), len(known)).astype(np.int64)

        def counted(known: np.ndarray, counts: np.ndarray):
            for at in range(0, len(known), 1 << 16):
                some, zero = known[at : at + (1 << 16)], pa.array([0], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), zero, pa.nulls(1, id_kind), *[zero] * 4, *[pa.array([None], pa.string())] * 2, _lists(some, np.array([len(some)]), kind), _lists(counts[at : at + len(some)], np.array([len(some)]), pa.int32())], FIELDS)

        for batch in batches:
            texts, id_kind = batch.column(2).to_pylist(), batch.column(1).type
            for first, last in _chunks(texts):
                got = aligner.aligned(texts[first:last])
                met.append(np.unique(got["pair"], return_counts=True))
                if sum(len(x[0]) for x in met) > 2 * HELD:
                    met = [merged()]
                    if len(met[0][0]) > HELD:
                        yield from counted(*met.pop())
                sizes = np.bincount(got["doc"], minlength=last - first)
                said = [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
                shown = pa.array([g.decode() for g in got["groups"]], pa.string()) if with_groups else pa.nulls(last - first, pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(last - first, np.int32)), *[batch.column(i).slice(first, last - first) for i in (0, 1)], *[pa.array(got[k]) for k in ("n_a", "n_b", "n_groups", "n_links")],
                    pa.array(said, pa.string()), shown, _lists(got["pair"], sizes, kind), _lists(got["times"], sizes, pa.int32()),
                ], FIELDS)
        if met:
            yield from counted(*merged())

    return run


def _threshold(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most `most` pairs are linked in as many documents."""
    rows = pairs.groupBy(F.floor(F.log2("docs")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()  # at most 63
    total, least = 0, 62
    for r in sorted(rows, reverse=True):
        total += r.n
        if total > most:
            break
        least = r.power
    return 1 << least


def align(docs: DataFrame, a_file: str, b_file: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_groups: bool = False, head: int = HEAD) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of each row.

    A is a byte-level BPE (tokenizers file, whose pieces `pattern` finds), B a sentencepiece model. groups, null unless asked for,
    is `a1,a2|b1;a3|b2,b3`: ids of A and of B that end together. A link is an occurrence of overlapping tokens; a pair's count is
    the number of rows that link it. n_best counts links whose pair no other of the same A id exceeds, count_sum adds the counts
    of all links. Zeros and '' without tokens: a null or empty text, or one whose bytes either tokenizer doesn't give back. Ids are
    of any type, null and repeated ones too: each row counts. No rows for an empty table; other columns are not read.

    Counts of at most `head` pairs are broadcast, those of the pairs in most documents; the rest goes through a join, at every size."""
    spark = docs.sparkSession
    bounded(spark)
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        a_data, b_data = f.read(), g.read()
    many_b = len(Pieces(b_data).entries)
    wide = len(ByteLevel(a_data, pattern).entries) * many_b >= 1 << 31
    pair = "long" if wide else "int"
    source = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), col(text).cast("string").alias("text"))
    id_kind = source.schema["id"].dataType.simpleString()
    schema = f"kind int, row long, id {id_kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<{pair}>, times array<int>"
    done = stored(source.mapInArrow(_aligning(a_data, b_data, pattern, with_groups, pa.int64() if wide else pa.int32()), schema))
    met = done.filter("kind = 1").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("docs"))
    met = stored(met.withColumn("a", F.floor(F.col("pair") / many_b).cast("int")))
    highest = met.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each id of A at most
    counts = stored(met.join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    least = _threshold(counts, head)
    common = counts.filter(F.col("docs") >= least).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("pair", "docs", "best")))
    forget(met)

    def make():
        def step(batch):
            pairs, times = batch.column(7), batch.column(8)
            sizes = np.diff(pairs.offsets.to_numpy())
            flat, n = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.repeat(np.arange(len(sizes)), sizes)
            known, docs_, best = sent.value
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            at, sums = at[hit], [np.zeros(len(sizes), np.int64) for _ in range(2)]
            np.add.at(sums[0], own[hit], n[hit] * best[at])
            np.add.at(sums[1], own[hit], n[hit] * docs_[at])
            left = np.bincount(own[~hit], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *map(pa.array, sums), _lists(flat[~hit], left, pairs.type.value_type), _lists(n[~hit], left, pa.int32()), batch.column(9)], [f"c{i}" for i in range(12)])

        return lambda batch: step(batch) if batch.num_rows else ()

    shown = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    scored = stored(map_arrow(done.filter("kind = 0").select(*shown, "pairs", "times", "groups"), make, f"row long, id {id_kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<{pair}>, times array<int>, groups string"))
    forget(done)
    rest = scored.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts.filter(F.col("docs") < least), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    out = scored.drop("pairs", "times").join(rest, "row", "left")
    added = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256", "groups")
