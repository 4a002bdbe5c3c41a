"""Repeated windows of words by FM-indexes of shards, and texts without them.

A window is WINDOW consecutive words of a document. Documents can't all be streamed past all shards, so that shards follow
content: the minimiser of a window, its GRAM-gram of least hash, names the shard, and equal windows meet whatever else their
documents hold. What is dealt out is a stretch of words for each minimiser, with all windows that have it, and only where two
documents share it; equal stretches are one, with the least id that has them.

A shard's index holds the Burrows-Wheeler transform of its stretches, ended by separators, in a wavelet tree of bit planes
with counts. Stretches stream past it from right to left: a backward search adds a word, and beyond WINDOW words the interval
is widened to that of the first WINDOW, so that matching statistics are followed up to the threshold. Each interval that
reaches it reports the least id in it."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, col, forget, fresh, map_arrow, stored
from .suffix import _BYTE, _Q, _R, _inverse, _mix, _powers, row_key

WINDOW, GRAM = 13, 5
SHARD = 1 << 17  # words of a shard
#: Stretches that share a minimiser and go to a shard together; of a more frequent one each window is a stretch of its own, dealt by its own hash.
GROUP = 1024
#: Bytes that stand for a word in a stretch: the first ones of its hash.
CODE = 5
CHUNK = 1 << 20  # bytes of texts that are hashed at once; a longer text is alone
_POS = 30

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of values[a:b], as in suffix.py, with powers that are kept between calls."""
    n = len(values) + 1
    up, down = _tables.get(int(base), ((), ()))
    if len(up) < n:
        up, down = _powers(base, 2 * n), _powers(_inverse(base), 2 * n)
        if n <= 2 * CHUNK:
            _tables[int(base)] = up, down
    sums = np.r_[np.uint64(0), np.cumsum(values * up[: n - 1])]
    return _mix((sums[ends] - sums[starts]) * down[starts])


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in it) of the words of several texts, in order."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edges = np.diff(np.r_[False, ~((raw == 32) | ((raw >= 9) & (raw <= 13))), False].astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    own = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    place = np.arange(len(starts)) - np.searchsorted(own, own)
    return _spans(_BYTE[raw], starts, ends, _R) if len(starts) else np.empty(0, np.uint64), own, place


def stretches(words: np.ndarray, own: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, windows) of each run of windows with one minimiser; minimisers are even numbers, ties take the leftmost."""
    n = len(words) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none
    at = np.arange(len(words) - gram + 1)
    grams = _spans(words, at, at + gram, _Q)
    least = key = (grams >> np.uint64(_POS) << np.uint64(_POS)) | at.astype(np.uint64)
    wide, width = 1, window - gram + 1
    while wide < width:
        step = min(wide, width - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    whole = np.flatnonzero(own[:n] == own[window - 1 :])
    place = (least[whole] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
    del key
    return grams[place[first]].view(np.int64) & ~1, whole[first], np.diff(np.r_[first, len(place)])


class Plane:
    """A sequence of bits with counts of the ones before each 64 of them."""

    def __init__(self, bits: np.ndarray) -> None:
        self.words = np.packbits(np.r_[bits, np.zeros(-len(bits) % 64 + 64, bits.dtype)].astype(bool), bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))[:-1]].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones come before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class Wavelet:
    """Counts of a symbol before a place: a plane for each bit of the symbols, each ordered by the bits above it."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.planes: list[tuple[Plane, int, int]] = []
        now = symbols
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (now >> shift) & 1
            self.planes.append((Plane(bit), shift, int(len(bit) - bit.sum())))
            now = np.r_[now[bit == 0], now[bit == 1]]

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place `at` of the sequence ends up, at the bottom, on the way of its symbol."""
        for plane, shift, zeros in self.planes:
            ones = plane.ones(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at


class Index:
    """An FM-index of sequences of words (concatenated, `sizes` long, at least `window` each), and an order of each."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, order: np.ndarray, window: int = WINDOW) -> None:
        many, self.window = len(sizes), window
        known, ids = np.unique(words, return_inverse=True)
        ends = np.cumsum(sizes + 1) - 1  # of each sequence, where its separator is
        inside = np.ones(len(words) + many, bool)
        inside[ends] = False
        text = np.zeros(len(inside), np.int64)  # separators are 0, words from 1
        text[inside] = ids + 1
        self.text, self.ends, self.sizes = text, ends, sizes
        suffixes, apart = self._sorted(np.where(inside, text + many - 1, np.cumsum(~inside) - 1), int(sizes.max()) + 1)
        before = text[suffixes - 1]
        before[suffixes == 0] = 0
        self.wavelet = Wavelet(before, len(known) + 1)
        symbols = np.arange(len(known) + 1)
        counts = np.bincount(text, minlength=len(symbols))
        self.base = np.cumsum(counts) - counts - self.wavelet.down(symbols, np.zeros(len(symbols), np.int64))
        self.marks = Plane(apart)  # where the first `window` words of a suffix differ from those of the one before
        self.begin = np.flatnonzero(apart)
        self.end = np.r_[self.begin[1:], len(text)]
        self.least = np.minimum.reduceat(order[np.searchsorted(ends, suffixes)], self.begin)

    def _sorted(self, ranks: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array by doubling, separators ordered by place, and where the first `window` words change in it."""
        n, bits = len(ranks), int(ranks.max() + 1).bit_length()
        depth = max(1, min(62 // bits, self.window))
        key = np.zeros(n, np.int64)
        beyond = np.r_[ranks + 1, np.zeros(deepest + self.window, np.int64)]
        for i in range(depth):
            key = key << bits | beyond[i : i + n]
        shared = None
        while True:
            by = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[by] = np.cumsum(np.r_[True, key[by][1:] != key[by][:-1]])
            beyond = np.r_[rank, np.zeros(deepest + self.window, np.int64)]
            if depth <= self.window:
                shared = (rank, beyond[self.window - depth :][:n])
            if depth >= deepest:
                break
            key = rank * (n + 1) + beyond[depth : depth + n]
            depth *= 2
        apart = np.ones(n, bool)
        apart[1:] = (shared[0][by][1:] != shared[0][by][:-1]) | (shared[1][by][1:] != shared[1][by][:-1])
        return by, apart

    def statistics(self) -> np.ndarray:
        """For each window of each sequence, in order: the least order of a sequence that has it too."""
        by = np.argsort(-self.sizes, kind="stable")
        sizes, ends = self.sizes[by], self.ends[by]
        out = np.zeros(int((self.sizes - self.window + 1).sum()), np.int64)
        place = (np.cumsum(self.sizes - self.window + 1))[by]  # after each sequence's last window
        low, high = np.zeros(len(by), np.int64), np.full(len(by), len(self.text))
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step, "left"))  # the longer ones come first
            word = self.text[ends[:live] - 1 - step]
            both = self.base[word].repeat(2) + self.wavelet.down(word.repeat(2), np.c_[low[:live], high[:live]].reshape(-1))
            low, high = both[::2], both[1::2]
            if step + 1 >= self.window:
                group = self.marks.ones(low + 1) - 1
                out[place[:live] - 1 - (step + 1 - self.window)] = self.least[group]
                low, high = self.begin[group], self.end[group]
        return out


def _reported(batches):
    """Reads stretches (key, hash, seq, least) sorted by key, whole groups at a time; gives the least id of each of their windows."""

    def report(t: pa.Table) -> pa.RecordBatch:
        seqs = t.column("seq").combine_chunks()
        sizes = pc.binary_length(seqs).to_numpy().astype(np.int64) // CODE
        raw = np.frombuffer(b"".join(seqs.to_pylist()), np.uint8).reshape(-1, CODE)
        words = np.zeros((len(raw), 8), np.uint8)
        words[:, 8 - CODE :] = raw
        ids = t.column("least").combine_chunks()
        order = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
        one = np.zeros(order.max() + 1, np.int64)
        one[order] = np.arange(len(order))
        found = Index(words.view(">u8").reshape(-1).astype(np.int64), sizes, order).statistics()
        ends = np.r_[0, np.cumsum(sizes - WINDOW + 1)].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array(one[found])))
        return pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), t.column("hash").combine_chunks(), lists], ["key", "hash", "held"])

    held, words = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.table(batch.columns, ["key", "hash", "seq", "least"]))
        words += sum(map(len, batch.column(2).to_pylist())) // CODE
        if words >= SHARD:
            t = pa.concat_tables(held)
            key = t.column("key").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            if cut:
                yield report(t.slice(0, cut))
                t = t.slice(cut)
            held, words = [t], pc.sum(pc.binary_length(t.column("seq"))).as_py() // CODE
    if held:
        yield report(pa.concat_tables(held))


def _chunks(texts: list, most: int = CHUNK):
    """Runs of texts, as UTF-8 (null: empty), of about `most` bytes: (first, last + 1, texts)."""
    now, size, first = [], 0, 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        if now and size + len(data) > most:
            yield first, i, now
            now, size, first = [], 0, i
        now.append(data)
        size += len(data)
    if now:
        yield first, len(texts), now


def _marks():
    def step(batch):
        for first, last, texts in _chunks(batch.column(1).to_pylist()):
            words, own, _ = hashed(texts)
            grams, at, _ = stretches(words, own)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(batch.column(0).slice(first, last - first).to_numpy()[own[at]])], ["gram", "rid"])

    return step


def _dealt():
    """Stretches of the minimisers that are listed for a row: odd ones are frequent, and each of their windows is dealt by itself."""

    def step(batch):
        for first, last, texts in _chunks(batch.column(2).to_pylist()):
            listed = np.unique(batch.column(3).slice(first, last - first).flatten().to_numpy(zero_copy_only=False))
            words, own, place = hashed(texts)
            grams, at, many = stretches(words, own)
            if not len(grams) or not len(listed):
                continue
            hit = np.minimum(np.searchsorted(listed & ~1, grams), len(listed) - 1)
            known = (listed & ~1)[hit] == grams
            often = known & (listed[hit] & 1 == 1)
            known &= ~often
            each = many[often]
            single = np.repeat(at[often] - np.cumsum(each) + each, each) + np.arange(each.sum())
            key = np.r_[grams[known], _spans(words, single, single + WINDOW, _R).view(np.int64)]
            start = np.r_[at[known], single]
            size = np.r_[many[known], np.ones(len(single), np.int64)] + WINDOW - 1
            codes = words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
            inner = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            ends = np.r_[0, np.cumsum(size * CODE)].astype(np.int32)
            seq = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(codes[inner]).tobytes())])
            row = pa.array(own[start] + first)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(row), batch.column(1).take(row), pa.array(place[start].astype(np.int32)), seq], ["key", "id", "rid", "start", "seq"])

    return step


def covered(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(rid, windows): of each row (row_key) that has any, its windows that a document with a smaller id has too, as a list of
    start * 2 ** WINDOW + bits, bit b for the window that starts b words after start.

    Ids may be of any type that has an order, nulls come last; rows that repeat an id and a text are one, rows that repeat an id
    are none smaller than the other. A null text or one under WINDOW words has no windows; no rows for an empty table; other
    columns are not read. Words are told apart by 40 bits of a hash, minimisers by 63.

    What two rows share is found by partial aggregates, and joins that Spark can split: no task holds the rows of a frequent
    minimiser. A shard holds about SHARD words at every size."""
    bounded(docs.sparkSession)
    source = docs.select(col(id_col).alias("id"), row_key(id_col, text).alias("rid"), col(text).cast("string").alias("text")).filter(F.length("text") >= 2 * WINDOW - 1)
    kind = source.schema["id"].dataType.simpleString()
    marks = stored(map_arrow(source.select("rid", "text"), _marks, "gram long, rid long"))
    often = stored(marks.groupBy("gram").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.count("*").alias("n")).filter("a <> b").select("gram", "n"))
    listed = stored(marks.join(often, "gram").groupBy("rid").agg(F.collect_list(F.col("gram") + (F.col("n") > group).cast("long")).alias("at")))
    forget(marks, often)
    found = source.join(listed.hint("shuffle_hash"), "rid").select("id", "rid", "text", "at")
    dealt = stored(map_arrow(found, _dealt, f"key long, id {kind}, rid long, start int, seq binary"))
    forget(listed)
    once = dealt.groupBy("key", "seq").agg(F.min("id").alias("least")).select("key", F.xxhash64("seq").alias("hash"), "seq", "least")
    reported = stored(once.repartition("key").sortWithinPartitions("key").mapInArrow(_reported, f"key long, hash long, held array<{kind}>"))
    smaller = F.transform("held", lambda x, i: F.when(F.coalesce(x < F.col("id"), x.isNotNull()), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))
    rows = dealt.select("key", F.xxhash64("seq").alias("hash"), "id", "rid", "start").join(reported, ["key", "hash"])
    rows = rows.select("rid", "start", F.aggregate(smaller, F.lit(0).cast("long"), lambda a, x: a + x).alias("bits")).filter("bits <> 0")
    return rows.groupBy("rid").agg(F.collect_list(F.col("start") * (1 << WINDOW) + F.col("bits")).alias("windows"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: tuple[str, str, str] = ("n_words", "n_removed", "kept"), group: int = GROUP) -> DataFrame:
    """docs with the number of words, of removed ones, and the kept ones joined by single spaces.

    A word goes if a window that a document with a smaller id has too covers it; windows are judged on the input. Each row of
    docs has its row, null and empty texts too (no words). A column of docs that bears one of the names `out` stays, and the new
    one gets an underscore before its name. Of covered() the rest."""
    rid, windows = fresh(docs, "window_row", "window_list")
    spans = stored(covered(docs, id_col, text, group))
    rows = docs.withColumn(rid, row_key(id_col, text)).join(spans.select(F.col("rid").alias(rid), F.col("windows").alias(windows)), rid, "left").select(*map(col, docs.columns), windows)
    names, out = docs.columns, fresh(docs, *out)
    at = names.index(text)

    def make():
        def step(batch):
            n, gone, kept = [], [], []
            lists = batch.column(batch.num_columns - 1)
            for i, t in enumerate(batch.column(at).cast(pa.string()).to_pylist()):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if lists[i].is_valid:
                    packed = lists[i].values.to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    for b in range(WINDOW):
                        starts = (packed[packed >> b & 1 == 1] >> WINDOW) + b
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + WINDOW, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    gone.append(len(words) - int(stay.sum()))
                    words = compress(words, stay.tolist())
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*names, *out])

        return step

    schema = docs.select("*", *[F.lit(0).cast("long").alias(x) for x in out[:2]], F.lit("").alias(out[2])).schema
    return map_arrow(rows, make, schema)
