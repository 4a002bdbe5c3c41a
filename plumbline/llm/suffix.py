"""Repeated passages by a sparse suffix array.

Words are runs without ASCII white space. Of all suffixes only those stay that start at a minimiser: the 16-gram of least
hash among the 35 of a 50-word window, so that equal windows keep the same suffix. Suffixes that share their first 16
words are sorted by what follows and compared with their neighbours; the common prefixes that this gives are extended to
the left. What repeats is every window of 50 words that occurs at another place too, in whichever document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, map_arrow, stored

WINDOW, GRAM = 50, 16
SIDE = WINDOW - GRAM  # words that a window has besides its 16-gram
#: Suffixes compared together in a task; a more frequent 16-gram is counted window by window instead.
GROUP = 1024
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
_POS = 30  # bits of a word's position beside a hash: a text of 2 GB, the most that Arrow takes, has fewer words

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_R, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)])


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of values[a:b] for each pair, by prefix sums of values times powers of an odd base, modulo 2 ** 64."""
    sums = np.r_[np.uint64(0), np.cumsum(values * _powers(base, len(values)))]
    return _mix((sums[ends] - sums[starts]) * _powers(_inverse(base), len(values) + 1)[starts])


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 text, in bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.r_[False, ~((raw == 32) | ((raw >= 9) & (raw <= 13))), False].astype(np.int8)
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: bytes) -> np.ndarray:
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    return _spans(_BYTE[np.frombuffer(data, np.uint8)], starts, ends, _R)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, least, most): the minimisers of all windows, and how many words before its position a window that
    has this minimiser starts, at least and at most. Ties take the leftmost."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    at = np.arange(len(words) - GRAM + 1)
    grams = _spans(words, at, at + GRAM, _Q)
    keys = (grams >> np.uint64(_POS) << np.uint64(_POS)) | at.astype(np.uint64)
    width = SIDE + 1
    block = np.r_[keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(block, 1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    place = (least & np.uint64((1 << _POS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], n] - 1
    pos = place[first]
    return grams[pos], pos, pos - last, pos - first


def _context(words: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SIDE words before each position, nearest first, and those after its 16-gram, as 32-bit hashes; 0 beyond the text."""
    short = np.r_[np.zeros(SIDE, np.uint32), (words >> np.uint64(32)).astype(np.uint32), np.zeros(SIDE, np.uint32)]
    return short[pos[:, None] + SIDE - 1 - np.arange(SIDE)], short[pos[:, None] + SIDE + GRAM + np.arange(SIDE)]


def _repeats(gram, order, rid, pos, least, most, left, right):
    """Rows must be sorted by gram and right. Returns (row, start, first row) of every window that another row has too."""
    rank = np.empty(len(gram), np.int64)
    rank[np.lexsort((pos, rid, order))] = np.arange(len(gram))
    apart = gram[1:] != gram[:-1]
    differ = np.c_[right[1:] != right[:-1], np.ones(len(apart), bool)]
    prefix = np.where(apart, -1, differ.argmax(1))  # words that neighbours share after their 16-grams
    reach = np.zeros(len(gram), np.uint64)
    found = []
    for o in range(SIDE + 1):  # windows that start o words to the left
        if o:
            reach = _mix(reach * _Q + left[:, o - 1] + np.uint64(1))
        rows = np.flatnonzero((least <= o) & (o <= most))
        if len(rows) > 1:
            run = np.cumsum(np.r_[0, prefix < SIDE - o]).astype(np.uint64)
            key = _mix(run[rows] * _R ^ reach[rows])
            rows = rows[by := np.lexsort((rank[rows], key))]
            key = key[by]
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[begins, len(key)])
            many = np.repeat(sizes > 1, sizes)
            found.append((rows[many], pos[rows[many]] - o, np.repeat(rows[begins], sizes)[many]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


SPANS = "doc long, rid long, lo long, hi long, first_doc long, first boolean"


def _compare(batches):
    """Reads suffixes sorted by gram and right context, whole groups at a time; gives runs of starts of repeated windows."""
    fields = ("gram", "order", "rid", "pos", "least", "most", "left", "right")

    def runs(t):
        order, rid, pos = t["order"], t["rid"], t["pos"]
        by = np.lexsort((pos, rid, order, t["gram"]))  # rows that repeat an id and a text count once
        twice = by[1:][(pos[by][1:] == pos[by][:-1]) & (rid[by][1:] == rid[by][:-1]) & (order[by][1:] == order[by][:-1]) & (t["gram"][by][1:] == t["gram"][by][:-1])]
        if len(twice):
            keep = np.ones(len(pos), bool)
            keep[twice] = False
            t = {k: v[keep] for k, v in t.items()}
            order, rid, pos = t["order"], t["rid"], t["pos"]
        row, start, first = _repeats(*(t[k] for k in fields))
        by = np.lexsort((start, rid[row], order[row]))
        row, start, first = row[by], start[by], first[by]
        own, of = row == first, order[first]
        new = np.flatnonzero(np.r_[True, (rid[row][1:] != rid[row][:-1]) | (order[row][1:] != order[row][:-1]) | (start[1:] != start[:-1] + 1) | (own[1:] != own[:-1]) | (of[1:] != of[:-1])][: len(row)])
        end = np.r_[new[1:], len(row)] - 1
        null = lambda x: pa.array(x, pa.int64(), mask=x == _LAST)
        if not len(row):
            new = end = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([null(order[row][new]), pa.array(rid[row][new]), pa.array(start[new]), pa.array(start[end]), null(of[new]), pa.array(own[new])], [x.split()[0] for x in SPANS.split(", ")])

    held: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        t = {k: col[k].to_numpy(zero_copy_only=False) for k in ("gram", "order", "rid", "pos", "least", "most")}
        for k in ("left", "right"):
            t[k] = np.frombuffer(b"".join(col[k].to_pylist()), ">u4").reshape(-1, SIDE).astype(np.uint32)
        held.append(t)
        if sum(len(x["gram"]) for x in held) >= 4 * GROUP:
            t = {k: np.concatenate([x[k] for x in held]) for k in t}
            cut = int(np.flatnonzero(np.r_[True, t["gram"][1:] != t["gram"][:-1]])[-1])
            if cut:
                yield runs({k: v[:cut] for k, v in t.items()})
            held = [{k: v[cut:] for k, v in t.items()}]
    if held:
        yield runs({k: np.concatenate([x[k] for x in held]) for k in held[0]})


def _merge(batches):
    """Reads runs sorted by doc, rid, first and lo; gives unions of their windows."""
    names = ["doc_id", "rid", "start_word", "end_word", "first", "first_doc_id"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    now = None
    for batch in batches:
        out = []
        for doc, rid, lo, hi, of, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and now[0] == doc and now[1] == rid and now[4] == first and lo <= now[3]:
                now[3] = max(now[3], hi + WINDOW)
                now[5] = min((x for x in (now[5], of) if x is not None), default=None)
            else:
                out += [now] * (now is not None)
                now = [doc, rid, lo, hi + WINDOW, first, of]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([now[i]], k) for i, k in enumerate(kinds)], names)


def row_key(id_col: str, text: str):
    return F.xxhash64(col(id_col), col(text))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, rid, start_word, end_word, first, first_doc_id): unions of the repeated windows of each document.

    Words count from 0, ends are exclusive. `first` marks the occurrence that comes first, by document id (nulls last) and
    place: what a deduplication keeps; the others are given apart. first_doc_id is the least id that holds the first
    occurrence of a window of the union; the id and rid (row_key) tell rows apart. Rows that repeat an id and a text count as
    one document; a null text or one under 50 words has no windows; no rows for an empty table; other columns are not read,
    whatever their names; a text may have any length that Arrow takes. Ids that are no whole numbers may be of any type that has
    an order: they are numbered first, in that order.

    A group of suffixes that share 16 words goes to a task whole, unless it has over `group` of them: then its windows are
    hashed and counted with partial sums, which a frequent passage does not overload."""
    if not isinstance(docs.schema[id_col].dataType, WHOLE):
        return _named(docs, id_col, text, group)
    source = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(_LAST)).alias("order"), row_key(id_col, text).alias("rid"), col(text).cast("string").alias("text"))

    def scan():
        def step(batch):
            grams, places = [], []
            for t in batch.column(2).to_pylist():
                g, p, _, _ = anchors(word_hashes((t or "").encode("utf-8", "surrogatepass")))
                grams.append(g.view(np.int64))
                places.append(p)
            own = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            order, rid = (batch.column(i).to_numpy(zero_copy_only=False)[own] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(grams), order, rid, np.concatenate(places))], ["gram", "order", "rid", "pos"])

        return lambda batch: step(batch) if batch.num_rows else ()

    marks = stored(map_arrow(source.filter(F.length("text") >= 2 * WINDOW - 1), scan, "gram long, `order` long, rid long, pos long"))
    often = stored(marks.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))  # written, so that both sides of the join are plain shuffles, which Spark can split
    # a position and whether its 16-gram is frequent, in one number: sets of numbers take a fraction of the memory of sets of rows
    chosen = marks.join(often, "gram").groupBy("order", "rid").agg(F.collect_set(F.col("pos") * 2 + (F.col("n") > group).cast("long")).alias("at"))

    def extend():
        seen: set[tuple[int, int]] = set()  # rows that repeat an id and a text meet in a task of the join: one of them is enough

        def step(batch):
            own = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = [not (x in seen or seen.add(x)) for x in own]
            if not all(new):
                batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                return
            orders, rids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found: list[list] = [[] for _ in range(8)]
            sides: list[list] = [[], []]
            for i, (t, at) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                words = word_hashes(t.encode("utf-8", "surrogatepass"))
                grams, pos, least, most = anchors(words)
                marked = np.sort(at.values.to_numpy(zero_copy_only=False))
                state = np.full(len(pos), -1)
                place = np.minimum(np.searchsorted(marked >> 1, pos), len(marked) - 1)
                known = marked[place] >> 1 == pos
                state[known] = marked[place[known]] & 1
                cold, often = np.flatnonzero(state == 0), np.flatnonzero(state == 1)
                for k, x in enumerate(_context(words, pos[cold])):
                    sides[k].append(x.astype(">u4"))
                sizes = most[often] - least[often] + 1  # the windows of a frequent 16-gram
                starts = np.repeat(pos[often] - most[often] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                windows = _spans(words, starts, starts + WINDOW, _R).view(np.int64)
                n, m = len(cold), len(starts)
                zero = np.zeros(m, np.int64)
                for k, x in enumerate((np.r_[np.zeros(n, np.int32), np.ones(m, np.int32)], np.r_[grams[cold].view(np.int64), windows], np.full(n + m, orders[i]), np.full(n + m, rids[i]), np.r_[pos[cold], starts], np.r_[least[cold], zero], np.r_[most[cold], zero])):
                    found[k].append(x)
                found[7].append(np.r_[np.zeros(n, bool), np.ones(m, bool)])
            none = np.concatenate(found[7])
            rows = [pa.array(np.concatenate(x), k) for x, k in zip(found[:7], [pa.int32(), *[pa.int64()] * 6], strict=True)]
            ends = np.r_[0, np.cumsum(~none) * (4 * SIDE)].astype(np.int32)
            valid = pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
            for x in sides:  # rows of windows have no context
                rows.append(pa.Array.from_buffers(pa.binary(), len(none), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.concatenate(x).tobytes())], int(none.sum())))
            yield pa.RecordBatch.from_arrays(rows, ["kind", "gram", "order", "rid", "pos", "least", "most", "left", "right"])

        return lambda batch, most=250: (x for at in range(0, batch.num_rows, most) for x in step(batch.slice(at, most)))

    fields = "kind int, gram long, `order` long, rid long, pos long, least long, most long, left binary, right binary"
    # the positions of a partition's documents are hashed, so that the texts pass by them without a sort
    suffixes = stored(map_arrow(source.join(chosen.hint("shuffle_hash"), ["order", "rid"]).select("order", "rid", "text", "at"), extend, fields))
    few = suffixes.filter("kind = 0").drop("kind").repartition("gram").sortWithinPartitions("gram", "right").mapInArrow(_compare, SPANS)
    hot = suffixes.filter("kind = 1").select("gram", "order", "rid", "pos")
    place = F.struct("order", "rid", "pos")
    counted = stored(hot.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b"))
    id_of = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    many = hot.join(counted.select("gram", "a"), "gram").select(
        id_of("order").alias("doc"), "rid", F.col("pos").alias("lo"), F.col("pos").alias("hi"), id_of("a.order").alias("first_doc"), (place == F.col("a")).alias("first")
    )
    runs = few.unionAll(many).repartition("doc", "rid").sortWithinPartitions("doc", "rid", "first", "lo")
    return runs.mapInArrow(_merge, "doc_id long, rid long, start_word long, end_word long, first boolean, first_doc_id long")


def _named(docs: DataFrame, id_col: str, text: str, group: int) -> DataFrame:
    """repeated_passages for ids of other types, by their numbers in order: partitions of ids sorted by range, and counts of those before."""
    ids = stored(docs.select(col(id_col).alias("id")).filter("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()))
    name = fresh(docs, "passage_order")[0]
    known = docs.select(col(id_col).alias("id"), col(text).alias("text"), row_key(id_col, text).alias("key")).join(ids, "id", "left").select(F.col("at").alias(name), "text", "key")
    found = repeated_passages(known.select(F.col(name), "text"), name, "text", group)
    keys = known.select(F.coalesce(name, F.lit(_LAST)).alias("order"), row_key(name, "text").alias("rid"), "key").distinct()
    first = ids.select(F.col("id").alias("first_id"), F.col("at").alias("first_doc_id"))
    named = found.join(ids.withColumnRenamed("at", "doc_id"), "doc_id", "left").join(first, "first_doc_id", "left")
    named = named.withColumn("order", F.coalesce("doc_id", F.lit(_LAST))).join(keys, ["order", "rid"])
    return named.select(F.col("id").alias("doc_id"), F.col("key").alias("rid"), "start_word", "end_word", "first", F.col("first_id").alias("first_doc_id"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space that follows them."""
    data = text.encode("utf-8", "surrogatepass")
    starts, _ = word_bounds(data)
    starts = np.r_[starts, len(data)]
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = int(starts[a]), int(starts[b])
        if b > at:
            out.append(data[at : max(a, at)])
            at = max(b, at)
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def removable(spans: list[tuple[int, int, bool, bool]]) -> list[tuple[int, int]]:
    """Word ranges to remove, of spans (start, end, first, own): all that are not first; of those whose first occurrence is in
    the same document (own), which may overlap it, only what no first one covers."""
    firsts = sorted((a, b) for a, b, first, _ in spans if first)
    out = []
    for a, b, first, own in spans:
        if first:
            continue
        for x, y in firsts if own else ():
            if a < x < b:
                out.append((a, x))
            if x < b and y > a:
                a = max(a, min(y, b))
        if a < b:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the repeated passages that an earlier document, or an earlier place, holds already.

    A document of which no word is left goes; all others stay, with what is left of their text: null and empty texts, and texts under
    50 words, as they are. Rows that repeat an id and a text are one document, cut alike; ids and long texts as in
    repeated_passages; an empty table stays empty. Columns and their order stay."""
    names = docs.columns
    key, rid, spans = fresh(docs, "passage_id", "passage_row", "passage_spans")
    found = repeated_passages(docs, id_col, text)
    own = F.coalesce(F.col("first_doc_id").eqNullSafe(F.col("doc_id")), F.lit(False))
    cuts = found.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start_word", "end_word", "first", own.alias("own"))).alias(spans), F.min("first").alias("f")).filter("not f")
    cuts = cuts.select(F.xxhash64("doc_id").alias(key), F.col("rid").alias(rid), spans)
    if isinstance(docs.schema[id_col].dataType, WHOLE):
        told = F.xxhash64(col(id_col).cast("long"))
    else:
        told = F.xxhash64(col(id_col))
    rows = docs.withColumns({key: told, rid: row_key(id_col, text)}).join(cuts, [key, rid], "left").select(*map(col, names), spans)
    at = names.index(text)

    def make():
        def step(batch):
            texts, keep = batch.column(at).to_pylist(), []
            for i, s in enumerate(batch.column(len(names)).to_pylist()):
                if s:
                    texts[i] = cut(texts[i], removable([(x["start_word"], x["end_word"], x["first"], x["own"]) for x in s]))
                keep.append(not s or texts[i].strip() != "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1]], names).filter(pa.array(keep, pa.bool_()))

        return step

    return map_arrow(rows, make, docs.schema)
