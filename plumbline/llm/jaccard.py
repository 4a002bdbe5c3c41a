"""Near duplicates by the Jaccard similarity of word shingles: all pairs of documents at or over 4/5, exactly.

SimHash fingerprints of the shingles, linked by multi-index hashing, propose the closest pairs. At similarity 0.8 two
fingerprints are ten of 64 bits apart on average, and a radius that holds them all holds most of a large table; so prefix
filtering (Chaudhuri et al., "A primitive operator for similarity joins"; Bayardo et al., "Scaling up all pairs similarity
search") proposes the rest: under any one order of all shingles, two sets of similarity 4/5 share one of the first n // 5 + 1
of each. Here common shingles come last, by a sample that decides the cost but never the result. Every set has a bitmap of its
shingles (Sandes et al., "Bitmap filter"): the bits in which two differ bound from below how many shingles they do not
share, and pairs that can't reach 4/5 are never listed; sets of over 512 shingles have a sample of them in the bitmap, with a
margin that a similar pair exceeds with a chance under 1e-9. Of those that can, a first round lists a forest that connects the
sets which meet at a shingle; the second lists the pairs that verified links of the first have not connected. Both are
verified on complete sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, forget, fresh, map_arrow, quoted, stored
from .components import components
from .simhash import links

SHINGLE = 5
#: Documents sampled for common shingles, of how many of them a common one is part, and the most that are remembered.
SAMPLE, COMMON, REMEMBERED = 10_000, 5, 200_000
#: Sets that meet at a shingle and are compared in one task; more are dealt to blocks, and in the end to pairs of blocks.
BLOCK = 4096
#: Bits of a set's bitmap, and shingles in it; of a larger set a sample by hash goes in.
BITMAP, DENSE = 2048, 512
#: Standard deviations by which a sample of a similar pair may lie off its mean: a chance under 1e-9 for each pair.
SURE = 6.5
#: Ids of sets a task remembers so as not to send the prefix of a copy again.
SEEN = 500_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one shingle, of none it has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as simhash.fingerprint
    if not words:
        return np.empty(0, np.int64)
    size = min(size, len(words))
    digest, joined, starts, at = xxhash.xxh64_intdigest, b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    return np.unique(np.fromiter((digest(joined[a : b - 1]) for a, b in zip(starts, starts[size:], strict=False)), np.uint64).view(np.int64))


def _id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63) if len(found) else 0


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def _common(source: DataFrame, size: int) -> np.ndarray:
    every = max(1, source.count() // SAMPLE)

    def make():
        def step(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *(shingles(t, size) for t in batch.column(0).to_pylist())]), pa.int64())], ["s"])

        return step

    some = source.filter(F.pmod(F.xxhash64(*map(col, source.columns)), F.lit(every)) == 0).select(source.columns[-1])
    often = map_arrow(some, make, "s long").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    return np.array(sorted(r.s for r in often.orderBy(F.desc("n"), "s").limit(REMEMBERED).collect()), np.int64)


def _fingerprint(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65536):
        ones += np.unpackbits(found[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


def _sampled(n):
    """Of sets of n shingles, one shingle in so many goes into the bitmap: a power of two that leaves DENSE or fewer."""
    return 1 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / DENSE))).astype(np.int64)


def _bitmap(found: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP, bool)
    bits[(found[(found >> 32) & (_sampled(len(found)) - 1) == 0]) & (BITMAP - 1)] = True
    return np.packbits(bits).tobytes()


def _with_sets(source: DataFrame, keys: list[str], common: np.ndarray, size: int) -> DataFrame:
    """The keys, th (hash of the text), fp (id of the set), n (its size), sh (its SimHash), bits (its bitmap) and prefix; the
    last two are empty if the task has sent those of an equal set."""
    fields = ", ".join(f"{quoted(k)} {source.schema[k].dataType.simpleString()}" for k in keys)

    def make():
        seen = set()

        def step(batch):
            ids, sizes, prints, maps, prefixes = [], [], [], [], []
            for t in batch.column(len(keys) + 1).to_pylist():
                found = shingles(t, size)
                ids.append(_id(found))
                sizes.append(len(found))
                prints.append(_fingerprint(found))
                if ids[-1] in seen or not len(found):
                    prefixes.append(found[:0])
                    maps.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(ids[-1])
                late = common[np.searchsorted(common, found) % max(1, len(common))] == found if len(common) else np.zeros(len(found), bool)
                prefixes.append(np.concatenate([found[~late], found[late]])[: len(found) // 5 + 1])
                maps.append(_bitmap(found))
            rest = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(maps, pa.binary()), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], *rest], [*keys, "th", "fp", "n", "sh", "bits", "prefix"])

        return step

    plain = source.columns[-1]
    return map_arrow(source.select(*map(col, keys), F.xxhash64(plain).alias("th"), plain), make, f"{fields}, th long, fp long, n long, sh long, bits binary, prefix array<long>")


def _runs(batches, keys: int = 1):
    """The columns of rows sorted by the first `keys`, cut so that no run of equal ones is broken, and where the runs begin and end."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        bounds = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in held[:keys]], axis=0)])
        cut = int(bounds[-1])
        if cut:
            done, held = [c[:cut] for c in held], [c[cut:] for c in held]
            yield done, bounds[:-1], bounds[1:]
    if held is not None:
        yield held, np.array([0]), np.array([len(held[0])])


def _shared(batches):
    """Of rows (key, fp, n) sorted by key and fp, each once and only those of keys that several sets have."""
    for (keys, fps, ns), _, _ in _runs(batches):
        once = np.r_[True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])]
        keys, fps, ns = keys[once], fps[once], ns[once]
        same = keys[1:] == keys[:-1]
        many = np.r_[False, same] | np.r_[same, False]
        yield pa.RecordBatch.from_arrays([pa.array(x[many], pa.int64()) for x in (keys, fps, ns)], ["key", "fp", "n"])


def _meet(forest: bool):
    """Reads rows (key, lo, hi, own, fp, n, root, bits) sorted by the first three; gives candidates (u, v): pairs of different
    roots whose bitmaps allow the similarity, one of block lo and one of block hi. All of a run, or with `forest` as few as
    connect the same sets."""

    def run(batches):
        for (_, lo, hi, block, fps, ns, roots, maps), starts, ends in _runs(batches, 3):
            out, rows = [], 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if (roots[a:b] == roots[a]).all():
                    continue
                bits = np.frombuffer(b"".join(maps[a:b]), np.uint64).reshape(b - a, -1)
                fp, n, root, part = fps[a:b], ns[a:b], roots[a:b], block[a:b]
                every = _sampled(n)
                left, queue = np.arange(1, b - a), [0]
                while len(left):
                    if not queue:  # the next tree, or all others that come later
                        queue, left = [left[0]], left[1:]
                    i = queue.pop()
                    most = (n[left] + n[i]) // 9  # shingles that are not in both sets
                    coarse = np.maximum(every[left], every[i])
                    # of differently sampled sets, only what the coarser has alone
                    apart = np.where((every[left] >= coarse)[:, None], bits[left] & ~bits[i], 0) | np.where((every[i] >= coarse)[:, None], bits[i] & ~bits[left], 0)
                    bound = np.where(coarse > 1, most / coarse + SURE * np.sqrt(most / coarse) + 3, most)
                    fit = (np.bitwise_count(apart).sum(1, dtype=np.int64) <= bound) & (np.abs(n[left] - n[i]) <= most) & (root[left] != root[i])
                    if lo[a] != hi[a]:
                        fit &= part[left] != part[i]
                    found = left[fit]
                    if len(found):
                        out.append((np.minimum(fp[found], fp[i]), np.maximum(fp[found], fp[i])))
                        rows += len(found)
                    if forest:
                        reached = fit | (root[left] == root[i])
                        queue += left[reached].tolist()
                        left = left[~reached]
                    if rows > 50_000:
                        yield _batch(out)
                        out, rows = [], 0
            if out:
                yield _batch(out)

    return run


def _batch(parts):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], ["u", "v"])


def _alike(batches):
    """Of rows (u, v, a, b) the (u, v) whose sets a and b have a Jaccard similarity of 4/5 or more: 9 |a & b| >= 4 (|a| + |b|)."""
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        good = [9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)) for x, y in ((a[i].values.to_numpy(), b[i].values.to_numpy()) for i in range(batch.num_rows))]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _verified(pairs: DataFrame, rows: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """Of candidates (u, v), repeats included, the pairs at or over 4/5."""
    near = stored(pairs.distinct())
    ids = stored(near.select(F.col("u").alias("fp")).unionAll(near.select(F.col("v").alias("fp"))).distinct())
    texts = stored(rows.join(ids, "fp", "left_semi").groupBy("fp").agg(F.min("th").alias("th")))  # one text of each set

    def make():
        def step(batch):
            found = [shingles(t, size) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_id, found), pa.int64()), _lists(found)], ["fp", "s"])

        return step

    plain = source.columns[-1]
    wanted = source.select(plain, F.xxhash64(plain).alias("th")).join(texts.select("th"), "th", "left_semi").select(plain)
    sets = stored(map_arrow(wanted, make, "fp long, s array<long>").dropDuplicates(["fp"]))
    both = near.join(sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v")
    out = stored(both.select("u", "v", "a", "b").mapInArrow(_alike, "u long, v long"))
    forget(near, ids, texts, sets)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keys: list[str] | None = None, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row for each document: its key columns, fp long (an id of its set of shingles) and component_id, the least id
    reachable over pairs of similarity 4/5 or more.

    Nulls, texts without words, null ids and repeated rows as in simhash.near_duplicates. Sets, not documents, are compared.
    Sets that share a shingle of their prefixes are compared where they meet, at most `block` in a task in the first round
    and pairs of such blocks in the second."""
    keys = keys or [id_col]
    (plain,) = fresh(docs, "text_to_compare")
    source = docs.select(*map(col, keys), col(text).cast("string").alias(plain))
    rows = stored(_with_sets(source, keys, _common(source, size), size))
    met = rows.select(F.explode("prefix").alias("key"), "fp", "n")
    met = stored(met.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_shared, "key long, fp long, n long"))
    sets = stored(rows.filter("bits is not null").groupBy("fp").agg(F.first("bits").alias("bits"), F.first("sh").alias("sh")))  # equal sets have equal ones

    def candidates(roots: DataFrame, forest: bool) -> DataFrame:
        rest = met.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        counts = rest.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("a"), F.max("root").alias("z")).filter("a <> z")
        counts = stored(counts.select("key", F.ceil(F.col("c") / block).alias("blocks")))
        rest = rest.join(counts, "key").join(sets.select("fp", "bits"), "fp")
        rest = rest.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
        if forest:
            rest = rest.withColumns({"lo": F.col("own"), "hi": F.col("own")})
        else:
            rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            rest = rest.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        run = ["key", "lo", "hi"]
        return rest.select(*run, "own", "fp", "n", "root", "bits").repartition(*run).sortWithinPartitions(*run, "fp").mapInArrow(_meet(forest), "u long, v long")

    # fingerprints: the least set of each stands for it, and is linked to the others and to those of linked ones
    least = stored(sets.groupBy("sh").agg(F.min("fp").alias("least")))
    close = links(least.select(F.col("sh").alias("fp")))
    of = lambda c: least.select(F.col("sh").alias(c), F.col("least").alias(f"least_{c}"))
    proposed = close.join(of("u"), "u").join(of("v"), "v").select(F.least("least_u", "least_v").alias("u"), F.greatest("least_u", "least_v").alias("v"))
    proposed = proposed.unionAll(sets.join(least, "sh").filter("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v")))
    none = met.select("fp", F.col("fp").alias("root")).limit(0)
    edges = _verified(proposed.unionAll(candidates(none, True)), rows, source, size)
    parts = stored(components(edges).withColumnRenamed("id", "fp"))
    more = _verified(candidates(parts, False), rows, source, size)
    parts = components(edges.unionAll(more)).withColumnRenamed("id", "fp")
    fps = rows.groupBy("fp").agg(F.min(col(id_col)).alias("least"))
    labelled = stored(fps.join(parts, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(labelled.join(least, "root").select("fp", "component_id"), "fp").select(*map(col, keys), "fp", "component_id")
