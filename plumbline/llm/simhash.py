"""SimHash near-duplicate detection with multi-index hashing (Norouzi et al., "Fast exact search in Hamming space").

A 64-bit fingerprint has two segments of 32 bits. Two fingerprints at most 3 bits apart differ by at most one bit in one
of them, so the Hamming ball of radius 1 around a segment reaches the other's segment. Of each ball only the values with
one bit more are listed (17 rows for a segment, on average): for a pair that differs by a bit, one side lists the other.
Rows that meet at a value are verified by their complete distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, map_arrow, quoted, settled, stored
from .components import components

SEED, BITS = 42, 3
#: Fingerprints compared within one value of a segment; more are dealt out anew by the quarters of the other segment.
RUN = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash, as a signed long, of a text's word shingles; 0 if there are no words or the text is null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536].tolist(), (ends[size - 1 :][at : at + 65536] - 1).tolist(), strict=True)]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """The key columns and fp long."""
    (plain,) = fresh(docs, "text_to_hash")
    source = docs.select(*map(col, keys), col(text).cast("string").alias(plain))
    fields = ", ".join(f"{quoted(k)} {source.schema[k].dataType.simpleString()}" for k in keys)

    def make():
        def step(batch):
            fps = [fingerprint(t, shingle) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(fps, pa.int64())], [*keys, "fp"])

        return step

    return map_arrow(source, make, f"{fields}, fp long")


def _ball(value, low: int, bits: int):
    """A segment's value and, for each of its zero bits, the value with that bit set."""
    return F.expr(f"filter(transform(sequence(-1, {bits - 1}), i -> if(i < 0, {value}, if((shiftright({value}, i) & 1) = 0, {value} | shiftleft(1L, i), null))), x -> x is not null)")


def _linked(fps: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """A star for each set of fingerprints that links hold together, found breadth first, each compared with those not reached yet."""
    roots, leaves, left = [], [], np.unique(fps)
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= bits  # of signed numbers it counts the absolute value
            if near.any():
                found = left[near]
                left = left[~near]
                queue += list(found)
                roots += [int(root)] * len(found)
                leaves += found.tolist()
    return roots, leaves


def _meet(bits: int, most: int):
    """Reads rows (key, fp) sorted by key; gives edges (0, u, v), or (1, key, fp) for the rows of runs longer than most."""

    def run(batches):
        key, held, over = None, [], False  # the run that the last batch broke off

        def closed(fps):
            return _linked(np.concatenate(fps), bits)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            kinds, us, vs = [], [], []

            def edges(u, v, kind=0):
                kinds.extend([kind] * len(u))
                us.extend(u)
                vs.extend(v)

            alone = ends - starts == 1
            alone[0] = alone[-1] = False
            for a, b in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
                k, part = int(keys[a]), fps[a:b]
                if k != key:
                    if held and not over:
                        edges(*closed(held))
                    key, held, over = k, [], False
                held.append(part)
                if over or sum(map(len, held)) > most:
                    rows = np.concatenate(held)
                    edges([k] * len(rows), rows.tolist(), 1)
                    held, over = [], True
                elif b < len(keys):
                    edges(*closed(held))
                    key, held = None, []
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["kind", "u", "v"])
        if held and not over:
            u, v = closed(held)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(u), pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["kind", "u", "v"])

    return run


def links(fps: DataFrame, bits: int = BITS, run: int = RUN) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints `fp` just as all pairs at most `bits` (3 or fewer) apart do.

    A value at which more than `run` fingerprints meet is dealt out again by the balls of the two 16-bit quarters of the
    other segment (at most 3 bits differ there too). What meets there shares 48 bits but for two balls, of 33 and 17 values:
    a run has at most 33 x 17 x 2 ** 16 distinct fingerprints whatever the input."""
    if bits > 3:
        raise ValueError("two segments with balls of radius 1 reach 3 bits")
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    keyed = fps.select("fp", F.explode(F.concat(F.transform(_ball(f"({low})", 0, 32), lambda x: x), F.transform(_ball(f"({high})", 0, 32), lambda x: x + F.lit(1 << 32)))).alias("key")).select("key", "fp")
    met = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(bits, run), "kind int, u long, v long"))
    other = f"if(u >= 4294967296L, {low}, {high})"
    hot = met.filter("kind = 1").select("u", F.col("v").alias("fp")).withColumn("w", F.expr(other))
    quarters = F.concat(F.transform(_ball("(w & 65535L)", 0, 16), lambda x: x), F.transform(_ball("shiftrightunsigned(w, 16)", 0, 16), lambda x: x + F.lit(65536)))
    again = hot.select("u", "fp", F.explode(quarters).alias("q")).select(F.expr("u * 131072L + q").alias("key"), "fp")
    more = again.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(bits, 1 << 40), "kind int, u long, v long")
    return met.filter("kind = 0").select("u", "v").unionAll(more.select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = BITS, keys: list[str] | None = None) -> DataFrame:
    """One row for each document: its key columns, fp long and component_id, the least id reachable over links.

    Fingerprints, not documents, are compared: copies share one and cost nothing more. A null text or one without words
    has fingerprint 0 and is linked like any other; a null id keeps its row and takes the least id of its component, if any;
    repeated rows stay repeated; an empty table gives no rows; other columns are not read."""
    keys = keys or [id_col]
    rows = stored(with_fingerprints(docs, keys, text, shingle))
    fps = rows.groupBy("fp").agg(F.min(col(id_col)).alias("least"))
    parts = components(links(fps.select("fp"), bits))
    labelled = fps.join(parts.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = stored(labelled)
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(labelled.join(least, "root").select("fp", "component_id"), "fp").select(*map(col, keys), "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", near=near_duplicates) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the least id, of repeated rows one. `near` finds
    the groups and gives rows as near_duplicates does.

    A group whose ids are all null keeps one of its rows. Columns and their order stay. Texts are joined with the rows that
    go, which are fewer than those that stay, and Spark knows how many: it moves the texts only if they are too many to send."""
    names = list(map(col, docs.columns))
    keyed = docs.select(*names, col(id_col).alias(at := fresh(docs, "near_id")[0]), F.xxhash64(*names).alias(r := fresh(docs, "near_row")[0]), F.xxhash64(F.lit(1), *names).alias(r2 := fresh(docs, "near_row2")[0]))
    row = [r, r2]
    found = settled(lambda: near(keyed, at, text, keys=[at, *row]))
    # component_id is null only where all ids of a component are; then each fingerprint is a group
    found = found.withColumn("g", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))))
    best = found.groupBy("g").agg(F.min(F.struct(F.col(at).isNull().alias("n"), F.col(at).alias("i"), F.col(r).alias("r"), F.col(r2).alias("r2"))).alias("b"))
    best = stored(best.select("g", F.col("b.r").alias("a"), F.col("b.r2").alias("b")))  # both sides are then plain shuffles, which Spark can split
    marked = found.join(best, "g").select(F.col(r).alias("r"), F.col(r2).alias("r2"), ((F.col(r) == F.col("a")) & (F.col(r2) == F.col("b"))).alias("best"))
    # by the first hash alone unless different rows share it: what texts are joined with is then 8 bytes for each row that goes
    each = marked.groupBy("r", "r2").agg(F.count("*").alias("n"), F.max("best").alias("best"))
    odd = each.groupBy("r").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.min("best").alias("b"), F.collect_list(F.when(F.col("best"), F.col("r2"))).alias("kept")).filter("k > 1 or n > 1 or not b")
    odd = stored(odd.select(F.col("r").alias(r), "kept"))
    gone = stored(odd.select(r))
    again = odd.select(r, F.explode("kept").alias(r2))  # repeated rows, and rows whose hash another one shares
    once = keyed.join(again, row, "left_semi").dropDuplicates(row)
    return keyed.join(gone, r, "left_anti").select(*names).unionAll(once.select(*names))
