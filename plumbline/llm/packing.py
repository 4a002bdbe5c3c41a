"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Within a shard documents come by falling length. Open bins stand in order of their residual room; the search starts at the
least residual that suffices and goes on through its successors until a bin is compatible, which is the tightest one. A
bin carries bitmaps of its sources, one for each occurrence that is allowed, and of its duplicate clusters."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, col
from .simhash import near_duplicates

CAPACITY, PER_SOURCE, SHARD = 2048, 2, 4096


class Packer:
    """Bins of one shard. Sources and clusters are any hashable values; None never conflicts."""

    def __init__(self, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []  # (residual, bin), sorted
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.bits: tuple[dict, dict] = ({}, {})

    def _bit(self, which: int, value) -> int:
        return 0 if value is None else 1 << self.bits[which].setdefault(value, len(self.bits[which]))

    def add(self, length: int, source=None, cluster=None) -> tuple[int, int]:
        """(bin, offset) of a document of 1 to capacity tokens."""
        if not 1 <= length <= self.capacity:
            raise ValueError("a document has 1 to capacity tokens; longer ones are cut into pieces")
        s, c = self._bit(0, source), self._bit(1, cluster)
        at = bisect_left(self.open, (length, -1))
        while at < len(self.open):
            room, k = self.open[at]
            if not self.clusters[k] & c and not self.sources[k][-1] & s:
                del self.open[at]
                break
            at += 1
        else:
            room, k = self.capacity, len(self.clusters)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        planes = self.sources[k]
        for i in range(self.per_source - 1, 0, -1):
            planes[i] |= planes[i - 1] & s
        planes[0] |= s
        self.clusters[k] |= c
        if room > length:
            insort(self.open, (room - length, k))
        return k, self.capacity - room


def _pack(capacity: int, per_source: int, shard_rows: int):
    """Reads pieces sorted by shard and falling length. A shard that hashing has overfilled is packed in parts of twice its size."""

    def run(batches):
        shard, packer, rows, base = None, None, 0, 0
        for batch in batches:
            ids, offsets = [], []
            for s, length, source, cluster in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != shard:
                    shard, packer, rows, base = s, Packer(capacity, per_source), 0, 0
                elif rows == 2 * shard_rows:
                    base += len(packer.clusters)
                    packer, rows = Packer(capacity, per_source), 0
                rows += 1
                if not length:
                    ids.append(None)
                    offsets.append(None)
                    continue
                k, at = packer.add(length, source, cluster)
                ids.append((s << 26) + base + k)
                offsets.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], batch.column(1), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names[4:], "n_tokens", "bin_id", "bin_offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, bin_offset): where each piece of each document lies. Tokens are words.

    A document longer than a bin is cut: its first pieces fill bins of their own, its rest is packed like any other. In a bin
    at most `per_source` documents share a source and none shares a duplicate cluster: a value of the column `cluster`, or else
    the documents whose SimHash fingerprints are linked (simhash.near_duplicates), copies among them. Null sources and null
    clusters never conflict. A document without words has one piece of 0 tokens and no bin. A null id and repeated rows are
    packed like others (copies of a cluster); an empty table gives no rows; other columns are not read.

    Shards are dealt by a hash of the row, with a number for each copy of equal rows, and hold about `shard_rows` documents at
    every size of the input, so that a source, cluster or row with a third of all rows is spread over all of them."""
    words = F.size(F.filter(F.split(col(text).cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    given = [] if cluster is None else [F.xxhash64(col(cluster).cast("string")).alias("cluster"), col(cluster).isNull().alias("alone")]
    rows = docs.select(col(id_col).alias("id"), col(source).cast("string").alias("source"), F.when(col(text).isNull(), 0).otherwise(words).cast("long").alias("n"), *given, col(text).cast("string").alias("text"))
    if cluster is None:
        near = near_duplicates(rows, "id", "text", keys=["id", "source", "n"])
        # component_id is null only where all ids of a component are; then its fingerprint names the copies
        rows = near.select("id", "source", "n", F.xxhash64("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).alias("cluster"))
    else:
        rows = rows.select("id", "source", "n", F.when(~F.col("alone"), F.col("cluster")).alias("cluster"))
    # equal rows are counted before they are dealt, and then dealt one by one
    rows = rows.groupBy("id", "source", "n", "cluster").agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    shards = max(1, -(-docs.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "source", "n", "cluster", "copy"), F.lit(shards)).cast("long"))
    last = F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / capacity)).otherwise(0).cast("int")
    pieces = rows.withColumn("last", last).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("last"))))
    whole = F.col("piece") < F.col("last")
    pieces = pieces.select(
        "shard", F.when(whole, capacity).otherwise(F.col("n") - F.col("last") * capacity).cast("long").alias("length"),
        F.when(~whole, F.col("source")).alias("source"), F.when(~whole, F.col("cluster")).alias("cluster"), "id", "piece", "copy",
    )
    kind = pieces.schema["id"].dataType.simpleString()
    order = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "id", "source", "cluster", "piece", "copy").drop("copy")
    bounded(docs.sparkSession)
    out = order.mapInArrow(_pack(capacity, per_source, shard_rows), f"id {kind}, piece int, n_tokens long, bin_id long, bin_offset long")
    return out.select(F.col("id").alias(id_col), "piece", "n_tokens", "bin_id", "bin_offset")
