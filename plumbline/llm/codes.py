"""Vector codes: each vector is cut into parts, and each part goes by the nearest entry of a codebook of integers.

Codebooks are learnt by Lloyd's rounds in integers: the driver broadcasts them, tasks find all distances of an Arrow batch
at once (norms less twice a product of int64 matrices, all exact) and give sums and counts of each entry's parts, and a
grouped shuffle adds these up. All that comes to the driver in a round is a sum for each component of each entry."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, col, map_arrow, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components are under this in magnitude, so that sums of 2 ** 32 of them and squared distances in up to 256 dimensions are exact.
LIMIT = 1 << 26


def quantised(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v): the floors of the components times scale, without vectors that are null or hold a null or a non-finite component."""
    rows = vectors.select(col(id_col).alias("id"), col(label).alias("label"), col(column).cast("array<double>").alias("v")).filter("v is not null")
    rows = rows.filter(F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))))
    sound = lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"a component times {scale} is not under {LIMIT}: "), x.cast("string"))).cast("int"))
    return rows.withColumn("v", F.transform("v", sound))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row and its squared distance; all in int64."""
    far = (entries * entries).sum(1)[None, :] - 2 * (parts @ entries.T)
    code = far.argmin(1)
    return code, far[np.arange(len(parts)), code] + (parts * parts).sum(1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _first(rows: DataFrame, entries: int) -> np.ndarray | None:
    """The vectors of the least ids, nulls last; of several vectors of an id the least."""
    least = rows.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    return np.array([r.v for r in least], np.int64) if least else None


def _moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round; an entry without parts stays."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    shape = [b.shape for b in books]

    def run(batches):
        sums, counts = [np.zeros(s, np.int64) for s in shape], [np.zeros(s[0], np.int64) for s in shape]
        for batch in batches:
            if batch.num_rows:
                for p, part in enumerate(np.split(_matrix(batch.column(0)), len(shape), 1)):
                    code, _ = nearest(part, sent.value[p])
                    np.add.at(sums[p], code, part)
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
        for p, (total, n) in enumerate(zip(sums, counts, strict=True)):
            for e in np.flatnonzero(n):
                at = pa.array(range(total.shape[1]), pa.int32())
                same = lambda x, kind, m=len(at): pa.array(np.full(m, x), kind)
                yield pa.RecordBatch.from_arrays([same(p, pa.int32()), same(e, pa.int32()), at, pa.array(total[e]), same(n[e], pa.int64())], ["part", "entry", "place", "total", "n"])

    found = rows.select("v").mapInArrow(run, "part int, entry int, place int, total long, n long")
    found = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    sent.destroy()
    out = [b.copy() for b in books]
    for r in found:
        out[r.part][r.entry, r.place] = r.total // r.n
    return out


def learned(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, from quantised() rows, which each round reads: they should be stored. None if there are none."""
    first = _first(rows, entries)
    if first is None:
        return []
    if first.shape[1] % parts:
        raise ValueError(f"{first.shape[1]} components can't be cut into {parts} equal parts")
    books = np.split(first, parts, 1)
    for _ in range(rounds if first.shape[1] else 0):
        books = _moved(rows, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each vector, code as two hex digits for each part.

    error is the squared distance from the vector to what its code stands for, label_error its sum over equal labels. Vectors
    that are null or hold a null or a non-finite component are left out; ids may be of any type that has an order, null and
    repeated ones included: each row counts. With fewer ids than entries codebooks are that much shorter. A table without
    vectors gives no rows, vectors without components the code of zeros. Vectors of different lengths, lengths that parts do not
    divide and components of LIMIT / SCALE or more are errors. Other columns are not read."""
    bounded(vectors.sparkSession)
    rows = quantised(vectors, id_col, column, label)
    kinds = rows.schema
    rows = stored(rows)
    widths = [r.w for r in rows.select(F.size("v").alias("w")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {widths[0]} and {widths[1]}")
    books = learned(rows, parts, entries, rounds)
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def make():
        def step(batch):
            if not batch.num_rows:
                return
            codes, errors = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, part in enumerate(np.split(_matrix(batch.column(2)), parts, 1)):
                codes[:, p], far = nearest(part, sent.value[p])
                errors += far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], ["id", "label", "code", "error"])

        return step

    kind = lambda n: kinds[n].dataType.simpleString()
    coded = stored(map_arrow(rows, make, f"id {kind('id')}, label {kind('label')}, code string, error long"))
    totals = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))  # its size is known, so that Spark sends it where it is small
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
