"""A quality classifier: a byte-level convolutional network in numpy.

Filters of 8 bytes step 2 bytes through the whole text. Each is max-pooled over overlapping chunks of 512 bytes; the mean, the
maximum and the minimum over all chunks, of each filter, give one probability by a logistic layer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, map_arrow

WIDTH, FILTERS = 8, 16
BLOCK = 64  # filter positions (2 bytes each) of a block; a chunk has 4 blocks and the next begins 3 blocks on
CHUNK, STEP = 4, 3
#: Labelled documents the network is fitted on at most, and characters of all of them.
TRAIN_DOCS, TRAIN_CHARS = 5000, 100_000_000


def _pairs(text: str | None) -> np.ndarray:
    """Byte pairs of a text, with zero bytes up to whole chunks and the last filter's width."""
    data = (text or "").encode("utf-8", "surrogatepass")
    pairs = -(-len(data) // 2)
    chunks = max(0, -(-(pairs - CHUNK * BLOCK) // (STEP * BLOCK))) + 1
    total = ((chunks - 1) * STEP + CHUNK) * BLOCK + WIDTH // 2 - 1
    raw = np.frombuffer(data.ljust(2 * total, b"\0"), np.uint8).reshape(-1, 2)
    return raw[:, 0].astype(np.int32) * 256 + raw[:, 1]


class Network:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"w": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), "b": np.zeros(FILTERS, np.float32), "v": rng.normal(0, 0.2, 3 * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}

    def tables(self) -> np.ndarray:
        """What each pair of bytes adds, at each of a filter's pair positions: [WIDTH / 2, 65536, FILTERS]."""
        w = self.p["w"]
        return (w[0::2, :, None, :] + w[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)

    def pooled(self, pairs: np.ndarray, tables: np.ndarray, places: bool = False):
        """Chunk maxima [chunks, FILTERS], and with places where they are."""
        n = len(pairs) - WIDTH // 2 + 1
        blocks, at = [], []
        for a in range(0, n, 64 * BLOCK):  # in parts that stay in the cache
            part = pairs[a : min(n, a + 64 * BLOCK) + WIDTH // 2 - 1]
            m = len(part) - WIDTH // 2 + 1
            out = tables[0].take(part[:m], 0)
            for j in range(1, WIDTH // 2):
                out += tables[j].take(part[j : j + m], 0)
            out = out.reshape(-1, BLOCK, FILTERS)
            if places:
                k = out.argmax(1)
                at.append(k + a + np.arange(len(out))[:, None] * BLOCK)
                blocks.append(np.take_along_axis(out, k[:, None], 1)[:, 0])
            else:
                blocks.append(out.max(1))
        top = np.concatenate(blocks)
        windows = np.lib.stride_tricks.sliding_window_view(top, CHUNK, 0)[::STEP]
        if not places:
            return windows.max(2)
        k = windows.argmax(2)
        where = np.lib.stride_tricks.sliding_window_view(np.concatenate(at), CHUNK, 0)[::STEP]
        return np.take_along_axis(windows, k[..., None], 2)[..., 0], np.take_along_axis(where, k[..., None], 2)[..., 0]

    def logit(self, chunks: np.ndarray) -> float:
        h = np.maximum(chunks + self.p["b"], 0)
        return float(np.r_[h.mean(0), h.max(0), h.min(0)] @ self.p["v"] + self.p["c"][0])

    def score(self, text: str | None, tables: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.pooled(_pairs(text), tables)), -30, 30))))

    def fit(self, texts: list[str], labels: list[int], epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Network:
        """Adam on the cross-entropy; a chunk's gradient reaches the bytes under each filter's maximum."""
        rng, step = np.random.default_rng(seed), 0
        rows = [_pairs(t) for t in texts]
        m, s = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                tables, g = self.tables(), {k: np.zeros_like(x) for k, x in self.p.items()}
                part = order[a : a + batch]
                for i in part:
                    chunks, at = self.pooled(rows[i], tables, True)
                    raw = chunks + self.p["b"]
                    h = np.maximum(raw, 0)
                    feats = np.r_[h.mean(0), h.max(0), h.min(0)]
                    d = (1 / (1 + np.exp(-np.clip(feats @ self.p["v"] + self.p["c"][0], -30, 30))) - labels[i]) / len(part)
                    g["v"] += d * feats
                    g["c"] += d
                    dh = np.tile(d * self.p["v"][:FILTERS] / len(h), (len(h), 1))
                    dh[h.argmax(0), np.arange(FILTERS)] += d * self.p["v"][FILTERS : 2 * FILTERS]
                    dh[h.argmin(0), np.arange(FILTERS)] += d * self.p["v"][2 * FILTERS :]
                    dh *= raw > 0
                    g["b"] += dh.sum(0)
                    for j in range(WIDTH // 2):
                        codes = rows[i][at + j]
                        np.add.at(g["w"][2 * j], (codes >> 8, np.arange(FILTERS)), dh)
                        np.add.at(g["w"][2 * j + 1], (codes & 255, np.arange(FILTERS)), dh)
                step += 1
                for k, x in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, seed: int = 3) -> Network | None:
    """A network fitted on at most `most` labelled rows of at most `chars` characters together, those whose ids have the least
    hashes; None if there is none.

    Labels other than 0 and 1, null ids and null texts are not used; of an id's labels and of its texts the least counts, so
    that a repeated id is one row. These rows alone come to the driver."""
    known = labels.select(col(id_col).alias("i"), col(label).alias("y")).filter(F.col("y").isin(0, 1) & F.col("i").isNotNull())
    chosen = known.groupBy("i").agg(F.min("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(most)
    texts = docs.select(col(id_col).alias("i"), col(text).cast("string").alias("t")).filter("t is not null")
    rows = texts.join(F.broadcast(chosen), "i").groupBy("i", "y").agg(F.min("t").alias("t"))  # at most `most` ids
    so_far = F.sum(F.length("t")).over(Window.orderBy(F.xxhash64("i"), "i").rowsBetween(Window.unboundedPreceding, 0))  # of as many rows
    rows = rows.withColumn("size", so_far).filter(F.col("size") <= chars).select("i", "t", "y").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.i, r.t))
    return Network(seed).fit([r.t for r in rows], [int(r.y) for r in rows])


def classify(docs: DataFrame, network: Network | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score double and predicted int (1 from the threshold on); the other columns pass through.

    A null or empty text is scored as one chunk of zero bytes; without a network every score is 0.5. Columns of docs with
    these names are replaced; repeated rows stay; an empty table gives none."""
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    (plain,) = fresh(docs, "text_to_score")
    schema = docs.select(*map(col, rest)).schema.add("score", "double").add("predicted", "integer")
    source = docs.select(*map(col, rest), col(text).cast("string").alias(plain))

    def make():
        tables = network.tables() if network else None

        def step(batch):
            scores = [network.score(t, tables) if network else 0.5 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], schema.names)

        return step

    return map_arrow(source, make, schema)
