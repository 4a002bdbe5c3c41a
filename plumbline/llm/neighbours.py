"""Nearest neighbours by largest inner product, with a vantage-point tree for each shard (Yianilos, 1993).

A vector x of length at most M becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0): the Euclidean order of these
is the order of inner products, so that the triangle inequality holds. A branch is skipped when its distance bound exceeds
`factor` times the distance of the k-th neighbour found so far; factor 1 is exact search, less skips more.

Shards follow cells: each vector belongs to the nearest of about sqrt(shards) pivots, and a cell is dealt to as many shards as
it fills. A query searches its own cell first; of the others it goes to those whose ball, a pivot and a radius, the same rule
does not skip."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, col, map_arrow, stored

SHARD, LEAF, FACTOR = 8192, 256, 0.8
#: Vectors that pivots are chosen from, for each pivot.
SAMPLE = 64
#: Bytes of them that come to the driver at most.
SAMPLE_BYTES = 128 << 20


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed by itself: equal vectors score equally wherever they are."""
    return (a * b).sum(1)


def _far(longest, size, score):
    """The distance that a score is, of a query of this length."""
    return np.sqrt(np.maximum(longest**2 + size**2 - 2 * score, 0))


def _slack(longest, size):
    """What rounding may do to a distance."""
    return 1e-7 * (longest + size)


def distinct(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (id, vector) once, and of equal vectors the `keep` least ids."""
    vectors = vectors + 0.0  # one zero
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    by = np.lexsort((ids, group := group.reshape(-1)))
    group, ids = group[by], ids[by]
    once = np.r_[True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])][: len(ids)]
    by, group, ids = by[once], group[once], ids[once]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(ids)])
    few = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)])) < keep
    return ids[few], vectors[by[few]]


class Tree:
    """A vantage-point tree. `longest` is a bound of the vectors' lengths."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, leaf: int = LEAF, keep: int = 21, seed: int = 1) -> None:
        self.ids, self.vectors = distinct(ids, vectors, keep)
        self.repeated = len(np.unique(self.ids)) < len(self.ids)
        self.longest = longest
        norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.points = np.c_[self.vectors, np.sqrt(np.maximum(longest**2 - norms, 0))]
        self.square = np.einsum("ij,ij->i", self.points, self.points)
        self.leaf, self.rng = leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(self.points)))

    def _distance(self, queries: np.ndarray, row: int) -> np.ndarray:
        square = np.einsum("ij,ij->i", queries, queries) + self.square[row] - 2 * queries @ self.points[row]
        return np.sqrt(np.maximum(square, 0))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        at = int(self.rng.integers(len(rows)))
        point, rest = int(rows[at]), np.delete(rows, at)
        d = self._distance(self.points[rest], point)
        middle = float(np.median(d))
        inside = d <= middle
        if inside.all():
            return rows
        return point, middle, self._build(rest[inside]), self._build(rest[~inside])

    def search(self, who: np.ndarray, queries: np.ndarray, k: int, factor: float = FACTOR, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), [queries, k]: the candidates found of each query, but for its own id `who`, by falling score and, of
        equal scores, rising id; -1 and minus infinity where there are fewer. Scores under `least` are of no use to a query."""
        n = len(queries)
        least = np.full(n, -np.inf) if least is None else least
        q = np.c_[queries, np.zeros(n)]
        size = np.sqrt(np.einsum("ij,ij->i", q, q))
        slack = 1e-12 * (size * self.longest + 1e-300)  # of products; below, of distances
        best, score = np.full((n, k), -1), np.full((n, k), -np.inf)

        def take(some, rows):
            """Every candidate at least as near as the k-th so far, ties included, is scored exactly and ranked with those so far."""
            near = queries[some] @ self.vectors[rows].T >= (np.maximum(score[some, -1], least[some]) - slack[some])[:, None]
            a, b = np.nonzero(near & (self.ids[rows][None] != who[some][:, None]))
            if not len(a):
                return
            changed, a = np.unique(a, return_inverse=True)
            some = some[changed]
            by = np.r_[np.repeat(np.arange(len(some)), k), a]
            ids = np.r_[best[some].reshape(-1), self.ids[rows[b]]]
            values = np.r_[score[some].reshape(-1), _scores(queries[some][a], self.vectors[rows[b]])]
            if self.repeated:  # of an id's vectors the nearest counts
                order = np.lexsort((-values, ids, by))
                by, ids, values = by[order], ids[order], values[order]
                once = np.r_[True, (by[1:] != by[:-1]) | (ids[1:] != ids[:-1]) | (ids[1:] < 0)]
                by, ids, values = by[once], ids[once], values[once]
            order = np.lexsort((ids, -values, by))
            by, ids, values = by[order], ids[order], values[order]
            starts = np.searchsorted(by, np.arange(len(some)))
            top = starts[:, None] + np.arange(k)
            top[:, :] = np.minimum(top, np.r_[starts[1:], len(by)][:, None] - 1)
            short = starts[:, None] + np.arange(k) > top
            best[some], score[some] = np.where(short, -1, ids[top]), np.where(short, -np.inf, values[top])

        def visit(node, some):
            if not len(some):
                return
            if isinstance(node, np.ndarray):
                if len(node):
                    take(some, node)
                return
            point, middle, inner, outer = node
            d = self._distance(q[some], point)
            take(some, np.array([point]))
            near = d <= middle
            for first, second, part in ((inner, outer, near), (outer, inner, ~near)):
                mine, gap = some[part], np.abs(d[part] - middle)
                visit(first, mine)
                # the k-th score as a distance; infinite while there are fewer
                far = _far(self.longest, size[mine], np.maximum(score[mine, -1], least[mine]))
                visit(second, mine[gap <= factor * far + _slack(self.longest, size[mine])])

        for at in range(0, n, 512):
            visit(self.root, np.arange(at, min(n, at + 512)))
        return best, score


def _search(k: int, factor: float, shard_rows: int):
    """Reads rows (width, cell, part, kind, id, longest, least, vector) sorted by the first four: candidates (0) make a tree,
    queries (1) then stream through it."""

    def answers(tree, ids, queries, least):
        found, scores = tree.search(ids, queries, k, factor, least)
        there = found >= 0
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(1))), pa.array(found[there]), pa.array(scores[there])], ["query_id", "vec_id", "score"])

    def run(batches):
        place, tree, ids, vectors, most = None, None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            width, cell, part, kind, who, longest, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            flat, ends = batch.column(7).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(width)]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (width, cell, part, kind)], axis=0)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(part)].tolist(), strict=True):
                if (width[a], cell[a], part[a]) != place:
                    place, tree, ids, vectors, most = (width[a], cell[a], part[a]), None, [], [], 4 * shard_rows
                rows = flat[ends[a] : ends[b]].reshape(-1, width[a])
                if kind[a] == 0:
                    ids.append(who[a:b])
                    vectors.append(rows)
                    if sum(map(len, ids)) > most:  # rows that repeat an id and a vector: a shard has no more others
                        x, y = distinct(np.concatenate(ids), np.concatenate(vectors), k + 1)
                        ids, vectors, most = [x], [y], max(most, 2 * len(x))
                elif ids or tree:
                    if tree is None:
                        tree = Tree(np.concatenate(ids), np.concatenate(vectors), float(longest[a]), keep=k + 1)
                        ids, vectors = [], []
                    yield answers(tree, who[a:b], rows, least[a:b])

    return run


def _apart(vectors: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances [vectors, pivots], where `last` is the vectors' last dimension."""
    points = np.c_[vectors, last]
    square = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _spread(vectors: np.ndarray, longest: float, most: int) -> np.ndarray:
    """Pivots: of these vectors the first, then again and again the one that is farthest from all pivots so far."""
    points = np.c_[vectors, np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))]
    chosen = [0]
    far = _apart(points[:, :-1], points[:, -1], points[:1])[:, 0]
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _apart(points[:, :-1], points[:, -1], points[chosen[-1:]])[:, 0])
    return points[chosen]


def _by_width(batch, widths):
    """(rows, vectors) of each width of a batch, of columns width and, last, vector."""
    width = batch.column(0).to_numpy(zero_copy_only=False)
    flat, ends = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(width)]
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w in widths:
            yield w, rows, np.concatenate([flat[ends[i] : ends[i + 1]] for i in rows]).reshape(-1, w)


def _assigned(rows: DataFrame, pivots: dict[int, np.ndarray], longest: dict[int, float]) -> DataFrame:
    """rows (width, id, v) with the cell of each, 0 where a width has no pivots, and the distance from its pivot."""

    def make():
        def step(batch):
            cell, away = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for w, at, x in _by_width(batch, pivots):
                d = _apart(x, np.sqrt(np.maximum(longest[w] ** 2 - np.einsum("ij,ij->i", x, x), 0)), pivots[w])
                cell[at], away[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], ["width", "id", "v", "cell", "away"])

        return step

    return map_arrow(rows.select("width", "id", "v"), make, "width int, id long, v array<double>, cell long, away double")


def _routed(queries: DataFrame, pivots: dict[int, np.ndarray], longest: dict[int, float], radius: dict[int, np.ndarray], factor: float) -> DataFrame:
    """Queries (width, id, home, least, v) once for each other cell that the rule does not skip."""

    def make():
        def step(batch):
            who, home, least = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for w, at, x in _by_width(batch, pivots):
                size = np.sqrt(np.einsum("ij,ij->i", x, x))
                d = _apart(x, np.zeros(len(x)), pivots[w])
                far = factor * _far(longest[w], size, least[at]) + _slack(longest[w], size)
                i, c = np.nonzero((d - radius[w] <= far[:, None]) & (np.arange(len(pivots[w])) != home[at][:, None]))
                rows.append(at[i])
                cells.append(c)
            rows = np.concatenate(rows)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(3), kept.column(4), pa.array(np.concatenate(cells))], ["width", "id", "least", "v", "cell"])

        return step

    return map_arrow(queries.select("width", "id", F.col("cell").alias("home"), "least", "v"), make, "width int, id long, least double, v array<double>, cell long")


def clean(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): ids and vectors as doubles, without those that are null, empty or zero or hold a null or a non-finite component."""
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(column).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    return rows.filter(F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")), F.lit(False)) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", column: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, a row of `vectors` for which the condition
    `queries` (SQL over id) holds, among all other ids; ties to the smaller id, also where they are cut.

    Vectors that clean() drops take no part; vectors of different lengths have no inner product and are no candidates of each
    other; rows that repeat an id are candidates each, of one id the nearest counts once; a table without vectors gives no
    rows; other columns are not read. Shards hold about `shard_rows` vectors at every size, and a shard's tree is all that a
    task holds; queries stream by. What comes to the driver is
    a sample of SAMPLE vectors for each pivot, of which there are about the square root of the number of shards, or of SAMPLE_BYTES if that
    is less, and a radius for each."""
    bounded(vectors.sparkSession)
    rows = clean(vectors, id_col, column).withColumn("width", F.size("v"))
    square = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), (F.sqrt(square) * (1 + 1e-12)).alias("longest"))
    sizes = stored(sizes.withColumn("cells", F.ceil(F.sqrt(F.ceil(F.col("n") / shard_rows)))))
    many = sizes.filter("cells > 1")
    # pivots are chosen from a sample by hash, of at most SAMPLE vectors for each
    wanted = {r.width: r for r in many.collect()}  # a row for each length of vectors
    longest = {w: r.longest for w, r in wanted.items()}
    pivots = {}
    for w, r in wanted.items():
        most = r.cells * min(SAMPLE, max(1, SAMPLE_BYTES // (8 * w * r.cells)))
        some = rows.filter((F.col("width") == w) & (F.pmod(F.xxhash64("id", "v"), F.lit(-(-r.n // most))) == 0))
        nth = F.row_number().over(Window.partitionBy("width").orderBy(F.xxhash64("v", "id"), "id"))
        points = some.withColumn("nth", nth).filter(F.col("nth") <= most).select("v").toArrow().column("v").combine_chunks()
        if len(points):
            pivots[w] = _spread(points.flatten().to_numpy().reshape(-1, w), r.longest, r.cells)
    assigned = stored(_assigned(rows, pivots, longest))
    cells = stored(assigned.groupBy("width", "cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / shard_rows).alias("parts")))
    radius = {w: np.full(len(x), -np.inf) for w, x in pivots.items()}
    for r in cells.join(many.select("width"), "width", "left_semi").collect():  # a row for each pivot
        if r.width in radius:
            radius[r.width][r.cell] = r.radius
    part = F.pmod(F.xxhash64("id", "v"), "parts")
    nothing = F.lit(float("-inf"))
    candidates = assigned.join(cells, ["width", "cell"]).join(sizes.select("width", "longest"), "width")
    candidates = candidates.select("width", "cell", part.alias("part"), F.lit(0).alias("kind"), "id", "longest", nothing.alias("least"), "v")

    def searched(asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) of queries (width, cell, id, least, v)."""
        to = asked.join(cells, ["width", "cell"]).join(sizes.select("width", "longest"), "width")
        to = to.select("width", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "id", "longest", "least", "v")
        place = ["width", "cell", "part"]
        dealt = candidates.unionAll(to).repartition(*place).sortWithinPartitions(*place, "kind")
        return dealt.mapInArrow(_search(k, factor, shard_rows), "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = assigned.filter(queries)
    home = best(searched(asked.withColumn("least", nothing)))
    if not pivots:
        return home
    home = stored(home)
    reached = home.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    others = _routed(asked.join(reached, "id", "left").withColumn("least", F.coalesce("least", nothing)), pivots, longest, radius, factor)
    return best(home.select("query_id", "vec_id", "score").unionAll(searched(others)))
