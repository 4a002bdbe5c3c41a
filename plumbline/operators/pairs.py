"""Preference pairs from scored candidates."""

from __future__ import annotations

from bisect import bisect_left
from decimal import ROUND_HALF_UP, Decimal
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Margins are rounded to this.
PLACES = Decimal("0.0001")


def scored_order(scored: DataFrame, keys: list[str] = ["sample_id"]) -> DataFrame:  # noqa: B006
    """Adds rank within the keys: by distance, correct ones first among equals, then by pos."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", F.col("is_correct").cast("int").desc(), "pos")))


def build_pairs(scored: DataFrame, keys: list[str] = ["sample_id"], min_margin: float = 0.0, max_pairs: int = 0) -> DataFrame:  # noqa: B006
    """Pairs (keys, chosen, rejected, margin, pair_type, the two verdicts and distances) of scored rows (keys, pos, sql, distance, is_correct).

    Every correct candidate is preferred to every wrong one (margin at least 0), and of two wrong ones the nearer to the
    farther if their gap is over 0 and at least min_margin. A text is not paired with itself; of equal pairs the first
    counts (correct_wrong before wrong_wrong, then in the candidates' order). With max_pairs the largest margins stay, ties in
    that same order. Rows with a null or NaN distance or a null verdict make no pair, nor does a null key.

    Without max_pairs the result is all pairs, by an equi-join on the keys with the rest as its condition. With max_pairs pairs
    that are cut are not made (top_pairs)."""
    own = scored.filter("distance is not null and not isnan(distance) and is_correct is not null and sql is not null")
    own = own.select(*keys, "sql", F.struct(F.col("distance").cast("double").alias("distance"), (~F.col("is_correct")).alias("w"), "pos").alias("at"))
    best = top_pairs(own, keys, min_margin, max_pairs) if max_pairs > 0 else all_pairs(own, keys, min_margin)
    a_d, b_d = F.col("a_at.distance"), F.col("b_at.distance")
    return best.select(
        *keys, "chosen", "rejected", _margin().alias("margin"), F.when(F.col("t"), "wrong_wrong").otherwise("correct_wrong").alias("pair_type"),
        (~F.col("t")).alias("chosen_is_correct"), F.lit(False).alias("rejected_is_correct"), F.round(a_d, 4).alias("chosen_distance"), F.round(b_d, 4).alias("rejected_distance"),
    )


def _margin() -> Column:
    return F.round(F.greatest(F.col("b_at.distance") - F.col("a_at.distance"), F.lit(0.0)), 4)


def _meets(min_margin: float, b: str = "b_at.distance") -> Column:
    gap = F.col(b) - F.col("a_at.distance")
    return (gap > 0) & (gap >= min_margin)


def all_pairs(own: DataFrame, keys: list[str], min_margin: float) -> DataFrame:
    """(keys, chosen, rejected, t, a_at, b_at): every pair of rows (keys, sql, at), t for two wrong ones."""
    a = own.select(*keys, F.col("sql").alias("chosen"), F.col("at").alias("a_at"))
    b = own.filter("at.w").select(*keys, F.col("sql").alias("rejected"), F.col("at").alias("b_at"))
    met = a.join(b, keys).filter((F.col("chosen") != F.col("rejected")) & (~F.col("a_at.w") | _meets(min_margin)))
    # all that a pair shows is in its place: the first one is the least
    met = met.groupBy(*keys, "chosen", "rejected").agg(F.min(F.struct(F.col("a_at.w").alias("t"), "a_at", "b_at")).alias("at"))
    return met.select(*keys, "chosen", "rejected", "at.*")


def frontier(chosen: list[tuple[bool, tuple, str]], rejected: list[tuple[tuple, str]], k: int, min_margin: float) -> list[tuple[int, int]]:
    """The first k pairs, by margin and then in the candidates' order, as places in the two lists.

    chosen has (wrong, at, id), rejected (at, id); `at` begins with the distance and is the candidates' order. Each chosen one
    walks the rejected ones in its pairs' order: from the farthest, those of one rounded margin by their places. The walks'
    first pairs are in the chosen ones' order, so that a heap holds one walk more of either kind than have given a pair."""
    by = sorted(range(len(rejected)), key=lambda j: rejected[j][0])
    far = [rejected[j][0][0] for j in by]

    def margin(gap: float) -> Decimal:
        return Decimal(repr(gap)).quantize(PLACES, ROUND_HALF_UP) if 0 < gap < 1e20 else Decimal(max(gap, 0.0))

    def walk(i: int):
        wrong, (near, *_), _ = chosen[i]
        least = bisect_left(far, True, key=lambda d: d > near and d - near >= min_margin) if wrong else 0
        end = len(far)
        while end > least:
            m = margin(far[end - 1] - near)
            first = bisect_left(far, m, least, end, key=lambda d: margin(d - near))
            yield from ((-m, j) for j in range(first, end))
            end = first

    heap: list = []

    def push(line: list[int], place: int, steps, begins: bool) -> None:
        if found := next(steps, None):
            wrong, at, _ = chosen[line[place]]
            heappush(heap, (found[0], wrong, at, found[1], place, begins, line, steps))

    for kind in (False, True):
        if line := sorted((i for i, c in enumerate(chosen) if c[0] == kind), key=lambda i: chosen[i][1]):
            push(line, 0, walk(line[0]), True)
    out: list[tuple[int, int]] = []
    while heap and len(out) < k:
        _, _, _, j, place, begins, line, steps = heappop(heap)
        if chosen[line[place]][2] != rejected[by[j]][1]:
            out.append((line[place], by[j]))
        if begins and place + 1 < len(line):
            push(line, place + 1, walk(line[place + 1]), True)
        push(line, place, steps, False)
    return out


def top_pairs(own: DataFrame, keys: list[str], min_margin: float, k: int) -> DataFrame:
    """What all_pairs has, of each key the k pairs of the largest margins only, without listing the others.

    Only the k + 1 nearest correct texts of a key, and its k + 1 nearest wrong ones, can be chosen: a pair of a farther text comes
    after theirs with the same rejected one. They go to the key's wrong texts, and tasks run a frontier heap over those of a batch,
    which gives k pairs of a key at most. A key with many candidates is many batches of many tasks; nothing holds all of them. A
    text that bears several distances within a key is met by its first one there, and by the others in a join of their own."""
    at = F.col("at")
    first = own.groupBy(*keys, "sql").agg(F.min(F.when(~at["w"], at)).alias("c"), F.min(F.when(at["w"], at)).alias("w"), F.max(F.when(at["w"], at["distance"])).alias("most"))
    able = first.select(*keys, F.col("sql").alias("chosen"), F.md5("sql").alias("a_id"), F.col("c").isNull().alias("t"), F.coalesce("c", "w").alias("a_at"))
    near = able.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "t").orderBy("a_at"))).filter(F.col("nth") <= k + 1).drop("nth")
    lists = near.groupBy(*keys).agg(F.collect_list(F.struct("t", "a_at", "a_id")).alias("near"))
    asked = first.filter("w is not null").select(*keys, F.col("sql").alias("rejected"), F.col("w").alias("b_at")).join(lists, keys).select(*keys, "rejected", "b_at", F.md5("rejected").alias("b_id"), "near")
    n = len(keys)

    def order(x: dict) -> tuple:
        return x["distance"], x["w"], x["pos"] is not None, x["pos"]

    def run(batches):
        for batch in batches:
            groups: dict[str, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(n)), strict=True)):
                groups.setdefault(repr(key), []).append(i)
            places, ids, lists = batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), batch.column(n + 3)
            a_rows, b_rows = [], []
            for rows in groups.values():
                chosen = [(x["t"], order(x["a_at"]), x["a_id"]) for x in lists[rows[0]].as_py()]
                for i, j in frontier(chosen, [(order(places[r]), ids[r]) for r in rows], k, min_margin):
                    a_rows.append(lists.offsets[rows[0]].as_py() + i)
                    b_rows.append(rows[j])
            taken = lists.values.take(pa.array(a_rows, pa.int64()))
            rest = [batch.column(c).take(pa.array(b_rows, pa.int64())) for c in range(n + 2)]
            yield pa.RecordBatch.from_arrays([*rest, *(taken.field(f) for f in ("t", "a_at", "a_id"))], [*asked_names, "t", "a_at", "a_id"])

    shape = asked.select(*keys, "rejected", "b_at", F.lit(True).alias("t"), F.col("b_at").alias("a_at"), F.lit("").alias("a_id")).schema
    asked_names = asked.columns[: n + 2]
    found = asked.mapInArrow(run, shape)
    # the farther distances of a text: they count for those from which its nearer ones are not far enough
    several = first.filter(F.col("most") > F.col("w.distance")).select(*keys, "sql")
    apart = own.filter("at.w").join(several, [*keys, "sql"]).groupBy(*keys, "sql", F.col("at.distance").alias("d")).agg(F.min("at").alias("b_at"))
    apart = apart.withColumn("before", F.lag("d").over(Window.partitionBy(*keys, "sql").orderBy("d"))).filter("before is not null").select(*keys, F.col("sql").alias("rejected"), "b_at", "before")
    more = able.filter("t").join(apart, keys).filter((F.col("chosen") != F.col("rejected")) & _meets(min_margin) & ~_meets(min_margin, "before"))
    columns = [*keys, "rejected", "b_at", "t", "a_at", "a_id"]
    ordered = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(_margin()), F.struct("t", "a_at", "b_at")))
    kept = found.select(*columns).unionAll(more.select(*columns)).withColumn("nth", ordered).filter(F.col("nth") <= k)
    return kept.join(able.select(*keys, "a_id", "chosen"), [*keys, "a_id"]).select(*keys, "chosen", "rejected", "t", "a_at", "b_at")


def with_gold_fallbacks(records: DataFrame, items: DataFrame) -> DataFrame:
    """Eval records with db_id and gold_sql filled in: metadata first, then the record, then the item at the sample's place.

    records has sample_id and, each nullable, meta_db_id, db_id and gold_sql; items has sample_id, db_id and SQL. A sample
    outside the items stays with what it has, and error names what is missing."""
    item = items.select("sample_id", F.col("db_id").alias("__db"), F.col("SQL").alias("__sql"))
    rows = records.join(item, "sample_id", "left")
    rows = rows.withColumns({"db_id": F.coalesce("meta_db_id", "db_id", "__db"), "gold_sql": F.coalesce("gold_sql", "__sql"), "error": F.when(F.coalesce("meta_db_id", "db_id", "__db").isNull(), "db_id is missing").when(F.coalesce("gold_sql", "__sql").isNull(), "gold SQL is missing")})
    return rows.drop("__db", "__sql", "meta_db_id")
