"""Text files and JSON arrays read by many tasks: what a place in a file depends on is summed up for each block Spark reads."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch

#: Blocks of files whose sums are broadcast at most; of more, rows meet them in a join and are sorted again.
BLOCKS = 100_000
PLACED = "file string, block long, value string, place long"
QUOTE, OPEN, CLOSE = 1, 2, 3
STRUCTURE = np.zeros(256, np.uint8)
STRUCTURE[list(b'"[]{}')] = QUOTE, OPEN, CLOSE, OPEN, CLOSE


def _pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, block, value): lines of text files, or what lies between separators, in the order of the file within each block."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batch: pa.RecordBatch, keys: int = 2) -> Iterator[tuple[tuple, int, int]]:
    """(block, first, end) of a batch's rows of one block, in order; the first columns name the block."""
    ends = [pc.run_end_encode(batch.column(i)).run_ends.to_numpy() for i in range(keys)] if batch.num_rows else []
    first = 0
    for end in sorted({e for x in ends for e in x.tolist()}):
        yield tuple(batch.column(i)[first].as_py() for i in range(keys)), first, end
        first = end


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place in its block."""
    now, n = None, 0
    for batch in batches:
        places = [np.empty(0, np.int64)]
        for block, first, end in _runs(batch):
            if block != now:
                now, n = block, 0
            places.append(np.arange(n, n + end - first))
            n += end - first
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(places), pa.int64())], ["file", "block", "value", "place"])


def _kept(blocks: DataFrame) -> tuple[DataFrame, bool]:
    """What is known of blocks (file, block), written so that they are scanned once, and whether they are few: those are broadcast."""
    blocks.write.parquet(path := scratch(blocks.sparkSession))
    blocks = blocks.sparkSession.read.schema(blocks.schema).parquet(path)
    few = blocks.count() <= BLOCKS
    return F.broadcast(blocks) if few else blocks, few


def _beside(rows: DataFrame, blocks: DataFrame, few: bool) -> DataFrame:
    """rows (file, block, value) with their block's columns, in the same order within blocks."""
    if few:
        return rows.join(blocks, ["file", "block"])
    if "place" not in rows.columns:
        rows = rows.mapInArrow(_placed, PLACED)
    return rows.join(blocks, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "place")


def _before(value: Column, through: Column | None = None) -> Column:
    """The sum of a value over a file's earlier blocks, and over those of earlier files that have `through` in common."""
    blocks = Window.partitionBy("file" if through is None else through).orderBy("file", "block")
    return F.coalesce(F.sum(value).over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered_lines(spark: SparkSession, path: str, through: Column | None = None) -> DataFrame:
    """(file, line_number, value) of text files, lines counted from 1 in each file, blank ones too. Where many tasks wrote what belongs
    together, `through` (of `file`) says so: lines are counted on through the files that have it in common, in the order of their paths.

    Each block's lines are counted where they are read; the counts of a file's earlier blocks make its lines' numbers. A file
    is read by as many tasks as it has blocks, twice: for their counts and for its lines."""
    lines = _pieces(spark, path)
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n")).withColumn("earlier", _before(F.col("n"), through)).drop("n")
    rows = _beside(lines.mapInArrow(_placed, PLACED), *_kept(blocks))
    return rows.select("file", (F.col("earlier") + F.col("place") + 1).alias("line_number"), "value")


def bad_lines(spark: SparkSession, path: str, through: Column | None = None) -> DataFrame:
    """(file, line_number, value) of lines that are no JSON and not blank, numbered as in numbered_lines."""
    return numbered_lines(spark, path, through).filter(_no_json(F.col("value")))


def _no_json(value: Column) -> Column:
    return (F.length(F.trim(value)) > 0) & F.try_parse_json(value).isNull()


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that must all be JSON: ValueError names the first that is not, by file and line number, before anything is read.

    Blank lines are skipped. The check is a job of its own; lines are numbered only if one is wrong."""
    if _pieces(spark, path).filter(_no_json(F.col("value"))).limit(1).count():
        first = bad_lines(spark, path).groupBy("file").agg(F.min("line_number").alias("n"), F.min_by("value", "line_number").alias("value")).orderBy("file").first()
        raise ValueError(f"Malformed JSON on {first.file}:{first.n}: {first.value[:100]}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _text(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after another, and where each begins, the end of the last included."""
    values = values.cast(pa.large_string())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _marks(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and kinds of the quotes and brackets in pieces of JSON that no backslash escapes, and how many there are up to each piece's end."""
    kinds = STRUCTURE[text]
    if len(back := np.flatnonzero(text == ord("\\"))):
        begins = np.zeros(len(text) + 1, bool)
        begins[at] = True
        i = np.arange(len(back))
        run = np.maximum.accumulate(np.where((np.diff(back, prepend=-2) != 1) | begins[back], i, 0))
        escaped = back[(i - run) % 2 == 0] + 1
        kinds[escaped[~begins[escaped]]] = 0
    places = np.flatnonzero(kinds)
    return places, kinds[places], np.searchsorted(places, at[1:])


def _from(start: int, steps: np.ndarray) -> np.ndarray:
    return np.concatenate([[start], start + np.cumsum(steps)])


def _depths(kinds: np.ndarray, quotes: int, depth: int, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotes modulo 2 and depth before each mark and after the last; brackets count where the quotes are as they are outside of strings."""
    parity = _from(quotes, kinds == QUOTE) % 2
    step = np.where(kinds == OPEN, 1, -1) * ((kinds != QUOTE) & (parity[:-1] == outside))
    return parity, _from(depth, step)


class _Scan:
    """Strings and depth of JSON text whose start is unknown: both beginnings, outside and inside a string, at once."""

    def __init__(self) -> None:
        self.quotes, self.depth = 0, [0, 0]
        self.commas = [Counter(), Counter()]  # by depth
        self.last = None  # piece

    def pieces(self, values: pa.Array) -> None:
        _, kinds, ends = _marks(*_text(values))
        for k in 0, 1:
            parity, depth = _depths(kinds, self.quotes, self.depth[k], k)
            found, n = np.unique(depth[ends][parity[ends] == k], return_counts=True)  # of the commas after the pieces
            self.commas[k].update(dict(zip(found.tolist(), n.tolist(), strict=True)))
            self.depth[k] = int(depth[-1])
        self.quotes, self.last = int(parity[-1]), values[-1]

    def ends_filled(self) -> bool:
        """Whether an element ends where the text does: not if a comma or nothing was before the array's last bracket."""
        return self.last.as_py().strip(" \t\n\r").removesuffix("]").removeprefix("[").strip(" \t\n\r") != ""


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: whether its quotes are odd, for either beginning the change of depth and its commas by depth, and whether an element may end with it."""
    now, scan = None, _Scan()

    def row():
        maps = [pa.array([list(c.items())], pa.map_(pa.int32(), pa.int64())) for c in scan.commas]
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([scan.quotes], pa.int32()), *[pa.array([d], pa.int32()) for d in scan.depth], *maps, pa.array([scan.ends_filled()])], ["file", "block", "quotes", "out_depth", "in_depth", "out_commas", "in_commas", "filled"])

    for batch in batches:
        for block, first, end in _runs(batch):
            if block != now:
                if now:
                    yield row()
                now, scan = block, _Scan()
            scan.pieces(batch.column(2)[first:end])
    if now:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch], inner: bool) -> Iterator[pa.RecordBatch]:
    """Puts pieces between top-level commas together: the `inner` ones of a block, or those at its ends, which may go on in other blocks."""
    now, text, inside, depth, element, opened = None, [], 0, 0, 0, False

    def made(values: pa.Array, place: int):
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(now[0], pa.int64()), n), pa.array(np.arange(place, place + n)), values.cast(pa.string())], ["number", "place", "value"])

    for batch in batches:
        for block, first, end in _runs(batch, 1):
            if block != now:
                if text and not inner:
                    yield made(pa.array([",".join(text)]), element)
                now, text, opened = block, [], False
                inside, depth, element = (batch.column(i)[first].as_py() for i in (2, 3, 4))
            data, at = _text(batch.column(1)[first:end])
            marks, kinds, ends = _marks(data, at)
            parity, depths = _depths(kinds, inside, depth, 0)
            own = marks[(depths[:-1] != depths[1:]) & (depths[1:] == (kinds == OPEN))]  # the array's own brackets
            if len(own):
                data, at = np.delete(data, own), at - np.searchsorted(own, at)
            pieces = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(data))])
            last = np.flatnonzero((depths[ends] == 1) & (parity[ends] == 0)) + 1  # a comma after these pieces ends an element
            lists = pa.LargeListArray.from_arrays(pa.array(np.unique(np.concatenate([[0], last, [len(pieces)]])), pa.int64()), pieces)
            joined = lambda a, b: pc.binary_join(lists[a:b], pa.scalar(",", pa.large_string()))  # noqa: B023, E731
            inside, depth, n = int(parity[-1]), int(depths[-1]), len(last)
            if n:
                whole = pa.array([",".join([*text, joined(0, 1)[0].as_py()])], pa.large_string())
                if not inner and not opened:
                    yield made(whole, element)
                elif inner:
                    yield made(pa.concat_arrays([whole, joined(1, n)]), element) if opened else made(joined(1, n), element + 1)
                text, opened, element = [], True, element + n
            if len(lists) > n:
                text.append(joined(n, n + 1)[0].as_py())
    if text and not inner:
        yield made(pa.array([",".join(text)]), element)


def json_elements(spark: SparkSession, path: str, through: Column | None = None) -> DataFrame:
    """(file, place, value): the elements of JSON files that each hold one array, as JSON text, counted from 0 in each file, or through
    the files that have `through` (of `file`) in common, in the order of their paths: an array that many tasks wrote.

    A file is split at its commas, by as many tasks as it has blocks. Which commas part elements follows from quotes and brackets
    before them: each block's are summed for both ways in which it may begin, sums of a file's blocks say how each does begin, and a
    second pass cuts. Only elements that cross blocks are shuffled. A file that ends inside a string or an array is an error; a comma
    too many gives no element."""
    pieces = _pieces(spark, path, ",")
    sums = pieces.mapInArrow(_summed, "file string, block long, quotes int, out_depth int, in_depth int, out_commas map<int,long>, in_commas map<int,long>, filled boolean")
    sums = sums.withColumn("inside", (_before(F.col("quotes")) % 2).cast("int"))
    of = lambda x: F.when(F.col("inside") == 0, F.col(f"out_{x}")).otherwise(F.col(f"in_{x}"))
    sums = sums.select("file", "block", "inside", "quotes", "filled", of("depth").alias("change"), of("commas").alias("commas")).withColumn("depth", _before(F.col("change")).cast("int"))
    whole = Window.partitionBy("file")
    sound = (F.sum("change").over(whole) == 0) & (F.sum("quotes").over(whole) % 2 == 0)
    at_end = F.lead("block").over(whole.orderBy("block")).isNull() & F.col("filled")
    sums = sums.withColumn("n", F.coalesce(F.try_element_at("commas", 1 - F.col("depth")), F.lit(0)) + at_end.cast("int")).withColumn("element", _before(F.col("n"), through))
    sums = sums.withColumn("element", F.when(sound, F.col("element")).otherwise(F.raise_error(F.concat(F.lit("JSON ends inside an array or a string: "), "file")).cast("long")))
    blocks, few = _kept(sums.select("file", "block", "inside", "depth", "element", F.monotonically_increasing_id().alias("number")))
    rows = _beside(pieces, blocks, few).select("number", "value", "inside", "depth", "element")
    cut = lambda inner: rows.mapInArrow(partial(_cut, inner=inner), "number long, place long, value string").join(blocks.select("number", "file", "block"), "number")
    ends = cut(False).groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("v"))
    ends = ends.select("file", "place", F.array_join(F.transform("v", lambda x: x["value"]), ",").alias("value"))
    return cut(True).select("file", "place", "value").unionAll(ends).filter("length(trim(translate(value, '\\n\\r\\t', ''))) > 0")
