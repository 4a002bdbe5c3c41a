"""Three named ways in which two results are the same: ordered, as bags and as sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _positional(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows with how often each side has them, in one shuffle with partial counts; nulls are equal to each other."""
    both = _positional(left).withColumns({"__l": F.lit(1), "__r": F.lit(0)}).unionAll(_positional(right).withColumns({"__l": F.lit(0), "__r": F.lit(1)}))
    return both.groupBy(*both.columns[:-2]).agg(F.sum("__l").alias("l"), F.sum("__r").alias("r"))


def _verdict(df: DataFrame, differs: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.when(differs, 1).otherwise(0)), F.lit(0)).alias("n_differing")).select((F.col("n_differing") == 0).alias("equal"), "n_differing")


def _other_arity(left: DataFrame, right: DataFrame) -> DataFrame | None:
    if len(left.columns) == len(right.columns):
        return None
    return left.sparkSession.range(1).select(F.lit(False).alias("equal"), F.lit(None).cast("long").alias("n_differing"))


def bag_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """(equal, n_differing distinct rows), columns by position, order ignored, repeats counted. Another number of columns is not equal."""
    return _other_arity(left, right) or _verdict(_counts(left, right), F.col("l") != F.col("r"))


def set_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same with repeats ignored."""
    return _other_arity(left, right) or _verdict(_counts(left, right), (F.col("l") > 0) != (F.col("r") > 0))


def digest(df: DataFrame, like: T.StructType | None = None) -> DataFrame:
    """(n, a, b): how many rows, and two sums of 64-bit hashes of them, the same for any order of the same rows.

    Sums of parts add up, so that a table is read once without a shuffle of its rows. Columns go by position and in the types of
    `like`; nulls, and zeros of either sign, hash as _counts compares them."""
    fields = (like or df.schema).fields

    def told(c: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.DoubleType | T.FloatType):
            c = c + F.lit(0.0).cast(kind)
        if isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.VariantType):
            c = F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
        return [c.isNull(), c]

    rows = _positional(df)
    parts = [x for i, f in enumerate(fields) for x in told(F.col(f"c{i}").cast(f.dataType), f.dataType)] or [F.lit(0)]
    lane = lambda seed: F.xxhash64(F.lit(seed), *parts)
    return rows.agg(F.count("*").alias("n"), *[F.sum(lane(seed).cast("decimal(20,0)")).alias(name) for name, seed in (("a", 1), ("b", 2))])


def bag_equal_by_digest(left: DataFrame, right: DataFrame) -> DataFrame:
    """What bag_equal gives. Both sides' digests are compared first, at once; rows are shuffled only if these differ, to count what does.

    Bags that differ have the same digest with a chance of about 2 ** -128."""
    if other := _other_arity(left, right):
        return other
    kind = _positional(left).unionAll(_positional(right)).schema
    if digest(left, kind).first() == digest(right, kind).first():
        return left.sparkSession.range(1).select(F.lit(True).alias("equal"), F.lit(0).cast("long").alias("n_differing"))
    return bag_equal(left, right)


def strict_equal(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """(equal, n_differing places): rows compared at the places that the column `place` names on both sides; it must be unique."""
    a, b = left.select(F.col(place).alias("__p"), F.struct(*[F.col(c) for c in left.columns if c != place]).alias("l")), right.select(F.col(place).alias("__p"), F.struct(*[F.col(c) for c in right.columns if c != place]).alias("r"))
    if len(left.columns) != len(right.columns):
        return _other_arity(left, right)
    return _verdict(a.join(b, "__p", "full"), ~F.to_json("l", {"ignoreNullFields": "false"}).eqNullSafe(F.to_json("r", {"ignoreNullFields": "false"}))) if left.columns == right.columns else strict_equal(left, right.toDF(*[place if c == place else n for c, n in zip(right.columns, left.columns, strict=True)]), place)


def results_equal(gold: Column, pred: Column, mode: str, empty_matches: bool = True) -> Column:
    """Whether two results (arrays of canonical row texts) are equal in mode strict, bag or set; false if either is null.

    empty_matches=False keeps the rule that in set mode an empty gold result is never matched."""
    sides = {"strict": lambda x: x, "bag": F.array_sort, "set": lambda x: F.array_sort(F.array_distinct(x))}[mode]
    same = sides(gold) == sides(pred)
    if mode == "set" and not empty_matches:
        same = same & (F.size(gold) > 0)
    return F.coalesce(same, F.lit(False))
