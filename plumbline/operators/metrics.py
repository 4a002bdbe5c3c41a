"""Token F1, calibration, schema-linking precision and recall, quantiles and nested metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import _ranged, average_ranks, RANGES

# The components of a query and their weights.
WEIGHTS = {"select": 2.0, "where": 2.0, "join": 2.0, "groupby": 1.0, "orderby": 1.0, "having": 1.0, "limit": 0.5}


def _bag(tokens: Column) -> Column:
    """Distinct tokens, each numbered among its equals, so that set functions count repeats."""
    sorted_ = F.array_sort(tokens)
    return F.transform(sorted_, lambda x, i: F.struct(x.alias("t"), (i - F.array_position(sorted_, x)).alias("k")))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two token arrays as bags: 1 if both are empty (or null), 0 if one is or nothing is common."""
    pred, gold = (F.coalesce(x, F.array().cast("array<string>")) for x in (pred, gold))
    common = F.size(F.array_intersect(_bag(pred), _bag(gold)))
    return F.when((F.size(pred) == 0) & (F.size(gold) == 0), 1.0).otherwise(F.coalesce(2.0 * common / F.nullif(F.size(pred) + F.size(gold), F.lit(0)), F.lit(0.0)))


def long_token_f1(df: DataFrame, ids: list[str], pred: str, gold: str) -> DataFrame:
    """(ids, f1): the same for long arrays, in rows that the ids tell apart. token_f1 compares within a row, in time that grows with
    the square of an array's length; here tokens are counted as rows, all of an id's in the task that its hash names."""
    side = lambda c, n: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.struct(t.alias("t"), F.lit(n).alias("side")))
    rows = df.select(*ids, F.concat(side(pred, 0), side(gold, 1)).alias("w")).repartition(*[F.col(c) for c in ids])
    counts = rows.select(*ids, F.explode_outer("w").alias("w")).groupBy(*ids, "w.t").agg(F.count_if(F.col("w.side") == 0).alias("p"), F.count_if(F.col("w.side") == 1).alias("g"))
    sums = counts.groupBy(*ids).agg(F.sum(F.least("p", "g")).alias("c"), F.sum(F.col("p") + F.col("g")).alias("n"))
    return sums.select(*ids, F.when(F.col("n") == 0, 1.0).otherwise(2.0 * F.col("c") / F.nullif(F.col("n"), F.lit(0))).alias("f1"))


def component_f1(pred: Column, gold: Column, weights: dict[str, float] | None = None) -> Column:
    """1 minus the weighted mean F1 of the components (structs of token arrays with the weights' names), within 0 and 1; 0 if the weights sum to 0."""
    weights = WEIGHTS if weights is None else weights
    total = sum(weights.values())
    if not total:
        return F.lit(0.0)
    mean = sum((token_f1(pred[k], gold[k]) * w for k, w in weights.items()), F.lit(0.0)) / total
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - mean))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row rho: the correlation of average ranks, 0 where it is undefined; rows with a null don't count."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    rx, ry = average_ranks(rows, "x", "rx").select("x", "rx"), average_ranks(rows, "y", "ry").select("y", "ry")
    pairs = rows.groupBy("x", "y").agg(F.count("*").alias("n")).join(rx, "x").join(ry, "y")
    w, a, b = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    sums = pairs.agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    over = F.sqrt(F.expr("(n * aa - a * a) * (n * bb - b * b)"))
    return sums.select(F.coalesce(F.when(over > 0, F.expr("n * ab - a * b") / over), F.lit(0.0)).alias("rho"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row auc: how likely a positive has the larger score, ties counting half; null if there are no positives or no negatives."""
    rows = df.select(F.col(score).cast("double").alias("s"), positive.cast("int").alias("p")).filter("s is not null and p is not null")
    ranks = average_ranks(rows, "s", "r").select("s", "r")
    by = rows.groupBy("s").agg(F.sum("p").alias("pos"), F.count("*").alias("n")).join(ranks, "s")
    sums = by.agg(F.sum(F.col("r") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"))
    return sums.select(F.when(F.expr("p > 0 and q > 0"), F.expr("(r - p * (p + 1) / 2) / (p * q)")).alias("auc"))


def correlation_p(rho: float, n: int) -> float | None:
    """The two-sided p value of a correlation of n pairs by Student's t with n - 2 degrees of freedom; None under 3 pairs.

    It is the regularised incomplete beta function of df / (df + t * t) with parameters df / 2 and 1 / 2, by its continued fraction."""
    if n is None or n < 3 or rho is None:
        return None
    if rho == 0 or abs(rho) >= 1:
        return float(rho == 0)
    a, b, x = (n - 2) / 2, 0.5, 1 - rho * rho
    if flip := x > (a + 1) / (a + b + 2):
        a, b, x = b, a, 1 - x
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    part = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * h / a
    return 1 - part if flip else part


@F.pandas_udf(T.DoubleType())
def _p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(r, int(k)) for r, k in zip(rho, n, strict=True)], dtype="float64")


def calibration(df: DataFrame, distance: str, correct: str, target: float = -0.65) -> DataFrame:
    """One row: spearman_rho, p_value, n_samples, n_correct, n_wrong, the mean distance of each, auc_roc of the distance for wrong ones (all to 4 places) and passed (rho at most the target)."""
    rows = df.select(F.col(distance).cast("double").alias("d"), F.col(correct).cast("int").alias("c")).filter("d is not null and c is not null")
    plain = rows.agg(F.count("*").alias("n_samples"), F.count_if(F.col("c") == 1).alias("n_correct"), F.count_if(F.col("c") == 0).alias("n_wrong"), F.round(F.avg(F.when(F.col("c") == 1, F.col("d"))), 4).alias("mean_dist_correct"), F.round(F.avg(F.when(F.col("c") == 0, F.col("d"))), 4).alias("mean_dist_wrong"))
    one = lambda x: F.broadcast(x)  # noqa: E731  one row each
    out = plain.crossJoin(one(spearman(rows, "d", "c"))).crossJoin(one(auc(rows, "d", F.col("c") == 0)))
    return out.select(F.round("rho", 4).alias("spearman_rho"), _p_value("rho", "n_samples").alias("p_value"), "n_samples", "n_correct", "n_wrong", "mean_dist_correct", "mean_dist_wrong", F.round("auc", 4).alias("auc_roc"), (F.col("rho") <= target).alias("passed"))


def linking_rows(df: DataFrame, predicted: str, reference: str) -> DataFrame:
    """Adds tp, exact, complete, precision and recall (0 or 1 or shares) of two name arrays, compared trimmed and in lower case as sets.

    complete asks that the true positives are as many as the references, repeats of which count: repeated ones are never complete."""
    clean = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    rows = df.withColumns({"__p": clean(predicted), "__r": clean(reference), "__n": F.coalesce(F.size(F.when(F.col(reference).isNotNull(), F.col(reference))), F.lit(0))})
    tp = F.size(F.array_intersect("__p", "__r"))
    same = (tp == F.size("__p")) & (tp == F.size("__r"))
    share = lambda of: F.when((F.size("__p") > 0) & (F.size(of) > 0), tp / F.size(of)).otherwise(0.0)
    rows = rows.withColumns({"tp": tp, "exact": same.cast("int"), "complete": (tp == F.col("__n")).cast("int"), "precision": share("__p"), "recall": share("__r")})
    return rows.drop("__p", "__r", "__n")


def linking_summary(rows: DataFrame) -> DataFrame:
    """One row over linking_rows: totals and means, and the F1 of the mean precision and recall (0 where both are 0)."""
    out = rows.agg(F.count("*").alias("all_total"), F.avg("exact").alias("acc"), F.avg("complete").alias("acc_filter"), F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"), F.sum("tp").alias("tp"))
    return out.withColumn("avg_f1", F.coalesce(2 * F.col("avg_precision") * F.col("avg_recall") / F.nullif(F.col("avg_precision") + F.col("avg_recall"), F.lit(0.0)), F.lit(0.0)))


def lower_quantiles(df: DataFrame, value: str, shares: Sequence[float] = (0.25, 0.5, 0.75, 0.9), names: Sequence[str] = ("p25", "median", "p75", "p90")) -> DataFrame:
    """One row: count, min, the values at place floor((n - 1) * share) of the sorted ones, max; nulls don't count."""
    # values are counted first, so that one that most rows have is a row
    groups = df.select(F.col(value).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    upto = F.col("__base") + F.sum("n").over(Window.partitionBy("__r").orderBy("v"))
    placed = _ranged(groups, F.col("v"), F.col("n"), RANGES).select("v", "n", upto.alias("upto"))
    at = placed.crossJoin(F.broadcast(groups.agg(F.sum("n").alias("total"))))  # one row
    place = lambda s: F.floor((F.col("total") - 1) * s) + 1
    picks = [F.max(F.when((place(s) <= F.col("upto")) & (place(s) > F.col("upto") - F.col("n")), F.col("v"))).alias(k) for s, k in zip(shares, names, strict=True)]
    return at.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.min("v").alias("min"), *picks, F.max("v").alias("max"))


def _leaves(kind: T.DataType, path: str, column: Column):
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(f.dataType, f"{path}/{f.name}", column[f.name])
    elif isinstance(kind, T.BooleanType | T.NumericType):
        yield path, column.cast("double")


def flattened_metrics(df: DataFrame, prefix: str, column: str) -> DataFrame:
    """(metric, value) for every number or boolean in a nested struct, named prefix/a/b/c; other leaves and nulls are dropped."""
    leaves = list(_leaves(df.schema[column].dataType, prefix, F.col(column)))
    if not leaves:
        return df.sparkSession.createDataFrame([], "metric string, value double")
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in leaves])
    return df.select(F.inline(pairs)).filter("value is not null")
