"""Values that contain texts, many texts at once, by posting lists of their runs of three characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 3


def _runs(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    return F.array_distinct(F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def grams(values: DataFrame, column: str) -> DataFrame:
    """(gram, value): a posting for each distinct value and each run of one to three characters of its lower-case text."""
    once = values.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct().withColumn("low", F.lower("value"))
    return once.select("value", F.explode(F.concat(*[_runs(F.col("low"), n) for n in range(1, LONGEST + 1)])).alias("gram")).select("gram", "value")


def containing(values: DataFrame, column: str, needles: DataFrame, needle_id: str, needle: str) -> DataFrame:
    """(needle_id, value, matches) of each needle that any value contains, ignoring case: the least such value and how many distinct ones.

    profile.value_exists for many needles in one job. A needle is no pattern; an empty one is in every value; null needles and values
    are left out. Each needle is looked up by the rarest of its runs of three characters (a shorter needle is a run itself), and
    what is in that list is verified. A frequent run is met by a join that adaptive execution can split. The postings are never
    sent to the driver: Spark guesses their size from the table's, of which each value becomes dozens."""
    index = grams(values, column).hint("merge")
    asked = needles.select(F.col(needle_id).alias("id"), F.lower(F.col(needle).cast("string")).alias("needle")).filter("needle is not null")
    texts = asked.select("needle").distinct()
    size = F.least(F.length("needle"), F.lit(LONGEST))
    parts = texts.filter("needle <> ''").select("needle", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("needle") - size + 1), lambda i: F.substr(F.col("needle"), i, size)))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    known = parts.join(counts, "gram", "left")  # a run that no value has: nothing contains the needle
    rarest = known.groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = rarest.join(index, "gram").filter(F.contains(F.lower("value"), F.col("needle"))).groupBy("needle").agg(F.min("value").alias("value"), F.count("*").alias("matches"))
    empty = values.select(F.col(column).cast("string").alias("value")).filter("value is not null").agg(F.min("value").alias("least"), F.count_distinct("value").alias("all"))
    every = texts.filter("needle = ''").crossJoin(F.broadcast(empty)).filter("least is not null").select("needle", F.col("least").alias("value"), F.col("all").alias("matches"))  # one row each
    return asked.join(found.unionAll(every), "needle").select(F.col("id").alias(needle_id), "value", "matches")
