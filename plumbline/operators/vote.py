"""Majority votes over execution results, the runner-up, and pass@k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ballots(candidates: DataFrame, question: str = "question_id", pos: str = "pos", result: str = "result", sql: str = "sql") -> DataFrame:
    """One row for each question and result (null results are invalid and don't vote): votes, first (pos) and the sql there."""
    valid = candidates.filter(F.col(result).isNotNull())
    return valid.groupBy(question, result).agg(F.count("*").alias("votes"), F.min(pos).alias("first"), F.min_by(sql, pos).alias("sql"))


def majority(candidates: DataFrame, question: str = "question_id", pos: str = "pos", result: str = "result", sql: str = "sql") -> DataFrame:
    """One row for each question: top1 and top2, structs (first, votes, result, sql), and n_results.

    top1 is the result seen first among those with most votes. top2 has the second largest number of votes: of several, the
    last that was seen before top1, else the first seen after it; if the largest number is tied, or there is one result, it is
    top1 itself. A question without valid results has nulls and n_results 0. Only results, not candidates, are gathered
    for a question."""
    counted = candidates.groupBy(question, result).agg(F.count("*").alias("votes"), F.min(pos).alias("first"), F.min_by(sql, pos).alias("sql"))
    one = F.when(F.col(result).isNotNull(), F.struct(F.col("first"), F.col("votes"), F.col(result).alias("result"), F.col("sql")))  # invalid ones keep their question only
    rows = counted.groupBy(question).agg(F.array_sort(F.collect_list(one)).alias("a"))
    votes = F.sort_array(F.transform("a", lambda x: x["votes"]), asc=False)
    rows = rows.withColumns({"v1": F.get(votes, F.lit(0)), "v2": F.coalesce(F.get(votes, F.lit(1)), F.get(votes, F.lit(0)))})
    rows = rows.withColumn("top1", F.get(F.filter("a", lambda x: x["votes"] == F.col("v1")), F.lit(0)))
    before = F.filter("a", lambda x: (x["votes"] == F.col("v2")) & (x["first"] < F.col("top1.first")))
    after = F.filter("a", lambda x: (x["votes"] == F.col("v2")) & (x["first"] > F.col("top1.first")))
    second = F.when(F.col("v1") == F.col("v2"), F.col("top1")).otherwise(F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))))
    return rows.select(question, "top1", second.alias("top2"), F.size("a").alias("n_results"))


def judged(votes: DataFrame, gold: DataFrame, question: str = "question_id", result: str = "gold_result") -> DataFrame:
    """votes with top1_correct, top2_correct (either of both) as 0 or 1, from gold (question, gold_result); a null gold is never matched."""
    rows = votes.join(gold.select(question, F.col(result).alias("__g")), question, "left")
    hit = lambda c: F.coalesce(F.col(f"{c}.result") == F.col("__g"), F.lit(False))
    return rows.withColumns({"top1_correct": hit("top1").cast("int"), "top2_correct": (hit("top1") | hit("top2")).cast("int")}).drop("__g")


def pass_at_k(candidates: DataFrame, gold: DataFrame, question: str = "question_id", result: str = "result", gold_result: str = "gold_result") -> DataFrame:
    """(question, passed 0 or 1): whether any valid candidate has the gold result."""
    rows = candidates.join(gold.select(question, F.col(gold_result).alias("__g")), question, "left")
    return rows.groupBy(question).agg(F.max(F.coalesce((F.col(result) == F.col("__g")).cast("int"), F.lit(0))).alias("passed"))


def accuracy(judgements: DataFrame, correct: str, by: str | None = None) -> DataFrame:
    """(difficulty, total, accuracy): the share of correct ones overall (difficulty null) and, with by, for each of its values; rows with a null count as `simple`."""
    value = F.avg(F.col(correct).cast("double")).alias("accuracy")
    if by is None:
        return judgements.agg(F.count("*").alias("total"), value).select(F.lit(None).cast("string").alias("difficulty"), "total", "accuracy")
    return judgements.withColumn("difficulty", F.coalesce(F.col(by).cast("string"), F.lit("simple"))).rollup("difficulty").agg(F.count("*").alias("total"), value)


def metric_row(judgements: DataFrame, correct: str, by: str) -> DataFrame:
    """One row in the layout of a metric file: easy, medium and hard with their totals, all, acc and the places of what is correct (from 1)."""
    level = F.coalesce(F.col(by), F.lit("simple"))
    hit = F.col(correct).cast("double")
    cols: list[Column] = []
    for name, value in (("easy", "simple"), ("medium", "moderate"), ("hard", "challenging")):
        cols += [F.coalesce(F.avg(F.when(level == value, hit)), F.lit(0.0)).alias(name), F.count_if(level == value).alias(f"{name}_total")]
    return judgements.agg(*cols, F.avg(hit).alias("all"), F.count("*").alias("all_total"), F.avg(hit).alias("acc"))


def valid_candidates(sqls: Column, least: int = 2) -> Column:
    """Whether candidates (an array of texts) can be put to a vote: at least `least`, none null or under ten characters, all beginning with select."""
    fit = F.forall(sqls, lambda s: F.coalesce((F.length(F.trim(s)) >= 10) & F.startswith(F.lower(F.trim(s)), F.lit("select")), F.lit(False)))
    return F.coalesce((F.size(sqls) >= least) & fit, F.lit(False))


def true_positives(judgements: DataFrame, place: str, correct: str) -> DataFrame:
    """(tp_id): places, counted from 1, of what is correct, in order."""
    return judgements.filter(F.col(correct) == 1).select((F.col(place) + 1).alias("tp_id")).orderBy("tp_id")


def top2_for_prompt(votes: DataFrame, results: DataFrame, question: str = "question_id") -> DataFrame:
    """votes with both winners' queries and what they returned: results (question, sql, shown); where the second has no result, the first's is shown."""
    shown = results.select(question, F.col("sql").alias("__s"), F.col("shown").alias("__r")).dropDuplicates([question, "__s"])
    rows = votes.withColumns({"sql1": F.col("top1.sql"), "sql2": F.col("top2.sql")})
    for k in ("1", "2"):
        part = shown.select(question, F.col("__s").alias(f"sql{k}"), F.col("__r").alias(f"shown{k}"))
        rows = rows.join(part, [question, f"sql{k}"], "left")
    return rows.withColumn("shown2", F.coalesce("shown2", "shown1"))
