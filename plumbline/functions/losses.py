"""The preference loss and its reward metrics as Column functions, for reports over logged log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reward(policy: Column, reference: Column, beta: float) -> Column:
    return beta * (policy - reference)


def margin_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, margin: Column, beta: float = 0.1, alpha: float = 0.0) -> Column:
    """-log sigmoid(beta * difference of log ratios + alpha * margin), in the form that does not overflow."""
    z = beta * ((chosen - rejected) - (ref_chosen - ref_rejected)) + alpha * F.coalesce(margin, F.lit(0.0))
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))


def reward_metrics(df: DataFrame, beta: float = 0.1, alpha: float = 0.0) -> DataFrame:
    """One row over (chosen, rejected, ref_chosen, ref_rejected, margin): mean loss, rewards, accuracy and reward margin."""
    a, b = reward(F.col("chosen"), F.col("ref_chosen"), beta), reward(F.col("rejected"), F.col("ref_rejected"), beta)
    return df.agg(
        F.avg(margin_loss(*map(F.col, ("chosen", "rejected", "ref_chosen", "ref_rejected", "margin")), beta, alpha)).alias("loss"), F.avg(a).alias("rewards_chosen"), F.avg(b).alias("rewards_rejected"),
        F.avg((a > b).cast("double")).alias("rewards_accuracy"), F.avg(a - b).alias("rewards_margin"),
    )
