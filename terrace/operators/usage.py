"""Tokens, costs, failures and budgets of model calls, as queries over a log of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators import relational

# Price of a prompt token and of a completion token by model.
PRICES = (
    ("gpt-4", 0.00003, 0.00006),
    ("gpt-4-32k", 0.00006, 0.00012),
    ("gpt-3.5-turbo", 0.0000015, 0.000002),
    ("claude-2", 0.00001102, 0.00003268),
)
#: Price of any token of a simulated call.
FLAT_PRICE = 0.00003


def tokens_by_bytes(text: Column) -> Column:
    """A quarter of the bytes, and one."""
    return F.floor(F.octet_length(text) / 4).cast("long") + 1


def tokens_by_chars(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def with_cost(calls: DataFrame, model: str = "model", prompt_tokens: str = "prompt_tokens", completion_tokens: str = "completion_tokens") -> DataFrame:
    """Adds cost by the price table; unknown models cost nothing."""
    prices = calls.sparkSession.createDataFrame(list(PRICES), "price_model string, price_in double, price_out double")
    joined = calls.join(F.broadcast(prices), F.col(model) == F.col("price_model"), "left")  # the table has a row for each model above
    cost = F.coalesce(F.col(prompt_tokens) * F.col("price_in") + F.col(completion_tokens) * F.col("price_out"), F.lit(0.0))
    return joined.withColumn("cost", cost).drop("price_model", "price_in", "price_out")


def totals(calls: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Calls and sums of measures by provider, model or session."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), *[F.sum(m).alias(m) for m in measures])


def failure_rates(calls: DataFrame, by: str, failed: Column) -> DataFrame:
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures")).withColumn("rate", F.coalesce(F.try_divide(F.col("failures").cast("double"), F.col("calls").cast("double")), F.lit(0.0)))


def within_budget(calls: DataFrame, budgets: DataFrame, by: str, order: list[str], cost: str) -> DataFrame:
    """Adds spent, the provider's running cost, and allowed: whether it keeps within the budget (none: any).

    The costs are added up in stretches of the first column of the order (:func:`relational.running_sum`), so the calls of a
    busy provider do not meet in one task.
    """
    spent = relational.running_sum(calls, [by], order, cost, "spent")
    return spent.join(budgets, by, "left").withColumn("allowed", F.coalesce(F.col("spent") <= F.col("budget"), F.lit(True)))


def timing_stats(timings: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return timings.groupBy(*by).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"))
