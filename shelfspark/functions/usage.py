"""Cost of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dollars per million tokens (input, output) and cache multipliers on input.
PRICING = {"fast": ("1.00", "5.00"), "reasoning": ("2.00", "10.00")}
CACHE_READ_MULTIPLIER = "0.1"
CACHE_WRITE_MULTIPLIER = "1.25"


def _dec(text: str) -> Column:
    return F.lit(text).cast("decimal(10,4)")


def estimate_cost(model: Column, input_tokens: Column, output_tokens: Column,
                  cache_read: Column, cache_write: Column,
                  pricing: dict[str, tuple[str, str]] = PRICING) -> Column:
    """Dollars as decimal(14,8); a model without a price is an error, never zero."""
    cost = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce(model, F.lit("null"))))
    cost = cost.cast("decimal(14,8)")
    for name, (rate_in, rate_out) in pricing.items():
        units = (
            input_tokens.cast("decimal(14,0)") * _dec(rate_in)
            + output_tokens.cast("decimal(14,0)") * _dec(rate_out)
            + cache_read.cast("decimal(14,0)") * _dec(rate_in) * _dec(CACHE_READ_MULTIPLIER)
            + cache_write.cast("decimal(14,0)") * _dec(rate_in) * _dec(CACHE_WRITE_MULTIPLIER))
        cost = F.when(model == name, (units / F.lit(1000000)).cast("decimal(14,8)")).otherwise(cost)
    return cost


def with_cost(usage: DataFrame, pricing: dict[str, tuple[str, str]] = PRICING) -> DataFrame:
    """Usage rows with cost_usd."""
    return usage.withColumn("cost_usd", estimate_cost(
        F.col("model"), F.col("input_tokens"), F.col("output_tokens"),
        F.col("cache_read_tokens"), F.col("cache_write_tokens"), pricing))
