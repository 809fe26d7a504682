"""Event-time usage and latency aggregates on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.telemetry import CHAT_BOUNDS, TOKENS, quantile_from_counts


def stream_usage(usage: DataFrame, lateness: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Calls, tokens and cost per model and window."""
    return (usage.withWatermark("created_at", lateness)
            .groupBy(F.window("created_at", size).alias("w"), "model")
            .agg(F.count("*").alias("calls"), *[F.sum(t).alias(t) for t in TOKENS],
                 F.sum("cost_usd").alias("cost_usd"))
            .select(F.col("w.start").alias("window_start"), "model", "calls", *TOKENS, "cost_usd"))


def stream_latency(events: DataFrame, keys: Sequence[str], seconds: str,
                   bounds: Sequence[float] = CHAT_BOUNDS, lateness: str = "10 minutes",
                   size: str = "5 minutes", slide: str = "1 minute",
                   quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Bucket-based latency quantiles per key and sliding window."""
    counts = (events.withWatermark("ts", lateness)
              .groupBy(*keys, F.window("ts", size, slide).alias("w"))
              .agg(*[F.count_if(F.col(seconds) <= b).alias(f"_le{i}")
                     for i, b in enumerate(bounds)], F.count("*").alias("_n")))
    return counts.select(*keys, F.col("w.end").alias("at"), F.col("_n").alias("n"), *[
        quantile_from_counts(p, bounds).alias(f"p{int(p * 100)}") for p in quantiles])
