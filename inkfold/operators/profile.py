"""Latency and token profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stages(rows: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """``(scope, stage, n, mean, p50, p95, min, max)`` of columns named by scope, in one scan; nulls are left out.

    Percentiles are nearest ranks.
    """
    cells = [F.struct(F.lit(s).alias("scope"), F.lit(c).alias("stage"), F.col(c).cast("double").alias("v")) for s, cs in scopes.items() for c in cs]
    long = rows.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("v is not null")
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by v)")
    return long.groupBy("scope", "stage").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.min("v").alias("min"), F.max("v").alias("max"))


def tokens(rows: DataFrame, by: str) -> DataFrame:
    """Mean tokens of each model, without nulls, and output's share as a ratio of means."""
    return rows.groupBy(by).agg(
        F.avg("input_tokens").alias("mean_input"),
        F.avg("output_tokens").alias("mean_output"),
        F.avg("total_tokens").alias("mean_total"),
        F.try_divide(F.avg("output_tokens"), F.avg("total_tokens")).alias("output_share"),
        F.avg(F.try_divide(F.col("latency_ms"), F.col("output_tokens"))).alias("ms_per_token"),
    )
