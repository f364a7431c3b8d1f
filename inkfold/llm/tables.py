"""The columns of the context table that the problems name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def context_fields(context: DataFrame) -> DataFrame:
    """The fields of the problems, flat. A missing snippet, or any missing struct, gives nulls."""
    snippet = F.get("input.context_snippets", F.lit(0))
    return context.select(
        "row_id",
        F.col("input.text").alias("text"),
        snippet.getField("visible_text").alias("visible_text"),
        snippet.getField("window_title").alias("window_title"),
        F.col("metadata.family_id").alias("family_id"),
        F.col("metadata.category").alias("category"),
        F.col("metadata.context_variant").alias("context_variant"),
        F.col("metadata.example_id").alias("example_id"),
        F.col("metadata.source_partition").alias("split"),
        F.col("metadata.source_dataset").alias("source"),
    )


def long_fields(fields: DataFrame, *names: str) -> DataFrame:
    """One row ``(row_id, field, value)`` for each named field, in one scan."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names])
    return fields.select("row_id", F.explode(pairs).alias("_f")).select("row_id", "_f.field", "_f.value")
