"""Word windows, typing bursts and session gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.functions import text as T


def chunks(text: Column, size: int) -> Column:
    """Windows of ``size`` words at 0, size, 2 size, ..., the last one shorter; none of a blank text."""
    w = T.words(text)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))


def finished_chunks(text: Column, size: int) -> Column:
    """Windows of ``size`` whole words; the last word is whole only if white space follows it."""
    w = T.words(text)
    n = F.size(w) - F.when(text.rlike(r"\S$"), 1).otherwise(0)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))


def trailing(text: Column, n: int) -> Column:
    """The last ``n`` words."""
    w = T.words(text)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")


def random_window(text: Column, key: Column, size: Column, seed: str) -> Column:
    """A contiguous window of ``size`` words at a start that the key's hash decides; null where the text is shorter."""
    w = T.words(text)
    start = F.pmod(F.xxhash64(F.lit(seed), key), F.greatest(F.size(w) - size + 1, F.lit(1))).cast("int") + 1
    return F.when(F.size(w) >= size, F.array_join(F.slice(w, start, size), " "))


def session_gaps(events: DataFrame, key: str, ts: str, order: str, gap_seconds: int) -> DataFrame:
    """``(key, session, n, started, ended)``: runs of a key's events without a gap beyond ``gap_seconds``."""
    w = W.partitionBy(key).orderBy(ts, order)
    since = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    marked = events.where(F.col(ts).isNotNull()).withColumn("_new", F.when(since > gap_seconds * 1_000_000, 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def within_budget(rows: DataFrame, key: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """The first occurrences of each key's texts, in order, as long as they fit into ``budget`` characters."""
    first = rows.where(F.coalesce(F.trim(text), F.lit("")) != "").withColumn("_n", F.row_number().over(W.partitionBy(*key, text).orderBy(*order))).where("_n = 1").drop("_n")
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return first.withColumn("_sum", F.sum(F.length(text)).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def early_exit(votes: DataFrame, key: list[str], order: str, choice: str, needed: int = 3) -> DataFrame:
    """For each key the first row at which a choice reaches ``needed`` votes: ``(*key, choice, order)``."""
    w = W.partitionBy(*key, choice).orderBy(order)
    reached = votes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == needed)
    return reached.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(order, choice))).where("_r = 1").select(*key, choice, order)
