"""Learned replacements: mining, trust and lookups with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.functions.edits import replacements


def mined(examples: DataFrame, profile: str, order: list[str], draft: str, committed: str) -> DataFrame:
    """``(profile, *order, pos, shorthand, expansion)``: the word replacements of each example."""
    pairs = F.posexplode(replacements(F.col(draft), F.col(committed))).alias("pos", "p")
    return examples.where(F.col(draft).isNotNull() & F.col(committed).isNotNull()).select(profile, *order, pairs).select(profile, *order, "pos", "p.shorthand", "p.expansion")


def trailing_runs(pairs: DataFrame, profile: str, order: list[str]) -> DataFrame:
    """``(profile, shorthand, expansion, trust)``: the last expansion and how often it came in a row at the end.

    A different expansion starts over at 1. One hot profile is spread by shorthand.
    """
    w = W.partitionBy(profile, "shorthand").orderBy(*[F.col(c).desc() for c in (*order, "pos")])
    last = F.first("expansion").over(w)
    other = F.sum(F.when(F.col("expansion") != last, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    run = pairs.withColumn("_last", last).withColumn("_other", other).where("_other = 0")
    return run.groupBy(profile, "shorthand").agg(F.first("expansion").alias("expansion"), F.count(F.lit(1)).alias("trust"))


def for_request(trusted: DataFrame, profile: str, least: int = 2, top: int = 8) -> DataFrame:
    """Each profile's patterns of enough trust, most trusted first, ties by shorthand."""
    w = W.partitionBy(profile).orderBy(F.desc("trust"), "shorthand")
    return trusted.where(F.col("trust") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def lookup(requests: DataFrame, entries: DataFrame, key: str, probes: list[dict[str, Column]], columns: list[str], order: str) -> DataFrame:
    """For each request the entry of its first probe that has one, then of least ``order``.

    A probe gives a value for each of ``columns``; all probes go through one equi-join.
    """
    ranked = F.array(*[F.struct(F.lit(i).alias("probe"), *[p[c].alias(c) for c in columns]) for i, p in enumerate(probes)])
    tries = requests.select(key, F.explode(ranked).alias("t")).select(key, "t.*")
    hits = tries.join(entries, columns)
    w = W.partitionBy(key).orderBy("probe", order)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def substitute(rows: DataFrame, key: str, text: str, patterns: DataFrame, out: str = "expanded") -> DataFrame:
    """``rows`` with ``text`` where words with a pattern(shorthand, expansion) are replaced; each row's words are joined."""
    words = rows.select(key, F.posexplode(F.split(text, " ")).alias("pos", "word"))
    hit = words.join(patterns.select("shorthand", "expansion"), F.lower("word") == F.col("shorthand"), "left")
    joined = hit.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("expansion", "word").alias("w")))), lambda x: x["w"]), " ").alias(out))
    return rows.join(joined, key, "left")
