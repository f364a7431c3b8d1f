"""Diagnostics of a corpus: frequency tables, duplicates, conflicts and overlaps between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequencies(rows: DataFrame, by: list[str], dimensions: dict[str, Column]) -> DataFrame:
    """``(*by, dimension, key, n)``: independent counts of each dimension, in one scan and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("key")) for n, c in dimensions.items()])
    return rows.select(*by, F.explode(pairs).alias("p")).select(*by, "p.dimension", "p.key").groupBy(*by, "dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def duplicate_surplus(rows: DataFrame, by: list[str], key: Column) -> DataFrame:
    """``(*by, rows, distinct_keys, surplus)``; null keys are no keys."""
    groups = rows.select(*by, key.alias("k")).where("k is not null").groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(*by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"), F.sum(F.col("n") - 1).alias("surplus"))


def conflicts(rows: DataFrame, key: Column, value: Column, split: Column) -> DataFrame:
    """``(key, targets, splits)``: keys with more than one target, with the sorted splits they stand in."""
    r = rows.select(key.alias("key"), value.alias("v"), split.alias("s")).where("key is not null and v is not null").distinct()
    return r.groupBy("key").agg(F.countDistinct("v").alias("targets"), F.array_join(F.array_sort(F.collect_set("s")), ",").alias("splits")).where("targets > 1")


def overlaps(rows: DataFrame, surface: Column, split: Column) -> DataFrame:
    """``(left_split, right_split, surfaces)``: how many surfaces each pair of splits shares.

    A surface's splits are few, so pairs are made of them and never of rows.
    """
    sets = rows.select(surface.alias("k"), split.alias("s")).where("k is not null and s is not null").groupBy("k").agg(F.array_sort(F.collect_set("s")).alias("ss")).where(F.size("ss") > 1)
    pairs = F.flatten(F.transform("ss", lambda a: F.transform(F.filter("ss", lambda b: b > a), lambda b: F.struct(a.alias("left_split"), b.alias("right_split")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.left_split", "p.right_split").agg(F.count(F.lit(1)).alias("surfaces"))


def first_of_each(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; with ties in the order, any one of equal rows."""
    from pyspark.sql import Window

    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def id_check(rows: DataFrame, key: str) -> DataFrame:
    """``(rows, distinct_ids, null_ids)``."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_ids"), F.count_if(F.col(key).isNull()).alias("null_ids"))


def quota_differences(actual: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose count ``n`` differs from the expected one, either way; missing groups count 0."""
    a, e = actual.withColumnRenamed("n", "actual_n"), expected.withColumnRenamed("n", "expected_n")
    both = a.join(e, by, "full_outer").select(*by, F.coalesce("actual_n", F.lit(0)).alias("actual_n"), F.coalesce("expected_n", F.lit(0)).alias("expected_n"))
    return both.where("actual_n != expected_n")
