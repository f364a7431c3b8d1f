"""Quotas, allocations and seeded selections. A row's place depends on its key and the seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.session import cut


def place(seed: str, key: Column) -> Column:
    """A row's place in a seeded shuffle: the same in every run and partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def laid_out(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` in order over range partitions, fixed by a lineage cut, with ``_part`` and the place ``_at`` in it."""
    s = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    m = F.monotonically_increasing_id()
    return cut(s.select("*", F.shiftright(m, 33).cast("int").alias("_part"), m.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with their ordinal from 0 in an order, without bringing them into one task: only the partitions'
    counts are summed up, and those are as many as partitions."""
    s = laid_out(rows, order)
    counts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return s.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def largest_remainder(groups: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``(key, allocated)``: ``total`` shared out by weight, the rest by largest remainder, ties by key. Groups are few."""
    everything = W.partitionBy()
    exact = F.col(weight) * F.lit(total) / F.sum(weight).over(everything)
    g = groups.where(F.col(weight) > 0).select(key, exact.alias("x")).withColumn("base", F.floor("x"))
    left = F.lit(total) - F.sum("base").over(everything)
    rank = F.row_number().over(everything.orderBy(F.desc(F.round(F.col("x") - F.col("base"), 9)), key))
    return g.select(key, (F.col("base") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("allocated"))


def water_fill(groups: DataFrame, key: str, capacity: str, total: int) -> DataFrame:
    """``(key, allocated)``: ``total`` shared out evenly, one at a time in key order, until capacities are full.

    A group with capacity c can take at levels 1..c; with groups in order of capacity the level that is reached is
    found from running sums, without laying out single places.
    """
    everything = W.partitionBy()
    g = groups.select(key, F.greatest(F.coalesce(capacity, F.lit(0)), F.lit(0)).cast("long").alias("c"))
    w = everything.orderBy("c", key)
    below = F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.count(F.lit(1)).over(everything) - F.row_number().over(w) + 1
    g = g.withColumn("full", below + F.col("c") * rest)  # what is shared out when this group is full
    g = g.withColumn("room", F.lit(total) - below).withColumn("rest", rest)
    first = F.min(F.when(F.col("full") > total, F.struct("c", key, "room", "rest"))).over(everything)
    g = g.withColumn("f", first)
    level = F.floor(F.col("f.room") / F.col("f.rest"))
    extra = F.pmod(F.col("f.room"), F.col("f.rest"))
    open_ = F.struct("c", F.col(key)) >= F.struct(F.col("f.c"), F.col(f"f.{key}"))
    more = F.row_number().over(W.partitionBy(F.coalesce(open_, F.lit(False)), F.col("c") > level).orderBy(key)) <= extra
    amount = F.when(F.col("f").isNull() | ~open_, F.col("c")).otherwise(level + F.when((F.col("c") > level) & more, 1).otherwise(0))
    return g.select(key, F.least(amount, F.col("c")).cast("long").alias("allocated"))


def stratified(rows: DataFrame, key: str, strata: list[str], quotas: DataFrame, seed: str) -> DataFrame:
    """The first rows of each stratum in the seeded shuffle, up to its ``quota``. Strata without a quota give none."""
    ranked = rows.withColumn("_place", place(seed, F.col(key))).join(quotas, strata)
    return ranked.withColumn("_rank", F.row_number().over(W.partitionBy(*strata).orderBy("_place", key))).where(F.col("_rank") <= F.col("quota")).drop("_rank", "_place", "quota")


def bucketed(rows: DataFrame, strata: list[str], order: list[Column], quotas: DataFrame, bucket: str) -> DataFrame:
    """Rows of each stratum dealt to buckets by running quota: ``quotas`` has (*strata, bucket, quota), buckets in order."""
    edges = quotas.withColumn("_to", F.sum("quota").over(W.partitionBy(*strata).orderBy(bucket))).withColumn("_from", F.col("_to") - F.col("quota"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*strata).orderBy(*order)))
    joined = ranked.join(edges, strata).where((F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to")))
    return joined.drop("_rank", "_from", "_to", "quota")


def systematic(rows: DataFrame, order: list[str], step: int, size: int) -> DataFrame:
    """Every ``step``-th row of an order, ``size`` at most."""
    return numbered(rows, order, "_i").where((F.col("_i") % step == 0) & (F.col("_i") < step * size)).drop("_i")


def hash_split(rows: DataFrame, key: str, shares: dict[str, float], seed: str, out: str = "split") -> DataFrame:
    """Rows with a split that all rows of a key share, by the key's place in the unit interval."""
    u = F.conv(F.substring(place(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(16**8)
    total, edge, c = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        edge += share / total
        c = F.when(u < edge, name) if c is None else c.when(u < edge, name)
    return rows.withColumn(out, F.when(F.col(key).isNotNull(), c.otherwise(name)))


def select_splits(rows: DataFrame, quotas: dict[str, int], surface: list[str], family: str, seed: str) -> DataFrame:
    """Splits chosen one after the other, each without families and surfaces of those before: ``(..., split)``.

    Within a split, a family gives one row and a surface occurs once; rows come in seeded order.
    """
    left, out = cut(rows.withColumn("_place", place(seed, F.concat_ws(":", family, *surface)))), None
    for name, quota in quotas.items():
        one = left.withColumn("_f", F.row_number().over(W.partitionBy(family).orderBy("_place"))).where("_f = 1").drop("_f")
        for s in surface:
            one = one.withColumn("_s", F.row_number().over(W.partitionBy(s).orderBy("_place"))).where("_s = 1").drop("_s")
        chosen = cut(one.orderBy("_place", family).limit(quota).withColumn("split", F.lit(name)))
        out = chosen if out is None else out.unionByName(chosen)
        left = left.join(chosen.select(family), family, "left_anti")
        for s in surface:
            left = left.join(chosen.select(s), s, "left_anti")
    return out.drop("_place")
