"""Selections that go step by step over few buckets or slots: the steps run on the driver, over counts; rows stay in Spark."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.operators.rules import DIMENSIONS

MOST_BUCKETS = 1_000_000  # whose counts the driver holds; more are an error, never dropped


def by_quality(judged: DataFrame, buckets: list[str], key: str = "candidate_id") -> DataFrame:
    """``judged`` with ``rank``, the order of quality in each bucket: least score, sum of scores, value, grounding, key.

    A missing score counts 0.
    """
    s = [F.coalesce(f"scores.{d}", F.lit(0)) for d in DIMENSIONS]
    total = s[0]
    for c in s[1:]:
        total = total + c
    w = W.partitionBy(*buckets).orderBy(F.least(*s).desc(), total.desc(), F.coalesce("scores.dataset_value", F.lit(0)).desc(), F.coalesce("scores.context_grounding", F.lit(0)).desc(), key)
    return judged.withColumn("rank", F.row_number().over(w))


def deficits_first(available: dict[tuple, int], targets: list[dict], total: int) -> dict[tuple, int]:
    """How many to take of each bucket: one after the other from the bucket whose values lack most, the first
    dimension counting most; of equal buckets the one with the larger names.

    What a value lacks only falls, so a heap of buckets needs to look again only at the one on top.
    """
    left, lack, taken = dict(available), [dict(t) for t in targets], dict.fromkeys(available, 0)
    order = {b: i for i, b in enumerate(sorted(left, key=lambda b: tuple(map(str, b)), reverse=True))}
    need = lambda b: (*(-lack[i].get(v, 0) for i, v in enumerate(b)), order[b])
    heap = [(need(b), b) for b, n in left.items() if n > 0]
    heapq.heapify(heap)
    while heap and total > 0:
        seen, best = heapq.heappop(heap)
        now = need(best)
        if now != seen:
            heapq.heappush(heap, (now, best))
            continue
        left[best] -= 1
        taken[best] += 1
        total -= 1
        for i, v in enumerate(best):
            lack[i][v] = lack[i].get(v, 0) - 1
        if left[best]:
            heapq.heappush(heap, (need(best), best))
    return taken


def complete_groups(judged: DataFrame, group: str, key: str, size: int, most: int) -> DataFrame:
    """The rows of groups of which all ``size`` members are here, at most so many rows, groups in order of name. They
    are taken before single rows, so that contrasts stay whole."""
    g = judged.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(key).alias("_n")).where(F.col("_n") == size)
    first = g.orderBy(group).limit(most // size).select(group)
    return judged.join(first, group, "left_semi")


def select(ranked: DataFrame, buckets: list[str], targets: list[dict], total: int) -> DataFrame:
    """The best rows of each bucket, as many as ``deficits_first`` takes. Only the buckets' counts reach the driver."""
    counts = ranked.groupBy(*buckets).count().limit(MOST_BUCKETS + 1).collect()
    if len(counts) > MOST_BUCKETS:
        raise ValueError(f"more than {MOST_BUCKETS} buckets")
    taken = deficits_first({tuple(r[b] for b in buckets): r["count"] for r in counts}, targets, total)
    kinds = ", ".join(f"{b} {ranked.schema[b].dataType.simpleString()}" for b in buckets)
    quota = ranked.sparkSession.createDataFrame([(*b, n) for b, n in taken.items() if n], f"{kinds}, _take int")
    on = [ranked[b].eqNullSafe(quota[b]) for b in buckets]
    return ranked.join(F.broadcast(quota), on).where(F.col("rank") <= F.col("_take")).select(*[ranked[c] for c in ranked.columns])


def pack(groups: list[tuple[str, int]], capacity: int) -> list[list[str]]:
    """Groups in order in batches of at most ``capacity`` members; a group stays whole, a larger one is a batch of its own."""
    out: list[list[str]] = []
    room = 0
    for name, size in groups:
        if out and size <= room:
            out[-1].append(name)
            room -= size
        else:
            out.append([name])
            room = capacity - size
    return out


def take_whole(groups: list[tuple[str, int]], wanted: int) -> list[str] | None:
    """Groups that have exactly so many members together, the earliest ones possible; None if there are none."""
    reach: dict[int, tuple[int, ...]] = {0: ()}
    for i, (_, size) in enumerate(groups):
        for have in sorted(reach, reverse=True):
            if have + size <= wanted and have + size not in reach:
                reach[have + size] = (*reach[have], i)
    return [groups[i][0] for i in reach[wanted]] if wanted in reach else None


def take_exact(groups: list[tuple[str, int]], wanted: int) -> list[tuple[str, int]]:
    """``(group, members)`` of exactly ``wanted`` members in all, if there are as many: groups in order that fit whole,
    then members of the first that did not, so that at most one group is split."""
    out, left, late = [], wanted, []
    for name, size in groups:
        if size <= left:
            out.append((name, size))
            left -= size
        else:
            late.append((name, size))
    if left and late:
        out.append((late[0][0], left))
    return out
