"""Problems 3 and 7: samples of given composition, and samples that stay as data grows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.session import cut, small

#: Units that one task balances at once, and groups that merge at each level.
GROUP, FAN = 20_000, 8
TARGET_BYTES = 8 << 20  # most bytes of targets that are broadcast


def _plain(c: str | Column) -> Column:
    return F.lower(F.trim(c))


def supply(units: DataFrame, targets: DataFrame, divisor: int = 5) -> DataFrame:
    """``targets`` with ``wanted`` and ``available``.

    ``units`` has ``example_id, category, context_variant``. With D distinct examples, N = floor(D / divisor) and wanted
    is the larger of min_rows and floor(target_share * N + 0.5). Available counts distinct examples of the category and
    variant, without outer blanks and case. Null examples, categories and variants count nowhere; repeated rows once.
    """
    known = units.where("example_id is not null")
    n = known.agg(F.floor(F.countDistinct("example_id") / divisor).alias("n"))
    cells = known.groupBy(_plain("category").alias("_c"), _plain("context_variant").alias("_v")).agg(F.countDistinct("example_id").alias("available"))
    t = targets.select("category", "context_variant", "target_share", "min_rows").crossJoin(F.broadcast(n))  # n is one row
    on = (_plain(t["category"]) == F.col("_c")) & (_plain(t["context_variant"]) == F.col("_v"))
    wanted = F.greatest(F.col("min_rows").cast("long"), F.floor(F.col("target_share") * F.col("n") + 0.5).cast("long"))
    return t.join(cells, on, "left").select("category", "context_variant", "target_share", "min_rows", wanted.alias("wanted"), F.coalesce("available", F.lit(0)).alias("available"))


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities to 0 or 1 while the sums over the columns of ``x`` (of units by variables, each
    divided by its own probability beforehand) stay. Units that no move can settle stay fractional, at most one more
    than there are variables."""
    p = p.copy()
    eps = 1e-9
    todo = [i for i in range(len(p) - 1, -1, -1) if eps < p[i] < 1 - eps]
    q = x.shape[1]
    work: list[int] = []
    while True:
        while len(work) < q + 1 and todo:
            work.append(todo.pop())
        if not work:
            break
        a = x[work].T
        active = np.abs(a).sum(axis=1) > 0
        a = a[active]
        rank = np.linalg.matrix_rank(a) if len(a) else 0
        if len(work) <= rank:
            if not todo:
                break
            work.append(todo.pop())
            continue
        u = np.linalg.svd(a)[2][-1] if len(a) else np.eye(len(work))[0]
        u[np.abs(u) < 1e-9] = 0
        w = p[work]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - w) / u, np.where(u < 0, -w / u, np.inf)).min()
            down = np.where(u > 0, w / u, np.where(u < 0, (w - 1) / u, np.inf)).min()
        step = up if rng.random() < down / (up + down) else -down
        p[work] = np.clip(w + step * u, 0, 1)
        work = [i for i in work if eps < p[i] < 1 - eps]
    return np.where(p < eps, 0.0, np.where(p > 1 - eps, 1.0, p))


def land(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle what the flight left, giving up one variable after the other from the last."""
    for q in range(x.shape[1], -1, -1):
        p = flight(p, x[:, :q], rng)
        if ((p == 0) | (p == 1)).all():
            break
    return p


def _rank(salt: str, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(salt), F.col(key).cast("string")), 256)


def balanced_sample(units: DataFrame, targets: DataFrame, divisor: int = 5, salt: str = "cube-v1") -> tuple[DataFrame, DataFrame]:
    """A sample of examples of the wanted composition: ``(example_id, category, context_variant)``, and its report.

    Each example is drawn with probability wanted / available of its cell. Flight phases run on groups of hashed
    examples, balanced on the cells' indicators; what stays open, at most a few units a group, moves up to groups of
    groups, and the last group lands. Neither rows' order nor partitions matter. An example with several categories
    counts for the least of them that is a target. The report has, for each target, wanted, available, selected and the residual
    ``selected - least(wanted, available)``. Nulls take no part; empty tables give an empty sample.
    """
    t = cut(supply(units, targets, divisor))
    cell = t.select(_plain("category").alias("_c"), _plain("context_variant").alias("_v"), "wanted", "available").where("available > 0")
    cell = F.broadcast(cell) if small(targets, TARGET_BYTES) else cell
    # an example's cell is the least of those that targets name, as supply() counts them
    of = units.where("example_id is not null").select("example_id", _plain("category").alias("_c"), _plain("context_variant").alias("_v")).join(cell, ["_c", "_v"])
    one = of.groupBy("example_id").agg(F.min(F.struct("_c", "_v", "wanted", "available")).alias("s")).select("example_id", "s.*")
    drawn = cut(one.select("example_id", "_c", "_v", F.least(F.lit(1.0), F.col("wanted") / F.col("available")).alias("p"), _rank(salt, "example_id").alias("h")))
    groups = max(1, -(-drawn.count() // GROUP))
    schema = "example_id string, _c string, _v string, p double, h string, g long"

    def settle(last: bool):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["h", "example_id"]).reset_index(drop=True)
            rng = np.random.default_rng(int(g["h"].iloc[0][:12], 16))
            p = g["p"].to_numpy(copy=True)
            # indicators of different cells share no unit, so each cell flies by itself; then what is left, on its number
            for _, at in sorted(g.groupby(["_c", "_v"]).indices.items()):
                p[at] = flight(p[at], np.ones((len(at), 1)), rng)
            if last and len(open_ := np.nonzero((p > 0) & (p < 1))[0]):
                p[open_] = land(p[open_], np.ones((len(open_), 1)), rng)
            g["p"] = p
            return g

        return run

    level = drawn.withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups)))
    chosen = []
    while True:
        done = cut(level.groupBy("g").applyInPandas(settle(groups == 1), schema))
        chosen.append(done.where("p = 1").select("example_id", "_c", "_v"))
        if groups == 1:
            break
        groups = -(-groups // FAN)
        level = done.where("p > 0 and p < 1").withColumn("g", F.pmod("g", F.lit(groups)))
    sample = chosen[0]
    for c in chosen[1:]:
        sample = sample.union(c)
    selected = sample.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("selected"))
    on = (_plain(t["category"]) == selected["_c"]) & (_plain(t["context_variant"]) == selected["_v"])
    k = F.coalesce("selected", F.lit(0))
    report = t.join(selected, on, "left").select("category", "context_variant", "target_share", "wanted", "available", k.alias("selected"), (k - F.least("wanted", "available")).alias("residual"))
    return sample.withColumnsRenamed({"_c": "category", "_v": "context_variant"}), report


def stable_sample(rows: DataFrame, family_rate: float, example_rate: float, salt: str = "sample-v1") -> DataFrame:
    """``(family_id, example_id)``: distinct members of a sample that depends on the keys and the salt alone.

    A key's salted hash is its place in the unit interval, and it is kept below the rate; so the sample is the same in
    every run and partitioning, and rows that come later add members but never remove one. Raising a rate adds members
    too. Null keys are never sampled; empty keys are keys.
    """
    family, example = (F.sha2(F.concat(F.lit(f"{salt}:{k}:"), F.col(k)), 256) for k in ("family_id", "example_id"))
    return rows.where((family < threshold(family_rate)) & (example < threshold(example_rate))).select("family_id", "example_id").distinct()


def threshold(rate: float) -> str:
    """The hexadecimal digits that a share ``rate`` of all hashes lies below."""
    return "g" if rate >= 1 else f"{int(max(0.0, rate) * (1 << 52)):013x}"
