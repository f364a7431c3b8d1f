"""Scoring, ranking and roll-ups of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.functions.distance import ratio_of
from inkfold.operators.rules import suggestion_of
from inkfold.operators.sampling import laid_out

BATCH = 5
# The parts of a completion's score.
FORM, DECISION, CONTENT, NEAR = 0.15, 0.25, 0.60, 0.25


def last_prediction(predictions: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last prediction of each key; rows without a key are left out."""
    w = W.partitionBy(*key).orderBy(F.col(order).desc())
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    return predictions.where(known).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def completions(rows: DataFrame, keep: list[str], responses: str = "responses") -> DataFrame:
    """One row for each of the first five responses: ``(*keep, idx, response, suggestion)``."""
    r = rows.select(*keep, F.posexplode(F.slice(F.coalesce(responses, F.array().cast("array<string>")), 1, BATCH)).alias("idx", "response"))
    return r.withColumn("suggestion", suggestion_of(F.col("response")))


def judged(c: DataFrame, draft: str, accepted: str, changed: str) -> DataFrame:
    """Completions with ``schema_ok, decision_ok, exact``. Texts are accepted folded; the decision compares them so too."""
    fold = T.fold
    s = fold(F.col("suggestion"))
    exact = F.exists(F.transform(F.coalesce(accepted, F.array().cast("array<string>")), fold), lambda a: a == s)
    return c.select(
        "*",
        F.col("suggestion").isNotNull().alias("schema_ok"),
        F.coalesce((s != fold(F.col(draft))) == F.col(changed), F.lit(False)).alias("decision_ok"),
        F.coalesce(exact, F.lit(False)).alias("exact"),
    )


def completion_score(near: Column | None = None) -> Column:
    """Score of a judged completion; ``near`` is the best similarity to an accepted text, 0 if not given."""
    content = F.when(F.col("exact"), CONTENT).otherwise(NEAR * (near if near is not None else F.lit(0.0)))
    return F.when(~F.col("schema_ok"), 0.0).when(~F.col("decision_ok"), FORM).otherwise(F.least(F.lit(1.0), F.lit(FORM) + DECISION + content))


def fuzzy_scores(j: DataFrame, accepted: str, keep: list[str]) -> DataFrame:
    """``(*keep, idx, score)`` with the similarity of suggestions that are not accepted; only those reach Python."""
    settled = j.where("exact or not schema_ok or not decision_ok").select(*keep, "idx", F.round(completion_score(), 6).alias("score"))
    open_ = j.where("not exact and schema_ok and decision_ok").select(*keep, "idx", "exact", "schema_ok", "decision_ok", "suggestion", F.explode_outer(accepted).alias("a"))
    near = open_.withColumn("r", ratio_of(T.fold(F.col("suggestion")), T.fold(F.col("a")))).groupBy(*keep, "idx", "exact", "schema_ok", "decision_ok").agg(F.max("r").alias("r"))
    return settled.union(near.select(*keep, "idx", F.round(completion_score(F.coalesce("r", F.lit(0.0))), 6).alias("score")))


def vote_rank(c: DataFrame, keep: list[str], original: str | None = None, top: int = BATCH) -> DataFrame:
    """``(*keep, suggestion, votes, first_idx, rank)``: suggestions by votes, then by first occurrence.

    ``original`` names a column of the draft, which is no candidate.
    """
    rows = c.where("suggestion is not null")
    if original:
        rows = rows.where(~F.col("suggestion").eqNullSafe(F.col(original)))
    g = rows.groupBy(*keep, "suggestion").agg(F.count(F.lit(1)).alias("votes"), F.min("idx").alias("first_idx"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy(*keep).orderBy(F.desc("votes"), "first_idx"))).where(F.col("rank") <= top)


def evaluation(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Roll-up of each model's answers: all examples, and each category.

    ``gold``: label, example_id, draft, accepted, changed, category, one row for each model and example.
    ``predictions``: label, example_id, prediction_seq, responses; the last one wins. A missing prediction counts as an example and in the completions' denominators
    (five an example), but not among unchanged examples. A success needs a whole batch of five with its form right
    and an accepted text (the draft itself, for unchanged ones) ranked first.
    """
    last = last_prediction(predictions.select("example_id", "label", "prediction_seq", "responses"), ["example_id", "label"], "prediction_seq").withColumn("has", F.lit(True)).drop("prediction_seq")
    rows = gold.select("label", "example_id", "draft", "accepted", "changed", "category").join(last, ["example_id", "label"], "left")
    keep = ["label", "category", "changed"]
    items = F.transform(F.slice(F.coalesce("responses", F.array().cast("array<string>")), 1, BATCH), lambda r: F.struct(suggestion_of(r).alias("s")))
    rows = rows.withColumn("items", items).withColumn("folded", F.transform("accepted", T.fold)).withColumn("plain", T.fold(F.col("draft")))
    s = F.transform("items", lambda x: T.fold(x["s"]))
    ok = F.transform(s, lambda x: F.coalesce(F.array_contains("folded", x), F.lit(False)))
    decided = F.transform(s, lambda x: F.coalesce((x != F.col("plain")) == F.col("changed"), F.lit(False)))
    count = lambda c: F.size(F.filter(c, lambda x: x))
    distinct = F.array_distinct(F.filter(F.transform("items", lambda x: x["s"]), lambda x: x.isNotNull()))
    votes = F.transform(distinct, lambda d: F.struct((-F.size(F.filter("items", lambda x: x["s"] == d))).alias("v"), F.array_position(F.transform("items", lambda x: x["s"]), d).alias("i"), d.alias("s")))
    others = F.filter(votes, lambda v: v["s"] != F.col("draft"))
    top = F.get(F.array_sort(others), F.lit(0))["s"]
    per = rows.select(
        *keep,
        F.col("has").isNull().alias("missing"),
        F.size("items").alias("n"),
        F.size(F.filter("items", lambda x: x["s"].isNotNull())).alias("n_schema"),
        count(decided).alias("n_decision"),
        count(ok).alias("n_exact"),
        (F.size(F.coalesce("responses", F.array().cast("array<string>"))) != BATCH).alias("incomplete"),
        F.when(F.col("changed"), F.coalesce(F.array_contains("folded", T.fold(top)), F.lit(False))).otherwise(F.size(others) == 0).alias("top_ok"),
        (F.size(others) > 0).alias("edits"),
    )
    whole = (F.col("n") == BATCH) & (F.col("n_schema") == BATCH)
    return (
        per.groupingSets([[F.col("label")], [F.col("label"), F.col("category")]], F.col("label"), F.col("category"))
        .agg(
            F.grouping("category").cast("int").alias("total"),
            F.count(F.lit(1)).alias("examples"),
            F.count_if("missing").alias("missing"),
            F.count_if(~F.col("missing") & F.col("incomplete")).alias("incomplete_batches"),
            (F.sum("n_schema") / (F.count(F.lit(1)) * BATCH)).alias("schema_rate"),
            (F.sum("n_decision") / (F.count(F.lit(1)) * BATCH)).alias("decision_rate"),
            (F.sum("n_exact") / (F.count(F.lit(1)) * BATCH)).alias("completion_rate"),
            (F.count_if(F.col("n_exact") > 0) / F.count(F.lit(1))).alias("any_of_five"),
            (F.count_if(whole & F.col("top_ok")) / F.count(F.lit(1))).alias("success_rate"),
            F.count_if(~F.col("missing") & ~F.col("changed")).alias("unchanged_examples"),
            F.count_if(~F.col("missing") & ~F.col("changed") & F.col("edits")).alias("unneeded_edits"),
        )
        .select("label", "category", "total", "examples", "missing", "incomplete_batches", "schema_rate", "decision_rate", "completion_rate", "any_of_five", "success_rate", "unchanged_examples", "unneeded_edits")
    )


def percentile_index(values: Column, fraction: float) -> Column:
    """The value at the rounded place ``(n - 1) * fraction`` of the sorted values; null for none.

    The values are one group's, so this is for groups of bounded size; ``F.percentile`` needs no such bound.
    """
    v = F.array_sort(values)
    return F.when(F.size(v) > 0, F.get(v, F.bround((F.size(v) - 1) * fraction).cast("int")))


def runtime_summary(predictions: DataFrame, by: str) -> DataFrame:
    """Requests, errors, tokens and latencies of each model; medians interpolated, p95 as the nearest rank."""
    return predictions.groupBy(by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count("error").alias("errors"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.percentile("latency_ms", F.lit(0.5)).alias("median_ms"),
        F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
    )


def frontier(points: DataFrame, key: str, good: str, cost: str) -> DataFrame:
    """Points that no other beats: none with as much good at as little cost and one of them better.

    In cost order, a point stays if its good is above the best of all cheaper ones and the best at its cost. Costs are
    first reduced to the best good of each, so ties and repeated points stay together. The running best is taken in
    range partitions and over the partitions' own bests, so no task sees all costs.
    """
    p = points.where(F.col(good).isNotNull() & F.col(cost).isNotNull())
    best = laid_out(p.groupBy(cost).agg(F.max(good).alias("_best")), [cost])
    parts = best.groupBy("_part").agg(F.max("_best").alias("_m"))
    over = parts.select("_part", F.max("_m").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_over"))
    inside = F.max("_best").over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    best = best.withColumn("_inside", inside).join(F.broadcast(over), "_part").withColumn("_before", F.greatest("_inside", "_over"))
    return p.join(best.where("_before is null or _best > _before").select(cost, "_best"), cost).where(F.col(good) == F.col("_best")).select(key, good, cost)


def verdict(quality: Column, meaning: Column, tone: Column, minimality: Column, acceptable: Column) -> Column:
    """A judge's weighted mark of 0 to 1; below one half where the answer is not acceptable."""
    mark = (0.40 * quality + 0.30 * meaning + 0.15 * tone + 0.15 * minimality) / 4
    return F.when(acceptable, mark).otherwise(F.least(mark, F.lit(0.49)))


def reward(exact: Column, form_ok: Column, decision_ok: Column, mark: Column) -> Column:
    """An answer's reward: 1 if accepted, its score of form if that or the decision fails, else by the judge's mark."""
    return F.when(exact, 1.0).when(~form_ok, 0.0).when(~decision_ok, FORM).otherwise(F.least(F.lit(0.99), 0.40 + 0.59 * mark))
