"""Aggregates of runs and answers as reports need them. Rates of nothing are 0 or null as stated; nulls count nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkfold.functions import text as T

EDGES = ".,!?;:'\""


def rate(n: Column, d: Column, places: int = 4) -> Column:
    """n / d rounded as a binary double, 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.round(n / d, places))


def hint_coverage(rows: DataFrame, changed: str, accepted: str, hints: str) -> DataFrame:
    """One row of how far hints reach: examples, those whose target changed, those with hints, both, the share of changed
    ones with hints and with a hint that an accepted text holds as a word, and the mean number of hints where there are
    any. ``hints`` is an array of structs with ``candidates``; accepted words lose signs at their ends and case."""
    bare = lambda w: F.btrim(F.lower(w), F.lit(EDGES))
    words = F.transform(F.flatten(F.transform(F.coalesce(accepted, F.array().cast("array<string>")), T.words)), bare)
    offered = F.transform(F.flatten(F.transform(hints, lambda h: h["candidates"])), bare)
    n = F.coalesce(F.size(hints), F.lit(0))
    r = rows.select(F.coalesce(F.col(changed), F.lit(False)).alias("c"), F.greatest(n, F.lit(0)).alias("n"), F.coalesce(F.arrays_overlap(offered, words), F.lit(False)).alias("gold"))
    has = F.col("n") > 0
    g = r.agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_if("c").alias("changed_examples"),
        F.count_if(has).alias("examples_with_hints"),
        F.count_if(F.col("c") & has).alias("changed_examples_with_hints"),
        F.count_if(F.col("c") & F.col("gold")).alias("_gold"),
        F.sum("n").alias("_hints"),
    )
    return g.select(
        "examples",
        "changed_examples",
        "examples_with_hints",
        "changed_examples_with_hints",
        rate(F.col("changed_examples_with_hints"), F.col("changed_examples")).alias("changed_hint_coverage"),
        rate(F.col("_gold"), F.col("changed_examples")).alias("changed_gold_hint_recall"),
        rate(F.col("_hints"), F.col("examples_with_hints"), 3).alias("mean_hints_when_present"),
    )


def set_usage(calls: DataFrame, key: list[str], order: str, sums: list[str]) -> DataFrame:
    """One row for each set of calls: its responses in order and the sums of its numbers, null where no call has one."""
    g = calls.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, "response"))).alias("_r"), *[F.sum(c).alias(c) for c in sums])
    return g.select(*key, F.transform("_r", lambda x: x["response"]).alias("responses"), *sums)


def costs(calls: DataFrame, by: list[str], cost: str) -> DataFrame:
    """``(*by, calls, with_cost, cost)``: recorded costs to eight places, null where no call has one."""
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count(cost).alias("with_cost"), F.round(F.sum(cost), 8).alias("cost"))


def counters(results: DataFrame, order: list[str], ok: Column, valid: Column, latency: str) -> DataFrame:
    """Counters over all results: requests, answered, errors, of broken form, the last answer's latency and the mean.

    The last one is that of the greatest order among the answered.
    """
    last = F.max(F.when(ok, F.struct(*order, F.col(latency).alias("_v"))))
    return results.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(ok).alias("ok"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("errors"),
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("schema_invalid"),
        last["_v"].alias("last_latency_ms"),
        F.avg(F.when(ok, F.col(latency))).alias("avg_latency_ms"),
    )


def running(results: DataFrame, by: list[str], order: list[Column], value: str, out: str = "running_mean") -> DataFrame:
    """Each row with the mean of its group's values up to it. Groups are series of bounded length, as of one session;
    ``counters`` gives the whole of a stream."""
    return results.withColumn(out, F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def live_report(cases: DataFrame, by: list[str], changed: Column, success: Column, any_ok: Column, error: Column, latency: str) -> DataFrame:
    """Cases, success in all, of changed and of unchanged ones, changed ones with any good candidate, errors, and latency.

    A share of no cases is null.
    """
    mean = lambda x, where: F.round(F.avg(F.when(where, F.coalesce(x, F.lit(False)).cast("int"))), 4)
    c = F.coalesce(changed, F.lit(False))
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        mean(success, F.lit(True)).alias("overall_success"),
        mean(success, c).alias("changed_top1_success"),
        mean(any_ok, c).alias("changed_any_candidate"),
        mean(success, ~c).alias("unchanged_kept"),
        F.count_if(error).alias("errors"),
        F.round(F.avg(latency), 1).alias("mean_latency_ms"),
    )


def run_summary(candidates: DataFrame, key: str, category: str, categories: list[str], status: DataFrame, reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """``(category, candidates, accepted, rate)`` for every category that exists, filled with zeros, and ``(reason, n)``.

    ``status`` has the key, ``status`` and ``reasons`` of each candidate.
    """
    names = candidates.sparkSession.createDataFrame([(c,) for c in categories], f"{category} string")
    done = candidates.select(key, category).distinct().join(status.select(key, "status").distinct(), key, "left")
    g = done.groupBy(category).agg(F.countDistinct(key).alias("n"), F.countDistinct(F.when(F.col("status") == "accepted", F.col(key))).alias("a"))
    n, a = F.coalesce("n", F.lit(0)), F.coalesce("a", F.lit(0))
    table = names.join(g, category, "left").select(category, n.alias("candidates"), a.alias("accepted"), rate(a, n).alias("rate"))
    why = status.select(key, F.explode(reasons).alias("reason")).distinct().groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return table, why


def diversity(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """``(dimension, value, n, share)`` of each dimension's values, nulls left out, in one scan."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    g = rows.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    total = g.groupBy("dimension").agg(F.sum("n").alias("m"))
    return g.join(total, "dimension").select("dimension", "value", "n", rate(F.col("n"), F.col("m"), 6).alias("share"))


def token_details(calls: DataFrame, keep: list[str], content: str, suggestion: Column, prompt: str, completion: str, server_ms: str, limit: Column, reported_ms: Column | None = None, decode_ms: Column | None = None, finish: Column | None = None) -> DataFrame:
    """What a call's tokens and time went into: letters of the answer's form and of its suggestion, the tokens of each by
    share of letters, milliseconds a token, queue time (the server's less the model's own, at least 0), and whether the
    limit was reached. Missing timings give nulls; the form's time then follows from the server's."""
    none = F.lit(None).cast("double")
    out, chosen = F.char_length(content), F.coalesce(F.char_length(suggestion), F.lit(0))
    chosen = F.least(chosen, out)
    share = F.when(out == 0, 0.0).otherwise(chosen / out)
    tokens = F.col(completion)
    server = F.when(tokens == 0, 0.0).otherwise(F.col(server_ms) / tokens)
    decode = F.when(tokens > 0, (decode_ms if decode_ms is not None else none) / tokens)
    form = tokens - tokens * share
    reported = reported_ms if reported_ms is not None else none
    return calls.select(
        *keep,
        out.alias("output_chars"),
        chosen.alias("suggestion_chars"),
        (out - chosen).alias("schema_chars"),
        (tokens * share).alias("suggestion_tokens"),
        form.alias("schema_tokens"),
        server.alias("server_ms_per_token"),
        decode.alias("decode_ms_per_token"),
        F.greatest(F.col(server_ms) - reported, F.lit(0.0)).alias("queue_ms") if reported_ms is not None else none.alias("queue_ms"),
        (F.coalesce(decode, server) * form).alias("schema_ms"),
        (F.col(prompt) + tokens).alias("tokens"),
        ((tokens >= limit) | (F.coalesce(finish, F.lit("")) == "length" if finish is not None else F.lit(False))).alias("limit_reached"),
    )


def hardest(rows: DataFrame, text: str, target: str, lexicon: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows with the rarest words, by the least frequency of a target's words, then by texts. A word that
    the lexicon ``(word, zipf)`` lacks counts 0; a target without words comes last."""
    t = rows.select(F.col(text).alias("text"), F.col(target).alias("target")).where("text is not null and target is not null").distinct()
    words = t.select("text", "target", F.explode_outer(F.array_distinct(T.english_tokens(F.lower("target")))).alias("word"))
    known = words.join(lexicon.select("word", "zipf"), "word", "left")
    least = F.min(F.when(F.col("word").isNotNull(), F.coalesce("zipf", F.lit(0.0))))
    return known.groupBy("text", "target").agg(least.alias("zipf")).orderBy(F.col("zipf").asc_nulls_last(), "text", "target").limit(most)


def sorted_by(rows: DataFrame, column: str, ties: list[str]) -> DataFrame:
    """Rows by one column, the greatest first and nulls last."""
    return rows.orderBy(F.col(column).desc_nulls_last(), *ties)


def leader(rows: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """The row of the greatest value in each group, of equal ones the least key; null values lead nothing."""
    best = F.min_by(F.struct(key, value), F.struct(-F.col(value), F.col(key))).alias("_b")
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(best).select(*by, f"_b.{key}", f"_b.{value}")


def html(rows: DataFrame, title: str) -> str:
    """A small report table as an HTML page; the caller bounds the rows."""
    from html import escape

    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    line = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(cell(v))}</{tag}>" for v in values) + "</tr>"
    body = "\n".join(line("td", r) for r in rows.toLocalIterator())
    return f"<!doctype html>\n<title>{escape(title)}</title>\n<h1>{escape(title)}</h1>\n<table>\n{line('th', rows.columns)}\n{body}\n</table>\n"
