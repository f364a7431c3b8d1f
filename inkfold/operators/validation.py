"""Checks of rows, inputs, candidates and splits. Each gives reasons as a column; the caller decides what to do.

Nulls break a rule wherever a value is required; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions import text as T

# What a small model copies from its instructions instead of answering, by its beginning or as a whole.
ECHO_STARTS = ("best full text", "suggestion:", "suggestion suggestion:", "uggestionuggestion:", "text_", "{", "}", "[", "]")
ECHO_WHOLE = ("text", "suggestion")
LEAST_LINE = 12  # letters of an instruction line that a candidate may not begin with
VARIANTS = ("ambiguous", "conflicting", "context_a", "context_b", "irrelevant", "no_context")


def utterance_reason(fields: list[str], locales: list[str], partitions: list[str]) -> Column:
    """The first reason against a source utterance: a field missing or empty, another locale or partition."""
    missing = F.lit(False)
    for f in fields:
        missing = missing | (F.coalesce(F.col(f), F.lit("")) == "")
    return F.when(missing, "empty_field").when(~F.col("locale").isin(locales), "locale").when(~F.col("partition").isin(partitions), "partition")


def ambiguity_reason(rows: DataFrame, text: str, lexicon: DataFrame, least: float = 3.0, vocabulary: DataFrame | None = None, out: str = "reason") -> DataFrame:
    """``rows`` with ``all_tokens_common_valid_words`` where ``text`` is a phrase of English tokens that are all at least
    so frequent in ``lexicon(word, zipf)``, and so could be meant as it stands; null otherwise.

    With a ``vocabulary(word)``, a phrase with a token outside it is left alone. Words are joined, not texts.
    """
    texts = rows.select(F.col(text).alias("_t")).where(F.col("_t").rlike(T.ENGLISH_PHRASE) & ~F.col("_t").rlike(r"\n\z")).distinct()
    pairs = texts.select("_t", F.explode(F.array_distinct(T.english_tokens(F.lower("_t")))).alias("word"))
    common = lexicon.where(F.col("zipf") >= least).select(F.lower("word").alias("word")).distinct().withColumn("_ok", F.lit(True))
    known = pairs.join(common, "word", "left")
    if vocabulary is not None:
        known = known.join(vocabulary.select(F.lower("word").alias("word")).distinct().withColumn("_in", F.lit(True)), "word", "left")
    else:
        known = known.withColumn("_in", F.lit(True))
    hit = known.groupBy("_t").agg(F.count(F.lit(1)).alias("n"), F.count("_ok").alias("ok"), F.count("_in").alias("known")).where("ok = n and known = n").select("_t", F.lit("all_tokens_common_valid_words").alias(out))
    return rows.join(hit, rows[text] == hit["_t"], "left").drop("_t")


def input_reason(payload: Column) -> Column:
    """The first reason against a model's input, a JSON object: ``text`` missing or no string, unknown fields, more than
    one snippet or a snippet without exactly its three non-empty strings, hints that are no list of tokens with
    candidates. Null or empty ``context_snippets`` count as none."""
    keys = F.json_object_keys(payload)
    text, raw, hints = (F.get_json_object(payload, f"$.{k}") for k in ("text", "context_snippets", "lexical_hints"))
    typed = payload.rlike(r'"text"\s*:\s*"')
    parts = F.from_json(raw, "array<string>")
    one = F.get(parts, F.lit(0))
    own = F.array_sort(F.json_object_keys(one)) == F.array(*map(F.lit, ("app_name", "visible_text", "window_title")))
    filled = F.lit(True)
    for k in ("app_name", "window_title", "visible_text"):
        filled = filled & (F.coalesce(F.get_json_object(one, f"$.{k}"), F.lit("")) != "") & one.rlike(rf'"{k}"\s*:\s*"')
    listed = F.from_json(hints, "array<string>")
    hint_ok = F.forall(
        listed,
        lambda h: F.coalesce(
            (F.array_sort(F.json_object_keys(h)) == F.array(F.lit("candidates"), F.lit("token")))
            & (F.get_json_object(h, "$.token") != "")
            & (F.size(F.from_json(F.get_json_object(h, "$.candidates"), "array<string>")) > 0)
            & F.forall(F.from_json(F.get_json_object(h, "$.candidates"), "array<string>"), lambda c: c != ""),
            F.lit(False),
        ),
    )
    return (
        F.when(keys.isNull() | text.isNull() | ~typed, "text")
        .when(F.exists(keys, lambda k: ~k.isin("text", "context_snippets", "lexical_hints")), "unknown_field")
        .when(raw.isNotNull() & ~raw.rlike(r"^\s*\["), "snippet_count")
        .when(raw.isNotNull() & (F.size(parts) > 1), "snippet_count")
        .when(raw.isNotNull() & (F.size(parts) == 1) & ~F.coalesce(own & filled, F.lit(False)), "snippet_fields")
        .when(hints.isNotNull() & (~hints.rlike(r"^\s*\[") | ~F.coalesce(hint_ok, F.lit(False))), "hint_fields")
    )


def context_row_reasons(split: Column, schema: str = "context_snippet_v1", method: str = "human_reviewed_source") -> Column:
    """All reasons against a row of a context corpus ``(input, output, metadata)``, sorted: its draft and suggestion,
    one snippet where it has any, its provenance, and fields that must follow from others."""
    s, d = F.col("output.suggestion"), F.col("input.text")
    snippets = F.col("input.context_snippets")
    m = lambda f: F.col(f"metadata.{f}")
    checks = {
        "input": d.isNotNull(),
        "snippet": snippets.isNull() | ((F.size(snippets) == 1) & F.forall(snippets, lambda x: x.isNotNull())),
        "output": s.isNotNull(),
        "schema_version": m("schema_version") == schema,
        "source_partition": m("source_partition") == split,
        "provenance": m("generation.method") == method,
        "label_evidence": m("label_evidence.resulting_text").eqNullSafe(s),
        "target_changed": m("target_changed") == ~s.eqNullSafe(d),
        "accepted": m("accepted_suggestions") == F.array(s),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()])))


def echoes(suggestion: Column, instructions: str = "", products: tuple[str, ...] = ()) -> Column:
    """Whether a suggestion repeats the model's instructions: their form, one of their longer lines, or the words with
    which they present the product by one of its names."""
    low = F.lower(F.trim(suggestion))
    hit = low.isin(*ECHO_WHOLE)
    lines = (line.strip().removeprefix("- ").lower() for line in instructions.split("\n"))
    starts = (*ECHO_STARTS, *(x for x in lines if len(x) >= LEAST_LINE), *(f"{who} {p.lower()}" for p in products for who in ("i'm", "i am", "you are")))
    for x in starts:
        hit = hit | low.startswith(x)
    return hit


def shortened(draft: Column, suggestion: Column) -> Column:
    """Whether a suggestion has fewer words than a draft of three or more, and so dropped some."""
    n = T.word_count(draft)
    return (n >= 3) & (T.word_count(suggestion) < n)


def drop_reason(draft: Column, suggestion: Column, instructions: str = "", products: tuple[str, ...] = ()) -> Column:
    """Why a trimmed suggestion is no candidate: it is the draft, an echo, or shortened; null for a candidate."""
    return F.when(suggestion == draft, "unchanged").when(echoes(suggestion, instructions, products), "echo").when(shortened(draft, suggestion), "shortened")


def group_reasons(candidates: DataFrame, group: str, variant: str, draft: Column, suggestion: Column, snippets: Column) -> DataFrame:
    """``(group, reasons)`` of contrast groups that break a rule: exactly the six variants once each; one draft but for
    the conflicting one; different suggestions of the two useful contexts; equal ones of the three controls; and no
    context where none belongs. The later rules hold for whole groups only."""
    at = lambda v, x: F.max(F.when(F.col(variant) == v, x))
    of = lambda names, x: F.collect_set(F.when(F.col(variant).isin(*names), x))
    g = (
        candidates.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array_sort(F.collect_set(variant)).alias("v"),
            F.size(of([x for x in VARIANTS if x != "conflicting"], draft)).alias("drafts"),
            at("context_a", suggestion).alias("a"),
            at("context_b", suggestion).alias("b"),
            F.size(of(("no_context", "irrelevant", "ambiguous"), suggestion)).alias("controls"),
            at("no_context", F.coalesce(F.size(snippets), F.lit(0))).alias("none"),
        )
    )
    whole = (F.col("n") == len(VARIANTS)) & (F.col("v") == F.array(*map(F.lit, VARIANTS)))
    reasons = F.when(~whole, F.array(F.lit("contrast_group_incomplete_or_duplicate"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("drafts") != 1, "contrast_group_base_draft_mismatch"),
                F.when(F.col("a").eqNullSafe(F.col("b")), "contrast_useful_targets_not_distinct"),
                F.when(F.col("controls") != 1, "contrast_restraint_targets_mismatch"),
                F.when(F.col("none") > 0, "contrast_no_context_has_context"),
            )
        )
    )
    return g.select(group, reasons.alias("reasons")).where(F.size("reasons") > 0)


def status(candidates: DataFrame, key: str, group: str, local: DataFrame, judgments: DataFrame, groups: DataFrame) -> DataFrame:
    """``(key, group, status, reasons)`` of candidates against their local checks ``(key, reasons)``, judgments
    ``(key, reasons)`` and group checks ``(group, reasons)``. Local reasons come first, then the group's, then the
    judgment's; without any, a candidate is accepted, and without a judgment it is pending."""
    none = F.array().cast("array<string>")
    c = candidates.select(key, group).distinct()
    c = c.join(local.select(key, F.col("reasons").alias("_l")), key, "left").join(groups.select(group, F.col("reasons").alias("_g")), group, "left")
    c = c.join(judgments.select(key, F.col("reasons").alias("_j")), key, "left")
    l_, g, j = (F.coalesce(x, none) for x in ("_l", "_g", "_j"))
    state = (
        F.when(F.size(l_) > 0, "rejected_local")
        .when(F.size(g) > 0, "rejected_group")
        .when(F.col("_j").isNull(), "pending")
        .when(F.size(j) > 0, "rejected_judgment")
        .otherwise("accepted")
    )
    return c.select(key, group, state.alias("status"), F.concat(l_, g, j).alias("reasons"))


def split_faults(rows: DataFrame, split: str, key: str, surface: Column, reason: Column) -> DataFrame:
    """``(split, fault, n)``: rows with a reason, repeated surfaces and ids within a split, and surfaces and ids that
    another split has too. A surface or id that repeats counts once for each row beyond the first."""
    r = rows.select(F.col(split).alias("split"), F.col(key).alias("_k"), surface.alias("_s"), reason.alias("_r"))
    bad = r.where("_r is not null").groupBy("split", F.col("_r").alias("fault")).agg(F.count(F.lit(1)).alias("n"))
    parts = [bad]
    for column, name in (("_s", "input"), ("_k", "id")):
        each = r.where(F.col(column).isNotNull()).groupBy("split", column).agg(F.count(F.lit(1)).alias("m"))
        parts.append(each.groupBy("split").agg(F.sum(F.col("m") - 1).alias("n")).where("n > 0").select("split", F.lit(f"duplicate_{name}").alias("fault"), "n"))
        wide = each.groupBy(column).agg(F.collect_set("split").alias("s")).where(F.size("s") > 1)
        parts.append(wide.select(F.explode("s").alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.lit(f"shared_{name}").alias("fault"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sourced_rows(exchanges: DataFrame, key: str, draft: str, candidates: Column, label: str, base: str, failed: Column) -> DataFrame:
    """``(key, draft, suggestion, target_changed)`` of answered exchanges of other models than ``base``: the first
    candidate, or the draft where there is none."""
    s = F.coalesce(F.get(candidates, F.lit(0)), F.col(draft))
    rows = exchanges.where(~F.coalesce(failed, F.lit(True)) & ~F.col(label).eqNullSafe(F.lit(base)))
    return rows.select(key, draft, s.alias("suggestion"), (s != F.col(draft)).alias("target_changed"))


def disjoint(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that two corpora share, which should be none: distinct rows of ``keys``; null keys share nothing."""
    return left.select(*keys).join(right.select(*keys), keys, "left_semi").distinct()


def missing_members(rows: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """Distinct values of ``column`` that the catalog, a table of that column, lacks."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().join(catalog.select(column), column, "left_anti")
