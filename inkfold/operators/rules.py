"""Reject rules. Each gives a reason column; the caller decides whether to drop, set aside or raise."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions import text as T

MAX_CHARS = 160
DIMENSIONS = ("correctness", "context_grounding", "context_usefulness", "meaning_preservation", "tone_preservation", "minimality", "naturalness", "category_validity", "dataset_value")


def source_reason(text: Column, profane: Column | None = None) -> Column:
    """The first reason against a source text; null for a good one. Null counts as empty."""
    c = F.when(F.coalesce(T.collapse_all(text), F.lit("")) == "", "empty").when(text.rlike(r"[\n\r]"), "multiline").when(~text.rlike("[A-Za-z]"), "not_text")
    c = c if profane is None else c.when(profane, "profanity")
    text = T.collapse_all(text)
    for name, pattern in (("email", T.EMAIL), ("url", T.URL), ("phone", T.PHONE), ("handle", T.HANDLE), ("markup", T.MARKUP), ("code", T.CODE)):
        c = c.when(text.rlike(pattern), name)
    return c


def window_reason(text: Column, size: Column, profane: Column | None = None) -> Column:
    """The first reason against a window of words."""
    n = T.word_count(text)
    first = source_reason(text, profane)
    return F.when(first.isNotNull(), first).when(n != size, "wrong_word_count").when(~size.between(1, 10), "unsupported_size").when(F.length(text) > MAX_CHARS, "too_long")


def draft_reason(text: Column, profane: Column | None = None) -> Column:
    first = source_reason(text, profane)
    return F.when(first.isNotNull(), first).when(text != T.collapse(text), "irregular_whitespace").when(F.length(text) > MAX_CHARS, "too_long")


def profane(rows: DataFrame, text: str, lexicon: DataFrame, out: str = "profane") -> DataFrame:
    """``rows`` with whether any word of ``text`` is in ``lexicon(word)``; the words are joined, not the rows' texts."""
    pairs = rows.select(F.col(text).alias("_t")).distinct().select("_t", F.explode(F.array_distinct(T.english_tokens(F.lower("_t")))).alias("word"))
    hit = pairs.join(lexicon.select(F.lower("word").alias("word")).distinct(), "word", "left_semi").select("_t").distinct().withColumn(out, F.lit(True))
    return rows.join(hit, rows[text] == hit["_t"], "left").drop("_t").withColumn(out, F.coalesce(out, F.lit(False)))


def vocabulary_reason(rows: DataFrame, text: str, lexicon: DataFrame, least: float = 3.0, out: str = "reason") -> DataFrame:
    """``rows`` with ``no_english_tokens`` or ``rare_or_misspelled_token`` where a token of ``text`` is missing from ``lexicon(word,
    zipf)`` or rarer than ``least``; null otherwise."""
    texts = rows.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    pairs = texts.select("_t", F.explode_outer(F.array_distinct(T.english_tokens(F.lower("_t")))).alias("word"))
    common = lexicon.where(F.col("zipf") >= least).select(F.lower("word").alias("word")).distinct().withColumn("_ok", F.lit(True))
    judged = pairs.join(common, "word", "left").groupBy("_t").agg(F.count("word").alias("n"), F.count("_ok").alias("ok"))
    reason = F.when(F.col("n") == 0, "no_english_tokens").when(F.col("ok") < F.col("n"), "rare_or_misspelled_token")
    return rows.join(judged.select("_t", reason.alias(out)), rows[text] == F.col("_t"), "left").drop("_t")


def text_reasons(name: str, text: Column, newlines: bool = False) -> list[Column]:
    checks = [("empty", F.trim(text) == ""), ("control", text.rlike(T.CONTROL)), ("email", text.rlike(T.EMAIL)), ("phone", text.rlike(T.PHONE)), ("url", text.rlike(r"(?i)(?:https?://|www\.)"))]
    if not newlines:
        checks.append(("newline", text.rlike(r"[\n\r]")))
    return [F.when(F.coalesce(c, F.lit(True)), f"{name}_{r}") for r, c in checks]


def candidate_reasons(rows: DataFrame, most_snippets: int = 4, most_chars: int = 1200) -> Column:
    """All reasons against a synthetic candidate, sorted."""
    draft, suggestion = F.col("input.text"), F.col("output.suggestion")
    snippets = F.coalesce("input.context_snippets", F.array().cast(rows.schema["input"].dataType["context_snippets"].dataType))
    reasons = [
        *text_reasons("input", draft),
        *text_reasons("suggestion", suggestion),
        F.when(F.length(draft) > MAX_CHARS, "input_too_long"),
        F.when(~T.word_count(draft).between(1, 10), "unsupported_word_count"),
        F.when(F.size(snippets) > most_snippets, "too_many_snippets"),
        F.when(F.exists(snippets, lambda s: F.length(s["visible_text"]) > most_chars), "snippet_too_long"),
        F.when((F.col("context_behavior") == "none") & (F.size(snippets) > 0), "context_not_empty"),
        F.when((F.col("context_behavior") != "none") & (F.size(snippets) == 0), "context_missing"),
        F.when(F.coalesce(F.trim("rationale"), F.lit("")) == "", "rationale_empty"),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))


def judgment_reasons(least: int = 4) -> Column:
    """All reasons against a judgment, sorted: a pass that is not true, and each low or missing score."""
    low = [F.when(F.coalesce(F.col(f"scores.{d}") < least, F.lit(True)), f"low_{d}") for d in DIMENSIONS]
    return F.array_sort(F.array_compact(F.array(F.when(~F.coalesce("pass", F.lit(False)), "not_passed"), *low)))


def suggestion_of(response: Column) -> Column:
    """The suggestion of a response that is a JSON object with exactly that key and a string; null otherwise."""
    strict = F.json_object_keys(response)
    value = F.get_json_object(response, "$.suggestion")
    return F.when((F.size(strict) == 1) & (F.element_at(strict, 1) == "suggestion") & response.rlike(r'^\s*\{\s*"suggestion"\s*:\s*"') & (F.trim(value) != ""), value)


def redact(props: Column, denied: tuple[str, ...]) -> Column:
    """A flat JSON object of strings without denied keys and keys that end in _text."""
    entries = F.map_entries(F.from_json(props, "map<string,string>"))
    kept = F.filter(entries, lambda e: ~e["key"].isin(*denied) & ~e["key"].endswith("_text"))
    return F.to_json(F.map_from_entries(kept))


def redact_nested(props: Column, denied: tuple[str, ...]) -> Column:
    """A JSON value without denied keys and keys that end in _text, at any depth; what is no JSON becomes null."""

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if k not in denied and not k.endswith("_text")}
        return [clean(x) for x in v] if isinstance(v, list) else v

    def one(v: str | None) -> str | None:
        try:
            return None if v is None else json.dumps(clean(json.loads(v)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return F.pandas_udf(lambda s: pd.Series([one(v) for v in s], dtype=object), "string")(props)


def vote_errors(candidates: Column, votes: Column) -> Column:
    """Whether a result breaks its form: at most five candidates, none empty or repeated, votes beside each, all at least one."""
    return (F.size(candidates) > 5) | F.exists(candidates, lambda c: F.trim(c) == "") | (F.size(F.array_distinct(candidates)) != F.size(candidates)) | (F.size(votes) != F.size(candidates)) | F.exists(votes, lambda v: v < 1)
