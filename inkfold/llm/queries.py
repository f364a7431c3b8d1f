"""Queries of the training-data problems, by name, and the SQL of those that SQL can state."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import drafts as d
from inkfold.llm import garbled, leaks, lookalike, pii, sampling, tokens, truncated
from inkfold.llm.tables import context_fields, long_fields
from inkfold.session import table


def context(spark: SparkSession, sf: str) -> DataFrame:
    return context_fields(table(spark, sf, "context"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncated.truncated(long_fields(context(spark, sf), "visible_text")).select("row_id")


def p1_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = context(spark, sf).select("row_id", F.lit("visible_text").alias("field"), F.col("visible_text").alias("value"), "source")
    return truncated.truncation_report(rows)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return d.cross_split_pairs(context(spark, sf))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return d.overlap_classes(context(spark, sf)).drop("draft")


def p2_overlap_report(spark: SparkSession, sf: str) -> DataFrame:
    return d.overlap_report(context(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    # what the sample fell short of; the count of what there is confirms that no sample could do better
    return p3_report(spark, sf).where("selected < wanted and available < wanted").select("category", "context_variant")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced_sample(context(spark, sf), table(spark, sf, "sample_targets"))[1]


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced_sample(context(spark, sf), table(spark, sf, "sample_targets"))[0]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.kinds_found(long_fields(context(spark, sf), "visible_text", "window_title"))


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal(long_fields(context(spark, sf), "visible_text", "window_title")).select("row_id", "field", "redacted")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return d.draft_groups(context(spark, sf))


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    return d.assign_splits(context(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalikes(long_fields(context(spark, sf), "text", "window_title", "visible_text")).select("row_id", "field")


FAMILY_RATE, EXAMPLE_RATE = 0.25, 0.5


def p7_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stable_sample(context(spark, sf), FAMILY_RATE, EXAMPLE_RATE)


#: Where the public vocabularies lie.
TOKENIZERS = os.environ.get("INKFOLD_TOKENIZERS", "/opt/tokenizers")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that the ids of all documents stand for; those of null texts are empty."""
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    return tokens.decode(tokens.encode(table(spark, sf, "documents"), path), path).select("doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_near(spark: SparkSession, sf: str) -> DataFrame:
    """Items of which 13 words stand in a document with at most two words inserted, deleted or replaced."""
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), edits=2)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.garbled(table(spark, sf, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.garbled(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


_SUPPLY = """
with e as (select metadata.example_id as id, lower(trim(metadata.category)) as c, lower(trim(metadata.context_variant)) as v
           from context where metadata.example_id is not null),
     n as (select floor(count(distinct id) / 5) as n from e),
     a as (select c, v, count(distinct id) as available from e group by c, v)
select t.category, t.context_variant, t.target_share,
       cast(greatest(t.min_rows, floor(t.target_share * n.n + 0.5)) as bigint) as wanted,
       coalesce(a.available, 0) as available
from sample_targets t cross join n
left join a on a.c = lower(trim(t.category)) and a.v = lower(trim(t.context_variant))"""

_WORDS = r"string_split(trim(regexp_replace(regexp_replace(lower(text), '[''’‘ʼ`´]', '', 'g'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ')"


def _grams(name: str, key: str) -> str:
    return f"""select distinct {key}, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as g
               from (select {key}, {_WORDS} as w from {name}) where len(w) >= 13"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"select category, context_variant from ({_SUPPLY}) where available < wanted",
        "p3_report": f"select category, context_variant, target_share, wanted, available, least(wanted, available) as selected, cast(0 as bigint) as residual from ({_SUPPLY})",
        "p7_sample": f"""
            select distinct metadata.family_id as family_id, metadata.example_id as example_id from context
            where sha256('sample-v1:family_id:' || metadata.family_id) < '{sampling.threshold(FAMILY_RATE)}'
              and sha256('sample-v1:example_id:' || metadata.example_id) < '{sampling.threshold(EXAMPLE_RATE)}'""",
        "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
        "p9_found": f"""
            with d as ({_grams("documents", "doc_id")}), i as ({_grams("eval_items", "item_id")})
            select distinct doc_id, item_id from d join i using (g)""",
    }
