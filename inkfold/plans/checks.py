"""Queries of the checks of rows, candidates and splits, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.operators import dedupe as DD
from inkfold.operators import lexical as L
from inkfold.operators import patterns as P
from inkfold.operators import quality as Q
from inkfold.operators import rules as R
from inkfold.operators import score as SC
from inkfold.operators import validation as V
from inkfold.plans.queries import _COMP, _LOW, BURSTS, CONTEXT, FOLD, GOLD, LAST, bursts, context, gold, query
from inkfold.session import table

FIELDS = ["id", "locale", "partition", "scenario", "intent", "utt"]


@query(f"""select coalesce(case when {' or '.join(f"coalesce({f}, '') = ''" for f in FIELDS)} then 'empty_field' when locale <> 'en-US' then 'locale'
  when partition not in ('train', 'dev', 'test') then 'partition' end, 'good') as reason, count(*) as n from utterances group by all""")
def utterance_reasons(spark, sf):
    reason = V.utterance_reason(FIELDS, ["en-US"], ["train", "dev", "test"])
    return table(spark, sf, "utterances").groupBy(F.coalesce(reason, F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_VOCAB = "(select word from (select distinct i, unnest(regexp_extract_all(lower(utt), '[a-z]+(?:''[a-z]+)?')) as word from (select row_number() over () as i, utt from (select input.text as utt from context) where utt is not null)) group by word having count(*) >= 2)"
_PHRASE = "'^(?:[A-Za-z]+(?:''[A-Za-z]+)?)(?:[\\s\\v]+[A-Za-z]+(?:''[A-Za-z]+)?)*[.!?]?$'"


@query(f"""with t as (select row_id, text from {CONTEXT} where text is not null and regexp_full_match(text, {_PHRASE}) and text not like '%' || chr(10)),
  w as (select row_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'))) as word from t)
  select row_id, 'all_tokens_common_valid_words' as reason from w left join {_VOCAB} v using (word) group by row_id having count(*) = count(v.word)""")
def ambiguous_drafts(spark, sf):
    """Drafts that could be meant as they stand: every token is in at least two rows."""
    lexicon = L.derived_vocabulary(context(spark, sf), "text", 2)
    rows = context(spark, sf).where("text is not null").select("row_id", "text")
    return V.ambiguity_reason(rows, "text", lexicon, 0.0).where("reason is not null").select("row_id", "reason")


@query("""select candidate_id, case when input.text is null then 'text' when len(input.context_snippets) > 1 then 'snippet_count'
  when len(input.context_snippets) = 1 and (coalesce(input.context_snippets[1].app_name, '') = '' or coalesce(input.context_snippets[1].window_title, '') = '' or coalesce(input.context_snippets[1].visible_text, '') = '') then 'snippet_fields' end as reason from synthetic_candidates""")
def input_reasons(spark, sf):
    r = table(spark, sf, "synthetic_candidates")
    payload = F.to_json("input", {"ignoreNullFields": "false"})
    return r.select("candidate_id", V.input_reason(payload).alias("reason"))


def _not(ok: str, name: str) -> str:
    return f"case when not coalesce({ok}, false) then '{name}' end"


_CONTEXT_REASONS = ", ".join(
    _not(ok, name)
    for name, ok in (
        ("input", "input.text is not null"),
        ("snippet", "input.context_snippets is null or (len(input.context_snippets) = 1 and input.context_snippets[1] is not null)"),
        ("output", "output.suggestion is not null"),
        ("schema_version", "metadata.schema_version = 'context_snippet_v1'"),
        ("source_partition", "metadata.source_partition = 'train'"),
        ("provenance", "metadata.generation.method = 'captured_source'"),
        ("label_evidence", "metadata.label_evidence.resulting_text is not distinct from output.suggestion"),
        ("target_changed", "metadata.target_changed = (output.suggestion is distinct from input.text)"),
        ("accepted", "metadata.accepted_suggestions = [output.suggestion]"),
    )
)


@query(f"select row_id, array_to_string(list_sort(list_filter([{_CONTEXT_REASONS}], lambda x: x is not null)), ',') as reasons from context")
def context_row_reasons(spark, sf):
    r = V.context_row_reasons(F.lit("train"), method="captured_source")
    return table(spark, sf, "context").select("row_id", F.array_join(r, ",").alias("reasons"))


_STARTS = " or ".join(f"starts_with(lower(trim(s)), '{x}')" for x in (*V.ECHO_STARTS, "i am pen", "i''m pen", "you are pen"))
_DROP = f"""case when s = draft then 'unchanged' when lower(trim(s)) in ('text', 'suggestion') or {_STARTS} then 'echo'
  when len(list_filter(regexp_split_to_array(trim(draft), '\\s+'), lambda x: x <> '')) >= 3 and len(list_filter(regexp_split_to_array(trim(s), '\\s+'), lambda x: x <> '')) < len(list_filter(regexp_split_to_array(trim(draft), '\\s+'), lambda x: x <> '')) then 'shortened' end"""
_TRIMMED = f"(select c.example_id, c.label, c.idx, trim(c.s) as s, g.draft from {_COMP} c join {GOLD} g using (example_id) where c.s is not null)"


def _trimmed(spark, sf):
    p = SC.last_prediction(table(spark, sf, "predictions"), ["example_id", "label"], "prediction_seq")
    c = SC.completions(p, ["example_id", "label"]).where("suggestion is not null").join(gold(spark, sf).select("example_id", "draft"), "example_id")
    return c.withColumn("suggestion", F.trim("suggestion"))


@query(f"select label, coalesce({_DROP}, 'candidate') as reason, count(*) as n from {_TRIMMED} group by all")
def dropped_candidates(spark, sf):
    c = _trimmed(spark, sf)
    reason = V.drop_reason(F.col("draft"), F.col("suggestion"), products=("pen",))
    return c.groupBy("label", F.coalesce(reason, F.lit("candidate")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select example_id, label, s as suggestion, votes, first_idx, row_number() over (partition by example_id, label order by votes desc, first_idx) as rank
  from (select example_id, label, s, count(*) as votes, min(idx) as first_idx from {_TRIMMED} where {_DROP} is null group by all)""")
def live_ranking(spark, sf):
    """Votes of trimmed suggestions that are candidates."""
    c = _trimmed(spark, sf)
    c = c.where(V.drop_reason(F.col("draft"), F.col("suggestion"), products=("pen",)).isNull())
    r = SC.vote_rank(c, ["example_id", "label"])
    return r.select("example_id", "label", "suggestion", "votes", F.col("first_idx").cast("long").alias("first_idx"), F.col("rank").cast("long").alias("rank"))


_CAND = "(select distinct candidate_id, group_id, variant, input.text as draft, output.suggestion as suggestion, coalesce(len(input.context_snippets), 0) as snippets from synthetic_candidates)"
_GROUPS = f"""(select group_id, case when count(*) <> 6 or count(distinct variant) <> 6 or not list_sort(list_distinct(list(variant))) = ['ambiguous', 'conflicting', 'context_a', 'context_b', 'irrelevant', 'no_context'] then ['contrast_group_incomplete_or_duplicate']
  else list_filter([case when count(distinct case when variant <> 'conflicting' then draft end) <> 1 then 'contrast_group_base_draft_mismatch' end,
    case when max(case when variant = 'context_a' then suggestion end) is not distinct from max(case when variant = 'context_b' then suggestion end) then 'contrast_useful_targets_not_distinct' end,
    case when count(distinct case when variant in ('no_context', 'irrelevant', 'ambiguous') then suggestion end) <> 1 then 'contrast_restraint_targets_mismatch' end,
    case when max(case when variant = 'no_context' then snippets end) > 0 then 'contrast_no_context_has_context' end], lambda x: x is not null) end as reasons
  from {_CAND} where group_id is not null group by group_id)"""


def _group_reasons(spark, sf):
    c = table(spark, sf, "synthetic_candidates").select("candidate_id", "group_id", "variant", F.col("input.text").alias("draft"), F.col("output.suggestion").alias("suggestion"), F.greatest(F.coalesce(F.size("input.context_snippets"), F.lit(0)), F.lit(0)).alias("n")).distinct()
    return V.group_reasons(c, "group_id", "variant", F.col("draft"), F.col("suggestion"), F.array_repeat(F.lit(1), F.col("n")))


@query(f"select group_id, array_to_string(reasons, ',') as reasons from {_GROUPS} where len(reasons) > 0")
def contrast_rejections(spark, sf):
    return _group_reasons(spark, sf).select("group_id", F.array_join("reasons", ",").alias("reasons"))


_J = f"(select candidate_id, list_sort(list_filter([case when not coalesce(pass, false) then 'not_passed' end, {_LOW}], lambda x: x is not null)) as reasons from judgments)"


@query(f"""select c.candidate_id, c.group_id, case when l.candidate_id is not null then 'rejected_local' when len(g.reasons) > 0 then 'rejected_group' when j.candidate_id is null then 'pending' when len(j.reasons) > 0 then 'rejected_judgment' else 'accepted' end as status,
    array_to_string(list_concat(list_concat(coalesce(l.reasons, []), coalesce(g.reasons, [])), coalesce(j.reasons, [])), ',') as reasons
  from (select distinct candidate_id, group_id from synthetic_candidates) c
  left join (select distinct candidate_id, ['rationale_empty'] as reasons from synthetic_candidates where coalesce(trim(rationale), '') = '') l using (candidate_id) left join {_GROUPS} g using (group_id) left join {_J} j using (candidate_id)""")
def candidate_status(spark, sf):
    r = table(spark, sf, "synthetic_candidates")
    local = r.where("coalesce(trim(rationale), '') = ''").select("candidate_id", F.array(F.lit("rationale_empty")).alias("reasons")).distinct()
    judged = table(spark, sf, "judgments").select("candidate_id", R.judgment_reasons().alias("reasons"))
    s = V.status(r, "candidate_id", "group_id", local, judged, _group_reasons(spark, sf))
    return s.select("candidate_id", "group_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query(f"""with r as (select source_partition as split, example_id as k, {FOLD.format('text')} as s, case when text is null then 'no_text' when suggestion is null then 'no_suggestion' end as reason from {CONTEXT}),
  ks as (select split, k, count(*) as m from r where k is not null group by all), ss as (select split, s, count(*) as m from r where s is not null group by all)
  select split, reason as fault, count(*) as n from r where reason is not null group by all
  union all select split, 'duplicate_id', cast(sum(m - 1) as bigint) from ks group by split having sum(m - 1) > 0
  union all select split, 'duplicate_input', cast(sum(m - 1) as bigint) from ss group by split having sum(m - 1) > 0
  union all select split, 'shared_id', count(*) from ks where split is not null and k in (select k from ks where split is not null group by k having count(distinct split) > 1) group by split
  union all select split, 'shared_input', count(*) from ss where split is not null and s in (select s from ss where split is not null group by s having count(distinct split) > 1) group by split""")
def split_faults(spark, sf):
    c = context(spark, sf)
    reason = F.when(F.col("text").isNull(), "no_text").when(F.col("suggestion").isNull(), "no_suggestion")
    return V.split_faults(c, "source_partition", "example_id", T.fold(F.col("text")), reason)


_FIRST = "case when json_valid(responses[1]) then json_extract_string(responses[1], '$.suggestion') end"


@query(f"""select example_id || '/' || label as key, draft, suggestion, suggestion <> draft as target_changed from (select p.example_id, p.label, g.draft, coalesce({_FIRST}, g.draft) as suggestion from {LAST} p join {GOLD} g using (example_id) where p.status = 'ok' and p.label <> 'base-b')""")
def sourced_rows(spark, sf):
    p = SC.last_prediction(table(spark, sf, "predictions"), ["example_id", "label"], "prediction_seq")
    rows = p.join(gold(spark, sf).select("example_id", "draft"), "example_id").withColumn("key", F.concat_ws("/", "example_id", "label"))
    first = F.transform(F.slice("responses", 1, 1), lambda r: F.get_json_object(r, "$.suggestion"))
    return V.sourced_rows(rows, "key", "draft", first, "label", "base-b", F.col("status") != "ok")


@query(f"select distinct model_variant from {BURSTS} where model_variant is not null and model_variant not in (select label from predictions where label is not null)")
def missing_models(spark, sf):
    catalog = table(spark, sf, "predictions").where("label is not null").select(F.col("label").alias("model_variant")).distinct()
    return V.missing_members(bursts(spark, sf), "model_variant", catalog)


@query(f"select distinct {FOLD.format('output.suggestion')} as surface from synthetic_candidates where output.suggestion is not null and {FOLD.format('output.suggestion')} in (select {FOLD.format('input.text')} from synthetic_candidates where input.text is not null)")
def shared_surfaces(spark, sf):
    """Suggestions that are drafts too."""
    r = table(spark, sf, "synthetic_candidates")
    left, right = (r.select(T.fold(F.col(c)).alias("surface")) for c in ("output.suggestion", "input.text"))
    return V.disjoint(left, right, ["surface"])


@query(f"""with r as (select burst_id, draft, model_variant, source from {BURSTS}), e as (select burst_id as entry, draft, model_variant, source from {BURSTS} where committed is not null),
  m as (select r.burst_id, e.entry, case when r.burst_id = e.entry then 0 else 1 end as tier from r join e on r.draft = e.draft and r.model_variant = e.model_variant and r.source = e.source)
  select burst_id, entry, tier from m qualify row_number() over (partition by burst_id order by tier, entry) = 1""")
def request_matches(spark, sf):
    """Each request's own entry, else one that equals it in all fields but the id."""
    b = bursts(spark, sf)
    entries = b.where("committed is not null").select(F.col("burst_id").alias("entry_id"), "draft", "model_variant", "source", F.col("burst_id").alias("entry"))
    same = {"draft": F.col("draft"), "model_variant": F.col("model_variant"), "source": F.col("source")}
    exact = P.lookup(b, entries, "burst_id", [{"entry_id": F.col("burst_id"), **same}], ["entry_id", *same], "entry").select("burst_id", "entry", F.lit(0).alias("tier"))
    rest = b.join(exact.select("burst_id"), "burst_id", "left_anti")
    loose = P.lookup(rest, entries.drop("entry_id"), "burst_id", [same], list(same), "entry").select("burst_id", "entry", F.lit(1).alias("tier"))
    return exact.union(loose)


@query("""select event_id, '{"event_id":' || event_id || ',"type":"' || event_type || '","inner":{"kept":[{"v":' || event_id % 7 || '}]}}' as redacted from events where event_type is not null and user_id is not null""")
def redacted_payloads(spark, sf):
    e = table(spark, sf, "events").where("event_type is not null and user_id is not null")
    payload = F.format_string('{"event_id":%d,"type":"%s","user_text":"x","inner":{"k":%d,"raw_text":null,"kept":[{"k":1,"v":%d}]}}', "event_id", "event_type", "user_id", F.col("event_id") % 7)
    return e.select("event_id", R.redact_nested(payload, ("k",)).alias("redacted"))


@query()
def near_draft_links(spark, sf):
    """Drafts whose masked texts are alike, one row of each different mask."""
    rows = context(spark, sf).where("text is not null").groupBy(T.shape(F.col("text")).alias("shape")).agg(F.min("row_id").alias("id"))
    return DD.near_links(rows.select("id", F.lit(None).cast("string").alias("group"), "shape"))


@query(f"""select {FOLD.format('draft')} as key, count(distinct {FOLD.format('committed')}) as targets, array_to_string(list_sort(list(distinct source)), ',') as splits from {BURSTS}
  where draft is not null and committed is not null group by key having count(distinct {FOLD.format('committed')}) > 1""")
def conflicting_commits(spark, sf):
    """Drafts that were committed in different ways, with the sources they came from."""
    b = bursts(spark, sf)
    return Q.conflicts(b, T.fold(F.col("draft")), T.fold(F.col("committed")), F.col("source"))
