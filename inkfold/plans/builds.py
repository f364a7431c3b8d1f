"""Queries of corpus builds and reports, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.operators import builds as B
from inkfold.operators import corpus as C
from inkfold.operators import lexical as L
from inkfold.operators import planning as PL
from inkfold.operators import quality as Q
from inkfold.operators import reports as RP
from inkfold.operators import rules as R
from inkfold.operators import score as SC
from inkfold.operators import validation as V
from inkfold.plans.checks import _GROUPS, _J, _group_reasons
from inkfold.plans.queries import BURSTS, CONTEXT, FOLD, GOLD, LAST, PLAIN, SUGGESTION, WORDS, _reject_sql, bursts, context, gold, query
from inkfold.session import table

_COLLAPSED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("""select policy, split, size, n as rows, cast(n / 10 as integer) as unchanged from (
  select unnest(['window_v1', 'draft_v2']) as policy, split, size, case split when 'train' then 400 else 40 end as n from (values ('train'), ('eval'), ('test')) s(split), range(1, 6) r(size)
  union all select 'runtime_v2', split, unnest(range(1, 11)), unnest(case split when 'train' then [160, 320, 400, 560, 640, 680, 600, 440, 360, 840] else [40, 80, 80, 120, 120, 120, 120, 80, 80, 160] end) from (values ('train'), ('eval'), ('test')) s(split))""")
def window_quotas(spark, sf):
    rows = [(p.name, *q) for p in B.POLICIES.values() for q in B.quotas(p)]
    return spark.createDataFrame(rows, "policy string, split string, size long, rows int, unchanged int")


_WANTED = {1: 36, 2: 36, 3: 48, 4: 48, 5: 60}
_SOURCE = f"""(select id, {WORDS.format(_COLLAPSED.format('utt'))} as w from (select * from utterances where id is not null and utt is not null and partition = 'train' qualify row_number() over (partition by id order by utt) = 1) where {_reject_sql('utt')} is null)"""


def _windows_sql(seed: str, chunk: int | None) -> str:
    parts, names = [f"left_ as (select * from {_SOURCE})"], []
    for size in sorted(_WANTED, reverse=True):
        taken = "".join(f" and id not in (select id from t{s})" for s in names)
        dice = f"('0x' || substr(sha256('{seed}:start:{size}:' || id), 1, 8))::bigint"
        if chunk is None:
            fits, start = f"len(w) >= {size}", f"{dice} % (len(w) - {size} + 1)"
        elif size == chunk:
            fits, start = f"len(w) >= {size}", f"({dice} % (len(w) // {chunk})) * {chunk}"
        else:
            fits, start = f"len(w) % {chunk} = {size}", f"len(w) - {size}"
        parts.append(f"w{size} as (select id, start, array_to_string(w[start + 1:start + {size}], ' ') as text, sha256('{seed}:{size}:' || id) as p from (select *, {start} as start from left_ where {fits}{taken}))")
        one = f"select * from w{size} where {_reject_sql('text')} is null and length(text) <= 160 qualify row_number() over (partition by {PLAIN.format('text')} order by p, id) = 1"
        parts.append(f"t{size} as (select id, cast({size} as integer) as size, cast(start as integer) as start, text from ({one}) order by p, id limit {_WANTED[size]})")
        names.append(size)
    return f"with {', '.join(parts)} " + " union all ".join(f"select * from t{s}" for s in names)


def _source(spark, sf):
    u = table(spark, sf, "utterances").where("id is not null and utt is not null and partition = 'train'")
    return Q.first_of_each(u, ["id"], [F.col("utt")])


@query(_windows_sql("window", None))
def balanced_windows(spark, sf):
    return B.balanced_windows(_source(spark, sf), "id", "utt", _WANTED, "window")


@query(_windows_sql("chunk", 5))
def balanced_chunks(spark, sf):
    return B.balanced_windows(_source(spark, sf), "id", "utt", _WANTED, "chunk", chunk=5)


_PLAN = dict(
    behaviours={"useful": 0.45, "irrelevant": 0.175, "ambiguous": 0.125, "conflicting": 0.125, "none": 0.125},
    categories={"context_disambiguation": 0.45, "context_entity": 0.3, "context_register": 0.2, "already_correct": 0.05},
)


@query("""select 'behaviour' as dimension, name as value, cast(n as bigint) as n from (values ('useful', 90), ('irrelevant', 35), ('ambiguous', 25), ('conflicting', 25), ('none', 25)) b(name, n)
  union all select 'category', name, n from (values ('context_disambiguation', 90), ('context_entity', 60), ('context_register', 40), ('already_correct', 10)) c(name, n)
  union all select 'variant', name, 16 from (values ('context_a'), ('context_b'), ('no_context'), ('irrelevant'), ('ambiguous'), ('conflicting')) v(name)
  union all select 'groups', '', 16""")
def slot_schedule(spark, sf):
    """What a round of 200 slots, of which 0.48 may stand in contrast groups, is made of."""
    plan = B.slots(200, _PLAN["behaviours"], _PLAN["categories"], ["context_disambiguation", "context_entity", "context_register"], 0.48, "plan")
    s = spark.createDataFrame(plan, "slot_id string, category string, context_behavior string, group_id string, variant string")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in (("behaviour", "context_behavior"), ("category", "category"), ("variant", "variant"))])
    g = s.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return g.union(s.agg(F.countDistinct("group_id").alias("n")).select(F.lit("groups").alias("dimension"), F.lit("").alias("value"), "n"))


_CTX = f"""(select row_id, {_COLLAPSED.format('input.text')} as text, {_COLLAPSED.format('output.suggestion')} as suggestion, input.context_snippets[1] is not null as has from context where input.text is not null and output.suggestion is not null)"""
_KINDS = f"""(select r.*, case when not has then 'context_preservation' when b.text is not null and b.s is not distinct from r.suggestion then 'context_hard_negative' when b.text is null and r.suggestion = r.text then 'context_preservation' else 'context_disambiguation' end as kind,
    case when not has then 'without_context' when b.text is not null and b.s is not distinct from r.suggestion then 'distractor_context' else 'relevant_context' end as variant,
    case when not has then 'not_retained' when b.text is not null and b.s is not distinct from r.suggestion then 'synthetic_distractor' else 'necessary_for_label' end as basis
  from {_CTX} r left join (select text, arg_max(suggestion, row_id) as s from {_CTX} where not has group by text) b on b.text = r.text)"""


@query(f"select row_id, kind, variant, basis from {_KINDS}")
def context_kinds(spark, sf):
    r = table(spark, sf, "context").where("input.text is not null and output.suggestion is not null")
    has = C.bounded_snippet(F.col("input.context_snippets")).isNotNull()
    return B.classified(r, T.collapse(F.col("input.text")), T.collapse(F.col("output.suggestion")), has, "row_id").select("row_id", "kind", "variant", "basis")


_FAMILY = f"'draft:' || substr(sha256({FOLD.format('text')}), 1, 20)"


@query(f"""select row_id, kind, family, case when u < 0.8 then 'train' when u < 0.9 then 'eval' else 'test' end as split from (
  select *, ('0x' || substr(sha256('corpus:' || family), 1, 8))::bigint / 4294967296.0 as u from (select row_id, kind, {_FAMILY} as family from {_KINDS}))""")
def context_corpus(spark, sf):
    r = B.context_corpus(table(spark, sf, "context"), "row_id", "draft:", {"train": 0.8, "eval": 0.1, "test": 0.1}, "corpus")
    return r.select("row_id", "kind", "family", "split")


@query(f"""select source_partition, dimension, key, count(*) as n from (select source_partition, unnest([{{'dimension': 'rows', 'key': ''}}, {{'dimension': 'changed', 'key': coalesce(cast(target_changed as varchar), 'null')}},
    {{'dimension': 'size', 'key': coalesce(cast(window_size as varchar), 'null')}}, {{'dimension': 'changed_by_size', 'key': coalesce(cast(target_changed as varchar), 'null') || '/' || coalesce(cast(window_size as varchar), 'null')}}], recursive := true) from {CONTEXT}) group by all""")
def split_summary(spark, sf):
    return B.split_summary(context(spark, sf), "source_partition", "target_changed", "window_size")


@query(f"select burst_id, ts_ms from {BURSTS} order by ts_ms desc, burst_id desc limit 500")
def recent_events(spark, sf):
    return B.last_rows(bursts(spark, sf).select("burst_id", "ts_ms"), [F.desc("ts_ms"), F.desc("burst_id")], 500)


@query("select prediction_seq, example_id from predictions where prediction_seq <= 200")
def first_predictions(spark, sf):
    return B.first_rows(table(spark, sf, "predictions").select("prediction_seq", "example_id"), "prediction_seq", 200)


@query("""select 0 as part, row_number() over (order by id, utt, intent, scenario, locale, partition) - 1 as row, id, null as burst_id from (select distinct * from utterances where id is not null)
  union all select 1, row_number() over (order by burst_id) - 1, null, burst_id from (select distinct burst_id from labeled_examples)""")
def concatenated_rows(spark, sf):
    u = table(spark, sf, "utterances").where("id is not null").distinct()
    u = u.select("id", F.struct("id", "utt", "intent", "scenario", "locale", "partition").alias("o"))
    b = table(spark, sf, "labeled_examples").select("burst_id").distinct().select("burst_id", F.col("burst_id").alias("o"))
    one = B.concatenated([u], "o").drop("o")
    two = B.concatenated([b], "o").drop("o").withColumn("_part", F.lit(1))
    return one.unionByName(two, allowMissingColumns=True).select(F.col("_part").alias("part"), F.col("_row").alias("row"), "id", "burst_id")


# ---- reports -------------------------------------------------------------------------------------------------------


@query("""select example_id, label, list(response order by prediction_seq) as responses, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(total_tokens) as bigint) as total_tokens
  from predictions where response is not null and example_id is not null group by example_id, label""")
def candidate_usage(spark, sf):
    p = table(spark, sf, "predictions").where("response is not null and example_id is not null")
    return RP.set_usage(p, ["example_id", "label"], "prediction_seq", ["input_tokens", "output_tokens", "total_tokens"])


_VALID = f"{SUGGESTION.format('response')} is not null"


@query(f"""select count(*) as requests, count_if(status = 'ok') as ok, count_if(not coalesce(status = 'ok', false)) as errors, count_if(not ({_VALID})) as schema_invalid,
  (select latency_ms from predictions where status = 'ok' order by prediction_seq desc limit 1) as last_latency_ms, round(avg(case when status = 'ok' then latency_ms end), 6) as avg_latency_ms from predictions""")
def result_counters(spark, sf):
    p = table(spark, sf, "predictions")
    c = RP.counters(p, ["prediction_seq"], F.col("status") == "ok", R.suggestion_of(F.col("response")).isNotNull(), "latency_ms")
    return c.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("select prediction_seq, round(avg(latency_ms) over (partition by example_id, label order by prediction_seq rows unbounded preceding), 6) as running_mean from predictions where example_id is not null and label is not null")
def running_latency(spark, sf):
    p = table(spark, sf, "predictions").where("example_id is not null and label is not null")
    return RP.running(p, ["example_id", "label"], [F.col("prediction_seq")], "latency_ms").select("prediction_seq", F.round("running_mean", 6).alias("running_mean"))


_CASES = f"""(select p.label, g.changed, p.error, p.latency_ms, coalesce(list_contains(list_transform(g.accepted, lambda a: {FOLD.format('a')}), {FOLD.format(SUGGESTION.format('p.response'))}), false) as top,
    coalesce(len(list_filter(list_transform(coalesce(p.responses, []), lambda r: {FOLD.format(SUGGESTION.format('r'))}), lambda f: list_contains(list_transform(g.accepted, lambda a: {FOLD.format('a')}), f))) > 0, false) as anyone
  from {LAST} p join {GOLD} g using (example_id))"""


@query(f"""select label, count(*) as cases, round(avg(top::int), 4) as overall_success, round(avg(case when coalesce(changed, false) then top::int end), 4) as changed_top1_success,
  round(avg(case when coalesce(changed, false) then anyone::int end), 4) as changed_any_candidate, round(avg(case when not coalesce(changed, false) then top::int end), 4) as unchanged_kept,
  count_if(error is not null) as errors, round(avg(latency_ms), 1) as mean_latency_ms from {_CASES} group by label""")
def live_report(spark, sf):
    p = SC.last_prediction(table(spark, sf, "predictions"), ["example_id", "label"], "prediction_seq")
    r = p.join(gold(spark, sf).select("example_id", "accepted", "changed"), "example_id")
    folded = F.transform("accepted", T.fold)
    top = F.array_contains(folded, T.fold(R.suggestion_of(F.col("response"))))
    some = F.exists(F.transform("responses", lambda x: T.fold(R.suggestion_of(x))), lambda f: F.array_contains(folded, f))
    return RP.live_report(r, ["label"], F.col("changed"), top, some, F.col("error").isNotNull(), "latency_ms")


_CATEGORIES = ["context_disambiguation", "context_entity", "context_preservation", "context_register", "number_date_identifier", "tone_preservation"]
_STATUS = f"""(select c.candidate_id, case when len(g.reasons) > 0 then 'rejected_group' when j.candidate_id is null then 'pending' when len(j.reasons) > 0 then 'rejected_judgment' else 'accepted' end as status, list_concat(coalesce(g.reasons, []), coalesce(j.reasons, [])) as reasons
  from (select distinct candidate_id, group_id from synthetic_candidates) c left join {_GROUPS} g using (group_id) left join {_J} j using (candidate_id))"""


def _status(spark, sf):
    r = table(spark, sf, "synthetic_candidates")
    local = spark.createDataFrame([], "candidate_id string, reasons array<string>")
    judged = table(spark, sf, "judgments").select("candidate_id", R.judgment_reasons().alias("reasons"))
    return V.status(r, "candidate_id", "group_id", local, judged, _group_reasons(spark, sf))


@query(f"""select t.category, count(distinct c.candidate_id) as candidates, count(distinct case when s.status = 'accepted' then c.candidate_id end) as accepted,
  case when count(distinct c.candidate_id) = 0 then 0.0 else round(count(distinct case when s.status = 'accepted' then c.candidate_id end) / count(distinct c.candidate_id), 4) end as rate
  from (select unnest({_CATEGORIES}) as category) t left join synthetic_candidates c using (category) left join {_STATUS} s using (candidate_id) group by t.category""")
def run_acceptance(spark, sf):
    return RP.run_summary(table(spark, sf, "synthetic_candidates"), "candidate_id", "category", _CATEGORIES, _status(spark, sf))[0]


@query(f"select reason, count(distinct candidate_id) as n from (select candidate_id, unnest(reasons) as reason from {_STATUS} where candidate_id is not null) group by reason")
def run_rejections(spark, sf):
    s = _status(spark, sf).where("candidate_id is not null")
    return RP.run_summary(table(spark, sf, "synthetic_candidates"), "candidate_id", "category", _CATEGORIES, s)[1]


@query("""with p as (select unnest([{'dimension': 'domain', 'value': domain}, {'dimension': 'error_type', 'value': error_type}, {'dimension': 'writing_style', 'value': writing_style}], recursive := true) from synthetic_candidates)
  select dimension, value, n, round(n / sum(n) over (partition by dimension), 6) as share from (select dimension, value, count(*) as n from p where value is not null group by all)""")
def run_diversity(spark, sf):
    return RP.diversity(table(spark, sf, "synthetic_candidates"), ["domain", "error_type", "writing_style"])


_SUGG = SUGGESTION.format("response")


@query(f"""select prediction_seq, o as output_chars, c as suggestion_chars, o - c as schema_chars, round(t * sh, 6) as suggestion_tokens, round(t - t * sh, 6) as schema_tokens, round(ms, 6) as server_ms_per_token, round(ms * (t - t * sh), 6) as schema_ms, input_tokens + t as tokens, t >= 120 as limit_reached
  from (select *, case when o = 0 then 0.0 else c / o end as sh, case when t = 0 then 0.0 else latency_ms / t end as ms from (select prediction_seq, latency_ms, input_tokens, output_tokens as t, length(response) as o, least(coalesce(length({_SUGG}), 0), length(response)) as c from predictions))""")
def token_details(spark, sf):
    d = RP.token_details(table(spark, sf, "predictions"), ["prediction_seq"], "response", R.suggestion_of(F.col("response")), "input_tokens", "output_tokens", "latency_ms", F.lit(120))
    d = d.drop("decode_ms_per_token", "queue_ms")
    return d.select(*[F.round(c, 6).alias(c) if c in ("suggestion_tokens", "schema_tokens", "server_ms_per_token", "schema_ms") else F.col(c) for c in d.columns])


_LEX = "(select word, count(*) as n from (select distinct i, unnest(regexp_extract_all(lower(utt), '[a-z]+(?:''[a-z]+)?')) as word from (select row_number() over () as i, utt from utterances where utt is not null)) group by word having count(*) >= 5)"


@query(f"""with t as (select distinct text, suggestion as target from {CONTEXT} where text is not null and suggestion is not null), w as (select text, target, unnest(case when len(list_distinct(regexp_extract_all(lower(target), '[a-z]+(?:''[a-z]+)?'))) = 0 then [null] else list_distinct(regexp_extract_all(lower(target), '[a-z]+(?:''[a-z]+)?')) end) as word from t)
  select text, target, min(case when word is not null then coalesce(n, 0) end) as least from w left join {_LEX} using (word) group by text, target order by least nulls last, text, target limit 25""")
def hardest_rows(spark, sf):
    voc = L.derived_vocabulary(table(spark, sf, "utterances"), "utt", 5)
    counts = table(spark, sf, "utterances").where("utt is not null").select(F.explode(F.array_distinct(T.english_tokens(F.lower("utt")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("zipf"))
    lexicon = voc.select("word").join(counts, "word")
    return RP.hardest(context(spark, sf), "text", "suggestion", lexicon, 25).select("text", "target", F.col("zipf").cast("long").alias("least"))


@query("select s_nationkey, s_suppkey, s_acctbal from supplier where s_acctbal is not null qualify row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) = 1")
def group_leaders(spark, sf):
    return RP.leader(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey")


@query()
def hint_coverage(spark, sf):
    """How far hints of the utterances' vocabulary reach over the gold examples."""
    g = gold(spark, sf)
    tokens = L.lookup_tokens(g, "example_id", "draft")
    found = L.ranked(L.edit_candidates(tokens.select("token"), L.derived_vocabulary(table(spark, sf, "utterances"), "utt", 5)))
    best = found.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("candidates"))
    hints = tokens.join(best, "token").groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "candidates"))).alias("hints"))
    return RP.hint_coverage(g.join(hints, "example_id", "left"), "changed", "accepted", "hints")


@query("select label, count(*) as calls, count(estimated_cost_usd) as with_cost, round(sum(estimated_cost_usd), 8) as cost from predictions group by label")
def run_costs(spark, sf):
    return RP.costs(table(spark, sf, "predictions"), ["label"], "estimated_cost_usd")


@query("""with g as (select group_id from synthetic_candidates where group_id is not null group by group_id having count(distinct candidate_id) = 6 order by group_id limit 20)
  select distinct candidate_id, group_id from synthetic_candidates where group_id in (select group_id from g)""")
def whole_groups(spark, sf):
    """The first 120 rows of groups that have all six members."""
    return PL.complete_groups(table(spark, sf, "synthetic_candidates"), "group_id", "candidate_id", 6, 120).select("candidate_id", "group_id").distinct()
