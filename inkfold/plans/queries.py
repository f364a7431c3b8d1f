"""Queries over the test tables, one for each operator or family of operators, and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions import distance as D
from inkfold.functions import edits as E
from inkfold.functions import text as T
from inkfold.operators import augment as A
from inkfold.operators import corpus as C
from inkfold.operators import dedupe as DD
from inkfold.operators import lexical as L
from inkfold.operators import patterns as P
from inkfold.operators import planning as PL
from inkfold.operators import profile as PR
from inkfold.operators import quality as Q
from inkfold.operators import rules as R
from inkfold.operators import sampling as S
from inkfold.operators import score as SC
from inkfold.operators import windows as WN
from inkfold.session import table
from inkfold.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared parts --------------------------------------------------------------------------------------------------

PLAIN = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_'']+', ' ', 'g'))"
WORDS = "list_filter(regexp_split_to_array(trim({}, ' \t\n\r'), '\\s+'), lambda x: x <> '')"
CONTEXT = """(select row_id, received_at, input.text as text, output.suggestion as suggestion, metadata.* from context)"""
BURSTS = "(select * from labeled_examples qualify row_number() over (partition by burst_id order by received_at, ts_ms) = 1)"
SUGGESTION = "case when json_valid({0}) then case when json_type({0}) = 'OBJECT' then case when json_keys({0}) = ['suggestion'] and json_type({0}, '$.suggestion') = 'VARCHAR' and trim(json_extract_string({0}, '$.suggestion')) <> '' then json_extract_string({0}, '$.suggestion') end end end"
FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


def context(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "context").select("row_id", "received_at", F.col("input.text").alias("text"), F.col("output.suggestion").alias("suggestion"), "metadata.*")


def bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Typing bursts, the first delivery of each."""
    return Q.first_of_each(table(spark, sf, "labeled_examples"), ["burst_id"], [F.col("received_at"), F.col("ts_ms")])


def gold(spark: SparkSession, sf: str) -> DataFrame:
    rows = context(spark, sf).where("source_partition in ('eval', 'test') and example_id is not null and text is not null")
    first = Q.first_of_each(rows, ["example_id"], [F.col("row_id")])
    return first.select("example_id", F.col("text").alias("draft"), F.col("accepted_suggestions").alias("accepted"), F.col("target_changed").alias("changed"), F.lower(F.trim("category")).alias("category"))


GOLD = f"""(select example_id, text as draft, accepted_suggestions as accepted, target_changed as changed, lower(trim(category)) as category
  from {CONTEXT} where source_partition in ('eval', 'test') and example_id is not null and text is not null
  qualify row_number() over (partition by example_id order by row_id) = 1)"""
LAST = "(select * from predictions where example_id is not null and label is not null qualify row_number() over (partition by example_id, label order by prediction_seq desc) = 1)"


# ---- text and rules ------------------------------------------------------------------------------------------------

_PH = r"(?:^|[^\p{L}\p{N}_])(?:\+?\p{Nd}[\s().-]*){7,}(?:[^\p{L}\p{N}_]|$)"


def _reject_sql(x: str) -> str:
    q = lambda p: p.replace("'", "''")
    y = f"trim(regexp_replace({x}, '[\\s\\v\u0085\u00a0\u2028\u2029]+', ' ', 'g'))"
    return f"""case when coalesce({y}, '') = '' then 'empty' when regexp_matches({x}, '[\\n\\r]') then 'multiline'
      when not regexp_matches({x}, '[A-Za-z]') then 'not_text' when regexp_matches({y}, '{q(T.EMAIL)}') then 'email'
      when regexp_matches({y}, '{q(T.URL)}') then 'url' when regexp_matches({y}, '{_PH}') then 'phone'
      when regexp_matches({y}, '{q(T.HANDLE)}') then 'handle' when regexp_matches({y}, '{q(T.MARKUP)}') then 'markup'
      when regexp_matches({y}, '{q(T.CODE)}') then 'code' end"""


@query(f"select lang, coalesce({_reject_sql('line')}, 'good') as reason, count(*) as n from (select lang, unnest(string_split(text, chr(10))) as line from documents) group by all")
def reject_reason_counts(spark, sf):
    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang", F.coalesce(R.source_reason(F.col("line")), F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select coalesce(case when {_reject_sql('text')} is not null then {_reject_sql('text')} when text <> {FOLD.format('text').replace('lower', '')} then 'irregular_whitespace' when length(text) > 160 then 'too_long' end, 'good') as reason, count(*) as n from {CONTEXT} group by all""")
def draft_reason_counts(spark, sf):
    return context(spark, sf).groupBy(F.coalesce(R.draft_reason(F.col("text")), F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_W5 = f"""(select id, unnest(list_transform(range(1, len(w) + 1, 5), lambda i: array_to_string(w[i:i + 4], ' '))) as win from (select id, {WORDS.format('utt')} as w from utterances where utt is not null))"""


@query(f"select len({WORDS.format('win')}) as size, coalesce(case when {_reject_sql('win')} is not null then {_reject_sql('win')} when length(win) > 160 then 'too_long' end, 'good') as reason, count(*) as n from {_W5} group by all")
def runtime_word_windows(spark, sf):
    wins = table(spark, sf, "utterances").where("utt is not null").select("id", F.explode(WN.chunks(F.col("utt"), 5)).alias("win"))
    size = T.word_count(F.col("win"))
    return wins.groupBy(size.alias("size"), F.coalesce(R.window_reason(F.col("win"), size), F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select burst_id, array_to_string(w[greatest(len(w) - 3, 1):len(w)], ' ') as last_words, len(w) // 5 as finished from (select burst_id, {WORDS.format('draft')} as w from {BURSTS} where draft is not null)")
def burst_windows(spark, sf):
    d = F.col("draft")
    return bursts(spark, sf).where("draft is not null").select("burst_id", WN.trailing(d, 4).alias("last_words"), F.size(WN.finished_chunks(F.concat(d, F.lit(" ")), 5)).cast("long").alias("finished"))


@query(f"""select row_id, {PLAIN.format('text')} as plain, {FOLD.format("regexp_replace(trim(text), '[.!?]+$', '')")} as surface,
  regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, right(text, 80) as tail, len({WORDS.format('text')}) as n_words,
  array_to_string(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'), ' ') as tokens from {CONTEXT} where text is not null""")
def text_forms(spark, sf):
    t = F.col("text")
    rows = context(spark, sf).where("text is not null")
    return rows.select("row_id", T.plain(t).alias("plain"), T.surface(t).alias("surface"), T.slug(t).alias("slug"), T.tail(t).alias("tail"), T.word_count(t).cast("long").alias("n_words"), F.array_join(T.english_tokens(t), " ").alias("tokens"))


@query()
def exact_text_forms(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", F.length(T.plain_exact(F.col("text"))).alias("plain_length"), F.size(T.token_spans(F.col("text"))).alias("n_tokens"), T.utf16_length(F.col("text")).alias("utf16"))


_DENIED = ("k",)


@query("select event_id, case when json_keys(props) is null then null else '{}' end as redacted from events")
def redacted_events(spark, sf):
    return table(spark, sf, "events").select("event_id", R.redact(F.col("props"), _DENIED).alias("redacted"))


# ---- quality -------------------------------------------------------------------------------------------------------


@query(f"""select lang, cast(sum(n) as bigint) as rows, count(*) as distinct_keys, cast(sum(n - 1) as bigint) as surplus
  from (select lang, {PLAIN.format('text')} as k, count(*) as n from documents where text is not null group by all) group by lang""")
def normalized_duplicates(spark, sf):
    return Q.duplicate_surplus(table(spark, sf, "documents"), ["lang"], T.plain(F.col("text")))


@query(f"""select source_partition, dimension, key, count(*) as n from (
  select source_partition, unnest([{{'dimension': 'category', 'key': lower(trim(category))}}, {{'dimension': 'variant', 'key': context_variant}}, {{'dimension': 'source', 'key': source_dataset}},
    {{'dimension': 'changed', 'key': cast(target_changed as varchar)}}, {{'dimension': 'window', 'key': cast(window_size as varchar)}}], recursive := true) from {CONTEXT}) group by all""")
def frequency_tables(spark, sf):
    dims = {"category": F.lower(F.trim("category")), "variant": F.col("context_variant"), "source": F.col("source_dataset"), "changed": F.col("target_changed"), "window": F.col("window_size")}
    return Q.frequencies(context(spark, sf), ["source_partition"], dims)


@query(f"""with s as (select distinct {PLAIN.format('text')} as k, source_partition as s from {CONTEXT} where text is not null and source_partition is not null)
  select a.s as left_split, b.s as right_split, count(*) as surfaces from s a join s b on a.k = b.k and a.s < b.s group by all""")
def split_overlaps(spark, sf):
    return Q.overlaps(context(spark, sf), T.plain(F.col("text")), F.col("source_partition"))


@query(f"""select key, count(distinct v) as targets, array_to_string(list_sort(list(distinct s)), ',') as splits
  from (select {FOLD.format('text')} as key, {FOLD.format('suggestion')} as v, source_partition as s from {CONTEXT}) where key is not null and v is not null group by key having count(distinct v) > 1""")
def conflicting_targets(spark, sf):
    return Q.conflicts(context(spark, sf), T.fold(F.col("text")), T.fold(F.col("suggestion")), F.col("source_partition"))


@query(f"select source_partition, count(*) as n, count_if(target_changed) as changed, count(distinct family_id) as families, count(distinct lower(trim(category))) as categories, count(distinct context_variant) as variants from {CONTEXT} group by source_partition")
def context_split_report(spark, sf):
    return context(spark, sf).groupBy("source_partition").agg(F.count(F.lit(1)).alias("n"), F.count_if("target_changed").alias("changed"), F.countDistinct("family_id").alias("families"), F.countDistinct(F.lower(F.trim("category"))).alias("categories"), F.countDistinct("context_variant").alias("variants"))


@query(f"select row_id, example_id from {CONTEXT} where example_id is not null qualify row_number() over (partition by example_id order by received_at, row_id) = 1")
def first_deliveries(spark, sf):
    rows = context(spark, sf).where("example_id is not null")
    return Q.first_of_each(rows, ["example_id"], [F.col("received_at"), F.col("row_id")]).select("row_id", "example_id")


@query(f"select count(*) as rows, count(distinct example_id) as distinct_ids, count_if(example_id is null) as null_ids from {CONTEXT}")
def id_uniqueness(spark, sf):
    return Q.id_check(context(spark, sf), "example_id")


@query(f"""with a as (select lower(trim(category)) as category, count(*) as n from {CONTEXT} where category is not null group by 1), e as (select category, min(min_rows) as n from sample_targets group by 1)
  select category, coalesce(a.n, 0) as actual_n, cast(coalesce(e.n, 0) as bigint) as expected_n from a full join e using (category) where coalesce(a.n, 0) <> coalesce(e.n, 0)""")
def quota_check(spark, sf):
    a = context(spark, sf).where("category is not null").groupBy(F.lower(F.trim("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf, "sample_targets").groupBy("category").agg(F.min("min_rows").cast("long").alias("n"))
    return Q.quota_differences(a, e, ["category"])


@query("""select group_id, count(*) as n, count(distinct variant) as variants, count(distinct input.text) as drafts,
  count(distinct variant) = 6 and count(*) = 6 as complete from synthetic_candidates where group_id is not null group by group_id""")
def contrast_groups(spark, sf):
    r = table(spark, sf, "synthetic_candidates").where("group_id is not null")
    n, v = F.count(F.lit(1)), F.countDistinct("variant")
    return r.groupBy("group_id").agg(n.alias("n"), v.alias("variants"), F.countDistinct("input.text").alias("drafts"), ((v == 6) & (n == 6)).alias("complete"))


def _bad(name: str, x: str) -> list[tuple[str, str]]:
    q = lambda p: p.replace("'", "''")
    checks = (("empty", f"trim({x}, ' ') = ''"), ("control", f"regexp_matches({x}, '{q(T.CONTROL)}')"), ("email", f"regexp_matches({x}, '{q(T.EMAIL)}')"), ("phone", f"regexp_matches({x}, '{_PH}')"), ("url", f"regexp_matches({x}, '(?i)(?:https?://|www\\.)')"), ("newline", f"regexp_matches({x}, '[\\n\\r]')"))
    return [(f"{name}_{r}", f"coalesce({c}, true)") for r, c in checks]


_SN = "coalesce(input.context_snippets, [])"
_REASONS = ", ".join(
    f"case when {c} then '{r}' end"
    for r, c in (
        *_bad("input", "input.text"),
        *_bad("suggestion", "output.suggestion"),
        ("input_too_long", "length(input.text) > 160"),
        ("unsupported_word_count", f"len({WORDS.format('input.text')}) not between 1 and 10"),
        ("too_many_snippets", f"len({_SN}) > 4"),
        ("snippet_too_long", f"len(list_filter({_SN}, lambda x: length(x.visible_text) > 1200)) > 0"),
        ("context_not_empty", f"context_behavior = 'none' and len({_SN}) > 0"),
        ("context_missing", f"context_behavior <> 'none' and len({_SN}) = 0"),
        ("rationale_empty", "coalesce(trim(rationale), '') = ''"),
    )
)


@query(f"select reason, count(*) as n from (select unnest(list_filter([{_REASONS}], lambda x: x is not null)) as reason from synthetic_candidates) group by reason")
def candidate_rejections(spark, sf):
    r = table(spark, sf, "synthetic_candidates")
    return r.select(F.explode(R.candidate_reasons(r)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_LOW = ", ".join(f"case when coalesce(scores.{d} < 4, true) then 'low_{d}' end" for d in R.DIMENSIONS)


@query(f"select candidate_id, array_to_string(list_sort(list_filter([case when not coalesce(pass, false) then 'not_passed' end, {_LOW}], lambda x: x is not null)), ',') as reasons from judgments")
def judgment_rejections(spark, sf):
    return table(spark, sf, "judgments").select("candidate_id", F.array_join(R.judgment_reasons(), ",").alias("reasons"))


@query("""select c.category, count(distinct c.candidate_id) as candidates, count(distinct j.candidate_id) as judged, count(distinct case when j.pass then j.candidate_id end) as passed
  from synthetic_candidates c left join judgments j using (candidate_id) group by c.category""")
def acceptance_by_category(spark, sf):
    j = table(spark, sf, "judgments").select("candidate_id", F.col("candidate_id").alias("j"), "pass")
    both = table(spark, sf, "synthetic_candidates").select("candidate_id", "category").join(j, "candidate_id", "left")
    return both.groupBy("category").agg(F.countDistinct("candidate_id").alias("candidates"), F.countDistinct("j").alias("judged"), F.countDistinct(F.when(F.col("pass"), F.col("j"))).alias("passed"))


@query("select distinct candidate_id from synthetic_candidates c where candidate_id is not null and not exists (select 1 from judgments j where j.candidate_id = c.candidate_id)")
def pending_judgments(spark, sf):
    c = table(spark, sf, "synthetic_candidates").select("candidate_id").where("candidate_id is not null").distinct()
    return c.join(table(spark, sf, "judgments").select("candidate_id"), "candidate_id", "left_anti")


_SC = "[" + ", ".join(f"coalesce(j.scores.{d}, 0)" for d in R.DIMENSIONS) + "]"
_JUDGED = "(select distinct candidate_id, category, context_behavior from synthetic_candidates where candidate_id is not null)"


def _judged(spark, sf):
    c = table(spark, sf, "synthetic_candidates").where("candidate_id is not null").select("candidate_id", "category", "context_behavior").distinct()
    return PL.by_quality(c.join(table(spark, sf, "judgments").select("candidate_id", "scores"), "candidate_id"), ["category", "context_behavior"])


@query(f"""select candidate_id, category, context_behavior, row_number() over (partition by category, context_behavior order by list_min({_SC}) desc, list_sum({_SC}) desc, coalesce(j.scores.dataset_value, 0) desc, coalesce(j.scores.context_grounding, 0) desc, candidate_id) as rank
  from {_JUDGED} c join judgments j using (candidate_id)""")
def quality_order(spark, sf):
    return _judged(spark, sf).select("candidate_id", "category", "context_behavior", F.col("rank").cast("long").alias("rank"))


@query()
def deficit_selection(spark, sf):
    """A selection of 100 candidates of even categories."""
    want = {c: 25 for c in ("context_disambiguation", "context_preservation", "context_register", "context_entity")}
    return PL.select(_judged(spark, sf), ["category", "context_behavior"], [want, {}], 100).select("candidate_id", "category", "context_behavior")


# ---- scoring -------------------------------------------------------------------------------------------------------


@query(f"select example_id, label, prediction_seq from {LAST}")
def last_predictions(spark, sf):
    return SC.last_prediction(table(spark, sf, "predictions"), ["example_id", "label"], "prediction_seq").select("example_id", "label", "prediction_seq")


@query(f"""select label, count(*) as predictions, count(g.example_id) as known, count_if(g.example_id is null) as unknown from {LAST} p left join {GOLD} g using (example_id) group by label""")
def prediction_matches(spark, sf):
    p = SC.last_prediction(table(spark, sf, "predictions"), ["example_id", "label"], "prediction_seq")
    g = gold(spark, sf).select("example_id", F.lit(True).alias("known"))
    return p.join(g, "example_id", "left").groupBy("label").agg(F.count(F.lit(1)).alias("predictions"), F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("unknown"))


_COMP = f"""(select example_id, label, i - 1 as idx, {SUGGESTION.format('r')} as s from (select example_id, label, unnest(responses[1:5]) as r, generate_subscripts(responses[1:5], 1) as i from {LAST} where responses is not null))"""


@query(f"""select example_id, label, s as suggestion, votes, first_idx, row_number() over (partition by example_id, label order by votes desc, first_idx) as rank
  from (select example_id, label, s, count(*) as votes, min(idx) as first_idx from {_COMP} where s is not null group by all)""")
def vote_rank_topk(spark, sf):
    p = SC.last_prediction(table(spark, sf, "predictions"), ["example_id", "label"], "prediction_seq")
    r = SC.vote_rank(SC.completions(p, ["example_id", "label"]), ["example_id", "label"])
    return r.select("example_id", "label", "suggestion", "votes", F.col("first_idx").cast("long").alias("first_idx"), F.col("rank").cast("long").alias("rank"))


def _gold_models(spark, sf):
    """Each gold example for each model; models are few and come as one value."""
    models = table(spark, sf, "predictions").where("label is not null").agg(F.array_sort(F.collect_set("label")).alias("m"))
    return gold(spark, sf).withColumn("label", F.explode(models.scalar()))


@query(f"""with g as (select g.*, l.label, g.example_id || '|' || l.label as id from {GOLD} g cross join (select distinct label from predictions where label is not null) l),
  p as (select g.id, g.label, g.category, g.changed, g.draft, g.accepted, p.prediction_seq is not null as has, coalesce(len(p.responses), 0) <> 5 as incomplete,
      list_transform(coalesce(p.responses[1:5], []), lambda r: {SUGGESTION.format('r')}) as items from g left join {LAST} p on p.example_id = g.example_id and p.label = g.label),
  q as (select *, list_transform(accepted, lambda a: {FOLD.format('a')}) as folded, list_filter(items, lambda s: s is not null) as good,
      list_transform(list_filter(items, lambda s: s is not null), lambda s: {FOLD.format('s')}) as fs from p),
  v as (select id, s, count(*) as votes, min(i) as first from (select id, draft, unnest(items) as s, generate_subscripts(items, 1) as i from q) where s is not null and s <> draft group by id, s),
  t as (select id, s from v qualify row_number() over (partition by id order by votes desc, first) = 1),
  e as (select q.label, q.category, not has as missing, incomplete, changed, len(good) as n_schema, len(items) as n,
      len(list_filter(fs, lambda f: (f <> {FOLD.format('draft')}) = changed)) as n_decision, len(list_filter(fs, lambda f: coalesce(list_contains(folded, f), false))) as n_exact,
      t.s is not null as edits, case when changed then coalesce(list_contains(folded, {FOLD.format('t.s')}), false) else t.s is null end as top_ok from q left join t using (id))
  select label, category, cast(grouping(category) as integer) as total, count(*) as examples, count_if(missing) as missing, count_if(not missing and incomplete) as incomplete_batches, sum(n_schema) / (count(*) * 5) as schema_rate,
      sum(n_decision) / (count(*) * 5) as decision_rate, sum(n_exact) / (count(*) * 5) as completion_rate, count_if(n_exact > 0) / count(*) as any_of_five,
      count_if(n = 5 and n_schema = 5 and top_ok) / count(*) as success_rate, count_if(not missing and not changed) as unchanged_examples, count_if(not missing and not changed and edits) as unneeded_edits
  from e group by grouping sets ((label), (label, category))""")
def evaluation_rollup(spark, sf):
    return SC.evaluation(_gold_models(spark, sf), table(spark, sf, "predictions"))


@query()
def fuzzy_scores(spark, sf):
    p = SC.last_prediction(table(spark, sf, "predictions"), ["example_id", "label"], "prediction_seq").select("example_id", "label", "responses")
    rows = gold(spark, sf).join(p, "example_id").select("example_id", "label", "draft", "accepted", "changed", "responses")
    j = SC.judged(SC.completions(rows, ["example_id", "label", "draft", "accepted", "changed"]), "draft", "accepted", "changed")
    return SC.fuzzy_scores(j, "accepted", ["example_id", "label"])


@query("""select label, count(*) as requests, count(error) as errors, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(total_tokens) as bigint) as total_tokens,
  quantile_cont(latency_ms, 0.5) as median_ms, quantile_disc(latency_ms, 0.95) as p95_ms, min(latency_ms) as min_ms, max(latency_ms) as max_ms from predictions group by label""")
def latency_summary(spark, sf):
    return SC.runtime_summary(table(spark, sf, "predictions"), "label")


@query("""select scope, stage, count(*) as n, round(avg(v), 4) as mean, quantile_disc(v, 0.5) as p50, quantile_disc(v, 0.95) as p95, min(v) as min, max(v) as max from (
  select unnest([{'scope': 'request', 'stage': 'latency_ms', 'v': latency_ms}, {'scope': 'tokens', 'stage': 'input_tokens', 'v': input_tokens::double}, {'scope': 'tokens', 'stage': 'output_tokens', 'v': output_tokens::double}], recursive := true)
  from predictions) where v is not null group by all""")
def stage_profile(spark, sf):
    s = PR.stages(table(spark, sf, "predictions"), {"request": ["latency_ms"], "tokens": ["input_tokens", "output_tokens"]})
    return s.withColumn("mean", F.round("mean", 4))


@query("""select label, round(avg(input_tokens), 6) as mean_input, round(avg(output_tokens), 6) as mean_output, round(avg(total_tokens), 6) as mean_total, round(avg(output_tokens) / avg(total_tokens), 6) as output_share,
  round(avg(case when output_tokens <> 0 then latency_ms / output_tokens end), 6) as ms_per_token from predictions group by label""")
def token_profile(spark, sf):
    t = PR.tokens(table(spark, sf, "predictions"), "label")
    return t.select("label", *[F.round(c, 6).alias(c) for c in t.columns if c != "label"])


@query("""select p_partkey, p_size, p_retailprice from part a where p_size is not null and p_retailprice is not null and not exists (select 1 from part b where b.p_size >= a.p_size and b.p_retailprice <= a.p_retailprice and (b.p_size > a.p_size or b.p_retailprice < a.p_retailprice))""")
def pareto_frontier(spark, sf):
    return SC.frontier(table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice")


@query("select s_nationkey, s_suppkey, s_acctbal from supplier qualify row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) = 1")
def metric_leader(spark, sf):
    s = table(spark, sf, "supplier")
    best = F.max_by(F.struct("s_suppkey", "s_acctbal"), F.struct("s_acctbal", -F.col("s_suppkey"))).alias("b")
    return s.groupBy("s_nationkey").agg(best).select("s_nationkey", "b.s_suppkey", "b.s_acctbal")


@query(f"select example_id, label, s as suggestion, idx from (select *, row_number() over (partition by example_id, label, s order by idx) as n from {_COMP} where s is not null) where n = 3 qualify row_number() over (partition by example_id, label order by idx, s) = 1")
def early_exits(spark, sf):
    p = SC.last_prediction(table(spark, sf, "predictions"), ["example_id", "label"], "prediction_seq")
    c = SC.completions(p, ["example_id", "label"]).where("suggestion is not null")
    return WN.early_exit(c, ["example_id", "label"], "idx", "suggestion").select("example_id", "label", "suggestion", F.col("idx").cast("long").alias("idx"))


# ---- sampling ------------------------------------------------------------------------------------------------------


@query("""with g as (select source, count(*) as w from documents where source is not null group by 1), x as (select source, w * 500 / sum(w) over () as x from g), b as (select *, floor(x) as base, 500 - sum(floor(x)) over () as rest from x)
  select source, cast(base + case when row_number() over (order by round(x - base, 9) desc, source) <= rest then 1 else 0 end as bigint) as allocated from b""")
def quota_allocation(spark, sf):
    g = table(spark, sf, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("w"))
    return S.largest_remainder(g, "source", "w", 500)


@query("""with g as (select lang, count(*) as c from documents where lang is not null group by 1), l as (select lang, unnest(range(1, c + 1)) as level from g), t as (select * from l order by level, lang limit 500)
  select g.lang, count(t.level) as allocated from g left join t using (lang) group by 1""")
def water_fill_targets(spark, sf):
    g = table(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    return S.water_fill(g, "lang", "c", 500)


_SRC = f"(select *, sha256('demo:' || example_id) as place from (select * from {CONTEXT} where example_id is not null qualify row_number() over (partition by example_id order by row_id) = 1))"


@query(f"select source_dataset, context_variant, example_id from {_SRC} qualify row_number() over (partition by source_dataset, context_variant order by place, example_id) <= 20")
def seeded_stratified_sample(spark, sf):
    rows = Q.first_of_each(context(spark, sf).where("example_id is not null"), ["example_id"], [F.col("row_id")]).select("source_dataset", "context_variant", "example_id")
    quotas = rows.select("source_dataset", "context_variant").distinct().withColumn("quota", F.lit(20))
    return S.stratified(rows, "example_id", ["source_dataset", "context_variant"], quotas, "demo")


@query(f"""select example_id, context_variant, case when r <= 10 then 1 else 2 end as events from (select *, row_number() over (partition by context_variant order by place, example_id) as r from {_SRC}) where r <= 30""")
def event_schedule(spark, sf):
    rows = Q.first_of_each(context(spark, sf).where("example_id is not null"), ["example_id"], [F.col("row_id")]).select("context_variant", "example_id")
    v = rows.select("context_variant").distinct()
    quotas = v.select("context_variant", F.explode(F.array(F.struct(F.lit(1).alias("events"), F.lit(10).alias("quota")), F.struct(F.lit(2).alias("events"), F.lit(20).alias("quota")))).alias("q")).select("context_variant", "q.*")
    return S.bucketed(rows, ["context_variant"], [S.place("demo", F.col("example_id")), F.col("example_id")], quotas, "events").select("example_id", "context_variant", "events")


@query("select doc_id from (select doc_id, row_number() over (order by captured_at, doc_id) - 1 as i from documents) where i % 10 = 0 and i < 10 * 40")
def systematic_sample(spark, sf):
    return S.systematic(table(spark, sf, "documents"), ["captured_at", "doc_id"], 10, 40).select("doc_id")


_U = "(('0x' || substr(sha256('split:' || family_id), 1, 8))::bigint / 4294967296.0)"


@query(f"select row_id, family_id, case when family_id is null then null when {_U} < 0.8 then 'train' when {_U} < 0.9 then 'eval' else 'test' end as split from {CONTEXT}")
def family_hash_split(spark, sf):
    return S.hash_split(context(spark, sf).select("row_id", "family_id"), "family_id", {"train": 0.8, "eval": 0.1, "test": 0.1}, "split")


def _isolated_sql(quotas: dict[str, int]) -> str:
    parts = [f"""l0 as (select distinct family_id, draft, target, sha256('isolate:' || family_id || ':' || draft || ':' || target) as p from (
      select family_id, {FOLD.format('text')} as draft, {FOLD.format('suggestion')} as target from {CONTEXT} where family_id is not null and text is not null and suggestion is not null))"""]
    for i, (name, quota) in enumerate(quotas.items()):
        one = f"select * from l{i} qualify row_number() over (partition by family_id order by p) = 1"
        for c in ("draft", "target"):
            one = f"select * from ({one}) qualify row_number() over (partition by {c} order by p) = 1"
        parts.append(f"c{i} as (select *, '{name}' as split from ({one}) order by p, family_id limit {quota})")
        parts.append(f"l{i + 1} as (select * from l{i} where family_id not in (select family_id from c{i}) and draft not in (select draft from c{i}) and target not in (select target from c{i}))")
    return f"with {', '.join(parts)} " + " union all ".join(f"select family_id, draft, target, split from c{i}" for i in range(len(quotas)))


_ISOLATED = {"test": 50, "eval": 50, "train": 200}


@query(_isolated_sql(_ISOLATED))
def isolated_splits(spark, sf):
    rows = context(spark, sf).where("family_id is not null and text is not null and suggestion is not null").select("family_id", T.fold(F.col("text")).alias("draft"), T.fold(F.col("suggestion")).alias("target"))
    return S.select_splits(rows, _ISOLATED, ["draft", "target"], "family_id", "isolate").select("family_id", "draft", "target", "split")


# ---- lexical -------------------------------------------------------------------------------------------------------

_TOK = r"(select distinct unnest(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')) as token from " + CONTEXT + " where text is not null)"
_VOC = r"(select word, count(*) as n from (select distinct id, unnest(regexp_extract_all(lower(utt), '[a-z]+(?:''[a-z]+)?')) as word from (select row_number() over () as id, utt from utterances where utt is not null)) where length(word) >= 3 group by word having count(*) >= 5)"


def _lexical(spark, sf):
    t = context(spark, sf).where("text is not null").select(F.explode(T.english_tokens(F.lower("text"))).alias("token"))
    return L.edit_candidates(t, L.derived_vocabulary(table(spark, sf, "utterances"), "utt", 5))


@query(f"""select token, word, distance, rank from (select token, word, levenshtein(token, word) as distance, row_number() over (partition by token order by levenshtein(token, word), n desc, abs(length(token) - length(word)), word) as rank
  from {_TOK} t join {_VOC} v on token <> word and abs(length(token) - length(word)) <= 2 and levenshtein(token, word) <= case when length(token) <= 3 then 1 else 2 end) where rank <= 3""")
def lexical_candidates(spark, sf):
    r = L.ranked(_lexical(spark, sf))
    return r.select("token", "word", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query()
def weighted_lexical_hints(spark, sf):
    return L.hints(_lexical(spark, sf)).select("token", "word", "typing", "rank")


# ---- duplicates, noise and edits -----------------------------------------------------------------------------------


@query(f"""select candidate_id, case when nn = 1 then null when ne > 1 then 'exact_duplicate' else 'normalized_duplicate' end as reason from (
  select candidate_id, row_number() over (partition by n order by k) as nn, row_number() over (partition by e order by k) as ne from (
    select candidate_id, candidate_id || '#' || row_number() over (partition by candidate_id, input.text, output.suggestion) as k, input.text || chr(31) || output.suggestion as e, {PLAIN.format("input.text || ' ' || output.suggestion")} as n
    from synthetic_candidates where candidate_id is not null and input.text is not null and output.suggestion is not null))""")
def ordered_dedupe(spark, sf):
    from pyspark.sql import Window as W

    t, s = F.col("input.text"), F.col("output.suggestion")
    r = table(spark, sf, "synthetic_candidates").where("candidate_id is not null and input.text is not null and output.suggestion is not null")
    n = F.row_number().over(W.partitionBy("candidate_id", t, s).orderBy("candidate_id"))
    r = r.select("candidate_id", F.concat("candidate_id", F.lit("#"), n.cast("string")).alias("k"), F.concat(t, F.lit("\x1f"), s).alias("e"), T.plain(F.concat(t, F.lit(" "), s)).alias("n"))
    return DD.ordered(r, "k", "e", "n").select("candidate_id", "reason")


def _candidates(spark, sf):
    r = table(spark, sf, "synthetic_candidates").where("candidate_id is not null and input.text is not null and output.suggestion is not null")
    t, s, c = F.col("input.text"), F.col("output.suggestion"), F.col("input.context_snippets")
    r = r.select(F.col("candidate_id").alias("id"), F.struct(F.col("group_id").cast("string").alias("group"), DD.normal_key(t, s, c).alias("normal"), T.shape(DD.whole(t, s, c)).alias("shape")).alias("r"))
    return r.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*")  # redelivered rows


@query()
def near_duplicate_links(spark, sf):
    return DD.near_links(_candidates(spark, sf).select("id", "group", "shape"))


@query()
def greedy_dedupe(spark, sf):
    return DD.kept_rows(_candidates(spark, sf))


@query()
def augmented_rows(spark, sf):
    r = Q.first_of_each(table(spark, sf, "utterances").where("utt is not null and id is not null"), ["id"], [F.col("utt")])
    r = r.withColumn("events", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"))
    return A.augment(r, "id", "utt", "events", "noise", A.DRAFT_WEIGHTS)


@query()
def word_diffs(spark, sf):
    r = bursts(spark, sf).where("draft is not null and committed is not null").select("burst_id", "draft", "committed")
    d = r.withColumn("edits", E.diff_of(F.col("draft"), F.col("committed")))
    return d.withColumn("same", E.apply_of(F.col("draft"), F.col("edits")) == T.collapse(F.col("committed"))).select("burst_id", F.size("edits").alias("n_edits"), "same")


_MINED = rf"""(select profile_id, ts_ms, burst_id, pos, lower(regexp_replace(a, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) as shorthand, regexp_replace(b, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') as expansion from (
  select profile_id, ts_ms, burst_id, unnest(da) as a, unnest(db) as b, generate_subscripts(da, 1) - 1 as pos from (
    select profile_id, ts_ms, burst_id, {WORDS.format('draft')} as da, {WORDS.format('committed')} as db from {BURSTS} where draft is not null and committed is not null) where len(da) = len(db)))"""
_GOOD = r"shorthand <> lower(expansion) and regexp_matches(shorthand, '^[\p{L}\p{N}]+$') and regexp_matches(expansion, '^[\p{L}\p{N}]+$') and strlen(shorthand) >= 2 and strlen(expansion) >= 2"


def _mined(spark, sf):
    return P.mined(bursts(spark, sf), "profile_id", ["ts_ms", "burst_id"], "draft", "committed")


@query(f"select profile_id, ts_ms, burst_id, pos, shorthand, expansion from {_MINED} where {_GOOD}")
def pattern_mining(spark, sf):
    pairs = F.posexplode(F.arrays_zip(T.words(F.col("draft")).alias("a"), T.words(F.col("committed")).alias("b"))).alias("pos", "w")
    rows = bursts(spark, sf).where("draft is not null and committed is not null").where(T.word_count(F.col("draft")) == T.word_count(F.col("committed")))
    placed = rows.select("profile_id", "ts_ms", "burst_id", pairs).select("profile_id", "ts_ms", "burst_id", F.col("pos").cast("long").alias("pos"), F.explode(E.replacements(F.col("w.a"), F.col("w.b"))).alias("p"))
    return placed.select("profile_id", "ts_ms", "burst_id", "pos", "p.*")


_RUNS = f"""(with m as (select * from {_MINED} where {_GOOD} and profile_id is not null), l as (select *, first_value(expansion) over w as last, row_number() over w as r from m window w as (partition by profile_id, shorthand order by ts_ms desc, burst_id desc, pos desc)),
  b as (select *, sum(case when expansion <> last then 1 else 0 end) over (partition by profile_id, shorthand order by r) as other from l)
  select profile_id, shorthand, any_value(expansion) as expansion, count(*) as trust from b where other = 0 group by profile_id, shorthand)"""


@query(f"select * from {_RUNS}")
def pattern_trailing_run(spark, sf):
    return P.trailing_runs(_mined(spark, sf).where("profile_id is not null"), "profile_id", ["ts_ms", "burst_id"])


@query(f"select profile_id, shorthand, expansion, trust, row_number() over (partition by profile_id order by trust desc, shorthand) as rank from {_RUNS} where trust >= 2 qualify rank <= 8")
def pattern_top8(spark, sf):
    r = P.for_request(P.trailing_runs(_mined(spark, sf).where("profile_id is not null"), "profile_id", ["ts_ms", "burst_id"]), "profile_id")
    return r.withColumn("rank", F.col("rank").cast("long"))


_ENT = f"(select draft, model_variant, context_used_for_model as ctx, committed, burst_id as entry from {BURSTS} where committed is not null)"


@query(f"""with t as (select burst_id, unnest([{{'probe': 0, 'v': model_variant, 'c': context_used_for_model}}, {{'probe': 1, 'v': model_variant, 'c': false}}, {{'probe': 2, 'v': 'global', 'c': context_used_for_model}}, {{'probe': 3, 'v': 'global', 'c': false}}], recursive := true), draft from {BURSTS})
  select t.burst_id, t.probe, e.entry, e.committed from t join {_ENT} e on e.draft = t.draft and e.model_variant = t.v and e.ctx = t.c qualify row_number() over (partition by t.burst_id order by t.probe, e.entry) = 1""")
def fixture_lookup_fallback(spark, sf):
    b = bursts(spark, sf)
    entries = b.where("committed is not null").select("draft", "model_variant", F.col("context_used_for_model").alias("ctx"), "committed", F.col("burst_id").alias("entry"))
    d, v, c, g, no = F.col("draft"), F.col("model_variant"), F.col("context_used_for_model"), F.lit("global"), F.lit(False)
    probes: list[dict[str, Column]] = [{"draft": d, "model_variant": x, "ctx": y} for x, y in ((v, c), (v, no), (g, c), (g, no))]
    return P.lookup(b, entries, "burst_id", probes, ["draft", "model_variant", "ctx"], "entry").select("burst_id", "probe", "entry", "committed")


# ---- rows of a corpus ----------------------------------------------------------------------------------------------

_ONE = lambda f, n: f"substr(trim(regexp_replace(input.context_snippets[1].{f}, '\\s+', ' ', 'g')), 1, {n})"


@query(f"""select row_id, nullif({_ONE('app_name', 80)}, '') as app_name, coalesce(nullif({_ONE('visible_text', 240)}, ''), nullif({_ONE('window_title', 120)}, '')) as visible_text, nullif({_ONE('window_title', 120)}, '') as window_title
  from context where input.context_snippets[1] is not null""")
def bounded_snippets(spark, sf):
    r = table(spark, sf, "context").select("row_id", C.bounded_snippet(F.col("input.context_snippets")).alias("s"))
    return r.where("s is not null").select("row_id", "s.*")


@query(f"select row_id, case when len(string_split(source_record_id, ':')) >= 5 then string_split(source_record_id, ':')[2] end as part, case when len(string_split(source_record_id, ':')) >= 5 then string_split(source_record_id, ':')[3] end as id from {CONTEXT}")
def record_parts(spark, sf):
    return context(spark, sf).select("row_id", C.source_parts(F.col("source_record_id")).alias("p")).select("row_id", F.col("p.partition").alias("part"), "p.id")


@query(f"select row_id, 'draft:' || substr(sha256({FOLD.format('text')}), 1, 20) as family from {CONTEXT} where text is not null")
def draft_families(spark, sf):
    return context(spark, sf).where("text is not null").select("row_id", C.family_of(F.col("text"), "draft:").alias("family"))


@query()
def content_ids(spark, sf):
    rows = context(spark, sf).drop("example_id").select("row_id", "text", "suggestion", "category", "source_dataset", "target_changed")
    return C.training_rows(rows, ["text", "suggestion", "category", "source_dataset", "target_changed"]).select("row_id", "example_id")


@query()
def model_inputs(spark, sf):
    return table(spark, sf, "context").select("row_id", C.model_input(F.col("input.text"), C.bounded_context(F.col("input.context_snippets"))).alias("model_input"))


@query(f"""with recursive f as (select family_id, count(*)::double as n, row_number() over (order by sha256('fill:' || family_id), family_id) as i from {CONTEXT} where family_id is not null group by family_id),
  w(i, family_id, split, a, b, c) as (
    select 0, null::varchar, null::varchar, 0.0::double, 0.0::double, 0.0::double
    union all select f.i, f.family_id, case when a / 0.8::double <= b / 0.1::double and a / 0.8::double <= c / 0.1::double then 'train' when b / 0.1::double <= c / 0.1::double then 'eval' else 'test' end,
      a + case when a / 0.8::double <= b / 0.1::double and a / 0.8::double <= c / 0.1::double then f.n else 0 end, b + case when not (a / 0.8::double <= b / 0.1::double and a / 0.8::double <= c / 0.1::double) and b / 0.1::double <= c / 0.1::double then f.n else 0 end,
      c + case when not (a / 0.8::double <= b / 0.1::double and a / 0.8::double <= c / 0.1::double) and not (b / 0.1::double <= c / 0.1::double) then f.n else 0 end from w join f on f.i = w.i + 1)
  select family_id, split from w where i > 0""")
def filled_splits(spark, sf):
    f = context(spark, sf).where("family_id is not null").groupBy("family_id").agg(F.count(F.lit(1)).alias("n"))
    return C.fill_splits(f, "family_id", "n", {"train": 0.8, "eval": 0.1, "test": 0.1}, "fill")


@query("""with u as (select id, row_number() over (order by id) - 1 as i, count(*) over () as n from utterances where id is not null)
  select id from u where (((i - (1454956953079340599)) % n) + n) % n < 16""")
def rotating_references(spark, sf):
    return C.rotating(table(spark, sf, "utterances").where("id is not null"), "id", "round-1").select("id")


# ---- events and streams --------------------------------------------------------------------------------------------


@query(f"""with e as (select profile_id, burst_id, make_timestamp(ts_ms * 1000) as ts from {BURSTS} where profile_id is not null), n as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by profile_id order by ts, burst_id)) > 1800000000 then 1 else 0 end as new from e),
  s as (select *, sum(new) over (partition by profile_id order by ts, burst_id) as session from n) select profile_id, cast(session as bigint) as session, count(*) as n, min(ts) as started, max(ts) as ended from s group by all""")
def session_gap_bursts(spark, sf):
    b = bursts(spark, sf).where("profile_id is not null").select("profile_id", "burst_id", F.timestamp_millis("ts_ms").alias("ts"))
    s = WN.session_gaps(b, "profile_id", "ts", "burst_id", 1800)
    return s.select("profile_id", "session", "n", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")])


@query(f"""with f as (select profile_id, burst_id, ts_ms, draft from {BURSTS} where profile_id is not null and trim(draft) <> '' qualify row_number() over (partition by profile_id, draft order by ts_ms, burst_id) = 1),
  s as (select *, sum(length(draft)) over (partition by profile_id order by ts_ms, burst_id rows unbounded preceding) as total from f) select profile_id, burst_id from s where total <= 240""")
def context_budget(spark, sf):
    b = bursts(spark, sf).where("profile_id is not null").select("profile_id", "burst_id", "ts_ms", "draft")
    return WN.within_budget(b, ["profile_id"], ["ts_ms", "burst_id"], "draft", 240).select("profile_id", "burst_id")


@query()
def edit_session_replay(spark, sf):
    b = bursts(spark, sf).where("profile_id is not null")
    own = F.xxhash64("burst_id")
    offers = b.select(F.concat_ws("/", "profile_id", "draft").alias("session_id"), F.col("ts_ms").alias("seq"), F.lit("offer").alias("kind"), "draft", F.col("committed").alias("candidate"), (F.pmod(own, F.lit(5)) + 1).cast("int").alias("votes"), (F.pmod(own, F.lit(7)) == 0).alias("unanimous"))
    return sessions.replay(offers)


@query()
def typing_distances(spark, sf):
    pairs = _mined(spark, sf).select("shorthand", F.lower("expansion").alias("expansion")).distinct()
    s, e = F.col("shorthand"), F.col("expansion")
    return pairs.select("shorthand", "expansion", F.levenshtein(s, e).alias("edits"), D.typing_distance_of(s, e).alias("typing"), D.ratio_of(s, e).alias("ratio"))


def _all() -> None:
    """The other modules of queries register theirs when they are imported."""
    from inkfold.plans import builds, capture, checks  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
