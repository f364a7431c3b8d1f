"""Queries of what is read around a writer and of what becomes of offers, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators import capture as CP
from inkfold.plans.queries import BURSTS, bursts, query
from inkfold.session import table
from inkfold.streaming import desk

_SPACE = "[\\s\\v\\x1c-\\x1f\u0085   -     　]+"
_ROLE = "case ord % 4 when 0 then 'static_text' when 1 then 'heading' when 2 then 'button' else 'link' end"


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents where text is not null),
  e as (select doc_id, ord % 3 as depth, ord, {_ROLE} as role, trim(regexp_replace(t, '{_SPACE}', ' ', 'g')) as t from l),
  f as (select * from (select *, row_number() over (partition by doc_id order by depth, ord) as n from e) where n <= 512 and role <> 'button' and t <> ''),
  o as (select doc_id, t, min((depth, ord)) as o from f group by doc_id, t),
  b as (select doc_id, t, o, 240 - coalesce(sum(length(t) + 1) over (partition by doc_id order by o rows between unbounded preceding and 1 preceding), 0) as room from o)
  select doc_id, string_agg(substr(t, 1, room::int), chr(10) order by o) as context from b where room > 0 group by doc_id""")
def screen_texts(spark, sf):
    """Lines of documents as elements of a screen, three deep, a quarter of them buttons."""
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    role = F.element_at(F.array(*map(F.lit, ("static_text", "heading", "button", "link"))), F.col("ord") % 4 + 1)
    e = lines.select("doc_id", (F.col("ord") % 3).alias("depth"), "ord", role.alias("role"), F.lit(False).alias("editable"), "text", F.array().cast("array<int>").alias("path"))
    return CP.screen_text(e, ["doc_id"], 240)


@query(f"""with g as (select profile_id, burst_id, ts_ms, ts_ms - lag(ts_ms) over w as gap from {BURSTS} where profile_id is not null window w as (partition by profile_id order by ts_ms, burst_id)),
  l as (select *, list_sort(list_filter(list(gap) over (partition by profile_id order by ts_ms, burst_id rows between 11 preceding and current row), lambda x: x is not null)) as s from g)
  select profile_id, burst_id, least(700.0, greatest(180.0, 2.2 * coalesce(s[len(s) // 2 + 1]::double, 250.0)))::double as pause_ms from l""")
def typing_rhythm(spark, sf):
    b = bursts(spark, sf).where("profile_id is not null").select("profile_id", "burst_id", "ts_ms")
    return CP.rhythm(b, ["profile_id"], "ts_ms", ["burst_id"]).select("profile_id", "burst_id", "pause_ms")


@query(f"""select burst_id, case when regexp_matches(draft, '[.!?]$') then 0.0 when regexp_matches(draft, '\\S\\s$') then 0.0 else 500.0 end::double as word, case when regexp_matches(draft, '[.!?]$') then 0.0 else 600.0 end::double as pause,
  case when regexp_matches(draft, '[.!?]$') then 0.0 end::double as sentence from {BURSTS} where draft is not null""")
def send_times(spark, sf):
    d = F.col("draft")
    return bursts(spark, sf).where("draft is not null").select("burst_id", CP.cadence(d, "word").alias("word"), CP.cadence(d, "chunk_pause").alias("pause"), CP.cadence(d, "sentence").alias("sentence"))


@query(f"""select burst_id, right(draft, 80) as captured from (select *, lead(ts_ms) over (partition by profile_id order by ts_ms, burst_id) as next from {BURSTS} where profile_id is not null and draft is not null) where next is null or next - ts_ms >= 60000""")
def idle_captures(spark, sf):
    b = bursts(spark, sf).where("profile_id is not null and draft is not null").select("profile_id", "burst_id", "ts_ms", "draft")
    return CP.idle(b, ["profile_id"], "ts_ms", "burst_id", "draft", delay_ms=60_000).select("burst_id", "captured")


@query(f"select burst_id, case when ts_ms % 3 = 1 and len(context_snippets) > 1 then context_snippets[2].visible_text else context_snippets[1].visible_text end as visible_text from {BURSTS}")
def reviewed_snippets(spark, sf):
    b = bursts(spark, sf).withColumn("line", F.when((F.col("ts_ms") % 3 == 1) & (F.size("context_snippets") > 1), 7).otherwise(1))
    return CP.reviewed(b, "line", {7: 1}, "context_snippets").select("burst_id", F.col("snippet.visible_text").alias("visible_text"))


@query()
def desk_outcomes(spark, sf):
    """Bursts as requests, answers and decisions of their profiles' sessions: dismissed ones are dismissed, others taken."""
    b = bursts(spark, sf).where("profile_id is not null and draft is not null")
    session, n = F.concat_ws("/", "profile_id", F.floor(F.col("ts_ms") / 3_600_000)), F.lit(None).cast("int")
    base = dict(burst="burst_id", draft="draft")
    offered = F.when(F.col("committed").isNotNull(), F.array("committed")).otherwise(F.array(F.concat("draft", F.lit("."))))
    steps = F.array(
        *[
            F.struct((F.col("ts_ms") * 3 + i).alias("seq"), kind.alias("kind"), cand.alias("candidates"))
            for i, (kind, cand) in enumerate(((F.lit("request"), F.lit(None).cast("array<string>")), (F.lit("result"), offered), (F.when(F.col("label") == "keep", "dismiss").otherwise("select"), F.lit(None).cast("array<string>"))))
        ]
    )
    e = b.select(session.alias("session_id"), F.col(base["burst"]).alias("burst_id"), "draft", F.explode(steps).alias("s"))
    e = e.select("session_id", "s.seq", "s.kind", "burst_id", "draft", "s.candidates", F.lit(None).cast("array<int>").alias("votes"), n.alias("at_word"), n.alias("choice"), F.lit(False).alias("quiet"))
    return desk.outcomes(e).groupBy("outcome", "label", "source").agg(F.count(F.lit(1)).alias("n"))
