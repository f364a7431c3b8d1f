import collections

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.operators import augment as A
from inkfold.operators import dedupe as DD
from inkfold.operators import lexical as L
from inkfold.operators import patterns as P
from inkfold.operators import quality as Q
from inkfold.operators import rules as R
from inkfold.operators import sampling as S
from inkfold.operators import score as SC
from inkfold.operators import windows as WN
from inkfold.sources import jsonl
from inkfold.streaming import sessions


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_reject_reasons_in_order(spark):
    rows = ["", None, "a\nb", "12 !", "mail me at a@b.co", "see www.x.y", "call +49 30 23125 144", "é1234567 x", "@me hi", "a <b>x</b>", "class of 9", "all good here"]
    got = [r.r for r in frame(spark, [(x,) for x in rows], "t string").select(R.source_reason(F.col("t")).alias("r")).collect()]
    assert got == ["empty", "empty", "multiline", "not_text", "email", "url", "phone", None, "handle", "markup", "code", None]


def test_strict_suggestions(spark):
    rows = ['{"suggestion": "ok"}', '{"suggestion": "ok", "x": 1}', '{"suggestion": 5}', "plain", '{"suggestion": " "}', None, "[]"]
    got = [r.s for r in frame(spark, [(x,) for x in rows], "t string").select(R.suggestion_of(F.col("t")).alias("s")).collect()]
    assert got == ["ok", None, None, None, None, None, None]


def test_vocabulary_and_profanity(spark):
    rows = frame(spark, [(1, "their dog"), (2, "zzz dog"), (3, "12"), (4, None)], "i int, t string")
    lex = frame(spark, [("their", 5.0), ("dog", 4.0), ("zzz", 1.0)], "word string, zipf double")
    assert {r.i: r.reason for r in R.vocabulary_reason(rows, "t", lex).collect()} == {1: None, 2: "rare_or_misspelled_token", 3: "no_english_tokens", 4: None}
    bad = frame(spark, [("Dog",)], "word string")
    assert {r.i: r.profane for r in R.profane(rows, "t", bad).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_vote_rank_goldens(spark):
    sug = lambda s: f'{{"suggestion": "{s}"}}'
    rows = frame(spark, [("e", "draft", [sug(x) for x in ("draft", "fixed", "alt", "fixed", "alt")])], "id string, draft string, responses array<string>")
    r = SC.vote_rank(SC.completions(rows, ["id", "draft"]), ["id", "draft"], "draft").orderBy("rank").collect()
    assert [(x.suggestion, x.votes) for x in r] == [("fixed", 2), ("alt", 2)]
    rows = frame(spark, [("e", [sug(x) for x in "babca"])], "id string, responses array<string>")
    assert [(x.suggestion, x.votes) for x in SC.vote_rank(SC.completions(rows, ["id"]), ["id"]).orderBy("rank").collect()] == [("b", 2), ("a", 2), ("c", 1)]


def _evaluate(spark, responses, changed=True, accepted="fixed", draft="fxed"):
    gold = frame(spark, [("m", "e", draft, [accepted], changed, "c")], "label string, example_id string, draft string, accepted array<string>, changed boolean, category string")
    preds = frame(spark, [("m", "e", 1, ["old"]), ("m", "e", 2, responses), ("m", None, 3, responses)], "label string, example_id string, prediction_seq long, responses array<string>")
    return SC.evaluation(gold, preds).where("total = 1").collect()[0]


def test_evaluation_goldens(spark):
    sug = lambda s: f'{{"suggestion": "{s}"}}'
    perfect = _evaluate(spark, [sug("fixed")] * 5)
    assert perfect.success_rate == perfect.schema_rate == perfect.completion_rate == 1.0
    split = _evaluate(spark, [sug("wrong")] * 3 + [sug("fixed")] * 2)
    assert split.success_rate == 0 and split.any_of_five == 1.0
    keep = _evaluate(spark, [sug("same")] * 4 + [sug("other")], changed=False, accepted="same", draft="same")
    assert keep.success_rate == 0 and keep.unneeded_edits == 1
    assert _evaluate(spark, None).incomplete_batches == 1


def test_scores(spark):
    r = spark.range(1).select(SC.verdict(F.lit(4), F.lit(4), F.lit(4), F.lit(4), F.lit(True)).alias("a"), SC.verdict(F.lit(4), F.lit(4), F.lit(4), F.lit(4), F.lit(False)).alias("b"), SC.reward(F.lit(False), F.lit(True), F.lit(False), F.lit(1.0)).alias("c")).collect()[0]
    assert (round(r.a, 9), r.b, r.c) == (1.0, 0.49, 0.15)


def test_percentiles(spark):
    r = frame(spark, [([5.0, 1.0, 3.0],), ([],), (None,)], "v array<double>").select(SC.percentile_index(F.col("v"), 0.95).alias("p")).collect()
    assert [x.p for x in r] == [5.0, None, None]


def test_water_fill_and_remainders(spark):
    g = frame(spark, [("scarce", 2), ("common", 10)], "k string, c long")
    assert {r.k: r.allocated for r in S.water_fill(g, "k", "c", 8).collect()} == {"scarce": 2, "common": 6}
    assert {r.k: r.allocated for r in S.water_fill(g, "k", "c", 50).collect()} == {"scarce": 2, "common": 10}
    assert {r.k: r.allocated for r in S.largest_remainder(g, "k", "c", 7).collect()} == {"scarce": 1, "common": 6}


def test_water_fill_against_dealing(spark):
    import random

    rng = random.Random(3)
    for _ in range(6):
        caps = {f"g{i}": rng.randint(0, 6) for i in range(rng.randint(1, 7))}
        total, want, left = rng.randint(0, 25), collections.Counter(), None
        left = total
        while left and any(want[k] < c for k, c in caps.items()):
            for k in sorted(caps):
                if left and want[k] < caps[k]:
                    want[k] += 1
                    left -= 1
        got = {r.k: r.allocated for r in S.water_fill(frame(spark, list(caps.items()), "k string, c long"), "k", "c", total).collect()}
        assert got == {k: want[k] for k in caps}, (caps, total)


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    quotas = frame(spark, [(0, 10), (1, 5)], "g long, quota int")
    a = S.stratified(rows.repartition(1), "id", ["g"], quotas, "s").collect()
    b = S.stratified(rows.repartition(7), "id", ["g"], quotas, "s").collect()
    assert sorted(a) == sorted(b) and len(a) == 15


def test_isolated_splits(spark):
    rows = frame(spark, [(f"f{i % 40}", f"d{i % 50}", f"t{i % 45}") for i in range(200)], "family string, draft string, target string")
    r = S.select_splits(rows, {"test": 5, "train": 20}, ["draft", "target"], "family", "s").collect()
    by = {s: [x for x in r if x.split == s] for s in ("test", "train")}
    for c in ("family", "draft", "target"):
        assert not {x[c] for x in by["test"]} & {x[c] for x in by["train"]}
        assert len({x[c] for x in by["train"]}) == len(by["train"])


def test_windows(spark):
    t = F.col("t")
    r = frame(spark, [("please call me back today call me",), ("",), (None,), ("a b c d unfin",)], "t string").select(WN.chunks(t, 5).alias("c"), WN.finished_chunks(t, 5).alias("f"), WN.trailing(t, 2).alias("l")).collect()
    assert r[0].c == ["please call me back today", "call me"] and r[0].f == ["please call me back today"] and r[0].l == "call me"
    assert r[1].c == [] and r[3].f == []


def test_lexical_goldens(spark):
    vocab = frame(spark, [(w, 4.0) for w in "brown going quick their there tomorrow".split()], "word string, zipf double")
    rows = frame(spark, [(1, "hteir tommorow"), (2, "their q3_finl_v2.pdf /usr/bin a.brwn"), (3, None)], "i int, t string")
    tokens = L.lookup_tokens(rows, "i", "t")
    hints = {(r.token, r.word) for r in L.hints(L.edit_candidates(tokens, vocab)).where("rank = 1").collect()}
    assert ("hteir", "their") in hints and ("tommorow", "tomorrow") in hints
    assert not {t for t, _ in hints} & {"finl", "usr", "bin", "brwn"}


def test_edit_candidates_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    ts, vs = sorted({word() for _ in range(60)}), sorted({w for w in (word() for _ in range(60)) if len(w) >= 3})
    t, v = frame(spark, [(x,) for x in ts], "token string"), frame(spark, [(x, 1.0) for x in vs], "word string, zipf double")
    got = {(r.token, r.word) for r in L.edit_candidates(t, v).collect()}
    d = F.levenshtein("token", "word")
    want = {(r.token, r.word) for r in t.join(v, F.lit(True)).where((F.col("token") != F.col("word")) & (d <= L.reach(F.col("token")))).collect()}
    assert got == want


def test_dedupe_keeps_first(spark):
    rows = frame(spark, [(1, "A b", "a b"), (2, "A b", "a b"), (3, "a  B", "a b"), (4, "c", "c")], "i int, e string, n string")
    assert {r.i: r.reason for r in DD.ordered(rows, "i", "e", "n").collect()} == {1: None, 2: "exact_duplicate", 3: "normalized_duplicate", 4: None}


def test_kept_is_greedy_not_components(spark):
    ids = frame(spark, [(i,) for i in range(1, 6)], "id long")
    links = frame(spark, [(1, 2), (2, 3), (3, 4)], "earlier long, later long")
    assert sorted(r.id for r in DD.kept(ids, links).collect()) == [1, 3, 5]
    assert DD.kept(ids.limit(0), links).count() == 0


def test_near_links(spark):
    base = "please move the printed invoice from the north lobby to the archive before lunch on the second day of the week"
    rows = [("a", "g1", base), ("b", "g2", base.replace("lunch", "noon")), ("c", "g1", base.replace("second", "third")), ("d", None, "something else entirely"), ("e", None, "")]
    links = {(r.earlier, r.later) for r in DD.near_links(DD.shapes(frame(spark, rows, "id string, g string, t string"), "id", "t", "g"), 0.9).collect()}
    assert ("a", "c") not in links and all(x < y for x, y in links)


def test_whole_candidates_are_compared(spark):
    draft, long = "please move the printed invoice from the north lobby to the archive", "the other screen speaks about a wholly different thing and holds many words of its own that nobody else has written so far"
    snip = lambda t: [("Mail", "Inbox", t)]
    rows = [("a", "g1", draft, "s one", snip("short")), ("b", "g2", draft, "s one", snip(long)), ("c", "g1", draft, "S  one", snip("short")), ("d", "g1", draft, "s 1", snip("short")), ("e", "g1", draft, "s 2", snip("short")), ("f", "g3", draft, "s one", None), ("g", "g4", draft, "s 3", snip("short"))]
    df = frame(spark, rows, f"id string, group string, t string, s string, c {DD.SNIPPETS}")
    t, s, c = F.col("t"), F.col("s"), F.col("c")
    r = df.select("id", "group", DD.normal_key(t, s, c).alias("normal"), DD.T.shape(DD.whole(t, s, c)).alias("shape"))
    # b has another context; c is a normalised copy of a; d and e are near a but of its group; g is near a of another group
    got = {x.id for x in DD.kept_rows(r).collect()}
    assert {"a", "b", "d", "e"} <= got and not {"c", "g"} & got


def test_noise_is_reproducible(spark):
    a = A.noisy("Meet me by the station.", 5, 9402)
    assert a == A.noisy("Meet me by the station.", 5, 9402) and len(a[1]) == 5
    assert A.noisy("a", 3, 1, {"transposition": 1}) == ("a", [])
    rows = frame(spark, [(i, "please archive the invoice", i % 4) for i in range(40)] + [(99, None, 1)], "id long, t string, n int")
    one = sorted(A.augment(rows.repartition(1), "id", "t", "n", "s").select("id", "draft").collect())
    assert one == sorted(A.augment(rows.repartition(8), "id", "t", "n", "s").select("id", "draft").collect()) and len(one) == 40
    near = dict(A.neighbours()["f"])
    assert near["d"] > near["r"] and {"t", "g"} <= set(near)


def test_pattern_trust(spark):
    def trust(*expansions):
        rows = [("p", i, "b", 0, "brb", e) for i, e in enumerate(expansions)]
        t = P.trailing_runs(frame(spark, rows, "profile_id string, ts_ms long, burst_id string, pos int, shorthand string, expansion string"), "profile_id", ["ts_ms", "burst_id"])
        return [r.expansion for r in P.for_request(t, "profile_id").collect()]

    assert trust("be right back") == [] and trust("x", "x") == ["x"] and trust("x", "x", "y") == []


def test_overlaps_and_conflicts(spark):
    rows = frame(spark, [("o", "to", "train"), ("o", "i", "eval"), (None, "x", "eval")], "k string, v string, s string")
    assert [tuple(r) for r in Q.overlaps(rows, F.col("k"), F.col("s")).collect()] == [("eval", "train", 1)]
    assert [tuple(r) for r in Q.conflicts(rows, F.col("k"), F.col("v"), F.col("s")).collect()] == [("o", 2, "eval,train")]


def test_frontier_keeps_ties(spark):
    pts = frame(spark, [("a", 5, 1), ("b", 5, 1), ("c", 9, 3), ("d", 4, 2), ("e", None, 1)], "k string, g int, c int")
    assert sorted(r.k for r in SC.frontier(pts, "k", "g", "c").collect()) == ["a", "b", "c"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": "z", "b": "x"}\n[1]\n{"a": 1, "b": "x", "c": 2}\n{"b": "y"}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType(), False)])
    good, bad = jsonl.read_checked(spark, str(p), schema)
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert sorted(r.reason for r in bad.collect()) == ["keys", "keys", "not_an_object", "types"]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    assert [r.line_no for r in jsonl.read_numbered(spark, str(p)).collect()] == [1, 3, 4, 5, 6]
    jsonl.write_jsonl(good, str(tmp_path / "out"), ["a"], 1)
    assert jsonl.read_jsonl(spark, str(tmp_path / "out"), schema).collect() == good.collect()
    jsonl.write_document(good, str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{"a":1,"b":"x"}\n'
    (tmp_path / "m.json").write_text('{"schema_version": 1}')
    with pytest.raises(ValueError):
        jsonl.read_manifest(spark, str(tmp_path / "m.json"), "schema_version int", 2)


OFFERS = [
    ("s1", 1, "offer", "teh cat sat on", "the cat sat on", 1, False),
    ("s1", 2, "offer", "teh cat sat on it", "the cat sat on it", 1, False),
    ("s1", 3, "offer", "teh cat sat on it now", "the cat sat on it now", 1, False),
    ("s2", 1, "offer", "teh cat sat", "the cat sat", 5, True),
    ("s3", 1, "offer", "teh cat sat", "the cat sat", 1, False),
    ("s3", 2, "offer", "teh cat sat", "ten cat sat", 1, False),
    ("s3", 3, "offer", "teh cat sat", "teh cat sat", 1, False),
    ("s4", 1, "offer", None, None, None, None),
]


def test_edits_harden(spark):
    got = {(r.session_id, r.seq, r.start, r.end, r.replacement) for r in sessions.replay(frame(spark, OFFERS, sessions.EVENT)).collect()}
    assert got == {("s1", 3, 0, 1, "the"), ("s2", 1, 0, 1, "the")}


def test_stream_equals_replay(spark, tmp_path):
    events = frame(spark, OFFERS, sessions.EVENT)
    for seq in (1, 2, 3):
        events.where(f"seq = {seq}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = sessions.edit_stream(spark.readStream.schema(sessions.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, sessions.replay(events).collect()))


def test_commit_shifts_places():
    s = sessions.EditSession()
    s.offer("a bb cc dd ee", "a bb cc xx ee", 1, False)
    s.commit(0, 1, "one two")
    assert list(s.slots) == [4]
