"""Checks, builds, reports, capture, offers and request sources: rules, edges, and the same result in any layout."""

from collections import Counter
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.operators import builds as B
from inkfold.operators import capture as CP
from inkfold.operators import reports as RP
from inkfold.operators import validation as V
from inkfold.sources import requests as RQ
from inkfold.streaming import desk, sessions


def test_input_reasons(spark):
    snippet = '{"app_name":"a","window_title":"b","visible_text":"c"}'
    rows = [
        ('{"text":"x"}', None), ('{"text":"x","context_snippets":[]}', None), ('{"text":"x","context_snippets":null}', None),
        (f'{{"text":"x","context_snippets":[{snippet}]}}', None), (f'{{"text":"x","context_snippets":[{snippet},{snippet}]}}', "snippet_count"),
        ('{"text":"x","context_snippets":[{"app_name":"a"}]}', "snippet_fields"), (f'{{"text":"x","context_snippets":[{snippet.replace(chr(34) + "c" + chr(34), chr(34) * 2)}]}}', "snippet_fields"),
        ('{"text":5}', "text"), ("[]", "text"), ("plain", "text"), (None, "text"), ('{"text":"x","more":1}', "unknown_field"),
        ('{"text":"x","lexical_hints":[{"token":"a","candidates":["b"]}]}', None), ('{"text":"x","lexical_hints":[{"token":"a","candidates":[]}]}', "hint_fields"), ('{"text":"x","lexical_hints":{}}', "hint_fields"),
    ]
    got = spark.createDataFrame(rows, "p string, want string").select("p", "want", V.input_reason(F.col("p")).alias("got")).collect()
    assert [(r.p, r.got) for r in got] == [(r.p, r.want) for r in got]


def test_ambiguity(spark):
    rows = spark.createDataFrame([(1, "their dog"), (2, "zzz dog"), (3, "two 2"), (4, None), (5, ""), (6, "Their DOG!"), (6, "Their DOG!")], "i int, t string")
    lexicon = spark.createDataFrame([("their", 5.0), ("dog", 4.0), ("zzz", 1.0)], "word string, zipf double")
    got = Counter((r.i, r.reason is not None) for r in V.ambiguity_reason(rows, "t", lexicon).collect())
    assert got == Counter({(1, True): 1, (2, False): 1, (3, False): 1, (4, False): 1, (5, False): 1, (6, True): 2})
    only = spark.createDataFrame([("their",)], "word string")
    assert {r.reason for r in V.ambiguity_reason(rows, "t", lexicon, vocabulary=only).collect()} == {None}


def test_dropped_suggestions(spark):
    rows = [("a b c", "a b c", "unchanged"), ("a b c", "a b", "shortened"), ("a b", "a", None), ("a b c", "a b d", None), ("a b", "Suggestion: x", "echo"), ("a b", "{x", "echo"), ("a", "I am Pen, hello", "echo"), ("a", "Keep the writer's words please", "echo"), ("a", "text", "echo"), ("a", "texture", None), (None, "x", None)]
    d = spark.createDataFrame(rows, "d string, s string, want string")
    got = d.select("want", V.drop_reason(F.col("d"), F.col("s"), "- Keep the writer's words\nshort", ("Pen",)).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_contrast_groups(spark):
    def group(g, **changes):
        rows = {v: [g, v, "draft", "same", []] for v in V.VARIANTS}
        rows["context_a"][3], rows["context_b"][3], rows["conflicting"][2] = "one", "two", "other"
        for v, (i, x) in changes.items():
            rows[v][i] = x
        return list(rows.values())

    rows = group("good") + group("draft", irrelevant=(2, "x")) + group("useful", context_b=(3, "one")) + group("control", ambiguous=(3, "x")) + group("context", no_context=(4, ["c"])) + group("few")[:5] + [[None, "context_a", "d", "s", []]]
    c = spark.createDataFrame(rows, "g string, v string, d string, s string, c array<string>")
    got = {r.g: r.reasons for r in V.group_reasons(c, "g", "v", F.col("d"), F.col("s"), F.col("c")).collect()}
    assert got == {"draft": ["contrast_group_base_draft_mismatch"], "useful": ["contrast_useful_targets_not_distinct"], "control": ["contrast_restraint_targets_mismatch"], "context": ["contrast_no_context_has_context"], "few": ["contrast_group_incomplete_or_duplicate"]}
    assert V.group_reasons(c.limit(0), "g", "v", F.col("d"), F.col("s"), F.col("c")).count() == 0


def test_status_and_faults(spark):
    c = spark.createDataFrame([("a", "g"), ("a", "g"), ("b", None), ("c", "g2"), ("d", "g")], "k string, g string")
    why = lambda rows, key: spark.createDataFrame(rows, f"{key} string, reasons array<string>")
    got = {(r.k, r.status, tuple(r.reasons)) for r in V.status(c, "k", "g", why([("b", ["x"])], "k"), why([("a", []), ("c", ["low"])], "k"), why([("g2", ["y"])], "g")).collect()}
    assert got == {("a", "accepted", ()), ("b", "rejected_local", ("x",)), ("c", "rejected_group", ("y", "low")), ("d", "pending", ())}
    r = spark.createDataFrame([("train", "1", "t"), ("train", "1", "t"), ("eval", "1", "u"), ("eval", None, None)], "s string, k string, t string")
    got = {tuple(x) for x in V.split_faults(r, "s", "k", F.col("t"), F.when(F.col("t").isNull(), "empty")).collect()}
    assert got == {("eval", "empty", 1), ("train", "duplicate_input", 1), ("train", "duplicate_id", 1), ("train", "shared_id", 1), ("eval", "shared_id", 1)}


def test_policies():
    assert sum(n for s, _, n, _ in B.quotas(B.RUNTIME_V2) if s == "train") == 5000 and sum(k for *_, k in B.quotas(B.WINDOW_V1)) == 240
    assert B.pool(B.WINDOW_V1, 1, 400) == 480 and B.pool(B.DRAFT_V2, 1, 40) == 70 and B.pool(B.DRAFT_V2, 3, 40) == 60
    with pytest.raises(ValueError, match="no whole number"):
        B.quotas(B.Policy("x", (1,), {"train": (5,)}))
    with pytest.raises(ValueError, match="1 counts"):
        B.quotas(B.Policy("x", (1, 2), {"train": (10,)}))


def test_balanced_windows(spark):
    text = lambda i: " ".join(f"w{chr(97 + (i * 7 + j) % 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for j in range(1 + i % 7))
    rows = [(i, text(i)) for i in range(300)] + [(900, None), (901, ""), (902, "mail a@b.co now please friends")]
    u = spark.createDataFrame(rows, "id int, utt string")
    want = {1: 20, 2: 20, 3: 20, 4: 20, 5: 20}
    w = B.balanced_windows(u, "id", "utt", want, "s")
    got = w.collect()
    assert Counter(r.size for r in got) == Counter(want) and len({r.id for r in got}) == 100
    texts = dict(rows)
    assert all(texts[r.id].split()[r.start : r.start + r.size] == r.text.split() for r in got)
    assert sorted(got) == sorted(B.balanced_windows(u.repartition(7), "id", "utt", want, "s").collect())
    assert B.shortages(w, {**want, 5: 30}).collect()[0].asDict() == {"size": 5, "required": 30, "found": 20}
    chunks = B.balanced_windows(u, "id", "utt", want, "s", chunk=5).collect()
    assert all(r.start % 5 == 0 and r.size == min(5, len(texts[r.id].split()) - r.start) for r in chunks) and chunks
    assert B.balanced_windows(u.limit(0), "id", "utt", want, "s").count() == 0


def test_slots():
    behaviours = {"useful": 0.45, "irrelevant": 0.175, "ambiguous": 0.125, "conflicting": 0.125, "none": 0.125}
    categories = {"a": 0.5, "b": 0.45, "already_correct": 0.05}
    s = B.slots(200, behaviours, categories, ["a", "b"], 0.48, "s")
    assert s == B.slots(200, behaviours, categories, ["a", "b"], 0.48, "s") != B.slots(200, behaviours, categories, ["a", "b"], 0.48, "s", 2)
    assert Counter(x["category"] for x in s) == {"a": 100, "b": 90, "already_correct": 10} and len({x["slot_id"] for x in s}) == 200
    assert Counter(x["context_behavior"] for x in s) == {"useful": 90, "irrelevant": 35, "ambiguous": 25, "conflicting": 25, "none": 25}
    groups = {}
    for i, x in enumerate(s):
        if x["group_id"]:
            groups.setdefault(x["group_id"], []).append((i, x["variant"], x["category"]))
    assert len(groups) == 16 and all([v for _, v, _ in g] == [v for v, _ in B.VARIANTS] and len({c for *_, c in g}) == 1 and g[-1][0] - g[0][0] == 5 for g in groups.values())
    assert all(x["context_behavior"] == "irrelevant" for x in s if x["category"] == "already_correct")
    with pytest.raises(ValueError, match="already_correct"):
        B.slots(100, {"useful": 1.0}, {"already_correct": 1.0}, [], 0.0, "s")


def test_classified(spark):
    rows = [(1, "d", "s1", False), (2, "d", "s", False), (3, "d", "s", True), (4, "d", "t", True), (5, "e", "e", True), (6, "e", "f", True), (7, None, "x", True)]
    r = B.classified(spark.createDataFrame(rows, "i int, d string, s string, c boolean"), F.col("d"), F.col("s"), F.col("c"), "i")
    assert {x.i: x.basis for x in r.collect()} == {1: "not_retained", 2: "not_retained", 3: "synthetic_distractor", 4: "necessary_for_label", 5: "necessary_for_label", 6: "necessary_for_label", 7: "necessary_for_label"}
    assert {x.i: x.kind for x in r.collect()}[5] == "context_preservation"


def test_hint_coverage(spark):
    kind = "changed boolean, accepted array<string>, hints array<struct<token string, candidates array<string>>>"
    rows = [(True, ["The Dog."], [("dgo", ["dig", "dog"])]), (True, ["a cat"], [("x", ["y"])]), (True, None, None), (False, ["b"], [("b", ["b"]), ("c", ["d"])]), (None, None, [])]
    got = RP.hint_coverage(spark.createDataFrame(rows, kind), "changed", "accepted", "hints").first()
    assert tuple(got) == (5, 3, 3, 2, 0.6667, 0.3333, 1.333)
    assert RP.hint_coverage(spark.createDataFrame([], kind), "changed", "accepted", "hints").first()["changed_hint_coverage"] == 0.0


def test_token_details(spark):
    c = spark.createDataFrame([(1, '{"suggestion":"ab"}', "ab", 10, 19, 190.0, 150.0), (2, "", None, 0, 0, 5.0, None)], "i int, content string, s string, p long, t long, ms double, model double")
    a, b = RP.token_details(c, ["i"], "content", F.col("s"), "p", "t", "ms", F.lit(19), reported_ms=F.col("model"), decode_ms=F.lit(95.0)).orderBy("i").collect()
    assert (a.output_chars, a.suggestion_chars, a.schema_chars, a.queue_ms, a.limit_reached, a.tokens) == (19, 2, 17, 40.0, True, 29)
    assert abs(a.schema_ms - 5.0 * 17) < 1e-9 and (b.output_chars, b.server_ms_per_token, b.limit_reached) == (0, 0.0, False) and b.schema_tokens == 0.0


def test_counters_and_summary(spark):
    r = spark.createDataFrame([(1, True, 10.0), (2, False, None), (3, True, 20.0), (4, None, 7.0)], "n int, ok boolean, ms double")
    assert tuple(RP.counters(r, ["n"], F.col("ok"), F.col("ms").isNotNull(), "ms").first()) == (4, 2, 2, 1, 20.0, 15.0)
    c = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("c", "y")], "k string, cat string")
    st = spark.createDataFrame([("a", "accepted", []), ("b", "rejected_local", ["r", "r2"])], "k string, status string, reasons array<string>")
    table, why = RP.run_summary(c, "k", "cat", ["x", "y", "z"], st)
    assert {tuple(x) for x in table.collect()} == {("x", 2, 1, 0.5), ("y", 1, 0, 0.0), ("z", 0, 0, 0.0)} and {tuple(x) for x in why.collect()} == {("r", 1), ("r2", 1)}


def test_folds_and_rounding(spark):
    d = spark.createDataFrame([("Ｓtraße   X!",), (None,), ("",)], "t string")
    got = [tuple(r) for r in d.select(T.folded_exact(F.col("t")), T.folded_after(F.col("t")), T.folded_case(F.col("t"))).collect()]
    assert got == [("strasse x!", "strasse x!", "ｓtrasse x!"), (None, None, None), ("", "", "")]
    n = spark.createDataFrame([(2.675,), (0.00005,), (2.5,), (None,)], "v double")
    assert [r[0] for r in n.select(T.round_exact(F.col("v"), 2)).collect()] == [2.67, 0.0, 2.5, None]


def test_html_escapes(spark):
    page = RP.html(spark.createDataFrame([("<a>", 0.5), (None, None)], "x string, y double"), "A & B")
    assert "<td>&lt;a&gt;</td><td>0.5000</td>" in page and "<td></td><td></td>" in page and "A &amp; B" in page


def test_screen_text(spark):
    kind = "s int, depth int, ord int, role string, editable boolean, text string, path array<int>"
    rows = [(1, 0, 1, "heading", False, " A  b ", []), (1, 0, 2, "text_area", False, "mine", []), (1, 1, 3, "static_text", None, "inside", [2]), (1, 1, 4, "link", False, "A b", [1]), (1, 1, 5, "button", False, "no", [1]), (1, 2, 6, "static_text", True, "edit", [1]), (1, 2, 7, "static_text", False, "longer text", [1]), (2, 0, 1, "link", False, None, None)]
    e = spark.createDataFrame(rows, kind)
    assert [tuple(r) for r in CP.screen_text(e, ["s"], 9).collect()] == [(1, "A b\nlonge")]
    assert [tuple(r) for r in CP.screen_text(e, ["s"], 100).collect()] == [(1, "A b\nlonger text")] and CP.screen_text(e, ["s"], 0).count() == 0


def test_idle_counts_units(spark):
    k = spark.createDataFrame([("a", 0, 1, "x" * 90), ("a", 100, 2, "y"), ("a", 400, 3, "z😀" * 50), ("b", 5, 1, "")], "u string, t long, g int, s string")
    got = {(r.u, r.g): r.captured for r in CP.idle(k, ["u"], "t", "g", "s", most=80).collect()}
    assert set(got) == {("a", 2), ("a", 3), ("b", 1)} and got[("a", 3)] == "😀" + "z😀" * 26 and got[("b", 1)] == ""


def _events(*rows):
    names = ["session_id", "seq", "kind", "burst_id", "draft", "candidates", "votes", "at_word", "choice", "quiet"]
    return [tuple(dict(session_id="s", seq=i, **r).get(n) for n in names) for i, r in enumerate(rows)]


def test_offers_and_labels(spark):
    ask = lambda b: dict(kind="request", burst_id=b)
    tell = lambda b, d, *c, **k: dict(kind="result", burst_id=b, draft=d, candidates=list(c), **k)
    rows = _events(
        ask("1"), tell("1", "teh", "the", "ten"), ask("2"), tell("1", "old", "x"), tell("2", "teh cat", "the cat"), ask("3"), tell("3", "b", "b"), ask("4"), tell("4", "zz", "z"),
        dict(kind="select", choice=0), dict(kind="dismiss"), dict(kind="dismiss"), dict(kind="select", choice=9),
        ask("5"), tell("5", "a bb cc dd", "a xx cc dd", votes=[4], at_word=0, quiet=True), dict(kind="end"), dict(kind="select", choice=0), dict(kind="cancel"),
    )
    got = [(r.seq, r.outcome, r.label, r.source, r.draft, r.committed) for r in desk.outcomes(spark.createDataFrame(rows, desk.EVENT)).orderBy("seq").collect()]
    assert got == [
        (1, "offered", None, None, "teh", "the"), (3, "stale", None, None, None, None), (4, "offered", None, None, "teh cat", "the cat"), (6, "skipped", None, None, None, None), (8, "offered", None, None, "zz", "z"),
        (9, "label", "replace", "confirmed_candidate", "teh cat", "the cat"), (10, "label", "keep", "dismissal", "zz", None),
        (14, "skipped", None, None, None, None), (15, "offered", None, None, "a bb cc dd", "a xx cc dd"), (16, "label", "replace", "sentence_pass", "a bb cc dd", "a xx cc dd"),
    ]
    assert desk.outcomes(spark.createDataFrame([], desk.EVENT)).count() == 0


def test_hardened_edits_are_applied_or_reverted():
    d = desk.Desk()
    at = lambda **k: type("E", (), {"burst_id": "1", "draft": None, "candidates": None, "votes": None, "at_word": None, "choice": None, "quiet": True, **k})
    for _ in range(2):
        d.take(at(kind="request"))
        d.take(at(kind="result", draft="a bb cc dd", candidates=["a xx yy cc dd"], votes=[3], at_word=0))
    assert [x[2:] for x in d.take(at(kind="revert"))] == [("keep", "revert", "bb", None)]
    d.take(at(kind="request"))
    d.take(at(kind="result", draft="a bb cc dd", candidates=["a xx yy cc dd"], votes=[5], at_word=0))
    assert [x[2:] for x in d.take(at(kind="apply"))] == [("replace", "hardened_edit", "bb", "xx yy")] and d.edits.text(False) == "a xx yy cc dd" and d.take(at(kind="apply")) == []


def test_session_evidence():
    s = sessions.EditSession()
    assert s.offer("a bb cc", "a xx cc", 1, False) == []  # the session ends one word beyond
    assert s.offer("cc dd ee", "cc dd ee", 0, False, at_word=2) == [] and s.frontier == 5
    assert s.offer("a bb", "a xx", 3, False) == [(1, 2, "xx")]  # two agreements with support; how far stays, though the draft is shorter
    s.offer("a bb cc", "a bb cc", 0, False)
    assert s.slots[1].hardened and s.slots[1].looks == 2 and s.text(True) == "a xx cc dd ee"
    t = sessions.EditSession()
    t.offer("a bb cc", "a xx yy", 1, False)
    t.offer("a bb cc", "a xx cc", 1, False)  # covers what it does not propose
    assert t.slots[1].replacement == "xx" and t.slots[1].agreements == 1


def test_equal_sequence_numbers_are_no_repeats(spark):
    rows = [("s", 1, "offer", "teh dog is here", "the dog is here", 2, False), ("s", 1, "offer", "teh dog is here", "the dog is here", 3, False), ("s", 1, "offer", "teh dog is here", "the dog is here", 3, False)]
    got = sessions.replay(spark.createDataFrame(rows, sessions.EVENT)).collect()
    assert [(r.start, r.replacement) for r in got] == [(0, "the")]


def test_dispatch(spark):
    rows = [('{"type":"ask","id":"1","n":2}',), ('{"type":"ask","n":2}',), ('{"type":"ping"}',), ('{"type":"who"}',), ("no json",), ("[1]",), (" ",), (None,)]
    out = RQ.dispatched(spark.createDataFrame(rows, "value string"), {"ask": "id string not null, n int", "ping": "type string"})
    assert [tuple(r) for r in out["ask"].collect()] == [("1", 2)] and out["ping"].count() == 1
    assert Counter(r.reason for r in out[""].collect()) == {"fields": 1, "unknown_type": 1, "not_an_object": 2}


def test_fixtures(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"id": "a", "n": 1}, {"id": "b", "n": null}]')
    assert RQ.fixtures(spark, str(tmp_path / "f.json"), "id string, n int", "id").count() == 2
    (tmp_path / "g.json").write_text('[{"id": "a"}, {"id": "a"}]')
    with pytest.raises(ValueError, match="repeated"):
        RQ.fixtures(spark, str(tmp_path / "g.json"), "id string", "id")


@dataclass
class Inner:
    share: float = field(metadata={"range": (0.0, 1.0)})
    names: list[str] = field(default_factory=list)


@dataclass
class Outer:
    seed: int
    run: Inner
    weights: dict[str, float] = field(default_factory=dict)


@pytest.mark.parametrize("text,error", [("seed = 1\n[run]\nshare = 1", None), ("seed = true\n[run]\nshare = 1", "seed is no int"), ("seed = 1\nmore = 2\n[run]\nshare = 1", "unknown keys"), ("seed = 1", "lacks"), ("seed = 1\n[run]\nshare = 2.0", "run.share is not within"), ('seed = 1\n[run]\nshare = 0.5\nnames = [" "]', "is empty"), ("seed = 1\n[run]\nshare = 0.5\n[weights]\na = 'x'", "weights.a is no float")])
def test_settings(tmp_path, text, error):
    (tmp_path / "c.toml").write_text(text)
    if error is None:
        assert RQ.settings(str(tmp_path / "c.toml"), Outer) == Outer(1, Inner(1.0))
    else:
        with pytest.raises(ValueError, match=error):
            RQ.settings(str(tmp_path / "c.toml"), Outer)


def test_concatenated_and_ends(spark):
    a, b = spark.createDataFrame([(3, "x"), (1, "y")], "k int, t string"), spark.createDataFrame([(2,)], "k int")
    assert sorted(map(tuple, B.concatenated([a, b], "k").select("_part", "_row", "k", "t").collect()), key=lambda x: x[:2]) == [(0, 0, 1, "y"), (0, 1, 3, "x"), (1, 0, 2, None)]
    assert [r.k for r in B.last_rows(a, [F.desc("k")], 1).collect()] == [3]
