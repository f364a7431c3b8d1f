import os
import random
from collections import Counter

import pandas as pd
import pytest

from inkfold.llm import garbled as G
from inkfold.llm import leaks as K
from inkfold.llm import queries as q
from inkfold.llm import sampling as S
from inkfold.llm import tokens as T
from inkfold.llm import truncated as TR
from tests.compare import rows_of_frame, rows_of_sql
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
VOCAB = f"{q.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert rows_of_frame(q.queries()[name](spark, SF)) == rows_of_sql(SF, q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_runs(spark, name):
    assert q.queries()[name](spark, SF).count() >= 0


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")
def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello world", "", None, "  double  blanks \n\n tabs\t", "naïve café — “quotes” 漢字かな 👩‍💻", "<|endoftext|> is text", "a" * 3000, "x1y2 don't we'll   z", "Ünïcødé" * 400]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(0, "Hello world", "k"), (0, "other", "k"), (None, "no id", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    e = T.encode(df, VOCAB)
    got = sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in e.collect())
    t = tokenizers.Tokenizer.from_file(VOCAB.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    want = sorted((-1 if i is None else i, t.encode(x or "", add_special_tokens=False).ids) for i, x, _ in rows)
    assert got == want
    back = {(r.doc_id, r.text) for r in T.decode(e, VOCAB).collect()}
    assert back == {(i, x or "") for i, x, _ in rows}
    assert T.encode(df.limit(0), VOCAB).count() == 0


def _sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_leaks_exact(spark):
    rng = random.Random(3)
    items = [(i, _sentence(rng, 30)) for i in range(5)] + [(9, "too short"), (10, None), (0, None)]
    cut = items[1][1].split()[4:17]
    docs = [(1, _sentence(rng, 40) + " " + items[0][1].upper().replace(" ", "\n")), (2, "> *" + "*, ".join(cut) + "*"), (3, " ".join(cut[:12]) + " x"), (4, None), (5, ""), (6, _sentence(rng, 30_000) + " " + " ".join(cut)), (1, items[0][1])]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, t string")
    i = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, doc string")
    assert {tuple(r) for r in K.leaks(d, i).collect()} == {(1, 0), (2, 1), (6, 1)}
    assert K.leaks(d.limit(0), i).count() == K.leaks(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_leaks_with_edits_reach_recall(spark, edits):
    """A thousand items, each in a document after so many random edits; nothing but those pairs comes out."""
    rng = random.Random(8)
    items = [(i, _sentence(rng, 13)) for i in range(1000)]
    docs = []
    for i, t in items:
        w = t.split()
        for _ in range(edits):
            j = rng.randrange(len(w))
            w[j : j + 1] = rng.choice([[], [_sentence(rng, 1)], [w[j], _sentence(rng, 1)]])
        docs.append((i, _sentence(rng, 20) + " " + " ".join(w) + " " + _sentence(rng, 20)))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in K.leaks(d, i, edits=edits).collect()}
    true = {(i, i) for i, _ in items}
    assert len(got & true) >= (0.95 if edits else 1) * len(true) and got <= true


def test_leaks_by_join(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 20)
    test_leaks_exact(spark)
    test_leaks_with_edits_reach_recall(spark, 1)


@pytest.mark.parametrize("true,wrong,text", [("utf-8", w, "Où est passé le dernier modèle, déjà jeté ?") for w in ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251")] + [("utf-8", "cp1252", "Мы перенесли встречу на четверг"), ("cp1251", "latin-1", "Мы перенесли встречу на четверг"), ("koi8-r", "cp1252", "Мы перенесли встречу на четверг"), ("cp932", "cp1252", "この図面はまだ下書きです。返事を待っています。")])
def test_restores(true, wrong, text):
    bad = G.read(text.encode(true), wrong)
    whole = f"Correct line: café, NÃO, GÂTEAU.\n{bad}"
    assert G.restore(whole) == (f"Correct line: café, NÃO, GÂTEAU.\n{text}", True)


def test_restores_twice():
    bad = G.read(G.read("São necessárias".encode(), "cp1252").encode(), "cp1252")
    assert G.restore(bad) == ("São necessárias", True)


@pytest.mark.parametrize("text", ["Où est passé “le” château ? NÃO APAGUE: MAÇÃ, GÂTEAU – 968 € · ☆", "Отчёт готов, спасибо. Рёв", "昨日、新しい契約書が届きました。", "👩‍💻 typing… 3.º ½ ©", "", None, "Żółta teczka, źdźbło", "word word on Saturday", " "])
def test_correct_text_stays(text):
    assert G.restore(text) == (text, False)


@pytest.mark.parametrize("sign", ["\u00a0", "\u202f", "\u2705", "\u26a0", "\U0001f7e2", "\U0001fa84"])
def test_restores_signs(sign):
    assert G.restore(G.read(f"keeps{sign}the".encode(), "cp1252")) == (f"keeps{sign}the", True)


def test_lone_letters_by_pairs_of_other_lines():
    lines = "Où est passé le modèle ?\nÓ sim"
    assert G.restore(G.read(lines.encode(), "cp1252")) == (lines, True)


def test_garbled_edges(spark):
    rows = [(1, "cafÃ©", "k"), (1, "cafÃ©", "k"), (2, None, "k"), (3, "", "k"), (4, "x" * 100_000 + " dÃ©jÃ\xa0", "k"), (5, "reuni�o", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    r = G.garbled(df).collect()
    assert sorted(x.doc_id for x in r) == [1, 1, 4, 5] and {x.restored for x in r if x.doc_id == 1} == {"café"}
    assert G.garbled(df.limit(0)).count() == 0


def test_truncation(spark):
    rng = random.Random(6)
    nouns, days = "report invoice ledger memo budget agenda glossary template".split(), "Monday Tuesday Friday Sunday".split()
    name = lambda: "".join(rng.choice(["gim", "dal", "kor", "zan", "pel", "tus"]) for _ in range(3)).capitalize()
    sentence = lambda: rng.choice([f"Please send the {rng.choice(nouns)} for {name()} by {rng.choice(days)}.", f"The {rng.choice(nouns)} for {name()} is still with the finance team.", f"Our call about the {rng.choice(nouns)} starts at noon."])
    rows, cut = [], set()
    for i in range(3000):
        t = " ".join(sentence() for _ in range(rng.randint(1, 3))) if rng.random() < 0.8 else f"Status: {rng.choice(nouns)}"
        if i % 10 == 0 and len(t) > 60:
            j = rng.randint(30, len(t) - 4)
            while t[j - 1] in ". ":
                j -= 1
            t = t[:j] + rng.choice(["", "", "…", "..."])
            cut.add(i)
        rows.append((i, "v", t, "s", 0.5))
    rows += [(5000, "v", None, "s", 0.5), (5001, "v", "", "s", 0.5), (5002, "v", "  ", "s", 0.5)]
    df = spark.createDataFrame(rows, "row_id long, field string, value string, source string, log_odds double")
    got = {r.row_id for r in TR.truncated(df.drop("log_odds")).collect()}
    assert len(got & cut) > 0.9 * len(cut) and len(got & cut) > 0.9 * len(got)
    rep = TR.truncation_report(df.drop("log_odds")).collect()[0]
    assert rep.n_rows == 3002 and rep.n_truncated == len(got)
    assert TR.truncated(df.drop("log_odds").limit(0)).count() == 0


def _bins(values):
    return pd.DataFrame(sorted(Counter(int(v * 5 // 1) for v in values).items()), columns=["bin", "count"])


def test_threshold_does_not_switch_by_size():
    rng = random.Random(4)
    some = [rng.gauss(-6.5, 1.0) for _ in range(60)] + [rng.uniform(-3.6, -2.2) for _ in range(25)] + [rng.gauss(1.5, 0.9) for _ in range(315)]
    limits = {TR.threshold(_bins(some * n), _bins(some * n)) for n in (1, 10, 100)}
    assert len(limits) == 1 and -2.3 < limits.pop() <= TR.HIGH  # the valley, not the centre, at each size
    none = pd.DataFrame({"bin": [], "count": []})
    assert abs(TR.threshold(none, none) - TR.CENTRE) < 0.11  # half a bin
    few = TR.threshold(_bins([-3.1] * 5), _bins(some * 10))
    assert abs(few - TR.threshold(_bins(some), _bins(some * 10))) < 0.5  # a small group follows its field


def test_common_words_keep_their_share(spark):
    words = ["Alpha", "Beta"]
    texts = lambda n: spark.createDataFrame([(f"{words[0] if i % 50 == 0 else ''} {words[1] if i % 400 == 0 else ''} text {i}",) for i in range(n)], "text string")
    assert TR.common_words(texts(400)) == TR.common_words(texts(4000)) == {"Alpha"}


def test_truncation_of_repeated_texts(spark):
    rng = random.Random(9)
    nouns = "report invoice ledger memo budget agenda glossary template".split()
    texts = [f"Please send the {rng.choice(nouns)} for room {i} to the {rng.choice(nouns)} team by {rng.choice(['Monday', 'Friday'])}." for i in range(800)]
    cuts = ["Please send the report for room 7 to the inv", "Please send the memo for room 9 to the led…", "Please send the bud"]
    rows = list(enumerate(texts + cuts * 1000 + ["Loading…", "Status: spare"] * 1000))
    df = spark.createDataFrame([(i, "v", t) for i, t in rows], "row_id long, field string, value string")
    got = Counter(r.value for r in TR.truncated(df).collect())
    assert got == {c: 1000 for c in cuts}


def test_truncation_after_a_closing_sign(spark):
    """A stop that others go on after is no end: the model reads it, no rule exempts it."""
    rng = random.Random(12)
    nouns = "report invoice ledger memo budget agenda glossary template".split()
    texts = [f"Please send the {rng.choice(nouns)} for room {i}. It costs {rng.randint(2, 9)}.{rng.randint(10, 99)} euros (tax included)." for i in range(800)]
    whole = ["Please send the report to room 7.", "It costs 3.50 euros (tax included)", "Please send the memo 🙂"] * 3
    cuts = ["Please send the memo for room 9. It costs 3.", "Please send the budget for room 4. It costs 5.20 euros (tax"]
    df = spark.createDataFrame([(i, "v", t) for i, t in enumerate(texts + whole + cuts)], "row_id long, field string, value string")
    assert {r.value for r in TR.truncated(df).collect()} == set(cuts)


def test_stable_sample_keeps_members(spark):
    rows = [(f"f{i % 90}", f"e{i}") for i in range(2000)] + [(None, "e"), ("f", None), ("", "")]
    df = spark.createDataFrame(rows, "family_id string, example_id string")
    few = {tuple(r) for r in S.stable_sample(df.where("example_id < 'e5'"), 0.4, 0.5).collect()}
    all_ = {tuple(r) for r in S.stable_sample(df.union(df).repartition(6), 0.4, 0.5).collect()}
    assert few <= all_ and 200 < len(all_) < 600
    assert S.stable_sample(df, 1.0, 1.0).count() == 2001 and S.stable_sample(df, 0.0, 1.0).count() == 0


def test_balanced_sample(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 100)
    rng = random.Random(2)
    rows = [(f"e{i}", rng.choice(["a", "A ", "b"]), rng.choice(["x", "y"])) for i in range(900)] + [("e1", "a", "x"), (None, "a", "x"), ("z", None, "x")]
    t = [("a", "x", 0.5, 3), ("b", "y", 0.3, 3), ("b", "x", 0.15, 3), ("c", "x", 0.05, 4), ("a", "y", 0.0, 7)]
    u = spark.createDataFrame(rows, "example_id string, category string, context_variant string")
    targets = spark.createDataFrame(t, "category string, context_variant string, target_share double, min_rows int")
    sample, report = S.balanced_sample(u, targets)
    rep = {(r.category, r.context_variant): r for r in report.collect()}
    assert all(r.residual == 0 for r in rep.values()) and rep[("a", "x")].selected == 90 and rep[("a", "y")].selected == 7
    assert rep[("c", "x")].available == 0 and rep[("c", "x")].wanted == 9
    got = sample.collect()
    assert len({r.example_id for r in got}) == len(got) == sum(r.selected for r in rep.values())
    assert sorted(got) == sorted(S.balanced_sample(u.repartition(7), targets)[0].collect())
    assert S.balanced_sample(u.limit(0), targets)[0].count() == 0


def test_balanced_sample_of_examples_with_untargeted_cells(spark):
    rows = [(f"e{i}", c, "x") for i in range(20) for c in (None, "0 no target", "a")]
    u = spark.createDataFrame(rows, "example_id string, category string, context_variant string")
    t = spark.createDataFrame([("a", "x", 1.0, 20)], "category string, context_variant string, target_share double, min_rows int")
    sample, report = S.balanced_sample(u, t)
    assert sample.count() == 20 and [(r.available, r.selected, r.residual) for r in report.collect()] == [(20, 20, 0)]
