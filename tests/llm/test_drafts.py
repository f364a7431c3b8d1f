import random
from collections import defaultdict

import pytest

from inkfold.llm import drafts as D
from inkfold.llm import editjoin as E
from inkfold.llm.components import frontier_components

SCHEMA = "row_id long, text string, family_id string, split string, source string, draft string"


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def texts(seed, n, low=8, high=80, letters="abcdef"):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        t = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        out.add(t)
        for _ in range(rng.randint(0, 3)):
            c = list(t)
            for _ in range(rng.randint(1, max(1, len(t) // 9))):
                i = rng.randrange(len(c))
                c[i : i + 1] = rng.choice([[], [rng.choice(letters)], [c[i], rng.choice(letters)]])
            out.add("".join(c))
    return sorted(t for t in out if t)


@pytest.mark.parametrize("seed,low,high,n", [(1, 8, 80, 150), (2, 380, 460, 12), (3, 1, 25, 150)])
def test_edit_links_lose_nothing(spark, seed, low, high, n):
    ts = texts(seed, n, low, high)
    df = spark.createDataFrame(list(enumerate(ts)), "id long, text string")
    want = {(i, j) for i in range(len(ts)) for j in range(i) if levenshtein(ts[i], ts[j]) <= max(len(ts[i]), len(ts[j])) // 10}
    got = {(max(r.a, r.b), min(r.a, r.b)) for r in E.edit_links(df, forest=False).collect()}
    assert got == want and want
    assert classes(got) == classes({(r.a, r.b) for r in E.edit_links(df).collect()})


def test_tiles_lose_nothing(spark, monkeypatch):
    ts = texts(7, 80, 20, 60, "ab")
    df = spark.createDataFrame(list(enumerate(ts)), "id long, text string")
    whole = {(r.a, r.b) for r in E.edit_links(df, forest=False).collect()}
    monkeypatch.setattr(E, "TILE", 40)
    monkeypatch.setattr(E, "SHARD", 500)
    assert {(r.a, r.b) for r in E.edit_links(df, forest=False).collect()} == whole


def classes(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    out = defaultdict(set)
    for x in list(parent):
        out[root(x)].add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "path": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 300)], "empty": []}[kind]
    df = spark.createDataFrame([*edges, (5, 5), (None, 1), *edges[:3]], "a long, b long")
    got = defaultdict(set)
    for r in frontier_components(df).collect():
        got[r.label].add(r.node)
    assert {frozenset(v) for v in got.values()} == classes([e for e in edges if e[0] != e[1]])


ROWS = [
    (1, "please archive the invoice for gimdalkor today", "f1", "train", "s", "x"),
    (2, "please archive the invoice for gimdalkor todxy", "f2", "eval", "s", "x"),
    (3, "Please, archive the ｉｎｖｏｉｃｅ for gimdalkor today!", "f3", "test", "t", "x"),
    (4, "something else", "f2", " Train", "s", "x"),
    (5, None, None, "train", "s", "x"),
    (6, None, "f9", "test", "s", "x"),
    (7, None, "f9", None, "s", "x"),
    (8, "!!!", None, "test", "s", "x"),
    (9, "?!", None, "train", "s", "x"),
    (10, "alone", "", "train", "s", "x"),
    (11, "w" * 30_000, None, "train", "t", "x"),
    (12, "w" * 29_000, None, "test", "t", "x"),
]


def test_groups_and_pairs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {(r.row_id, r.group_id) for r in D.draft_groups(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6), (11, 11), (12, 11)}
    assert {(r.row_id_a, r.row_id_b) for r in D.cross_split_pairs(df).collect()} == {(1, 2), (1, 3), (2, 4), (3, 4), (11, 12)}
    assert {tuple(r)[1:] for r in D.overlap_classes(df).collect()} == {(2, 2, 1, 2), (1, 1, 11, 12)}
    rep = {(r.split, r.source): (r.n_rows, r.n_in_train) for r in D.overlap_report(df).collect()}
    assert rep[("eval", "s")] == (1, 1) and rep[("test", "t")] == (2, 2) and rep[("test", "s")] == (2, 0)
    empty = df.limit(0)
    assert D.draft_groups(empty).count() == D.cross_split_pairs(empty).count() == D.assign_splits(empty).count() == 0


def test_drafts_keep_clashing_columns(spark):
    r = D.drafts(spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("draft", "node"))
    assert r.columns == ["row_id", "draft", "split", "source", "node"] and r.count() == len(ROWS)


def test_splits_keep_drafts_together(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcdefghij") for _ in range(30)), f"f{rng.randrange(400)}", "x", "s", "x") for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = {r.row_id: r.assigned for r in D.assign_splits(df).collect()}
    assert a == {r.row_id: r.assigned for r in D.assign_splits(df.repartition(5)).collect()} and len(a) == len(rows)
    by = defaultdict(set)
    for i, _, f, *_ in rows:
        by[f].add(a[i])
    assert all(len(v) == 1 for v in by.values())
    assert abs(sum(v == "train" for v in a.values()) / len(a) - 0.8) < 0.03
