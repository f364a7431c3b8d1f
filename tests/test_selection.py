"""Selections, screens and similarity hashes against plain versions."""

import difflib
import hashlib
import random
import re

from inkfold.functions import distance as D
from inkfold.operators import dedupe as DD
from inkfold.operators import planning as PL


def _plain_selection(available, targets, total):
    left, lack, taken = dict(available), [dict(t) for t in targets], dict.fromkeys(available, 0)
    for _ in range(total):
        open_ = [b for b, n in left.items() if n > 0]
        if not open_:
            break
        best = max(open_, key=lambda b: (tuple(lack[i].get(v, 0) for i, v in enumerate(b)), tuple(map(str, b))))
        left[best] -= 1
        taken[best] += 1
        for i, v in enumerate(best):
            lack[i][v] = lack[i].get(v, 0) - 1
    return taken


def test_heap_takes_what_steps_take():
    rng = random.Random(5)
    for _ in range(60):
        names = [[f"v{i}{j}" for j in range(rng.randint(1, 4))] for i in range(2)]
        available = {(a, b): rng.randint(0, 6) for a in names[0] for b in names[1]}
        targets = [{v: rng.randint(0, 8) for v in names[0]}, {v: rng.randint(0, 8) for v in names[1]} if rng.random() < 0.7 else {}]
        total = rng.randint(0, 30)
        assert PL.deficits_first(available, targets, total) == _plain_selection(available, targets, total)
    assert PL.deficits_first({}, [{}, {}], 5) == {}


def test_exact_take_splits_one_group():
    assert PL.take_exact([("a", 3), ("b", 4), ("c", 2)], 6) == [("a", 3), ("c", 2), ("b", 1)]
    assert PL.take_exact([("a", 3), ("b", 3)], 6) == [("a", 3), ("b", 3)] and PL.take_exact([("a", 1)], 5) == [("a", 1)] and PL.take_exact([], 3) == []


def test_complete_groups(spark):
    r = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g1", "b"), ("g2", "c"), ("g3", "d"), ("g3", "e"), (None, "f")], "g string, k string")
    assert {x.g for x in PL.complete_groups(r, "g", "k", 2, 4).collect()} == {"g1", "g3"} and {x.g for x in PL.complete_groups(r, "g", "k", 2, 3).collect()} == {"g1"}


def _plain_simhash(text):
    tokens = re.findall(r"[\w<>']+", text)
    score = [0] * 64
    for f in tokens + [f"{x} {y}" for x, y in zip(tokens, tokens[1:])]:
        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        for i in range(64):
            score[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if score[i] >= 0)


def test_similarity_hashes():
    texts = ["", "a", "the <entity> of <number>", None, "x " * 5000, "né dog", "..."]
    assert [None if v is None else v % (1 << 64) for v in D.simhashes(texts)] == [None if t is None else _plain_simhash(t) for t in texts]
    assert D.simhashes([]) == []


def test_near_links_are_alike(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    texts += [t.replace(t.split()[3], "other", 1) for t in texts[:10]]
    rows = spark.createDataFrame([(i, None if i % 2 else "g", t) for i, t in enumerate(texts)] + [(99, None, ""), (98, None, None)], "id int, group string, shape string")
    got = {(r.earlier, r.later): r.ratio for r in DD.near_links(rows).collect()}
    brute = {(i, j): difflib.SequenceMatcher(None, texts[j], texts[i]).ratio() for i in range(40) for j in range(i + 1, 40) if not (i % 2 == 0 and j % 2 == 0)}
    brute = {k: v for k, v in brute.items() if v >= 0.9}
    assert got == {k: brute[k] for k in got} and len(got) >= 0.5 * len(brute) > 0


def test_screened_rows(spark):
    kind = "id int, normal string, shape string"
    reference = spark.createDataFrame([(1, "n1", "s one"), (2, "n2", "the long shape of a <entity> with <number> words in it")], kind)
    rows = spark.createDataFrame([(1, "n1", "x"), (2, "m", "the long shape of a <entity> with <number> words in it"), (3, "k", "quite another one"), (4, None, None)], kind)
    assert {tuple(r) for r in DD.screened(rows, reference).collect()} == {(1, "reference_duplicate"), (2, "reference_near_duplicate")}
    assert DD.screened(rows, reference.limit(0)).count() == 0 and DD.screened(rows.limit(0), reference).count() == 0


def test_markdown_counts_what_it_leaves_out(spark):
    from inkfold.sources import jsonl

    page = jsonl.markdown(spark.range(5).toDF("a|b"), most=3)
    assert page.count("\n| ") == 4 and page.endswith("\n\n2 more rows\n") and "more" not in jsonl.markdown(spark.range(3), most=3)


def test_whole_file_is_numbered(spark, tmp_path):
    from inkfold.sources import jsonl

    (tmp_path / "f.txt").write_text("\n".join("" if i % 10 == 9 else f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = {r.line_no: r.value for r in jsonl.read_numbered(spark, str(tmp_path / "f.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i + 1: f"line {i}" for i in range(5000) if i % 10 != 9}
