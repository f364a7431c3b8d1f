import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.functions import distance as D
from inkfold.functions import edits as E
from inkfold.functions import text as T


def test_levenshtein_goldens(spark):
    r = spark.createDataFrame([("kitten", "sitting"), ("same", "same"), ("", "abc")], "a string, b string").select(F.levenshtein("a", "b").alias("d"))
    assert [x.d for x in r.collect()] == [3, 0, 3]


def test_typing_distance_goldens():
    assert D.typing_distance("teh", "the") < 1
    assert D.typing_distance("cat", "cat") == 0
    assert D.typing_distance("cat", "czt") < 1 < D.typing_distance("", "ab")
    assert D.adjacent_keys("f", "d") and not D.adjacent_keys("f", "p")


def test_ratio_keeps_junk_rule():
    a = "ab" * 120
    assert D.ratio(a, a) == 1.0 and D.ratio("abc", "abd") > 0.6


def test_simhash_of_nothing_has_all_bits():
    assert D.simhash("") == -1 and D.simhash(None) is None and D.simhash("a b") == D.simhash("a b")


def test_diff_goldens():
    assert E.diff("a b c", "x y z") == [(0, 3, "x y z")]
    assert E.diff("teh cat sat on the mta", "the cat sat on the mat") == [(0, 1, "the"), (5, 6, "mat")]
    assert E.diff("thank very", "thank you very") == [(1, 1, "you")]
    assert E.diff("same words", "same words") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=8), st.lists(st.sampled_from("a b c d".split()), max_size=8))
def test_diff_round_trip(a, b):
    a, b = " ".join(a), " ".join(b)
    assert E.apply(a, E.diff(a, b)) == b


def test_replacements_goldens(spark):
    rows = [("ship spec tn", "Ship spec tonight."), ("one two", "one two three"), ("a x", "b x"), ("b/c dd", "zz dd"), (None, "x")]
    r = spark.createDataFrame(rows, "d string, c string").select(E.replacements(F.col("d"), F.col("c")).alias("p")).collect()
    assert [(x.shorthand, x.expansion) for x in r[0].p] == [("tn", "tonight")]
    assert not r[1].p and not r[2].p and not r[3].p and not r[4].p


def test_text_forms(spark):
    t = F.col("t")
    rows = [("  Héllo,   WORLD!  ",), ("",), (None,), ("x" * 5000,), ("a\n\nb \r\n c",)]
    r = spark.createDataFrame(rows, "t string").select(T.plain(t).alias("p"), T.surface(t).alias("s"), T.slug(t).alias("g"), T.word_count(t).alias("n"), T.lines(t).alias("l"), T.sentence(t).alias("c"), T.plain_exact(t).alias("x"), T.utf16_length(t).alias("u")).collect()
    assert (r[0].p, r[0].s, r[0].g, r[0].n) == ("héllo world", "héllo, world", "h-llo-world", 2)
    assert (r[1].p, r[1].n, r[1].c) == ("", 0, "") and r[2].p is None and r[2].x is None
    assert len(r[3].p) == 5000 and r[4].l == ["a", "b", "c"] and r[0].x == "héllo world"


def test_keep_edges(spark):
    r = spark.createDataFrame([("  wrld ", "world"), ("x", " y ")], "a string, b string").select(T.keep_edges(F.col("a"), F.col("b")).alias("k"))
    assert [x.k for x in r.collect()] == ["  world ", "y"]


def test_spans(spark):
    r = spark.createDataFrame([("hello  wrld next",), (None,)], "t string").select(T.token_spans(F.col("t")).alias("s")).collect()
    assert [(x.start, x.end) for x in r[0].s] == [(0, 5), (7, 11), (12, 16)] and r[1].s is None


def test_random_edits_are_found_by_simhash_bands():
    rng = random.Random(1)
    words = [rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(40)]
    a = D.simhash(" ".join(words)) & (2**64 - 1)
    b = D.simhash(" ".join([*words[:-1], "theta"])) & (2**64 - 1)
    assert bin(a ^ b).count("1") < 24
