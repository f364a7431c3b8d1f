from pyspark.sql import functions as F

from inkfold.operators import corpus as C


def test_trace_errors(spark):
    ops = [{"x": 1}]
    rows = [("sourced", None, None, None), ("sourced", 1, None, None), ("augmentation", 5, 1, [1]), ("augmentation", 5, 2, [1]), ("augmentation", -1, 1, [1]), ("augmentation", 5, 11, [1]), ("augmentation", 5, None, None), ("other", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "m string, s long, r int, o array<int>")
    got = [x.e for x in df.select(C.trace_errors(F.col("m"), F.col("s"), F.col("r"), F.col("o")).alias("e")).collect()]
    assert got == [None, "trace_of_sourced_row", None, "operations", "seed", "requested_events", "requested_events", "unknown_method", "no_method"] and ops


def test_filled_splits_follow_shares(spark):
    f = spark.createDataFrame([(f"f{i}", 1 + i % 3) for i in range(300)] + [(None, 9)], "k string, n int")
    got = {r.k: r.split for r in C.fill_splits(f, "k", "n", {"train": 0.8, "eval": 0.1, "test": 0.1}, "s").collect()}
    assert got == {r.k: r.split for r in C.fill_splits(f.repartition(6), "k", "n", {"train": 0.8, "eval": 0.1, "test": 0.1}, "s").collect()}
    share = sum(1 + int(k[1:]) % 3 for k, s in got.items() if s == "train") / 600
    assert len(got) == 300 and abs(share - 0.8) < 0.02


def test_lines_around_the_caret(spark):
    rows = [("one\r\ntwo\r\nthree", 6), ("one\ntwo", 0), ("one", 99), ("", 0), (None, 1), ("a\nb", None)]
    df = spark.createDataFrame(rows, "t string, c int")
    assert [r.x for r in df.select(C.without_line(F.col("t"), F.col("c")).alias("x")).collect()] == ["one\r\nthree", "two", "", "", None, "a\nb"]


def test_snippets_fall_back(spark):
    df = spark.createDataFrame([([("App", "", "A  title")],), ([],), (None,), ([("x" * 100, "v" * 300, None)],)], "s array<struct<app_name string, visible_text string, window_title string>>")
    r = [x.b for x in df.select(C.bounded_snippet(F.col("s")).alias("b")).collect()]
    assert r[0].visible_text == "A title" and r[1] is None and r[2] is None
    assert len(r[3].app_name) == 80 and len(r[3].visible_text) == 240 and r[3].window_title is None


def test_ids_ignore_other_columns(spark):
    df = spark.createDataFrame([("t", 1, "x"), ("t", 1, "y"), (None, 1, "x")], "b string, a int, other string")
    r = [x.example_id for x in C.training_rows(df, ["b", "a"]).collect()]
    assert r[0] == r[1] != r[2] and r[0].startswith("row_") and len(r[0]) == 24


def test_rotation_wraps(spark):
    df = spark.range(10)
    got = sorted(r.id for r in C.rotating(df, "id", "a", 4).collect())
    assert len(got) == 4 and C.rotating(df, "id", "a", 99).count() == 10 and C.rotating(df.limit(0), "id", "a").count() == 0
