from inkfold.operators import planning as P


def test_deficits_first():
    taken = P.deficits_first({("a", "x"): 5, ("b", "x"): 5, ("b", "y"): 1}, [{"a": 1, "b": 3}, {"y": 1}], 4)
    assert taken == {("a", "x"): 1, ("b", "x"): 2, ("b", "y"): 1}
    assert P.deficits_first({("a",): 1}, [{}], 5) == {("a",): 1}


def test_packing():
    groups = [("a", 6), ("b", 1), ("c", 6), ("d", 12), ("e", 2)]
    assert P.pack(groups, 8) == [["a", "b"], ["c"], ["d"], ["e"]] and P.pack([], 8) == []
    assert P.take_whole(groups, 8) == ["a", "e"] and P.take_whole(groups, 5) is None and P.take_whole(groups, 0) == []


def test_selection_takes_the_best(spark):
    score = "scores struct<correctness:int,context_grounding:int,context_usefulness:int,meaning_preservation:int,tone_preservation:int,minimality:int,naturalness:int,category_validity:int,dataset_value:int>"
    rows = [("x1", "a", (5,) * 9), ("x2", "a", (4,) * 9), ("x3", "b", None), ("x4", None, (3,) * 9)]
    r = P.by_quality(spark.createDataFrame(rows, f"candidate_id string, category string, {score}"), ["category"])
    assert {x.candidate_id: x["rank"] for x in r.collect()} == {"x1": 1, "x2": 2, "x3": 1, "x4": 1}
    assert {x.candidate_id for x in P.select(r, ["category"], [{"a": 1, "b": 1, None: 1}], 3).collect()} == {"x1", "x3", "x4"}
    assert P.select(r.limit(0), ["category"], [{}], 3).count() == 0
