import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking, splits


def test_strata(spark):
    rows = [(i, "Fake" if i < 20 else "Real", f"m{i // 10}") for i in range(30)] + [(99, "x", "alone"), (100, "y", "two"), (101, "y", "two")]
    df = spark.createDataFrame(rows, "k int, label string, m string")
    got = splits.stratified_split(df, ["label", "m"], "k", 0.7, 7)
    n = {(r["m"], r["split"]): r["count"] for r in got.groupBy("m", "split").count().collect()}
    assert all(n[(f"m{i}", "train")] == 7 and n[(f"m{i}", "eval")] == 3 for i in range(3))
    assert n[("alone", "train")] == 1 and n[("two", "train")] == n[("two", "eval")] == 1
    again = splits.stratified_split(df.repartition(9), ["label", "m"], "k", 0.7, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_published_strata(spark):
    sizes = {"F-F": 10835, "F-R": 9709, "R-F": 500, "R-R": 500}
    df = None
    for m, n in sizes.items():
        x = spark.range(n).select(F.concat(F.lit(m), F.col("id")).alias("k"), F.lit(m).alias("m"))
        df = x if df is None else df.union(x)
    got = splits.stratified_split(df, ["m"], "k", 0.7, 42).groupBy("m", "split").count().collect()
    assert {(r["m"], r["split"]): r["count"] for r in got if r["split"] == "train"} == {("F-F", "train"): 7584, ("F-R", "train"): 6796, ("R-F", "train"): 350, ("R-R", "train"): 350}


@pytest.mark.parametrize("n, ratio, expected", [(10, 0.3, 3), (5, 0.1, 1), (25, 0.1, 2), (1, 0.5, 0), (2, 0.9, 1)])
@pytest.mark.parametrize("exact", [False, True])
def test_groups(spark, n, ratio, expected, exact):
    df = spark.createDataFrame([(f"g{i}", v) for i in range(n) for v in (0, 1)], "g string, v int")
    got = splits.group_split(df, "g", ratio, 7, exact)
    assert got.filter("split = 'val'").select("g").distinct().count() == expected
    splits.assert_no_leak(got, "g")
    with pytest.raises(ValueError):
        splits.group_split(df, "g", 1.0, 7)


def test_folds(spark):
    folds = spark.createDataFrame([(f, "test" if (f == 1) == (s == "b") else "train", s) for f in range(1, 6) for s in "ab"] + [(1, "test", "a")], "fold int, split string, subject_id string")
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    got = {(r["s"], r["fold"]): r["split"] for r in splits.fold_membership(df, folds, "s").collect()}
    assert got[("a", 1)] == "train" and got[("b", 1)] == "test" and got[("b", 2)] == "train" and len(got) == 10
    splits.assert_covered(df, folds, "s")
    for odd in ("c", ""):
        with pytest.raises(ValueError):
            splits.assert_covered(df.union(spark.createDataFrame([(odd,)], "s string")), folds, "s")


def test_memberships(spark):
    rows = [("TEST", a, b) for a in (False, True) for b in (False, True)] + [("Dev", False, False), ("training", True, True), ("x", False, False)]
    got = spark.createDataFrame(rows, "s string, a boolean, b boolean").select(splits.memberships(F.col("s"), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [["test_all", "test_indomain"], ["test_all", "test_open_language"], ["test_all", "test_open_model"], ["test_all", "test_open_full"], ["validation"], ["train"], []]


def test_shards_and_caps(spark):
    got = ranking.round_robin(spark.range(5), "id", 2, 4).collect()
    assert sorted((r["shard"], r["id"]) for r in got) == [(0, 0), (0, 2), (1, 1), (1, 3)]
    df = spark.range(20).withColumn("g", F.col("id") % 2)
    assert ranking.per_group(df, ["g"], 3, "id", 1).count() == 6 and ranking.per_group(df, ["g"], None, "id", 1).count() == 20
