"""Numbers, running sums, ranks and everything built on them, on tables that fill many ranges, against numpy."""

import datetime
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, ranges, ranking
from tessera.operators.ranges import Down, cumulative, numbered
from tessera.sources import readers

N = 1_500_000


@pytest.fixture(scope="module")
def million(spark, tmp_path_factory):
    """N rows in no order: id, score with ties, label, group g (one holds most rows), and columns that ride along."""
    path = str(tmp_path_factory.mktemp("million") / "rows")
    x = spark.range(0, N, 1, 16).withColumn("id", (F.col("id") * 7919) % N)
    x = x.select("id", F.floor(F.pmod(F.xxhash64("id"), F.lit(40_000))).cast("double").alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).alias("fake"),
                 F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), F.md5(F.col("id").cast("string")).alias("payload"))
    x.write.parquet(path)
    return spark.read.parquet(path)


def test_numbers_with_payload(spark, million):
    got = numbered(million, "id").select("idx", "id", F.length("payload").alias("n")).toPandas()
    assert len(got) == N and (got["idx"] == got["id"]).all() and (got["n"] == 32).all()
    other = numbered(million, Down("score"), "id", name="place").select("place", "id", "score").toPandas()
    want = np.lexsort((other["id"].to_numpy(), -other["score"].to_numpy()))
    assert (other["place"].to_numpy()[want] == np.arange(N)).all()


def test_one_shuffle_of_the_rows(million):
    x = numbered(million, "id")
    x.count()
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2  # the rows, and a row for each range and task


def test_grouped_sums_ranks_and_metrics(million):
    p = million.toPandas()
    x = cumulative(million.withColumn("one", F.lit(1).cast("long")), ["g", "id"], ("one",)).select("g", "id", "one_0").toPandas().sort_values(["g", "id"])
    assert (x["one_0"].to_numpy() == np.arange(N)).all()
    ranks = ranking.average_rank(million, "score", ("g",)).toPandas()
    want = p.groupby("g")["score"].rank(method="average")
    want = p.assign(r=want).groupby(["g", "score"])["r"].first()
    got = ranks.set_index(["g", "score"])["avg_rank"].sort_index()
    assert np.allclose(got, want.sort_index()) and len(got) == len(want)
    m = metrics.rank_metrics(million, F.col("fake"), "score", ("g",)).toPandas().set_index("g")
    a = metrics.rowwise_precision(million, F.col("fake"), "score", "id", ("g",)).toPandas().set_index("g")
    for g, rows in p.groupby("g"):
        y = rows["fake"].to_numpy()
        r = rows["score"].rank().to_numpy()
        auc = (r[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
        s = y[np.lexsort((rows["id"].to_numpy(), -rows["score"].to_numpy()))]
        precision = np.cumsum(s) / np.arange(1, len(s) + 1)
        assert abs(m.loc[g, "roc_auc"] - auc) < 1e-9 and abs(a.loc[g, "ap_rowwise"] - precision[s].mean()) < 1e-9


def test_shards_and_prefixes(million):
    s = ranking.round_robin(million, "id", 7, limit=1_000_003).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("m"), F.max("id").alias("top")).collect()
    assert sum(r["n"] for r in s) == sum(r["m"] for r in s) == 1_000_003 and max(r["top"] for r in s) == 1_000_002
    assert [r["id"] for r in ranking.first_rows(million, "id", 20, 8).orderBy("idx").collect()] == list(range(20))


def test_lines_of_large_files(spark, tmp_path):
    rows = [f"line {i}" if i % 31 else "  " for i in range(1_000_000)]
    (tmp_path / "a.txt").write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        x = readers.lines(spark, f"{tmp_path}/a.txt").select("line_number", "index", F.substring_index("value", " ", -1).cast("long").alias("i")).toPandas().sort_values("line_number")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    i = x["i"].to_numpy()
    assert (x["line_number"].to_numpy() == i + 1).all() and (x["index"].to_numpy() == np.arange(len(i))).all() and len(i) == sum(1 for r in rows if r.strip())


@pytest.mark.parametrize("kind", ["string", "double", "decimal(10,2)", "date", "timestamp", "boolean", "binary", "int"])
def test_orders_of_every_type(spark, monkeypatch, kind):
    monkeypatch.setattr(ranges, "ROWS", 7)
    values = {
        "string": ["", "a", "ab", "b", "é", "ä", "z\n", '"q"', "Z", None], "double": [0.0, -1.5, float("nan"), float("inf"), float("-inf"), 1e-300, 3.25, None], "decimal(10,2)": [decimal.Decimal(v) for v in ("1.10", "-3.00", "99999999.99", "0.00")] + [None],
        "date": [datetime.date(1960, 1, 2), datetime.date(2020, 5, 5), None], "timestamp": [datetime.datetime(1960, 1, 2, 3, 4, 5, 6), datetime.datetime(2020, 5, 5), None], "boolean": [True, False, None], "binary": [b"", b"\xff", b"\x00a", None], "int": [5, -7, 2**31 - 1, -(2**31), None],
    }[kind]
    df = spark.createDataFrame([(values[i % len(values)], i) for i in range(120)], f"v {kind}, i int")
    for order in (["v", "i"], [Down("v"), Down("i")], [Down("v"), "i"]):
        got = [r["i"] for r in numbered(df, *order).orderBy("idx").collect()]
        assert got == [r["i"] for r in df.orderBy(*ranges.sorting(order)).collect()], order
        x = numbered(df.withColumn("_range", F.lit("own")).withColumn("idx", F.lit(-1)), *order)
        assert x.filter("_range = 'own'").count() == 120 and sorted(r["idx"] for r in x.collect()) == list(range(120))


def test_empty_tables_and_other_types(spark, monkeypatch):
    df = spark.createDataFrame([], "id long, v double")
    assert numbered(df, "id").count() == 0 and cumulative(df, ["id"], ("v",)).count() == 0
    monkeypatch.setattr(ranges, "ROWS", 2)
    with pytest.raises(TypeError):
        numbered(spark.range(9).withColumn("m", F.array("id")), "m")
