import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.metrics import binary_metrics
from tessera.streaming import snapshot


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_covering_segments():
    assert snapshot.covering([(0, 0), (0, 3), (1, 1), (4, 4), (5, 5), (7, 7)]) == [(0, 3), (4, 4), (5, 5)]
    assert snapshot.covering([(0, 0), (0, 3), (1, 1), (2, 2), (3, 3)], 3) == [(0, 0), (1, 1), (2, 2)] and snapshot.covering([(1, 1)]) == []


def test_what_a_trigger_writes_follows_its_batch(spark, tmp_path, monkeypatch):
    table, source = str(tmp_path / "t"), str(tmp_path / "source")
    scores = np.random.default_rng(1).random(9 * 400)
    rows = [("Fake" if v > 0.4 and i % 3 else "Real", "Fake" if v > 0.5 else "Real", float(v)) for i, v in enumerate(scores)]
    schema = "label string, pred string, p_fake double"
    for i in range(9):
        spark.createDataFrame(rows[i * 400 : (i + 1) * 400], schema).coalesce(1).write.mode("append").parquet(source)
    written, seen = {}, {}

    def on_snapshot(m, i):
        seen[i] = m.first()
        written[i] = {s: size(snapshot._segment(table, s)) for s in snapshot.segments(spark, table)}

    snapshot.watch(spark, source, schema, table, str(tmp_path / "c"), on_snapshot).awaitTermination()
    assert sorted(seen) == list(range(9)) and [seen[i]["num_samples"] for i in range(9)] == [400 * (i + 1) for i in range(9)]
    own = [written[i][i, i] for i in range(9)]
    assert max(own) < 1.1 * min(own) and max(own) < size(source) / 5
    assert written[3][0, 3] > 2.5 * own[0] and (4, 7) in written[7] and set(snapshot.segments(spark, table)) == {(0, 3), (4, 7), (8, 8)}
    whole = binary_metrics(spark.createDataFrame(rows, schema)).first()
    for k in ("accuracy", "roc_auc", "average_precision", "tp", "fn"):
        assert seen[8][k] == pytest.approx(whole[k], abs=1e-12), k
    # A repeated trigger replaces its own segments.
    before = binary_metrics(snapshot.latest(spark, table), weight="n").first()
    spark.read.parquet(snapshot._segment(table, (8, 8))).write.mode("overwrite").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(snapshot._segment(table, (8, 8)))
    snapshot._merged(spark, table, 8)
    assert binary_metrics(snapshot.latest(spark, table), weight="n").first() == before
    # A restart goes on with the next number.
    spark.createDataFrame([("Fake", "Fake", None)], schema).coalesce(1).write.mode("append").parquet(source)
    snapshot.watch(spark, source, schema, table, str(tmp_path / "c"), on_snapshot).awaitTermination()
    assert seen[9]["num_samples"] == 3601 and snapshot.latest(spark, table).agg(F.sum("n")).first()[0] == 3601
    assert snapshot.latest(spark, str(tmp_path / "none")) is None
