import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening


def table(rows, spark, dim_type="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {dim_type}")


def brute(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, c @ v / np.sqrt(np.maximum(e, 1e-30)), e / e.sum()


def checked(got, vectors, k):
    n, deviation, white, explained = brute([v for _, v in vectors])
    assert len(got) == len(vectors)
    signs = None
    by = {i: at for at, (i, _) in enumerate(vectors)}
    for r in got:
        at = by[r["vec_id"]]
        w = np.array(r["whitened"])
        assert r["n"] == n and r["deviation"] == deviation[at] and len(w) == k
        assert np.allclose(r["explained"], explained[:k], rtol=1e-9) and r["identity_error"] < 1e-9
        assert np.allclose(np.abs(w), np.abs(white[at, :k]), atol=1e-7)
        s = np.where(np.abs(white[at, :k]) > 1e-5, np.sign(w * white[at, :k]), 0)
        signs = s if signs is None else np.where(signs == 0, s, signs)
        assert (s * signs >= 0).all()


@pytest.mark.parametrize("parts", [1, 23])
def test_equals_the_eigenvectors_of_the_covariance(spark, parts):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(700, 40)) * np.geomspace(3, 0.2, 40) + np.linspace(-5, 5, 40)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [1.0] * 39 + [None]), (1002, [float("nan")] * 40), (1003, [float("inf")] * 40), (1004, [1.0] * 3), (1005, [])]
    df = table(rows + odd, spark).repartition(parts).withColumn("n", F.lit("own")).withColumn("whitened", F.create_map(F.lit(1), F.lit(2)))
    checked(whitening.whiten(df).collect(), rows, 32)


def test_more_parts_than_a_level_merges_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * [9, 5, 3, 2, 1, 0.5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    y = whitening.integers(x)
    part = None
    for at in range(0, 300, 7):
        one = whitening.Part.of(y[at : at + 7])
        part = one if part is None else part.merged(one)
    e, _ = part.spread()
    c = (y - y.sum(0) / 300).astype(float)
    assert part.n == 300 and (part.sums == y.sum(0)).all() and np.allclose(e[:6], np.linalg.eigvalsh(c.T @ c / 300)[::-1], rtol=1e-12)
    checked(whitening.whiten(table(rows, spark, "array<double>").repartition(70)).collect(), rows, 6)


def test_ranks_and_repeated_rows(spark):
    flat = [(i, [i * 1.0, i * 2.0, 0.0]) for i in range(5)] * 2 + [(None, [9.0, 18.0, 0.0])]
    got = whitening.whiten(table(flat, spark)).collect()
    assert len(got) == 11 and all(len(r["whitened"]) == 1 and abs(r["explained"][0] - 1) < 1e-12 and r["identity_error"] < 1e-12 for r in got)
    same = whitening.whiten(table([(1, [2.0, 3.0]), (2, [2.0, 3.0])], spark)).collect()
    assert [(r["vec_id"], r["n"], r["deviation"], r["whitened"]) for r in same] == [(1, 2, 0, []), (2, 2, 0, [])]
    assert whitening.whiten(table([(1, [2.0, 3.0])], spark)).count() == 1 and whitening.whiten(table([], spark)).count() == 0
    assert whitening.whiten(table([(1, None), (2, [])], spark)).filter(F.size("whitened") > 0).count() == 0


def test_large_entries(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.5, 1.0]), (4, [2.0, 7.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table(rows, spark, "array<double>")).collect()}
    _, want, _, _ = brute([v for _, v in rows])
    assert got == {i: (d if d < 1 << 63 else None) for (i, _), d in zip(rows, want, strict=True)}
    assert len(whitening.whiten(table([(1, [1e300]), (2, [0.0])], spark, "array<double>")).collect()) == 2


def test_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(90, 35)).astype(np.float32))]
    table(rows, spark).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op12(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert len(got) == 90 * 32 and sorted({r["component"] for r in got}) == list(range(1, 33)) and {r["n"] for r in got} == {90}
    n, deviation, white, explained = brute([v for _, v in rows])
    for r in got:
        k = r["component"] - 1
        assert abs(abs(r["whitened"]) - abs(white[r["vec_id"], k])) < 1e-7 and abs(r["explained"] / explained[k] - 1) < 1e-9 and r["deviation"] == deviation[r["vec_id"]]
