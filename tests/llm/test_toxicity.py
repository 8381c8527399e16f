import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.toxicity import K, Index, Model, fit, held_out, kin, terms_of

BAD = ["vilest", "wretch", "Ekelhaft", "odieux"]


def test_terms():
    assert terms_of("It's an IDIOT, a_b c3d!\n(x)") == ["it", "s", "an", "idiot", "a", "b", "c", "d", "x"]
    assert terms_of("Été à la mer – l’île 4you, ÖL_x") == ["été", "à", "la", "mer", "l", "île", "you", "öl", "x"] and terms_of("") == []
    assert kin(["a"] * 9) == kin(["a"] * 50) != kin([])


def test_nearest_are_those_of_brute_force():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        terms = rng.choice(40, rng.integers(1, 9), replace=False)
        w = rng.integers(1, 4, len(terms)).astype(float)
        w /= np.sqrt((w**2).sum())
        vectors.append(dict(zip(terms.tolist(), w.tolist(), strict=True)))
    index = Index(vectors, np.zeros(700), np.ones(700), list(range(700)), 40)
    dense = np.zeros((700, 40))
    for row, i in enumerate(index.order):
        for t, w in vectors[i].items():
            dense[row, t] = w
    for q in range(0, 700, 7):
        for but in (-1, q):
            places, scores = index.nearest({t: w for t, w in enumerate(dense[q]) if w}, K, but)
            want = dense @ dense[q]
            if but >= 0:
                want[but] = -1
            best = np.sort(want[want > 0])[::-1][:K]
            assert np.allclose(scores, best) and np.allclose(want[places], scores) and len(set(places.tolist())) == len(places)


def corpus(n=500, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [f"{a}{b}" for a, b in ((rng.choice("abcdefgh"), rng.choice("klmnopqrst")) for _ in range(rng.randint(20, 90)))]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(BAD, 2):
                words[rng.randrange(len(words))] = w + rng.choice(["", ".", ","])
        rows.append((i, " ".join(words), "l", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_evidence(spark, tmp_path):
    rows, labels = corpus()
    truth = {i: t for i, _, t in labels}
    docs, marks = frames(spark, rows, labels)
    docs.withColumn("score", F.create_map(F.lit(1), F.lit("x"))).write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op13(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == 500 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    out = [r for r in got.values() if r["held_out"]]
    assert 120 < len(out) < 220 and all(r["predicted"] == truth[r["doc_id"]] for r in out)
    model = fit(docs, marks, ~held_out())
    assert set(model.number) == {w.lower() for w in BAD}
    near = {r["doc_id"]: r["evidence"] for r in toxicity.toxicity(docs, model).collect()}
    assert all(len(near[i]) == (3 if truth[i] else 0) and all(e["label"] == 1 and truth[e["doc_id"]] for e in near[i]) for i in near)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    turned = marks.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, fit(docs, m, ~held_out())).select("doc_id", "score").collect())) for m in (marks, turned))
    assert a == b


def test_odd_tables(spark):
    rows, labels = corpus(300)
    long = " ".join(f"word{'xyz'[i % 3] * (i % 17)}" for i in range(60_000)) + " vilest wretch"
    odd = [(None, "a vilest one and odieux", None, None), (1000, None, None, None), (1001, "", None, None), (1002, long, None, None), (1003, "12 !", None, None), (1003, "12 !", None, None), (0, rows[0][1], None, None)]
    docs, marks = frames(spark, rows + odd, [*labels, (None, 1, 1), (3, 1, None), (4, 1, 1), (4, 1, 0), (9999, 1, 1)])
    model = fit(docs, marks, F.lit(True))
    got = [(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, model).collect()]
    assert len(got) == 307
    by = dict(got)
    assert by[None] > 0.7 and by[1002] > 0.7 and by[1000] == by[1001] == by[1003] == model.none < 0.05 and len({s for i, s in got if i == 0}) == 1
    empty = docs.limit(0)
    assert toxicity.toxicity(empty, fit(empty, marks, F.lit(True))).count() == 0
    for none, want in ((marks.limit(0), 0.0), (marks.filter("toxic = 0"), 0.0), (marks.filter("toxic = 1 AND doc_id <> 4"), 1.0)):
        assert {r["score"] for r in toxicity.toxicity(docs, fit(docs, none, F.lit(True))).collect()} == {want}


def test_equal_texts_have_equal_scores_and_copies_count_once(spark):
    rows, labels = corpus(300)
    many = [(5000 + i, "one text that is there often and has a vilest word") for i in range(400)]
    docs, marks = frames(spark, rows + [(i, t, None, None) for i, t in many], labels + [(i, 1, 0) for i, _ in many])
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, fit(docs, marks, F.lit(True))).collect()}
    assert len({got[i] for i, _ in many}) == 1 and min(got[i] for i in range(0, 300, 5)) > 0.6 > 0.4 > max(got[i] for i in range(1, 300, 5))


def test_without_an_index_all_scores_are_the_same():
    assert Model(0.25).score("any text") == (0.25, [])
