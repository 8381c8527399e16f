import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import runs


def brute(words):
    """All runs, from the definition."""
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items()), [i for i in range(n) if not any(s + q <= i < s + m for (s, m), q in out.items())]


def made_texts():
    rng = random.Random(4)
    word = lambda k: f"w{rng.randint(0, k)}"
    fib = ["a", "b"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(128))
    texts = [" ".join(fib[-1]), " ".join(thue), " ".join("a" * 200), " ".join("ab" * 60) + " c " + " ".join("ab" * 60)]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            block = [word(rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 20))]
            parts += (block * rng.randint(1, 6))[: rng.randint(1, 80)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return texts


def test_runs_equal_brute_force(spark):
    rows = [*enumerate(made_texts()), (900, None), (901, ""), (902, " \n "), (902, " \n "), (None, "é " * 30), (903, "x y " * 20), (904, "one two")]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, text in rows:
        w = [x.decode() for x in (text or "").encode().split()]
        found, stays = brute(w)
        want.append((i, found, " ".join(w[j] for j in stays)))
    assert sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str) == sorted(want, key=str)
    assert max(len(x[1]) for x in want) > 10


def test_blocks_and_many_equal_words(monkeypatch):
    ids, sizes = np.zeros(60_000, np.int64), np.array([0, 30_000, 11, 29_989], np.int64)
    assert runs.find_runs(ids, sizes).T.tolist() == [[0, 30_000, 1], [30_011, 60_000, 1]]
    rng = np.random.default_rng(1)
    ids, sizes = rng.integers(0, 2, 3000), np.array([1000, 1, 1999], np.int64)
    whole = runs.find_runs(ids, sizes)
    monkeypatch.setattr(runs, "BLOCK", 7)
    assert (runs.find_runs(ids, sizes) == whole).all() and whole.shape[1] > 20


def test_hashes_that_err_are_found_out():
    class Erring(runs.Prefixes):
        def __init__(self, ids, seed):
            super().__init__(ids, seed)
            if seed < 3:
                self.sums[:] = 0

    ids = np.tile(np.arange(9), 30) % np.array([3] * 100 + [9] * 170)
    assert (runs.find_runs(ids, np.array([len(ids)]), Erring) == runs.find_runs(ids, np.array([len(ids)]))).all()


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 120)))) for i in range(300)] + [(7, None), (None, "a " * 20), (12345, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("own")).withColumn("h", F.create_map(F.lit("a"), F.lit(1)))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found, stays = brute(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w[j] for j in stays))))
    got = runs.op11(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(x[1] > 0 for x in want) > 15
    assert runs.periodic_runs(df.limit(0)).count() == 0 and runs.digests(runs.periodic_runs(runs.looped(df.limit(0)))).count() == 0
