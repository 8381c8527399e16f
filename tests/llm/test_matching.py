import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, lines, neighbours, substrings
from tessera.llm.components import components


def brute_strings(rows, n):
    seen = collections.Counter(t[j : j + n] for _, x in rows for t in [(x or "").encode()] for j in range(len(t) - n + 1))
    out = []
    for i, x in rows:
        t = (x or "").encode()
        m = np.zeros(len(t), np.int8)
        for j in range(len(t) - n + 1):
            if seen[t[j : j + n]] > 1:
                m[j : j + n] = 1
        edges = np.diff(np.concatenate([[0], m, [0]]))
        out.append((i, len(t), int(m.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[m == 0])).hexdigest()))
    return sorted(out)


def brute_words(rows, n):
    texts = [(i, (x or "").encode().split()) for i, x in rows]
    seen = collections.Counter(tuple(w[j : j + n]) for _, w in texts for j in range(len(w) - n + 1))
    return sorted((i, len({j + k for j in range(len(w) - n + 1) if seen[tuple(w[j : j + n])] > 1 for k in range(n)})) for i, w in texts)


@pytest.mark.parametrize("hot, block", [(1000, 1 << 20), (2, 16)])
def test_repeated_strings(spark, monkeypatch, hot, block):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(hot)
    rows = [(i, "".join(rng.choice(["ab", "a", "ba", "é"]) for _ in range(rng.randint(0, 60)))) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "a" * 150), (103, "a" * 60), (104, "ab" * 50), (105, rows[0][1]), (105, rows[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rid string")
    if block < 1 << 20:
        monkeypatch.setattr(substrings, "BLOCK", block)
    rows += [(200 + i, " ".join(rng.choice(["p", "q", "rr"]) for _ in range(40))) for i in range(12)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rid string")
    out = substrings.repeated(df, 20, 12).collect()
    assert sorted(tuple(r[:5]) for r in out) == brute_strings(rows, 20)
    assert sorted((r["doc_id"], r["n_repeat_words"]) for r in substrings.repeated_words(df, 7, 4).collect()) == brute_words(rows, 7)


def test_no_strings_in_an_empty_table(spark):
    assert substrings.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_equal_union_find(spark, tmp_path):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    least = {n: n for x in links for n in x}
    for _ in range(100):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), str(tmp_path), "c").collect()}
    assert got == {n: least[n] for n in least if any(n in x and x[0] != x[1] for x in links)}


def copies(rng, n):
    """Texts with exact and near copies: some words of a text are replaced."""
    out = []
    while len(out) < n:
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 90))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(words))
    return out[:n]


@pytest.mark.parametrize("many", [0, 1000])
def test_jaccard_join(spark, monkeypatch, many):
    monkeypatch.setattr(jaccard, "MANY", many)
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    rng = random.Random(8)
    rows = list(enumerate(copies(rng, 150))) + [(200, None), (201, " \n"), (202, "One two"), (203, "one TWO"), (204, "one two three"), (7, None)]
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k in range(len(sets)):
        least[find(k)] = min(least.get(find(k), 10**9), sets[k][0])
    expected = sorted((sets[k][0], len(sets[k][1]), least[find(k)]) for k in range(len(sets)))
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == expected


def test_open_pairs_meet_once(spark, tmp_path):
    """Of sets that share runs of tokens, each pair that may match is met once a run, not once a token."""
    rng = random.Random(31)
    sets = {i: [*range(30), *rng.sample(range(100, 140), 30 + i % 3), *range(1000 + 90 * i, 1040 + 90 * i)] for i in range(20)}
    rows = [(t, i, len(s), len(s) - k, len(s), i // 2) for i, s in sets.items() for k, t in enumerate(sorted(s)) if t < 1000]
    x = spark.createDataFrame(rows, "token long, sid long, n int, left int, rest int, comp long")
    y = x.select("token", *[F.col(c).alias(f"l_{c}") for c in ("sid", "n", "left", "rest", "comp")])
    every = x.join(y, "token").filter((F.col("sid") < F.col("l_sid")) & (F.col("comp") != F.col("l_comp")) & jaccard.possible()).select("sid", "l_sid")
    got = jaccard._meetings(x, str(tmp_path)).collect()
    assert set(map(tuple, got)) == set(map(tuple, every.collect())) and len(set(got)) == 180
    assert len(got) < 3 * len(set(got)) and every.count() > 10 * len(set(got))


def grown(rng, sizes):
    """Texts as (words, variants, added): a base, and its variants with own words added behind it."""
    word = lambda: f"v{rng.randint(0, 10**9)}"
    out = []
    for words, variants, added in sizes:
        base = [word() for _ in range(words)]
        out += [" ".join(base)] + [" ".join(base + [word() for _ in range(added)]) for _ in range(variants)]
    return out


def linked_pairs(texts):
    """All pairs (a, b), a < b, of similarity 0.75 or more, counted over an index of the n-grams."""
    words = [t.lower().split() for t in texts]
    grams = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    where, overlap = collections.defaultdict(list), collections.Counter()
    for i, g in enumerate(grams):
        for x in g:
            overlap.update((j, i) for j in where[x])
            where[x].append(i)
    return [(a, b) for (a, b), n in overlap.items() if 4 * n >= 3 * (len(grams[a]) + len(grams[b]) - n)]


def least_of_components(texts):
    least, links = list(range(len(texts))), linked_pairs(texts)
    before = None
    while before != least:
        before = list(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def with_added_words(rng, n):
    """n pairs of a text of 1 to 400 words and the same with words put in front, behind or inside; some hold a common phrase."""
    word = lambda: f"v{rng.randint(0, 10**9)}"
    phrase, out = "all rights are kept by those who wrote this".split(), []
    for _ in range(n):
        base = [word() for _ in range(int(400 ** rng.random()))] + phrase * (rng.random() < 0.1)
        more = list(base)
        where = rng.choice(["front", "behind", "inside", "anywhere"])
        inside = rng.randint(0, len(base))
        for _ in range(rng.randint(0, 2 + len(base) // 3)):
            more.insert({"front": 0, "behind": len(more), "inside": inside, "anywhere": rng.randint(0, len(more))}[where], word())
        out += [" ".join(x) for x in rng.sample([base, more], 2)]
    return out


def test_no_link_of_texts_with_added_words_is_lost(spark):
    texts = with_added_words(random.Random(11), 2000)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = least_of_components(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w < i for i, w in enumerate(want)) > 600


def test_no_line_with_added_words_is_lost(spark):
    texts = with_added_words(random.Random(12), 2000)
    rows = [(i, "\n".join(texts[4 * i : 4 * i + 4])) for i in range(len(texts) // 4)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {b for _, b in linked_pairs(texts)}
    assert got == {i: "\n".join(t for k, t in enumerate(texts[4 * i : 4 * i + 4], 4 * i) if k not in gone) for i, _ in rows} and len(gone) > 600


def test_no_line_goes_without_an_earlier_match(spark):
    word = [f"v{i}" for i in range(60)]
    chain = [" ".join(word[k : k + 24]) for k in (2, 4, 0)]  # 20 n-grams each: the first and last share 18, 18 and 16
    df = spark.createDataFrame([(1, chain[2], 0), (2, chain[1], 0), (3, chain[0], 0)], "doc_id long, text string, _ln_gone int")
    assert linked_pairs(chain) == [(0, 1), (0, 2)]
    got = lines.dedup_lines(df)
    assert {r["doc_id"]: r["_ln_gone"] for r in got.collect()} == {1: 0, 2: 0, 3: 1} and got.columns == ["doc_id", "text", "_ln_all", "_ln_gone"]


def test_lines_of_odd_tables(spark):
    long = "\n".join(f"line {i} of a text with very many lines says {i * 7919} times that" for i in range(3000))
    rows = [(None, "a\tb\u000bc\rd e"), (7, "a b c d e"), (7, "a b c d e"), (7, "x"), (8, long), (9, long + "\nA  B\tc d E"), (10, "\n\n"), (11, "y " * 9000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, rid string")
    got = {(r["doc_id"], r["text"], r["_ln_all"], r["_ln_gone"]) for r in lines.dedup_lines(df).collect()}
    assert got == {(None, "", 1, 1), (7, "a b c d e", 1, 0), (7, "x", 1, 0), (8, long, 3000, 0), (9, "", 3001, 3001), (10, "\n\n", 3, 0), (11, "y " * 9000, 1, 0)}


#: n-grams of a base and of its variants at 0.75 to 0.85: 80 in 94 to 106; added ones are rarer (8 variants) or as rare (1).
UNEQUAL = [(84, variants, added) for variants in (8, 1, 1, 1) for added in (15, 20, 26)]


def test_jaccard_join_of_contained_texts(spark):
    texts = grown(random.Random(5), UNEQUAL)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == least_of_components(texts)


def test_prefix_tree():
    rng = np.random.default_rng(1)
    base = np.sort(rng.choice(10**6, 60, replace=False))
    sets = [np.sort(np.concatenate([np.delete(base, rng.choice(60, k, replace=False)), rng.choice(10**6, k)])) for k in range(0, 14)] + [base[:1], base[:45]]
    probe = base
    want = {i: len(np.intersect1d(s, probe)) for i, s in enumerate(sets) if 7 * len(np.intersect1d(s, probe)) >= 3 * (len(s) + len(probe))}
    assert dict(jaccard.PrefixTree(list(range(len(sets))), sets).overlaps(probe)) == want


def test_line_dedup(spark):
    a = "this is the first long line of the text with some more words in it"
    rows = [(1, f"{a}\nshort one\n\n{a}"), (2, f"new words stand here\n{a} too\nSHORT ONE"), (3, None), (4, ""), (5, f"{a}\nlast"), (None, "last\nown"), (6, "x\ny"), (6, "x\ny")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, pos int")
    got = sorted(((r["doc_id"], r["text"], r["_ln_all"], r["_ln_gone"]) for r in lines.dedup_lines(df).collect()), key=str)
    want = [(1, f"{a}\nshort one\n", 4, 1), (2, "new words stand here", 3, 2), (3, None, 0, 0), (4, "", 1, 0), (5, "last", 2, 1), (None, "own", 2, 1), (6, "x\ny", 2, 0), (6, "x\ny", 2, 0)]
    assert got == sorted(want, key=str)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_lines_with_words_behind(spark):
    texts = grown(random.Random(6), [(12, variants, 2) for variants in (8, 1, 1, 1, 1, 1, 1)] + [(16, variants, 3) for variants in (8, 1, 1, 1, 1, 1, 1)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["_ln_gone"] for r in lines.dedup_lines(df).collect()}
    gone = {b for _, b in linked_pairs(texts)}
    assert [got[i] for i in range(len(texts))] == [int(i in gone) for i in range(len(texts))]


def test_languages(spark):
    words = {"en": "the of and thing with that", "de": "der die und nicht schön über", "fr": "le des être où leçon avec", "es": "los que niño señor para así"}
    rng = random.Random(3)
    rows = []
    for i in range(200):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang))
    rows += [(900, None, "en"), (901, "12 !", "en"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(df, language.fit(df.filter(~language.held_out()))).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:200]) >= 198
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.fit(df.filter("false")) is None and {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}


def test_the_driver_gets_a_sample_of_counts(spark, monkeypatch):
    """The sample reaches the driver as packed counts, and one matrix of it is held."""
    import tracemalloc

    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh" if i % 2 else "efghijkl") for _ in range(rng.randint(2, 7))) for _ in range(60)), "en" if i % 2 else "fr") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = language.fit(df)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.5 * 1200 * language.FEATURES * 4
    lang, _ = model.predict(np.array([language.features(t) for _, t, _ in rows]))
    assert sum(a == r[2] for a, r in zip(lang, rows, strict=True)) >= 1190


def test_neighbours(spark, monkeypatch):
    for name, value in (("LEAF", 64), ("PART", 50), ("SAMPLE", 700)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 8))).astype(np.float32)
    x[:300] = x[0]  # a third is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0]), (None, x[1].tolist()), (2004, [None] * 8)]
    got = neighbours.search(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, leaf int"), F.col("vec_id") % 20 == 0).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    y, hits = x.astype(np.float64), 0
    for q in range(0, 900, 20):
        s = np.cumsum(y * y[q], axis=1)[:, -1]
        s[q] = -np.inf
        true = np.lexsort((np.arange(900), -s))[:20]
        assert len(found[q]) == 20 and all(score == pytest.approx(s[v], abs=1e-12) for v, score in found[q])
        assert [v for v, _ in found[q]] == [v for v, _ in sorted(found[q], key=lambda p: (-p[1], p[0]))]
        hits += len({v for v, _ in found[q]} & set(true.tolist()))
    assert hits >= 0.9 * 45 * 20 and len(found) == 45


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def shuffled(spark) -> int:
    """Bytes of shuffle that this context has written so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_a_query_is_sent_once_for_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 8)
    x = np.random.default_rng(3).normal(size=(4000, 32)).astype(np.float32)  # without clusters: most leaves are visited
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    before = shuffled(spark)
    assert neighbours.search(df, F.col("vec_id") % 20 == 0).count() == 200 * 20
    assert shuffled(spark) - before < 4 * x.nbytes


def test_short_lines_are_shuffled_once_for_both_sides(spark, tmp_path):
    posts = lines.stored(spark.createDataFrame([(t, t % 9, 5, 5, 5) for t in range(40)], "token long, sid long, n int, left int, rest int"), str(tmp_path), "posts")
    sets = lines.stored(spark.createDataFrame([(i, i, [i, i + 1]) for i in range(9)], "sid long, place long, tokens array<long>"), str(tmp_path), "sets")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = lines._short_matches(posts, sets)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sum("Exchange hashpartitioning(token" in x and "ReusedExchange" not in x for x in plan) == 1


def test_tables_of_hashes_are_not_compressed(spark, monkeypatch, tmp_path):
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(lines, "forget", lambda *a: None)
    df = spark.createDataFrame([(i, f"a b c d e f g {i}\none more line of words {i % 3}") for i in range(30)], "doc_id long, text string")
    lines.later_lines(df, str(tmp_path))
    for name, kind in (("tokens", "UNCOMPRESSED"), ("entries", "UNCOMPRESSED"), ("lines", "ZSTD")):
        found = [pq.ParquetFile(p).metadata for p in glob.glob(f"{tmp_path}/{name}/*.parquet")]
        assert {m.row_group(0).column(0).compression for m in found if m.num_rows} == {kind}, name


def test_long_lines_are_shuffled_in_line_with_their_length(spark):
    def pair(n, seed):
        rng = random.Random(seed)
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
        changed = list(words)
        for i in range(0, n, 90):  # a word in ninety: some 0.9 of similarity
            changed[i] = "other"
        worse = list(words)
        for i in range(0, n, 22):  # below 0.75
            worse[i] = "else"
        return [" ".join(words), " ".join(changed), " ".join(worse)]

    written = {}
    for n in (4000, 16000, 64000):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(pair(n, n))], "doc_id long, text string").repartition(3)
        before = shuffled(spark)
        got = {r["doc_id"]: r["_ln_gone"] for r in lines.dedup_lines(df).collect()}
        written[n] = shuffled(spark) - before
        assert got == {0: 0, 1: 1, 2: 0}, n
    assert written[64000] < 5 * written[16000] < 25 * written[4000] and written[64000] < 40e6, written


@pytest.mark.parametrize("long", [3, 40])
def test_crowds_of_template_lines_equal_brute_force(spark, monkeypatch, long):
    """Lines of shared parts, many below 0.75 with the earliest of their n-grams and above it with another one."""
    monkeypatch.setattr(lines, "LONG", long)
    rng = random.Random(long)
    parts = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(8)]
    rows = [(i, " ".join(sorted(rng.sample(parts, rng.randint(4, 7)))) + rng.choice(["", " end", " one more end"])) for i in range(150)]
    grams = lambda t: (lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)})(t.split())
    sets = [grams(t) for _, t in rows]
    want = {i: int(any(4 * len(sets[i] & sets[k]) >= 3 * len(sets[i] | sets[k]) for k in range(i))) for i in range(150)}
    got = {r["doc_id"]: r["_ln_gone"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 0 < sum(want.values()) < 150


def test_prefixes_of_lines_are_plain_integers(spark, tmp_path):
    from tessera.llm import lines

    spark.createDataFrame([([5, 3 << 40, 7],)], "tokens array<bigint>").write.parquet(f"{tmp_path}/tokens")
    keys = spark.read.parquet(f"{tmp_path}/tokens").select(lines._keys([0] * 7 + [1] + [0] * (lines.BUCKETS - 8)).alias("keys"))
    assert not keys.schema["keys"].dataType.containsNull and keys.first()["keys"] == [5, 3 << 40, (1 << lines.HASH_BITS) | 7]


def test_lines_in_company_keep_their_n_grams(spark):
    from tessera.llm import lines

    rare, lone, heavy = 77, 78, (lines.HEAVY << lines.HASH_BITS) | 77
    rows = [(rare, -9, 300, 2), (rare, 4, 3, 0), (lone, 4, 3, 1), (heavy, -9, 300, 75), (heavy + 1, 130, 1, 0)]
    found = lines._with_company(spark.createDataFrame(rows, "token long, sid long, n int, pos int"))
    assert sorted(map(tuple, found.collect())) == sorted(x for x in rows if x[0] != lone) and found.dtypes[2:] == [("n", "int"), ("pos", "int")]
