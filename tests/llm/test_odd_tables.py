"""Every operator on documents with nulls, blank and very long texts, repeated rows and columns of clashing names, and on none."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard, language, lines, mixing, packing, quality, substrings, tokens

CLASHING = ("rid", "sid", "gone", "row", "whole", "token", "key", "cell", "part", "words", "lines", "length", "n", "size", "taken", "piece", "component_id", "_row", "_key", "in_rid", "_ln_all", "entries", "spans")


def odd_rows():
    rng = random.Random(9)
    long = " ".join(f"word{rng.randint(0, 5000)}" for _ in range(40_000)) + "\nand  a last\tline"
    prose = "the thing that is not with this one goes\nand that which was there for all of them stays"
    return [
        (None, "the first text of all has no number but some words", "en", "a"), (None, prose, None, "a"), (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t\n", "de", "b"), (4, long, "en", "b"),
        (5, prose, "en", "b"), (5, prose, "en", "b"), (6, prose + " yes", "en", "c"), (7, "12 345 !", None, "c"), (8, "le thé est là avec les gens de la ville", "fr", "c"), (8, "les uns et les autres sont là", "fr", "c"), (9, "x", "en", "c"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def test_counts_and_packing(odd):
    v = tokens.Vocabulary(tokens.vocabulary_path())
    n = lambda t: len(v.library.encode(t or "", add_special_tokens=False).ids)
    key = lambda x: (x is None, x or 0)
    got = tokens.count_tokens(odd).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=lambda x: (key(x[0]), x[1])) == sorted(((i, n(t)) for i, t, *_ in odd_rows()), key=lambda x: (key(x[0]), x[1]))
    packed = packing.pack(odd).collect()
    assert sum(r["length"] for r in packed) == sum(n(t) + 1 for _, t, *_ in odd_rows()) and {r["doc_id"] for r in packed} == {i for i, *_ in odd_rows()}
    assert tokens.count_tokens(odd.limit(0)).count() == 0 and packing.pack(odd.limit(0)).count() == 0


def test_mix(odd):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == len(odd_rows()) and all(r["taken"] <= 3 * r["size"] for r in got)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and all(r["rid"] == "own rid" and r["part"] == "own part" for r in mixed.collect())
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_sources(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0


def test_matching(odd):
    spans = substrings.repeated(odd).collect()
    assert len(spans) == len(odd_rows()) and {r["n_removed"] for r in spans} == {0}
    near = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(odd).collect()}
    prose = len(jaccard.shingles(odd_rows()[1][1]))
    assert near[None, prose] == near[5, prose] == near[6, prose + 1] == 5 and near[1, 0] == 1 and near[3, 0] == 3 and near[9, 1] == 9
    left = lines.dedup_lines(odd, "total", "removed")
    assert left.columns == [*odd.columns, "total", "removed"]
    by = {(r["doc_id"], r["rid"], r["gone"], r["removed"]) for r in left.collect()}
    assert (None, "own rid", "own gone", 2) in by and (5, "own rid", "own gone", 0) in by and (6, "own rid", "own gone", 2) in by
    for f in (substrings.repeated, jaccard.near_duplicates, lines.dedup_lines):
        assert f(odd.limit(0)).count() == 0


def test_language_and_quality(odd):
    got = language.identify(odd, language.fit(odd)).collect()
    assert len(got) == len(odd_rows()) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 7)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    rules = quality.clean_lines(odd).collect()
    assert len(rules) == len(odd_rows()) and [r["kept"] for r in rules if r["n_words"] < 50] == [False] * (len(rules) - 1)
    assert language.identify(odd.limit(0), language.fit(odd.limit(0))).count() == 0 and quality.clean_lines(odd.limit(0)).count() == 0


def test_rare_scripts_are_letters(spark):
    rows = [(i, "𠀀𠀁𠀂 " * 5, "zh") for i in range(4)] + [(i + 4, "plain words of a language", "en") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(df, language.fit(df)).collect()} == {i: lang for i, _, lang in rows}


@pytest.mark.parametrize("nested", [False, True])
def test_pipeline(spark, odd, tmp_path, nested):
    docs = odd
    if nested:  # maps, arrays and structs ride along, null ones too
        docs = odd.drop(*CLASHING[3:]).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("a", F.array(F.col("lang"), F.lit(None))).withColumn("s", F.struct(F.col("source").alias("x y"), F.create_map(F.lit(1), F.lit(2)).alias("z")))
        docs = docs.withColumn("none", F.when(F.col("doc_id") > 99, F.col("m"))).withColumnRenamed("rid", "a b").withColumn("part", F.lit("own part")).withColumn("rid", F.lit("own rid"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    if nested:
        assert all(r["m"] == {"k": r["doc_id"]} and len(r["a"]) == 2 and r["s"]["z"] == {1: 2} and r["none"] is None and r["a b"] == "own rid" for r in docs.collect())
    kept = {r["doc_id"] for r in docs.collect()}
    assert {4, 5, 8} <= kept <= {None, 4, 5, 6, 8, 9} and corpus_pipeline.STAGES[4][1](spark, docs, "").count() > 0


def test_pipeline_of_no_documents(spark, odd, tmp_path):
    odd.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_stage_equals_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 30))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice(base) + rng.choice(["", "", " more"]) for _ in range(rng.randint(0, 6))), "x") for i in range(60)]
    grams = lambda t: (lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)})(t.split())
    seen, want = [], {}
    for i, text, _ in rows:
        kept = []
        for line in text.split("\n"):
            g = grams(line) if line.split() else None
            if g is None or not any(4 * len(g & h) >= 3 * len(g | h) for h in seen):
                kept.append(line)
            if g is not None:
                seen.append(g)
        if kept == text.split("\n") or "".join(kept).split():
            want[i] = "\n".join(kept)
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, removed string"), "")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want and got.columns == ["doc_id", "text", "removed"]
