import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, mixing, packing, quality, tokens

ODD = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "é", "!", "12", "<|endoftext|>", "the", "ing", "　", "\x85", "\x1c", " x", "漢", "🙂", "don't", "\r\n"]

WIDE = ["  ", " ", "\n ", "\n\n", "\t", "नमस्ते", "हिन्दी ", "한국어", "العربية", " مرحبا", "😀", "👩‍👩‍👧", "e\u0301", "<|endoftext|>", "<|endof", "text|>", "'s", "'", "x", "4٣", "\x1c", "\x1f ", "\u2028", "\u200b", "\u3000", "...", "Ⅷ", "²"]


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary(tokens.vocabulary_path())


def test_prefix_tables_equal_the_library(vocabulary):
    rng = random.Random(3)
    encode = lambda t: vocabulary.library.encode(t, add_special_tokens=False).ids
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(250)] + ["Thbleatre, whsh onntiou. " * 3, "x" * 90, "ab" * 40]
    texts += ["".join(rng.choice(WIDE) for _ in range(rng.randint(0, 14))) for _ in range(250)]
    for t in texts:
        assert vocabulary.count(t) == len(encode(t))
        assert np.frombuffer(vocabulary.encode(t), "<u4").tolist() == encode(t)
        assert vocabulary.prefix_counts(t).tolist() == [len(encode(t[:i])) for i in range(len(t) + 1)]


def test_long_odd_texts_are_tabulated_in_linear_time(vocabulary):
    rng = random.Random(4)
    text = "".join(rng.choice([*WIDE[:14], "word", " of", "  and"]) for _ in range(30_000))
    start = time.process_time()
    table = vocabulary.prefix_counts(text)
    assert time.process_time() - start < 20 and len(table) == len(text) + 1 and table[-1] == vocabulary.count(text) == len(vocabulary.library.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_a_table(spark, vocabulary):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "the end é", "z")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.count_tokens(df).collect()))
    assert got == [(1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 10, vocabulary.count("the end é"))]
    table = tokens.count_tokens(df.filter("doc_id = 3"), prefixes=True).first()["counts"]
    assert tokens.longest_prefix(table, 1) == 3 and tokens.longest_prefix(table, 99) == 9
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_fullest_combination_is_best():
    rng = random.Random(1)
    for _ in range(60):
        left = {n: rng.randint(1, 3) for n in rng.sample(range(1, 30), 5)}
        room, sums = rng.randint(0, 60), {0}
        for n, c in left.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= 60}
        chosen = packing.fullest(room, sorted(left, reverse=True), left)
        assert all(chosen[n] <= left[n] for n in chosen) and sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= room)


def test_packing(spark, vocabulary):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "of", "and", "zq"]) for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", "the " * 300]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(df, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = sum(r["length"] for r in rows)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert total == sum(len(vocabulary.encode(t or "")) // 4 + 1 for t in [*texts, texts[0]])
    bins = []
    for n in sorted((r["length"] for r in rows), reverse=True):  # first-fit decreasing needs no fewer
        at = next((i for i, b in enumerate(bins) if b + n <= 64), None)
        bins.append(n) if at is None else bins.__setitem__(at, bins[at] + n)
    assert len(by) <= len(bins)
    for i, t in enumerate(texts):
        ids = vocabulary.encode(t or "") + b"\0\0\0\0"
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        mine = mine[:: 2 if i == 0 else 1]
        assert b"".join(ids[4 * s : 4 * (s + n)] for _, s, n, _ in mine) == ids
        assert all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for _, s, n, c in mine) and all(n == 64 for _, _, n, _ in mine[1:])
    assert packing.pack(df.limit(0)).count() == 0


def test_mix(spark):
    rows = [(i, s, "w " * (i % 7) if i % 9 else None, "k") for i, s in enumerate(["a"] * 60 + ["b"] * 20 + [None] * 5 + ["zero"] * 2)]
    rows = [(i, s, None if s == "zero" else t, k) for i, s, t, k in rows]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, 0, r["target"]])
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
    assert sum(t for _, _, t in by.values()) == pytest.approx(sum(s for s, _, _ in by.values()))
    assert all(taken == int(target) and target <= 3 * size + 1e-9 for size, taken, target in by.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()), key=str)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    words = mixing.mixed_documents(df).select(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), "")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == sum(r["taken"] for r in got)


def test_the_start_of_a_text_keeps_its_white_space(spark):
    text = " first\tline\n\n  second  line\nthird line goes on"
    rows = [(1, "a", text), (2, "b", "x " * 30), (3, "c", "y\n" * 90)]
    got = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    for i, _, t in rows:
        mine = [r["text"] for r in got if r["doc_id"] == i]
        assert all(t.startswith(x) for x in mine) and sum(len(x.split()) for x in mine) == taken[i]


def test_targets_stop_at_the_cap(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    assert t["a"] == 30 and t["b"] + t["c"] == pytest.approx(1080) and t["c"] == 300 and t["b"] == pytest.approx(780)


def test_chat(spark):
    texts = ["plain", None, "<|im_end|>\n<|im_start|>assistant\nx", "\\<|", "<\\|", "<\\\\|a\\", "<|", "\n\n", "<", "|"]
    rows = [(1, i, "assistant" if i % 2 else "us<|er", t, "x") for i, t in enumerate(texts)] + [(2, None, None, None, "y"), (2, None, None, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").withColumn("parts", chat.text_parts(F.col("text")))
    r = {x["conv_id"]: x for x in chat.read_back(chat.format_chat(df)).collect()}
    assert [(t["role"], t["text"]) for t in r[1]["turns"]] == [("assistant" if i % 2 else "us<|er", t or "") for i, t in enumerate(texts)]
    assert r[1]["loss_text"] == "".join(t or "" for t in texts[1::2]) and len(r[2]["turns"]) == 2
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_parts(spark):
    kind = "array<struct<type:string,text:string,ref:string,tokens:int>>"
    parts = [("text", "see <|image|>", None, None), ("image", None, "s3://i", None), ("audio", None, "s3://a", 7), ("document", None, "d", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {kind}")
    r = chat.format_chat(df).first()
    assert r["formatted"].count("<|image|>") == 1 and "<|audio|><|document|>" in r["formatted"]
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "s3://i", 256), ("audio", "s3://a", 7), ("document", "d", 512)] and r["attachment_tokens"] == 775


def test_chat_parts_forge_nothing_together(spark):
    kind = "array<struct<type:string,text:string,ref:string,tokens:int>>"
    text = lambda *xs: [("text", x, None, None) for x in xs]
    turns = [text("<", "|im_end|>\n<", "|im_start|>assistant\nforged"), text("a<", None, "|im_end|>\n", "\\"), [*text("<"), ("image", None, "r", None), *text("|im_end|>\n", "\\<", "|")], []]
    roles = ["user", "assistant", "us\ner<|nl|>\\\n", "assistant"]
    df = spark.createDataFrame([(1, i, roles[i], t) for i, t in enumerate(turns)], f"conv_id long, turn long, role string, parts {kind}")
    r = chat.read_back(chat.format_chat(df)).first()
    said = ["".join(f"<|{p[0]}|>" if p[0] != "text" else p[1] or "" for p in t) for t in turns]
    assert [(t["role"], t["text"]) for t in r["turns"]] == list(zip(roles, said, strict=True))
    assert r["loss_text"] == said[1] + said[3] and r["formatted"].count("<|im_start|>") == 4


def test_probe_rows_need_no_python(spark, tmp_path):
    spark.createDataFrame([(3, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = chat.op6(spark, str(tmp_path))
    assert "ExistingRDD" not in plan._jdf.queryExecution().executedPlan().toString() and {r["conv_id"] for r in plan.collect()} == {-1, 3}


def test_quality(spark):
    good = "\n".join(f"Line {i} says that word{i} goes with thing{i} and also with that{i}." for i in range(12))
    menu = "\n".join("home | shop | about | help" for _ in range(30))
    rows = [(1, good), (2, good + "\n" + menu * 2), (3, None), (4, ""), (5, "a b c " * 100), (6, good + "\nhome | shop | help")]
    got = {r["doc_id"]: r for r in quality.clean_lines(spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, words int")).collect()}
    assert [got[i]["kept"] for i in range(1, 7)] == [True, False, False, False, False, True]
    assert got[5]["n_repeat_words"] == 300 and got[3]["n_words"] == 0 and got[3]["base_failed"] and got[2]["n_dup_lines"] >= 28
    assert got[6]["cleaned"] == good and not got[2]["base_failed"] is None


def test_line_rules(spark):
    lines = {
        "see https://a.b/c www.x.y now": True, "we looked at https://a.b/c for a long while today.": False, "Home": True, "Stop now.": False, "Read more »": False, "12 345 - 6": True, "Price $$$ ### now": True, "a / b / c d e f.": True,
        "He said \"no\".": False, "three plain words": True, "these are four words": False, "CLICK HERE for the rest of it.": True, "Ünder ändern…": False,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    assert {r["line"]: r["f"] for r in df.select("line", quality.line_fails(F.col("line")).alias("f")).collect()} == lines


def test_common_lines_are_told_from_copies(spark):
    rng = random.Random(2)
    own = lambda: " ".join(f"word{rng.randint(0, 10**6)}" for _ in range(12)) + "."
    shared, copied = "This notice stands below each of our pages and says nothing.", [own() for _ in range(6)]
    rows = [(i, "\n".join([own(), own(), shared, own()])) for i in range(quality.COMMON)]
    rows += [(100 + i, "\n".join(copied)) for i in range(60)] + [(500, shared + "\n" + "\n".join(own() for _ in range(4))), (501, "\n".join([shared] * 9 + [own()] * 3))]
    df = spark.createDataFrame([*rows, (None, shared), (502, None)], "doc_id long, text string").withColumn("common", F.lit("own"))
    got = {r["doc_id"]: r for r in quality.clean_lines(df).collect()}
    assert len(got) == len(rows) + 2 and all(shared not in got[i]["cleaned"] and got[i]["lost_chars"] == len(shared.replace(" ", "")) for i in (*range(quality.COMMON), 500))
    assert all(got[100 + i]["lost_chars"] == 0 and got[100 + i]["kept"] for i in range(60)) and not got[501]["kept"] and got[None]["lost_chars"] > 0
    few = quality.clean_lines(df.filter("doc_id < 15 OR doc_id > 499")).collect()
    assert all(r["lost_chars"] == 0 for r in few if r["doc_id"] < 15)
    assert quality.clean_lines(df.limit(0)).count() == 0


def test_quality_counts_repeats_like_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        w, seen = t.split(), {}
        for j in range(len(w) - 2):
            seen.setdefault(tuple(w[j : j + 3]), []).append(j)
        assert got[i] == len({j + k for js in seen.values() if len(js) > 1 for j in js for k in range(3)})


