"""Operator 3: removal of long repeated byte strings, by prefix-free parsing.

Every string of LENGTH bytes is judged; a byte goes if a repeated one covers it.

1. Parse. A rolling hash runs over all windows of WINDOW bytes. The trigger of a LENGTH-byte string is the window of
   least hash inside it (the first of equal ones), so equal strings have their trigger at the same place. Strings that
   follow each other and have the same trigger form a phrase: the text from the first byte of the first string to the
   last byte of the last. Phrases overlap by LENGTH - 1 bytes, which makes the parse prefix-free: where a phrase ends
   follows from its bytes alone.
2. Dictionary. Equal phrases are one entry, with the number of times they occur; in highly repetitive text nearly all
   phrases occur more than once, and all their strings are repeated. Counts are combined before the shuffle.
3. Order. What is left are phrases that occur once but share a trigger with other entries. For these entries, and one
   occurrence of each repeated entry with the same trigger, the suffixes are put in order: a suffix of a phrase up to its
   trigger followed by the parse from there, that is by (trigger, distance to it, hash of the string). Suffixes that are
   equal over LENGTH bytes are neighbours in this order, as in a suffix array; hash order replaces the alphabet's, which
   no result depends on.
4. The repeated strings of each text are united into spans and cut out.

`repeated_words` does the same with words in place of bytes, for strings of WORDS words, and counts the words that such
strings cover: a passage of 51 words has some 300 bytes, so a string of LENGTH bytes need not be in it.

The rolling hash is a polynomial modulo 2^64 over randomly mapped bytes, mixed; equality is that of these 64-bit values
together with the trigger's, 128 bits in all.

Defined results: a null text is empty, its digest that of no bytes; texts below LENGTH bytes lose nothing; repeated rows
are documents of their own, so a text of LENGTH bytes or more that occurs twice goes as a whole; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, released, shipped, small, stored, work_folder
from tessera.llm.jaccard import word_hashes
from tessera.llm.tokens import slices

LENGTH, WINDOW = 400, 256
#: A passage of more than 50 words is a repeated one too, though it may have fewer bytes than LENGTH.
WORDS, WORD_WINDOW = 51, 32
#: Strings of a text that are hashed at once.
BLOCK = 1 << 20
#: Triggers with more entries than HOT are ordered in SALTS parts first.
HOT, SALTS = 1000, 64
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int):
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


def _mix(h):
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def units(text: str, of_words: bool = False) -> np.ndarray:
    """A random number for each byte of a text, or for each of its words."""
    data = text.encode("utf-8")
    return word_hashes(data.split()) if of_words else _BYTES[np.frombuffer(data, np.uint8)]


class Rolled:
    """The rolling hashes of one text's units."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = _grown(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.powers[: len(data)], out=self.sums[1:])

    def of(self, start, end):
        """The hashes of the ranges [start, end)."""
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, width: int):
        h = self.sums[width:] - self.sums[:-width]
        return _mix(h * self.inverse[: len(h)])


def _first_least(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the first least hash in each run of w hashes: from running minima of blocks of w, in both directions."""
    n = len(h) - w + 1
    pad = np.concatenate([h, np.full(-len(h) % w, ~_U(0))]).reshape(-1, w)
    column = np.arange(w)
    ahead = np.minimum.accumulate(pad, axis=1)
    lower = np.ones(pad.shape, bool)
    lower[:, 1:] = pad[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(lower, column, 0), axis=1)
    back = pad[:, ::-1]
    behind = np.minimum.accumulate(back, axis=1)
    lower[:, 1:] = back[:, 1:] <= behind[:, :-1]  # of equal ones the first in the text
    behind_at = (w - 1 - np.maximum.accumulate(np.where(lower, column, 0), axis=1))[:, ::-1]
    base = np.arange(len(pad))[:, None] * w
    ahead_at, behind_at = (ahead_at + base).ravel(), (behind_at + base).ravel()
    ahead, behind = ahead.ravel(), behind[:, ::-1].ravel()
    start, end = np.arange(n), np.arange(n) + w - 1
    return np.where(behind[start] <= ahead[end], behind_at[start], ahead_at[end])


def phrases(data: np.ndarray, length: int = LENGTH, window: int = WINDOW):
    """(trigger hash, first string, strings, trigger's distance from the first string, phrase hash) of each phrase of a text.

    Long texts go in blocks of BLOCK strings; a phrase that a block's end cuts is two entries with the same trigger."""
    out, total = [], len(data) - length + 1
    for base in range(0, total, BLOCK):
        r = Rolled(data[base : base + BLOCK + length - 1])
        h = r.all(window)
        at = _first_least(h, length - window + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        end = np.append(first[1:], len(at))
        out.append((h[at[first]], first + base, end - first, at[first] - first, r.of(first, end - 1 + length)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _strings(data: np.ndarray, entries: list, length: int):
    """(place, key, hash) of each string of the entries: the key is that of the trigger and the distance to it."""
    out = []
    entries = sorted(entries, key=lambda e: e["first"])
    while entries:
        base = entries[0]["first"]
        n = next((i for i, e in enumerate(entries) if e["first"] > base + BLOCK), len(entries))
        part, entries = entries[:n], entries[n:]
        first, strings, distance, trigger, salt = (np.array([e[c] for e in part], np.int64) for c in ("first", "strings", "distance", "trigger", "salt"))
        first -= base
        r = Rolled(data[base : base + int((first + strings).max()) + length])
        step = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        at = np.repeat(first, strings) + step
        key = _mix(np.repeat(trigger, strings).view(np.uint64) * _U(0x9E3779B97F4A7C15) + (np.repeat(distance, strings) - step).astype(np.uint64))
        out.append(((at + base).astype(np.int32), key.view(np.int64), r.of(at, at + length).view(np.int64), np.repeat(salt, strings).astype(np.int32)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def parse(docs: DataFrame, length: int, window: int, of_words: bool) -> DataFrame:
    """docs(rid, text) -> rid, trigger, first, strings, distance, phrase."""

    def run(batches):
        names = ["rid", "trigger", "first", "strings", "distance", "phrase"]
        for batch in batches:
            for part, texts in slices(batch, 1):
                rids, out = part.column(0).to_numpy(), []
                for rid, t in zip(rids, texts, strict=True):
                    data = units(t, of_words)
                    if len(data) >= length:
                        trigger, first, strings, distance, phrase = phrases(data, length, window)
                        out.append((np.full(len(first), rid), trigger.view(np.int64), first.astype(np.int32), strings.astype(np.int32), distance.astype(np.int32), phrase.view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    return docs.mapInArrow(run, "rid long, trigger long, first int, strings int, distance int, phrase long")


def _suffixes(texts: DataFrame, length: int, of_words: bool) -> DataFrame:
    """texts(rid, text, entries) -> rid, at, key, string, salt: a row for each string of an entry."""

    def run(batches):
        names = ["rid", "at", "key", "string", "salt"]
        for batch in batches:
            for part, ts in slices(batch, 1, 1 << 20):
                for rid, t, entries in zip(part.column(0).to_pylist(), ts, part.column(2).to_pylist(), strict=True):
                    got = _strings(units(t, of_words), entries, length)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(got[0]), rid, np.int64), *got)], names=names)

    return texts.mapInArrow(run, "rid long, at int, key long, string long, salt int")


def _ordered(suffixes: DataFrame, *by: str) -> DataFrame:
    """The suffixes in order, with n: 0 for one without an equal neighbour, else 1 for the first of equal ones, 2 for others."""
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = suffixes.repartition(parts, *by).sortWithinPartitions(*by)
    columns = ["rid", "at", "key", "string", "salt"]

    def run(batches):
        held = None  # the last row so far, and whether the one before is equal to it
        for b in batches:
            rows = [b.column(b.schema.get_field_index(c)).to_numpy() for c in columns]
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held[0], rows, strict=True)]
            same = np.logical_and.reduce([rows[columns.index(c)][1:] == rows[columns.index(c)][:-1] for c in by])
            before = np.concatenate([[held[1] if held is not None else False], same])
            n = np.where(before, 2, np.concatenate([same, [False]]).astype(int)).astype(np.int32)
            held = [x[-1:] for x in rows], bool(before[-1])
            if len(n) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in (*rows, n)], names=[*columns, "n"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*held[0], np.array([2 * held[1]], np.int32))], names=[*columns, "n"])

    return dealt.mapInArrow(run, "rid long, at int, key long, string long, salt int, n int")


def _neighbours(suffixes: DataFrame, folder: str) -> DataFrame:
    """rid, at of the suffixes that have an equal one.

    Suffixes of hot triggers carry a salt and are first ordered within it; one of each salt then meets those of the others."""
    once = stored(_ordered(suffixes, "key", "string", "salt").filter("n > 0 OR salt > 0"), folder, "ordered")
    across = _ordered(once.filter("salt > 0 AND n < 2").drop("n"), "key", "string").filter("n > 0")
    return once.filter("n > 0").select("rid", "at").unionByName(across.select("rid", "at"))


def repeated_spans(texts: DataFrame, length: int, window: int, folder: str, of_words: bool = False) -> DataFrame:
    """texts(rid, text) -> in_rid, spans: the runs (first, last) of starts of repeated strings, in bytes or in words.

    Rows with one rid are repeated rows: their strings all are repeated ones."""
    spark = texts.sparkSession
    parsed = stored(parse(texts.filter(F.octet_length("text") >= (2 * length - 1 if of_words else length)), length, window, of_words), folder, "parse", dictionary=False)
    often = stored(parsed.groupBy("trigger").agg(F.count("*").alias("n")).filter("n > 1").select("trigger"), folder, "often")
    parsed = stored(parsed.join(small(often, 8), "trigger", "left_semi"), folder, "shared", dictionary=False)
    forget(spark, f"{folder}/parse")
    entry = ["trigger", "distance", "strings", "phrase"]
    entries = stored(parsed.groupBy(*entry).agg(F.count("*").alias("n"), F.min(F.struct("rid", "first")).alias("one")), folder, "dictionary", dictionary=False)
    groups = entries.groupBy("trigger").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1")
    spans = parsed.join(entries.filter("n > 1").select(*entry), entry).select("rid", "first", (F.col("first") + F.col("strings") - 1).alias("last"))
    salt = F.when(F.col("kinds") > HOT, F.pmod("one.rid", F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("int")
    open_ = entries.join(groups, "trigger").select(F.col("one.rid").alias("in_rid"), F.struct(F.col("one.first").alias("first"), "strings", "distance", "trigger", salt.alias("salt")).alias("e"))
    open_ = stored(open_.groupBy("in_rid").agg(F.collect_list("e").alias("entries")), folder, "open")  # an entry names one row, so a text's length bounds them
    found = texts.join(open_.hint("merge"), F.col("rid") == F.col("in_rid")).select("rid", "text", "entries")
    single = _neighbours(_suffixes(found, length, of_words), folder).select("rid", F.col("at").alias("first"), F.col("at").alias("last"))
    spans = spans.unionByName(single).distinct().groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # repeated rows count once, so a text's length bounds them
    spans = stored(spans.select(F.col("rid").alias("in_rid"), F.array_sort("spans").alias("spans")), folder, "spans")
    for name in ("shared", "dictionary", "open", "ordered"):
        forget(spark, f"{folder}/{name}")
    released(spark)
    return spans


def united(spans: list | None, length: int) -> list[list[int]]:
    """The runs [start, end) that the strings of sorted spans cover together."""
    out: list[list[int]] = []
    for x in spans or []:
        if out and x["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["last"] + length)
        else:
            out.append([x["first"], x["last"] + length])
    return out


def _with_spans(docs: DataFrame, length: int, window: int, of_words: bool) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, spans."""
    spark = shipped(docs.sparkSession)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(d.select("rid", "text"), length, window, work_folder(spark), of_words)
    return d.join(spans.hint("merge"), F.col("rid") == F.col("in_rid"), "left").select("doc_id", "text", "spans")


def repeated(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for part, ts in slices(batch, 1):
                rows = []
                for t, s in zip(ts, part.column(2).to_pylist(), strict=True):
                    data, runs = t.encode("utf-8"), united(s, length)
                    edges = [0, *(e for u in runs for e in u), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
                arrays = [part.column(0)] + [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return _with_spans(docs, length, window, False).mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_words(docs: DataFrame, words: int = WORDS, window: int = WORD_WINDOW) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_repeat_words: the words that are covered by a string of so many words that also starts elsewhere."""
    runs = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] + words - F.greatest(a["end"], x["first"]))).cast("long").alias("n"), F.greatest(a["end"], x["last"] + words).cast("long").alias("end")),
    )
    return _with_spans(docs, words, window, True).select("doc_id", F.coalesce(runs["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def op3(spark, sf_dir):
    from tessera.llm.common import table

    return repeated(table(spark, sf_dir, "documents")).drop("kept")
