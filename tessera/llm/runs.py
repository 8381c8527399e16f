"""Operator 11: periodic runs of words, by a harmonic grid of longest common extensions.

A run is a stretch of words with smallest period q, at least twice as long as q and at least LEAST words, that can't be
extended on either side. For each period p a grid point stands at every multiple of p; a run of period p matches itself p
words on over at least p neighbouring places, so one of them is a grid point. All pairs (period, grid point) of a slice of
documents are worked on at once:

1. Words get numbers of their own (exactly, no hashes); prefix sums of number times power, modulo 2^64, hash every stretch.
2. Pairs whose words differ go; so do pairs that the grid point before covers, and those with too short extensions.
3. Binary searches over the prefix hashes, one step for all pairs together, give the common extensions to both sides.
4. The same stretch found by several periods is kept with the smallest. The words of every run kept are compared; should a
   hash have erred, the slice is worked on again with other hashes.

There are n/1 + n/2 + ... pairs, so time grows as n log n; pairs are dealt in blocks of BLOCK, so memory grows with the text alone.
Documents stand apart: nothing is shuffled, a lost executor's files are simply read again.

Defined results: a null, blank or short text has no runs; its words (none, for null) are returned joined by one space; every
row gives one row, repeated ids and rows too; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shipped, table, words_of
from tessera.llm.tokens import slices

LEAST, BLOCK, SLICE = 12, 1 << 20, 2 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Prefixes:
    """Hashes of all stretches of a row of numbers, and common extensions of pairs (i, i + p)."""

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        value = rng.integers(1, 1 << 64, int(ids.max(initial=0)) + 1, np.uint64)
        self.power = np.full(len(ids) + 1, rng.integers(1 << 62, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(value[ids] * self.power[:-1], out=self.sums[1:])

    def same(self, i, p, n):
        """Whether the n words from i on are those from i + p on."""
        h = self.sums
        return (h[i + n] - h[i]) * self.power[p] == h[i + p + n] - h[i + p]

    def extension(self, i, p, most, back: bool):
        """The largest n up to `most` for which the n words from i on (or those before i) are those p words further on."""
        low, high = np.zeros_like(most), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            n = (low + high + 1) // 2
            fits = self.same(i - n if back else i, p, n)
            low, high = np.where(fits, n, low), np.where(fits, high, np.maximum(n - 1, low))
        return low


def _pairs(starts: np.ndarray, sizes: np.ndarray):
    """(place, period, document's start, document's end) of all grid points, in blocks."""
    long = np.flatnonzero(sizes >= LEAST)
    half = sizes[long] // 2
    doc = np.repeat(long, half)
    period = np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(half) - half, half)
    points = (sizes[doc] - 1) // period
    upto = np.concatenate([[0], np.cumsum(points)])
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, side="right")) - 1)
        many = points[at:to]
        p, first = np.repeat(period[at:to], many), np.repeat(starts[doc[at:to]], many)
        k = np.arange(upto[to] - upto[at]) - np.repeat(upto[at:to] - upto[at], many)
        yield first + k * p, p, first, np.repeat((starts + sizes)[doc[at:to]], many)
        at = to


def _candidates(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, x: Prefixes):
    """(start, end, period) of runs, in arrays; the same stretch may occur with multiples of its period."""
    for i, p, first, end in _pairs(starts, sizes):
        keep = np.flatnonzero(ids[i] == ids[i + p])
        i, p, first, end = i[keep], p[keep], first[keep], end[keep]
        covered = i - p >= first
        covered[covered] = x.same(i[covered] - p[covered], p[covered], p[covered])
        least = np.maximum(p, LEAST - p)  # how many neighbouring places match themselves p words on
        ahead, behind = (least + 1) // 2, least // 2 + 1
        right, left = i + p + ahead <= end, i - behind >= first
        right[right] = x.same(i[right], p[right], ahead[right])
        left[left] = x.same(i[left] - behind[left], p[left], behind[left])
        keep = np.flatnonzero(~covered & (right | left))
        if not len(keep):
            continue
        i, p, first, end, least = i[keep], p[keep], first[keep], end[keep], least[keep]
        f, b = x.extension(i, p, end - i - p, False), x.extension(i, p, np.minimum(p - 1, i - first), True)
        keep = np.flatnonzero(f + b >= least)
        yield np.stack([(i - b)[keep], (i + p + f)[keep], p[keep]])


def _distinct(found: np.ndarray) -> np.ndarray:
    """Columns of found, by start and end: of each stretch the smallest period."""
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = (found[:2, 1:] != found[:2, :-1]).any(0)
    return found[:, new]


def _verified(ids: np.ndarray, runs: np.ndarray) -> bool:
    """Whether every word of every run is the one a period further on."""
    size = runs[1] - runs[0] - runs[2]
    upto = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, side="right")) - 1)
        i = np.arange(upto[to] - upto[at]) + np.repeat(runs[0, at:to] - (upto[at:to] - upto[at]), size[at:to])
        if (ids[i] != ids[i + np.repeat(runs[2, at:to], size[at:to])]).any():
            return False
        at = to
    return True


def find_runs(ids: np.ndarray, sizes: np.ndarray, prefixes=Prefixes) -> np.ndarray:
    """ids: the numbered words of documents of the given sizes, one after the other -> start, end, period of all runs, by start, then period."""
    starts = np.cumsum(sizes) - sizes
    for seed in itertools.count(1):
        x = prefixes(ids, seed)
        runs = np.zeros((3, 0), np.int64)
        for some in _candidates(ids, starts, sizes, x):
            runs = _distinct(np.concatenate([runs, some], axis=1))
        if _verified(ids, runs):
            return runs[:, np.lexsort((runs[2], runs[0]))]


def _of_texts(texts: list[str]):
    """Of each text: the runs, as a column, and the text that is left without the repetitions of each run's first period."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes are split at ASCII white space
    sizes = np.array([len(w) for w in words], np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
    start, end, period = find_runs(ids, sizes)
    firsts = np.cumsum(sizes) - sizes
    repeats = np.zeros(len(ids) + 1, np.int64)
    np.add.at(repeats, start + period, 1)
    np.add.at(repeats, end, -1)
    stays = np.cumsum(repeats)[:-1] == 0
    left = [b" ".join(w if stays[a : a + n].all() else itertools.compress(w, stays[a : a + n].tolist())) for w, a, n in zip(words, firsts.tolist(), sizes.tolist(), strict=True)]
    offsets = np.searchsorted(start, np.append(firsts, len(ids)))
    of = np.searchsorted(firsts, start, side="right") - 1  # empty documents share their start with the next; the last of them holds the run
    runs = pa.StructArray.from_arrays([pa.array(v) for v in (start - firsts[of], end - start, period)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array([x.decode("utf-8", "surrogatepass") for x in left], pa.string())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, runs (start, length, period of each, by start, then period), collapsed (the words without repetitions, joined by one space)."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    shipped(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, 1, SLICE):
                runs, left = _of_texts(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), runs, left], names=["doc_id", "runs", "collapsed"])

    return d.mapInArrow(run, f"doc_id {kind}, runs array<{RUN}>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with loops put into a tenth of the texts: those whose id's checksum h has h % 10 = 0 and that have words.

    With g = h / 10, n words, a = g % n and p = 1 + (n - a) / (3 + g % 8), every word i from a on becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.when(h % 10 == 0, words_of(F.col("text").cast("string"))).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    d = d.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", at(i))), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the longest one, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    x = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("shown"), "collapsed")
    period = -F.col("best.period")
    return x.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2("shown", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11(spark, sf_dir):
    return digests(periodic_runs(looped(table(spark, sf_dir, "documents"))))
