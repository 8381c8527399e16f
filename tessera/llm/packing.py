"""Operator 1: best-fit packing by minimum bin slack.

Pieces of the same length are interchangeable, so packing needs only the histogram of lengths, which has at most
`capacity` entries however many documents there are. For each bin, the longest piece left is put in first; then a bitset
subset-sum dynamic programme over the lengths left (as many of each as there are) finds the fullest combination for the
rest. The combination is removed as often as the histogram allows, so it stands for many bins at once and the number of
programmes doesn't grow with the corpus.

Each piece then finds its place: it has a rank among the pieces of its length, made from its rank within its task and
prefix sums over the tasks, and the combinations own ranges of ranks. A third of all pieces may have one length: no
group is ever brought together.

Defined results: a null text is empty and gives one piece, the end id alone; repeated rows are packed once each; an
empty table gives an empty result; only doc_id and text are read. Only documents above the capacity are cut; their first
piece is the short one. Every sequence is gapless from 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import shipped, small, stored, work_folder
from tessera.llm.tokens import slices, vocabulary, vocabulary_path

CAPACITY = 2048
END_ID = 0


def fullest(room: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """The combination of lengths, each at most left[length] times, whose sum is the largest that is at most room.

    Bit s of a level says that sum s can be reached with the lengths so far; the levels are walked back for the counts."""
    mask, levels, steps = (1 << (room + 1)) - 1, [1], []
    for length in lengths:
        if length > room or not left[length]:
            continue
        copies, unit = min(left[length], room // length), 1
        while copies and not levels[-1] >> room & 1:
            take = min(unit, copies)
            levels.append((levels[-1] | levels[-1] << (take * length)) & mask)
            steps.append((length, take))
            copies, unit = copies - take, unit * 2
        if levels[-1] >> room & 1:
            break
    at, chosen = levels[-1].bit_length() - 1, {}
    for i in range(len(steps), 0, -1):
        if not levels[i - 1] >> at & 1:
            length, take = steps[i - 1]
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def minimum_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, length -> pieces in each of these bins) until the histogram is used up."""
    left, plan = {k: n for k, n in sorted(histogram.items(), reverse=True) if n}, []
    while left:
        lengths = list(left)
        seed = lengths[0]
        left[seed] -= 1
        combination = fullest(capacity - seed, lengths, left)
        left[seed] += 1
        combination[seed] = combination.get(seed, 0) + 1
        bins = min(left[k] // n for k, n in combination.items())
        plan.append((bins, combination))
        for k, n in combination.items():
            left[k] -= bins * n
            if not left[k]:
                del left[k]
    return plan


def layout(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces in each bin, first bin, offset in the bin), by length and rank."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for bins, combination in plan:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            rows.append((length, used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + bins * n
            offset += n * length
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, block, nth: nth counts the pieces of one length in one task."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        v, block = vocabulary(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part, texts in slices(batch, 1):
                at, out = [], []
                for row, text in enumerate(texts):
                    ids = v.encode(text) + END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    edge = n % capacity or capacity
                    for piece, start in enumerate([0, *range(edge, n, capacity)]):
                        end = edge if not piece else start + capacity
                        out.append((piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), block, seen[end - start]))
                        seen[end - start] += 1
                        at.append(row)
                cols = list(zip(*out, strict=True))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                arrays = [part.column(0).take(pa.array(at, pa.int32()))] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"])

    return d.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block int, nth long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    spark = shipped(docs.sparkSession)
    folder = work_folder(spark)
    pieces = stored(cut_pieces(docs, path or vocabulary_path(), capacity), folder, "pieces")
    counts = stored(pieces.groupBy("block", "length").agg((F.max("nth") + 1).alias("n")), folder, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = layout(minimum_slack(histogram, capacity))
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = stored(counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), folder, "first")
    ranked = pieces.join(small(first, 24), ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def put(batches):
        keys = places[:, 0] << 44 | places[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            p = places[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            j = rank - p[:, 1]
            arrays = [b.column(i) for i in range(5)] + [pa.array(p[:, 3] + j // p[:, 2]), pa.array(p[:, 4] + j % p[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(put, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1(spark, sf_dir):
    from tessera.llm.common import table

    return pack(table(spark, sf_dir, "documents"))
