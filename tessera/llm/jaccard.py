"""Operator 10: n-gram Jaccard join over prefix trees of globally ordered n-gram sets.

1. Every document becomes the set of its word 5-grams, as 60-bit hashes. A table of counters of fixed size, filled from
   all documents, gives each n-gram a frequency level; level and hash together are one integer, so that the order of
   integers is a global order from rare to frequent.
2. Only the first n - ceil(0.75 n) + 1 n-grams of a set can be the first that it shares with a set of similarity 0.75.
   These are dealt by n-gram; those that occur in one set alone go. Documents with the same set count once.
3. Sets that share such an n-gram are compared unless sizes or positions exclude 0.75. In each round the sets of an
   n-gram are compared with one leader, and sets already linked (directly or not) not again; what then remains between
   different components is compared in full, so no link between components is lost.
4. A comparison puts the sets that a leader meets into a path-compressed prefix tree in the global order. The leader's
   set goes down the tree; the overlap of a shared path is counted once, and a subtree goes as soon as the overlap so
   far and the n-grams left on either side can't reach the threshold. Leaders with many sets are dealt in blocks.
5. Components come from star contractions; each document gets the smallest doc_id of its component.

Defined results: null and blank texts have the empty set, n_shingles 0, and are their own component; texts with fewer
than five words have one n-gram; repeated rows are documents of their own, in one component; a null doc_id takes part
but never is a component's id unless all are null; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_BYTES, forget, released, shipped, small, stored, tidied, work_folder
from tessera.llm.components import components
from tessera.llm.tokens import slices

N = 5
#: Similarity as a fraction: 100 * intersection >= 75 * union, which is 7 * intersection >= 3 * (size + size).
COUNTERS, BLOCKS = 1 << 22, 256
HASH_BITS = 60
#: N-grams of this level and above are dealt by set as well, so that none of them fills a task.
HEAVY = 3
SEEN, WORDS = 100_000, 100_000
#: Bytes of text that are hashed at once.
SLICE = 2 << 20
MEMBERS = 256
ROUNDS = 4
#: Rounds with leaders end when what is left has at most so many pairs for each row.
MANY = 20
_words: dict[bytes, int] = {}
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, those of short words from a bounded cache."""
    import xxhash

    try:
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_words) > WORDS:
            _words.clear()
        own = {w: xxhash.xxh64_intdigest(w) for w in words if w not in _words}
        h = np.fromiter((own[w] if w in own else _words[w] for w in words), np.uint64, len(words))
        _words.update((w, v) for w, v in itertools.islice(own.items(), WORDS) if len(w) <= 64)
        return h


def shingles(text: str) -> np.ndarray:
    """The set of a text's word 5-grams as sorted hashes of HASH_BITS bits; a shorter text is one n-gram."""
    words = text.encode("utf-8").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(N, len(h))
    g = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        g = _mix(g * _U(0x9E3779B97F4A7C15) + h[j : j + len(g)])
    return np.unique(g >> _U(64 - HASH_BITS))


def _set_id(keys: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(keys.tobytes()) - (1 << 63)


def _squeeze(counts: np.ndarray) -> bytes:
    kind = "<u1" if counts.max(initial=0) < 1 << 8 else "<u4"
    return kind[2:].encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), "<u" + data[:1].decode()).astype(np.int64)


def _scan(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n, sid, grams) for each document, grams being its packed hashes, and rows (block, counts) with each task's counters."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "sid", "grams", "block", "counts"]

    def run(batches):
        counters = np.zeros(COUNTERS, np.uint32)
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for part, texts in slices(batch, 1, SLICE):
                sets = [shingles(t) for t in texts]
                where, times = np.unique(np.concatenate(sets) & _U(COUNTERS - 1), return_counts=True)
                counters[where.astype(np.int64)] += times.astype(np.uint32)
                none = len(sets)
                arrays = [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_set_id(x) if len(x) else None for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        _words.clear()
        if id_type is not None:
            packed = [_squeeze(c) for c in counters.reshape(BLOCKS, -1)]
            nothing = [pa.nulls(BLOCKS, t) for t in (id_type, pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], names=names)
        tidied()

    return docs.mapInArrow(run, f"doc_id {kind}, n long, sid long, grams binary, block int, counts binary")


def _levels(counts: DataFrame) -> np.ndarray:
    """A level from 0 (rare) to 7 for each counter. Blocks are summed on the executors; COUNTERS numbers reach the driver."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + _unsqueeze(data)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(t, 2**32 - 1).astype("<u4").tobytes() for t in total.values()], pa.binary())], names=["block", "counts"])

    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.repartition(min(n, BLOCKS), "block").mapInArrow(add, "block int, counts binary").toArrow()
    sums = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for block, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        sums[block] += np.frombuffer(data, "<u4")
    sums = np.maximum(sums.ravel() - int(np.median(sums)), 1)  # without what rare n-grams share a counter with
    return np.concatenate([np.minimum(np.log2(x) / 3, 7).astype(np.uint8) for x in sums.reshape(BLOCKS, -1)])  # a block at a time, for the driver's memory


def ordered(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set as integers in the global order."""
    return np.sort(levels[(hashes & _U(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << _U(HASH_BITS) | hashes).astype(np.int64)


def _prefixes(sets: DataFrame, levels) -> DataFrame:
    """sets(sid, grams) -> rows (token, sid, n, pos) for the prefix of each set, once for each set and task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sids, grams = batch.column(0).to_pylist(), batch.column(1)
            tok, sid, n, pos, held = [], [], [], [], 0
            for k, s in enumerate(sids):
                if s not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(s)
                    h = np.frombuffer(grams[k].as_buffer(), np.uint64)
                    p = len(h) - -(-3 * len(h) // 4) + 1
                    tok.append(ordered(h, levels.value)[:p])
                    sid.append(np.full(p, s, np.int64))
                    n.append(np.full(p, len(h), np.int32))
                    pos.append(np.arange(p, dtype=np.int32))
                    held += p
                if tok and (held >= SLICE >> 4 or k == len(sids) - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tok, sid, n, pos)], names=["token", "sid", "n", "pos"])
                    tok, sid, n, pos, held = [], [], [], [], 0
        tidied()

    return sets.mapInArrow(run, "token long, sid long, n int, pos int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The rows whose token occurs in two sets or more (all rows of heavy tokens), without repeated rows."""
    heavy = F.shiftright("token", HASH_BITS) >= HEAVY
    n = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prefixes.repartition(n, "token", F.when(heavy, F.pmod("sid", F.lit(64))).otherwise(F.lit(0))).sortWithinPartitions("token", "sid")

    def run(batches):
        names, held, linked = ["token", "sid", "n", "pos"], None, False  # held: the last row so far; linked: the row before has its token
        for b in batches:
            rows = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            new = np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            rows = [x[new] for x in rows]
            same = rows[0][1:] == rows[0][:-1]
            keep = np.concatenate([[linked], same]) | np.concatenate([same, [False]]) | (rows[0] >> HASH_BITS >= HEAVY)
            held, linked = [x[-1:] for x in rows], bool(same[-1]) if len(same) else linked
            if keep[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in rows], names=names)
        if held is not None and (linked or held[0][0] >> HASH_BITS >= HEAVY):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)

    return dealt.mapInArrow(run, "token long, sid long, n int, pos int")


def _sets(sets: DataFrame, levels) -> DataFrame:
    """sets(sid, grams) -> sid, keys: in the global order, packed."""

    def run(batches):
        for batch in batches:
            keys = [ordered(np.frombuffer(g.as_buffer(), np.uint64), levels.value).tobytes() for g in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["sid", "keys"])

    return sets.mapInArrow(run, "sid long, keys binary")


class PrefixTree:
    """A path-compressed tree of ordered sets. A node is [edge, kids, ids of the sets that end here, depth, least size, largest size]."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(ids)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.root = self._build([ids[i] for i in order], [sets[i] for i in order], 0, len(order), 0)

    def _build(self, ids, sets, lo, hi, depth):
        first, last = sets[lo], sets[hi - 1]  # in order: what these two share, all share
        n = min(len(first), len(last))
        apart = np.flatnonzero(first[depth:n] != last[depth:n])
        end = depth + (int(apart[0]) if len(apart) else n - depth)
        here, at = [], lo
        while at < hi and len(sets[at]) == end:
            here.append(ids[at])
            at += 1
        kids = []
        while at < hi:
            to = at + 1
            while to < hi and sets[to][end] == sets[at][end]:
                to += 1
            kids.append(self._build(ids, sets, at, to, end))
            at = to
        sizes = [end] * bool(here) + [s for k in kids for s in k[4:]]
        return [first[depth:end], kids, here, end, min(sizes), max(sizes)]

    def overlaps(self, probe: np.ndarray):
        """(id, overlap) of every set whose similarity with the probe is at least 0.75."""
        n, stack = len(probe), [(self.root, 0)]
        while stack:
            (edge, kids, here, depth, least, largest), shared = stack.pop()
            if len(edge):
                at = np.searchsorted(probe, edge)
                shared += int((probe[np.minimum(at, n - 1)] == edge).sum())
                left = n - int(np.searchsorted(probe, edge[-1], side="right"))
            else:
                left = n
            if 7 * (shared + min(largest - depth, left)) < 3 * (n + least):
                continue
            if 7 * shared >= 3 * (n + depth):
                for i in here:
                    yield i, shared
            stack += [(k, shared) for k in kids]


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) -> a, b, overlap of those that are similar. Sets of a leader a come in blocks of about MEMBERS."""
    few = pairs.count() * 40 <= BROADCAST_BYTES
    near = F.broadcast if few else lambda x: x
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    members = pairs.join(near(sizes), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    members = sets.withColumnRenamed("sid", "b").join(near(members), "b").select("a", "block", "b", "keys")
    leaders = sets.withColumnRenamed("sid", "a").join(near(sizes), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "keys")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.unionByName(leaders).repartition(n, "a", "block").sortWithinPartitions("a", "block", F.col("b").isNotNull(), "b")

    def run(batches):
        names = ["a", "b", "overlap"]
        a, probe, ids, sets_ = None, None, [], []

        def flush():
            if ids:
                found = list(PrefixTree(ids, sets_).overlaps(probe))
                if found:
                    return [pa.RecordBatch.from_arrays([pa.array([a] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=names)]
            return []

        for batch in batches:
            for x, b, keys in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b is None:
                    yield from flush()
                    a, probe, ids, sets_ = x, np.frombuffer(keys, np.int64), [], []
                else:
                    ids.append(b)
                    sets_.append(np.frombuffer(keys, np.int64))
        yield from flush()

    return dealt.mapInArrow(run, "a long, b long, overlap long")


def possible(x: str = "", y: str = "l_"):
    """Whether sizes and what is left of both sets allow a similarity of 0.75, if the token is the first that they share.

    A set's rest bounds the overlap only if its prefix ends first, as only then what both share of its prefix is in the
    other prefix too. Which of the two that is isn't known here, so the greater rest counts."""
    total = F.col(f"{x}n") + F.col(f"{y}n")
    most = F.least(f"{x}left", f"{y}left", F.greatest(f"{x}rest", f"{y}rest"))
    return (7 * most >= 3 * total) & (4 * F.least(f"{x}n", f"{y}n") >= 3 * F.greatest(f"{x}n", f"{y}n"))


def _ordered_pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def with_partners(shared: DataFrame) -> DataFrame:
    """token, sid, n, left, rest of the rows whose token some other set has, where sizes and what is left allow 0.75.

    left: how many n-grams the set has from this one on. rest: the same without those tokens of its prefix that no other
    set has in its own prefix; such a token can still stand behind the prefix of another set (see `possible`). A token's
    rows are held against its classes of equal (n, left, rest), which are counted first, not against each other."""
    later = F.count("*").over(W.partitionBy("sid").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0))
    left = (F.col("n") - F.col("pos")).cast("int").alias("left")
    x = shared.select("token", "sid", "n", left, (F.ceil(F.col("n") * 3 / F.lit(4)) - 1 + later).cast("int").alias("rest"))
    kinds = ("n", "left", "rest")
    classes = x.groupBy("token", *kinds).agg(F.count("*").alias("many")).select(F.col("token").alias("l_token"), *[F.col(c).alias(f"l_{c}") for c in kinds], "many")
    own = (F.col("n") == F.col("l_n")) & (F.col("left") == F.col("l_left")) & (F.col("rest") == F.col("l_rest"))
    return x.join(classes, (F.col("token") == F.col("l_token")) & possible() & (~own | (F.col("many") > 1)), "left_semi")


def _meetings(x: DataFrame, folder: str) -> DataFrame:
    """x(token, sid, n, left, rest, comp) -> sid, l_sid: the pairs of sets of different components that share a token and may match.

    What is left is most at the first of the tokens that two sets share, and so is the rest; if sizes and what is left
    allow a match at a later one, they do at the first. So of tokens with the same sets only the first is looked at, and a pair
    meets at a token only if the token before, among those looked at, isn't the same in both sets."""
    own = x.groupBy("token").agg(F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"h{i}") for i in (0, 1)])
    first = own.groupBy("c", "h0", "h1").agg(F.min("token").alias("token")).select("token")
    before = F.lag("token").over(W.partitionBy("sid").orderBy("token")).alias("before")
    x = stored(x.join(first, "token", "left_semi").select("*", before), folder, "rest")
    y = x.select("token", *[F.col(c).alias(f"l_{c}") for c in ("sid", "n", "left", "rest", "comp", "before")])
    apart = F.col("before").isNull() | F.col("l_before").isNull() | (F.col("before") != F.col("l_before"))
    return x.join(y, "token").filter((F.col("sid") < F.col("l_sid")) & (F.col("comp") != F.col("l_comp")) & apart & possible()).select("sid", "l_sid")


def linked(shared: DataFrame, sets: DataFrame, folder: str, compare=_compare) -> DataFrame:
    """shared(token, sid, n, left, rest), sets(sid, keys) -> node, root: the components of sets that have a link to another one."""
    spark = shared.sparkSession
    tested, roots = None, None
    for turn in range(ROUNDS + 1):
        x = shared if roots is None else shared.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
        x = x.withColumn("comp", F.col("sid")) if roots is None else x
        by = F.xxhash64("token", "sid", F.lit(turn)) if turn else F.xxhash64("sid")  # at first few leaders, then a different one for each token
        lead = F.min(F.struct(by, "sid", "n", "left", "rest", "comp"))
        inside = x.groupBy("token", "comp").agg(F.count("*").alias("c"), lead.alias("l"))
        several = inside.groupBy("token").agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("within"), F.count("*").alias("comps"), F.min("l").alias("l")).filter("comps > 1")
        several = several.select("token", "rows", (F.col("rows") * F.col("rows") - F.col("within")).alias("across"), *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("sid", "n", "left", "rest", "comp")])
        several = stored(several, folder, f"tokens-{turn}", True)
        size = several.agg(F.sum("rows").alias("n"), F.sum("across").alias("across")).first()
        if not size["n"]:
            break
        last = turn == ROUNDS or (turn > 0 and size["across"] <= MANY * size["n"])
        if last:
            pairs = _meetings(stored(x.join(several.select("token"), "token", "left_semi"), folder, "open"), folder)
        else:
            met = x.join(several.drop("rows", "across"), "token").filter((F.col("comp") != F.col("l_comp")) & possible())
            pairs = met.select("sid", "l_sid")
            if not turn:  # at first each set meets only the leader with which it shares most
                met = met.groupBy("sid", "l_sid").agg(F.count("*").alias("c"))
                pairs = met.groupBy("sid").agg(F.max(F.struct("c", "l_sid")).alias("m")).select("sid", F.col("m.l_sid").alias("l_sid"))
        pairs = pairs.select(*_ordered_pair("sid", "l_sid")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, folder, f"pairs-{turn}", True)
        found = stored(compare(pairs, sets).select("a", "b"), folder, f"links-{turn}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        roots = components(links, folder, f"roots-{turn}")
        if last:
            break
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id."""
    spark = shipped(docs.sparkSession)
    folder = work_folder(spark)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scanned = stored(_scan(d), folder, "scan", dictionary=False)
    levels = spark.sparkContext.broadcast(_levels(scanned.filter("block IS NOT NULL").select("block", "counts")))  # COUNTERS bytes
    every = scanned.filter("sid IS NOT NULL").select("sid", "grams")
    prefixes = stored(_shared(_prefixes(every, levels)), folder, "prefixes")
    released(spark)
    shared = stored(with_partners(prefixes), folder, "shared")
    forget(spark, f"{folder}/prefixes")
    wanted = stored(shared.select("sid").distinct(), folder, "wanted", True)
    sets = stored(_sets(every.join(small(wanted, 16), "sid", "left_semi").groupBy("sid").agg(F.first("grams").alias("grams")), levels), folder, "sets", dictionary=False)
    rows = stored(scanned.filter("block IS NULL").select("doc_id", "n", "sid"), folder, "rows")
    forget(spark, f"{folder}/scan")
    released(spark)
    roots = linked(shared, sets, folder)
    of_set = rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = of_set.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets"))
    named = stored(named.join(of_root.filter("sets > 1"), "root").select("sid", "component_id"), folder, "named")
    # Sets without links get the least id of their own rows, so only rows of repeated sets need a look-up.
    alone = of_set.join(named, "sid", "left_anti").select("sid", F.col("least").alias("component_id"))
    every = stored(named.unionByName(alone), folder, "every")
    for name in ("shared", "sets", "wanted"):
        forget(spark, f"{folder}/{name}")
    size = 32 + F.octet_length(F.coalesce(F.col("component_id").cast("string"), F.lit("")))  # ids of any type
    out = rows.join(small(every, size), "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op10(spark, sf_dir):
    from tessera.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
