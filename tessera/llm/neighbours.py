"""Operator 7: approximate nearest neighbours by inner product, over a hierarchical k-means tree.

The tree is fitted on a bounded sample (SAMPLE vectors, those of smallest hashed id), every vector is put into a leaf,
and a query takes leaves best bin first: a priority queue holds the nodes seen so far by the inner product of query and
centre; the best is expanded until enough leaves came out. How many are enough is calibrated: PROBES queries are
compared with all vectors in blocks, and the number of visits is widened until TARGET of their true neighbours are in the
leaves visited.

Neighbouring leaves make a bin of at most PART vectors; a larger leaf is a bin of its own, dealt in parts by hashed id, and
queries of a bin in parts of about BLOCK_BYTES as well; so neither a leaf with a third of all vectors nor many queries of
one leaf meet in one task. A query goes to a bin once, with the list of its leaves there, a few queries at a time, so that
neither a task's memory nor the shuffle grows with queries times leaves. Of equal vectors in a part only the first k + 1
by id are compared, as no others can be among the k best. Scores are sums of double-precision products in the order of the
components, the same for equal vectors.

Defined results: vectors that are null, all zero, hold a null or non-finite component, have no id, or another number of
components than most vectors (ties: the larger number) take no part; rows are numbered once, so every row is a candidate
of every query but its own, rows with a query's id or vector too, and every query row has k results of its own, also where
its id occurs twice; with fewer candidates than k all of them are returned; empty tables give an empty result; only vec_id
and embedding are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import shipped, stored, work_folder

SAMPLE, PROBES, TARGET, PART, LEAF, BRANCH, MAX_LEAVES = 16384, 200, 0.96, 4096, 2048, 12, 4096
#: Scores that are held at once, rows that a task hands over at once, bytes of the queries that meet a part of a bin.
CELLS, ROWS, BLOCK_BYTES = 1 << 20, 2048, 16 << 20


class Tree:
    """A hierarchical k-means tree. Nodes are numbered; children of node i are rows of kids[i]; leaves have numbers of their own."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int = 7):
        self.centres, self.kids, self.leaf_of, self.leaves = [x.mean(0) if len(x) else np.zeros(x.shape[1])], {}, {}, 0
        rng, stack = np.random.default_rng(seed), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            groups = self._split(x, rows, rng) if len(rows) > leaf and self.leaves + len(stack) + BRANCH < MAX_LEAVES else []
            if len(groups) < 2:
                self.leaf_of[node], self.leaves = self.leaves, self.leaves + 1
                continue
            self.kids[node] = np.arange(len(self.centres), len(self.centres) + len(groups))
            for g in groups:
                stack.append((len(self.centres), g))
                self.centres.append(x[g].mean(0))
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(x, rows, rng):
        y = x[rows]
        c = np.unique(y[rng.choice(len(y), min(BRANCH, len(y)), replace=False)], axis=0)
        for _ in range(8):
            a = np.argmin((c**2).sum(1) - 2 * y @ c.T, axis=1)
            c = np.array([y[a == k].mean(0) for k in range(len(c)) if (a == k).any()])
        a = np.argmin((c**2).sum(1) - 2 * y @ c.T, axis=1)
        return [rows[a == k] for k in range(len(c)) if (a == k).any()]

    def assign(self, y: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree by the nearest centre."""
        out, stack = np.zeros(len(y), np.int32), [(0, np.arange(len(y)))]
        while stack:
            node, rows = stack.pop()
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
            elif len(rows):
                kids = self.kids[node]
                c = self.centres[kids]
                a = np.argmin((c**2).sum(1) - 2 * y[rows] @ c.T, axis=1)
                stack += [(int(k), rows[a == i]) for i, k in enumerate(kids)]
        return out

    def best_first(self, q: np.ndarray, visits: int, sizes: np.ndarray, least: int) -> list[int]:
        """The first leaves that the query takes from the priority queue, and further ones until they hold `least` vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            if node in self.leaf_of:
                out.append(self.leaf_of[node])
                held += int(sizes[out[-1]])
                continue
            for k, s in zip(self.kids[node], self.centres[self.kids[node]] @ q, strict=True):
                heapq.heappush(queue, (-float(s), int(k)))
        return out


def matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64)


def first_of(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best scores of each `of`, in order, ties to smaller ids."""
    order = np.lexsort((ids, -scores, of))
    new = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    return order[rank < k]


def best(q: np.ndarray, q_rows: np.ndarray, v: np.ndarray, v_rows: np.ndarray, v_ids: np.ndarray, k: int, bound: np.ndarray | None = None):
    """Places in q, places in v and scores of the k best of each query, ties to smaller ids; its own row never counts.

    bound: scores that k candidates are known to reach; what is below them isn't returned."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, CELLS // max(1, len(v)))
    for at in range(0, len(q) if len(v) else 0, step):
        rough = q[at : at + step] @ v.T
        rough[q_rows[at : at + step, None] == v_rows[None, :]] = -np.inf
        kth = np.full(len(rough), -np.inf) if bound is None else bound[at : at + step].copy()
        many = np.flatnonzero(np.count_nonzero(rough >= kth[:, None], axis=1) > k)
        if len(many):
            kth[many] = np.maximum(kth[many], np.partition(rough[many], -k, axis=1)[:, -k])
        least = np.where(np.isfinite(kth), kth - 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0))), -np.inf)
        i, c = np.nonzero(rough >= least[:, None])
        fine = np.isfinite(rough[i, c])
        i, c = i[fine], c[fine]
        chunk = max(1, CELLS // v.shape[1])
        exact = np.concatenate([np.zeros(0), *(np.cumsum(v[c[j : j + chunk]] * q[at + i[j : j + chunk]], axis=1)[:, -1] for j in range(0, len(i), chunk))])
        o = first_of(i, v_ids[c], exact, k)
        out.append((at + i[o], c[o], exact[o]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def foremost(v: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k + 1 smallest ids of each set of equal vectors: no other can be among the k best of a query."""
    if not len(v):
        return np.zeros(0, np.int64)
    same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    return np.sort(first_of(same, ids, np.zeros(len(v)), k + 1))


def dealt(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each leaf, and the parts of each bin: neighbouring leaves of PART vectors together; larger ones are alone, in parts."""
    bin_of, held = np.zeros(len(sizes), np.int32), []
    for leaf, size in enumerate(sizes):
        if not held or held[-1] + size > PART:
            held.append(0)
        held[-1] += int(size)
        bin_of[leaf] = len(held) - 1
    return bin_of, np.array([-(-n // PART) for n in held], np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats are carried as such, and become doubles exactly
    v = vectors.select(F.col("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score for the rows that fulfil is_query, against all others."""
    spark = shipped(vectors.sparkSession)
    folder = work_folder(spark)
    v = usable(vectors)
    dims = {r[0]: r[1] for r in v.groupBy(F.size("embedding")).count().collect()}  # a row for each number of components
    dim = max(dims, key=lambda d: (dims[d], d), default=0)
    n = dims.get(dim, 0)
    v = v.filter(F.size("embedding") == dim)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    h = F.xxhash64("vec_id")
    share = min(1.0, 1.3 * SAMPLE / max(1, n))
    sample = v.filter(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(h, "vec_id").limit(SAMPLE).select("vec_id", "embedding").toPandas()
    x = matrix(sample["embedding"]) if len(sample) else np.zeros((0, max(1, dim)))
    leaf = max(LEAF, n // (MAX_LEAVES // 4))
    tree = Tree(x, max(4, int(leaf * len(x) / max(1, n))))

    def to_leaf(frames):
        for f in frames:
            if len(f):
                yield f.assign(leaf=tree.assign(matrix(f["embedding"])))

    carried = v.schema["embedding"].dataType.simpleString()
    rows = v.mapInPandas(to_leaf, f"vec_id {kind}, embedding {carried}, leaf int").withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, folder, "rows")  # row numbers are final once written
    counted = stored(rows.groupBy("leaf").agg(F.count("*").alias("size")), folder, "leaves", True)
    sizes = {r["leaf"]: r["size"] for r in counted.collect()}  # at most MAX_LEAVES rows
    queries = rows.filter(is_query)
    visits, seen_by = calibrated(rows, queries, tree, k)
    counts = np.array([sizes.get(leaf, 0) for leaf in range(tree.leaves)])
    bin_of, parts = dealt(counts)
    shares = np.zeros(len(parts))  # of the queries that go to a bin, as the probes do
    for leaves in seen_by:
        shares[np.unique(bin_of[leaves])] += 1 / len(seen_by)
    blocks = np.maximum(1, np.ceil(queries.count() * np.minimum(1, shares + 0.05) * 8 * max(1, dim) / BLOCK_BYTES)).astype(np.int64)
    held_sample = spark.sparkContext.broadcast((x, sample["vec_id"].to_numpy(), tree.assign(x)))  # SAMPLE vectors

    def to_bins(frames):
        xs, ids, leaf_of = held_sample.value
        names = ["query", "query_id", "q", "bound", "leaves", "bin", "part", "block"]
        for f in frames:
            out = []
            for row, i, q in zip(f["row"], f["vec_id"], f["embedding"], strict=True):
                d = np.asarray(q, np.float64)
                leaves = np.array(tree.best_first(d, visits, counts, k + 1), np.int32)
                # The k-th best score of the sampled vectors in these leaves, without those of the query's id, bounds what each returns.
                seen = np.zeros(tree.leaves, bool)
                seen[leaves] = True
                s = xs[seen[leaf_of] & (ids != i)] @ d
                bound = np.partition(s, -k)[-k] if len(s) >= k else -np.inf
                bins = bin_of[leaves]
                for b in np.unique(bins).tolist():
                    out += [(row, i, q, bound, leaves[bins == b], b, p, row % int(blocks[b])) for p in range(parts[b])]
                if len(out) >= ROWS:
                    for at in range(0, len(out), ROWS):
                        yield pd.DataFrame(out[at : at + ROWS], columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    bins = queries.mapInPandas(to_bins, f"query long, query_id {kind}, q {carried}, bound double, leaves array<int>, bin int, part int, block int")
    deal = spark.createDataFrame([(leaf, int(b), int(parts[b]), int(blocks[b])) for leaf, b in enumerate(bin_of)], "of_leaf int, bin int, parts int, blocks int")
    held = rows.join(F.broadcast(deal), F.col("leaf") == F.col("of_leaf")).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))  # MAX_LEAVES rows at most
    held = held.select("row", "vec_id", "embedding", "leaf", "bin", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        q, v, bound = matrix(a["q"]), matrix(b["embedding"]), a["bound"].to_numpy()
        q_rows, q_ids, v_rows, v_ids, leaf = (x.to_numpy() for x in (a["query"], a["query_id"], b["row"], b["vec_id"], b["leaf"]))
        want = np.repeat(np.arange(len(a)), [len(x) for x in a["leaves"]])
        want_leaf = np.concatenate(a["leaves"].tolist())
        fore = foremost(v, v_ids, k)
        got = []
        for at in np.unique(leaf[fore]):
            of, to = want[want_leaf == at], fore[leaf[fore] == at]
            i, c, s = best(q[of], q_rows[of], v[to], v_rows[to], v_ids[to], k, bound[of])
            got.append((of[i], to[c], s))
        i, c, s = (np.concatenate(x) for x in zip(*got, strict=True))
        o = first_of(i, v_ids[c], s, k)
        return pd.DataFrame({"query": q_rows[i[o]], "query_id": q_ids[i[o]], "vec_id": v_ids[c[o]], "score": s[o]})

    keys = ["bin", "part", "block"]
    found = bins.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(score, f"query long, query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrated(rows: DataFrame, queries: DataFrame, tree: Tree, k: int) -> tuple[int, list[list[int]]]:
    """The number of leaves to visit: widened until TARGET of the true neighbours of at most PROBES queries are found; these queries' leaves."""
    probes = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(PROBES).select("row", "embedding").toPandas()
    if not len(probes) or tree.leaves < 2:
        return 1, [[0]]
    q, q_rows = matrix(probes["embedding"]), probes["row"].to_numpy()

    def block(frames):
        for f in frames:
            if len(f):
                ids, leaves = f["vec_id"].to_numpy(), f["leaf"].to_numpy()
                of, at, scores = best(q, q_rows, matrix(f["embedding"]), f["row"].to_numpy(), ids, k)
                yield pd.DataFrame({"probe": of, "id": ids[at], "leaf": leaves[at], "score": scores})

    kind = rows.schema["vec_id"].dataType.simpleString()
    near = rows.mapInPandas(block, f"probe long, id {kind}, leaf int, score double")
    rank = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "id"))
    true = near.withColumn("r", rank).filter(F.col("r") <= k).select("probe", "leaf").toPandas()  # PROBES * k rows
    orders = [tree.best_first(x, tree.leaves, np.ones(tree.leaves), 0) for x in q]
    place = [{leaf: at for at, leaf in enumerate(leaves)} for leaves in orders]
    need = np.sort([place[p][leaf] + 1 for p, leaf in zip(true["probe"], true["leaf"], strict=True)])
    visits = int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) if len(need) else 1
    return visits, [leaves[:visits] for leaves in orders]


def op7(spark, sf_dir):
    from tessera.llm.common import table

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
