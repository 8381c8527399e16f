"""Operator 13: toxicity scores by the nearest labelled examples.

A text is compared with labelled examples by the exact cosine of their TF-IDF vectors, found in a block-max inverted
index. Its K nearest vote for their labels, each with the inverse of its distance, against a fixed vote for the share of label 1 among all;
a logistic curve, fitted on the examples' own votes without themselves, makes the outcome a calibrated probability. The nearest examples are the evidence.

Fitting. Labelled texts are told apart by their hash, so that copies are one example; its label is the mean of theirs. At
most SAMPLE examples are used, of each label up to half, those of smallest hash. Terms are lower-case runs of letters. The
terms of the index are the at most TERMS whose presence in an example depends most on its label: of an example count n with
the term, a share q has label 1, against p of all; n KL(q, p) bounds the logarithm of the odds against chance, and must
exceed that of CHANCE times the number of terms tried. Near copies aren't independent: examples with the same least hash of a 5-word
shingle count once for a term. Terms are found among all those of the examples by a grouped count. Their document
frequencies are counted over all documents.

Index. Examples are put in an order in which like ones are neighbours, and cut into blocks of BLOCK. For each term and block
the largest weight is kept. A text's product with these bounds the cosine in each block; blocks are taken by falling bound
and scored in full, until the next bound can't reach the K-th best. So the K nearest are exact.

The index is as large as its parameters allow, whatever the number of documents; every text is scored whole, where it is.
Neither lang nor source, nor an id or a label of the text itself is an input of its score: equal texts have equal scores.

Defined results: a text without a term of the index, or without text, has no neighbours and gets the score of such texts;
labels that are null don't count; an id with several labels has their mean, and several texts share it; rows come out as
they are, repeated ones too; without any example, or with examples of one label alone, every score is the share of label 1
among them (0 without any); an empty table gives an empty result; only doc_id, text and the labels' doc_id and toxic are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shipped, stored, table, work_folder
from tessera.llm.tokens import slices

SAMPLE, TERMS, CHANCE, K, BLOCK, EVIDENCE, THRESHOLD = 4000, 512, 20, 15, 64, 3, 0.7
TERM = re.compile(r"[^\W\d_]+")
_TO_SPACE = bytes(c if 65 <= c < 91 or 97 <= c < 123 else 32 for c in range(256))


def terms_of(text: str) -> list[str]:
    """The lower-case runs of letters of a text, in order."""
    if text.isascii():
        return text.encode().translate(_TO_SPACE).lower().decode().split()
    return TERM.findall(text.lower())


def kin(words: list[str]) -> int:
    """The least hash of a text's 5-word shingles (of the whole text, if shorter): mostly the same for near copies."""
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))))


class Index:
    """A block-max inverted index over examples. Exact: no block is passed over that could hold one of the K nearest."""

    def __init__(self, vectors: list[dict[int, float]], labels: np.ndarray, weights: np.ndarray, names: list, n_terms: int):
        like = lambda v: sorted(v, key=lambda t: (-v[t], t))
        self.order = order = sorted(range(len(vectors)), key=lambda i: (like(vectors[i]), i))
        self.labels, self.weights, self.names = labels[order], weights[order], [names[i] for i in order]
        self.base = float(weights @ labels / weights.sum()) if len(labels) else 0.0
        self.size, blocks = len(order), max(1, -(-len(order) // BLOCK))
        self.best = np.zeros((n_terms, blocks))
        lists: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for at, i in enumerate(order):
            for t, w in vectors[i].items():
                lists[t].append((at, w))
                self.best[t, at // BLOCK] = max(self.best[t, at // BLOCK], w)
        self.places = [np.array([p for p, _ in x], np.int64) for x in lists]
        self.values = [np.array([w for _, w in x]) for x in lists]
        self.cuts = [np.searchsorted(p, np.arange(blocks + 1) * BLOCK) for p in self.places]

    def nearest(self, vector: dict[int, float], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The places and cosines of the k nearest examples with a term in common, nearest first, ties by place; `but` is left out."""
        known = sorted(vector)
        bounds = np.array([vector[t] for t in known]) @ self.best[known]
        rank = np.argsort(-bounds, kind="stable")
        places, scores, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in rank.tolist():
            if bounds[b] <= 0 or len(places) >= k and bounds[b] < least - 1e-12:
                break
            sums = np.zeros(BLOCK)
            for t in known:
                low, high = self.cuts[t][b], self.cuts[t][b + 1]
                sums[self.places[t][low:high] - b * BLOCK] += vector[t] * self.values[t][low:high]
            some = np.flatnonzero(sums)
            some = some[some + b * BLOCK != but]
            places, scores = np.concatenate([places, some + b * BLOCK]), np.concatenate([scores, sums[some]])
            if len(places) > k:
                keep = np.lexsort((places, -scores))[:k]
                places, scores = places[keep], scores[keep]
            least = scores.min() if len(scores) else 0.0
        keep = np.lexsort((places, -scores))
        return places[keep], scores[keep]

    def share(self, places: np.ndarray, scores: np.ndarray) -> float:
        """The votes for label 1 among the nearest, each by its weight and the inverse of its distance; K votes go to the usual share."""
        weights = self.weights[places]
        votes = weights / (1.05 - np.minimum(scores, 1.0))
        held = K * weights.mean()
        return float((votes @ self.labels[places] + held * self.base) / (votes.sum() + held))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the weighted logistic regression of y (0 to 1) on x, held back a little, by Newton's steps."""
    a, total = np.zeros(2), w.sum()
    x = np.stack([x, np.ones(len(x))], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        hold = np.array([1e-3, 1e-6]) * total
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (w * (p - y)) + hold * a)
        a -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])


class Model:
    """Terms, their weights, the index and the curve. Without an index every text gets the score `none`."""

    def __init__(self, none: float, terms: list[str] | None = None, idf: np.ndarray | None = None, index: Index | None = None, curve=(0.0, 0.0)):
        self.none, self.number, self.idf, self.index, self.curve = none, {t: i for i, t in enumerate(terms or [])}, idf, index, curve
        self.known = frozenset(self.number)

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + np.log(n)) * self.idf[t] for t, n in counts.items()}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {t: float(x / length) for t, x in v.items()}

    def counts(self, text: str) -> dict[int, int]:
        words = terms_of(text)
        return {self.number[t]: words.count(t) for t in self.known.intersection(words)}

    def score(self, text: str) -> tuple[float, list]:
        """The score and the nearest examples: name, cosine, label."""
        c = self.counts(text) if self.index is not None else {}
        if not c:
            return self.none, []
        places, cosines = self.index.nearest(self.vector(c), K)
        if not len(places):
            return self.none, []
        p = self.curve[0] * self.index.share(places, cosines) + self.curve[1]
        near = [(self.index.names[i], min(1.0, float(s)), float(self.index.labels[i])) for i, s in zip(places[:EVIDENCE].tolist(), cosines[:EVIDENCE], strict=True)]
        return float(1 / (1 + np.exp(-np.clip(p, -40, 40)))), near


def _examples(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """hash, y, id: the distinct labelled texts, the mean of their labels, and an id that has the text. Only ids and hashes are shuffled."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sum(F.col("toxic").cast("double")).alias("s"), F.count("*").alias("n"))
    hashed = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("hash"))
    found = hashed.join(known, "doc_id").groupBy("hash").agg((F.sum("s") / F.sum("n")).alias("y"), F.min("doc_id").alias("id"))
    return stored(found, folder, "examples", True)


def fit(docs: DataFrame, labels: DataFrame, learn) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) -> a model of the rows of docs that fulfil `learn`; frequencies are those of all docs."""
    spark = shipped(docs.sparkSession)
    folder = work_folder(spark)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    examples = _examples(d.filter(learn), labels, folder)
    side = F.col("y") >= 0.5
    sizes = {r[0]: r[1] for r in examples.groupBy(side.alias("toxic")).count().collect()}
    base = examples.agg(F.avg("y")).first()[0]
    if len(sizes) < 2:
        return Model(float(base or 0.0))
    picked = None
    for toxic, n in sizes.items():
        h = F.xxhash64("hash", F.lit(13))
        near = F.pmod(h, F.lit(1 << 20)) <= int(min(1.0, 1.3 * SAMPLE / 2 / n + 1e-3) * (1 << 20))
        some = examples.filter((side == toxic) & near).orderBy(F.pmod(h, F.lit(1 << 20)), "hash").limit(SAMPLE // 2)
        some = some.withColumn("weight", F.lit(n) / F.least(F.lit(n), F.lit(SAMPLE // 2)))
        picked = some if picked is None else picked.unionByName(some)
    picked = stored(picked, folder, "picked", True)
    wanted = F.broadcast(picked.withColumnRenamed("hash", "of_hash"))  # at most SAMPLE rows
    texts = d.filter(learn).join(wanted, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("of_hash")), "inner")
    texts = stored(texts.dropDuplicates(["of_hash"]).select("id", "y", "weight", "of_hash", "text"), folder, "texts")

    def counted(batches):
        for batch in batches:
            for part, of in slices(batch, 1):
                for h, text in zip(part.column(0).to_pylist(), of, strict=True):
                    words = terms_of(text)
                    c = Counter(words)
                    columns = [pa.array([h] * len(c), pa.int64()), pa.array([kin(words)] * len(c), pa.int64()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["hash", "kin", "term", "n"])

    occurs = stored(texts.select("of_hash", "text").mapInArrow(counted, "hash long, kin long, term string, n long"), folder, "occurs")
    marked = occurs.join(F.broadcast(picked.select("hash", side.alias("toxic"))), "hash").groupBy("term", "kin").agg((F.avg(F.col("toxic").cast("double")) >= 0.5).alias("toxic"))
    by = stored(marked.groupBy("term").agg(F.avg(F.col("toxic").cast("double")).alias("q"), F.count("*").alias("n")), folder, "terms")
    p = min(sizes[True], SAMPLE // 2) / sum(min(n, SAMPLE // 2) for n in sizes.values())
    part = lambda q, p: F.when(q > 0, q * F.log(q / F.lit(p))).otherwise(0.0)
    odds = F.col("n") * (part(F.col("q"), p) + part(1 - F.col("q"), 1 - p))
    tried = by.count()
    chosen = by.withColumn("odds", odds).filter(F.col("odds") > float(np.log(CHANCE * max(1, tried)))).orderBy(F.desc("odds"), "term").limit(TERMS).select("term").collect()
    terms = [r[0] for r in chosen]  # at most TERMS
    if not terms:
        return Model(float(base))
    number = {t: i for i, t in enumerate(terms)}
    known = frozenset(terms)

    def frequencies(batches):
        c, n = Counter(), 0
        for batch in batches:
            for _, of in slices(batch, 0):
                for text in of:
                    c.update(known.intersection(terms_of(text)))
                n += len(of)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(number[t] for t in c)], pa.int64()), pa.array([n, *c.values()], pa.int64())], names=["term", "n"])

    df = d.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r[0]: r[1] for r in df.collect()}  # at most TERMS + 1 rows
    idf = np.array([1 + np.log((1 + counts[-1]) / (1 + counts.get(i, 0))) for i in range(len(terms))])
    model = Model(0.0, terms, idf)
    held = occurs.join(F.broadcast(spark.createDataFrame([(t, i) for t, i in number.items()], "term string, at int")), "term").groupBy("hash").agg(F.collect_list(F.struct("at", "n")).alias("terms"))  # at most TERMS entries a text
    rows = picked.join(held, "hash", "left").orderBy("hash").select("id", "y", "weight", "terms").collect()  # at most SAMPLE rows
    y, w = np.array([r["y"] for r in rows]), np.array([float(r["weight"]) for r in rows])
    vectors = [model.vector({x["at"]: x["n"] for x in r["terms"] or []}) for r in rows]
    full = [i for i, v in enumerate(vectors) if v]
    empty = np.array([not v for v in vectors])
    # Of texts without neighbours: the share of label 1, drawn a little to that of all examples.
    none = (w[empty] @ y[empty] + base) / (w[empty].sum() + 1)
    index = Index([vectors[i] for i in full], y[full], w[full], [rows[i]["id"] for i in full], len(terms))
    xs, at = [], []
    for place, i in enumerate(index.order):
        places, cosines = index.nearest(vectors[full[i]], K, place)
        if len(places):
            xs.append(index.share(places, cosines))
            at.append(full[i])
    model.none, model.index = float(none), index
    model.curve = logistic(np.array(xs), y[at], w[at]) if xs else (0.0, float(np.log(base / (1 - base))))
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, evidence (the nearest examples: their doc_id, cosine, label)."""
    spark = shipped(docs.sparkSession)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(model)  # at most SAMPLE examples of TERMS terms

    def run(batches):
        m = held.value
        for batch in batches:
            for part, texts in slices(batch, 1):
                got = [m.score(t) for t in texts]
                near = [[{"doc_id": i, "cosine": s, "label": y} for i, s, y in e] for _, e in got]
                kinds = pa.list_(pa.struct([("doc_id", part.column(0).type), ("cosine", pa.float64()), ("label", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(near, kinds)], names=["doc_id", "score", "evidence"])

    return d.mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:{kind},cosine:double,label:double>>")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
