"""Operator 5: language identification by hierarchical discrimination.

A text is predicted in two steps: first its language family, then, inside the family, its language. Both steps are
one-versus-one linear support vector machines over the relative frequencies of hashed character n-grams (1 to 4
characters of the lower-cased letters, with word borders), fitted in this module by dual coordinate descent.

Fitting uses a bounded sample: at most SAMPLE labelled rows, shared evenly by the labels, those of smallest hashed id.
Prediction reads every text whole. lang, source and doc_id are never inputs of a prediction.

Defined results: a null text, or one without a letter, is `und` with score 0; a language that FAMILIES doesn't list is
a family of its own; with a single label that label is predicted; without any labelled row everything is `und`; repeated
rows are predicted each; an empty table gives an empty result; only doc_id, text and lang are read. Nothing is shuffled
but the sample.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.common import shipped, table, tidied
from tessera.llm.tokens import slices

SAMPLE, FEATURES, EPOCHS = 3000, 4096, 12
#: Families of languages, by their codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "ne"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def counted(text: str) -> np.ndarray | None:
    """How often each hashed n-gram occurs; None if the text has no letter."""
    low = text.lower()
    if not any(c.isalpha() for c in low[:256]) and not any(c.isalpha() for c in low):
        return None
    out = np.zeros(FEATURES, np.int64)
    for at in range(0, len(low), 1 << 18):  # long texts in blocks; the counts add up
        c = np.frombuffer(low[at : at + (1 << 18)].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters(c)
        c = np.where(letter, c, np.uint32(32))
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        for n in range(1, 5):
            if len(c) < n:
                break
            h = np.zeros(len(c) - n + 1, np.uint32)
            for j in range(n):
                h = (h ^ c[j : j + len(h)]) * _MULTIPLIERS[j] + np.uint32(n)
                h ^= h >> np.uint32(15)
            out += np.bincount(h % np.uint32(FEATURES), minlength=FEATURES)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Relative frequencies, their square roots scaled to length 1."""
    out = np.sqrt(counts / max(1, counts.sum()))
    return out / np.sqrt((out**2).sum())


def features(text: str) -> np.ndarray | None:
    """The scaled frequencies of a text; None if it has no letter."""
    counts = counted(text)
    return None if counts is None else scaled(counts)


_KNOWN_LETTERS = np.array([chr(i).isalpha() for i in range(0x3000)])


def _letters(c: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, as `isalpha` has it."""
    out = _KNOWN_LETTERS[np.minimum(c, len(_KNOWN_LETTERS) - 1)]
    above = c >= len(_KNOWN_LETTERS)
    if above.any():
        points, place = np.unique(c[above], return_inverse=True)
        out[above] = np.array([chr(i).isalpha() for i in points])[place]
    return out


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 4.0, seed: int = 5) -> np.ndarray:
    """A linear support vector machine (squared hinge loss) on some rows of x, y of +1 and -1, by dual coordinate descent.

    The last weight is the constant's."""
    rng, w, b, a = np.random.default_rng(seed), np.zeros(x.shape[1]), 0.0, np.zeros(len(rows))
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    d = 1 / (2 * c * weight)
    q = 2 + d  # rows have length 1, and the constant adds 1
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            v = x[rows[i]]
            new = max(0.0, a[i] - (y[i] * (v @ w + b) - 1 + d[i] * a[i]) / q[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * v
                b += (new - a[i]) * y[i]
                a[i] = new
    return np.append(w, b)


class OneVersusOne:
    """A machine for each pair of classes. A class's score is the least margin against the others, through a sigmoid."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        """Fitted on some rows of x, with their labels."""
        self.classes = sorted(set(labels))
        self.pairs, ws = [], []
        for i, a in enumerate(self.classes):
            for j in range(i + 1, len(self.classes)):
                use = np.flatnonzero((labels == a) | (labels == self.classes[j]))
                ws.append(svm(x, rows[use], np.where(labels[use] == a, 1.0, -1.0)))
                self.pairs.append((i, j))
        self.w = np.array(ws)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the class and the score of each row. Ties go to the first class."""
        if not self.pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        m = x @ self.w[:, :-1].T + self.w[:, -1]
        wins, least = np.zeros((len(x), len(self.classes))), np.full((len(x), len(self.classes)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            wins[:, i] += m[:, k] > 0
            wins[:, j] += m[:, k] <= 0
            least[:, i], least[:, j] = np.minimum(least[:, i], m[:, k]), np.minimum(least[:, j], -m[:, k])
        best = np.lexsort((np.broadcast_to(-np.arange(wins.shape[1]), wins.shape), least, wins), axis=1)[:, -1]
        return best, 1 / (1 + np.exp(-4 * np.clip(least[np.arange(len(x)), best], -30, 30)))


class Identifier:
    """The two steps: family first, then the language inside it."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([_FAMILY.get(v, v) for v in langs])
        self.top = OneVersusOne(x, np.arange(len(x)), families)
        self.inner = [OneVersusOne(x, np.flatnonzero(families == f), langs[families == f]) for f in self.top.classes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.top.predict(x)
        lang = np.empty(len(x), object)
        for k, inner in enumerate(self.inner):
            rows = np.flatnonzero(family == k)
            if len(rows):
                got, s = inner.predict(x[rows])
                lang[rows] = [inner.classes[g] for g in got]
                score[rows] *= s
        return list(lang), score


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, limit: int = SAMPLE) -> Identifier | None:
    """Fits on at most `limit` labelled rows of docs(doc_id, text, lang)."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each label
    if not sizes:
        return None
    each = max(1, limit // len(sizes))
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 20))
    cut = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1 << 20, int(1.3 * each / n * (1 << 20)) + 64))])
    near = known.withColumn("h", h).filter(F.col("h") < cut[F.col("lang")])
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    sample = near.withColumn("rank", rank).filter(F.col("rank") <= each)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, 1):
                packed = [None if v is None else zlib.compress(v.astype("<u4").tobytes(), 1) for v in map(counted, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["lang", "x"])

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, x binary").filter(F.col("x").isNotNull()).toArrow()
    if not len(rows):
        return None
    packed, langs = rows.column("x").to_pylist(), np.array(rows.column("lang").to_pylist(), object)  # counts: few bytes of a row's FEATURES

    def row(i: int) -> np.ndarray:
        return scaled(np.frombuffer(zlib.decompress(packed[i]), "<u4")).astype("<f4")

    first = np.array([row(i)[:2] for i in range(len(packed))])
    order = np.lexsort((first[:, 1], first[:, 0], langs.astype(str)))  # the same model whatever order the rows came in
    x = np.empty((len(packed), FEATURES), "<f4")  # the one copy that the driver holds
    for at, i in enumerate(order):
        x[at] = row(i)
    model = Identifier(x, langs[order])
    del x
    tidied()
    return model


def identify(docs: DataFrame, model: Identifier | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([StructField("doc_id", d.schema["doc_id"].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType())])  # doc_id may be a struct with fields of any name

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, 1):
                for at in range(0, len(texts), 512):
                    x = [features(t) for t in texts[at : at + 512]]
                    lang, score = ["und"] * len(x), np.zeros(len(x))
                    rows = [i for i, v in enumerate(x) if v is not None] if model else []
                    if rows:
                        got, s = model.predict(np.array([x[i] for i in rows]))
                        score[rows] = s
                        for i, g in zip(rows, got, strict=True):
                            lang[i] = g
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(x)), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return d.mapInArrow(run, schema)


def op5(spark, sf_dir):
    docs = table(shipped(spark), sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
