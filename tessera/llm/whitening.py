"""Operator 12: whitening of embeddings by hierarchical merging of singular value decompositions.

Every entry c becomes the integer x = floor(64 c) + SHIFT. Each partition decomposes its centred vectors, a block at a time,
and keeps all singular values and right vectors, the number of its vectors and their exact integer sums. Two such parts
are merged by decomposing their scaled right vectors, stacked, and one more row, sqrt(n1 n2 / n) times the difference of
the means, which corrects for the two centres. Nothing is cut off, so the merged values and vectors are those of all
vectors together. Parts are merged FAN at a time on the executors, level by level, each level a written table; only the
last part, as many rows as dimensions, reaches the driver. The number of dimensions bounds every part, not the number of rows.

Covariances divide by the number of vectors. A whitened entry is the centred vector's product with a component over the
square root of its eigenvalue. How far the whitened covariance is from the identity is measured in a second pass, centred
and merged in the same way.

Defined results: vectors that are null or hold a null or non-finite entry take no part, nor do those with another number
of entries than most vectors (ties: the larger number); other rows give a result each, repeated ids and null ids too.
Components without variance beyond rounding aren't components (there is nothing to divide by), so equal vectors, or a single
one, give none. Products 64 c beyond 2^50 count as 2^50. A deviation too large for a long is null. An empty table gives
an empty result; only vec_id and embedding are read. The sign of a component makes its largest entry positive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shipped, stored, table, work_folder

SCALE, SHIFT, COMPONENTS, FAN, ROWS = 64, 1_000_000, 32, 8, 4096
PART = "node long, n long, sums array<string>, scaled binary"


class Part:
    """A number of vectors: how many, their exact sums, and all singular values times right vectors of them, centred."""

    def __init__(self, n: int, sums: np.ndarray, scaled: np.ndarray):
        self.n, self.sums, self.scaled = n, sums, scaled

    @classmethod
    def of(cls, y: np.ndarray) -> Part:
        """y: a row for each vector, at most ROWS, so that sums of integers are exact."""
        sums = y.sum(0) if y.dtype == np.float64 else y.sum(0).astype(object)
        return cls(len(y), sums, _scaled(y - (sums / len(y)).astype(np.float64)))

    def merged(self, other: Part) -> Part:
        n, m = self.n, other.n
        if self.sums.dtype == np.float64:
            gap = self.sums / n - other.sums / m
        else:  # integers: exact, then rounded once
            gap = ((self.sums * m - other.sums * n) / (n * m)).astype(np.float64)
        return Part(n + m, self.sums + other.sums, _scaled(np.vstack([self.scaled, other.scaled, np.sqrt(n / (n + m) * m) * gap])))

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """The eigenvalues of the covariance, falling, and its eigenvectors as rows."""
        _, s, v = np.linalg.svd(self.scaled, full_matrices=False)
        return s**2 / self.n, v

    def row(self, node: int) -> pd.DataFrame:
        return pd.DataFrame({"node": [node], "n": [self.n], "sums": [[repr(float(v)) if self.sums.dtype == np.float64 else str(v) for v in self.sums]], "scaled": [self.scaled.tobytes()]})


def _scaled(centred: np.ndarray) -> np.ndarray:
    """All singular values times right vectors: what stays of a matrix without the left ones."""
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    return s[:, None] * v


def _from_row(row, exact: bool) -> Part:
    sums = np.array([int(v) for v in row.sums], object) if exact else np.array(row.sums, np.float64)
    return Part(row.n, sums, np.frombuffer(row.scaled).reshape(-1, len(row.sums)))


def integers(matrix: np.ndarray) -> np.ndarray:
    """floor(64 c) of each entry, as integers."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(SCALE * matrix, -(2.0**50), 2.0**50)).astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def decomposed(rows: DataFrame, blocks, folder: str, exact: bool = True) -> Part | None:
    """The whole of `rows` as one part. blocks(record batch) gives its matrix: integers if exact, else doubles."""

    def of_partition(batches):
        from pyspark import TaskContext

        part, held = None, []

        def add(part):
            if not held:
                return part
            one = Part.of(np.vstack(held))
            held.clear()
            return one if part is None else part.merged(one)

        for batch in batches:
            y = blocks(batch)
            while len(y):
                room = ROWS - sum(map(len, held))
                held.append(y[:room])
                y = y[room:]
                if sum(map(len, held)) == ROWS:
                    part = add(part)
        part = add(part)
        if part is not None:
            yield pa.RecordBatch.from_pandas(part.row(TaskContext.get().partitionId()), schema=pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("scaled", pa.binary())]))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = None
        for row in rows.sort_values("node").itertuples():
            one = _from_row(row, exact)
            part = one if part is None else part.merged(one)
        return part.row(key[0])

    level, at = stored(rows.mapInArrow(of_partition, PART), folder, "part0", dictionary=False), 0
    while True:
        last = level.agg(F.count("*"), F.max("node")).first()
        if last[0] < 2:
            break
        at += 1
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("node_")).applyInPandas(merge, PART)
        level = stored(level, folder, f"part{at}", dictionary=False)
    whole = level.toPandas()  # one part: at most as many rows as dimensions, and one more
    return _from_row(next(whole.itertuples()), exact) if len(whole) else None


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding (of doubles) of the vectors that take part, and the number of their entries."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.filter(F.coalesce(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False)))
    sizes = {r[0]: r[1] for r in v.groupBy(F.size("embedding")).count().collect()}  # a row for each number of entries
    dim = max(sizes, key=lambda d: (sizes[d], d), default=0)
    return v.filter(F.size("embedding") == dim), dim


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n, deviation, whitened (array by falling eigenvalue), explained (array), identity_error."""
    spark = shipped(vectors.sparkSession)
    folder = work_folder(spark)
    v, dim = usable(vectors)
    kind = v.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>"
    whole = decomposed(v.select("embedding"), lambda b: integers(_matrix(b.column(0), dim)), folder) if dim else None
    if whole is None:
        return spark.createDataFrame([], f"{out}, identity_error double")
    e, axes = whole.spread()
    e, axes = e[: min(dim, whole.n)], axes[: min(dim, whole.n)]
    some = e > (1e-12 * e[0] if e[0] > 0 else 0)
    some &= np.arange(len(e)) < components
    explained, e, axes = (e / e.sum())[some] if e[0] > 0 else e[:0], e[some], axes[some]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.argmax(np.abs(axes), axis=1)])[:, None]
    n, sums = whole.n, whole.sums
    mean = (sums / n).astype(np.float64)
    scaled = axes.T / np.sqrt(e)
    narrow = all(abs(int(s)) < 1 << 62 for s in sums)
    explained = explained.tolist()

    def white(y: np.ndarray) -> np.ndarray:
        return (y - mean) @ scaled

    def deviations(y: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2, exactly; SHIFT cancels out."""
        far = float(np.abs(y).max(initial=0)) * n + max(abs(float(s)) for s in sums)
        if narrow and far**2 * dim < 2.0**62:
            return ((n * y - sums.astype(np.int64)) ** 2).sum(1).tolist()
        exact = (((n * y.astype(object) - sums) ** 2).sum(1)).tolist()
        return [d if d < 1 << 63 else None for d in exact]

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = integers(_matrix(part.column(1), dim))
                w = white(y)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
                columns = [part.column(0), pa.array(np.full(len(y), n)), pa.array(deviations(y), pa.int64()), lists(w), lists(np.tile(explained, (len(y), 1)).reshape(len(y), -1))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened", "explained"])

    error = 0.0
    if len(e):
        again = decomposed(v.select("embedding"), lambda b: white(integers(_matrix(b.column(0), dim))), f"{folder}/white", exact=False)
        error = float(np.abs(again.scaled.T @ again.scaled / n - np.eye(len(e))).max())
    return v.mapInArrow(rows, out).withColumn("identity_error", F.lit(error))


def op12(spark, sf_dir):
    w = whiten(table(spark, sf_dir, "embeddings"))
    x = w.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"), "n", "deviation", "identity_error")
    return x.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error")
