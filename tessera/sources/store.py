"""Tables of intermediate data in the shared folder, written once, with what was observed while they were written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; on a single machine, where that is unset, below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-files-{uuid.uuid4().hex}"


def staged(df: DataFrame, measures: dict[str, Column] | None = None, path: str | None = None) -> tuple[DataFrame, dict]:
    """df as a written table, and the values of aggregates over it, taken in the same pass (`observe`).

    Whatever is made of the table reads it, and not the source of df again."""
    spark = df.sparkSession
    path = path or new_folder(spark)
    seen = Observation(f"staged-{uuid.uuid4().hex}") if measures else None
    (df.observe(seen, *[c.alias(k) for k, c in measures.items()]) if measures else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if measures else {}


class Checks:
    """Assertions over rows as measures of a pass: how many rows break each, and the least example of them."""

    def __init__(self):
        self.rules: dict[str, tuple[Column, Column]] = {}

    def forbid(self, what: str, broken: Column, example: Column) -> Checks:
        self.rules[what] = (F.coalesce(broken, F.lit(False)), example)
        return self

    def measures(self) -> dict[str, Column]:
        out = {}
        for i, (broken, example) in enumerate(self.rules.values()):
            out[f"broken_{i}"], out[f"example_{i}"] = F.count(F.when(broken, 1)), F.min(F.when(broken, example.cast("string")))
        return out

    def verify(self, seen: dict) -> None:
        bad = [f"{what}: {seen[f'broken_{i}']} rows, such as {seen[f'example_{i}']!r}" for i, what in enumerate(self.rules) if seen[f"broken_{i}"]]
        if bad:
            raise ValueError("; ".join(bad))
