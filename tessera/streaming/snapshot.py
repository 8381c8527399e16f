"""Metrics of a growing folder of predictions, from counts kept in segments, as a log-structured store keeps them.

A trigger writes the counts of its own rows as a segment of one trigger, so what it writes follows its batch, not the
history. When the number of triggers is a multiple of FAN, FAN^2 and so on, the last FAN segments of a size are merged
into one; each count is so written again once for every power of FAN, and about FAN segments of each size are there. The
metrics after a trigger come from the segments that cover all triggers so far.

What a trigger writes depends on its number and rows alone. So a trigger that is repeated after a failure replaces its own
segments; inputs of a merge are deleted by the next trigger, when the merge is known to be whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.metrics import metrics_document

FAN = 4
KEY = ("label", "pred", "p_fake")


def _path(spark: SparkSession, path: str, *below: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path, *below) if below else spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def segments(spark: SparkSession, table: str) -> list[tuple[int, int]]:
    """The first and last trigger of each segment that is there, whole."""
    p, fs = _path(spark, table)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith("segment=")]
    whole = [n for n in names if fs.exists(_path(spark, f"{table}/{n}", "_SUCCESS")[0])]
    return sorted(tuple(map(int, n.removeprefix("segment=").split("-"))) for n in whole)


def covering(known: list[tuple[int, int]], before: int | None = None) -> list[tuple[int, int]]:
    """The widest segments that cover all triggers from the first on, each once, up to the one before `before`."""
    at, out = 0, []
    while fit := [s for s in known if s[0] == at and (before is None or s[1] < before)]:
        out.append(max(fit))
        at = out[-1][1] + 1
    return out


def _segment(table: str, s: tuple[int, int]) -> str:
    return f"{table}/segment={s[0]}-{s[1]}"


def latest(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """label, pred, p_fake, n: counts after the last trigger (below `before`), a key once for each segment; None if there are none."""
    live = covering(segments(spark, table), before)
    return spark.read.parquet(*[_segment(table, s) for s in live]) if live else None


def _merged(spark: SparkSession, table: str, last: int) -> None:
    """The merges that are due after trigger `last`."""
    size = FAN
    while (last + 1) % size == 0:
        parts = [(at, at + size // FAN - 1) for at in range(last + 1 - size, last + 1, size // FAN)]
        rows = spark.read.parquet(*[_segment(table, s) for s in parts]).groupBy(*KEY).agg(F.sum("n").alias("n"))
        rows.write.mode("overwrite").parquet(_segment(table, (parts[0][0], last)))
        size *= FAN


def watch(spark: SparkSession, source: str, schema: StructType | str, table: str, checkpoint: str, on_snapshot, fmt: str = "parquet", files_per_trigger: int = 1):
    """Starts a query that reads what is there and ends; on_snapshot(metrics, batch id) is called after each trigger.

    A restart goes on where the checkpoint ended. A trigger without rows writes an empty segment."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(source)

    def trigger(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.groupBy(*KEY).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(_segment(table, (batch_id, batch_id)))
        _merged(spark, table, batch_id)
        on_snapshot(metrics_document(latest(spark, table, batch_id + 1), weight="n"), batch_id)
        known = segments(spark, table)
        live = covering(known, batch_id)  # what the trigger before left, whole; it covers its inputs
        for s in known:
            if s[1] < batch_id and s not in live and any(a <= s[0] and s[1] <= b for a, b in live):
                p, fs = _path(spark, _segment(table, s))
                fs.delete(p, True)

    return stream.writeStream.foreachBatch(trigger).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
