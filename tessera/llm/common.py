"""Shared helpers: word patterns, the shared work folder, size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: The largest side, in bytes of its rows, that is sent to every executor.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only on a single machine, where that setting may be empty (tests), a local temporary folder is used."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, narrow: bool = False, dictionary: bool = True, compression: str = "zstd") -> DataFrame:
    """Writes df into the shared folder and reads it back: the lineage ends there and survives lost executors.

    narrow: a side table of a few bytes a row goes into an eighth of the files. dictionary: False for hashes, which don't repeat.
    compression: "uncompressed" for tables that are nearly all hashes, of which it takes off a twentieth for much of the time."""
    path = f"{folder}/{name}"
    if narrow:
        df = df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what the first round frees lets go of the rest
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def tidied() -> None:
    """Gives the memory that a Python worker no longer needs back to the system, at the end of a task: workers are used again."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(df: DataFrame, row_bytes, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a stored df for broadcast if its rows are below the limit; otherwise the planner shuffles it.

    row_bytes: the size of a row, or a column with the size of each."""
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def text_of(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text):
    """The words of a text column as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text):
    """The number of words, without building them: word characters that follow white space or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shipped(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once for each Spark context, so that it need not be installed on them."""
    sc = spark.sparkContext
    if not getattr(sc, "_tessera_shipped", False):
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="tessera-code-")) / "tessera_code.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(to))
        sc._tessera_shipped = True
    return spark
