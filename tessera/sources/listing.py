"""Listing of directory trees, level by level: the directories of a level are dealt to tasks, which list one directory at a time.

So a deep or lopsided tree is spread over tasks like any other. Tasks list through the file system that a path's scheme
names (local paths, file:, hdfs:, s3:, gs: and the like, as pyarrow has them); hidden and empty files are listed too. A
level is written into the shared folder, so the listing survives lost executors and is never walked again by what reads it."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.constants import AUDIO_EXTENSIONS, LISTING_SCHEMA, VIDEO_EXTENSIONS
from tessera.functions.scalars import is_ignored, is_video
from tessera.sources.store import new_folder, staged

DEEPEST, ROWS = 256, 8192
_LEVEL = f"{LISTING_SCHEMA}, directory boolean"


def _local(path: str) -> Iterator[tuple]:
    """name, length, error, directory of the entries of a local directory; links that lead nowhere are entries with an error."""
    for e in os.scandir(path):
        try:
            yield e.name, None if e.is_dir() else e.stat().st_size, None, e.is_dir()
        except OSError as x:
            yield e.name, None, type(x).__name__, False


def _remote(path: str) -> Iterator[tuple]:
    """The same of a directory of another store."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    for x in system.get_file_info(fs.FileSelector(inner)):
        yield x.base_name, x.size, None, x.type == fs.FileType.Directory


def _entries(path: str, endings: tuple[str, ...] | None) -> Iterator[tuple]:
    """path, name, parent, length, error, directory of what a directory holds; nothing if it can't be listed."""
    try:
        for name, length, error, directory in _remote(path) if "://" in path else _local(path):
            if directory or endings is None or name.lower().endswith(endings):
                yield posixpath.join(path, name), name, path, length, error, directory
    except OSError:
        return


def _absolute(root: str) -> str:
    """A local path made absolute, without file:; paths of other stores stay."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return root.rstrip("/") if "://" in root else os.path.abspath(os.path.expanduser(root))


def files(spark: SparkSession, root: str, endings: tuple[str, ...] | None = None) -> DataFrame:
    """path, name, parent, length, error of every file below root; none if it isn't there.

    endings: lower-case ends of names that are wanted; tasks drop others at once."""
    import pandas as pd

    names = [c.split()[0] for c in _LEVEL.split(", ")]

    def one_level(frames):
        for f in frames:
            rows = []
            for path in f["path"]:
                for entry in _entries(path, endings):
                    rows.append(entry)
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names).astype({"length": "Int64"})
                        rows = []
            yield pd.DataFrame(rows, columns=names).astype({"length": "Int64"})

    folder, cores = new_folder(spark), spark.sparkContext.defaultParallelism
    level, n, levels = spark.createDataFrame([(_absolute(root),)], "path string"), 1, []
    while n:
        if len(levels) == DEEPEST:
            raise ValueError(f"more than {DEEPEST} levels below {root}: a link that leads back?")
        dealt = level.select("path").repartition(min(n, 4 * cores), "path")
        table, seen = staged(dealt.mapInPandas(one_level, _LEVEL), {"n": F.count(F.when(F.col("directory"), 1))}, f"{folder}/{len(levels)}")
        levels.append(f"{folder}/{len(levels)}")
        level, n = table.filter("directory"), seen["n"]
    return spark.read.schema(_LEVEL).parquet(*levels).filter("NOT directory").drop("directory")


def _media(spark: SparkSession, root: str, endings: tuple[str, ...], wanted: Column) -> DataFrame:
    return files(spark, root, endings).filter(wanted).orderBy("path")


def videos(spark: SparkSession, root: str) -> DataFrame:
    return _media(spark, root, VIDEO_EXTENSIONS, is_video("name") & ~is_ignored("path"))


def audios(spark: SparkSession, root: str) -> DataFrame:
    from tessera.functions.scalars import is_audio

    return _media(spark, root, AUDIO_EXTENSIONS, is_audio("name") & ~is_ignored("path"))


def archives(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root, (".zip",)).orderBy("path")


def count_videos(spark: SparkSession, root: str) -> DataFrame:
    return files(spark, root, VIDEO_EXTENSIONS).filter(is_video("name")).agg(F.count("*").alias("n"))


def directories(spark: SparkSession, root: str) -> list[str] | None:
    """The names of the directories right below root, empty ones too; None if root isn't there. Asked of Hadoop's file system, by the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else None
