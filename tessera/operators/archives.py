"""Zip archives unpacked member by member: what is dealt to tasks is members, not archives, so a large archive is spread too.

`members` reads the directories of the archives, `unzipped` deals the members to tasks, which write them below their
archive's folder, and adds up a manifest. Archives and folders are in storage that all executors share: local paths of a
shared mount, or stores that pyarrow knows by their scheme. A member is written under another name first, so that a task
that is repeated, or runs twice, leaves whole files."""

from __future__ import annotations

import os
import posixpath
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import is_video, name_of

MEMBER = "archive_path string, output_dir string, member string, size bigint, error_type string, error string"
MANIFEST = "archive_path string, output_dir string, status string, video_count bigint, extractor string, error_type string, error string"
_COLUMNS = [c.split()[0] for c in MEMBER.split(", ")]
CHUNK, ROWS = 1 << 20, 4096


def _store(path: str):
    """The file system of a path and the path inside it; None for local ones."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _opened(path: str) -> zipfile.ZipFile:
    system, inner = _store(path)
    return zipfile.ZipFile(open(inner, "rb") if system is None else system.open_input_file(inner))  # noqa: SIM115


def _written(source, target: str) -> int:
    """Copies a stream in chunks to a file that appears whole; its size."""
    system, inner = _store(target)
    folder, part, n = posixpath.dirname(inner), f"{inner}.{uuid.uuid4().hex}.part", 0
    if system is None:
        os.makedirs(folder, exist_ok=True)
    else:
        system.create_dir(folder, recursive=True)
    with open(part, "wb") if system is None else system.open_output_stream(part) as out:
        while data := source.read(CHUNK):
            out.write(data)
            n += len(data)
    os.replace(part, inner) if system is None else system.move(part, inner)
    return n


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"size": "Int64"})


def members(archives: DataFrame) -> DataFrame:
    """archives(archive_path, output_dir) -> a row for each file in them; one with an error for an archive that can't be read."""

    def run(frames):
        for f in frames:
            rows = []
            for a, o in zip(f["archive_path"], f["output_dir"], strict=True):
                try:
                    with _opened(a) as z:
                        rows += [(a, o, x.filename, x.file_size, None, None) for x in z.infolist() if not x.is_dir()]
                except Exception as e:
                    rows.append((a, o, None, None, type(e).__name__, str(e)))
                while len(rows) >= ROWS:
                    yield _frame(rows[:ROWS])
                    rows = rows[ROWS:]
            yield _frame(rows)

    return archives.select("archive_path", "output_dir").mapInPandas(run, MEMBER)


def _unpacked_members(found: DataFrame) -> DataFrame:
    """The members, each written, with the size that was written or an error."""

    def run(frames):
        at, z = None, None
        for f in frames:
            rows = []
            for a, o, m in zip(f["archive_path"], f["output_dir"], f["member"], strict=True):
                try:
                    if m.startswith("/") or ".." in m.replace("\\", "/").split("/"):
                        raise ValueError(f"a member outside its folder: {m}")
                    if at != a:
                        at, z = a, _opened(a)
                    with z.open(m) as source:
                        rows.append((a, o, m, _written(source, posixpath.join(o, m)), None, None))
                except Exception as e:
                    rows.append((a, o, m, None, type(e).__name__, str(e)))
            yield _frame(rows)

    dealt = found.repartition("archive_path", "member").sortWithinPartitions("archive_path", "member")
    return dealt.mapInPandas(run, MEMBER)


def unzipped(archives: DataFrame) -> DataFrame:
    """archives(archive_path, output_dir) -> the manifest: extracted, or failed with its first error; an archive without a video fails."""
    found = members(archives)
    done = _unpacked_members(found.filter("member IS NOT NULL")).unionByName(found.filter("member IS NULL"))
    first = F.min(F.when(F.col("error_type").isNotNull(), F.struct(F.coalesce("member", F.lit("")).alias("m"), "error_type", "error")))
    by = done.groupBy("archive_path", "output_dir").agg(F.count(F.when(F.col("error_type").isNull() & is_video(name_of("member")), 1)).alias("n"), first.alias("e"))
    x = archives.select("archive_path", "output_dir").distinct().join(by, ["archive_path", "output_dir"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ok, none = F.col("e").isNull() & (F.col("n") > 0), F.col("e").isNull()
    return x.select(
        "archive_path", "output_dir", F.when(ok, "extracted").otherwise("failed").alias("status"), F.when(ok, F.col("n")).otherwise(0).cast("long").alias("video_count"), F.lit("zipfile").alias("extractor"),
        F.when(~ok & none, "ValueError").otherwise(F.col("e.error_type")).alias("error_type"), F.when(~ok & none, "no video in the archive").otherwise(F.col("e.error")).alias("error"),
    )
