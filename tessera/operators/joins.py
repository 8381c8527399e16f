"""Look-ups: by several keys in priority order, by directory, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import first_filled, is_video, lookup_keys, metadata_json, name_of, normalised_stem, parent_of, path_candidates


def unambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value for the keys that exactly one distinct value has."""
    g = rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_last"), F.count("*").alias("rows"))
    return g.filter(F.col(value) == F.col("_last")).select(key, value, "rows")


def priority_lookup(df: DataFrame, keys: Column, index: DataFrame, key: str, value: str, id_: str) -> DataFrame:
    """df with value and matched_at of the first of its keys that the index has; null without one. id_ identifies a row.

    Keys are exploded, joined by equality and the first hit is taken as a minimum: never a join on alternatives."""
    probes = df.select(F.col(id_).alias("_id"), F.posexplode(keys).alias("_at", "_key"))
    hits = probes.join(index.select(F.col(key).alias("_key"), F.col(value).alias("_value")), "_key")
    best = hits.groupBy("_id").agg(F.min(F.struct("_at", "_value")).alias("_hit"))
    return df.join(best, F.col(id_) == F.col("_id"), "left").select(*df.columns, F.col("_hit._value").alias(value), F.col("_hit._at").cast("long").alias("matched_at"))


def metadata_index(metadata: DataFrame, root: str) -> DataFrame:
    """metadata(row map) -> key, row_json: the keys of all candidate paths that belong to one row alone."""
    m = metadata.select(metadata_json("row").alias("row_json"), F.explode(path_candidates("row", root)).alias("path"))
    return unambiguous(m.select("row_json", F.explode(lookup_keys("path", root)).alias("key")).distinct(), "key", "row_json").select("key", "row_json")


def with_metadata(listing: DataFrame, metadata: DataFrame, root: str) -> DataFrame:
    """listing(path, ..) with row_json and matched_at: all five keys of a path are tried in order."""
    return priority_lookup(listing, lookup_keys("path", root), metadata_index(metadata, root), "key", "row_json", "path")


def expected_but_missing(metadata: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """metadata(row, row_number) -> expected_path, row: videos that the metadata names and the listing lacks, the first row of each."""
    want = metadata.select("row_number", "row", F.explode(path_candidates("row", root)).alias("expected_path")).filter(is_video(name_of("expected_path")))
    first = want.groupBy("expected_path").agg(F.min_by("row", "row_number").alias("row"))
    return first.join(listing.select(F.col("path").alias("expected_path")), "expected_path", "left_anti")


def paired_audio(videos: DataFrame, audios: DataFrame) -> DataFrame:
    """videos(path) with audio_path: the least sound file of the same directory and key; null without one."""
    key = lambda p: normalised_stem(name_of(p))
    a = audios.groupBy(parent_of("path").alias("_dir"), key("path").alias("_key")).agg(F.min("path").alias("audio_path"))
    v = videos.withColumn("_d", parent_of("path")).withColumn("_k", key("path"))
    return v.join(a, (F.col("_d") == F.col("_dir")) & (F.col("_k") == F.col("_key")), "left").drop("_d", "_k", "_dir", "_key")


def audio_handling(paired: DataFrame, probed: DataFrame, require: bool = True) -> DataFrame:
    """paired(path, audio_path), probed(path, has_stream) -> with handling: paired_file, extract_from_video or missing_audio.

    Without `require`, videos without sound are kept for extraction and flagged by audio_exists."""
    x = paired.join(probed.select("path", "has_stream"), "path", "left")
    exists = F.col("audio_path").isNotNull() | F.coalesce("has_stream", F.lit(False))
    kind = F.when(F.col("audio_path").isNotNull(), "paired_file").when(exists | F.lit(not require), "extract_from_video").otherwise("missing_audio")
    return x.withColumn("handling", kind).withColumn("audio_exists", exists)


def split_of(row: str = "row") -> Column:
    return first_filled(*[F.try_element_at(F.col(row), F.lit(k)) for k in ("split", "original_split", "partition")])
