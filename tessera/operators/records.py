"""Training records for the JSONL outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scalars as S

EXTRACT = "extract_from_video"


def _audios(df: DataFrame):
    many = F.col("audio_paths") if "audio_paths" in df.columns else F.lit(None).cast("array<string>")
    one = F.col("audio_path") if "audio_path" in df.columns else F.lit(None).cast("string")
    return S.audio_paths(many, one)


def _record(df: DataFrame, plain: str, with_audio: str, answer) -> DataFrame:
    x = df.withColumn("_a", _audios(df))
    heard = F.size("_a") > 0
    prompt = F.when(heard, F.lit(with_audio)).otherwise(F.lit(plain))
    return x.select(S.messages(prompt, answer, K.SYSTEM_PROMPT).alias("messages"), F.array("video_path").alias("videos"), F.when(heard, F.col("_a")).alias("audios"), "meta")


def binary_records(samples: DataFrame) -> DataFrame:
    """samples(video_path, meta[, audio_path, audio_paths]) -> messages, videos, audios (null without sound), meta."""
    return _record(samples, K.BINARY_PROMPT, K.BINARY_AUDIO_PROMPT, F.col("meta.overall_label"))


def structured_records(samples: DataFrame) -> DataFrame:
    """The same with the JSON answer of five keys."""
    part = lambda k: F.col(f"meta.{k}")
    return _record(samples, K.STRUCTURED_PROMPT, K.STRUCTURED_AUDIO_PROMPT, S.structured_answer(part("overall_label"), part("video_label"), part("audio_label"), part("modality_type")))


def with_audio(records: DataFrame, root: str) -> DataFrame:
    """An existing record with audios = the derived path of its first video; records without a video fail the query."""
    first = F.try_element_at("videos", F.lit(1))
    checked = F.when(first.isNotNull(), S.audio_target(first, root)).otherwise(F.raise_error(F.lit("a record without videos")))
    return records.withColumn("audios", F.array(checked)).drop("_line_number")


def extraction_plan(samples: DataFrame, root: str, existing: DataFrame, dry_run: bool = False, skip: bool = False, overwrite: bool = False) -> DataFrame:
    """samples(video_path, audio_path, handling) with target, audio_exists and to_extract.

    The target is the sample's own sound file if it names one and its handling is known, else the derived one; a
    missing handling is extract_from_video. Videos that differ in their suffix alone would share a derived target: each of
    these gets one that keeps the suffix."""
    handling = F.coalesce("handling", F.lit(EXTRACT))
    given = F.col("audio_path").isNotNull() & handling.isin("paired_file", EXTRACT)
    x = samples.withColumn("handling", handling).withColumn("_derived", F.when(~given, S.audio_target("video_path", root)))
    shared = x.groupBy(F.col("_derived").alias("_of")).agg((F.min("video_path") != F.max("video_path")).alias("_shared")).filter("_of IS NOT NULL AND _shared")
    x = x.join(shared, F.col("_derived") == F.col("_of"), "left")
    target = F.when(given, F.col("audio_path")).when(F.col("_shared"), S.own_audio_target("video_path", root)).otherwise(F.col("_derived"))
    x = x.withColumn("target", target).drop("_derived", "_of", "_shared").join(existing.select(F.col("path").alias("target"), F.lit(True).alias("_there")), "target", "left")
    there = F.coalesce("_there", F.lit(False))
    go = (F.col("handling") == EXTRACT) & F.lit(not dry_run) & F.lit(not skip) & (F.lit(overwrite) | ~there)
    return x.withColumn("audio_exists", there).withColumn("to_extract", go).drop("_there")
