"""Readers with explicit schemas: metadata, folds, JSONL and Arrow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.constants import LABELS, RECORD_SCHEMA
from tessera.functions.scalars import joined, normalise_label, strip
from tessera.operators.ranges import numbered
from tessera.sources import arrow
from tessera.sources.store import Checks


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def file_path() -> Column:
    """The path of the file that a row was read from, as it is named there: Spark gives it percent-encoded; file: is left out."""
    plain = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))  # url_decode takes + for a blank
    return F.regexp_replace(F.url_decode(plain), "^file:/+", "/")


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    """row_number, row (map of all named columns, as text); empty if the file isn't there."""
    if not exists(spark, path):
        return spark.createDataFrame([], "row_number bigint, row map<string,string>")
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    named = [c for c in raw.columns if c.strip() and not c.startswith("_c")]
    pairs = [x for c in named for x in (F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit("")))]
    return raw.select(F.monotonically_increasing_id().alias("row_number"), F.create_map(*pairs).alias("row"))


def fold_lists(spark: SparkSession, folder: str, folds: int = 5) -> DataFrame:
    """fold, split, subject_id from train_N.txt and test_N.txt: trimmed, without blanks and repetitions."""
    t = spark.read.text(folder, pathGlobFilter="*_*.txt").select(strip("value").alias("subject_id"), F.regexp_extract(F.col("_metadata.file_name"), r"^(train|test)_(\d+)\.txt$", 1).alias("split"), F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.txt$", 1).alias("_n"))
    t = t.filter("split <> '' AND subject_id <> ''")
    return t.select(F.col("_n").cast("int").alias("fold"), "split", "subject_id").filter(F.col("fold").between(1, folds)).distinct()


def assert_folds(lists: DataFrame, folds: int = 5) -> None:
    """Fails if a list is missing or empty, or if a subject is in both lists of a fold. One pass; a row for each fold."""
    each = lists.groupBy("fold", "subject_id").agg(F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") == "test").alias("test"))
    both = F.col("train") & F.col("test")
    count = lambda c: F.count(F.when(c, 1))
    seen = {r["fold"]: r for r in each.groupBy("fold").agg(count(F.col("train")).alias("train"), count(F.col("test")).alias("test"), count(both).alias("both"), F.min(F.when(both, F.col("subject_id"))).alias("first")).collect()}
    lost = [(f, s) for f in range(1, folds + 1) for s in ("train", "test") if f not in seen or not seen[f][s]]
    if lost:
        raise ValueError(f"missing or empty fold lists: {lost}")
    twice = [(f, r["both"], r["first"]) for f, r in sorted(seen.items()) if r["both"]]
    if twice:
        raise ValueError(f"subjects in train and test (fold, how many, the first): {twice}")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line_number (from 1, blank lines count), index (from 0, blank lines don't), file (its path).

    Lines are ordered by file, then by the block of the file that a task read, then by their place in the block."""
    raw = spark.read.text(path).select("value", file_path().alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    x = numbered(raw, "file", "_block", "_at", name="line_number").withColumn("line_number", F.col("line_number") + 1)
    full = numbered(x.filter(strip("value") != ""), "line_number", name="index")
    return full.select("value", "line_number", "index", "file")


def eval_jsonl(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """index, line_number, video_path, audio_paths, label, meta, source_record. Media paths are taken from the file's folder."""
    x = lines(spark, path)
    if max_samples is not None:
        x = x.filter(F.col("index") < max_samples)
    r = x.withColumn("r", F.from_json("value", RECORD_SCHEMA)).withColumn("base", F.regexp_replace("file", r"/[^/]*$", ""))
    video = F.try_element_at("r.videos", F.lit(1))
    audios = F.coalesce(F.transform("r.audios", lambda a: joined(F.col("base"), a)), F.array().cast("array<string>"))
    return r.select("index", "line_number", joined(F.col("base"), video).alias("video_path"), audios.alias("audio_paths"), normalise_label(F.col("r.meta")["overall_label"]).alias("label"), F.col("r.meta").alias("meta"), F.col("value").alias("source_record"))


def sample_checks() -> Checks:
    """What must not be among evaluation samples, measured while they are written."""
    bad = F.col("video_path").isNull() | ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))
    return Checks().forbid("lines without a video or with a bad label", bad, F.col("line_number"))


def assert_samples(samples: DataFrame) -> None:
    checks = sample_checks()
    checks.verify(samples.agg(*[c.alias(k) for k, c in checks.measures().items()]).first().asDict())


def jsonl(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """JSON lines with a schema; with `lenient` a missing file has no rows."""
    if lenient and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def jsonl_numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return lines(spark, path).select(F.from_json("value", schema).alias("r"), F.col("line_number").alias("_line_number")).select("r.*", "_line_number")


def split_rows(frames: dict[str, DataFrame]) -> DataFrame:
    """The union of frames by split, with the split's name; a single frame may have the name ''."""
    out = None
    for name, f in frames.items():
        f = f.withColumn("split", F.coalesce(F.col("split"), F.lit(name)) if "split" in f.columns else F.lit(name))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def arrow_dataset(spark: SparkSession, files: list[str], schema: str) -> DataFrame:
    """Arrow IPC files (streams or files), read on the executors, a task for each record batch; see `arrow`."""
    return arrow.read(spark, files, schema)


def metrics_of_runs(spark: SparkSession, runs: DataFrame, schema: str) -> DataFrame:
    """runs(output_dir, ..) with the metrics of output_dir/metrics.json; null where there are none."""
    dirs = [r[0] for r in runs.select("output_dir").distinct().collect()]  # the runs of one configuration
    there = [f"{d}/metrics.json" for d in dirs if exists(spark, f"{d}/metrics.json")]
    if there:
        m = spark.read.schema(schema).option("multiLine", True).json(there).withColumn("_dir", F.regexp_replace(file_path(), "/metrics.json$", ""))
    else:
        m = spark.createDataFrame([], schema).withColumn("_dir", F.lit(""))
    return runs.join(F.broadcast(m), F.col("output_dir") == F.col("_dir"), "left").drop("_dir")  # a row for each run


