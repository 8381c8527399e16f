"""Compositions: the three corpora from their files to records and splits, and the evaluation of scored samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scalars as S
from tessera.operators import adapters, joins, metrics, records, splits, stats, validate
from tessera.operators.ranking import per_group, seeded
from tessera.sources import listing, readers, sinks
from tessera.sources.store import Checks, staged
from tessera.plans.config import Preparation


def corpus_a(files: DataFrame, root: str, metadata: DataFrame | None = None, max_per_class: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A listing of category directories -> samples(video_path, meta, subject_id) and issues.

    A listing that has language, generative_method or original_split keeps them; metadata fills only what is blank."""
    parts = S.relative_parts("path", root)
    x = files.withColumn("category", F.try_element_at(parts, F.lit(1))).filter(F.col("category").isin(*K.CATEGORIES))
    good, bad = validate.routed(x, validate.listed_reason())
    found = validate.issues(bad, "a", F.lit(""), "path", F.lit("{}"))
    if metadata is not None:
        good = joins.with_metadata(good, metadata, root)
        lost = joins.expected_but_missing(metadata, files, root).withColumn("reason", F.lit("missing_file"))
        split = F.coalesce(F.nullif(joins.split_of("row"), F.lit("")), F.lit("metadata"))
        found = found.unionByName(validate.issues(lost, "a", split, "expected_path", S.metadata_json("row")))
    else:
        good = good.withColumn("row_json", F.lit(None).cast("string"))
    row = F.from_json("row_json", "map<string,string>")
    labels = S.category_labels("category")
    own = lambda k: F.col(k).cast("string") if k in good.columns else F.lit(None).cast("string")
    meta = F.struct(
        F.lit("a").alias("dataset"), F.col("path").alias("source_path"), *[labels[k].alias(k) for k in ("overall_label", "video_label", "audio_label", "modality_type")],
        *[S.filled(own(k), S.first_present(row, keys)).alias(k) for k, keys in (("language", K.LANGUAGE_KEYS), ("generative_method", K.METHOD_KEYS), ("original_split", K.SPLIT_KEYS))], row.alias("source_metadata"),
    )
    source = F.try_element_at(row, F.lit("source"))
    samples = good.select(F.col("path").alias("video_path"), meta.alias("meta"), S.subject_id(source, parts).alias("subject_id"), labels["overall_label"].alias("overall_label"), labels["modality_type"].alias("modality_type"))
    return per_group(samples, ["overall_label"], max_per_class, "video_path", seed), found


def corpus_b(rows: DataFrame, files: DataFrame, root: str, max_per_class: int | None = None, seed: int = 42, strict_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """Metadata rows -> samples(output, video_path, meta), capped by output and label, and issues."""
    named = S.path_text(rows, "video_path")
    x = rows.withColumn("path", F.when(named != "", S.joined(root, named)))
    there = files.select(F.col("path").alias("_path"), "length", "error", F.lit(True).alias("_found"))
    x = x.join(there, F.col("path") == F.col("_path"), "left").withColumn("found", F.coalesce("_found", F.lit(False)))
    good, bad, _ = validate.routed_once(x, validate.referenced_reason("path"))
    found = validate.issues(bad, "b", S.clean_text("split"), "path", F.to_json(F.struct(*rows.columns)))
    label = S.checked_label("label") if strict_labels else S.label_of_text("label")
    unknown = lambda k: F.lit(K.UNKNOWN).alias(k)
    column = lambda k: F.col(k).cast("string") if k in rows.columns else F.lit(None).cast("string")
    meta = F.struct(
        F.lit("b").alias("dataset"), F.col("path").alias("source_path"), label.alias("overall_label"), unknown("video_label"), unknown("audio_label"), unknown("modality_type"),
        S.first_filled(*map(column, K.ROW_LANGUAGE_KEYS)).alias("language"), S.method_of(*map(column, K.ROW_METHOD_KEYS)).alias("generative_method"), S.clean_text("split").alias("original_split"),
    )
    y = splits.exploded_memberships(good, S.clean_text("split"), S.lenient_bool("open_set_model"), S.lenient_bool("open_set_language"))
    samples = y.select("output", F.col("path").alias("video_path"), meta.alias("meta"), label.alias("overall_label"))
    return per_group(samples, ["output", "overall_label"], max_per_class, "video_path", seed), found


def corpus_c(videos: DataFrame, audios: DataFrame, root: str, probe, val_ratio: float = 0.1, seed: int = 42, require_audio: bool = True) -> tuple[DataFrame, DataFrame]:
    """Listings of videos and sound files -> samples with group_id, audio and split; and the videos without sound."""
    parts, name = S.relative_parts("path", root), S.name_of("path")
    m = S.modality(parts)
    labels = S.category_labels(m)
    x = videos.select(
        "path", F.array_join(parts, "/").alias("relative_path"), m.alias("source_modality"), S.generation_path(m, parts).alias("generation_path"), S.part_after(parts, m).alias("video_source"),
        S.audio_source(parts).alias("audio_source"), S.group_id(m, parts, name).alias("group_id"), *[labels[k].alias(k) for k in ("overall_label", "video_label", "audio_label", "modality_type")],
    )
    paired = joins.paired_audio(x, audios)
    probed = adapters.each_path(paired.filter("audio_path IS NULL"), probe, "said").select("path", (F.col("said") == "true").alias("has_stream"))
    y = joins.audio_handling(paired, probed, require_audio).drop("has_stream").withColumnRenamed("path", "video_path")
    missing = y.filter("handling = 'missing_audio'")
    return splits.group_split(y.filter("handling <> 'missing_audio'"), "group_id", val_ratio, seed), missing


def corpus_c_records(samples: DataFrame, audio_root: str, existing: DataFrame, dry_run: bool = False, skip: bool = False, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """samples of corpus_c -> binary records with their sound file, and the extraction plan.

    A record's sound is the sample's own file, or the one that will be extracted, whether or not it is there yet."""
    plan = records.extraction_plan(samples, audio_root, existing, dry_run, skip, overwrite)
    labels = [F.col(c) for c in ("overall_label", "video_label", "audio_label", "modality_type", "relative_path", "group_id", "source_modality", "generation_path", "video_source", "audio_source") if c in samples.columns]
    x = plan.select("video_path", F.col("target").alias("audio_path"), F.struct(F.lit("c").alias("dataset"), *labels).alias("meta"), F.col("split").alias("output"))
    return render_with(x, records.binary_records, "output"), plan.select("video_path", "target", "handling", "audio_exists", "to_extract")


def extracted(plan: DataFrame, extract) -> DataFrame:
    """Runs the plan's extractions: path, result, error for each video. extract(video path, target) is a side effect."""
    pairs = plan.filter("to_extract").select(F.to_json(F.struct("video_path", "target")).alias("path"))

    def work(pair: str) -> str:
        p = json.loads(pair)
        extract(p["video_path"], p["target"])
        return p["target"]

    done = adapters.each_path(pairs, work)
    return done.select(F.get_json_object("path", "$.video_path").alias("path"), "result", "error")


def prepare_c(spark: SparkSession, p: Preparation, probe, extract=None) -> DataFrame:
    """Runs a preparation of corpus c and writes its bundle; the records, by output. extract(video path, target) may be None: then sound is only planned.

    The tree is walked and its videos are probed once; everything is made of the tables written then."""
    files = listing.files(spark, p.root, K.VIDEO_EXTENSIONS + K.AUDIO_EXTENSIONS).filter(~S.is_ignored("path"))
    samples, missing = corpus_c(files.filter(S.is_video("name")), files.filter(S.is_audio("name")), p.root, probe, p.extra.get("val_ratio", 0.1), p.seed)
    samples, _ = staged(samples)
    audio_root = p.extra.get("audio_root") or f"{p.output_dir}/audio"
    rendered, plan = corpus_c_records(samples, audio_root, listing.files(spark, audio_root, K.AUDIO_EXTENSIONS).select("path"), p.dry_run, extract is None, p.extra.get("overwrite", False))
    if extract is not None:
        done, seen = staged(extracted(plan, extract), Checks().forbid("videos whose sound wasn't extracted", F.col("error").isNotNull(), F.col("path")).measures())
        if seen["broken_0"]:
            raise RuntimeError(f"videos whose sound wasn't extracted: {seen['broken_0']}, such as {seen['example_0']}")
    sinks.write_split(samples, missing, p.output_dir, p.preview)
    sinks.write_csv(stats.audio_handling_counts(samples), f"{p.output_dir}/audio_handling.csv")
    sinks.write_jsonl(rendered, f"{p.output_dir}/outputs", p.dry_run, by="output", order=F.try_element_at("videos", F.lit(1)))
    return rendered


def prepare(spark: SparkSession, p: Preparation, rows: DataFrame | None = None) -> DataFrame:
    """Runs a preparation of corpus a or b and writes its bundle; the records, by output. For corpus c see `prepare_c`.

    Each source is read once: the tree is listed into a table, metadata rows are decided on as they are written, and the
    samples are written once, while labels, subjects and folds are checked. Records, issues, totals, statistics and
    previews come from these tables."""
    files = listing.files(spark, p.root)
    there = listing.directories(spark, p.root)
    before = validate.precondition_issues(spark, p.kind, p.root, there, tuple(K.CATEGORIES) if p.kind == "a" else ())
    modes = ("binary", "structured") if p.mode == "both" else (p.mode,)
    checks = Checks()
    if p.kind == "a":
        metadata = staged(readers.metadata_csv(spark, p.metadata))[0] if p.metadata else None
        samples, found = corpus_a(files, p.root, metadata, p.max_per_class, p.seed)
        if p.folds:
            lists, _ = staged(readers.fold_lists(spark, p.folds))
            readers.assert_folds(lists)
            samples, checks = splits.with_folds(samples, lists, "subject_id"), splits.fold_checks("subject_id")
        else:
            samples = splits.stratified_split(samples, ["overall_label", "modality_type"], "video_path", p.train_ratio, p.seed)
        samples, dims = splits.named_outputs(samples, modes), ["overall_label", "modality_type"]
    elif p.kind == "b":
        samples, found = corpus_b(rows, files, p.root, p.max_per_class, p.seed)
        dims = ["overall_label", "language", "generative_method"]
    else:
        raise ValueError("corpus c is prepared by prepare_c")
    checks.forbid("samples with another label than Real or Fake", ~F.coalesce(F.col("overall_label").isin(*K.LABELS), F.lit(False)), F.col("video_path"))
    samples, seen = staged(samples, checks.measures())
    checks.verify(seen)
    missing = F.col("reason").isin(*K.MISSING_REASONS)
    found, totals = staged(before.unionByName(found), {"missing": F.count(F.when(missing, 1)), "invalid": F.count(F.when(~missing, 1))})
    rendered = None
    for mode in modes:
        render = records.structured_records if mode == "structured" else records.binary_records
        part = samples.filter(F.startswith("output", F.lit(mode))) if p.kind == "a" else samples
        one = render_with(part, render, "output")
        rendered = one if rendered is None else rendered.unionByName(one)
    sinks.write_preparation(files, rendered, found, p.output_dir, p.root, dims, p.dry_run, p.preview, totals)
    return rendered


def render_with(samples: DataFrame, render, *kept: str) -> DataFrame:
    """Records with further columns of their samples: these ride in a struct beside meta."""
    x = render(samples.withColumn("meta", F.struct("meta.*", F.struct(*kept).alias("_kept"))))
    return x.select("messages", "videos", "audios", F.col("meta").dropFields("_kept").alias("meta"), *[F.col(f"meta._kept.{k}").alias(k) for k in kept])


def duration_quantiles(files: DataFrame, probe, seed: int = 42, sample: int = 200) -> DataFrame:
    """files(path) -> q, v, mean: quantiles and mean of the seconds that the probe finds in a seeded sample of files; failures don't count."""
    picked = files.select("path").orderBy(*seeded("path", seed)).limit(sample)
    seconds = adapters.each_path(picked, probe, "said").select(F.col("said").try_cast("double").alias("seconds"))
    return metrics.nearest_rank(seconds, "seconds").crossJoin(F.broadcast(seconds.agg(F.mean("seconds").alias("mean"))))  # one row


def evaluate(samples: DataFrame, load, columns: list[str], folder: str, run_name: str = "", batch: int = 8) -> None:
    """Scores samples, routes failures and writes the evaluation bundle. Samples are read and scored once; bad lines stop it before."""
    checks = readers.sample_checks()
    samples, seen = staged(samples, checks.measures() if "line_number" in samples.columns else {})
    if seen:
        checks.verify(seen)
    results, seen = staged(adapters.scored(samples, load, columns, batch), {"bad": F.count(F.when(F.col("error").isNotNull(), 1))})
    good, bad = adapters.predictions(samples, results)
    sinks.write_evaluation(good, bad, folder, run_name, seen["bad"])


def merged_evaluation(frames: list[DataFrame], bad: list[DataFrame], folder: str, run_name: str = "") -> None:
    """The bundle of the predictions and bad samples that workers wrote, in the order of index, each row with its worker's number."""
    sinks.write_evaluation(staged(tagged_union(frames).orderBy("index"))[0], tagged_union(bad), folder, run_name)


def tagged_union(frames: list[DataFrame], tag: str = "parallel_worker") -> DataFrame:
    """The union of workers' rows with the worker's number, where a row has none of its own."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn(tag, F.coalesce(F.col(tag), F.lit(i).cast("long")) if tag in f.columns else F.lit(i).cast("long"))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out
