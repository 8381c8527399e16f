"""Sinks: JSONL, JSON, CSV, HTML, and the bundles made of them. All overwrite."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.constants import SUMMARY_FIELDS
from tessera.operators import metrics as M
from tessera.operators import stats
from tessera.operators.ranking import per_group


def write_jsonl(df: DataFrame, path: str, dry_run: bool = False, by: str | None = None, order=None) -> None:
    """JSON lines in the order of columns, text as it is, null fields left out; a folder for each value of `by`.

    With `by`, rows of a folder come together before they are written (REBALANCE), and Spark splits folders that are large;
    so a folder has a file for each part of advisory size, neither one task's worth nor one from every task. With `order`
    the lines are sorted by it over all files, in each folder."""
    if not dry_run:
        if order is not None:
            keys = [by, order] if by else [order]
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        elif by:
            df = df.hint("rebalance", by)
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver through Hadoop's file system, so that any scheme will do."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def write_json(one: DataFrame, path: str, sort: bool = False) -> dict:
    """A frame of one row as indented JSON; the row as a dictionary."""
    rows = one.limit(1).collect()
    row = rows[0].asDict(True) if rows else {}
    write_text(one.sparkSession, path, json.dumps(row, ensure_ascii=False, indent=2, sort_keys=sort, default=str) + "\n")
    return row


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_issues(found: DataFrame, path: str) -> None:
    write_csv(found.select("dataset", "split", "reason", "expected_path", "metadata_json"), path)


def write_shards(numbered_lines: DataFrame, path: str) -> None:
    """value, shard, idx -> text files in a folder for each shard, lines in the order of idx over the files of a folder."""
    x = numbered_lines.select("shard", "idx", "value").repartitionByRange("shard", "idx").sortWithinPartitions("shard", "idx")
    x.drop("idx").write.mode("overwrite").partitionBy("shard").text(path)


def summary_rows(df: DataFrame) -> DataFrame:
    """The columns of a batch summary; arrays and maps as JSON."""

    def shown(c: str):
        if c not in df.columns:
            return F.lit(None).cast("string").alias(c)
        nested = df.schema[c].dataType.typeName() in ("array", "map", "struct")
        return (F.to_json(c) if nested else F.col(c)).alias(c)

    return df.select(*[shown(c) for c in SUMMARY_FIELDS])


def add_runs(rows: DataFrame, path: str) -> None:
    """Adds the rows of runs to the table of all runs. A run that is there already is replaced; no other is read or written."""
    x = summary_rows(rows).withColumn("run", F.col("name"))
    x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def all_runs(spark: SparkSession, path: str) -> DataFrame:
    """The table of all runs, a row for each, with the columns of a summary."""
    return spark.read.option("recursiveFileLookup", True).parquet(path).select(*SUMMARY_FIELDS)


def write_summary(df: DataFrame, folder: str) -> None:
    """summary.json, a list with an entry for each run of the configuration, and summary.csv."""
    rows = [r.asDict(True) for r in df.select(*[c for c in SUMMARY_FIELDS if c in df.columns]).collect()]  # a row for each run
    write_text(df.sparkSession, f"{folder}/summary.json", json.dumps(rows, ensure_ascii=False, indent=2, default=str) + "\n")
    write_csv(summary_rows(df), f"{folder}/summary.csv")


def confusion_rows(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A row for each label: `label\\prediction`, Fake, Real."""
    long = M.confusion_long(df, label, pred)
    return long.groupBy(F.col("label").alias("label\\prediction")).pivot("pred", ["Fake", "Real"]).agg(F.sum("n"))


def score_rows(predictions: DataFrame) -> DataFrame:
    """index, video_path, label, pred, p_real, p_fake as text, missing ones empty."""
    return predictions.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("index", "video_path", "label", "pred", "p_real", "p_fake")])


def percent_text(v) -> str:
    return "N/A" if v is None else f"{v * 100:.2f}%"


def decimal_text(v) -> str:
    return "N/A" if v is None else f"{v:.4f}"


def summary_html(document: dict) -> str:
    """A page with the rates, in percent, the two ranking metrics, with four decimals, and the matrix of a metrics document."""
    shown = {**dict.fromkeys(("accuracy", "fake_recall", "real_recall", "balanced_accuracy"), percent_text), "roc_auc": decimal_text, "average_precision": decimal_text}
    rows = "".join(f"<tr><th>{html.escape(k)}</th><td>{text(document.get(k))}</td></tr>" for k, text in shown.items())
    matrix = "".join("<tr><th>" + name + "</th>" + "".join(f"<td>{n}</td>" for n in line) + "</tr>" for name, line in zip(("Fake", "Real"), document.get("confusion_matrix") or [[0, 0], [0, 0]], strict=True))
    title = html.escape(str(document.get("run_name") or "evaluation"))
    return f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1><p>{document.get('num_samples', 0)} samples</p><table>{rows}</table><table><tr><th></th><th>Fake</th><th>Real</th></tr>{matrix}</table>\n"


def write_evaluation(predictions: DataFrame, bad: DataFrame, folder: str, run_name: str = "", num_bad: int | None = None) -> None:
    """Predictions, bad samples, metrics, matrix, scores, histogram and page. num_bad: the number of bad samples, if it is known."""
    write_jsonl(predictions, f"{folder}/predictions.jsonl")
    write_jsonl(bad, f"{folder}/bad_samples.jsonl")
    count = F.lit(num_bad).cast("long") if num_bad is not None else bad.agg(F.count("*")).scalar()
    document = M.metrics_document(predictions).withColumn("num_bad_samples", count).withColumn("run_name", F.lit(run_name))
    row = write_json(document, f"{folder}/metrics.json")
    write_csv(confusion_rows(predictions), f"{folder}/confusion_matrix.csv")
    write_csv(score_rows(predictions), f"{folder}/scores.csv")
    write_csv(M.histogram(predictions, "p_fake"), f"{folder}/score_histogram.csv")
    write_text(predictions.sparkSession, f"{folder}/summary.html", summary_html(row))


def write_preparation(listing: DataFrame, records: DataFrame, found: DataFrame, folder: str, root: str, dims: list[str], dry_run: bool = False, preview: int = 20, totals: dict | None = None) -> None:
    """Outputs (unless it is a dry run), scan summary, statistics, issues, their totals if known, and previews (always)."""
    write_jsonl(records, f"{folder}/outputs", dry_run, by="output", order=F.try_element_at("videos", F.lit(1)))
    write_json(stats.scan_summary(listing, root), f"{folder}/scan_summary.json", sort=True)
    flat = records.select("output", *[F.col(f"meta.{d}").alias(d) for d in dims])
    write_csv(stats.output_stats(flat, "output", dims), f"{folder}/dataset_stats.csv")
    write_issues(found, f"{folder}/missing_or_invalid.csv")
    if totals is not None:
        write_text(records.sparkSession, f"{folder}/issue_totals.json", json.dumps(totals, indent=2, sort_keys=True) + "\n")
    keyed = records.withColumn("_key", F.try_element_at("videos", F.lit(1)))
    write_jsonl(per_group(keyed, ["output"], preview, "_key", 42).drop("_key"), f"{folder}/preview", by="output")


def write_split(samples: DataFrame, missing: DataFrame, folder: str, preview: int = 20) -> None:
    """Indexes by split and as a whole, missing sound, group manifest, counts and a preview."""
    write_jsonl(samples, f"{folder}/index", by="split", order="video_path")
    write_jsonl(samples, f"{folder}/all", order="video_path")
    write_jsonl(missing, f"{folder}/missing_audio", order="video_path")
    write_jsonl(stats.group_manifest(samples, "group_id", "video_path", ["overall_label", "modality_type"]), f"{folder}/groups")
    dims = {"overall_label": "label_distribution", "modality_type": "modality_type_distribution", "handling": "audio_handling_distribution"}
    write_jsonl(stats.split_summary(samples, "group_id", {k: v for k, v in dims.items() if k in samples.columns}), f"{folder}/split_stats")
    write_jsonl(samples.orderBy("video_path").limit(preview), f"{folder}/preview")
