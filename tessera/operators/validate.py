"""Validation cascades: the first failing rule is the reason; rows without one are kept, the others become issues."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import MISSING_REASONS
from tessera.functions.scalars import is_video, name_of
from tessera.sources.store import staged


def cascade(*rules: tuple[Column, str | Column]) -> Column:
    """The reason of the first rule that holds; null if none does. Null conditions don't hold."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), reason if isinstance(reason, Column) else F.lit(reason)).otherwise(out)
    return out


def listed_reason() -> Column:
    """For a listing: extension, then errors of the file system, then empty files."""
    error = F.concat(F.lit("stat_error:"), F.col("error"))
    return cascade((~is_video("name"), "invalid_extension"), (F.col("error").isNotNull(), error), (F.col("length") == 0, "zero_size_file"))


def referenced_reason(path: str = "path") -> Column:
    """For rows that name a file, joined with the listing (found, error, length)."""
    error = F.concat(F.lit("stat_error:"), F.col("error"))
    return cascade(
        (F.coalesce(F.col(path), F.lit("")) == "", "missing_video_path_field"), (~is_video(name_of(path)), "invalid_extension"),
        (~F.col("found"), "missing_file"), (F.col("error").isNotNull(), error), (F.col("length") == 0, "zero_size_file"),
    )


def routed(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their reason."""
    x = df.withColumn("reason", reason)
    return x.filter("reason IS NULL").drop("reason"), x.filter("reason IS NOT NULL")


def routed_once(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame, dict]:
    """The same from one pass over df, written as a table, and its totals: rows, missing, invalid."""
    missing = F.col("reason").isin(*MISSING_REASONS)
    totals = {"rows": F.count("*"), "missing": F.count(F.when(missing, 1)), "invalid": F.count(F.when(~missing, 1))}
    x, seen = staged(df.withColumn("reason", reason), totals)
    return x.filter("reason IS NULL").drop("reason"), x.filter("reason IS NOT NULL"), seen


def issues(rejected: DataFrame, dataset: str, split: Column, path: str, metadata: Column) -> DataFrame:
    return rejected.select(F.lit(dataset).alias("dataset"), split.alias("split"), "reason", F.col(path).alias("expected_path"), metadata.alias("metadata_json"))


def issue_totals(found: DataFrame) -> DataFrame:
    """name, n: a row for each reason, and the totals __missing and __invalid."""
    by = found.groupBy("reason").agg(F.count("*").alias("n"))
    missing = F.col("reason").isin(*MISSING_REASONS)
    totals = by.agg(F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(~missing, F.col("n"))), F.lit(0)).alias("i"))
    rows = F.array(F.struct(F.lit("__missing").alias("name"), F.col("m").alias("n")), F.struct(F.lit("__invalid").alias("name"), F.col("i").alias("n")))
    return by.select(F.col("reason").alias("name"), "n").unionByName(totals.select(F.explode(rows).alias("x")).select("x.*"))


def precondition_issues(spark, dataset: str, root: str, directories: list[str] | None, wanted: tuple[str, ...]) -> DataFrame:
    """Issues for a missing root or missing category directories; directories is None where the root is missing."""
    rows = [("missing_root", root, "{}")] if directories is None else [("missing_category_dir", f"{root.rstrip('/')}/{c}", json.dumps({"category": c})) for c in wanted if c not in directories]
    return spark.createDataFrame([(dataset, "scan", *r) for r in rows], "dataset string, split string, reason string, expected_path string, metadata_json string")
