"""Splits: stratified, by groups, by folds of subjects, and memberships in named outputs."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.constants import OUTPUTS
from tessera.operators.ranges import numbered
from tessera.operators.ranking import seeded
from tessera.sources.store import Checks


def stratified_split(df: DataFrame, strata: list[str], key: str, ratio: float, seed: int) -> DataFrame:
    """With split: train for max(1, min(n - 1, int(n * ratio))) rows of each stratum, eval for others; a single row is train.

    The seeded digest is uniform, so rows far from the cut needn't be sorted: strata are ranked by digest prefix cells,
    and rows only within their cell."""
    x = df.withColumn("_h", seeded(key, seed)[0])
    cell = F.substring("_h", 1, 3)
    sizes = x.groupBy(*strata, cell.alias("_cell")).agg(F.count("*").alias("_in_cell"))
    w = W.partitionBy(*strata)
    before = F.coalesce(F.sum("_in_cell").over(w.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in strata], "_cell", before.alias("_before"), F.sum("_in_cell").over(w).alias("_n"))
    x = x.withColumn("_own", cell)
    on = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in strata] + [F.col("_own") == F.col("_cell")]
    rank = F.row_number().over(W.partitionBy(*strata, "_own").orderBy("_h", key))
    x = x.withColumn("_rank", rank).join(sizes, on).withColumn("_rank", F.col("_rank") + F.col("_before"))
    cut = F.when(F.col("_n") == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(float(ratio))))))
    out = x.withColumn("split", F.when(F.col("_rank") <= cut, F.lit("train")).otherwise(F.lit("eval")))
    return out.select(*df.columns, "split")


def validation_groups(df: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """The distinct groups that go to validation: max(1, round(G * ratio)), at most G - 1; none of a single group."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio is between 0 and 1")
    g = numbered(df.select(group).distinct(), *seeded(group, seed), name="_at")
    size = df.select(F.count_distinct(group).alias("_g"))
    cut = F.least(F.greatest(F.lit(1), F.bround(F.col("_g") * F.lit(float(ratio)), 0)), F.col("_g") - 1)
    return g.crossJoin(F.broadcast(size)).filter(F.col("_at") < cut).select(group)  # size: one row


def group_split(df: DataFrame, group: str, ratio: float, seed: int, exact_shuffle: bool = False) -> DataFrame:
    """With split: whole groups go to val or train. exact_shuffle draws as Python's shuffle does, on the driver, for short lists."""
    if exact_shuffle:
        ids = sorted(r[0] for r in df.select(group).distinct().collect())
        random.Random(seed).shuffle(ids)
        n = min(max(1, round(len(ids) * ratio)), len(ids) - 1)
        val = df.sparkSession.createDataFrame([(i,) for i in ids[:n]], df.select(group).schema)
    else:
        val = validation_groups(df, group, ratio, seed)
    val = val.select(F.col(group).alias("_val"))
    return df.join(val, F.col(group) == F.col("_val"), "left").withColumn("split", F.when(F.col("_val").isNull(), F.lit("train")).otherwise(F.lit("val"))).drop("_val")


def leaking_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups on both sides of a split; there should be none."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("sides")).filter("sides > 1").select(group)


def with_folds(df: DataFrame, folds: DataFrame, subject: str) -> DataFrame:
    """A row for each fold that knows the subject, with fold and split; both null for a subject that no fold knows."""
    f = folds.groupBy("fold", F.col("subject_id").alias("_subject")).agg(F.max("split").alias("split"))  # train > test
    return df.join(f, F.col(subject) == F.col("_subject"), "left").drop("_subject")


def fold_membership(df: DataFrame, folds: DataFrame, subject: str) -> DataFrame:
    """A row for each fold that knows the subject, with fold and split; train before test where a subject is in both."""
    return with_folds(df, folds, subject).filter("fold IS NOT NULL")


def fold_checks(subject: str) -> Checks:
    """What must not be in a result of `with_folds`, measured while it is written."""
    blank = F.coalesce(F.col(subject), F.lit("")) == ""
    return Checks().forbid("samples without a subject", blank, F.lit("")).forbid("subjects in no fold", ~blank & F.col("fold").isNull(), F.col(subject))


def uncovered(df: DataFrame, folds: DataFrame, subject: str) -> DataFrame:
    """Subjects that no fold knows."""
    return df.select(subject).distinct().join(folds.select(F.col("subject_id").alias(subject)).distinct(), subject, "left_anti")


def assert_covered(df: DataFrame, folds: DataFrame, subject: str) -> None:
    if df.filter(F.coalesce(F.col(subject), F.lit("")) == "").limit(1).count():
        raise ValueError("samples without a subject")
    rest = [r[0] for r in uncovered(df, folds, subject).orderBy(subject).limit(20).collect()]
    if rest:
        raise ValueError(f"subjects in no fold: {rest}")


def assert_no_leak(df: DataFrame, group: str) -> None:
    rest = [r[0] for r in leaking_groups(df, group).orderBy(group).limit(20).collect()]
    if rest:
        raise ValueError(f"groups on both sides: {rest}")


def memberships(split: Column, open_model: Column, open_language: Column) -> Column:
    """The outputs that a row belongs to: train, validation, or test_all and exactly one part of the test split."""
    s = F.lower(split)
    part = F.when(~open_model & ~open_language, "test_indomain").when(open_model & ~open_language, "test_open_model").when(~open_model & open_language, "test_open_language").otherwise("test_open_full")
    none = F.array().cast("array<string>")
    return F.when(s.isin("train", "training"), F.array(F.lit("train"))).when(s.isin("validation", "val", "dev"), F.array(F.lit("validation"))).when(s == "test", F.array(F.lit("test_all"), part)).otherwise(none)


def exploded_memberships(df: DataFrame, split: Column, open_model: Column, open_language: Column) -> DataFrame:
    return df.withColumn("output", F.explode(memberships(split, open_model, open_language)))


def all_outputs(counts: DataFrame, n: str = "n") -> DataFrame:
    """counts(output, n) with a row for each of the seven outputs, empty ones too."""
    grid = counts.sparkSession.createDataFrame([(o,) for o in OUTPUTS], "output string")
    return grid.join(counts, "output", "left").select("output", F.coalesce(n, F.lit(0)).alias(n))


def named_outputs(df: DataFrame, modes: tuple[str, ...] = ("binary",)) -> DataFrame:
    """A row for each mode, output = mode_split or mode_foldN_split: ready for a sink that is partitioned by output."""
    parts = [F.lit("_")] + ([F.concat(F.lit("fold"), F.col("fold").cast("string"), F.lit("_"))] if "fold" in df.columns else [])
    return df.withColumn("_mode", F.explode(F.array(*[F.lit(m) for m in modes]))).withColumn("output", F.concat("_mode", *parts, "split")).drop("_mode")
