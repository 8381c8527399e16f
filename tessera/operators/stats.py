"""Counts over corpora: extensions, values, outputs and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import UNKNOWN
from tessera.functions.scalars import clean_text, is_video, suffix_or_none


def extension_counts(listing: DataFrame) -> DataFrame:
    """ext, n, video_bytes."""
    size = F.when(is_video("name"), F.col("length")).otherwise(F.lit(0))
    return listing.groupBy(suffix_or_none("name").alias("ext")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("video_bytes"))


def scan_summary(listing: DataFrame, root: str) -> DataFrame:
    """One row: root, exists, first_level_dirs, extension_counts, total_video_files, total_size_bytes."""
    by = extension_counts(listing)
    dirs = F.array_sort(F.collect_set(F.when(F.instr(F.expr(f"substr(path, {len(root.rstrip('/')) + 2})"), "/") > 0, F.substring_index(F.expr(f"substr(path, {len(root.rstrip('/')) + 2})"), "/", 1))))
    top = listing.agg(dirs.alias("first_level_dirs"), F.count(F.when(is_video("name"), 1)).alias("total_video_files"))
    sums = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("extension_counts"), F.coalesce(F.sum("video_bytes"), F.lit(0)).alias("total_size_bytes"))
    return top.crossJoin(F.broadcast(sums)).select(F.lit(root).alias("root"), F.lit(True).alias("exists"), "first_level_dirs", "extension_counts", "total_video_files", "total_size_bytes")  # one row each


def value_counts(df: DataFrame, column) -> DataFrame:
    """value, n; blank values are Unknown."""
    v = clean_text(column)
    return df.groupBy(F.when(v == "", F.lit(UNKNOWN)).otherwise(v).alias("value")).agg(F.count("*").alias("n"))


def output_stats(df: DataFrame, output: str, dims: list[str]) -> DataFrame:
    """output, dim, value, n: the distribution of each dimension in each output, and their rows as dim `count`; blank values are Unknown."""
    x = df.select(F.col(output).alias("output"), *[F.nullif(clean_text(d), F.lit("")).alias(d) for d in dims])
    x = distributions(x, ["output"], dims)
    return x.withColumn("dim", F.when(F.col("dim") == "", F.lit("count")).otherwise(F.col("dim")))


def split_counts(df: DataFrame, group: str) -> DataFrame:
    """split, rows, groups."""
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"))


def distributions(df: DataFrame, by: list[str], dims: list[str], unknown: str = UNKNOWN) -> DataFrame:
    """by.., dim, value, n: how often each value of each of dims occurs for every by; dim is '' for the number of rows.

    All are grouping sets of one aggregation, so rows are counted where they are and shuffled once, as counts. Null
    values are `unknown`."""
    named = [f"_d{i}" for i in range(len(dims))]
    x = df.select(*by, *[F.coalesce(F.col(d).cast("string"), F.lit(unknown)).alias(k) for d, k in zip(dims, named, strict=True)])
    x = x.groupingSets([by, *[[*by, k] for k in named]], *by, *named).agg(F.count("*").alias("n"), F.grouping_id().alias("_set"))
    dim, value = F.lit(""), F.lit("")
    for i, d in enumerate(dims):  # grouping_id has a bit for each column that a set leaves out, the last one lowest
        mine = F.col("_set") == (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i))
        dim, value = F.when(mine, F.lit(d)).otherwise(dim), F.when(mine, F.col(f"_d{i}")).otherwise(value)
    return x.select(*by, dim.alias("dim"), value.alias("value"), "n")


def split_summary(df: DataFrame, group: str, dims: dict[str, str], unknown: str = "unknown") -> DataFrame:
    """split, count, group_count, and for each of dims (column -> name) a map of its values' counts; null values are `unknown`.

    Rows are shuffled once, as counts by grouping sets; a second aggregation over these makes a row for each split."""
    x = distributions(df.withColumn("_group", F.concat(F.lit("="), F.col(group).cast("string"))), ["split"], ["_group", *dims], unknown)
    groups = F.count(F.when((F.col("dim") == "_group") & (F.col("value") != unknown), 1))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dim") == c, F.struct("value", F.col("n").alias("count")))))).alias(name) for c, name in dims.items()]
    return x.groupBy("split").agg(F.sum(F.when(F.col("dim") == "", F.col("n"))).alias("count"), groups.alias("group_count"), *maps)


def group_manifest(df: DataFrame, group: str, order: str, labels: list[str], examples: int = 5) -> DataFrame:
    """group, count, the labels of its first row, the first examples joined by commas. Each group keeps only `examples` values."""
    first = [F.min_by(c, order).alias(c) for c in labels]
    w = df.groupBy(group).agg(F.count("*").alias("count"), *first)
    from pyspark.sql import Window as W

    top = df.select(group, order).withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("r") <= examples)
    top = top.groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("x"))
    return w.join(top.select(group, F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("examples")), group)


def audio_handling_counts(df: DataFrame, handling: str = "handling", default: str = "extract_from_video") -> DataFrame:
    """audio_handling (paired_file, extract_from_video or unknown for any other), n; a missing one counts as the default."""
    h = F.coalesce(handling, F.lit(default))
    named = F.when(h.isin("paired_file", "extract_from_video"), h).otherwise(F.lit("unknown"))
    return df.groupBy(named.alias("audio_handling")).agg(F.count("*").alias("n"))
