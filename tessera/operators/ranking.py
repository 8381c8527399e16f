"""Reproducible orders and what is ranked by them: shards, batches, prefixes, caps and samples.

A seeded order is that of md5(seed|key), then key: it depends neither on partitions nor on the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranges import cumulative, numbered


def seeded(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]


def average_rank(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """by.., value, n, avg_rank: the mean rank of each distinct value. Values are counted first; no task holds all of a group."""
    from tessera.operators.metrics import joined_by

    x = cumulative(df.groupBy(*by, value).agg(F.count("*").alias("n")), [*by, value], ("n",))
    first = x.groupBy(*by).agg(F.min("n_0").alias("_first"))  # groups follow each other in the order
    return joined_by(x, first, by).select(*by, value, "n", (F.col("n_0") - F.col("_first") + (F.col("n") + 1) / 2).alias("avg_rank"))


def round_robin(df: DataFrame, order: str, shards: int, limit: int | None = None) -> DataFrame:
    """With idx and shard = idx % shards; only the first `limit` rows if it is given."""
    x = numbered(df, order)
    if limit is not None:
        x = x.filter(F.col("idx") < limit)
    return x.withColumn("shard", F.col("idx") % shards)


def first_rows(df: DataFrame, order: str, n: int, batch: int) -> DataFrame:
    """The first n rows in the order, with idx and batch_id; the last batch may be short."""
    return numbered(df.orderBy(order).limit(n), order, at_most=n).withColumn("batch_id", F.floor(F.col("idx") / batch).cast("long"))


def per_group(df: DataFrame, by: list[str], k: int | None, key: str, seed: int) -> DataFrame:
    """At most k rows of each group, by the seeded order; all rows if k is None, none if it is below 1."""
    if k is None:
        return df
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*seeded(key, seed)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def zipped(a: DataFrame, a_order, b: DataFrame, b_order, strict: bool = True, name: str = "place") -> DataFrame:
    """The rows of a and b at the same place of their orders, side by side, with the place, from 0. Columns of b that a has too get `_b`.

    Both sides are numbered by ranges and joined by the number. If one side has more rows, the strict form fails the query at
    the first place that only one has (checked in the join itself, with no pass before); the other stops there."""
    left = numbered(a, *a_order, name=name)
    right = numbered(b, *b_order, name=f"{name}_b").select(F.col(f"{name}_b"), *[F.col(f"`{c}`").alias(f"{c}_b" if c in a.columns else c) for c in b.columns])
    x = left.join(right, F.col(name) == F.col(f"{name}_b"), "full_outer" if strict else "inner")
    if strict:
        lone = F.concat(F.lit("sides of different lengths: only one has a row at place "), F.coalesce(name, f"{name}_b").cast("string"))
        x = x.filter(F.when(F.col(name).isNull() | F.col(f"{name}_b").isNull(), F.raise_error(lone).cast("boolean")).otherwise(F.lit(True)))
    return x.drop(f"{name}_b")
