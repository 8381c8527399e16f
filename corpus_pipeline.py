"""The corpus pipeline: five stages, each reading the documents that the one before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes every stage as Parquet into the shared
folder and reads it again. All but the last return the columns of documents, further ones too, whatever their names and types.

Defined results: an empty table stays empty through all stages; texts that are null, blank or without a letter are rejected
by the first; repeated rows are one group of copies, of which one row stays; a null doc_id takes part like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language, lines, mixing, packing
from tessera.llm.common import shipped, small, stored, table, work_folder

#: Predictions below this score are rejected, as `und` is, whose score is 0.
MIN_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go; the others carry the predicted one."""
    shipped(spark)
    model = language.fit(docs)
    named = docs.withColumn("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    p = language.identify(named.select("doc_id", F.col("doc_id.text").alias("text")), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    columns = [F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"doc_id.`{c}`") for c in docs.columns]
    return p.select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; a document that loses all its lines with words goes with them."""
    total, removed = (f"{name}{'_' * max(map(len, docs.columns))}" for name in ("total", "removed"))  # longer than any column's name
    d = lines.dedup_lines(docs, total, removed)
    empty = (F.col(removed) > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    d = d.filter(~empty)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies exactly one row stays: that of the smallest doc_id (null comes last), then of the smallest
    hash of id and text; of rows that are equal in both, that of the smallest JSON. Texts without words stay."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("doc_id", "text").alias("hash"))
    keyed = docs.select(row.alias("row"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    groups = jaccard.near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text")).filter("n_shingles > 0")
    groups = groups.groupBy(F.col("doc_id").alias("of"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first")).count()
    groups = small(stored(groups.filter("count > 1 OR NOT first").select("of", "first"), work_folder(spark), "groups"), 64)
    alone = keyed.join(groups, F.col("row") == F.col("of"), "left_anti").select("whole.*")
    again = keyed.join(groups.filter("first"), F.col("row") == F.col("of"), "left_semi")
    # Maps have no order, the rows' JSON has; equal JSON is that of equal rows.
    return alone.unionByName(again.groupBy("row").agg(F.min_by("whole", F.to_json("whole")).alias("whole")).select("whole.*"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them, the last one in part."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, as a row for each piece in them."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_sources", mixed_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
