"""Operator 2: mixing sources to target weights, with DataFrame functions only.

Every document has a hash-random key. Within a source, documents are taken in the order of that key until the
source's budget is spent; a budget above the source's size takes whole epochs first. The order is never sorted as a
whole: token counts are summed over 4096 ranges of the key, prefix sums of those ranges find the range in which the
budget ends, the same is done once more inside that range, and only the documents of that one cell (a 16-millionth of
the source) are put in order. So a source with a third of all rows costs no more than its share of a partial
aggregation.

Defined results: a null text has size 0; a null source is a source of its own and comes last; documents with equal
keys (repeated ids) are ordered by size; a null id's key comes from its text; an empty table gives an empty result; only the needed columns of the input
are read, so further columns never clash. Reruns agree, as keys depend on the ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, WORD, small, stored, word_count, work_folder

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
_DIGITS = 3  # hexadecimal digits of the key for each level of ranges


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size) -> with target: shares of the total by weight, none above max_epochs x its source.

    With caps c and weights w the target is min(c, w * level); the level is found in one pass over the sources in
    the order of c / w, as the excess of every capped source is shared by weight among the rest."""
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    s = s.withColumn("level", (total - before) / after).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    s = s.withColumn("level", F.min(fits).over(everything)["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def _cell(level: int):
    return F.substring("key", 1 + level * _DIGITS, _DIGITS)


def _ending(ranges: DataFrame, name: str) -> DataFrame:
    """ranges(source, budget, cell, words) -> for each source the cell in which the budget ends, and the budget left there."""
    w = W.partitionBy("source").orderBy("cell")
    upto = ranges.withColumn("upto", F.sum("words").over(w))
    ends = upto.filter(F.col("upto") > F.col("budget"))
    first = F.min(F.struct("cell", (F.col("budget") - F.col("upto") + F.col("words")).alias("left")))
    return ends.groupBy("source").agg(first.alias("f")).select("source", F.col("f.cell").alias(name), F.col("f.left").alias(f"{name}_left"))


def _same_source(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    b = b.withColumnRenamed("source", "_source")
    return a.join(b, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, size, source_size, target, taken.

    taken = epochs * size, plus the words that the last, partial epoch takes from the start of the text."""
    folder = work_folder(docs.sparkSession)
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))).alias("key"))
    d = stored(d, folder, "sizes")
    cells = stored(d.groupBy("source", _cell(0).alias("cell")).agg(F.sum("size").alias("words")), folder, "cells")
    plan = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", (whole - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = _same_source(plan, _ending(_same_source(cells, plan.select("source", "budget"), "inner"), "c1"))
    plan = stored(plan, folder, "plan")
    hint = small(plan, 200)
    inner = _same_source(d.select("source", "size", "key"), hint.select("source", "c1", F.col("c1_left").alias("budget")), "inner")
    inner = inner.filter(_cell(0) == F.col("c1")).groupBy("source", "budget", _cell(1).alias("cell")).agg(F.sum("size").alias("words"))
    ends = small(stored(_same_source(plan, _ending(inner, "c2")), folder, "ends"), 200)
    x = _same_source(d, ends, "inner")
    in_cell = F.coalesce((_cell(0) == F.col("c1")) & (_cell(1) == F.col("c2")), F.lit(False))
    # Where no c1 exists the budget is not exceeded by the whole source, which happens only for sources without words.
    below = F.coalesce((_cell(0) < F.col("c1")) | ((_cell(0) == F.col("c1")) & (_cell(1) < F.col("c2"))), F.lit(False))
    rest = x.filter(~in_cell).withColumn("part", F.when(below, F.col("size")).otherwise(F.lit(0)).cast("long"))
    order = W.partitionBy("source").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    room = F.col("c2_left") - F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = x.filter(in_cell).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long"))
    out = rest.unionByName(cut)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix as documents: a row for every epoch of a document, and its start where an epoch ends inside it, up to the last word taken.

    Rows with no words are kept once, as they cost no budget. The input's columns are returned."""
    folder = work_folder(docs.sparkSession)
    rid = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    m = mix_sources(docs.select(F.struct("doc_id", rid.alias("rid")).alias("doc_id"), "source", "text"), weights, max_epochs)
    m = m.groupBy(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.rid").alias("_rid")).agg(F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.count("*").alias("_rows"))
    m = stored(m, folder, "mix")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), rid.alias("key"), "doc_id", "text")
    d = d.join(m, (F.col("key") == F.col("_rid")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    share = F.floor(F.col("_taken") / F.col("_rows"))
    epochs = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.floor(share / F.greatest(F.col("_size"), F.lit(1)))).cast("int")
    left = F.when(F.col("_size") == 0, F.lit(0)).otherwise(share - epochs * F.col("_size")).cast("int")
    spaced = F.regexp_extract_all("text", F.lit(f"(?:{SPACE})?{WORD}"), F.lit(0))  # each word with the white space before it
    head = F.array_join(F.slice(spaced, 1, F.greatest(F.col("part"), F.lit(1))), "")
    d = d.withColumn("epochs", epochs).withColumn("part", left)
    whole = d.filter("epochs > 0").select("whole", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("whole.*")
    changed = {"text": head}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(head).cast(docs.schema["n_chars"].dataType)
    part = d.filter("part > 0").select(*[changed[c].alias(c) if c in changed else F.col(f"whole.`{c}`") for c in docs.columns])
    return whole.unionByName(part)


def op2(spark, sf_dir):
    from tessera.llm.common import table

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
             source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS place,
             (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, place) FROM l WHERE level * weight <= cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
x AS (SELECT d.*, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM x
"""
