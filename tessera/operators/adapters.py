"""Outside programs and models behind mapInPandas: probing, extraction, unpacking and scoring, with the function as a parameter; back ends as columns."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import TOKEN_IDS
from tessera.functions.scalars import logprob_map, pair_softmax
from tessera.operators.archives import MANIFEST
from tessera.sources.store import staged

SCORED = "index bigint, p_real double, p_fake double, real_logit double, fake_logit double, error string, traceback string"


def scored(samples: DataFrame, load: Callable[[], Callable[[list[dict]], list[dict]]], columns: list[str], batch: int = 8) -> DataFrame:
    """samples(index, columns..) -> a row for each sample with its scores, or its error.

    load() runs once for each Python worker and returns the scorer of a list of rows. A batch that fails is tried again
    row by row, so that one bad row costs no other."""

    def run(frames: Iterator[pd.DataFrame]):
        score = load()
        for frame in frames:
            rows, out = frame.to_dict("records"), []
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                try:
                    got = score(part)
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} results for {len(part)} rows")
                    out += [{"index": r["index"], **g} for r, g in zip(part, got, strict=True)]
                except Exception:
                    for r in part:
                        try:
                            out.append({"index": r["index"], **score([r])[0]})
                        except Exception as e:
                            out.append({"index": r["index"], "error": f"{type(e).__name__}: {e}", "traceback": traceback.format_exc()})
            names = [x.split(" ")[0] for x in SCORED.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"error": object, "traceback": object}).where(lambda d: d.notna(), None) if out else pd.DataFrame(columns=names)

    return samples.select("index", *columns).mapInPandas(run, SCORED)


def predictions(samples: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The predictions (a tie is Fake), and the bad samples with their errors."""
    x = samples.join(results, "index")
    pred = F.when(F.col("p_fake") >= F.col("p_real"), F.lit("Fake")).otherwise(F.lit("Real"))
    good = x.filter("error IS NULL").withColumn("pred", pred).drop("error", "traceback")
    bad = x.filter("error IS NOT NULL").withColumn("reason", F.lit("inference_error")).drop("p_real", "p_fake", "real_logit", "fake_logit")
    return good, bad


def each_path(paths: DataFrame, work: Callable[[str], str], name: str = "result", path: str = "path") -> DataFrame:
    """paths(path) -> path, name, error: a side effect or probe for each path; parallel by partitions, errors stay in their row."""

    def run(frames):
        for f in frames:
            out = []
            for p in f[path]:
                try:
                    out.append((p, str(work(p)), None))
                except Exception as e:
                    out.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[path, name, "error"])

    return paths.select(path).mapInPandas(run, f"{path} string, {name} string, error string")


def unpacked(archives: DataFrame, extract: Callable[[str, str], int], extractor: str = "program") -> DataFrame:
    """archives(archive_path, output_dir) -> the manifest: status extracted or failed. For zip archives see `archives.unzipped`.

    extract(archive, folder) gives the number of videos; an archive without one is a failure."""

    def run(frames):
        for f in frames:
            rows = []
            for a, o in zip(f["archive_path"], f["output_dir"], strict=True):
                try:
                    n = extract(a, o)
                    if not n:
                        raise ValueError("no video in the archive")
                    rows.append((a, o, "extracted", n, extractor, None, None))
                except Exception as e:
                    rows.append((a, o, "failed", 0, extractor, type(e).__name__, str(e)))
            yield pd.DataFrame(rows, columns=["archive_path", "output_dir", "status", "video_count", "extractor", "error_type", "error"]).astype({"video_count": "Int64"})

    return archives.select("archive_path", "output_dir").mapInPandas(run, MANIFEST)


def assert_unpacked(manifest: DataFrame) -> None:
    """Fails if an archive failed; call it after the manifest was written."""
    bad = [r[0] for r in manifest.filter("status = 'failed'").select("archive_path").orderBy("archive_path").limit(10).collect()]
    if bad:
        raise RuntimeError(f"archives that failed: {bad}")


def resumed(archives: DataFrame, manifest: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """archives(archive_path, output_dir) -> the manifest of all, after `work` (such as `archives.unzipped`) was done for what isn't done yet.

    The manifest is a table in shared storage, to which each run adds its rows; an anti join with the rows that were extracted
    leaves the archives that a run starts work for. So a restart knows what was done on whichever executor; nothing is looked
    up on local disks. What an earlier run extracted is `skipped` in the result; what failed is tried again."""
    spark = archives.sparkSession
    key = ["archive_path", "output_dir"]
    p = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    known = spark.read.parquet(manifest).filter("status = 'extracted'").dropDuplicates(key) if there else None
    rest = archives.join(known, key, "left_anti") if known is not None else archives
    now, _ = staged(work(rest))
    now.write.mode("append").parquet(manifest)
    if known is None:
        return now
    before = archives.select(*key).join(known, key).withColumn("status", F.lit("skipped"))
    return now.unionByName(before)


def scored_columns(samples: DataFrame, real, fake, missing=None) -> DataFrame:
    """samples(index, ..) -> the columns of SCORED from a pair of logits or log probabilities that rows hold already.

    missing: a text where a row can't be scored, else null; a row without one of the pair can't be, either."""
    x = samples.select("index", real.cast("double").alias("real_logit"), fake.cast("double").alias("fake_logit"), (missing if missing is not None else F.lit(None).cast("string")).alias("error"))
    x = x.withColumn("error", F.coalesce("error", F.when(F.col("real_logit").isNull() | F.col("fake_logit").isNull(), F.lit("ValueError: a row without a pair of logits"))))
    p = pair_softmax("real_logit", "fake_logit")
    ok = lambda c: F.when(F.col("error").isNull(), c)
    return x.select("index", ok(p["p_real"]).alias("p_real"), ok(p["p_fake"]).alias("p_fake"), ok(F.col("real_logit")).alias("real_logit"), ok(F.col("fake_logit")).alias("fake_logit"), "error", F.lit(None).cast("string").alias("traceback"))


def from_logits(samples: DataFrame, config: dict) -> DataFrame:
    """The back end for rows that hold the logits of an earlier run, in the columns that the configuration names."""
    return scored_columns(samples, F.col(config.get("real_logit", "real_logit")), F.col(config.get("fake_logit", "fake_logit")))


def from_logprobs(samples: DataFrame, config: dict) -> DataFrame:
    """The back end for rows that hold log probabilities by token id, in a map or in the answer of a text-generation server (`logprob_map`)."""
    column, ids = config.get("logprobs_column", "logprobs"), {k: str(config.get(k, v)) for k, v in TOKEN_IDS.items()}
    kind = samples.schema[column].dataType
    m = logprob_map(samples, column) if kind.typeName() == "struct" else F.transform_keys(column, lambda k, v: k.cast("string"))
    x = samples.withColumn("_map", m)
    at = {k: F.try_element_at("_map", F.lit(i)) for k, i in ids.items()}
    told = [F.when(c.isNull(), F.lit(f"ValueError: no log probability for token {ids[k]}")) for k, c in at.items()]
    missing = F.coalesce(F.when(F.col("_map").isNull(), F.lit("ValueError: no log probabilities")), *told)
    return scored_columns(x, at["real_token_id"], at["fake_token_id"], missing)


#: Back ends by name: samples and a configuration to the columns of SCORED. Programs that run a model register theirs here, by `scored`.
BACKENDS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {"logits": from_logits, "logprobs": from_logprobs}


def backend(name: str) -> Callable[[DataFrame, dict], DataFrame]:
    if name not in BACKENDS:
        raise ValueError(f"unknown back end {name}; there are {sorted(BACKENDS)}")
    return BACKENDS[name]
