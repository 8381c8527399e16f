import glob
import os

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import catalogue, common, jaccard, lines, mixing

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    shown = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert shown(df.select(*columns).collect()) == shown(duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall())


def written_plans(monkeypatch) -> list[str]:
    """Grows by the plan of every table that an operator stores on its way."""
    plans = []

    def stored(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.stored(df, *args, **kwargs)

    for module in (lines, mixing, jaccard):
        if hasattr(module, "stored"):
            monkeypatch.setattr(module, "stored", stored)
    return plans


def test_native_plans_have_no_python(spark, monkeypatch):
    if os.path.isdir(DATA):
        for name in ("op2_mix_sources", "op4_line_dedup", "op6_chat_format", "op8_quality_rules"):
            plans = written_plans(monkeypatch)
            plans.append(catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString())
            for plan in plans:
                assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan, name
            assert len(plans) > 4 or name != "op4_line_dedup"


def test_stages_on_a_small_corpus(spark):
    prose = "\n".join(f"the line number {i} of this text says that some words stand here as usual" + f" with mark{i}" for i in range(6))
    rows = [(1, prose, "en", "a", 9), (2, prose + " now", "en", "b", 9), (3, "123 456", "en", "a", 7), (4, "le des etre ou avec que les une dans pour sur", "fr", "a", 9), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) >= {1, 4} and not {3, 5} & set(left) and left[1] == prose and 2 not in left
    packed = corpus_pipeline.best_fit_packing(spark, corpus_pipeline.mixed_sources(spark, docs, ""), "")
    assert {r["doc_id"] for r in packed.collect()} <= set(left)


def test_one_row_of_each_group_of_copies_stays(spark):
    text = lambda name, end="": " ".join(f"{name}{i}" for i in range(40)) + end
    rows = [(1, text("a"), "x"), (1, text("a"), "x"), (1, text("a"), "w"), (2, text("a", " more"), "x"), (None, text("a"), "x")]  # rows that are repeated; a near copy; a copy without an id
    rows += [(3, text("b"), "x"), (4, text("b"), "x"), (4, text("c"), "x")]  # two texts of one id, one of them a copy
    rows += [(None, text("d"), "x"), (None, text("d"), "x"), (None, text("e"), "x"), (5, " ", "x"), (5, " ", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, text("a"), "w"), (3, text("b"), "x"), (4, text("c"), "x"), (None, text("d"), "x"), (None, text("e"), "x"), (5, " ", "x"), (5, " ", "x"), (None, None, "x")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
