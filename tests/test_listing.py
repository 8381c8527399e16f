import os

from pyspark.sql import functions as F

from tessera.sources import listing, store


def put(path, size=3):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"x" * size)


def test_a_deep_single_branch_is_spread_over_tasks(spark, tmp_path):
    root = str(tmp_path / "deep")
    for i in range(6):
        for j in range(12):
            put(f"{root}/{'only/' * 4}b{i}/c{j}/f{j}.mp4")
    x = listing.files(spark, root)
    assert x.count() == 72 and x.agg(F.count_distinct("path")).first()[0] == 72
    last = os.path.dirname(x.inputFiles()[0].removeprefix("file://"))
    parts = [n for n in os.listdir(last) if n.endswith(".parquet")]
    assert "/6" in last or len(parts) >= 1
    tasks = {}
    for f in x.inputFiles():
        level = f.split("/")[-2]
        tasks[level] = tasks.get(level, 0) + (spark.read.parquet(f).count() > 0)
    assert tasks["6"] > 4  # 72 directories of the last level, below one directory of the first


def test_odd_names_and_missing_roots(spark, tmp_path):
    root = str(tmp_path / "a b")
    for name, size in (("x y%20+é.MP4", 4), (".hidden.mp4", 0), ("_s.wav", 1), ("__MACOSX/._q.mp4", 1), ("n.ZIP", 2)):
        put(f"{root}/{name}", size)
    os.makedirs(f"{root}/empty")
    os.symlink(f"{root}/gone", f"{root}/lost.mp4")
    got = {r["name"]: r for r in listing.files(spark, root).collect()}
    assert set(got) == {"x y%20+é.MP4", ".hidden.mp4", "_s.wav", "._q.mp4", "n.ZIP", "lost.mp4"}
    assert got["x y%20+é.MP4"]["length"] == 4 and got[".hidden.mp4"]["length"] == 0 and got["lost.mp4"]["error"] == "FileNotFoundError" and got["lost.mp4"]["length"] is None
    assert got["._q.mp4"]["parent"] == f"{root}/__MACOSX" and got["n.ZIP"]["path"] == f"{root}/n.ZIP"
    assert [r["name"] for r in listing.videos(spark, f"file://{root}").collect()] == [".hidden.mp4", "lost.mp4", "x y%20+é.MP4"]
    assert [r["name"] for r in listing.audios(spark, root).collect()] == ["_s.wav"] and [r["name"] for r in listing.archives(spark, root).collect()] == ["n.ZIP"]
    assert listing.count_videos(spark, root).first()["n"] == 4 and listing.files(spark, f"{root}/none").count() == 0


def test_staged_tables_read_their_source_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def slow(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    df = spark.range(100).mapInPandas(slow, "id long")
    checks = store.Checks().forbid("odd above 90", (F.col("id") > 90) & (F.col("id") % 2 == 1), F.col("id")).forbid("negative", F.col("id") < 0, F.col("id"))
    table, seen = store.staged(df, {"n": F.count("*"), **checks.measures()})
    assert table.count() == 100 and table.agg(F.sum("id")).first()[0] == 4950 and seen["n"] == 100 and reads.value == 100
    try:
        checks.verify(seen)
        raise AssertionError
    except ValueError as e:
        assert str(e) == "odd above 90: 5 rows, such as '91'"
    store.Checks().verify({})
