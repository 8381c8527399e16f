import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.functions import scalars as S
from tessera.operators import adapters, archives, joins, metrics, records, validate
from tessera.plans import config, pipelines
from tessera.sources import listing, readers, sinks


def put(root, name, size=5):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"x" * size)
    return path


@pytest.fixture
def corpus(tmp_path):
    root = str(tmp_path / "a")
    put(root, "RealVideo-RealAudio/African/men/id1/real.mp4")
    put(root, "FakeVideo-FakeAudio/fake.webm")
    put(root, "FakeVideo-RealAudio/empty.mp4", 0)
    put(root, "RealVideo-FakeAudio/note.txt")
    put(root, "RealVideo-FakeAudio/.hidden.mp4")
    return root


def test_listing_and_cascade(spark, corpus):
    files = listing.files(spark, corpus)
    assert files.count() == 5 and listing.files(spark, corpus + "/none").count() == 0
    good, bad = validate.routed(files, validate.listed_reason())
    assert {r["name"] for r in good.collect()} == {"real.mp4", "fake.webm", ".hidden.mp4"}
    assert {r["name"]: r["reason"] for r in bad.collect()} == {"empty.mp4": "zero_size_file", "note.txt": "invalid_extension"}


def test_corpus_a_with_metadata(spark, corpus, tmp_path):
    csv = tmp_path / "meta.csv"
    csv.write_text("﻿source,type,race,gender,path,method,split\nid1,RealVideo-RealAudio,African,men,real.mp4,real,train\nid2,RealVideo-RealAudio,African,men,gone.mp4,real,\n", encoding="utf-8")
    m = readers.metadata_csv(spark, str(csv))
    samples, issues = pipelines.corpus_a(listing.files(spark, corpus), corpus, m)
    s = {os.path.basename(r["video_path"]): r for r in samples.collect()}
    assert s["real.mp4"]["subject_id"] == "id1" and s["real.mp4"]["meta"]["generative_method"] == "real" and s["fake.webm"]["overall_label"] == "Fake"
    assert sorted(r["reason"] for r in issues.collect()) == ["invalid_extension", "missing_file", "zero_size_file"]
    assert readers.metadata_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_preparation_bundle(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    p = config.resolve({"kind": "a", "mode": "both"}, {"root": corpus}, {"output_dir": out, "train_ratio": None})
    records_ = pipelines.prepare(spark, p)
    assert {r["output"] for r in records_.select("output").distinct().collect()} <= {"binary_train", "structured_train", "binary_eval", "structured_eval"}
    assert json.load(open(f"{out}/scan_summary.json"))["total_video_files"] == 4
    back = spark.read.json(f"{out}/outputs")
    assert back.count() == records_.count() and "audios" not in back.columns


def test_corpus_b(spark, tmp_path):
    root = str(tmp_path / "b")
    for n in "xyz":
        put(root, f"{n}.mp4")
    rows = [("x.mp4", "real", "train", "en", "true", "sd", "false", "false"), ("y.mp4", None, "test", "de", "m", None, "1", "no"), ("gone.mp4", "fake", "test", "", "", "", "0", "0"), (None, "fake", "dev", "", "", "", "0", "0")]
    df = spark.createDataFrame(rows, "video_path string, label string, split string, language string, generative_method string, model string, open_set_model string, open_set_language string")
    samples, issues = pipelines.corpus_b(df, listing.files(spark, root), root)
    got = {(r["output"], os.path.basename(r["video_path"])): r["meta"] for r in samples.collect()}
    assert set(got) == {("train", "x.mp4"), ("test_all", "y.mp4"), ("test_open_model", "y.mp4")}
    assert got[("train", "x.mp4")]["generative_method"] == "sd" and got[("test_all", "y.mp4")]["overall_label"] == "Fake"
    assert sorted(r["reason"] for r in issues.collect()) == ["missing_file", "missing_video_path_field"]


def test_corpus_c(spark, tmp_path):
    root = str(tmp_path / "c")
    for n in ("real_real/s/a b.mp4", "real_fake/s/m_AudioX/c_AudioX.mp4", "real_fake/s/m_MMAudio/c_MMAudio.mp4", "fake_real/s/q.mp4", "__MACOSX/real_real/._z.mp4"):
        put(root, n)
    put(root, "real_real/s/A_b.wav")
    samples, missing = pipelines.corpus_c(listing.videos(spark, root), listing.audios(spark, root), root, lambda p: "false" if p.endswith("q.mp4") else "true", 0.4)
    s = {os.path.basename(r["video_path"]): r for r in samples.collect()}
    assert set(s) == {"a b.mp4", "c_AudioX.mp4", "c_MMAudio.mp4"} and s["a b.mp4"]["handling"] == "paired_file"
    assert s["c_AudioX.mp4"]["group_id"] == s["c_MMAudio.mp4"]["group_id"] and s["c_AudioX.mp4"]["split"] == s["c_MMAudio.mp4"]["split"]
    assert [os.path.basename(r["video_path"]) for r in missing.collect()] == ["q.mp4"]


def test_ambiguous_keys(spark):
    rows = [("k", "a"), ("k", "a"), ("m", "a"), ("m", "b"), ("n", "c")]
    assert {r["key"] for r in joins.unambiguous(spark.createDataFrame(rows, "key string, value string"), "key", "value").collect()} == {"k", "n"}


def test_fold_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"train_{i}.txt").write_text("id1 \nid2\n\n\n")
        (tmp_path / f"test_{i}.txt").write_text("id3\nid3\n")
    lists = readers.fold_lists(spark, str(tmp_path), 2)
    assert lists.count() == 6
    readers.assert_folds(lists, 2)
    (tmp_path / "test_2.txt").write_text("id1\n")
    with pytest.raises(ValueError, match="train and test"):
        readers.assert_folds(readers.fold_lists(spark, str(tmp_path), 2), 2)
    with pytest.raises(ValueError, match="missing"):
        readers.assert_folds(readers.fold_lists(spark, str(tmp_path), 3), 3)


def test_eval_jsonl(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    line = lambda v, label: json.dumps({"messages": [], "videos": v, "meta": {"overall_label": label}})
    path.write_text("\n" + line(["a.mp4"], "real") + "\n\n" + line(["/x/b.mp4"], "Fake") + "\n")
    got = readers.eval_jsonl(spark, str(path)).orderBy("index").collect()
    assert [(r["index"], r["line_number"], r["label"]) for r in got] == [(0, 2, "Real"), (1, 4, "Fake")]
    assert got[0]["video_path"] == f"{tmp_path}/a.mp4" and got[1]["video_path"] == "/x/b.mp4"
    assert readers.eval_jsonl(spark, str(path), 1).count() == 1 and readers.eval_jsonl(spark, str(path), 0).count() == 0
    path.write_text(line([], "Fake") + "\n")
    with pytest.raises(ValueError):
        readers.assert_samples(readers.eval_jsonl(spark, str(path)))


def test_scorer_retry_and_bundle(spark, tmp_path):
    def load():
        def score(rows):
            if any(r["video_path"] == "bad" for r in rows):
                raise RuntimeError("broken")
            return [{"p_fake": 0.5, "p_real": 0.5, "real_logit": 0.0, "fake_logit": 0.0} for _ in rows]

        return score

    rows = [(i, i, "bad" if i == 3 else f"v{i}", "Fake", {"k": "v"}) for i in range(6)]
    df = spark.createDataFrame(rows, "index long, line_number long, video_path string, label string, meta map<string,string>")
    good, bad = adapters.predictions(df, adapters.scored(df, load, ["video_path"], 4))
    assert {r["pred"] for r in good.collect()} == {"Fake"} and [r["index"] for r in bad.collect()] == [3] and "broken" in bad.first()["error"]
    sinks.write_evaluation(good, bad, str(tmp_path / "o"), "run & one")
    m = json.load(open(tmp_path / "o/metrics.json"))
    assert m["num_samples"] == 5 and m["num_bad_samples"] == 1 and "run &amp; one" in open(tmp_path / "o/summary.html").read()


def test_records(spark):
    df = spark.createDataFrame([("/v.mp4", None, ("Fake",)), ("/w.mp4", "/w.wav", ("Real",))], "video_path string, audio_path string, meta struct<overall_label:string>")
    r = records.binary_records(df).orderBy("videos").collect()
    assert r[0]["audios"] is None and r[1]["audios"] == ["/w.wav"] and "<audio>" in r[1]["messages"][1]["content"] and r[0]["messages"][2]["content"] == "Fake"
    assert records.with_audio(records.binary_records(df), "/o").orderBy("videos").first()["audios"] == ["/o/v.wav"]


def test_archives(spark):
    a = spark.createDataFrame([("good.zip", "o1"), ("bad.zip", "o2"), ("none.zip", "o4")], "archive_path string, output_dir string")

    def extract(path, out):
        if path == "bad.zip":
            raise OSError("corrupt")
        return 2 if path == "good.zip" else 0

    m = {r["archive_path"]: r for r in adapters.unpacked(a, extract).collect()}
    assert [m[k]["status"] for k in ("good.zip", "bad.zip", "none.zip")] == ["extracted", "failed", "failed"]
    with pytest.raises(RuntimeError):
        adapters.assert_unpacked(adapters.unpacked(a, extract))


def test_zip_archives_are_unpacked_member_by_member(spark, tmp_path):
    import zipfile

    for name, inner in (("good", {"v/a.MP4": b"x" * 9, "v/b.mp4": b"", "t.txt": b"t", "e/": b""}), ("none", {"readme.txt": b"r"}), ("empty", {}), ("evil", {"../out.mp4": b"x", "in.mp4": b"y"}), ("big", {f"d{i % 3}/{i}.mp4": os.urandom(300_000) for i in range(12)})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for member, data in inner.items():
                z.writestr(member, data)
    (tmp_path / "bad.zip").write_text("no archive")
    names = ("good", "none", "empty", "evil", "big", "bad")
    a = spark.createDataFrame([(str(tmp_path / f"{n}.zip"), str(tmp_path / "out" / n)) for n in names], "archive_path string, output_dir string")
    assert archives.members(a).filter("member LIKE 'd%'").agg(F.sum("size")).first()[0] == 3_600_000
    run = lambda: {os.path.basename(r["output_dir"]): r for r in adapters.resumed(a, f"{tmp_path}/manifest", archives.unzipped).collect()}
    first = run()
    assert {n: first[n]["status"] for n in names} == {"good": "extracted", "none": "failed", "empty": "failed", "evil": "failed", "big": "extracted", "bad": "failed"}
    assert first["good"]["video_count"] == 2 and first["big"]["video_count"] == 12 and first["bad"]["error_type"] == "BadZipFile" and "no video" in first["empty"]["error"] and "outside" in first["evil"]["error"]
    with zipfile.ZipFile(tmp_path / "big.zip") as z:
        assert all((tmp_path / "out/big" / m).read_bytes() == z.read(m) for m in z.namelist())
    assert not (tmp_path / "out/out.mp4").exists() and not [f for _, _, fs in os.walk(tmp_path / "out") for f in fs if f.endswith(".part")]
    stamp = os.stat(tmp_path / "out/good/v/a.MP4").st_mtime_ns
    again = run()
    assert again["good"]["status"] == again["big"]["status"] == "skipped" and again["bad"]["status"] == "failed" and again["good"]["video_count"] == 2 and os.stat(tmp_path / "out/good/v/a.MP4").st_mtime_ns == stamp


def test_back_ends(spark):
    df = spark.createDataFrame([(0, {"12768": -0.2, "52317": -1.3}), (1, {"12768": -2.0, "52317": -0.1}), (2, {"7": -1.0}), (3, None)], "index long, logprobs map<string,double>")
    x = adapters.backend("logprobs")(df, {})
    got = {r["index"]: r for r in x.collect()}
    assert ", ".join(f"{c} {t}" for c, t in x.dtypes) == adapters.SCORED and "Python" not in x._jdf.queryExecution().executedPlan().toString()
    assert got[0]["p_real"] > 0.7 and got[1]["p_fake"] > 0.8 and "12768" in got[2]["error"] and got[2]["p_fake"] is None and "no log prob" in got[3]["error"]
    logits = spark.createDataFrame([(0, 1.0, 1.0), (1, None, 2.0)], "index long, real_logit double, fake_logit double")
    r = {r["index"]: r for r in adapters.backend("logits")(logits, {}).collect()}
    assert r[0]["p_fake"] == 0.5 and r[0]["error"] is None and "without a pair" in r[1]["error"]
    with pytest.raises(ValueError):
        adapters.backend("none")


@pytest.mark.parametrize("kind, value", [
    ("logprob_token_ids map<int,double>", {12768: -0.1, 52317: -2.0}), ("logprob_token_ids array<map<string,double>>", [{"12768": -0.1, "52317": -2.0}]),
    ("logprobs array<map<int,struct<logprob:double,rank:int>>>", [{12768: (-0.1, 1), 52317: (-2.0, 2)}]), ("token_logprobs map<string,struct<logprob:double>>", {"12768": (-0.1,), "52317": (-2.0,)}),
])
def test_log_probabilities_of_every_container(spark, kind, value):
    df = spark.createDataFrame([(0, (value, "x")), (1, (None, "x"))], f"index long, logprobs struct<{kind.replace(' ', ':', 1)},text:string>")
    r = {r["index"]: r for r in adapters.from_logprobs(df, {}).collect()}
    assert abs(r[0]["real_logit"] + 0.1) < 1e-12 and r[0]["p_real"] > 0.8 and "no log prob" in r[1]["error"]


def test_the_first_container_counts_and_ids_have_bounds(spark):
    df = spark.createDataFrame([(0, ({"5": -1.0, "6": -2.0}, [{"5": -9.0, "6": -9.0}])), (1, (None, [{"5": -9.0, "6": -8.0}])), (2, (None, []))], "index long, a struct<token_logprobs:map<string,double>,logprobs:array<map<string,double>>>")
    r = {r["index"]: r for r in adapters.from_logprobs(df, {"logprobs_column": "a", "real_token_id": 5, "fake_token_id": "6"}).collect()}
    assert r[0]["real_logit"] == -9.0 and r[1]["fake_logit"] == -8.0 and r[2]["error"]
    v = spark.createDataFrame([([0.5, 1.5, 2.5], [1, 1, 0])], "v array<double>, mask array<int>")
    assert v.select(S.token_logit("v", 2), S.last_valid("v", "mask")).first() == (2.5, 1.5)
    with pytest.raises(Exception, match="outside a vocabulary of 3"):
        v.select(S.token_logit("v", 3)).collect()


def test_targets_of_sound_that_would_collide(spark):
    rows = [("/v/a.mp4", None, None), ("/v/a.mov", None, None), ("/v/b.mp4", None, None), ("/v/c.mp4", "/own.wav", "paired_file")]
    df = spark.createDataFrame(rows, "video_path string, audio_path string, handling string")
    got = {r["video_path"]: r["target"] for r in records.extraction_plan(df, "/o", spark.createDataFrame([], "path string")).collect()}
    assert got == {"/v/a.mp4": "/o/v/a.mp4.wav", "/v/a.mov": "/o/v/a.mov.wav", "/v/b.mp4": "/o/v/b.wav", "/v/c.mp4": "/own.wav"}


def test_a_restart_works_on_what_the_manifest_lacks(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    broken = spark.sparkContext.broadcast({"2"})

    def extract(path, out):
        calls.add(1)
        if path in broken.value:
            raise OSError("corrupt")
        return 3

    a = spark.createDataFrame([(str(i), f"o{i}") for i in range(9)], "archive_path string, output_dir string").repartition(3)
    first = {r["archive_path"]: r["status"] for r in adapters.resumed(a, f"{tmp_path}/m", lambda rest: adapters.unpacked(rest, extract)).collect()}
    assert calls.value == 9 and first["2"] == "failed" and list(first.values()).count("extracted") == 8
    broken = spark.sparkContext.broadcast(set())
    again = {r["archive_path"]: r["status"] for r in adapters.resumed(a, f"{tmp_path}/m", lambda rest: adapters.unpacked(rest, extract)).collect()}
    assert calls.value == 10 and again.pop("2") == "extracted" and set(again.values()) == {"skipped"}
    assert {r["status"] for r in adapters.resumed(a, f"{tmp_path}/m", lambda rest: adapters.unpacked(rest, extract)).collect()} == {"skipped"} and calls.value == 10


def test_summary_and_metrics_files(spark, tmp_path):
    document = {"num_predictions": 10, "num_bad_samples": 1, "accuracy": 0.7, "roc_auc": 0.8, "average_precision": 0.75, "fake_recall": 0.6, "real_recall": 0.9, "confusion_matrix_labels": ["Fake", "Real"], "confusion_matrix": [[3, 2], [1, 4]]}
    sinks.write_text(spark, str(tmp_path / "r1/metrics.json"), json.dumps(document))
    runs = spark.createDataFrame([("one", "A", "completed", 0, "/c/1", "/d/e.jsonl", str(tmp_path / "r1")), ("two", None, "failed", 1, None, "/d/f.jsonl", str(tmp_path / "r2"))], "name string, dataset string, status string, returncode int, adapter_path string, jsonl string, output_dir string")
    schema = "num_predictions long, num_bad_samples long, accuracy double, roc_auc double, average_precision double, fake_recall double, real_recall double, confusion_matrix_labels array<string>, confusion_matrix array<array<long>>"
    found = readers.metrics_of_runs(spark, runs.select("output_dir"), schema)
    rows = metrics.run_summary(runs, found)
    assert tuple(rows.columns) == K.SUMMARY_FIELDS
    sinks.write_summary(rows, str(tmp_path / "s"))
    one, two = sorted(json.load(open(tmp_path / "s/summary.json")), key=lambda r: r["name"])
    assert (one["status"], one["accuracy"], one["auc"], one["ap"], one["map"], one["confusion_matrix"], one["dataset"]) == ("completed", 0.7, 0.8, 0.75, 0.75, [[3, 2], [1, 4]], "A")
    assert two["auc"] is None and two["dataset"] == "" and two["returncode"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "s/summary.csv")).count() == 2
    page = sinks.summary_html({"roc_auc": 0.51239, "accuracy": 0.5, "average_precision": None})
    assert "0.5124" in page and "50.00%" in page and "N/A" in page


def test_corpus_c_preparation(spark, tmp_path):
    root = str(tmp_path / "c")
    for n in ("real_real/s/talk.mp4", "real_real/s/talk.wav", "fake_real/s/q.mp4", "real_fake/s/silent.mp4"):
        put(root, n)
    extract = lambda video, target: put(os.path.dirname(target), os.path.basename(target))
    p = config.resolve({"kind": "c"}, {"root": root}, {"output_dir": str(tmp_path / "o")})
    r = {os.path.basename(x["videos"][0]): x for x in pipelines.prepare_c(spark, p, lambda path: str("silent" not in path).lower(), extract).collect()}
    assert set(r) == {"talk.mp4", "q.mp4"} and r["talk.mp4"]["audios"] == [f"{root}/real_real/s/talk.wav"] and "<audio>" in r["q.mp4"]["messages"][1]["content"]
    assert os.path.exists(r["q.mp4"]["audios"][0]) and r["q.mp4"]["messages"][2]["content"] == "Fake" and r["q.mp4"]["meta"]["modality_type"] == "F-R"
    counts = {x["audio_handling"]: x["n"] for x in spark.read.option("header", True).csv(f"{p.output_dir}/audio_handling.csv").collect()}
    assert counts == {"paired_file": "1", "extract_from_video": "1"} and spark.read.json(f"{p.output_dir}/missing_audio").count() == 1
    with pytest.raises(RuntimeError, match="extracted"):
        pipelines.prepare_c(spark, config.resolve({"kind": "c", "overwrite": True}, {"root": root}, {"output_dir": str(tmp_path / "o")}), lambda path: "true", lambda v, t: 1 / 0)


def test_preconditions(spark, corpus, tmp_path):
    os.makedirs(f"{corpus}/empty-dir")
    assert listing.directories(spark, corpus + "/none") is None and "empty-dir" in listing.directories(spark, corpus)
    os.rename(f"{corpus}/FakeVideo-FakeAudio", f"{corpus}/other")
    for root, want in ((corpus, [("missing_category_dir", f"{corpus}/FakeVideo-FakeAudio")]), (corpus + "/none", [("missing_root", corpus + "/none")])):
        got = validate.precondition_issues(spark, "a", root, listing.directories(spark, root), tuple(K.CATEGORIES))
        assert [(r["reason"], r["expected_path"]) for r in got.collect()] == want
    out = str(tmp_path / "out")
    pipelines.prepare(spark, config.resolve({"kind": "a"}, {"root": corpus}, {"output_dir": out}))
    assert "missing_category_dir" in {r["reason"] for r in spark.read.option("header", True).csv(f"{out}/missing_or_invalid.csv").collect()}


def test_corpus_b_takes_paths_from_structs(spark, tmp_path):
    root = str(tmp_path / "b")
    for n in "xyz":
        put(root, f"{n}.mp4")
    rows = [(("x.mp4", "no"),), ((None, "y.mp4"),), ((" ", f"{root}/z.mp4"),), ((None, None),), (None,)]
    df = spark.createDataFrame(rows, "video_path struct<path:string,filename:string>").withColumns({"label": F.lit("real"), "split": F.lit("train"), "language": F.lit("en"), "open_set_model": F.lit("0"), "open_set_language": F.lit("0")})
    samples, issues = pipelines.corpus_b(df, listing.files(spark, root), root)
    assert {os.path.basename(r["video_path"]) for r in samples.collect()} == {"x.mp4", "y.mp4", "z.mp4"}
    assert [r["reason"] for r in issues.collect()] == ["missing_video_path_field"] * 2


def test_metadata_fills_only_blanks(spark):
    df = spark.createDataFrame([("fr", "en"), (" ", "en"), (None, None)], "own string, found string")
    assert [r[0] for r in df.select(S.filled(F.col("own"), F.col("found"))).collect()] == ["fr", "en", None]


def test_durations(spark):
    files = spark.createDataFrame([(f"/v/{i}.mp4",) for i in range(9)], "path string")
    got = pipelines.duration_quantiles(files, lambda p: "broken" if p == "/v/0.mp4" else os.path.basename(p)[0] + ".5").collect()
    assert {r["q"]: r["v"] for r in got}[0.0] == 1.5 and {r["q"]: r["v"] for r in got}[1.0] == 8.5 and got[0]["mean"] == 5.0


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("runs:\n- {name: a, jsonl: x, output_dir: /own}\n- {name: b, jsonl: y}\n")
    runs = config.load_runs(str(tmp_path / "c.yaml"))["runs"]
    assert [r["name"] for r in config.selected(runs, "b,b  ")] == ["b"] and len(config.selected(runs, None)) == 2
    with pytest.raises(ValueError):
        config.selected(runs, ["zzz"])
    whole = {"runs": runs, "defaults": {"output_root": "/d", "batch": 4, "fps": 2.0}}
    one, two = config.evaluations(whole, {"output_root": "/cli", "batch": None})
    assert (one.output_dir, two.output_dir, two.batch, two.extra) == ("/own", "/cli/b", 4, {"fps": 2.0})
    assert config.evaluations(whole, {"batch": 9, "max_samples": 5}, "b")[0].batch == 9
    for bad in ({"name": ""}, {"jsonl": ""}, {"batch": 0}, {"max_samples": -1}):
        with pytest.raises(ValueError):
            config.evaluations(whole, bad)
    with pytest.raises(ValueError, match="output_dir"):
        config.layered(config.Evaluation, {"name": "a", "jsonl": "b"})
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path / "l.json"))
    for bad in ({"kind": "z"}, {"train_ratio": 1.0}, {"max_per_class": 0}, {"mode": "x"}, {"root": ""}):
        with pytest.raises(ValueError):
            config.resolve({"kind": "a", "root": "r", "output_dir": "o"}, bad, {})


def test_each_source_is_read_once(spark, tmp_path):
    root = str(tmp_path / "b")
    for i in range(20):
        put(root, f"v{i}.mp4")
    reads = spark.sparkContext.accumulator(0)

    def source(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    schema = "video_path string, label string, split string, language string, open_set_model string, open_set_language string"
    df = spark.createDataFrame([(f"v{i}.mp4" if i < 20 else f"gone{i}.mp4", "real", "train", "en", "0", "0") for i in range(25)], schema).mapInPandas(source, schema)
    out = str(tmp_path / "o")
    got = pipelines.prepare(spark, config.resolve({"kind": "b"}, {"root": root}, {"output_dir": out}), df)
    assert got.count() == 20 and reads.value == 25 and json.load(open(f"{out}/issue_totals.json")) == {"invalid": 0, "missing": 5}
    assert spark.read.json(f"{out}/outputs").count() == 20 and spark.read.option("header", True).csv(f"{out}/missing_or_invalid.csv").count() == 5


def test_subjects_in_no_fold_are_found_while_samples_are_written(spark, corpus, tmp_path):
    folds = tmp_path / "folds"
    folds.mkdir()
    for i in range(1, 6):
        (folds / f"train_{i}.txt").write_text("id9\n")
        (folds / f"test_{i}.txt").write_text("id8\n")
    p = config.resolve({"kind": "a", "folds": str(folds)}, {"root": corpus}, {"output_dir": str(tmp_path / "o")})
    with pytest.raises(ValueError, match="samples without a subject: 2 rows.*subjects in no fold: 1 rows, such as 'id1'"):
        pipelines.prepare(spark, p)


def test_folders_have_a_bounded_number_of_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 16).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 7)).alias("output"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        sinks.write_jsonl(rows, str(tmp_path / "a"), by="output")
        sinks.write_jsonl(rows, str(tmp_path / "b"), by="output", order="text")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for name in "ab":
        files = {d: [f for f in os.listdir(tmp_path / name / d) if f.startswith("part-")] for d in os.listdir(tmp_path / name) if "=" in d}
        assert spark.read.json(str(tmp_path / name)).count() == 4000 and len(files) == 8
        assert sum(map(len, files.values())) < 40, files  # without, 16 tasks write 128 files into 8 folders
    assert len([f for f in os.listdir(tmp_path / "a/output=hot") if f.startswith("part-")]) > 1  # the hot one is split


def test_paths_with_blanks_and_signs(spark, tmp_path):
    folder = tmp_path / "my run 100%+é"
    folder.mkdir()
    (folder / "e.jsonl").write_text(json.dumps({"messages": [], "videos": ["v/a b.mp4"], "meta": {"overall_label": "Real"}}) + "\n")
    assert readers.eval_jsonl(spark, str(folder / "e.jsonl")).first()["video_path"] == f"{folder}/v/a b.mp4"
    sinks.write_text(spark, str(folder / "metrics.json"), json.dumps({"accuracy": 0.5}))
    runs = spark.createDataFrame([(str(folder),), (str(tmp_path / "none"),)], "output_dir string")
    assert {r["output_dir"]: r["accuracy"] for r in readers.metrics_of_runs(spark, runs, "accuracy double").collect()} == {str(folder): 0.5, str(tmp_path / "none"): None}


def test_merged_workers(spark, tmp_path):
    row = lambda i, w=None: (i, i, f"v{i}", "Fake" if i % 2 else "Real", "Fake" if i % 3 else "Real", 0.5, 0.1 * i, 0.0, 0.0, w)
    schema = "index long, line_number long, video_path string, label string, pred string, p_real double, p_fake double, real_logit double, fake_logit double, parallel_worker long"
    parts = [spark.createDataFrame([row(3), row(1)], schema), spark.createDataFrame([row(2, 7), row(0)], schema)]
    bad = [spark.createDataFrame([(9, "x")], "index long, error string"), spark.createDataFrame([], "index long, error string")]
    pipelines.merged_evaluation(parts, bad, str(tmp_path / "m"), "merged")
    got = spark.read.json(str(tmp_path / "m/predictions.jsonl")).orderBy("index").collect()
    assert [(r["index"], r["parallel_worker"]) for r in got] == [(0, 1), (1, 0), (2, 7), (3, 0)] and json.load(open(tmp_path / "m/metrics.json"))["num_bad_samples"] == 1


def test_tagged_union(spark):
    a = spark.createDataFrame([(1, None), (2, 7)], "i int, parallel_worker long")
    got = {r["i"]: r["parallel_worker"] for r in pipelines.tagged_union([a, spark.createDataFrame([(3,)], "i int")]).collect()}
    assert got == {1: 0, 2: 7, 3: 1}


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"x": [1, 2]})
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as s, pa.ipc.new_file(s, t.schema) as w:
        w.write_table(t)
    assert readers.arrow_dataset(spark, [str(tmp_path / "f.arrow")], "x long").agg(F.sum("x")).first()[0] == 3
    many = pa.table({"x": list(range(90)), "y": [str(i) for i in range(90)], "z": [[i] for i in range(90)]})
    for name, opened in (("m.arrow", pa.ipc.new_file), ("s.arrow", pa.ipc.new_stream)):
        with pa.OSFile(str(tmp_path / name), "wb") as f, opened(f, many.schema) as w:
            w.write_table(many, max_chunksize=10)
    x = readers.arrow_dataset(spark, [str(tmp_path / "m.arrow"), str(tmp_path / "s.arrow")], "y string, x int, none double")
    assert x.count() == 180 and x.agg(F.sum("x")).first()[0] == 2 * 89 * 45 and x.filter("y = '7'").count() == 2 and x.filter("none IS NULL").count() == 180
    assert x.rdd.getNumPartitions() == 10 and x.select(F.spark_partition_id().alias("p")).distinct().count() == 10  # nine batches of a file, one stream
    assert readers.arrow_dataset(spark, [], "x long").count() == 0
