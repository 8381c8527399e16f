import math
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S


def values(spark, column, rows, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_clean_text(spark):
    rows = ["　a ", "NaN", " none", "NULL", None, "", "nano"]
    assert values(spark, S.clean_text("c"), rows) == ["a", "", "", "", "", "", "nano"]


def test_lenient_bool(spark):
    assert values(spark, S.lenient_bool("c"), [" TRUE", "1", "yes", "Y", "t", "0", "on", None]) == [True] * 5 + [False] * 3
    assert values(spark, S.lenient_number_bool("c"), [1.0, 0.0, math.nan, None], "c double") == [True, False, True, False]


def test_suffix_and_stem_match_pathlib(spark):
    names = [".mp4", "a.", "..a", "a.tar.gz", "X.MP4", "a b.é", "x", "k=v.mov", "a.b.", "...", "日本.mp4"]
    assert values(spark, S.suffix("c"), names) == [PurePosixPath(n).suffix.lower() for n in names]
    assert values(spark, S.stem("c"), names) == [PurePosixPath(n).stem for n in names]


def test_labels(spark):
    assert values(spark, S.normalise_label("c"), [" REAL", "fake", "x ", None]) == ["Real", "Fake", "x", ""]
    assert values(spark, S.label_of_text("c"), ["real", "no", None]) == ["Real", "Fake", "Fake"]
    with pytest.raises(Exception, match="not a label"):
        values(spark, S.checked_label("c"), ["maybe"])


def test_stems_of_generated_clips(spark):
    names = ["Clip  001（a）_AudioX.mp4", "audiox.mp4", "x_MMAudio_y.mov"]
    assert values(spark, S.normalised_stem("c"), names) == ["clip_001_a_audiox", "audiox", "x_mmaudio_y"]
    assert values(spark, S.without_generator(S.normalised_stem("c")), names) == ["clip_001_a", "audiox", "x_y"]


PATHS = [
    "train/real_real/talkvid/talk001.mp4", "train/real_fake/msrvtt/msrvtt_AudioX/clip_001_AudioX.mp4", "train/fake_real/Humo/humo_001.mp4",
    "train/fake_fake/indirect/pika/pika_AudioX/clip_001_AudioX.mp4", "train/fake_fake/direct/clip_001_MMAudio.mp4",
]


def test_labels_from_paths(spark):
    parts = S.relative_parts("c", "/r")
    rows = ["/r/" + p for p in PATHS]
    assert values(spark, S.modality(parts), rows) == ["real_real", "real_fake", "fake_real", "fake_fake", "fake_fake"]
    assert values(spark, S.category_labels(S.modality(parts))["modality_type"], rows) == ["R-R", "R-F", "F-R", "F-F", "F-F"]
    assert values(spark, S.generation_path(S.modality(parts), parts), rows) == ["", "", "", "indirect", "direct"]
    assert values(spark, S.audio_source(parts), rows) == ["", "msrvtt_AudioX", "", "pika_AudioX", ""]
    assert values(spark, S.part_after(parts, F.lit("real_real")), ["/r/real_real/x.mp4", "/r/real_real/d/x.mp4"]) == ["", "d"]
    groups = values(spark, S.group_id(S.modality(parts), parts, S.name_of("c")), rows)
    assert groups[1] == "real_fake:msrvtt::clip_001" and groups[3] == "fake_fake:indirect:indirect:clip_001" and groups[4].endswith("clip_001_mmaudio")
    with pytest.raises(Exception, match="no modality"):
        values(spark, S.modality(parts), ["/r/other/x.mp4"])


def test_paths(spark):
    assert values(spark, S.relative_path("c", "/r"), ["/r/a/b.mp4", "/x/b.mp4"]) == ["a/b.mp4", "b.mp4"]
    assert values(spark, S.is_ignored("c"), ["a/__MACOSX/x", "a/._x.mp4", "a/b.mp4", "a_/x"]) == [True, True, False, False]
    assert values(spark, S.audio_target("c", "/out"), ["/a/b/c.mp4", "c.mov"]) == ["/out/a/b/c.wav", "/out/c.wav"]
    assert values(spark, S.subject_id(F.lit(""), S.relative_parts("c", "/r")), ["/r/A/ID7/x.mp4", "/r/a/x.mp4"]) == ["ID7", ""]


def test_softmax_and_division(spark):
    p = values(spark, S.pair_softmax(F.col("c"), F.lit(0.0)), [0.0, 800.0, -800.0], "c double")
    assert [x["pred"] for x in p] == ["Fake", "Real", "Fake"] and p[1]["p_real"] == 1.0
    assert values(spark, S.safe_div(F.lit(1), F.col("c")), [0.0, 2.0, None], "c double") == [0.0, 0.5, 0.0]
    assert values(spark, S.batch_count("c", 4), [0, 1, 8, 9], "c int") == [0, 1, 2, 3]
    assert values(spark, S.percent("c"), [0.12345, None], "c double") == ["12.35%", "N/A"]


def test_log_probabilities_and_masks(spark):
    m = F.create_map(F.lit("12768"), F.lit(-0.2), F.lit("52317"), F.lit(-1.3))
    assert values(spark, S.logprob_of(m, F.col("c")), ["12768", "52317"]) == [-0.2, -1.3]
    with pytest.raises(Exception, match="no log probability"):
        values(spark, S.logprob_of(m, F.col("c")), ["1"])
    assert values(spark, S.last_valid(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(1), F.lit(0))), ["x"]) == [2]


def test_answers(spark):
    a = values(spark, S.structured_answer(F.lit("Fake"), F.lit("Fake"), F.lit("Real"), F.col("c")), ["F-R"])[0]
    assert a == '{"overall_label":"Fake","video_label":"Fake","audio_label":"Real","modality_type":"F-R","evidence":"The video modality is fake while the audio modality is real."}'
    assert values(spark, S.metadata_json(F.create_map(F.lit("b"), F.col("c"), F.lit("a"), F.lit("ä"))), [None]) == ['{"a":"ä","b":""}']
