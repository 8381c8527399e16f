"""Scalar functions, Column to Column; none of them is a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.constants import AUDIO_EXTENSIONS, CATEGORIES, FAKE, GENERATOR_TOKENS, IGNORED_DIRECTORY, LABELS, MODALITIES, NO_EVIDENCE, PATH_FIELDS, PATH_WORDS, REAL, VIDEO_EXTENSIONS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -----------------------------------------------------------------------------------------------------------
def strip(c) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def json_scalar(c) -> Column:
    """A value as text for a JSON map; null is empty."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def clean_text(c) -> Column:
    """Stripped; null and the words nan, none and null in any case are empty."""
    s = strip(F.coalesce(_c(c).cast("string"), F.lit("")))
    return F.when(F.lower(s).isin("nan", "none", "null"), F.lit("")).otherwise(s)


def lenient_bool(c) -> Column:
    """true, 1, yes, y and t in any case are true; anything else and null are false."""
    return F.coalesce(F.lower(strip(_c(c).cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


def lenient_number_bool(c) -> Column:
    """Numbers other than 0 are true, NaN included; null is false."""
    return F.coalesce(_c(c).cast("double") != 0.0, F.lit(False))


def first_filled(*cs) -> Column:
    """The first of the cleaned values that is not empty, else empty."""
    return F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in cs], F.lit(""))


def first_present(row, names) -> Column:
    """The first filled value under the candidate names of a map, names in any case."""
    low = F.map_from_entries(F.transform(F.map_entries(_c(row)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return first_filled(*[F.try_element_at(low, F.lit(n)) for n in names])


def method_of(*cs) -> Column:
    """Like first_filled, but the words true and false don't count."""
    return F.coalesce(*[F.when(~F.lower(clean_text(c)).isin("", "true", "false"), clean_text(c)) for c in cs], F.lit(""))


def metadata_json(m) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(_c(m), lambda k, v: json_scalar(v))))))


def label_of_text(c) -> Column:
    """real in any case is Real, anything else and null are Fake."""
    return F.when(F.lower(clean_text(c)) == "real", F.lit(REAL)).otherwise(F.lit(FAKE))


def normalise_label(c) -> Column:
    """real and fake in any case get their usual form, other texts are stripped, null is empty."""
    s = strip(F.coalesce(_c(c).cast("string"), F.lit("")))
    return F.when(F.lower(s) == "real", F.lit(REAL)).when(F.lower(s) == "fake", F.lit(FAKE)).otherwise(s)


def checked_label(c) -> Column:
    """The normalised label; the query fails on any other than Real and Fake."""
    n = normalise_label(c)
    return F.when(n.isin(*LABELS), n).otherwise(F.raise_error(F.concat(F.lit("not a label: "), n)))


# --- paths ----------------------------------------------------------------------------------------------------------
def name_of(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def parent_of(path) -> Column:
    p = _c(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def raw_suffix(name) -> Column:
    return F.regexp_extract(_c(name), r"(?s)^.+(\.[^.]+)$", 1)


def suffix(name) -> Column:
    """The lower-cased suffix with its dot; empty if there is none."""
    return F.lower(raw_suffix(name))


def suffix_or_none(name) -> Column:
    return F.coalesce(F.nullif(suffix(name), F.lit("")), F.lit("<no_ext>"))


def stem(name) -> Column:
    n = _c(name)
    return F.substr(n, F.lit(1), F.length(n) - F.length(raw_suffix(n)))


def relative_path(path, root: str) -> Column:
    """The path below root, or just the name of one outside."""
    p = _c(path)
    return F.when(F.startswith(p, F.lit(root.rstrip("/") + "/")), F.substr(p, F.lit(len(root.rstrip("/")) + 2))).otherwise(name_of(p))


def relative_parts(path, root: str) -> Column:
    """The parts below root, or all parts of a path outside."""
    p = _c(path)
    inside = F.startswith(p, F.lit(root.rstrip("/") + "/"))
    return F.split(F.when(inside, F.substr(p, F.lit(len(root.rstrip("/")) + 2))).otherwise(p), "/")


def joined(root, path) -> Column:
    """An absolute path as it is, any other below root."""
    p, r = _c(path), F.lit(root) if isinstance(root, str) else root
    return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/"), p))


def is_video(name) -> Column:
    return suffix(name).isin(*VIDEO_EXTENSIONS)


def is_audio(name) -> Column:
    return suffix(name).isin(*AUDIO_EXTENSIONS)


def is_ignored(path) -> Column:
    """Resource forks of archives: a part of that name, or one that starts with ._"""
    return F.exists(F.split(_c(path), "/"), lambda p: (p == IGNORED_DIRECTORY) | F.startswith(p, F.lit("._")))


def audio_target(path, root: str, ext: str = ".wav") -> Column:
    """The place of a video's sound track: its directories again, below root."""
    p = F.regexp_replace(_c(path), "^/+", "")
    inner = F.when(F.instr(p, "/") > 0, F.concat(parent_of(p), F.lit("/"))).otherwise(F.lit(""))
    return F.concat(F.lit(root.rstrip("/") + "/"), inner, stem(name_of(p)), F.lit(ext))


def own_audio_target(path, root: str, ext: str = ".wav") -> Column:
    """A place that no other video has: the video's suffix stays before that of the sound."""
    p = F.regexp_replace(_c(path), "^/+", "")
    return F.concat(F.lit(root.rstrip("/") + "/"), p, F.lit(ext))


def archive_target(path, root: str, out: str) -> Column:
    """Where an archive is unpacked to: its relative path without the suffix, below out."""
    r = relative_path(path, root)
    return F.concat(F.lit(out.rstrip("/") + "/"), F.substr(r, F.lit(1), F.length(r) - F.length(raw_suffix(name_of(r)))))


# --- names of generated clips ---------------------------------------------------------------------------------------
def normalised_stem(name) -> Column:
    s = F.regexp_replace(F.lower(stem(name)), r"(?U)[\s（）()]+", "_")
    return F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")


def without_generator(s) -> Column:
    """A normalised stem without the names of sound generators; as it was if nothing else is left."""
    def drop(c: Column, token: str) -> Column:
        return F.regexp_replace(F.regexp_replace(c, f"(^|_){token}($|_)", "_"), f"_{token}$", "")

    out = reduce(drop, GENERATOR_TOKENS, _c(s))
    out = F.regexp_replace(F.regexp_replace(out, "_+", "_"), "^_+|_+$", "")
    return F.when(out == "", _c(s)).otherwise(out)


def _lowered(parts) -> Column:
    return F.transform(_c(parts), lambda p: F.lower(p))


def modality(parts, strict: bool = True) -> Column:
    """The first of the known modalities, in their order, that is a part; the query fails (or null, if not strict) without one."""
    low, out = _lowered(parts), None
    for m in MODALITIES:
        out = F.when(F.array_contains(low, m), F.lit(m)) if out is None else out.when(F.array_contains(low, m), F.lit(m))
    return out.otherwise(F.raise_error(F.concat(F.lit("no modality in "), F.array_join(_c(parts), "/")))) if strict else out


def generation_path(modality_, parts) -> Column:
    low = _lowered(parts)
    inside = F.when(F.array_contains(low, "direct"), F.lit("direct")).when(F.array_contains(low, "indirect"), F.lit("indirect"))
    return F.when(_c(modality_) == "fake_fake", F.coalesce(inside, F.lit(""))).otherwise(F.lit(""))


def part_after(parts, marker) -> Column:
    """The directory that follows the marker's; empty if there is none but the file itself."""
    at = F.array_position(_lowered(parts), _c(marker))
    return F.when((at == 0) | (at + 1 >= F.size(_c(parts))), F.lit("")).otherwise(F.try_element_at(_c(parts), (at + 1).cast("int")))


def audio_source(parts) -> Column:
    """The deepest directory whose name holds that of a sound generator."""
    p = _c(parts)
    dirs = F.reverse(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))
    hit = lambda d: reduce(lambda a, b: a | b, [F.contains(F.lower(d), F.lit(t)) for t in GENERATOR_TOKENS])
    return F.coalesce(F.try_element_at(F.filter(dirs, hit), F.lit(1)), F.lit(""))


def group_id(modality_, parts, name) -> Column:
    """The key that keeps variants of one clip together."""
    m, s = _c(modality_), normalised_stem(name)
    path = generation_path(m, parts)
    body = F.when((m == "real_fake") | ((m == "fake_fake") & (path == "indirect")), without_generator(s)).otherwise(s)
    source = F.coalesce(F.nullif(F.lower(part_after(parts, m)), F.lit("")), F.lit("unknown"))
    return F.concat_ws(":", m, source, path, body)


def category_labels(category) -> Column:
    """overall_label, video_label, audio_label, modality_type of a category or modality name; null for others."""
    out = None
    for name, (o, v, a, m) in {**CATEGORIES, **MODALITIES}.items():
        s = F.struct(F.lit(o).alias("overall_label"), F.lit(v).alias("video_label"), F.lit(a).alias("audio_label"), F.lit(m).alias("modality_type"))
        out = F.when(_c(category) == name, s) if out is None else out.when(_c(category) == name, s)
    return out


def subject_id(source, parts) -> Column:
    """The metadata's source, else the deepest directory that starts with id in any case, else empty."""
    p = _c(parts)
    dirs = F.transform(F.reverse(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))), clean_text)
    found = F.try_element_at(F.filter(dirs, lambda d: F.startswith(F.lower(d), F.lit("id"))), F.lit(1))
    return F.coalesce(F.nullif(clean_text(source), F.lit("")), found, F.lit(""))


def lookup_keys(path, root: str) -> Column:
    """The five keys of a path in the order in which they are tried."""
    p = _c(path)
    return F.array(p, p, relative_path(p, root), name_of(p), stem(name_of(p)))


def structured_path(row, value, root: str) -> Column:
    """A bare file name below the directories that the row names; null unless all of them are there."""
    field = lambda k: clean_text(F.try_element_at(_c(row), F.lit(k)))
    dirs = [field(k) for k in ("type", "race", "gender", "source")]
    filled = reduce(lambda a, b: a & b, [d != "" for d in dirs]) & field("type").isin(*CATEGORIES)
    return F.when(filled & (F.instr(value, "/") == 0), F.concat_ws("/", F.lit(root.rstrip("/")), *dirs, value))


def path_candidates(row, root: str) -> Column:
    """The paths that a metadata row may mean: values that look like a path, in columns whose name speaks of one."""
    def speaks(e):
        return reduce(lambda a, b: a | b, [F.contains(F.lower(e["key"]), F.lit(w)) for w in PATH_WORDS])

    def shaped(v):
        return (v != "") & (F.contains(v, F.lit("/")) | F.contains(v, F.lit("\\")) | is_video(v))

    values = F.filter(F.transform(F.filter(F.map_entries(_c(row)), speaks), lambda e: clean_text(e["value"])), shaped)
    return F.transform(values, lambda v: F.when(F.startswith(v, F.lit("/")), v).otherwise(F.coalesce(structured_path(row, v, root), joined(root, v))))


# --- numbers --------------------------------------------------------------------------------------------------------
def safe_div(a, b) -> Column:
    """The quotient as a double; 0.0 where the divisor is 0 or either is null."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def pair_softmax(real, fake) -> Column:
    """p_real, p_fake and pred of two logits; a tie is Fake."""
    r, f = _c(real).cast("double"), _c(fake).cast("double")
    top = F.greatest(r, f)
    er, ef = F.exp(r - top), F.exp(f - top)
    return F.struct((er / (er + ef)).alias("p_real"), (ef / (er + ef)).alias("p_fake"), F.when(ef / (er + ef) >= er / (er + ef), F.lit(FAKE)).otherwise(F.lit(REAL)).alias("pred"))


def percent(c) -> Column:
    return F.when(_c(c).isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f%%", _c(c) * 100))


def batch_count(n, size: int) -> Column:
    if size < 1:
        raise ValueError("a batch has at least one row")
    return F.ceil(_c(n) / F.lit(size)).cast("long")


def logprob_of(m, token_id) -> Column:
    """The log probability of a token in a map by id; the query fails where it is missing."""
    key = F.lit(str(token_id)) if isinstance(token_id, int) else _c(token_id).cast("string")
    return F.coalesce(F.try_element_at(_c(m), key), F.raise_error(F.concat(F.lit("no log probability for token "), key)).cast("double"))


def logprob_map(df, column: str) -> Column:
    """Log probabilities by token id, as map<string,double>, of a server's answer: a struct with one of three containers.

    The first that a row has counts, in the order logprob_token_ids, logprobs, token_logprobs; each is a map, or a list whose
    first element is one. Keys are numbers or text; values are numbers or structs with a field logprob. Null without any."""
    kind = df.schema[column].dataType
    found = []
    for name in ("logprob_token_ids", "logprobs", "token_logprobs"):
        if name not in kind.names:
            continue
        c, t = F.col(column)[name], kind[name].dataType
        if t.typeName() == "array":
            c, t = F.try_element_at(c, F.lit(1)), t.elementType
        if t.typeName() != "map":
            continue
        plain = (lambda v: v["logprob"].cast("double")) if t.valueType.typeName() == "struct" else (lambda v: v.cast("double"))
        found.append(F.transform_values(F.transform_keys(c, lambda k, v: k.cast("string")), lambda k, v: plain(v)))
    return F.coalesce(*found) if found else F.lit(None).cast("map<string,double>")


def last_valid(values, mask) -> Column:
    """The element at the last position that the attention mask counts; null for an empty mask."""
    return F.try_element_at(_c(values), F.nullif(F.aggregate(_c(mask), F.lit(0), lambda a, x: a + x.cast("int")), F.lit(0)))


def token_logit(logits, token_id: int) -> Column:
    """The logit of a token in the logits of a vocabulary; the query fails for an id that is outside it."""
    v = _c(logits)
    outside = (F.lit(token_id) < 0) | (F.size(v) <= token_id)
    return F.when(outside, F.raise_error(F.concat(F.lit(f"token {token_id} is outside a vocabulary of "), F.size(v).cast("string"))).cast("double")).otherwise(F.get(v, F.lit(max(0, token_id))))


# --- records --------------------------------------------------------------------------------------------------------
def audio_paths(many, one) -> Column:
    """The list without blanks if there is one, else the single path, else nothing."""
    kept = F.filter(_c(many), lambda p: p.isNotNull() & (strip(p) != ""))
    single = F.when(F.coalesce(_c(one), F.lit("")) != "", F.array(_c(one))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size(_c(many)), F.lit(0)) > 0, kept).otherwise(single)


def messages(prompt, answer, system: str) -> Column:
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(said("system", F.lit(system)), said("user", _c(prompt)), said("assistant", _c(answer)))


def evidence(video_label, audio_label) -> Column:
    v, a = F.lower(_c(video_label)), F.lower(_c(audio_label))
    known = v.isin("real", "fake") & a.isin("real", "fake")
    return F.when(known, F.concat(F.lit("The video modality is "), v, F.lit(" while the audio modality is "), a, F.lit("."))).otherwise(F.lit(NO_EVIDENCE))


def structured_answer(overall, video, audio, modality_type) -> Column:
    known = lambda c: F.coalesce(_c(c), F.lit("Unknown"))
    s = F.struct(known(overall).alias("overall_label"), known(video).alias("video_label"), known(audio).alias("audio_label"), known(modality_type).alias("modality_type"), evidence(known(video), known(audio)).alias("evidence"))
    return F.to_json(s)


def path_text(df, column: str) -> Column:
    """A path column as text. Of a struct or map the first that isn't blank of path, filename, file counts."""
    kind = df.schema[column].dataType
    names = kind.names if kind.typeName() == "struct" else PATH_FIELDS if kind.typeName() == "map" else None
    if names is None:
        return clean_text(column)
    parts = [F.nullif(clean_text(F.col(column)[k]), F.lit("")) for k in PATH_FIELDS if k in names]
    return F.coalesce(*parts, F.lit("")) if parts else F.lit("")


def filled(own: Column, other: Column) -> Column:
    """own, or the other where own is blank: what a sample has isn't overwritten by its metadata."""
    return F.coalesce(F.nullif(clean_text(own), F.lit("")), other)
