"""Operator 4: line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its 5-word n-grams, in lower case; with fewer words it is one n-gram. Two lines match if their
Jaccard similarity is 0.75 or more. A line goes if an earlier line matches it, in the order of (doc_id, line number),
whether or not that one goes as well. So no line goes without an earlier match, and no classes need be built.

1. Every line's n-grams are hashed once and stored. A table of BUCKETS counters over all of them gives each n-gram a level
   of frequency; level and hash together are one integer, so that integers are ordered from rare to frequent. With so many
   n-grams that all counters are full, only those far above the usual counter keep a level; the order stays a global one.
2. Lines with the same set are one entry of the join, the first of them, so copies never meet each other.
3. Only prefixes are dealt by n-gram. Length and position filters drop an entry of an n-gram if no class of (size, position)
   there, counted first, could match it; a crowd that can't match isn't met pair by pair.
4. What is left carries its whole set, and a semi join looks for an earlier entry of the same n-gram that matches; it stops
   at the first and returns no pairs. The planner splits crowded n-grams. Entries of more than LONG n-grams never carry their
   sets along with their n-grams; they are compared by pairs of numbers, so what is shuffled grows in line with a line.

Defined results: blank lines have no n-gram and always stay; null texts stay null; a row that is repeated as a whole is
one document, so its lines aren't removed for its own copies; documents with equal ids are ordered by a hash of their
text; null ids come last; an empty table gives an empty result. All columns of the input are kept, whatever their names;
an input column that is named like one of the two new ones gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, forget, released, small, stored, work_folder
from tessera.llm.jaccard import HASH_BITS, HEAVY, possible, with_partners

N, BUCKETS, LONG = 5, 1 << 15, 256


def _lines(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """docs(doc_id, text) -> rid, doc_id, pos, line, odd for the lines with a word, in lower case; odd: of a text with tabs and the like.

    What holds for a text is worked out in a projection of its own, below the one that deals out its lines.
    only(want_rid, want_pos): the lines that are wanted."""
    d = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.lower("text").alias("low"))
    if only is not None:
        d = d.join(only.select("want_rid").distinct(), F.col("rid") == F.col("want_rid"), "left_semi")
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.col("low").contains(c)
    d = d.withColumn("odd", odd).select("doc_id", "rid", "odd", F.posexplode(F.split("low", "\n", -1)).alias("pos", "line"))
    if only is not None:
        d = d.join(only, (F.col("rid") == F.col("want_rid")) & (F.col("pos") == F.col("want_pos")), "left_semi")
    return d.filter(F.when(F.col("odd"), F.col("line").rlike(r"[^\x20\x09-\x0D]")).otherwise(F.trim("line") != ""))


def _tokens(lines: DataFrame) -> DataFrame:
    """rid, doc_id, pos, tokens: the hashes of the line's distinct n-grams, of HASH_BITS bits, in order.

    Hashes of two, four and five words are put together from neighbours, an array at a time."""
    words = F.array_remove(F.when(F.col("odd"), F.split("line", SPACE)).otherwise(F.split("line", " ")), "")
    d = lines.select("rid", "doc_id", "pos", F.transform(words, lambda w: F.xxhash64(w)).alias("w")).withColumn("k", F.size("w"))
    cut = lambda h: h.bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    behind = lambda c, i: F.slice(c, F.lit(i + 1), F.greatest(F.col("k") - i, F.lit(0)))
    d = d.withColumn("two", F.zip_with("w", behind("w", 1), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("four", F.zip_with("two", behind("two", 2), lambda a, b: F.xxhash64(a, b)))
    grams = F.slice(F.zip_with("four", behind("w", N - 1), lambda a, b: cut(F.xxhash64(a, b))), F.lit(1), F.greatest(F.col("k") - N + 1, F.lit(0)))
    tokens = F.when(F.col("k") < N, F.array(cut(F.xxhash64("w")))).otherwise(F.sort_array(F.array_distinct(grams)))
    return d.select("rid", "doc_id", "pos", tokens.alias("tokens"))


def _levels(tokens: DataFrame) -> list[int]:
    """A level from 0 (rare) to 7 for each of BUCKETS counters, from all lines; BUCKETS rows reach the driver."""
    rows = tokens.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count().collect()
    counts = sorted(r["count"] for r in rows)
    usual = counts[len(counts) // 2] if len(counts) == BUCKETS else 0
    out = [0] * BUCKETS
    for r in rows:
        out[r["b"]] = min(7, (max(1, r["count"] - usual).bit_length() - 1) // 3)
    return out


def _keys(levels: list[int]):
    """The n-grams in the global order, as integers. The levels, in their place among the bits, are a constant array.

    No key is null, and the planner is told so: then plain integers are sorted, not objects."""
    high = F.split(F.lit(",".join(str(x << HASH_BITS) for x in levels)), ",").cast("array<bigint>")
    return F.sort_array(F.transform("tokens", lambda t: F.coalesce(F.get(high, t.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).bitwiseOR(t), F.lit(0))))


def _with_company(post: DataFrame) -> DataFrame:
    """The rows (token, sid, n, pos) whose token occurs in two sets or more; all rows of heavy ones, which are dealt by set as well.

    The set is worked into the low bits of heavy ones, and taken out again: a single integer is sorted by its digits. n and pos
    travel as one integer."""
    heavy = F.shiftright("token", HASH_BITS) >= HEAVY
    dealt = F.col("token").bitwiseXOR(F.when(heavy, F.pmod("sid", F.lit(64))).otherwise(F.lit(0)))  # its own inverse: levels stay
    together = F.count("*").over(W.partitionBy("token"))
    packed = post.select(dealt.alias("token"), "sid", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    kept = packed.withColumn("together", together).filter((F.col("together") > 1) | heavy)
    return kept.select(dealt.alias("token"), "sid", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))


def _alike(x: str, y: str):
    """Whether the sets x.tokens and y.tokens match."""
    return 7 * F.size(F.array_intersect(f"{x}.tokens", f"{y}.tokens")) >= 3 * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _matched_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(sid, l_sid) -> sid of those whose sets match. A set is fetched once for each pair, not for each n-gram of it."""
    pairs = pairs.distinct()
    x = sets.select("sid", F.size("tokens").alias("n"), "tokens")
    y = x.select(F.col("sid").alias("l_sid"), "n", "tokens")
    full = pairs.join(x, "sid").select("sid", "l_sid", F.struct("n", "tokens").alias("x")).join(y, "l_sid").select("sid", "x", F.struct("n", "tokens").alias("y"))
    return full.filter(_alike("x", "y")).select("sid")


def _earlier(x: str, y: str):
    """Whether y is another set than x, of an earlier line, and may match by sizes and what is left."""
    return (F.col(f"{x}.sid") != F.col(f"{y}.sid")) & (F.col(f"{y}.place") < F.col(f"{x}.place")) & possible(f"{x}.", f"{y}.")


def _short_matches(posts: DataFrame, sets: DataFrame) -> DataFrame:
    """sid of the sets of at most LONG n-grams that an earlier one matches: a semi join that carries the sets and stops at the first match.

    Both sides need the same columns and the same rows, so that one shuffle serves both: a condition on one side alone would
    be pushed below its shuffle and make it another one. So sets of up to `most` n-grams are asked here too; what matches does."""
    most = LONG * 4 // 3 + 1  # what a set of LONG n-grams may match
    sets = sets.filter(F.size("tokens") <= most).withColumnRenamed("sid", "of_sid")
    full = posts.filter(F.col("n") <= most).join(sets, F.col("sid") == F.col("of_sid")).select("token", "sid", "n", "left", "rest", "place", "tokens")
    x, y = full.alias("x"), full.alias("y")
    return x.join(y, (F.col("x.token") == F.col("y.token")) & _earlier("x", "y") & _alike("x", "y"), "left_semi").select("sid")


def _long_matches(posts: DataFrame, sets: DataFrame, folder: str) -> DataFrame | None:
    """sid of the sets of more than LONG n-grams that an earlier one matches; None if there are no such sets.

    The sets of all prefix n-grams of a line would grow with the square of its length, so pairs of numbers are compared: each
    set with the earliest of like size in each of its n-grams first, which settles nearly all of a crowd of copies, then what
    is left with all earlier ones of its n-grams."""
    sets = sets.filter(4 * F.size("tokens") >= 3 * LONG)  # what a set of more than LONG n-grams may match, and these
    posts = stored(posts.filter(4 * F.col("n") >= 3 * LONG).join(sets.select("sid", "place"), "sid"), folder, "long")
    asked = posts.filter(F.col("n") > LONG)
    if asked.isEmpty():
        return None
    size = F.floor(F.log2("n"))
    first = posts.groupBy(F.col("token").alias("l_token"), size.alias("l_size")).agg(F.min(F.struct("place", "sid", "n", "left", "rest")).alias("f"))
    first = first.select("l_token", "l_size", *[F.col(f"f.{c}").alias(f"l_{c}") for c in ("sid", "n", "left", "rest")])
    near = asked.join(first, (F.col("token") == F.col("l_token")) & (size == F.col("l_size")) & (F.col("sid") != F.col("l_sid")) & possible())
    settled = stored(_matched_pairs(near.select("sid", "l_sid"), sets).distinct(), folder, "settled", True)
    x, y = asked.join(settled, "sid", "left_anti").alias("x"), posts.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & _earlier("x", "y")).select(F.col("x.sid").alias("sid"), F.col("y.sid").alias("l_sid"))
    return settled.unionByName(_matched_pairs(pairs, sets)).distinct()


def _with_earlier_match(posts: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """posts(token, sid, n, left, rest), sets(sid, place, tokens) -> sid of the sets that an earlier one matches."""
    long = _long_matches(posts, sets, folder)
    if long is not None:  # done and let go before the short ones, so that their shuffles don't live together
        long = stored(long, folder, "long_matched", True)
        released(posts.sparkSession)
    short = _short_matches(posts, sets)
    return (short if long is None else short.unionByName(long)).distinct()


def later_lines(docs: DataFrame, folder: str) -> DataFrame:
    """docs(doc_id, text) -> in_rid, gone: the numbers of the lines of each text that repeat an earlier line."""
    spark = docs.sparkSession
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "pos")
    tokens = _tokens(_lines(docs)).withColumns({"sid": F.xxhash64("tokens"), "row": F.monotonically_increasing_id()})
    tokens = stored(tokens, folder, "tokens", dictionary=False, compression="uncompressed")
    size = F.size("tokens")
    prefix = F.slice(_keys(_levels(tokens)), F.lit(1), (size - F.ceil(size * 3 / F.lit(4)) + 1).cast("int"))
    x = stored(tokens.select("rid", "doc_id", "pos", "sid", "row"), folder, "lines", dictionary=False)
    many = x.groupBy("sid").agg(F.count("*").alias("many"), F.min(F.struct(place.alias("place"), "row")).alias("first")).filter("many > 1")
    many = stored(many.select("sid", F.col("first.place.rid").alias("first_rid"), F.col("first.place.pos").alias("first_pos"), F.col("first.row").alias("first_row")), folder, "many")
    copies = small(many.select("sid", "first_row"), 24)
    entries = tokens.join(copies, "sid", "left").filter(F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)))
    entries = stored(entries.select("sid", size.alias("n"), prefix.alias("prefix")), folder, "entries", dictionary=False, compression="uncompressed")
    forget(spark, f"{folder}/tokens")  # whole sets go before prefixes are shuffled
    released(spark)
    posts = stored(_with_company(entries.select("sid", "n", F.posexplode("prefix").alias("pos", "token"))), folder, "company")
    forget(spark, f"{folder}/entries")
    released(spark)
    posts = stored(with_partners(posts), folder, "posts")
    forget(spark, f"{folder}/company")
    wanted = x.join(posts.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min(place).alias("place"))
    wanted = stored(wanted.select(F.col("place.rid").alias("want_rid"), F.col("place.pos").alias("want_pos")), folder, "wanted")
    some = _tokens(_lines(docs, small(wanted.select("want_rid", "want_pos"), 24))).withColumn("sid", F.xxhash64("tokens"))
    sets = stored(some.select("sid", place.alias("place"), "tokens").dropDuplicates(["sid"]), folder, "sets", dictionary=False)
    released(spark)
    matched = stored(_with_earlier_match(posts, sets, folder), folder, "matched").withColumn("matched", F.lit(True))
    marks = small(stored(many.drop("first_row").join(matched, "sid", "full_outer"), folder, "marks"), 40)
    other = (F.col("rid") != F.col("first_rid")) | (F.col("pos") != F.col("first_pos"))
    gone = x.select("rid", "pos", "sid").join(marks, "sid").filter(F.coalesce("matched", other))
    gone = stored(gone.groupBy(F.col("rid").alias("in_rid")).agg(F.collect_set("pos").alias("gone")), folder, "gone")
    for name in ("lines", "posts", "wanted", "sets", "marks", "matched", "many", "long", "settled", "long_matched"):
        forget(spark, f"{folder}/{name}")
    return gone


def dedup_lines(docs: DataFrame, total: str = "_ln_all", removed: str = "_ln_gone") -> DataFrame:
    """docs(doc_id, text, ...) -> the same with the text that is left, and two new columns: numbers of lines, in all and removed."""
    folder = work_folder(docs.sparkSession)
    gone = later_lines(docs.select("doc_id", F.col("text").cast("string").alias("text")), folder)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("rid"), F.split("text", "\n", -1).alias("lines"))
    d = d.join(small(gone, 32 + 8 * F.size("gone")), F.col("rid") == F.col("in_rid"), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)
    counts = [F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("gone"), F.lit(0))]
    counts = [F.greatest(c, F.lit(0)).cast("long").alias(name) for c, name in zip(counts, (total, removed), strict=True)]
    kept = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in (total, removed)]
    return d.select(*kept, *counts)


def op4(spark, sf_dir):
    from tessera.llm.common import table

    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("_ln_all").alias("n_lines"), F.col("_ln_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
w AS (SELECT doc_id, pos, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM l),
t AS (SELECT doc_id, pos, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS grams FROM w WHERE len(w) > 0),
s AS (SELECT grams, array_to_string(grams, '|') AS sid, len(grams) AS n, min((doc_id, pos)) AS first FROM t GROUP BY grams),
g AS (SELECT sid, n, unnest(grams) AS gram FROM s),
p AS (SELECT a.sid AS a, b.sid AS b FROM g a JOIN g b ON a.gram = b.gram AND a.sid <> b.sid GROUP BY a.sid, b.sid, a.n, b.n HAVING 7 * count(*) >= 3 * (a.n + b.n)),
c AS (SELECT s.sid, s.first, coalesce(bool_or(o.first < s.first), false) AS matched FROM s LEFT JOIN p ON p.a = s.sid LEFT JOIN s o ON o.sid = p.b GROUP BY s.sid, s.first),
x AS (SELECT t.doc_id, t.pos FROM t JOIN c ON c.sid = array_to_string(t.grams, '|') WHERE c.matched OR (t.doc_id, t.pos) > c.first),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL), '') AS kept
      FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.pos = l.pos GROUP BY l.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
