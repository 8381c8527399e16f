"""Operator 8: line-first cleaning, with DataFrame functions only.

Every line with a word is tested by three rules, any of which removes it:
  punctuation   the share of the symbols # * $ % & | < > ! among its characters other than white space is above 8 %, or
                it has no letter
  navigation    at least two words that are a bare separator (|, >, », ·, /); or links, which are a third of its words or
                more; or at most MENU words and no mark at its end that closes a sentence
  boilerplate   it holds a phrase of BOILERPLATE; or it is a common line: one that stands between COMMON or more different
                pairs of neighbouring lines in all documents. Copies of a text have the same neighbours and count once
A document is rejected if the base rules reject it, or if the removed lines hold more than half of its word characters.

Common lines come from a count over all lines of all documents, by hashes: lines and their neighbours are counted where
they are and shuffled as 16 bytes each, once for each distinct pair in a task. Their numbers come back to the documents
that hold them; nothing else is shuffled, and no text.

Defined results: a null or blank text has no words, so base_failed is true and kept is false; an empty table gives an
empty result; one row comes out for each row in, repeated ids and rows too; neighbours of a first or last line are blank;
blank lines are no neighbours; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, stored, words_of, work_folder

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 8
MAX_LOST_PERCENT = 50
LINE_SYMBOLS = "#*$%&|<>!"
MENU, COMMON = 3, 20
#: The marks that close a sentence, or stand behind one that does.
CLOSING = r"[.!?:;…\"')\]»”’。！？][\x20\x09-\x0D]*$"
SEPARATORS = ("|", ">", "»", "·", "/")
#: Phrases that mark a line as boilerplate.
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "cookie policy", "click here", "subscribe to our newsletter", "enable javascript", "lorem ipsum")


def line_fails(line):
    """The verdict on a line, from the line alone."""
    dense = F.regexp_replace(line, r"[\x20\x09-\x0D]", "")
    n_sym = F.length(dense) - F.length(F.translate(dense, LINE_SYMBOLS, ""))
    punctuation = (n_sym * 100 > F.length(dense) * MAX_SYMBOL_PERCENT) | ~line.rlike(r"\p{L}")
    items = F.split(line, " ")
    bars = F.size(F.filter(items, lambda w: w.isin(*SEPARATORS)))
    words, links = F.size(F.array_remove(items, "")), F.size(F.filter(items, lambda w: w.contains("://") | w.startswith("www.")))
    navigation = (bars >= 2) | ((links > 0) & (links * 3 >= words)) | ((words <= MENU) & ~line.rlike(CLOSING))
    low = F.lower(line)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | low.contains(phrase)
    return punctuation | navigation | boiler


def _lines(text: str):
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def common_lines(docs: DataFrame) -> DataFrame:
    """docs(text) -> line_hash of the lines that stand between COMMON or more different pairs of neighbours."""
    h = docs.select(F.transform(_lines("text"), lambda x: F.xxhash64(x)).alias("h")).filter(F.size("h") > 0)
    around = F.transform("h", lambda x, i: F.struct(x.alias("line"), F.xxhash64(F.coalesce(F.when(i > 0, F.get("h", i - 1)), F.lit(0).cast("long")), F.coalesce(F.get("h", i + 1), F.lit(0).cast("long"))).alias("around")))
    pairs = h.select(F.explode(around).alias("x")).select("x.line", "x.around").distinct()
    return pairs.groupBy(F.col("line").alias("line_hash")).agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).select("line_hash")


def _with_common(docs: DataFrame, folder: str) -> DataFrame:
    """docs(doc_id, text) with common: the hashes of those of its lines that are common ones; null without any."""
    common = small(stored(common_lines(docs), folder, "common", True), 8)
    own = docs.select(F.xxhash64("text").alias("of"), F.explode(F.array_distinct(F.transform(_lines("text"), lambda x: F.xxhash64(x)))).alias("line_hash"))
    held = own.join(common, "line_hash").distinct().groupBy("of").agg(F.collect_list("line_hash").alias("common"))
    held = small(stored(held, folder, "held", True), 16 + 8 * F.size("common"))
    return docs.join(held, F.xxhash64("text") == F.col("of"), "left").drop("of")


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, cleaned.

    cleaned: the text without the lines that failed."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = _with_common(d, work_folder(docs.sparkSession))
    d = d.withColumn("words", words_of(F.col("text"))).withColumn("lines", _lines("text"))
    is_common = lambda x: F.coalesce(F.array_contains("common", F.xxhash64(x)), F.lit(False))
    fails = lambda x: F.when(F.col("common").isNull(), line_fails(x)).otherwise(is_common(x) | line_fails(x))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("bare", F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))
    n = F.size("words")
    grams = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.slice(F.transform("hashes", lambda h, i: F.xxhash64(h, F.get("hashes", i + 1), F.get("hashes", i + 2))), F.lit(1), n - 2)
    )
    d = d.withColumn("grams", grams).withColumn("bad", F.filter("lines", fails))
    d = d.withColumn("several", F.size(F.array_distinct("grams")) < F.size("grams"))
    pairs = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    d = d.withColumn("sorted", F.when(F.col("several"), pairs))
    same = lambda x, i, step: F.coalesce(F.get("sorted", i + step)["g"] == x["g"], F.lit(False))
    hits = F.filter("sorted", lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1)))
    d = d.withColumn("hits", hits)
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    d = d.withColumn("n_words", n.cast("long")).withColumn("n_repeat_words", F.when(F.col("several"), covered).otherwise(F.lit(0)).cast("long"))
    d = d.withColumn("lost_chars", F.coalesce(F.aggregate("bad", F.lit(0), lambda a, x: a + F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", ""))), F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    d = d.withColumn("word_chars", F.length("bare").cast("long"))
    n_symbols = F.length("bare") - F.length(F.translate("bare", "#*$%&|<>", ""))
    return d.select(
        "doc_id", "n_words", "word_chars", n_symbols.cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "base_failed", "lost_chars", (~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT)).alias("kept"),
        F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~fails(x)), "\n").alias("cleaned"),
    )


def op8(spark, sf_dir):
    from tessera.llm.common import table

    return clean_lines(table(spark, sf_dir, "documents")).drop("cleaned", "lost_chars")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, unnest([0, 1, 2]) AS u(k) GROUP BY r),
l AS (SELECT r, line, coalesce(lines[i - 1], '') AS before, coalesce(lines[i + 1], '') AS behind FROM (SELECT r, lines, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM w)),
c AS (SELECT line FROM (SELECT DISTINCT line, before, behind FROM l) GROUP BY line HAVING count(*) >= 20),
b AS (SELECT r, line, line IN (SELECT line FROM c) AS common, regexp_replace(line, '[\x20\x09-\x0D]', '', 'g') AS dense, lower(line) AS low, string_split(line, ' ') AS items FROM l),
n AS (SELECT *, len(list_filter(items, lambda x: x <> '')) AS words, len(list_filter(items, lambda x: contains(x, '://') OR starts_with(x, 'www.'))) AS links FROM b),
lost AS (SELECT r, sum(length(dense)) AS lost_chars FROM n
         WHERE common OR len(regexp_extract_all(dense, '[#*$%&|<>!]')) * 100 > length(dense) * 8 OR NOT regexp_matches(line, '\pL')
            OR len(list_filter(items, lambda x: x IN ('|', '>', '»', '·', '/'))) >= 2 OR (links > 0 AND links * 3 >= words)
            OR (words <= 3 AND NOT regexp_matches(line, '[.!?:;…"'')\]»”’。！？][\x20\x09-\x0D]*$'))
            OR low LIKE '%all rights reserved%' OR low LIKE '%privacy policy%' OR low LIKE '%terms of use%' OR low LIKE '%cookie policy%'
            OR low LIKE '%click here%' OR low LIKE '%subscribe to our newsletter%' OR low LIKE '%enable javascript%' OR low LIKE '%lorem ipsum%'
         GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
      FROM w LEFT JOIN cov USING (r) LEFT JOIN lost USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars * 100 <= word_chars * 50 AS kept FROM f
"""
