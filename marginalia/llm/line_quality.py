"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each row is measured by itself first; ``base_failed`` follows from that. The
verdict then looks across documents: lines are normalised (ASCII lower case,
digits to 0, white space squeezed) and hashed, the distinct documents that hold a
line are counted for every host (``source``), and a line in more of them than
``max_documents`` is removed from all but the host's smallest doc_id that has
it. A document left with less than ``min_left`` hundredths of the words of its
lines is rejected; ``remove_lines`` and ``keep_good`` give the others back without
the removed lines. Rows of one doc_id are one document in these counts.
Null text counts as empty (no words: it fails the base rules); null hosts are one
host; repeated rows get the same verdict; ties are by doc_id, null ids first. An
empty table gives an empty table. A very long text is measured whole, in one task.
Columns beside doc_id, text and source are carried in a struct, so they may have any
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.shared import NULL_ID

WORD_BREAK = r"[\x20\x09-\x0D]+"
BREAKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A host's line in more distinct documents than this is boilerplate.
MAX_DOCUMENTS = 20
#: Percent of its words that a document must keep.
MIN_LEFT = 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), has_word)


def normal_line(line: Column) -> Column:
    return F.translate(F.btrim(F.regexp_replace(line, WORD_BREAK, " ")), UPPER + "0123456789", LOWER + "0" * 10)


def base_measures(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows with a non-null ``text``."""
    text = F.col("text")
    step = docs.withColumn("_words", words_of(text)).withColumn("_lines", lines_of(text))
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    step = step.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    # only texts that repeat a window need to know where
    step = step.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    around = lambda i, by: F.get(F.col("_sorted"), i + by)["h"]
    twice = F.filter("_sorted", lambda s, i: F.coalesce(around(i, -1) == s["h"], F.lit(False)) | F.coalesce(around(i, 1) == s["h"], F.lit(False)))
    step = step.withColumn("_at", F.sort_array(F.transform(twice, lambda s: s["i"])))
    spans = F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(WINDOW))))
    return step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(text, BREAKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(spans, F.lit(0), lambda a, b: a + b).cast("long"),
        }
    ).drop("_words", "_lines", "_hashes", "_windows", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def marked_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(doc_id, host, digest, at, n, gone) of every line with a word; needs (doc_id, host, digest, text). ``at`` counts all lines of the text."""
    lines = docs.select("doc_id", "host", "digest", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(has_word(F.col("line")))
    lines = lines.select("doc_id", "host", "digest", "at", F.xxhash64(normal_line(F.col("line"))).alias("line"), F.size(words_of(F.col("line"))).alias("n"))
    seen = lines.select("host", "line", "doc_id").distinct()
    common = seen.groupBy("host", "line").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first")).where(F.col("documents") > max_documents)
    marked = lines.join(common.select("host", "line", F.col("first"), F.lit(True).alias("common")), ["host", "line"], "left")
    return marked.withColumn("gone", F.coalesce(F.col("common") & ~F.col("doc_id").eqNullSafe(F.col("first")), F.lit(False))).drop("line", "first", "common")


def is_depleted(min_left: int) -> Column:
    return F.sum(F.when(F.col("gone"), 0).otherwise(F.col("n"))) * 100 < F.sum("n") * min_left


def depleted(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT) -> DataFrame:
    """(doc_id, host, digest) of documents whose lines are mostly removed; needs (doc_id, host, digest, text)."""
    some = marked_lines(docs, max_documents).groupBy("doc_id", "host", "digest").agg(is_depleted(min_left).alias("bad"))
    return some.where("bad").drop("bad")


def judge(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row of ``docs`` (doc_id, text, source)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))
    rows = rows.withColumn("digest", F.xxhash64("text"))
    measured = base_measures(rows).drop("text")
    key = lambda c: F.coalesce(F.col(c), F.lit(NULL_ID))
    bad = depleted(rows.withColumn("doc_id", key("doc_id")), max_documents, min_left).withColumn("depleted", F.lit(True)).withColumnRenamed("doc_id", "_id")
    out = measured.withColumn("_id", key("doc_id")).join(bad, ["_id", "host", "digest"], "left")
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("depleted").isNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "digest")


def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))
    return rows.withColumn("digest", F.xxhash64("text"))


def verdicts(rows: DataFrame, max_documents: int, min_left: int) -> DataFrame:
    """(doc_id, host, digest, bad, gone) of documents that lose lines; ``gone`` counts lines from 0."""
    gone = F.collect_set(F.when(F.col("gone"), F.col("at"))).alias("gone")
    some = marked_lines(rows, max_documents).groupBy("doc_id", "host", "digest").agg(is_depleted(min_left).alias("bad"), gone)
    return some.where(F.size("gone") > 0)


def without(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that are not bad, with all their columns; what ``text`` keeps is in order."""
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("gone", i)), "\n")
    joined = rows.join(found, ["doc_id", "host", "digest"], "left").where(~F.coalesce("bad", F.lit(False)))
    cut = F.when(F.size("gone") > 0, kept).otherwise(F.col("_row")["text"])
    return joined.select(*[cut.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns])


def remove_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT) -> DataFrame:
    """``docs`` without the lines above the limit and without the documents that they leave depleted."""
    rows = keyed(docs)
    return without(rows, verdicts(rows.drop("_row"), max_documents, min_left), docs.columns)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict is ``kept``, with all their columns and without the lines above the limit."""
    rows = keyed(docs)
    # an aggregate, which no filter passes: a filter below would compute the measures over and over
    failed = base_measures(rows.drop("_row")).groupBy("doc_id", "host", "digest").agg(F.max(base_failed()).alias("bad")).where("bad")
    both = failed.withColumn("gone", F.array().cast("array<int>")).unionByName(verdicts(rows.drop("_row"), MAX_DOCUMENTS, MIN_LEFT))
    found = both.groupBy("doc_id", "host", "digest").agg(F.max("bad").alias("bad"), F.flatten(F.collect_list("gone")).alias("gone"))
    return without(rows, found, docs.columns)


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host", "digest")


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
                length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
         FROM w LEFT JOIN rep USING (doc_id)),
ln AS (SELECT doc_id, host, translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '{UPPER}0123456789', '{LOWER}0000000000') AS line,
              len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
       FROM (SELECT doc_id, host, unnest(lines) AS line FROM w)),
common AS (SELECT host, line, min(doc_id) AS first FROM ln GROUP BY host, line HAVING count(DISTINCT doc_id) > {MAX_DOCUMENTS}),
bad AS (SELECT doc_id FROM ln LEFT JOIN common USING (host, line) GROUP BY doc_id
        HAVING 100 * sum(CASE WHEN first IS NOT NULL AND first <> doc_id THEN 0 ELSE n END) < {MIN_LEFT} * sum(n))
SELECT b.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND b.doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM base b
"""
