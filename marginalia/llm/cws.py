"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words with their counts as weights. For each of the
``GROUPS * PER_GROUP`` samples every weighted term draws r and c from
Gamma(2, 1) and beta from [0, 1), all fixed by the term and the sample:
``t = floor(ln w / r + beta)`` and ``ln a = ln c - r * (t - beta + 1)``. The term
with the smallest ``a`` is the sample. As ``a`` is a continuous function of the
term and ``t``, two documents have the same smallest ``a`` exactly if they drew
the same term and ``t``, so the sample is kept as a hash of ``a``; samples of two
documents agree with a probability equal to the generalised Jaccard similarity
sum(min) / sum(max) of their weights.

Null and empty texts, and those without a word, have the empty fingerprint; two
such are alike (1), one of them and another text are not (0). The next document
is the next row by (doc_id, text digest), null ids first; after the last comes
the first. Repeated rows follow each other. An empty table gives an empty table. A
text of any length is one group of terms. Columns beside doc_id and text may have any
name. With 32 samples a likeness s has a standard error of sqrt(s (1 - s) / 32), 0.09
at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import NULL_ID

GROUPS, PER_GROUP = 8, 4
#: Text of a run of consecutive ids, and runs at most: their first ids are a literal in the plan.
RUN_BYTES, MAX_RUNS = 1 << 25, 1 << 16
BREAKS = "\x09\x0a\x0b\x0c\x0d"


def words_of(text: Column) -> Column:
    """Words split at single spaces; empty strings among them stand for further white space."""
    return F.split(F.translate(text, BREAKS, " " * len(BREAKS)), " ", -1)


def unit(bits: Column, width: int) -> Column:
    """A number inside (0, 1) from so many bits."""
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-width)


def log_a(term: Column, group: Column, j: int, log_weights: list[Column]) -> list[Column]:
    """ln a of a term in sample j of a group, for each of the weights."""
    h, k = F.xxhash64(term, group, F.lit(j)), F.xxhash64(term, group, F.lit(j + 1000))
    low = F.lit((1 << 21) - 1)
    r = -F.ln(unit(F.shiftrightunsigned(h, 43), 21) * unit(F.shiftrightunsigned(h, 22).bitwiseAND(low), 21))
    log_c = F.ln(-F.ln(unit(h.bitwiseAND(low), 21) * unit(F.shiftrightunsigned(k, 32), 32)))
    beta = unit(k.bitwiseAND(F.lit((1 << 32) - 1)), 32)
    return [log_c - r * (F.floor(w / r + beta).cast("double") - beta + 1) for w in log_weights]


def samples(terms: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """An array of samples, named as the weight, for each of several weightings of (keys, term, weights...)."""
    spread = terms.withColumn("_group", F.explode(F.lit(list(range(GROUPS)))))
    logs = {w: F.ln(F.col(w).cast("double")) for w in weights}
    least = []
    for j in range(PER_GROUP):
        for w, a in zip(weights, log_a(F.col("term"), F.col("_group"), j, [logs[w] for w in weights]), strict=True):
            least.append(F.min(F.when(F.col(w) > 0, a)).alias(f"_{w}_{j}"))
    grouped = spread.groupBy(*keys, "_group").agg(*least)
    parts = [F.sort_array(F.collect_list(F.struct("_group", F.array(*[f"_{w}_{j}" for j in range(PER_GROUP)]).alias("a")))).alias(w) for w in weights]
    code = lambda x: F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))
    flat = lambda w: F.transform(F.flatten(F.transform(w, lambda s: s["a"])), code)
    whole = lambda w: F.when(F.element_at(w, 1)["a"][0].isNotNull(), flat(w)).alias(w)
    return grouped.groupBy(*keys).agg(*parts).select(*keys, *map(whole, weights))


def printed(code: str) -> Column:
    """A fingerprint as hexadecimal text; empty without terms."""
    return F.coalesce(F.array_join(F.transform(code, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """The share of samples that agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(GROUPS * PER_GROUP))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(same)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fingerprint) of every distinct row of ``docs`` (doc_id, text); clashing columns are ignored."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("digest", F.xxhash64("_text"))
    words = rows.select("doc_id", "digest", F.explode(words_of(F.col("_text"))).alias("word")).where("word <> ''")
    terms = words.select("doc_id", "digest", F.xxhash64("word").alias("term")).groupBy("doc_id", "digest", "term").agg(F.count("*").alias("weight"))
    found = samples(terms, ["doc_id", "digest"], ["weight"])
    keys = rows.select("doc_id", "digest").distinct()
    joined = keys.join(found.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("doc_id", "digest", printed("weight").alias("fingerprint"))


def runs_by_id(docs: DataFrame) -> DataFrame:
    """Deal rows (doc_id, text) into runs of consecutive ids: adds run, guest and at.

    The rows with the first id of a run also stand, as guests, at the end of the
    run before it, so that every row's successor is in its own run."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = min(max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RUN_BYTES)), MAX_RUNS)
    cuts = docs.select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id")).collect()
    firsts = sorted(r[1] for r in cuts) or [0]  # at most n ids
    table = F.lit(firsts)
    steps = [1 << k for k in range(len(firsts).bit_length() - 1, -1, -1)]
    ahead = lambda at, step: F.when(at + step <= len(firsts), F.get(table, at + step - 1) <= F.col("doc_id")).otherwise(False)
    # binary search: the number of first ids up to this one
    run = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at)) - 1
    placed = docs.withColumn("run", F.greatest(run, F.lit(0)))
    before = F.when(F.col("run") == 0, len(firsts) - 1).otherwise(F.col("run") - 1)
    own = F.struct(F.col("run"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("run"), F.lit(True).alias("guest"))
    opens = F.get(table, F.col("run")) == F.col("doc_id")
    return placed.withColumn("_place", F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own)))).withColumns({"run": F.col("_place.run"), "guest": F.col("_place.guest")}).drop("_place")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row and of its text with the last quarter replaced by the next document's beginning."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = runs_by_id(docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), text.alias("text")))
    order = Window.partitionBy("run").orderBy("guest", "doc_id", F.xxhash64("text"))
    rows = rows.withColumns({"at": F.row_number().over(order), "following": F.coalesce(F.lead("text").over(order), F.lit(""))})
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    head = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("cut"))
    rows = rows.withColumns({"head": head, "tail": F.when(F.col("cut") > 0, F.substring(F.col("text"), -F.col("cut"), F.col("cut"))).otherwise(""), "new_tail": F.substring(F.col("following"), F.lit(1), F.col("cut"))})
    about = rows.select("run", "at", "guest", "doc_id", "n_chars", F.sha2(F.concat("head", "new_tail"), 256).alias("edited_sha256"))
    # words of the head but its last are common to both texts; that one may go on in either tail
    rows = rows.select("run", "at", words_of(F.col("head")).alias("shared"), "tail", "new_tail")
    last = F.element_at("shared", -1)
    rows = rows.select("run", "at", F.slice("shared", F.lit(1), F.size("shared") - 1).alias("shared"), words_of(F.concat(last, F.col("tail"))).alias("old"), words_of(F.concat(last, F.col("new_tail"))).alias("new"))
    words = rows.select("run", "at", F.size("shared").alias("n"), (F.size("shared") + F.size("old")).alias("m"), F.posexplode(F.concat("shared", "old", "new")).alias("pos", "word")).where("word <> ''")
    terms = words.select("run", "at", F.xxhash64("word").alias("term"), (F.col("pos") < F.col("m")).cast("int").alias("a"), ((F.col("pos") < F.col("n")) | (F.col("pos") >= F.col("m"))).cast("int").alias("b"))
    terms = terms.groupBy("run", "at", "term").agg(F.sum("a").alias("code"), F.sum("b").alias("edited"))
    found = about.join(samples(terms, ["run", "at"], ["code", "edited"]), ["run", "at"], "left")
    found = found.withColumn("next", F.lead("code").over(Window.partitionBy("run").orderBy("at"))).where("not guest")
    return found.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        printed("code").alias("fingerprint"),
        printed("edited").alias("edited_fingerprint"),
        likeness("code", "edited").alias("near_edited"),
        likeness("code", "next").alias("near_next"),
    )


def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
