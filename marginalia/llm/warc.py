"""WARC archives: written from pages, read back with boundaries verified by their chain.

Writing: a record is a line of Spark's text writer, ended by two line breaks, so
archives are splittable files under Spark's commit protocol. Of records with equal
payloads that are long enough only one holds the payload; the others are revisits.

Reading: the text reader splits files where a line break and the magic follow one
another, also inside payloads, so every task finds candidates in its own split. Their
offsets come from the lengths of the pieces: running sums within a split, and of splits
within a file. A candidate whose header parses gives an offset and that of its
successor. Runs of adjacent records of a split are one node; pointer jumping over these
nodes from the start of each file keeps what can be reached, and so rejects records
that are only quoted in a payload. A payload cut by the magic is put together from its
pieces. Archives compressed as a whole or by members are read likewise, each as one split.

A null html is an empty payload, a null url leaves its field out. A null page_id is
written as an empty id and comes back as null; beside records that have an id it is never the
one referred to. Rows that repeat a page with the largest id each hold their
payload. Further columns are not written. An empty table gives no records. What
follows a damaged record in its file can't be reached; ``chain_report`` shows it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import dropped, settled, shared_folder

MAGIC, BREAK = "WARC/1.", "\r\n"
#: Pieces of a file lie between these bytes.
BOUNDARY = BREAK + MAGIC
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Groups of equal payloads up to which their table (some 100 bytes each) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: Pieces of cut payloads (some 150 bytes each) up to which their list is broadcast, so that only what they hold is moved.
BROADCAST_PIECES = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def field(name: str, value: Column | str) -> Column:
    """A header line, or nothing where the value is null."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def with_verdict(pages: DataFrame, least: int) -> DataFrame:
    """(id, url, payload, size, digest, first): ``first`` is the page that a revisit refers to."""
    url = F.regexp_replace(pages["url"].cast("string"), r"[\x00-\x20\x7F]", "%20") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(pages["page_id"].cast("long").alias("id"), url.alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("most"), F.count("*").alias("n"))
    groups = settled(groups.where("n > 1 and most is not null").drop("n"))
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    joined = rows.join(groups, ["digest", "size"], "left")
    return joined.withColumn("first", F.when(F.col("id").isNull() | (F.col("id") < F.col("most")), F.col("most"))).drop("most")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = DATE) -> None:
    """One record for each row of pages (page_id, url, html), a file for each task."""
    rows = with_verdict(pages, least)
    again = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"), field("Content-Length", F.col("size").cast("string")), F.lit(BREAK))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        F.lit(f"{MAGIC}0{BREAK}"),
        field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", page_urn(F.col("id"))),
        field("WARC-Date", date),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.when(again, F.lit(PROFILE))),
        field("WARC-Refers-To", F.when(again, page_urn(F.col("first")))),
        field("Content-Type", "application/http;msgtype=response"),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit(BREAK),
        F.col("block"),
    )
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", BREAK * 2).text(folder)


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(file, split, seq, value): what lies between boundaries; seq grows within a split."""
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    return spark.read.option("lineSep", BOUNDARY).text(folder).select(*where, F.monotonically_increasing_id().alias("seq"), "value")


def header(head: Column, name: str) -> Column:
    """A field's value, or null."""
    found = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def digits(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9]{1,18}$"), value.cast("long"))


def payload_of(block: Column, content_type: Column) -> tuple[Column, Column]:
    """HTTP head and payload of a record's block; without HTTP the block is the payload."""
    text = block.cast("string")
    head = F.when(content_type.startswith("application/http"), F.substring_index(text, BREAK * 2, 1))
    return head, F.when(head.isNull(), block).otherwise(F.substr(block, F.octet_length(head) + 5))


def digested(df: DataFrame, block: Column) -> DataFrame:
    """Add payload_bytes and payload_digest: of the payload itself, or as a revisit's header has them."""
    http, payload = payload_of(block, F.col("content_type"))
    again = F.col("record_type") == "revisit"
    stated = F.lower(F.regexp_extract(F.coalesce("stated_digest", F.lit("")), r"(?i)^sha1:(\w+)$", 1))
    size = F.when(again, digits(header(http, "Content-Length"))).otherwise(F.length(payload).cast("long"))
    return df.withColumn("payload_bytes", size).withColumn("payload_digest", F.when(again, stated).otherwise(F.sha1(payload)))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece with its offset; where its header parses, with the offset of the successor and what the record says of itself.

    Payloads don't leave the scan: those that are whole in their piece are digested there."""
    value = F.col("value")
    raw = pieces(spark, folder)
    quoted = value.startswith(MAGIC)
    head = F.substring_index(value, BREAK * 2, 1)
    # of a piece that begins with the magic, as the first of a file does, the magic is part of the piece
    raw = raw.withColumn("head", head).withColumn("before", F.when(quoted, F.lit(0)).otherwise(F.lit(len(MAGIC))))
    ended = F.octet_length("head") < F.octet_length("value")
    parses = ended & F.col("head").rlike(r"^(WARC/1\.)?[0-9]\r\n")
    length = F.when(parses, digits(header(F.col("head"), "Content-Length")))
    raw = raw.withColumn("length", length).withColumn("begin", F.octet_length("head") + 4)
    raw = raw.withColumn("record_type", F.when(F.col("length").isNotNull(), F.lower(header(F.col("head"), "WARC-Type"))))
    for name, known in (("content_type", "Content-Type"), ("record_id", "WARC-Record-ID"), ("target_uri", "WARC-Target-URI"), ("refers", "WARC-Refers-To"), ("stated_digest", "WARC-Payload-Digest")):
        raw = raw.withColumn(name, F.when(F.col("record_type").isNotNull(), header(F.col("head"), known)))
    whole = F.octet_length("value") - F.col("begin") >= F.col("length")
    block = F.when(whole, F.substr(value.cast("binary"), F.col("begin") + 1, F.col("length").cast("int")))
    found = digested(raw.withColumn("whole", whole), block).withColumn("size", F.octet_length("value").cast("long") + len(BOUNDARY)).drop("value", "head")
    # settled: offsets, runs and records are all made from these few columns
    found = settled(found)
    splits = found.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(splits, ["file", "split"])
    placed = placed.withColumn("offset", F.col("base") + F.col("at") - F.col("before")).drop("base", "at")
    after = F.col("offset") + F.col("before") + F.col("begin") + F.col("length") + 2 * len(BREAK)
    return placed.withColumn("next", F.when(F.col("record_type").isNotNull(), after))


def reachable(found: DataFrame) -> DataFrame:
    """(file, offset) of the records of ``candidates`` that the chain from the start of their file meets."""
    links = found.where("next is not null").select("file", "split", "offset", "next")
    order = Window.partitionBy("file", "split").orderBy("offset")
    links = links.withColumn("straight", F.coalesce(F.lead("offset").over(order) == F.col("next"), F.lit(False)))
    entered = links.where("not straight").select("file", F.col("next").alias("offset"), F.lit(True).alias("entered")).distinct()
    links = links.join(entered, ["file", "offset"], "left")
    head = F.col("entered").isNotNull() | ~F.lag("straight", 1, False).over(order)
    links = links.withColumn("head", head).withColumn("node", F.max(F.when(F.col("head"), F.col("offset"))).over(order))
    links = settled(links.select("file", "offset", "node", "next"))
    # a run is entered at its head alone, so that where its last record leads is a node, or no candidate at all
    nodes = links.groupBy("file", "node").agg(F.max_by("next", "offset").alias("to")).withColumn("met", F.col("node") == 0)
    nodes = settled(nodes)
    while not nodes.where("to is not null").isEmpty():
        met = nodes.where("met and to is not null").select("file", F.col("to").alias("node"), F.lit(True).alias("now")).distinct()
        jump = nodes.select("file", F.col("node").alias("to"), F.col("to").alias("then"))
        step = nodes.join(met, ["file", "node"], "left").join(jump, ["file", "to"], "left")
        last, nodes = nodes, settled(step.select("file", "node", F.col("then").alias("to"), (F.col("met") | F.coalesce("now", F.lit(False))).alias("met")))
        dropped(last)
    return links.join(nodes.where("met").select("file", "node"), ["file", "node"], "left_semi").select("file", "offset")


def blocks(spark: SparkSession, folder: str, owned: DataFrame) -> DataFrame:
    """(file, offset, block) put together from the pieces in ``owned`` (file, split, seq, piece, offset, skip, length)."""
    parts = pieces(spark, folder).join(owned, ["file", "split", "seq"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda x: x["value"]), BOUNDARY).cast("binary")
    joined = parts.groupBy("file", "offset").agg(whole.alias("raw"), F.max("skip").alias("skip"), F.max("length").alias("length"))
    block = F.substr("raw", F.col("skip") + 1, F.col("length").cast("int"))
    # a scan that cut the files otherwise than the one before would have mixed pieces up
    checked = F.when(F.length(block) == F.col("length"), block).otherwise(F.raise_error(F.lit("pieces of a record are missing: files were split anew, read again")).cast("binary"))
    return joined.select("file", "offset", checked.alias("block"))


def read_archives(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """(file, offset, record_type, record_id, target_uri, refers, payload_bytes, payload_digest) of all records, on request with their payload."""
    found = settled(candidates(spark, folder))
    kept = reachable(found).withColumn("kept", F.lit(True))
    found = settled(found.join(kept, ["file", "offset"], "left"))
    columns = ["file", "offset", "record_type", "record_id", "target_uri", "refers", "payload_bytes", "payload_digest"]
    records = found.where("kept")
    wanted = records if payload else records.where("not whole")
    cut = wanted.select("file", "split", "seq", F.col("offset").alias("piece"), "offset", F.col("begin").alias("skip"), "length")
    # pieces that are no record belong to the last record before them, where that one is not whole
    order = Window.partitionBy("file").orderBy("offset")
    broken = found.where("kept is null or not whole").withColumn("owner", F.last(F.when(F.col("kept"), F.struct("offset", "next")), ignorenulls=True).over(order))
    more = broken.where("kept is null and offset < owner.next").select("file", "split", "seq", F.col("offset").alias("piece"), F.col("owner.offset").alias("offset"), F.lit(0).alias("skip"), F.lit(0).cast("long").alias("length"))
    whole = records.where("whole").select(*columns)
    owned = settled(cut.unionByName(more))
    made = blocks(spark, folder, F.broadcast(owned) if owned.count() <= BROADCAST_PIECES else owned)
    made = records.drop("payload_bytes", "payload_digest").join(made, ["file", "offset"])
    made = digested(made, F.col("block"))
    if payload:
        return made.select(*columns, payload_of(F.col("block"), F.col("content_type"))[1].alias("payload"))
    return whole.unionByName(made.select(*columns))


def chain_report(spark: SparkSession, folder: str) -> DataFrame:
    """(file, candidates, records, covered, bytes): where the chain ends before the file does, a record is damaged."""
    found = settled(candidates(spark, folder))
    kept = reachable(found).withColumn("kept", F.lit(True))
    end = F.max(F.col("offset") + F.col("before") + F.col("size")) - len(BOUNDARY)
    per = found.join(kept, ["file", "offset"], "left").groupBy("file")
    return per.agg(F.count("next").alias("candidates"), F.count("kept").alias("records"), F.max(F.when(F.col("kept"), F.col("next"))).alias("covered"), end.alias("bytes"))


def page_of(urn: Column) -> Column:
    found = F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1)
    return F.when(found != "", found.cast("long"))


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages, from archives in the shared folder that are deleted once read."""
    spark = pages.sparkSession
    folder = f"{shared_folder(pages)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    read = read_archives(spark, folder)
    out = settled(read.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers")).alias("refers_to")))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def op12_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
