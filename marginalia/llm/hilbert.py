"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut into equal-depth cells, numbers by approximate quantiles and
strings by exact ones over whole strings; a row's cell coordinates give its index on
the curve, and the rows in curve order are cut into runs, so that a shard's minimum
and maximum of every dimension span few cells and files can be skipped on any of
them. The law is ``rows``: counts of shards differ by one at most.
Ranks come from counts, not from a total sort in one task: rows are counted by
(curve index, salt), the counts' running sums give every group's first rank, and
only rows of one group are numbered together. Equal texts share the index of their smallest
id, and the salt is made of the text's digest first and of the id second: they are
neighbours, and however many they are no group holds them all. Identical rows are interchangeable, ties are by id.
A null dimension counts as its smallest value; a null text has no bytes and the
digest of the empty text. An empty table gives an empty table. A text of any length
is only measured and digested. Columns beside doc_id, text, lang and source may have
any name; ``write_shards`` writes them too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import NULL_ID, settled

#: Bits a dimension; the curve over d dimensions has 2**(BITS * d) indexes.
BITS = 4
#: Each index is split so often, so that no group holds a hot cell whole.
SALTS = 256
#: Salts by digest and, for each, by id, where equal texts should be neighbours.
TEXT_SALTS, ID_SALTS = 64, 256
QUANTILE_ACCURACY = 2000
#: Groups of equal texts (some 40 bytes each) up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_GROUPS = 100_000


def hilbert_index(point: Sequence[int], bits: int) -> int:
    """The position on the curve of a point whose coordinates have so many bits.

    A point is turned into the curve's own axes from the highest bit down: where
    an axis' bit is set the lower bits of the first axis are mirrored, else they
    are exchanged with it. The Gray code over all axes' bits is then undone."""
    x = list(point)
    for shift in range(bits - 1, 0, -1):
        low = (1 << shift) - 1
        for i in range(len(x)):
            if x[i] >> shift & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    index = parity = 0
    for shift in range(bits - 1, -1, -1):
        for v in x:
            parity ^= v >> shift & 1
            index = index << 1 | parity
    return index


def cell(c: Column, cuts: Sequence[float | str]) -> Column:
    """How many cuts lie at or below the value."""
    out = F.lit(0)
    for cut in cuts:
        out = out + F.when(c >= F.lit(cut), 1).otherwise(0)
    return F.coalesce(out, F.lit(0))


def string_cuts(df: DataFrame, c: Column, bits: int = BITS) -> list[str]:
    """At most 2**bits - 1 strings that cut the rows, in the order of whole strings, into cells of equal depth.

    Distinct values are counted and ranged; the ranges' sums and the cuts are all that comes to the driver."""
    counts = df.groupBy(c.alias("v")).agg(F.count("*").alias("n"))
    ranged = settled(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").agg(F.sum("n")).collect())):
        before[part] = total
        total += n
    if not before:
        return []
    order = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.element_at(F.lit([before.get(i, 0) for i in range(max(before) + 1)]), F.col("part") + 1)
    start = F.coalesce(F.sum("n").over(order), F.lit(0)) + offset
    # a value belongs to the cell in which its rows begin
    cells = ranged.withColumn("cell", F.floor(start * 2**bits / total)).groupBy("cell").agg(F.min("v").alias("v")).collect()
    return sorted(v for k, v in cells if k > 0)


def quantile_cuts(df: DataFrame, dims: dict[str, Column], bits: int = BITS) -> dict[str, list[float | str]]:
    """At most 2**bits - 1 cuts for each dimension, over all rows."""
    strings = {t[0] for t in df.select(*[c.alias(n) for n, c in dims.items()]).dtypes if t[1] == "string"}
    at = F.array(*[F.lit(i / 2**bits) for i in range(1, 2**bits)])
    numbers = {name: c for name, c in dims.items() if name not in strings}
    row = df.agg(*[F.percentile_approx(c, at, QUANTILE_ACCURACY).alias(name) for name, c in numbers.items()]).first() if numbers else {}
    return {name: string_cuts(df, c, bits) if name in strings else sorted(set(row[name] or [])) for name, c in dims.items()}


def with_curve(df: DataFrame, dims: dict[str, Column], name: str = "curve", bits: int = BITS) -> DataFrame:
    """Add the curve index of each row. ``dims`` are numbers or strings without nulls; few values need few cells."""
    cuts = quantile_cuts(df, dims, bits)
    place = F.lit(0)
    for key, c in dims.items():
        place = place * 2**bits + cell(c, cuts[key])
    d = len(dims)
    points = ([p >> bits * (d - 1 - i) & (1 << bits) - 1 for i in range(d)] for p in range(1 << bits * d))
    table = F.lit([hilbert_index(p, bits) for p in points])
    return df.withColumn(name, F.element_at(table, place + 1))


def with_rank(df: DataFrame, cell_col: str, salt_col: str, order: Sequence[Column], name: str = "rank") -> tuple[DataFrame, int]:
    """Number all rows from 0 by (cell, salt, order), and count them."""
    counts = df.groupBy(cell_col, salt_col).agg(F.count("*").alias("_n"))
    cells = counts.groupBy(cell_col).agg(F.sum("_n").alias("_m")).collect()
    first, total = {}, 0
    for c, m in sorted((r[0], r[1]) for r in cells):
        first[c] = total
        total += m
    # at most one entry for each curve index
    starts = F.lit([first.get(i, 0) for i in range(max(first, default=0) + 1)])
    within = Window.partitionBy(cell_col).orderBy(salt_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(cell_col).alias("_c"), F.col(salt_col).alias("_s"), (F.coalesce(F.sum("_n").over(within), F.lit(0)) + F.element_at(starts, F.col(cell_col) + 1)).alias("_first"))
    numbered = df.withColumn("_i", F.row_number().over(Window.partitionBy(cell_col, salt_col).orderBy(*order)) - 1)
    joined = numbered.join(offsets, (F.col(cell_col) == F.col("_c")) & (F.col(salt_col) == F.col("_s")))
    return joined.withColumn(name, F.col("_first") + F.col("_i")).drop("_c", "_s", "_first", "_i"), total


def together(placed: DataFrame) -> DataFrame:
    """Rows of equal texts (by digest and size) take the curve index of the one with the smallest id, whatever their own dimensions."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "curve"))
    groups = placed.groupBy(F.col("text_crc32").alias("_crc"), F.col("size").alias("_size")).agg(F.count("*").alias("_n"), first.alias("_first"))
    groups = settled(groups.where("_n > 1").select("_crc", "_size", F.col("_first.curve").alias("_own")))
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    joined = placed.join(groups, (F.col("text_crc32") == F.col("_crc")) & (F.col("size") == F.col("_size")), "left")
    return joined.withColumn("curve", F.coalesce("_own", "curve")).drop("_crc", "_size", "_own")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) of every row; dimensions: lang, source, size."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), word("lang").alias("_lang"), word("source").alias("_source"))
    placed = with_curve(rows, {"_lang": F.col("_lang"), "_source": F.col("_source"), "size": F.col("size")})
    salt = F.pmod(F.xxhash64("text_crc32"), F.lit(TEXT_SALTS)) * ID_SALTS + F.pmod(F.xxhash64("doc_id"), F.lit(ID_SALTS))
    placed = together(settled(placed.select("doc_id", "size", "text_crc32", "curve", salt.cast("int").alias("_salt"))))
    ranked, total = with_rank(placed, "curve", "_salt", [F.col("text_crc32"), F.col("doc_id")])
    # the first `total % shards` shards hold one row more
    small, more = divmod(total, shards)
    edge = more * (small + 1)
    r = F.col("rank")
    shard = F.when(r < edge, F.floor(r / (small + 1))).otherwise(more + F.floor((r - edge) / max(small, 1))).cast("int")
    slot = F.when(r < edge, r % (small + 1)).otherwise((r - edge) % max(small, 1))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def free_name(name: str, columns: Sequence[str]) -> str:
    """The name, with as many underscores behind it as make it a new one."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """Write documents as one folder a shard, in slot order; files keep statistics for pruning.

    As many rows are written as read: null ids meet too, and the rows of one id,
    size and digest are numbered on both sides and meet one by one. All columns of
    ``docs`` are written; the folders' column and the slot are ``shard`` and ``slot``,
    with an underscore behind where ``docs`` has a column of that name."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = ["id", "size", "crc", "nth"]
    nth = lambda *order: F.row_number().over(Window.partitionBy("id", "size", "crc").orderBy(*order)).alias("nth")
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    left = left.select("row", "id", "size", "crc", nth("id"))
    placed = sharded.select(F.col("doc_id").alias("id"), "size", F.col("text_crc32").alias("crc"), "shard", "slot")
    placed = placed.select("id", "size", "crc", "shard", "slot", nth("shard", "slot")).withColumnsRenamed({k: f"{k}_" for k in keys})
    joined = left.join(placed, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    folder, slot = free_name("shard", docs.columns), free_name("slot", docs.columns)
    out = joined.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("shard").alias(folder), F.col("slot").alias(slot))
    out.repartitionByRange(folder, slot).sortWithinPartitions(folder, slot).write.partitionBy(folder).mode("overwrite").parquet(path)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
