"""Contiguous shards of nearly equal bytes, by prefix sums over an order of the rows, in built-in functions alone.

The order has equal texts side by side. Rows are dealt to parts by ranges of it; every part is summed
by itself, running sums over the parts' totals say where each one begins among all bytes, and a running
sum inside a part places its rows. Shards are cut at equal steps of the total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import discard, stash

#: Rows of one part at most, about.
PART_ROWS = 200_000
#: Parts up to which their table is broadcast; a larger one is joined by shuffle.
BROADCAST_PARTS = 100_000


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shards_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = 8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: id_col, size, text_crc32 (long), shard (int), slot (long, from 0 without gaps in its shard).

    A row's size is its text's UTF-8 bytes and ``overhead``. In the order by MD5 of the text, then of the id,
    a row goes to the shard in which the middle of its bytes falls, so a shard's size misses the equal
    share by less than its first and last rows' halves, and copies of a text are in one shard or in
    shards that follow each other: a group of copies larger than a shard is cut like all else. Null texts
    are empty, null ids are equal, rows equal in id and text are alike and each takes a slot. Texts
    count whole; columns of ``docs`` other than the two are not read. With fewer bytes than shards some
    shards are empty; an empty table gives none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(
        F.col(f"`{id_col}`").alias("__id"), (byte_size(text) + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("__key"), F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")).alias("__sub"),
    )
    # Rows equal in text and id are told apart by where they are read, so that any number of them can be dealt out.
    base = stash(base.withColumn("__tie", F.monotonically_increasing_id()), "sizes")
    total, rows = base.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return base.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    order = ["__key", "__sub", F.hash("__tie"), "__tie"]
    parts = max(-(-rows // PART_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = base.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("__id", "size", "text_crc32", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    dealt = stash(dealt, "parts")
    discard(base)

    # One row a part: where it begins among all bytes and rows.
    totals = dealt.groupBy("__part").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(name) for c, name in (("__bytes", "__from"), ("__rows", "__first"))])
    starts = F.broadcast(starts) if parts <= BROADCAST_PARTS else starts
    inside = Window.partitionBy("__part").orderBy("__at")
    placed = dealt.withColumns({"__run": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "__row": F.row_number().over(inside) - 1})
    placed = placed.join(starts, "__part").withColumns({"__run": F.col("__run") + F.col("__from"), "__row": F.col("__row") + F.col("__first")})
    # The shard of a row's middle; twice the bytes, so that a half is a whole number.
    shard = F.expr(f"cast(((2 * __run + size) * {shards}L) div {2 * total}L as int)")
    placed = stash(placed.select("__id", "size", "text_crc32", shard.alias("shard"), "__row"), "placed")
    discard(dealt)
    heads = placed.groupBy("shard").agg(F.min("__row").alias("__head"))  # a row a shard
    return placed.join(F.broadcast(heads) if shards <= BROADCAST_PARTS else heads, "shard").select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("__row") - F.col("__head")).alias("slot"))
