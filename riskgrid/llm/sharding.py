"""Contiguous shards of near equal bytes (operator 10), DataFrame operations only.

The rows are laid out in one global order (equal texts side by side, then by
id). The order is cut into ranges by ``repartitionByRange`` and written once
with the number of the range, so the ranges cannot move under later reads.
Each range gives one total (bytes, rows); prefix sums over those totals place
every range, a running sum inside each range places every row, and a row goes
to the shard in which the middle of its bytes lies. No range is larger than
the range partitioner makes it; a text that is repeated very often is spread
over several ranges, because the id (and a row number for repeated rows) is
part of the order.

Law ``bytes`` keeps sizes near equal and nothing else: a cut may go through a group of equal
texts, which then lies in neighbouring shards (a group larger than a shard has to).

Defined results: a null text has no bytes (size = ``overhead``); empty tables
give no rows; repeated rows are rows of their own, in any order among
themselves; null ids sort first; columns that the table has besides are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh, numbered, partitions, q, settle

SHARDS = 24
OVERHEAD = 8


def assign_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, global_start per row."""
    text = F.coalesce(q(text_col), F.lit(""))
    rows = docs.select(
        q(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("u"),
    )
    order = ["h", "doc_id", "u"]
    ranged = settle(rows.repartitionByRange(partitions(docs.sparkSession), *order)
                    .withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # One row per range: bounded by the number of partitions, not by the rows.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"))
    inside = Window.partitionBy("range").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (ranged
               .withColumn("run", F.sum("size").over(upto))
               .withColumn("nth", F.row_number().over(inside))
               .join(placed, "range")
               .withColumn("global_start", F.col("bytes_before") + F.col("run") - F.col("size"))
               .withColumn("row_no", F.col("rows_before") + F.col("nth") - 1)
               # Twice the middle of the row, so that all stays in whole numbers.
               .withColumn("shard", F.least(F.lit(shards - 1), F.expr(
                   f"cast((cast(2 * global_start + size as decimal(38,0)) * {shards}) div (2 * all_bytes) as int)"))))
    first = located.groupBy("shard").agg(F.min("row_no").alias("first_row"))
    return located.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("row_no") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("global_start").cast("long").alias("global_start"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, overhead: int = OVERHEAD,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as one folder per shard, rows in slot order.

    Rows that repeat an id and a text take that id and text's slots one each. A shard is
    written by several tasks, each a run of its slots."""
    key, place, sid, crc, nth = (fresh(docs, c) for c in ("shard", "slot", "sid", "crc", "nth"))
    plan = assign_shards(docs, shards, overhead, id_col, text_col).select(
        F.col("doc_id").alias(sid), F.col("text_crc32").alias(crc), F.col("shard").alias(key), F.col("slot").alias(place))
    plan = numbered(plan, [sid, crc], nth)
    rows = docs.withColumn(f"{crc}_own", F.crc32(F.coalesce(q(text_col), F.lit("")).cast("binary")))
    rows = numbered(rows, [id_col, f"{crc}_own"], f"{nth}_own")
    placed = rows.join(plan, q(id_col).eqNullSafe(q(sid)) & (q(f"{crc}_own") == q(crc)) & (q(f"{nth}_own") == q(nth)))
    (placed.select(*[q(c) for c in docs.columns], q(key), q(place))
     .repartitionByRange(max(shards, partitions(docs.sparkSession)), key, place).sortWithinPartitions(key, place)
     .write.partitionBy(key).parquet(path))
