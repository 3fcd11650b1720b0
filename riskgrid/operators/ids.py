"""Dense, ordered id assignment without a single-partition sort.

IDENTITY columns hand out consecutive ids in insert order. Here rows are
range-partitioned on the ordering key, sorted within each partition, and
numbered by ``monotonically_increasing_id`` (partition index in the upper 31
bits, position within the partition in the lower 33 bits). The numbered rows
are checkpointed once, so the counts per partition, the offsets made from them
and every later use see the same partitions and the same ids (a second plan
would sample its own range bounds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = 33


def assign_sequence(df: DataFrame, order_by: list[str], start: Column, name: str,
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start + 1, start + 2, ... in ``order_by`` order.

    ``order_by`` must be unique per row for the numbering to be repeatable.
    ``start`` is a scalar column (for example a scalar subquery of the
    current maximum id).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    ranged = ranged.select("*", F.shiftright("_mid", _LOW_BITS).alias("_pid"),
                           (F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).alias("_pos"))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the window below runs over at most n rows.
    offsets = counts.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    out = ranged.join(F.broadcast(offsets), "_pid", "inner")
    return (out.withColumn(name, (start + F.col("_off") + F.col("_pos") + 1).cast("long"))
            .drop("_mid", "_pid", "_pos", "_off"))
