"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back.

    Cuts the lineage: what follows reads these files, so a lost executor
    costs only its own tasks, and values such as partition ids stay fixed.
    The files go when the application ends (or with ``session`` clean-up)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (letters of any case)."""
    taken = {c.lower() for c in df.columns}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}{n}"
    return name


def q(name: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def release() -> None:
    """Give memory that this worker no longer uses back to the machine.

    A worker lives on behind its task, beside those of the next stage; without
    this, every one of them keeps the most it has ever held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """``run``, with ``release`` behind the last batch of a task."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: rows of equal keys numbered from 1, in any order.

    Numbers run per key and written partition, plus the rows of the key in earlier
    partitions, so a key of very many rows is not one task's. ``df`` is written once."""
    at, part, ahead = fresh(df, "at"), fresh(df, "part"), fresh(df, "ahead")
    rows = settle(df.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(q(at), 33))
    counts = rows.groupBy(*[q(k) for k in keys], q(part)).agg(F.count(F.lit(1)).alias(name))
    before = Window.partitionBy(*[q(k) for k in keys]).orderBy(q(part)).rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select(*[q(k).alias(f"{ahead}_{i}") for i, k in enumerate(keys)], q(part).alias(f"{ahead}_p"),
                            F.coalesce(F.sum(name).over(before), F.lit(0)).alias(ahead))
    met = q(part) == q(f"{ahead}_p")
    for i, k in enumerate(keys):
        met = met & q(k).eqNullSafe(q(f"{ahead}_{i}"))
    inside = Window.partitionBy(*[q(k) for k in keys], q(part)).orderBy(q(at))
    return (rows.withColumn(name, F.row_number().over(inside)).join(earlier, met)
            .withColumn(name, q(name) + q(ahead)).drop(at, part, *earlier.columns))


def map_columns(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` by position: ``run`` yields lists of arrays in the order of ``schema``.

    Columns keep their names, whatever characters they hold."""
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in run(batches):
            yield pa.RecordBatch.from_arrays(arrays, names=inner.names)

    return df.toDF(*[f"i{i}" for i in range(len(df.columns))]).mapInArrow(released(named), inner).toDF(*schema.names)


def text_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(q(doc_id), q(text))


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str],
             handle: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Call ``handle`` once for each run of equal keys in sorted batches.

    Only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        ids = list(zip(*cols))
        lo = 0
        for i in range(1, len(ids) + 1):
            if i < len(ids) and ids[i] == ids[lo]:
                continue
            if held and ids[lo] != current:
                out = handle(pa.Table.from_batches(held))
                held = []
                if out is not None and out.num_rows:
                    yield out
            current = ids[lo]
            held.append(batch.slice(lo, i - lo))
            lo = i
    if held:
        out = handle(pa.Table.from_batches(held))
        if out is not None and out.num_rows:
            yield out
