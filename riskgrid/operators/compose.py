"""States at the start of ordered chunks, by composing the chunks' functions in a tree.

A fold over a key's rows is a chain: every row needs the state behind the row before it.
Where a chunk of rows can be written down as a function from the state before it to
the state behind it, the chain can be cut: functions of neighbouring chunks are composed,
level by level, into those of larger runs; then states go down the same tree, from a
key's first state to the state before each chunk. Every step handles at most a
node's children in one task, and the chunks themselves are folded side by side.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_BITS = 33   # a place is (partition << 33) + place in the partition
FAN_BITS = 4     # a node has at most 16 children above the partitions


def placed(rows: DataFrame, order: list[str], per_chunk: int, n_rows: int) -> DataFrame:
    """``rows`` in the order of ``order`` with ``chunk``, an ascending number of runs of at most
    ``per_chunk`` rows; written once (checkpoint), so that numbers stay as they are.

    Range partitions of about ``per_chunk`` rows, each sorted on its own."""
    parts = max(1, -(-n_rows // per_chunk))
    at = F.monotonically_increasing_id()
    within = F.lit((1 << PART_BITS) - 1)
    return (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("chunk", at)
            .withColumn("chunk", F.col("chunk") - F.col("chunk").bitwiseAND(within)
                        + F.expr(f"(chunk & {(1 << PART_BITS) - 1}L) div {per_chunk}L"))
            .checkpoint(eager=True))


def _schema(frame: DataFrame, columns: list[str]) -> T.StructType:
    return T.StructType([frame.schema[c] for c in columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in iter(lambda: list(itertools.islice(rows, 2_000)), []):
        columns = list(zip(*part))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _up(level: DataFrame, key: str, bits: int, compose: Callable) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    out = _schema(level, [key, "chunk", "fn"])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r[key], r["up"], r["fn"]) for b in batches for r in b.to_pylist())

        def nodes():
            for (k, up), group in itertools.groupby(rows, key=lambda r: r[:2]):
                fn = None
                for _, _, f in group:
                    fn = f if fn is None else compose(fn, f)
                yield k, up, fn
        yield from _batches(nodes(), arrow)

    return (level.withColumn("up", F.shiftright("chunk", bits)).repartition(key, "up").sortWithinPartitions(key, "up", "chunk")
            .select(key, "up", "fn").mapInArrow(run, out).checkpoint(eager=True))


def entry_states(functions: DataFrame, initial: DataFrame, key: str, compose: Callable, advance: Callable) -> DataFrame:
    """(key, chunk, state): the state before each chunk.

    ``functions``: (key, chunk, fn), one row per key and chunk, written. ``initial``: (key, state), one row
    per key; keys without one get none. ``compose(f, g)``: first f, then g. ``advance(fn, state)``: the state behind."""
    from pyspark.sql.pandas.types import to_arrow_schema
    levels, bits = [functions], [PART_BITS]
    level = _up(functions, key, PART_BITS, compose)
    most = level.agg(F.max("chunk")).head()[0] or 0
    while most > 0:
        levels.append(level)
        bits.append(FAN_BITS)
        level = _up(level, key, FAN_BITS, compose)
        most >>= FAN_BITS
    states = initial.select(key, F.lit(0).cast("long").alias("up"), "state")
    for children, shift in zip(reversed(levels), reversed(bits)):
        both = children.select(key, F.shiftright("chunk", shift).alias("up"), "chunk", "fn").unionByName(states, allowMissingColumns=True)
        out = T.StructType([functions.schema[key], functions.schema["chunk"], initial.schema["state"]])
        arrow = to_arrow_schema(out)

        def run(batches: Iterator[pa.RecordBatch], arrow=arrow) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for r in b.to_pylist())

            def entries():
                for (k, _), group in itertools.groupby(rows, key=lambda r: (r[key], r["up"])):
                    state = None
                    for r in group:
                        if r["chunk"] is None:
                            state = r["state"]
                        elif state is not None:
                            yield k, r["chunk"], state
                            state = advance(r["fn"], state)
            yield from _batches(entries(), arrow)

        states = (both.repartition(key, "up").sortWithinPartitions(key, "up", F.col("chunk").asc_nulls_first())
                  .mapInArrow(run, out)).withColumnRenamed("chunk", "up")
        states = states.checkpoint(eager=True)
    return states.withColumnRenamed("up", "chunk")
