"""Embedding near-dedup (operator 3): lattice hashing with E8.

Every vector is scaled to length 1. In each of ``TABLES`` tables it is
projected by a random orthonormal map to ``BLOCKS`` times eight dimensions,
scaled, and each eight decoded to the nearest point of the lattice E8; the
points and the label together are the vector's cell. Besides its own cell it
probes the ``PROBES`` neighbouring cells (one of the 240 shortest lattice
vectors away, in one block) whose points are next nearest. Vectors that share a cell are
compared by cosine in double precision, so no link is below the threshold.

A pair that shares several cells counts in the first of them (smallest cell
key), so links are counted where they are found and no table of pairs is made.
Equal vectors are collapsed to one class first (their number counts as
links). A cell with more than ``CELL`` classes is split into chunks, and
every pair of chunks is compared in a task of its own, so nothing is dropped.
A cell's task sends on one count per vector and links that join what is not
joined yet, not all pairs.

Vectors of each length have projections and cells of their own, so only equal lengths link.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component, and vectors without a label, link with nothing and are kept as their own component; repeated rows of one id and
vector link with each other like other equal vectors; a null id takes part,
a component's id is the smallest that is not null; empty tables give no rows;
other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frames import by_group, partitions, q, released, settle
from .words import mix

THRESHOLD = 0.93
TABLES = 8
BLOCKS = 2
PROBES = 4
SCALE = 3.5
CELL = 2048
SEED = 3
KEYS_AT_ONCE = 4096  # cells of one cell's vectors that are compared at once


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: (+-2, +-2, 0^6) and (+-1)^8 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append([-1 if bits >> k & 1 else 1 for k in range(8)])
    return np.array(out, np.int64)


_NEIGHBOURS = _shortest()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum."""
    r = np.rint(x)
    odd = (r.sum(1).astype(np.int64) & 1) == 1
    off = x - r
    k = np.abs(off).argmax(1)
    rows = np.flatnonzero(odd)
    r[rows, k[rows]] += np.where(off[rows, k[rows]] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row, doubled to whole numbers."""
    whole = _nearest_d8(x)
    half = _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


def projections(dim: int, tables: int, blocks: int, seed: int) -> np.ndarray:
    """[table, 8 * blocks, dim], orthonormal rows (where dim allows)."""
    rng = np.random.default_rng(seed)
    out = np.zeros((tables, 8 * blocks, dim))
    for t in range(tables):
        g = rng.standard_normal((max(dim, 8 * blocks), max(dim, 8 * blocks)))
        basis = np.linalg.qr(g)[0]
        out[t] = basis[:8 * blocks, :dim]
    return out


def _hash(points: np.ndarray, salt: int) -> np.ndarray:
    """Hash of rows of whole numbers."""
    total = np.full(len(points), np.uint64(salt))
    for j in range(points.shape[1]):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + (points[:, j] + (1 << 20)).astype(np.uint64))
    return total


def cells(unit: np.ndarray, label: np.ndarray, maps: np.ndarray, blocks: int, probes: int, scale: float) -> np.ndarray:
    """[vector, table * (1 + probes)] uint64 keys of the cells that a vector visits."""
    n, dim = unit.shape
    out = []
    stretch = scale * np.sqrt(dim / 8.0) / 2.0
    for t in range(len(maps)):
        y = (unit @ maps[t].T) * stretch
        points = np.concatenate([decode_e8(y[:, 8 * b:8 * b + 8]) for b in range(blocks)], 1)
        salted = np.concatenate([points, label[:, None]], 1)
        salt = (dim << 20) + t + 1  # vectors of different lengths share no cell
        out.append(_hash(salted, salt))
        if probes:
            # How much farther each neighbouring point is, over all blocks.
            rest = 2 * y - points
            cost = np.concatenate([(_NEIGHBOURS ** 2).sum(1)[None, :] - 2 * rest[:, 8 * b:8 * b + 8] @ _NEIGHBOURS.T
                                   for b in range(blocks)], 1)
            pick = np.argpartition(cost, probes, axis=1)[:, :probes]
            for p in range(probes):
                moved = salted.copy()
                b, v = pick[:, p] // len(_NEIGHBOURS), pick[:, p] % len(_NEIGHBOURS)
                for j in range(8):
                    moved[np.arange(n), 8 * b + j] += _NEIGHBOURS[v, j]
                out.append(_hash(moved, salt))
    return np.stack(out, 1)


@functools.lru_cache(maxsize=8)
def _projections(dim: int, tables: int, blocks: int, seed: int) -> np.ndarray:
    return projections(dim, tables, blocks, seed)


def unit_rows(column, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, raw vectors) of the rows whose vector takes part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), kind)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    raw = flat.astype(kind).reshape(len(rows), dim)
    ok = np.isfinite(raw).all(1) & (raw != 0).any(1)
    return rows[ok], raw[ok]


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1. The largest component is divided out first: squares of large or tiny ones leave the doubles."""
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1)[:, None]
    return wide / np.linalg.norm(wide, axis=1)[:, None]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a boolean adjacency matrix."""
    out, seen = [], np.zeros(len(linked), bool)
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            out += [(i, int(j)) for j in new]
            todo += new.tolist()
    return out


def _cell_links(threshold: float, kind: str):
    """One cell (or pair of its chunks): counts per class and joining links."""
    def run(whole: pa.Table) -> pa.RecordBatch | None:
        # One cell holds one vector length, but for equal hashes.
        length = pa.compute.binary_length(whole.column("vec")).to_numpy()
        found = [alike(whole.filter(pa.array(length == n))) for n in np.unique(length)]
        found = [x for x in found if x is not None]
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None

    def alike(t: pa.Table) -> pa.RecordBatch | None:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        key = np.int64(t.column("key")[0].as_py()).view(np.uint64)
        cls = t.column("cls").to_pylist()
        part = t.column("part").to_numpy()
        size = t.column("size").to_numpy().astype(np.float64)
        unit = _unit(np.stack([np.frombuffer(x.as_py(), kind) for x in t.column("vec")]))
        keys = np.array(t.column("keys").to_pylist(), np.int64).view(np.uint64)
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= part[:, None] != part[None, :]
        busy = np.flatnonzero(linked.any(1))
        if not len(busy):
            return None
        linked, keys, size = linked[np.ix_(busy, busy)], keys[busy], size[busy]
        # Pairs that share a smaller key are counted in that cell.
        low = np.where(keys < key, keys, key)
        value, at = np.unique(low, return_inverse=True)
        at = at.reshape(low.shape)
        several = np.bincount(at.ravel(), minlength=len(value)) >= 2
        number = np.where(several & (value != key), np.cumsum(several) - 1, -1)[at]
        own = linked.copy()
        for lo in range(0, int(several.sum()), KEYS_AT_ONCE):
            here = (number >= lo) & (number < lo + KEYS_AT_ONCE)
            holders = np.zeros((len(busy), min(KEYS_AT_ONCE, int(several.sum()) - lo)), np.float32)
            holders[np.nonzero(here)[0], number[here] - lo] = 1
            own &= holders @ holders.T == 0
        counts = (own @ size).astype(np.int64)
        edges = _forest(linked)
        a = [cls[busy[x]] for x in np.flatnonzero(counts)] + [cls[busy[x]] for x, _ in edges]
        b = [None] * int((counts > 0).sum()) + [cls[busy[y]] for _, y in edges]
        n = counts[counts > 0].tolist() + [0] * len(edges)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
                                          names=["a", "b", "n"])
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS,
                 probes: int = PROBES, scale: float = SCALE, cell: int = CELL, seed: int = SEED,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors``."""
    spark = vectors.sparkSession
    source = vectors.select(q(id_col).alias("vec_id"), q(label_col).cast("long").alias("label"), q(vector_col).alias("v"))
    kind = "<f4" if source.schema["v"].dataType.elementType == T.FloatType() else "<f8"
    schema = T.StructType([source.schema["vec_id"], T.StructField("cls", T.BinaryType()), T.StructField("vec", T.BinaryType()),
                           T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                cls, vec, keys = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
                for dim in pa.compute.unique(pa.compute.list_value_length(b.column(2))).to_pylist():
                    if not dim:
                        continue
                    rows, raw = unit_rows(b.column(2), dim, kind)
                    labels = b.column(1).take(pa.array(rows, pa.int64()))
                    has = labels.is_valid().to_numpy(zero_copy_only=False)
                    rows, raw = rows[has], raw[has]
                    label = labels.fill_null(0).to_numpy(zero_copy_only=False)[has].astype(np.int64)
                    if not len(rows):
                        continue
                    # Each length has projections of its own; a worker keeps those of the last few.
                    maps = _projections(dim, tables, blocks, seed)
                    visited = cells(_unit(raw), label, maps, blocks, probes, scale).view(np.int64)
                    for k, r in enumerate(rows.tolist()):
                        vec[r] = raw[k].tobytes()
                        cls[r] = hashlib.blake2b(vec[r], digest_size=16, salt=int(label[k]).to_bytes(8, "little", signed=True)).digest()
                        keys[r] = visited[k]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), pa.array(vec, pa.binary()),
                                                  pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    points = settle(source.mapInArrow(released(run), schema))
    classes = settle(points.where("cls is not null").groupBy("cls").agg(
        F.first("vec").alias("vec"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least")))
    keyed = classes.select("cls", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("key").alias("k2"), F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("parts"))
    members = (keyed.join(shared, F.col("key") == F.col("k2"))
               .withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("k2")
               .join(classes.select("cls", "vec", "keys", "size"), "cls")
               .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
               .select("key", F.least("x", "part").alias("i"), F.greatest("x", "part").alias("j"), "part", "cls", "vec", "keys", "size"))
    names = ["key", "i", "j"]
    handle = _cell_links(threshold, kind)
    found = settle(members.repartition(partitions(spark), *names).sortWithinPartitions(*names)
                   .mapInArrow(released(lambda it: by_group(it, names, handle)), "a binary, b binary, n long"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"))
    group = (classes.select("cls", "size", "least").join(counts, F.col("cls") == F.col("a"), "left")
             .join(roots, F.col("cls") == F.col("node"), "left")
             .select("cls", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "least", F.coalesce("root", "cls").alias("root")))
    least = group.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r2")
    group = group.join(least, F.col("root") == F.col("r2")).select(F.col("cls").alias("c2"), "n_links", "component")
    component = F.when(F.col("c2").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return (points.select("vec_id", "cls").join(group, F.col("cls") == F.col("c2"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
