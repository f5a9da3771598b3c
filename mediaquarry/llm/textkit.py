"""Vectorised text kernels over Arrow buffers, and helpers shared by the operators of this subpackage.

A kernel sees the bytes of many documents as one ``uint8`` array with document offsets and works on
whole arrays, so no Python code runs per word or per character.
"""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import shared_dir

#: The white space of all operators, and an odd multiplier for prefix hashes modulo 2**64.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = 0x9E3779B97F4A7C15

#: Bytes of text handled at once; bounds the temporary arrays (about ten arrays of 8 bytes a byte).
SLICE_BYTES = 2 << 20


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker; tables that are costly to build go there."""
    name = "_mediaquarry_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def give_back() -> None:
    """Returns memory that is free in this process to the system.

    A worker serves many tasks; what it keeps of each one's peak adds up with the next one's on its executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library of Linux
        trim(0)


def lean(run):
    """The function of record batches, with memory given back once a task is done."""

    def work(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return work


def lean_groups(run, least: int = 1 << 20):
    """The function of one or two tables, with memory given back after tables of ``least`` bytes and more."""

    def work(*tables):
        out = run(*tables)
        if sum(t.nbytes for t in tables) >= least:
            give_back()
        return out

    return (lambda left, right: work(left, right)) if run.__code__.co_argcount == 2 else (lambda table: work(table))


def space_table() -> np.ndarray:
    """True for bytes of words split at white space."""
    table = np.ones(256, bool)
    table[list(SPACE_BYTES)] = False
    return table


def alnum_table() -> np.ndarray:
    """True for ASCII digits and letters and all bytes of other code points."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n at least."""
    cache = worker_cache()
    size = max(1 << 16, n + n // 8)
    if "pow" not in cache or len(cache["pow"]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for b in (BASE, inverse):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            out.append(p[:size].copy())
        cache["pow"], cache["inv"] = out
    return cache["pow"], cache["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (buf[j] + 1) * BASE**j over j < i, modulo 2**64."""
    pw, _ = powers(len(buf) + 1)
    p = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[: len(buf)], out=p[1:])
    return p


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], alike for equal bytes wherever they stand."""
    _, inv = powers(len(p))
    h = (p[ends] - p[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Yields (first row, rows, buf, offsets) over runs of rows with at most ``limit`` bytes, or one longer row.

    Nulls count as empty texts.
    """
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j - i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that stay within documents: starts, ends, and each document's first run (CSR)."""
    n = len(mask)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = mask[:-1]
        after[:-1] = mask[1:]
        inner = offs[(offs > 0) & (offs < n)]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted columns, and their length at the end."""
    n = len(keys[0])
    fresh = np.ones(n, bool)
    if n:
        fresh[1:] = False
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(fresh), n)


def binary_runs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose elements are values[bounds[i]:bounds[i + 1]], without a copy for each."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * (values.itemsize if values.ndim == 1 else values.shape[1])).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def owners(csr: np.ndarray) -> np.ndarray:
    """For each item of a CSR layout, the document that holds it."""
    return np.repeat(np.arange(len(csr) - 1), np.diff(csr))


def doc_sums(values: np.ndarray, csr: np.ndarray) -> np.ndarray:
    """Sum of each document's values."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fui" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[csr[1:]] - total[csr[:-1]]


def crc_mod(column: str, by: int):
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string")) % by


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: a cut in the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(docs: DataFrame, added: str, run) -> DataFrame:
    """All columns of ``docs``, whatever their names, and those of the DDL ``added``, which replace any of the same name.

    ``run`` takes a record batch with the columns of ``docs`` in order and returns arrays for the new ones.
    """
    new = T.StructType.fromDDL(added)
    docs = docs.drop(*new.names)
    names = docs.columns
    kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*docs.schema, *new])])

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                batch = pa.RecordBatch.from_arrays(batch.columns, names=names)
                yield pa.RecordBatch.from_arrays(batch.columns + run(batch), names=[f"c{i}" for i in range(len(names) + len(new))])

    return docs.mapInArrow(lean(work), kinds).toDF(*names, *new.names)


def dense_counts(rows: DataFrame, cells: int, count, part: int = 1 << 16, fan_in: int = 128) -> np.ndarray:
    """Adds up tables of ``cells`` counters: ``count(table, batch)`` fills a task's own, which is sent once in parts.

    Parts meet in three levels, so that no group holds those of more than ``fan_in`` tasks (of two million in all).
    """
    kinds = "task int, part int, cells binary"

    def fill(batches):
        table = np.zeros(cells, np.int64)
        for batch in batches:
            count(table, batch)
        parts = [zlib.compress(table[i : i + part].tobytes(), 1) for i in range(0, cells, part)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["task", "part", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table["cells"])
        new = [[table["task"][0].as_py() // fan_in], [table["part"][0].as_py()], [zlib.compress(total.tobytes(), 1)]]
        return pa.table([pa.array(new[0], pa.int32()), pa.array(new[1], pa.int32()), pa.array(new[2], pa.binary())], names=["task", "part", "cells"])

    sums = rows.mapInArrow(lean(fill), kinds)
    for _ in range(2):
        sums = sums.groupBy(F.floor(F.col("task") / fan_in), "part").applyInArrow(add, kinds)
    out = np.zeros(cells, np.int64)
    for r in sums.groupBy("part").applyInArrow(add, kinds).toLocalIterator():
        x = np.frombuffer(zlib.decompress(bytes(r["cells"])), np.int64)
        out[r["part"] * part : r["part"] * part + len(x)] = x
    return out
