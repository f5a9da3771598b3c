"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import lean, lean_groups
from .tokens import token_ids

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Tournament tree over bins: each inner node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts an item into the first bin that has room; returns the bin and the room it had."""
        free, node = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        room = free[node]
        bin_ = node - self.leaves
        free[node] = room - size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return bin_, room


def first_fit_decreasing(sizes: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``order`` lists the items from the largest down, ties settled."""
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    tree = CapacityTree(max(1, len(sizes)), capacity)
    for k in order.tolist():
        bins[k], room = tree.place(int(sizes[k]))
        offsets[k] = capacity - room
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int = 0, with_ids: bool = False, deal=None) -> DataFrame:
    """Cuts each document's ids (then ``end_id``) at multiples of ``limit``.

    A null text counts as empty and gives one piece with the end id alone.  Repeated ids of documents stay
    separate rows.  ``with_ids`` adds the ids themselves, ``deal`` a number of the row as ``pack_group``.
    """
    dealt = deal is not None
    more = ", ids array<int>" * with_ids + ", pack_group long" * dealt

    def run(batches):
        for batch in batches:
            for i, ids, offs in token_ids(batch, tokenizer_path, end_id):
                lengths = np.diff(offs)
                count = -(-lengths // limit)
                doc = np.repeat(np.arange(len(lengths)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * limit
                size = np.minimum(lengths[doc] - start, limit)
                data = memoryview(ids.astype("<u4").tobytes())
                a = offs[doc] + start
                crc = [zlib.crc32(data[4 * x : 4 * (x + y)]) for x, y in zip(a.tolist(), size.tolist(), strict=True)]
                cols = [batch.column(0).take(pa.array(i + doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(lengths[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(ids)).astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                if dealt:
                    cols.append(batch.column(2).take(pa.array(i + doc)))
                    names.append("pack_group")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if deal is None else [deal.alias("deal")]))
    return rows.mapInArrow(lean(run), PIECES + more)


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int = 0, group_docs: int = 4096, seed: int = 7, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``limit`` ids.

    Documents are dealt at random (by a seeded hash of id and text, those without id by their row) into groups of
    about ``group_docs``; each group is packed alone, so work and memory are bounded by the group, not by the table, and a hot source spreads
    over all groups.  Within a group pieces are placed from the longest down, ties by doc_id and start, each
    into the first sequence with room, which the tournament tree finds in logarithmic time.  A document longer
    than ``limit`` gives whole sequences and one rest.  Repeated rows are packed each.  Empty table: no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    deal = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"), row, F.lit(seed)), F.lit(groups))
    dealt = pieces(docs, tokenizer_path, limit, end_id, with_ids, deal)

    def run(table: pa.Table) -> pa.Table:
        size = table["length"].to_numpy()
        order = np.lexsort((table["start"].to_numpy(), table["doc_id"].fill_null(-1).to_numpy(), -size))
        bins, offsets = first_fit_decreasing(size, order, limit)
        group = table["pack_group"][0].as_py()
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("pack_group").applyInArrow(lean_groups(run), PIECES + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
