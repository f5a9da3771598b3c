"""Line dedup: sharded cuckoo filters backed by exact reference-count tables, reversible by document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import edges, lean, lean_groups, lower_table, space_table, staged, text_slices

#: Repeated keys that one shard's filter is made for, and postings that are held against a shard at once.
SHARD_KEYS = 50_000
SHARD_POSTINGS = 1_000_000
SLOTS = 4
#: Postings a task gathers before it sends them to the shards.
GATHERED = 1_000_000


class CuckooFilter:
    """Cuckoo filter over 64-bit keys: 16-bit fingerprints in buckets of four; keys may be deleted again.

    Keys that find no slot after ``kicks`` moves go to an exact overflow list, so no key is ever lost.
    """

    kicks = 200

    def __init__(self, capacity: int, table: np.ndarray | None = None, overflow: list[int] | None = None):
        self.buckets = 1 << max(1, int(np.ceil(capacity / (SLOTS * 0.85))) - 1).bit_length()
        self.table = np.zeros((self.buckets, SLOTS), np.uint16) if table is None else table.reshape(-1, SLOTS)
        self.buckets = len(self.table)
        self.overflow = set(overflow or ())

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        mark = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        last = np.uint64(self.buckets - 1)
        one = (keys & last).astype(np.int64)
        return mark, one, one ^ self.jump(mark)

    def jump(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, key: int) -> None:
        mark, one, two = (x[0] for x in self.places(np.array([key])))
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        at, moved = int(one), []
        for turn in range(self.kicks):
            slot = turn % SLOTS
            moved.append((at, slot, self.table[at, slot]))
            mark, self.table[at, slot] = self.table[at, slot], mark
            at ^= int(self.jump(np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        for at, slot, mark in reversed(moved):
            self.table[at, slot] = mark
        self.overflow.add(int(key))

    def insert_many(self, keys: np.ndarray) -> None:
        """Fills free slots of first and second buckets for all keys at once; the few that are left move others."""
        mark, one, two = self.places(keys)
        left = np.arange(len(keys))
        for place in (one, two):
            left = left[np.argsort(place[left], kind="stable")]
            at = place[left]
            first = edges(at)
            rank = np.arange(len(at)) - np.repeat(first[:-1], np.diff(first))
            used = self.table[at] != 0
            fits = rank < SLOTS - used.sum(1)
            slot = np.argsort(used[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.table[at[fits], slot] = mark[left[fits]]
            left = left[~fits]
        for k in left.tolist():
            self.insert(int(keys[k]))

    def delete(self, key: int) -> bool:
        """Removes a key that was inserted; False if there is no trace of it."""
        if int(key) in self.overflow:
            self.overflow.discard(int(key))
            return True
        mark, one, two = (x[0] for x in self.places(np.array([key])))
        for at in (one, two):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """May the keys be there?  Never False for a key that was inserted."""
        mark, one, two = self.places(keys)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        if self.overflow:
            found |= np.isin(keys, list(self.overflow))
        return found


@dataclass
class LineIndex:
    """postings: doc_id, k1, k2, lines; counts: k1, k2, n_refs, owner, last_doc; filters: shard, slots, overflow.

    All are tables.  Postings and counts are exact; the filters hold the keys of at least two documents, each in
    the filter of its shard, and follow insertions and deletions.
    """

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def line_keys(buf: np.ndarray, offs: np.ndarray, min_chars: int):
    """Lines of each document: starts, ends, document of each line, and 128-bit keys of those long enough.

    Returns (document, line number, key rows as two int64 columns, lines per document).
    """
    n = len(buf)
    breaks = np.flatnonzero(buf == 0x0A)
    inner = np.searchsorted(breaks, offs)
    per_doc = np.diff(inner) + 1
    first = np.cumsum(per_doc) - per_doc
    starts = np.empty(int(per_doc.sum()), np.int64)
    ends = np.empty_like(starts)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    number = np.arange(len(starts)) - first[doc]
    starts[first] = offs[:-1]
    starts[number > 0] = breaks + 1
    ends[first + per_doc - 1] = offs[1:]
    ends[:-1][number[1:] > 0] = breaks
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros((0, 2), np.int64), per_doc
    solid = space_table()[buf]
    at = np.arange(n)
    after = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, at, -1))
    a = np.where(starts < n, after[np.minimum(starts, n - 1)], n)
    b = np.where(ends > 0, before[np.maximum(ends - 1, 0)], -1) + 1
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    long_enough = np.flatnonzero((a < ends) & (chars[np.maximum(b, 0)] - chars[np.minimum(a, n)] >= min_chars))
    data = lower_table()[buf].tobytes()
    digest = xxhash.xxh3_128_digest
    keys = b"".join(digest(data[x:y]) for x, y in zip(a[long_enough].tolist(), b[long_enough].tolist(), strict=True))
    return doc[long_enough], number[long_enough], np.frombuffer(keys, np.int64).reshape(-1, 2), per_doc


def postings(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row for each document and distinct line key, with the numbers of its lines."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, offs in text_slices(batch):
                doc, number, keys, _ = line_keys(buf, offs, min_chars)
                order = np.lexsort((number, keys[:, 1], keys[:, 0], doc))
                doc, number, keys = doc[order], number[order], keys[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1]).any(1)
                at = np.flatnonzero(fresh)
                lines = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), pa.array(number.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc[at]]), pa.array(keys[at, 0]), pa.array(keys[at, 1]), lines], names=["doc_id", "k1", "k2", "lines"])

    rows = docs.select("doc_id", "text").filter("doc_id is not null")
    return rows.mapInArrow(lean(run), "doc_id long, k1 long, k2 long, lines array<int>")


def reference_counts(rows: DataFrame) -> DataFrame:
    """Exact counts of each key: references, smallest and largest document.  Pre-aggregated before the shuffle."""
    return rows.groupBy("k1", "k2").agg(F.count("*").alias("n_refs"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last_doc"))


def indexed(rows: DataFrame, counts: DataFrame) -> LineIndex:
    """The index of staged postings and counts, its filters made anew."""
    size = counts.agg(F.coalesce(F.sum("n_refs"), F.lit(0)).alias("refs"), F.count(F.when(F.col("owner") < F.col("last_doc"), 1)).alias("keys")).first()
    shards = max(1, -(-size["keys"] // SHARD_KEYS), -(-size["refs"] // SHARD_POSTINGS))
    every = counts.sparkSession.range(shards).select(F.col("id").alias("shard"))
    none = every.select("shard", F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("array<long>").alias("overflow"))
    filters = updated_filters(none, counts.filter("owner < last_doc"), None, shards)
    return LineIndex(rows, counts, staged(filters, "line-filters"), shards)


def build_index(docs: DataFrame, min_chars: int = 10) -> LineIndex:
    rows = staged(postings(docs, min_chars), "line-postings")
    return indexed(rows, staged(reference_counts(rows), "line-counts"))


def followed(index: LineIndex, rows: DataFrame, counts: DataFrame) -> LineIndex:
    """The index with new postings and counts; its filters take in keys that are repeated now and let go those that no longer are."""
    was, now = (x.filter("owner < last_doc").select("k1", "k2") for x in (index.counts, counts))
    added, gone = now.join(was, ["k1", "k2"], "left_anti"), was.join(now, ["k1", "k2"], "left_anti")
    n = now.count()
    if n > 2 * SHARD_KEYS * index.shards:
        return indexed(rows, counts)
    return LineIndex(rows, counts, staged(updated_filters(index.filters, added, gone, index.shards), "line-filters"), index.shards)


def insert_documents(index: LineIndex, docs: DataFrame, min_chars: int = 10) -> LineIndex:
    """Adds documents; only the new postings are aggregated, then merged with the counts."""
    new = staged(postings(docs, min_chars), "line-postings")
    both = index.counts.unionByName(reference_counts(new))
    merged = both.groupBy("k1", "k2").agg(F.sum("n_refs").alias("n_refs"), F.min("owner").alias("owner"), F.max("last_doc").alias("last_doc"))
    return followed(index, staged(index.postings.unionByName(new), "line-postings"), staged(merged, "line-counts"))


def delete_documents(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Takes documents out again: keys they held are counted anew from the postings that remain, others stay."""
    gone = doc_ids.select("doc_id").distinct()
    touched = index.postings.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct()
    rows = staged(index.postings.join(gone, "doc_id", "left_anti"), "line-postings")
    again = reference_counts(rows.join(touched, ["k1", "k2"], "left_semi"))
    counts = index.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(again)
    return followed(index, rows, staged(counts, "line-counts"))


def shard_of(shards: int):
    return F.pmod(F.shiftright("k1", 20), F.lit(shards)).cast("long")


def updated_filters(filters: DataFrame, added: DataFrame, gone: DataFrame | None, shards: int) -> DataFrame:
    """Each shard's cuckoo filter with the keys ``added`` inserted and those ``gone`` deleted; a null filter is made new.

    Filters are kept as shard, slots, overflow; keys reach them in packed form, one row from each group.
    """
    changes = added.select("k1", F.lit(True).alias("new"))
    if gone is not None:
        changes = changes.union(gone.select("k1", F.lit(False)))
    changes = changes.select("k1", "new", shard_of(shards).alias("shard"))
    kinds = pa.schema([("shard", pa.int64()), ("slots", pa.binary()), ("overflow", pa.list_(pa.int64()))])

    def run(old: pa.Table, change: pa.Table) -> pa.Table:
        if not old.num_rows:
            return old
        row = old.to_pylist()[0]
        keys, new = change["k1"].to_numpy(), change["new"].to_numpy()
        if row["slots"] is None:
            cuckoo = CuckooFilter(int(len(keys) * 1.1) + 16)
        else:
            cuckoo = CuckooFilter(1, np.frombuffer(row["slots"], np.uint16).copy(), row["overflow"])
        for k in keys[~new].tolist():
            cuckoo.delete(k)
        cuckoo.insert_many(keys[new])
        return pa.table({"shard": [row["shard"]], "slots": [cuckoo.table.tobytes()], "overflow": [sorted(cuckoo.overflow)]}, schema=kinds)

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(lean_groups(run), "shard long, slots binary, overflow array<long>")


def packed_postings(rows: DataFrame, salts: np.ndarray, gathered: int = GATHERED) -> DataFrame:
    """Postings in blobs by (shard, salt); a shard of many postings has several salts, by the document."""
    shards = len(salts)

    def parcels(held):
        doc, k1, k2, size, lines = (np.concatenate(x) for x in zip(*held, strict=True))
        shard = np.mod(k1 >> 20, shards)
        salt = np.mod((doc * 0x9E3779B1) >> 16, salts[shard])
        order = np.lexsort((salt, shard))
        shard, salt, doc, k1, k2 = (x[order] for x in (shard, salt, doc, k1, k2))
        begin, n = (np.cumsum(size) - size)[order], size[order]
        ends = np.concatenate([[0], np.cumsum(n)])
        lines = lines[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])]
        bounds = edges(shard, salt)
        first = bounds[:-1]
        cut = lambda x, at: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
        cols = [pa.array(shard[first]), pa.array(salt[first]), *[cut(x, bounds) for x in (doc, k1, k2, n.astype(np.int32))], cut(lines.astype(np.int32), ends[bounds])]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "salt", "docs", "k1s", "k2s", "sizes", "lines"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                lines = batch.column(3)
                held.append((*[batch.column(i).to_numpy() for i in range(3)], lines.value_lengths().to_numpy(), lines.flatten().to_numpy()))
                size += batch.num_rows
            if size > gathered:
                yield parcels(held)
                held, size = [], 0
        if held:
            yield parcels(held)

    return rows.select("doc_id", "k1", "k2", "lines").mapInArrow(lean(run), "shard long, salt long, docs binary, k1s binary, k2s binary, sizes binary, lines binary")


def dropped_lines(index: LineIndex) -> DataFrame:
    """doc_id and the sorted numbers of its lines that a document with a smaller id owns.

    Postings meet the filter and the exact keys of their shard: the filter lets only lines through that may be
    repeated, the exact keys and owners then decide.  A shard with many postings, because of a line that very many
    documents hold, is divided by document, and its filter and keys go to each part.  Nothing is sent to all executors
    but one small number for each shard.
    """
    shards = index.shards
    sizes = index.counts.groupBy(shard_of(shards).alias("shard")).agg(F.sum("n_refs").alias("n"))
    salts = np.ones(shards, np.int64)
    for r in sizes.toLocalIterator():
        salts[r["shard"]] = max(1, -(-r["n"] // SHARD_POSTINGS))
    repeated = index.counts.filter("owner < last_doc").select(shard_of(shards).alias("shard"), "k1", "k2", "owner")

    def pack(table: pa.Table) -> pa.Table:
        k1, k2, owner = (table[x].to_numpy() for x in ("k1", "k2", "owner"))
        order = np.lexsort((k2, k1))
        shard = table["shard"][0].as_py()
        keys = np.stack([k1[order], k2[order], owner[order]], 1).tobytes()
        n = int(salts[shard])
        return pa.table([pa.array([shard] * n), pa.array(range(n), pa.int64()), pa.array([keys] * n, pa.binary())], names=["shard", "salt", "keys"])

    exact = repeated.groupBy("shard").applyInArrow(lean_groups(pack), "shard long, salt long, keys binary").join(index.filters, "shard")
    out = pa.schema([("doc_id", pa.int64()), ("lines", pa.list_(pa.int32()))])

    def decide(rows: pa.Table, shard: pa.Table) -> pa.Table:
        if not rows.num_rows or not shard.num_rows:
            return out.empty_table()
        held = shard.to_pylist()[0]
        cuckoo = CuckooFilter(1, np.frombuffer(held["slots"], np.uint16), held["overflow"])
        keys = np.frombuffer(held["keys"], np.int64).reshape(-1, 3)
        doc, k1, k2 = (np.frombuffer(b"".join(rows[x].to_pylist()), np.int64) for x in ("docs", "k1s", "k2s"))
        size, lines = (np.frombuffer(b"".join(rows[x].to_pylist()), np.int32) for x in ("sizes", "lines"))
        may = np.flatnonzero(cuckoo.contains(k1))
        place = np.searchsorted(keys[:, 0], k1[may])
        owner = np.full(len(may), np.iinfo(np.int64).max)
        # keys of equal first halves stand next to each other
        for ahead in range(int(np.diff(edges(keys[:, 0])).max())):
            at = np.minimum(place + ahead, len(keys) - 1)
            same = (keys[at, 0] == k1[may]) & (keys[at, 1] == k2[may])
            owner[same] = keys[at[same], 2]
        hit = may[owner < doc[may]]
        order = hit[np.argsort(doc[hit], kind="stable")]
        n = size[order].astype(np.int64)
        ends = np.cumsum(n)
        flat = lines[np.repeat((np.cumsum(size.astype(np.int64)) - size)[order] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        own = edges(doc[order])
        bounds = np.concatenate([[0], ends])[own]
        return pa.table([pa.array(doc[order][own[:-1]]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))], schema=out)

    packed = packed_postings(index.postings, salts)
    hits = packed.groupBy("shard", "salt").cogroup(exact.groupBy("shard", "salt")).applyInArrow(lean_groups(decide), "doc_id long, lines array<int>")
    return hits.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("drop"))


def remove_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to the documents, in place of columns of these names."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    names = docs.columns
    text = names.index("text")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, drop = batch.column(text).to_pylist(), batch.column(len(names)).to_pylist()
            n_lines, n_dropped, kept = [], [], []
            for t, d in zip(texts, drop, strict=True):
                t = t or ""
                n_lines.append(t.count("\n") + 1)
                n_dropped.append(len(set(d)) if d else 0)
                if d:
                    gone = set(d)
                    t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
                kept.append(t)
            cols = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)] + cols, names=[f"c{i}" for i in range(len(names) + 3)])

    key = names.index("doc_id")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    joined = plain.join(drops.select(F.col("doc_id").alias("drop_id"), "drop").hint("shuffle_hash"), F.col(f"c{key}") == F.col("drop_id"), "left").drop("drop_id")
    kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + list(T.StructType.fromDDL(f"c{len(names)} long, c{len(names) + 1} long, c{len(names) + 2} string")))
    return joined.mapInArrow(lean(run), kinds).toDF(*names, "n_lines", "n_dropped", "kept_text")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Drops lines whose key at least two documents hold, except in the document with the smallest id.

    A key is the line without white space at its ends, ASCII letters lower-cased; keys under ``min_chars``
    code points never count.  All lines of an owner stay, repeats too.  A null text is one empty line; rows
    with the same doc_id, repeated rows among them, are the same document; a row without doc_id keeps its lines.
    Empty table: no rows.  Adds n_lines, n_dropped and kept_text.
    """
    return remove_lines(docs, dropped_lines(build_index(docs, min_chars)))
