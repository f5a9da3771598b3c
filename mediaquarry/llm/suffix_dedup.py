"""Suffix-array dedup: bytes inside long strings that an earlier document holds, by hash-compared suffix sort.

Strings of SPAN bytes are too many to be sorted all.  Each has one anchor, the smallest hash among the grams
inside it, and equal strings have the same anchor at the same place.  So only suffixes around anchors that
several documents share are sorted, each group of equal anchors by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import binary_runs, doc_sums, edges, lean, lean_groups, map_rows, mix, owners, powers, prefix_hash, runs, shuffle_width, span_hash, staged, text_slices

#: Length of a repeated string in bytes, of a gram, grams in such a string, and bytes of the longest segment.
SPAN, GRAM = 50, 20
WINDOW = SPAN - GRAM + 1
WIDE = SPAN + WINDOW - 1
#: Anchors (or segments) a task gathers before it sends them, and bytes of text behind one partition of them.
GATHERED = 400_000
PART_BYTES = 16 << 20
#: Bytes of text whose anchors are found at once.
SLICE = 1 << 20
#: Kinds of segments whose suffixes are sorted at once, and rows of bytes that are compared, marked or filled at once.
SORTED_KINDS, ROWS = 1 << 14, 1 << 16
#: Bits of the map of shared anchors that is sent to all executors (16 MB), and shared anchors it is used for;
#: where there are more, each document gets its own by a join.
MAP_BITS = 27
SENT_HASHES = 16_000_000
#: Different segments around one anchor above which each of its strings is dealt out by its own hash.
HOT_CONTEXTS = 100_000


def anchors(buf: np.ndarray, offs: np.ndarray):
    """Runs of string starts with the same anchor: document, first start, starts in the run, anchor, its hash; and the prefix hashes.

    The anchor is the gram whose hash has the smallest upper half, the first of several.
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none, none.astype(np.uint64), np.zeros(1, np.uint64)
    p = prefix_hash(buf)
    _, inv = powers(n + 1)
    g = mix((p[GRAM:] - p[:-GRAM]) * inv[: n - GRAM + 1])
    low = np.uint64(0xFFFFFFFF)
    v = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    for step in (1, 2, 4, 8, 15):
        v = np.minimum(v[:-step], v[step:])
    inside = np.ones(len(v), bool)
    for end in offs[1:-1].tolist():
        inside[max(0, end - SPAN + 1) : end] = False
    starts = np.flatnonzero(inside)
    a = (v[starts] & low).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    s0, a = starts[first], a[first]
    return np.searchsorted(offs, s0, "right") - 1, s0, np.diff(np.append(first, len(starts))), a, g[a], p


def segment_hash(p: np.ndarray, s0: np.ndarray, count: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Hash of the bytes of a run's strings and of the anchor's place among them."""
    return span_hash(p, s0, s0 + count + SPAN - 1) ^ mix((count | ((a - s0) << 8)).astype(np.uint64))


def joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() or b"" for x in column), kind)


# --- which anchors do several documents share -------------------------------------------------------------


def short(fp: np.ndarray) -> np.ndarray:
    """The upper 48 bits of anchor hashes; equal ones are candidates, no more."""
    return fp >> np.uint64(16)


def places(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def bit_map(blobs) -> np.ndarray:
    """The map with a bit set for each hash; up to one in eight others may look shared too, which only costs work."""
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for b in blobs:
        at = np.unique(places(np.frombuffer(b, np.uint64)))
        first = edges(at >> 3)[:-1]
        if len(first):
            out[at[first] >> 3] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)
    return out


def dealt(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by partition, and where each one's items begin."""
    order = np.argsort(p, kind="stable")
    return order, edges(p[order])


def shared_hashes(docs: DataFrame, parts: int, hot_contexts: int) -> DataFrame:
    """Short hashes of anchors that at least two rows hold (hot: with over ``hot_contexts`` different segments), in blobs.

    A task sends each hash once: a word of the hash, a bit if two of its documents hold it, and the number of
    different segments around it.  So a passage in very many documents sends one word from each task.
    """

    def parcels(doc: np.ndarray, fp: np.ndarray, seg: np.ndarray):
        order = np.argsort(fp)
        group = edges(fp[order])
        doc = doc[order]
        many = np.minimum.reduceat(doc, group[:-1]) != np.maximum.reduceat(doc, group[:-1])
        contexts = np.unique((fp << np.uint64(16)) | (seg >> np.uint64(48))) >> np.uint64(16)
        different = np.minimum(np.diff(edges(contexts)), 0x7FFF).astype(np.uint64)
        distinct = fp[order][group[:-1]]
        words = (distinct << np.uint64(16)) | (many.astype(np.uint64) << np.uint64(15)) | different
        p = (distinct % np.uint64(parts)).astype(np.int64)
        by, bounds = dealt(p)
        return pa.RecordBatch.from_arrays([pa.array(p[by][bounds[:-1]].astype(np.int32)), binary_runs(words[by], bounds)], names=["p", "words"])

    def send(batches):
        held, size, rows = [], 0, 0
        for batch in batches:
            for _, n, buf, offs in text_slices(batch, limit=SLICE):
                doc, s0, count, a, fp, p = anchors(buf, offs)
                held.append((doc + rows, short(fp), segment_hash(p, s0, count, a)))
                rows += n
                size += len(fp)
                if size > GATHERED:
                    yield parcels(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield parcels(*map(np.concatenate, zip(*held, strict=True)))

    def meet(table: pa.Table) -> pa.Table:
        words = np.sort(joined(table["words"], np.uint64))
        fp = words >> np.uint64(16)
        group = edges(fp)
        sure = np.bitwise_or.reduceat(words & np.uint64(0x8000), group[:-1]) > 0
        contexts = np.add.reduceat((words & np.uint64(0x7FFF)).astype(np.int64), group[:-1])
        fp, shared = fp[group[:-1]], sure | (np.diff(group) > 1)
        found = [fp[shared & ~(contexts > hot_contexts)], fp[shared & (contexts > hot_contexts)]]
        return pa.table({"hot": [False, True], "fps": pa.array([x.tobytes() for x in found], pa.binary())})

    return docs.select("text").mapInArrow(lean(send), "p int, words binary").groupBy("p").applyInArrow(lean_groups(meet), "hot boolean, fps binary")


SHARED = "p int, docs binary, keys binary, fps binary, answered boolean"


def anchor_parts(doc: np.ndarray, key: np.ndarray, fp: np.ndarray, parts: int) -> list[pa.RecordBatch]:
    """Rows for the partitions of a gathered set of (document, text key, anchor hash).

    A hash that two documents of the set hold is answered at once; a single row (key 0, no answer wanted)
    tells the others.  So a passage in very many documents sends one row from each task.
    """
    order = np.lexsort((key, doc, fp))
    doc, key, fp = doc[order], key[order], fp[order]
    keep = edges(fp, doc, key)[:-1]
    doc, key, fp = doc[keep], key[keep], fp[keep]
    group = edges(fp)
    size = np.diff(group)
    local = np.repeat(doc[group[:-1]] != doc[group[1:] - 1], size)
    head = np.zeros(len(fp), bool)
    head[group[:-1]] = True
    ask, tell = ~local, local & head
    out = []
    for mask, answered, p in ((ask | tell, False, (fp % np.uint64(parts)).astype(np.int64)), (local, True, np.mod(doc, parts))):
        d, k, f, q = doc[mask], np.where(ask[mask], key[mask], 0) if not answered else key[mask], fp[mask], p[mask]
        if not answered:
            k = np.where(ask[mask], k | 1, 0)
        order = np.argsort(q, kind="stable")
        bounds = edges(q[order])
        cols = [pa.array(q[order][bounds[:-1]].astype(np.int32)), *[binary_runs(x[order], bounds) for x in (d, k, f)], pa.array(np.full(len(bounds) - 1, answered))]
        out.append(pa.RecordBatch.from_arrays(cols, names=["p", "docs", "keys", "fps", "answered"]))
    return out


def shared_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, tkey and hashes of the document's anchors that another document holds too."""

    def send(batches):
        held, size = [], 0
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
            for i, _, buf, offs in text_slices(batch, limit=SLICE):
                doc, _, _, _, fp, _ = anchors(buf, offs)
                held.append((ids[i + doc], keys[i + doc], fp))
                size += len(fp)
                if size > GATHERED:
                    yield from anchor_parts(*map(np.concatenate, zip(*held, strict=True)), parts)
                    held, size = [], 0
        if size:
            yield from anchor_parts(*map(np.concatenate, zip(*held, strict=True)), parts)

    def answer(table: pa.Table) -> pa.Table:
        done = table.filter(table["answered"])
        doc, key, fp = (joined(done[x], k) for x, k in (("docs", np.int64), ("keys", np.int64), ("fps", np.uint64)))
        rest = table.filter(pa.compute.invert(table["answered"]))
        d, k, f = (joined(rest[x], t) for x, t in (("docs", np.int64), ("keys", np.int64), ("fps", np.uint64)))
        order = np.lexsort((d, f))
        d, k, f = d[order], k[order], f[order]
        group = edges(f)
        if len(f):
            told = np.logical_or.reduceat(k == 0, group[:-1])
            many = told | (d[group[:-1]] != d[group[1:] - 1])
            mask = np.repeat(many, np.diff(group)) & (k != 0)
            doc, key, fp = np.append(doc, d[mask]), np.append(key, k[mask]), np.append(fp, f[mask])
        order = np.lexsort((fp, key, doc))
        doc, key, fp = doc[order], key[order] | 1, fp[order]
        bounds = edges(doc, key)
        at = bounds[:-1]
        return pa.table({"doc_id": doc[at], "tkey": key[at], "fps": binary_runs(fp, bounds)})

    return docs.mapInArrow(lean(send), SHARED).groupBy("p").applyInArrow(lean_groups(answer), "doc_id long, tkey long, fps binary")


# --- which strings around them are repeated -----------------------------------------------------------------

SEGMENTS = "p int, docs binary, keys binary, fps binary, hashes binary, starts binary, shapes binary, bytes binary"


def chunks(at: np.ndarray) -> list[np.ndarray]:
    """The places in parts of about ROWS, so that what is made of their bytes stays small."""
    return np.array_split(at, 1 + len(at) // ROWS)


def gathered(held: list[tuple]) -> list[np.ndarray]:
    """The columns of what was held, one after another; each is let go of once it is copied."""
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    out = []
    while columns:
        out.append(np.concatenate(columns.pop(0)))
    return out


def filled(size: np.ndarray) -> np.ndarray:
    """Which of the WIDE bytes of a row belong to its segment."""
    return np.arange(WIDE) < size[:, None]


def segment_rows(buf: np.ndarray, s0: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of segments, each in a row of WIDE bytes filled up with zeros."""
    rows = np.lib.stride_tricks.sliding_window_view(np.append(buf, np.zeros(WIDE, np.uint8)), WIDE)[s0]
    rows *= filled(size)
    return rows


def split_hot(runs_, hot: np.ndarray, p: np.ndarray):
    """The runs (document, first start, starts, anchor, hash), those of hot anchors as one run for each string.

    Equal strings of a hot anchor still meet, under the hash of the string in place of the anchor's.
    """
    doc, s0, count, a, fp = runs_
    if not hot.any():
        return runs_
    row = np.repeat(np.flatnonzero(hot), count[hot])
    start = np.concatenate([np.arange(x, x + c) for x, c in zip(s0[hot].tolist(), count[hot].tolist(), strict=True)])
    one = doc[row], start, np.ones_like(row), a[row], span_hash(p, start, start + SPAN)
    return tuple(np.append(x[~hot], y) for x, y in zip(runs_, one, strict=True))


def byte_ranges(doc, key, start, end):
    """Ranges by document, those that touch or overlap merged."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    own = edges(doc, key)
    base = np.repeat(np.arange(len(own) - 1) << 40, np.diff(own))
    reach = np.maximum.accumulate(base + end)
    fresh = np.ones(len(start), bool)
    fresh[1:] = base[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return doc[first], key[first], start[first], (reach - base)[last] if len(first) else end


def packed_ranges(doc, key, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array((start.astype(np.int64) << 32) | end.astype(np.int64))], names=["doc_id", "tkey", "range"])


def segment_parts(doc, key, fp, h, s0, shape, rows, parts: int) -> list[pa.RecordBatch]:
    """Rows for the partitions of a gathered set of segments (the bytes of all strings of one anchor).

    Of equal segments in the set only those of the smallest document are sent; the others, once their bytes are
    compared, are repeated as a whole: their ranges come along with no hash, for the last step alone.
    """
    order = np.lexsort((doc, fp ^ mix(h)))
    tie = (fp ^ mix(h))[order]
    group = edges(tie)
    head = np.empty(len(doc), np.int64)
    head[order] = np.repeat(order[group[:-1]], np.diff(group))
    settled = doc[head] < doc
    for at in chunks(np.flatnonzero(settled)):
        settled[at] = (rows[at] == rows[head[at]]).all(1) & (shape[at] == shape[head[at]]) & (fp[at] == fp[head[at]])
    d, k, s, e = byte_ranges(doc[settled], key[settled], s0[settled], (s0 + (shape & 255) + SPAN - 1)[settled])
    names = ["p", "docs", "keys", "fps", "hashes", "starts", "shapes", "bytes"]
    out = []
    for mine, p in ((np.flatnonzero(~settled), None), (None, np.mod(d, parts))):
        if p is None:
            p = (fp[mine] % np.uint64(parts)).astype(np.int64)
        by, bounds = dealt(p)
        if mine is not None:
            x = mine[by]
            size = (shape[x] & 255).astype(np.int64) + SPAN - 1
            ends = np.concatenate([[0], np.cumsum(size)])
            cols = [binary_runs(v, bounds) for v in (doc[x], key[x], fp[x], h[x], s0[x].astype(np.uint32), shape[x].astype(np.uint16))]
            cols.append(binary_runs(np.concatenate([rows[x[:0]].ravel(), *[rows[x[i]][filled(size[i])] for i in chunks(np.arange(len(x)))]]), ends[bounds]))
        else:
            none = pa.array([b""] * (len(bounds) - 1), pa.binary())
            cols = [binary_runs(d[by], bounds), binary_runs(k[by], bounds), none, none, binary_runs(np.stack([s[by], e[by]], 1).astype(np.uint32).ravel().view(np.uint64), bounds), none, none]
        out.append(pa.RecordBatch.from_arrays([pa.array(p[by][bounds[:-1]].astype(np.int32)), *cols], names=names))
    return out


def common_length(p: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int = SPAN) -> np.ndarray:
    """Length of the common beginning of the suffixes at a and b, up to ``limit``: binary search over prefix hashes."""
    _, inv = powers(len(p))
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit)
    for _ in range(int(limit).bit_length()):
        mid = (low + high + 1) >> 1
        same = (p[a + mid] - p[a]) * inv[a] == (p[b + mid] - p[b]) * inv[b]
        low = np.where(same, mid, low)
        high = np.where(same, high, np.maximum(mid - 1, low))
    return low


def suffix_less(buf: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Is the suffix at a before that at b, and are both equal, by their first SPAN bytes."""
    n = common_length(p, a, b)
    equal = n >= SPAN
    k = np.minimum(n, SPAN - 1)
    return ~equal & (buf[a + k] < buf[b + k]), equal


def sort_suffixes(buf: np.ndarray, p: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of suffixes inside each group (groups lie one after another): mergesort, all merges of a level at once.

    An element's place in a merged run is its own rank plus the number of elements before it in the
    neighbouring run, found by binary search with logarithmic comparisons of suffixes.
    """
    order = np.arange(len(starts))
    size = np.diff(group)
    base = np.repeat(group[:-1], size)
    total = np.repeat(size, size)
    rank = order - base
    width = 1
    while width < (size.max() if len(size) else 0):
        block = rank // width
        other = (block ^ 1) * width
        live = np.flatnonzero(other < total)
        mine = starts[order[live]]
        low = other[live]
        high = np.minimum(low + width, total[live])
        begin = low.copy()
        left = (block[live] & 1) == 0
        for _ in range(int(width).bit_length()):
            open_ = low < high
            mid = np.where(open_, (low + high) >> 1, begin)
            there = starts[order[base[live] + mid]]
            less, equal = suffix_less(buf, p, there, mine)
            before = open_ & (less | (equal & ~left))
            low = np.where(before, mid + 1, low)
            high = np.where(open_ & ~before, mid, high)
        moved = base[live] + (block[live] & ~1) * width + rank[live] - block[live] * width + low - begin
        new = order.copy()
        new[moved] = order[live]
        order = new
        width *= 2
    return order


def repeated_strings(doc, fp, h, shape, rows) -> np.ndarray:
    """For each segment a bit mask of its strings that start in a smaller document too.

    Equal segments (by hash, then by bytes) are one kind.  Strings of kinds around the same anchor are put into
    buckets by their place before it and their first and last eight bytes, and each bucket's suffixes are
    sorted; equal neighbours are compared byte by byte.
    """
    n = len(doc)
    if not n:
        return np.zeros(0, np.uint32)
    count = (shape & 255).astype(np.int64)
    tie = fp ^ mix(h)
    order = np.lexsort((doc, tie))
    same = edges(tie[order])
    kind = np.empty(n, np.int64)
    kind[order] = np.repeat(np.arange(len(same) - 1), np.diff(same))
    first = order[same[:-1]]
    head = first[kind]
    at = np.flatnonzero(head != np.arange(n))
    bad = np.concatenate([at[:0], *[x[(rows[x] != rows[head[x]]).any(1) | (shape[x] != shape[head[x]]) | (fp[x] != fp[head[x]])] for x in np.array_split(at, 1 + len(at) // ROWS)]])
    kind[bad] = len(first) + np.arange(len(bad))
    first = np.append(first, bad)
    by = np.argsort(fp[first])
    group = edges(fp[first][by])
    many = by[np.repeat(np.diff(group) > 1, np.diff(group))]
    mask = np.zeros(len(first))
    for x in anchor_sets(many, fp[first], SORTED_KINDS):
        found = suffix_groups(doc[first[x]], fp[first[x]], shape[first[x]], rows[first[x]])
        mask[x] = found
    every = (np.int64(1) << count) - 1
    return np.where(doc > doc[first[kind]], every, mask[kind].astype(np.int64)).astype(np.uint32)


def anchor_sets(kinds: np.ndarray, fp: np.ndarray, size: int):
    """Runs of about ``size`` kinds that do not part those of one anchor; ``kinds`` is sorted by anchor."""
    bounds = edges(fp[kinds])
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        yield kinds[bounds[i] : bounds[j]]
        i = j


def suffix_groups(doc, fp, shape, rows) -> np.ndarray:
    """For each kind a bit mask of its strings that a smaller document's kind of the same anchor holds too."""
    n = len(doc)
    buf = rows.ravel()
    count = (shape & 255).astype(np.int64)
    row = np.repeat(np.arange(n), count)
    w = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = (shape[row] >> 8).astype(np.int64) - w
    starts = row * WIDE + w
    eight = np.ndarray((len(buf) - 7,), "<u8", buf.data, 0, (1,))
    bucket = mix(fp[row] + mix(place.astype(np.uint64) + np.uint64(11))) ^ mix(eight[starts] * np.uint64(0x9E3779B97F4A7C15) + mix(eight[starts + SPAN - 8]))
    order = np.argsort(bucket)
    size = np.diff(edges(bucket[order]))
    order = order[np.repeat(size > 1, size)]
    row, w, starts = row[order], w[order], starts[order]
    groups = np.append(0, np.cumsum(size[size > 1]))
    out = np.zeros(n)
    if not len(row):
        return out
    p = prefix_hash(buf)
    sorted_ = sort_suffixes(buf, p, starts, groups)
    row, w, starts = row[sorted_], w[sorted_], starts[sorted_]
    new = np.zeros(len(row), bool)
    new[groups[:-1]] = True
    a, b = starts[:-1], starts[1:]
    equal = (common_length(p, a, b) >= SPAN) & ~new[1:]
    strings = np.lib.stride_tricks.sliding_window_view(buf, SPAN)
    inner = np.flatnonzero(equal)
    for x in np.array_split(inner, 1 + len(inner) // ROWS):
        equal[x] = (strings[a[x]] == strings[b[x]]).all(1)
    # hashes of buckets may meet: an equal string is one at the same place around the same anchor
    q, r = row[:-1], row[1:]
    equal &= (fp[q] == fp[r]) & ((shape[q] >> 8).astype(np.int64) - w[:-1] == (shape[r] >> 8).astype(np.int64) - w[1:])
    new[1:] |= ~equal
    runs_ = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(doc[row], runs_), np.diff(np.append(runs_, len(row))))
    return np.bincount(row, (low < doc[row]) * np.exp2(w), n)


def marked_ranges(start: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first and last byte (exclusive) of each run of marked strings."""
    out = []
    for part in chunks(np.arange(len(mask))):
        bits = ((mask[part, None] >> np.arange(WINDOW + 1, dtype=np.uint32)) & 1).astype(np.int8)
        change = np.diff(bits, axis=1, prepend=0)
        row, at = np.nonzero(change == 1)
        _, end = np.nonzero(change == -1)
        row = part[row]
        out.append((row, start[row] + at, start[row] + end + SPAN - 1))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def repeated_ranges(docs: DataFrame, shared: DataFrame | np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """doc_id, tkey and range: start and end of bytes under repeated strings, packed into a number.

    shared: the bit map of shared anchors, or a table of each document's own; hot: sorted short hashes.  One row
    for each repeated segment that crossed the shuffle, however many partitions there are; what one task
    settled itself comes merged.
    """
    rows, known = docs.select("doc_id", "tkey", "text"), None
    if isinstance(shared, np.ndarray):
        known = shared
    else:
        wanted = shared.groupBy("doc_id", "tkey").agg(F.collect_list("fps").alias("fps"))
        rows = docs.join(wanted, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "fps")

    def chosen(fp, csr, lists, i, n):
        if known is not None:
            at = places(short(fp))
            return (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        keep = np.zeros(len(fp), bool)
        for k in np.flatnonzero(np.diff(csr)).tolist():
            mine = slice(csr[k], csr[k + 1])
            keep[mine] = np.isin(fp[mine], np.frombuffer(b"".join(lists[i + k].as_py()), np.uint64))
        return keep

    def send(batches):
        held, size = [], 0
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
            lists = None if known is not None else batch.column(3)
            for i, n, buf, offs in text_slices(batch, limit=SLICE):
                *found, p = anchors(buf, offs)
                keep = chosen(found[-1], np.searchsorted(found[0], np.arange(n + 1)), lists, i, n)
                found = tuple(x[keep] for x in found)
                doc, s0, count, a, fp = split_hot(found, np.isin(short(found[-1]), hot), p)
                if not len(doc):
                    continue
                held.append((ids[i + doc], keys[i + doc], fp, segment_hash(p, s0, count, a), s0 - offs[doc], count | ((a - s0) << 8), segment_rows(buf, s0, count + SPAN - 1)))
                size += len(fp)
                if size > GATHERED:
                    yield from segment_parts(*gathered(held), parts)
                    size = 0
        if size:
            yield from segment_parts(*gathered(held), parts)

    def answer(table: pa.Table) -> pa.Table:
        settled = pa.compute.equal(pa.compute.binary_length(table["fps"]), 0)
        done = table.filter(settled)
        doc, key, span = (joined(done[x], k) for x, k in (("docs", np.int64), ("keys", np.int64), ("starts", np.uint32)))
        span = span.reshape(-1, 2).astype(np.int64)
        rest = table.filter(pa.compute.invert(settled))
        d, k, f, h, s, c = (joined(rest[x], t) for x, t in (("docs", np.int64), ("keys", np.int64), ("fps", np.uint64), ("hashes", np.uint64), ("starts", np.uint32), ("shapes", np.uint16)))
        size = (c & 255).astype(np.int64) + SPAN - 1
        ends, data = np.concatenate([[0], np.cumsum(size)]), joined(rest["bytes"], np.uint8)
        segments = np.zeros((len(size), WIDE), np.uint8)
        for part in chunks(np.arange(len(size))):
            if len(part):
                segments[part[0] : part[-1] + 1][filled(size[part])] = data[ends[part[0]] : ends[part[-1] + 1]]
        del data
        row, start, end = marked_ranges(s.astype(np.int64), repeated_strings(d, f, h, c, segments))
        return pa.Table.from_batches([packed_ranges(np.append(doc, d[row]), np.append(key, k[row]), np.append(span[:, 0], start), np.append(span[:, 1], end))])

    return rows.mapInArrow(lean(send), SEGMENTS).groupBy("p").applyInArrow(lean_groups(answer), "doc_id long, tkey long, range long")


def removed_mask(buf: np.ndarray, offs: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which bytes lie in a document's ranges."""
    packed = lists.flatten().to_numpy(zero_copy_only=False)
    size = lists.value_lengths().fill_null(0).to_numpy()
    base = np.repeat(offs[:-1], size)
    change = np.bincount(base + (packed >> 32), minlength=len(buf) + 1) - np.bincount(base + (packed & 0xFFFFFFFF), minlength=len(buf) + 1)
    return np.cumsum(change[: len(buf)]) > 0


def dedup_spans(docs: DataFrame, sent_hashes: int = SENT_HASHES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Adds n_bytes, n_removed, spans (byte ranges removed) and kept (the remaining bytes) to the documents.

    A byte goes if a string of SPAN bytes over it also starts in a document with a smaller doc_id, judged on
    the input.  A map of up to ``sent_hashes`` shared anchors is sent to all executors; where there are more, each
    document gets its own by a join, at the price of one more shuffle of the texts.  Strings of anchors with over
    ``hot_contexts`` different segments are dealt out by their own hashes, so no task gets all of a frequent phrase.

    Repeats inside one document stay, as do all copies in the smallest document.  A null text is empty; rows
    with the same doc_id, repeated rows among them, are one document to each other; rows without doc_id are
    left alone.  Empty table: no rows.  Columns of the added names are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "spans", "kept")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).bitwiseOR(F.lit(1)).alias("tkey"), text.alias("text"))
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(shuffle_width(docs.sparkSession), -(-total // PART_BYTES))
    hashes = staged(shared_hashes(keyed, parts, hot_contexts), "shared-anchors")
    n_shared = hashes.agg(F.coalesce(F.sum(F.octet_length("fps")), F.lit(0)).alias("n")).first()["n"] // 8
    # a hot anchor has hot_contexts segments, so there is one for each few megabytes of text at most
    hot = np.sort(joined(hashes.filter("hot").select("fps").toArrow()["fps"], np.uint64))
    if n_shared <= sent_hashes:
        shared = bit_map(bytes(r["fps"]) for r in hashes.select("fps").toLocalIterator())
    else:
        shared = shared_anchors(keyed, parts)
    ranges = repeated_ranges(keyed, shared, hot, parts)
    ranges = ranges.groupBy("doc_id", "tkey").agg(F.collect_list("range").alias("ranges"))
    ranges = ranges.select(F.col("doc_id").alias("m_id"), F.col("tkey").alias("m_key"), "ranges")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = F.col(f"c{names.index('doc_id')}"), F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))
    both = plain.join(ranges, (own[0] == F.col("m_id")) & (F.xxhash64(own[1]).bitwiseOR(F.lit(1)) == F.col("m_key")), "left").drop("m_id", "m_key")
    both = both.withColumnRenamed(f"c{names.index('text')}", "text")
    at = len(names)

    def run(batch):
        out = []
        for i, n, buf, offs in text_slices(batch):
            gone = removed_mask(buf, offs, batch.column(at).slice(i, n))
            starts, ends, csr = runs(gone, offs)
            doc = owners(csr)
            pairs = pa.StructArray.from_arrays([pa.array(starts - offs[doc]), pa.array(ends - offs[doc])], names=["start", "end"])
            left = np.concatenate([[0], np.cumsum(~gone)])
            spans = pa.ListArray.from_arrays(pa.array(csr.astype(np.int32)), pairs)
            out.append((pa.array(np.diff(offs)), pa.array(doc_sums(gone.astype(np.int64), offs)), spans, binary_runs(buf[~gone], left[offs])))
        return [pa.concat_arrays(x) for x in zip(*out, strict=True)]

    out = map_rows(both, "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary", run)
    new = out.columns[-4:]
    return out.select(*[F.col("text" if n == "text" else f"c{i}").alias(n) for i, n in enumerate(names)], *new)
