"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

The patterns are windows of consecutive words, so their prefixes are runs of words of the items.  A state is a
depth and a group of rows of the sorted item positions; dropping the first word of a run gives another such run,
which is where its failure link goes.  The automaton is a few numpy arrays that all workers read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import alnum_table, lean, lower_table, owners, prefix_hash, runs, span_hash, staged, text_slices

#: Words of benchmark text in one automaton (107 bytes each, measured on 1.2 million words); a larger benchmark is split
#: over several, scanned one after another.
AUTOMATON_WORDS = 1 << 20
#: Bytes of text scanned at once, and stretches of a slice that walk through the automaton side by side.
SLICE, LANES = 4 << 20, 4096

FOUND = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of the normalised words, and each document's first word (CSR)."""
    starts, ends, csr = runs(alnum_table()[buf], offs)
    return span_hash(prefix_hash(lower_table()[buf]), starts, ends), starts, ends, csr


class Automaton:
    """Aho-Corasick automaton over the word numbers of benchmark items; a state is (depth, first row of its group).

    ``words`` holds all items, a 0 before each and after the last; number 1 is the first word of the vocabulary.
    Row r stands for the run of words from ``order[r]`` on; rows are sorted by their first ``width`` words, so the
    rows that share the first d words are the group from ``start[d][r]`` to ``end[d][start[d][r]]``.
    """

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width = width
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], names=["text"])
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, buf, offs in text_slices(batch):
            h, _, _, csr = word_hashes(buf, offs)
            hashes.append(h)
            sizes.append(np.diff(csr))
        h, size = np.concatenate(hashes), np.concatenate(sizes)
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        self.vocabulary, back = np.unique(h, return_inverse=True)
        self.words = np.insert(back.astype(np.int32) + 1, np.cumsum(size) - size, 0) if len(size) else np.zeros(0, np.int32)
        self.words = np.append(self.words, np.zeros(width + 1, np.int32))
        begin = np.cumsum(size + 1) - size
        n = len(self.words) - width - 1
        item = np.repeat(np.arange(len(size)), size + 1)
        self.holder = np.array([number[i] for i, _ in items], np.int32)[item] if len(items) else np.zeros(0, np.int32)
        # positions sorted by their first words, one more word in each round
        group = self.words[:n].astype(np.int64)
        starts = [np.zeros(n, np.int32)]
        columns = [group]
        for d in range(1, width):
            _, group = np.unique(group * (len(self.vocabulary) + 2) + self.words[d : n + d], return_inverse=True)
            columns.append(group)
        self.order = np.argsort(group, kind="stable").astype(np.int32)
        self.row = np.empty(n, np.int32)
        self.row[self.order] = np.arange(n, dtype=np.int32)
        for column in columns:
            fresh = np.ones(n, bool)
            fresh[1:] = np.diff(column[self.order]) != 0
            starts.append(np.maximum.accumulate(np.where(fresh, np.arange(n), 0)).astype(np.int32))
        self.start = np.stack(starts) if n else np.zeros((width + 1, 0), np.int32)
        self.end = np.full_like(self.start, n)
        for line, end in zip(self.start, self.end, strict=True):
            first = np.flatnonzero(np.diff(line, prepend=-1))
            end[first[:-1]] = first[1:]
        # windows of the full width end inside their item; a shorter item is a window as a whole
        reach = np.repeat(begin + size, size + 1)
        whole = np.zeros(n, bool)
        short = np.flatnonzero((size > 0) & (size < width))
        whole[begin[short]] = True
        at = np.arange(n)
        inside = self.words[:n] > 0
        self.full = inside & (at + width <= reach)
        self.short = {int(m): np.unique(self.start[m][self.row[begin[short[size[short] == m]]]]) for m in np.unique(size[short])}
        self.whole_of = {int(m): begin[short[size[short] == m]] for m in np.unique(size[short])}
        self.first_row = np.searchsorted(self.words[self.order], np.arange(len(self.vocabulary) + 2)).astype(np.int32)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Word numbers from 1; -1 for words that no item holds."""
        if not len(self.vocabulary):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, -1).astype(np.int32)

    def step(self, depth: np.ndarray, row: np.ndarray, word: np.ndarray) -> None:
        """Moves all lanes by one word, along failure links where there is no edge."""
        live = np.flatnonzero((word > 0) | (depth > 0))
        at_end = live[depth[live] == self.width]
        self.fail(depth, row, at_end)
        while len(live):
            d, x = depth[live], word[live]
            found = x > 0
            low = np.where(d == 0, self.first_row[np.maximum(x, 0)], row[live]).astype(np.int64)
            high = np.where(d == 0, low, self.end[d, row[live]])
            inner = np.flatnonzero(found & (d > 0))
            if len(inner):
                lo, hi, di, xi = low[inner], high[inner].copy(), d[inner], x[inner]
                while (open_ := lo < hi).any():
                    mid = (lo + hi) >> 1
                    less = open_ & (self.words[self.order[np.minimum(mid, len(self.order) - 1)] + di] < xi)
                    lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
                there = np.minimum(lo, len(self.order) - 1)
                found[inner] = (lo < high[inner]) & (self.words[self.order[there] + di] == xi)
                low[inner] = lo
            went = live[found]
            row[went] = low[found]
            depth[went] += 1
            live = live[~found]
            stop = depth[live] == 0
            live = live[~stop]
            self.fail(depth, row, live)

    def fail(self, depth: np.ndarray, row: np.ndarray, lanes: np.ndarray) -> None:
        d = depth[lanes] - 1
        row[lanes] = self.suffix(row[lanes], d, 1)
        depth[lanes] = d

    def suffix(self, row: np.ndarray, length: np.ndarray, drop) -> np.ndarray:
        """First row of the group of the run that is left when the first ``drop`` words go."""
        return np.where(length > 0, self.start[length, self.row[self.order[row] + np.where(length > 0, drop, 0)]], 0)

    def scan(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Depth and row after each word: stretches are walked side by side, each from ``width`` words before its own."""
        n = len(words)
        size = max(4 * self.width, -(-n // LANES))
        lanes = -(-n // size)
        padded = np.concatenate([np.full(self.width, -1, np.int32), words, np.full(lanes * size - n, -1, np.int32)])
        depths, rows = np.zeros((size, lanes), np.int8), np.zeros((size, lanes), np.int32)
        depth, row = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        at = np.arange(lanes) * size
        for k in range(size + self.width):
            self.step(depth, row, padded[at + k])
            if k >= self.width:
                depths[k - self.width], rows[k - self.width] = depth, row
        return depths.T.ravel()[:n].astype(np.int64), rows.T.ravel()[:n].astype(np.int64)

    def matches(self, words: np.ndarray):
        """Yields (last word, number of words, holders) of the windows that occur, grouped by window."""
        depth, row = self.scan(words)
        hits = [(self.width, np.flatnonzero(depth == self.width), None)]
        for m, known in self.short.items():
            at = np.flatnonzero(depth >= m)
            group = self.suffix(row[at], np.full(len(at), m), depth[at] - m)
            hits.append((m, at[np.isin(group, known)], group[np.isin(group, known)]))
        for m, at, group in hits:
            group = row[at] if group is None else group
            by = np.argsort(group, kind="stable")
            first, begin = np.unique(group[by], return_index=True)
            for g, ends in zip(first.tolist(), np.split(at[by], begin[1:]), strict=False):
                places = self.order[g : self.end[m, g]]
                places = places[self.full[places]] if m == self.width else np.intersect1d(places, self.whole_of[m])
                if len(places):
                    yield ends, m, np.unique(self.holder[places])


def scan_slice(automaton: Automaton, buf: np.ndarray, offs: np.ndarray):
    """For each document of a slice: words, mask of hit words, items, and hit runs in code points of the text."""
    h, starts, ends, csr = word_hashes(buf, offs)
    n = len(offs) - 1
    cover = np.zeros(len(h) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    if automaton.names and len(h):
        # an unknown word between documents keeps matches within one; position p then stands for word p - document
        words = np.insert(automaton.numbers(h), csr[1:-1], -1)
        doc = np.insert(owners(csr), csr[1:-1], -1)
        for last, size, holders in automaton.matches(words):
            names = [automaton.names[k] for k in holders.tolist()]
            mine = doc[last]
            np.add.at(cover, last - mine - size + 1, 1)
            np.add.at(cover, last - mine + 1, -1)
            for k in np.unique(mine).tolist():
                items[k].update(names)
    hit = np.cumsum(cover[:-1]) > 0
    spans: list[list[dict]] = [[] for _ in range(n)]
    for doc in (k for k in range(n) if items[k]):
        a, b = csr[doc], csr[doc + 1]
        mine = hit[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
        lead = np.cumsum((buf[offs[doc] : offs[doc + 1]] & 0xC0) != 0x80)
        for x, y in zip(edge[::2], edge[1::2], strict=True):
            p, q = starts[a + x] - offs[doc], ends[a + y - 1] - offs[doc]
            spans[doc].append({"start": int(lead[p]) - 1, "end": int(lead[q - 1])})
    total = np.concatenate([[0], np.cumsum(hit)])
    return np.diff(csr), total[csr[1:]] - total[csr[:-1]], items, spans


def merge_spans(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(a + b, key=lambda x: (x["start"], x["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Adds n_words, n_hit, item_ids and spans to the documents.

    A word is a run of ASCII letters, digits and code points from 128 up, ASCII letters lower-cased.  Every run
    of ``width`` consecutive words of an item is a pattern, as is a whole item of fewer words.  Spans are the
    maximal runs of hit words as code point offsets into the original text.  The scan is a map over whole
    texts: no shuffle, and a hot source or item costs nothing extra.  The benchmark is counted first; up to
    ``automaton_words`` words of it make one automaton, beyond that parts are scanned in turn.

    Null texts have no words; null item ids count as empty strings; without items nothing is hit.  Repeated rows
    each get their own answer, repeated items count as one.  Empty table: no rows.  Columns of the added names
    are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "item_ids", "spans")
    words = F.size(F.split("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    size = benchmark.agg(F.coalesce(F.sum(F.when(F.col("text").isNotNull(), words)), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(size) // automaton_words))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    state = docs
    for part in range(parts):
        chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        state = _scan(state, Automaton([tuple(r) for r in chosen.toLocalIterator()], width), docs, part)
        if part < parts - 1:
            state = staged(state, "decontamination")
    return state


def _scan(state: DataFrame, automaton: Automaton, docs: DataFrame, part: int) -> DataFrame:
    names = docs.columns

    def run(batches):
        for batch in batches:
            n_words, n_hit, found, places = [], [], [], []
            for _, _, buf, offs in text_slices(batch, limit=SLICE):
                words, hits, items, spans = scan_slice(automaton, buf, offs)
                n_words.append(words)
                n_hit.append(hits)
                found += items
                places += spans
            if not batch.num_rows:
                continue
            words = np.concatenate(n_words)
            if part:
                found = [x | set(y) for x, y in zip(found, batch.column(len(names) + 2).to_pylist(), strict=True)]
                places = [merge_spans(x, y) for x, y in zip(places, batch.column(len(names) + 3).to_pylist(), strict=True)]
                hits = np.array([hit_words(t, s) for t, s in zip(batch.column(names.index("text")).to_pylist(), places, strict=True)])
            else:
                hits = np.concatenate(n_hit)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(places, span)]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)] + cols, names=[f"c{i}" for i in range(len(names) + 4)])

    kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField(f"c{len(names) + i}", f.dataType) for i, f in enumerate(T.StructType.fromDDL(FOUND))])
    return state.mapInArrow(lean(run), kinds).toDF(*names, "n_words", "n_hit", "item_ids", "spans")


def hit_words(text: str | None, spans: list[dict]) -> int:
    """Words of a text that lie in the given spans."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    lead = np.cumsum((raw & 0xC0) != 0x80)
    starts, _, _ = runs(alnum_table()[raw], np.array([0, len(raw)]))
    at = lead[starts] - 1
    return sum(int(((at >= s["start"]) & (at < s["end"])).sum()) for s in spans)
