"""Byte-level BPE over whole columns: each distinct piece is encoded once and then looked up by its hash."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from .textkit import doc_sums, prefix_hash, span_hash, text_slices, worker_cache

#: Pieces that a worker remembers; beyond it the memory starts anew, which costs time and changes nothing.
CACHE_PIECES = 1_000_000


def class_table() -> np.ndarray:
    """Class of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    cache = worker_cache()
    if "bpe_classes" not in cache:
        import regex

        table = np.full(0x110000, 3, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1]) + 1
                table[a:b] = value
        cache["bpe_classes"] = table
    return cache["bpe_classes"]


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the pre-tokeniser's pieces start, and each document's first piece (CSR).

    A run of letters, numbers or other signs is a piece, with one blank before it; of white space before
    something else the last sign stands apart; 's 't 'm 'd 're 've 'll after no blank are pieces.
    """
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = class_table()[points]
    bounds = np.searchsorted(lead, offs)
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    first = bounds[bounds < n]
    fresh[first] = True
    opening = np.zeros(n + 1, bool)
    opening[first] = True
    opening[n] = True
    flag = fresh.copy()
    blank = points == 0x20
    space = kind == 0
    # the last white space before something else in the same document starts a piece
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~opening[1:n])
    flag[last] = True
    flag[last[blank[last]] + 1] = False
    # contractions
    q = np.flatnonzero((points == 0x27) & flag)
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == 1) & ~opening[q + 1]]
    if len(q):
        a = points[q + 1]
        two = q + 2 < n
        b = np.where(two, points[np.minimum(q + 2, n - 1)], 0)
        b[two & opening[np.minimum(q + 2, n)]] = 0
        size = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, 0)
        size[((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))] = 2
        size[(a == ord("l")) & (b == ord("l"))] = 2
        q, size = q[size > 0], size[size > 0]
        flag[q + 1] = False
        end = q + 1 + size
        inside = end[end < n]
        flag[inside[(kind[inside] == 1) & ~opening[inside]]] = True
    chars = np.flatnonzero(flag)
    return lead[chars], np.searchsorted(chars, bounds)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class PieceEncoder:
    """Ids of pieces, remembered by 64-bit hash in one sorted array with a pool of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = tokenizer.model, byte_alphabet()
        added = tokenizer.get_added_tokens_decoder()
        if odd := [t.content for t in added.values() if t.single_word or t.lstrip or t.rstrip]:
            raise ValueError(f"added tokens that take their surroundings into account are not supported: {odd}")
        self.added = {t.content.encode(): i for i, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.find_added = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.clear()

    def starts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like ``piece_starts``, each added token in a text being one piece that cuts the text in two."""
        at, data, place = [], buf.tobytes(), 0
        while self.find_added and (m := self.find_added.search(data, place)):
            end = int(offs[np.searchsorted(offs, m.start(), "right")])
            # what reaches into the next text is no token of this one
            m = m if m.end() <= end else self.find_added.search(data, m.start(), end)
            place = m.end() if m else end
            if m:
                at.append(m.span())
        if not at:
            return piece_starts(buf, offs)
        a, b = np.array(at, np.int64).T
        starts, _ = piece_starts(buf, np.unique(np.concatenate([offs, a, b])))
        token = np.searchsorted(a, starts, "right") - 1
        inside = (token >= 0) & (starts > a[token]) & (starts < b[token])
        starts = starts[~inside]
        return starts, np.searchsorted(starts, offs)

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        tokenize, alphabet = self.model.tokenize, self.alphabet
        ids = [[self.added[p]] if p in self.added else [t.id for t in tokenize(p.decode("latin-1").translate(alphabet))] for p in pieces]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.int32, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(flat)), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.keys, keys), (self.at, at), (self.size, size)))

    def rows(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each piece its row in the memory; unknown pieces are encoded first."""
        ends = np.append(starts[1:], len(buf))
        h = span_hash(prefix_hash(buf), starts, ends)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > CACHE_PIECES:
            self.clear()
        where = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(where, len(self.keys) - 1)] == distinct
        new = np.flatnonzero(~known)
        if len(new):
            data = buf.tobytes()
            f = first[new]
            self._learn(distinct[new], [data[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)])
            where = np.searchsorted(self.keys, distinct)
        return where[back]


def encoder(path: str) -> PieceEncoder:
    cache = worker_cache().setdefault("piece_encoders", {})
    if path not in cache:
        cache[path] = PieceEncoder(path)
    return cache[path]


def token_lengths(batch: pa.RecordBatch, path: str) -> np.ndarray:
    """Number of ids of each row's text."""
    enc, out = encoder(path), np.zeros(batch.num_rows, np.int64)
    for i, n, buf, offs in text_slices(batch):
        starts, csr = enc.starts(buf, offs)
        if len(starts):
            rows = enc.rows(buf, starts)
            out[i : i + n] = doc_sums(enc.size[rows], csr)
    return out


def token_ids(batch: pa.RecordBatch, path: str, end_id: int | None):
    """Yields (first row, ids of a run of rows, offsets): each row's ids, then ``end_id`` if there is one."""
    enc = encoder(path)
    for i, n, buf, offs in text_slices(batch):
        starts, csr = enc.starts(buf, offs)
        rows = enc.rows(buf, starts) if len(starts) else np.zeros(0, np.int64)
        size = enc.size[rows]
        lengths = doc_sums(size, csr)
        more = 0 if end_id is None else 1
        out = np.zeros(n + 1, np.int64)
        np.cumsum(lengths + more, out=out[1:])
        total = int(size.sum())
        begin = np.cumsum(size) - size
        ids = enc.pool[np.repeat(enc.at[rows] - begin, size) + np.arange(total)]
        if more:
            ids = np.insert(ids, np.cumsum(lengths), end_id)
        yield i, ids, out
