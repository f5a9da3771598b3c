"""LM scoring: a Brown class bigram model; exchange clustering assigns words to classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import binary_runs, crc_mod, dense_counts, edges, lower_table, mix, owners, prefix_hash, runs, space_table, span_hash, staged, text_slices

#: Rows with this remainder of crc32(doc_id) modulo FOLDS are held out.
FOLDS, HELD_OUT = 7, 2
#: Words that the exchange on the driver starts with, and kinds of beginnings and ends that stand for rare words.
OWN_WORDS, KINDS = 1024, 1024
#: Every word seen this often in training takes part in the exchange; executors hold all of them.
CLASSED_COUNT = 10
#: Word classes; words whose counts every executor holds (a bound, the others are joined); sweeps of the exchange
#: among the first words, and half sweeps among all.
CLASSES, HELD_WORDS, SWEEPS, HALF_SWEEPS = 48, 1 << 18, 8, 2
#: Key of the end of a text.
END = 1
#: A packed count of a class beside a symbol.
CELL = np.dtype([("cell", "u1"), ("c", "<u4")])


def held_out():
    return F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))


def tokens(buf: np.ndarray, offs: np.ndarray):
    """Keys and kinds of all tokens of a slice, each text followed by its end, and each text's first token (CSR)."""
    low = lower_table()[buf]
    starts, ends, csr = runs(space_table()[buf], offs)
    h = span_hash(prefix_hash(low), starts, ends).view(np.int64)
    two = np.minimum(ends - starts, 2) - 1
    edge = low[starts].astype(np.uint64)
    for x in (low[starts + two], low[ends - 1 - two], low[ends - 1]):
        edge = edge * np.uint64(256) + x
    kind = (mix(edge + np.uint64(5)) % np.uint64(KINDS)).astype(np.int64)
    return np.insert(h, csr[1:], END), np.insert(kind, csr[1:], 0), csr + np.arange(len(csr))


def word_counts(docs: DataFrame, gathered: int = 4_000_000) -> DataFrame:
    """Exact counts of all tokens: h, kind, c.  Workers add up a few million tokens before they send any."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, buf, offs in text_slices(batch):
                h, kind, _ = tokens(buf, offs)
                held.append(_distinct(h, kind, np.ones(len(h), np.int64)))
                size += len(held[-1][0])
                if size > gathered:
                    held = [_distinct(*map(np.concatenate, zip(*held, strict=True)))]
                    yield _counted(*held.pop())
                    size = 0
        if held:
            yield _counted(*_distinct(*map(np.concatenate, zip(*held, strict=True))))

    rows = docs.select("text").mapInArrow(run, "h long, kind int, c long")
    return rows.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))


def _distinct(h, kind, c):
    keys, first, back = np.unique(h, return_index=True, return_inverse=True)
    return keys, kind[first], np.bincount(back, c, len(keys)).astype(np.int64)


def _counted(h, kind, c):
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(kind.astype(np.int32)), pa.array(c)], names=["h", "kind", "c"])


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(joint: np.ndarray) -> float:
    """The part of the bigram log-likelihood that depends on the classes."""
    return float(xlogx(joint).sum() - xlogx(joint.sum(0)).sum() - xlogx(joint.sum(1)).sum())


def exchange_gains(joint: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What the likelihood gains, for each symbol and class, when the symbol alone is put into the class from none.

    joint: counts of classes after classes; right, left: how often each class stands after and before the symbol;
    own: how often it follows itself; of: its class.  The last class, the end's, takes no symbol.
    """
    n, classes = len(of), len(joint) - 1
    i, k = np.arange(n), np.arange(classes)
    right, left = right.astype(np.float64), left.astype(np.float64)
    right[i, of] -= own
    left[i, of] -= own
    without = np.repeat(joint[None], n, 0)
    without[i, of] -= right
    without[i, :, of] -= left
    without[i, of, of] -= own
    plain = xlogx(without)
    rows = (xlogx(without + right[:, None]) - plain)[:, :classes]
    cols = (xlogx(without + left[:, :, None]) - plain)[:, :, :classes]
    diagonal = without[:, k, k]
    gain = rows.sum(2) - rows[:, k, k] + cols.sum(1) - cols[:, k, k] + xlogx(diagonal + right[:, :classes] + left[:, :classes] + own[:, None]) - xlogx(diagonal)
    # whatever its class, the symbol comes after those before it and before those after it
    after, before = (without.sum(2) + left)[:, :classes], (without.sum(1) + right)[:, :classes]
    gain -= xlogx(after + (right.sum(1) + own)[:, None]) - xlogx(after) + xlogx(before + (left.sum(1) + own)[:, None]) - xlogx(before)
    return gain


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Exchange clustering of symbols: each in turn moves to the class that raises the bigram likelihood most.

    ``pairs[a, b]`` counts b after a; the last symbol, the end, keeps a class of its own, number ``classes``.
    """
    n = len(pairs)
    freq = pairs.sum(0)
    order = np.argsort(-freq[:-1], kind="stable")
    of = np.full(n, classes)
    of[order] = np.arange(n - 1) % classes
    one_hot = np.eye(classes + 1)[of]
    right, left = pairs @ one_hot, pairs.T @ one_hot
    joint = one_hot.T @ right
    live = order[freq[order] > 0]
    for _ in range(sweeps):
        moved = 0
        for w in live.tolist():
            g, own = int(of[w]), pairs[w, w]
            gain = exchange_gains(joint, right[w : w + 1], left[w : w + 1], pairs[w : w + 1, w], of[w : w + 1])[0]
            best = int(np.argmax(gain))
            if gain[best] <= gain[g] + 1e-9:
                continue
            moved += 1
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            r[g] -= own
            l[g] -= own
            for k, sign in ((g, -1), (best, 1)):
                joint[k] += sign * r
                joint[:, k] += sign * l
                joint[k, k] += sign * own
            of[w] = best
            right[:, g] -= pairs[:, w]
            right[:, best] += pairs[:, w]
            left[:, g] -= pairs[w]
            left[:, best] += pairs[w]
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """Log10 tables of the model and the counts that every executor holds."""

    n: int
    v: int
    held: np.ndarray  # sorted keys of the commoner words
    held_count: np.ndarray
    held_symbol: np.ndarray  # symbol of each, or -1 where its kind stands for it
    step: np.ndarray  # log10 P(class | class before)
    of: np.ndarray  # class of each symbol
    emit: np.ndarray  # log10 P(symbol | class)
    rest: np.ndarray  # of each kind: log10 of 1 / (its tokens + 1)
    unknown: np.ndarray  # of each kind: log10 of the share left to unknown words
    discount: float
    words: int  # words that are symbols; after them come the kinds and the end

    def symbols(self, h: np.ndarray, kind: np.ndarray):
        """Symbol of each token, its place among the held words, and whether it is one of them."""
        at = np.minimum(np.searchsorted(self.held, h), max(0, len(self.held) - 1))
        found = self.held[at] == h if len(self.held) else np.zeros(len(h), bool)
        symbol = self.words + kind
        if len(self.held):
            symbol = np.where(found & (self.held_symbol[at] >= 0), self.held_symbol[at], symbol)
        symbol[h == END] = self.words + KINDS
        return symbol, at, found

    def before(self, symbol: np.ndarray, csr: np.ndarray) -> np.ndarray:
        out = np.empty_like(symbol)
        out[1:] = symbol[:-1]
        out[csr[:-1]] = self.words + KINDS
        return out


def train(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model and the table of all counts (h, kind, c), learned from all documents that are not held out."""
    rows = docs.filter(~held_out())
    counts = staged(word_counts(rows), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the least count at which the held words stay within their bound, from a histogram of magnitudes
    level = F.floor(F.log2("c") * 16).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    cut, size = max(sizes, default=0) + 1, 0
    while cut > 0 and size + sizes.get(cut - 1, 0) <= HELD_WORDS:
        cut -= 1
        size += sizes.get(cut, 0)
    held = counts.filter((level >= cut) | (F.col("c") >= CLASSED_COUNT)).toArrow().sort_by("h")
    h, kind, c = (held[x].to_numpy().astype(np.int64) for x in ("h", "kind", "c"))
    ranked = np.lexsort((h, -c))
    ranked = ranked[h[ranked] != END]
    # the words with a class, those that the exchange starts with first
    words = ranked[c[ranked] >= CLASSED_COUNT]
    own = words[:OWN_WORDS]
    stats = counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
    by = np.zeros((4, KINDS))
    for r in stats.collect():
        by[:, r["kind"]] = r["n"], r["v"], r["n1"], r["n2"]
    gone = np.concatenate([words, np.flatnonzero(h == END)])
    for line, x in zip(by, (c, np.ones_like(c), c == 1, c == 2), strict=True):
        np.subtract.at(line, kind[gone], x[gone])
    discount = float(np.clip(by[2].sum() / max(1.0, by[2].sum() + 2 * by[3].sum()), 0.1, 0.9))
    nothing = np.zeros(0)

    def model_of(chosen: np.ndarray) -> ClassModel:
        symbol = np.full(len(h), -1, np.int32)
        symbol[chosen] = np.arange(len(chosen))
        return ClassModel(total["n"], total["v"], h, c, symbol, nothing, nothing, nothing, -np.log10(by[0] + 1), np.log10((discount * by[1] + 1) / (by[0] + 1)), discount, len(chosen))

    model = model_of(words)
    stream = staged(symbol_stream(rows.select("text"), model), "symbols")
    # the exchange among the first words and the kinds; other words go by their kind
    first = len(own)
    core = np.concatenate([np.arange(first), first + kind[words[first:]], first + np.arange(KINDS + 1)])
    pairs = symbol_pairs(stream, core)
    start = exchange(pairs, CLASSES, SWEEPS)
    model.of = start[core]
    one_hot = np.eye(CLASSES + 1)[start]
    assign(stream, model, first, one_hot.T @ pairs @ one_hot)
    joint = symbol_pairs(stream, model.of)
    for half in range(HALF_SWEEPS):
        moved = exchanged(stream, model, joint, half % 2)
        after = symbol_pairs(stream, moved)
        if likelihood(after) > likelihood(joint):
            model.of, joint = moved, after
    freq = np.concatenate([c[words], by[0], c[h == END] if (h == END).any() else [0]]).astype(np.float64)
    prior = (joint.sum(0) + 1) / (joint.sum() + CLASSES + 1)
    model.step = np.log10((joint + 5 * prior) / (joint.sum(1, keepdims=True) + 5))
    members, mass = (np.bincount(model.of, x, CLASSES + 1) for x in (np.ones(len(freq)), freq))
    model.emit = np.log10((freq + 0.1) / (mass + 0.1 * members)[model.of])
    return model, counts


def symbol_stream(texts: DataFrame, model: ClassModel) -> DataFrame:
    """The symbols of many texts in a row, each text followed by its end, as blobs of 32-bit numbers."""

    def run(batches):
        for batch in batches:
            for _, _, buf, offs in text_slices(batch):
                h, kind, _ = tokens(buf, offs)
                yield pa.RecordBatch.from_arrays([pa.array([model.symbols(h, kind)[0].astype(np.int32).tobytes()], pa.binary())], names=["symbols"])

    return texts.mapInArrow(run, "symbols binary")


def read_stream(batch: pa.RecordBatch, end: int):
    """Yields the symbols of each blob and the symbol before each."""
    for x in batch.column(0):
        symbol = np.frombuffer(x.as_py(), np.int32).astype(np.int64)
        yield symbol, np.concatenate([[end], symbol[:-1]])


def symbol_pairs(stream: DataFrame, label: np.ndarray) -> np.ndarray:
    """How often the label of a symbol (the columns) comes after that of another (the rows)."""
    size, end = int(label.max()) + 1, len(label) - 1

    def add(table, batch):
        for symbol, before in read_stream(batch, end):
            table += np.bincount(label[before] * size + label[symbol], minlength=size * size)

    return dense_counts(stream, size * size, add).reshape(size, size).astype(np.float64)


def context_counts(stream: DataFrame, of: np.ndarray, chosen: np.ndarray, gathered: int = 4_000_000) -> DataFrame:
    """symbol and cells of the chosen symbols: how often each class stands before (cell = class) and after
    (CLASSES + 1 + class) it, and how often it follows itself (the last cell).  A task sends one packed row for each symbol."""
    span, end = 2 * (CLASSES + 1) + 1, len(of) - 1

    def summed(held):
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def sent(keys, n):
        symbol = keys // span
        own = edges(symbol)
        cells = np.zeros(len(keys), CELL)
        cells["cell"], cells["c"] = keys % span, n
        return pa.RecordBatch.from_arrays([pa.array(symbol[own[:-1]].astype(np.int32)), binary_runs(cells.view(np.uint8).reshape(-1, CELL.itemsize), own)], names=["symbol", "cells"])

    def run(batches):
        raw, held = [], []
        for batch in batches:
            for symbol, before in read_stream(batch, end):
                at, prior, twice = chosen[symbol], chosen[before], chosen[symbol] & (symbol == before)
                raw += [symbol[at] * span + of[before[at]], before[prior] * span + CLASSES + 1 + of[symbol[prior]], symbol[twice] * span + span - 1]
                if sum(map(len, raw)) > gathered:
                    held.append(np.unique(np.concatenate(raw), return_counts=True))
                    raw = []
                if sum(len(k) for k, _ in held) > 2 * gathered:
                    held = [summed(held)]
                    if len(held[0][0]) > gathered:
                        yield sent(*held.pop())
        if raw:
            held.append(np.unique(np.concatenate(raw), return_counts=True))
        if held:
            yield sent(*summed(held))

    return stream.mapInArrow(run, "symbol int, cells binary").groupBy("symbol").agg(F.collect_list("cells").alias("cells"))


def context_tables(batch: pa.RecordBatch, rows: int = 256):
    """Yields symbols and their (symbol x cell) tables, a few at a time."""
    span = 2 * (CLASSES + 1) + 1
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        lists = part.column(1)
        blobs = lists.flatten().to_pylist()
        cells = np.frombuffer(b"".join(blobs), CELL)
        row = np.repeat(np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), [len(x) // CELL.itemsize for x in blobs])
        yield part.column(0).to_numpy(), np.bincount(row * span + cells["cell"], cells["c"], part.num_rows * span).reshape(-1, span)


def assign(stream: DataFrame, model: ClassModel, first: int, joint: np.ndarray) -> None:
    """Sets the class of each word from ``first`` on to that under which its own class bigrams are likeliest.

    The likelihood of a word's tokens in class g is P(g | class before) P(word | g) P(class after | g); what does
    not depend on g is left out.  ``joint`` counts classes after classes; the end's class takes no word.
    """
    if model.words <= first:
        return
    share = joint + 5 * np.outer(joint.sum(1) + 1, joint.sum(0) + 1) / (joint.sum() + CLASSES + 1) / (CLASSES + 1)
    of = np.log(share / share.sum(0))[:, :CLASSES]
    after = np.log(share / share.sum(1, keepdims=True)).T[:, :CLASSES]
    gains = np.concatenate([of, after])

    def best(batches):
        for batch in batches:
            for symbol, table in context_tables(batch):
                yield pa.RecordBatch.from_arrays([pa.array(symbol), pa.array(np.argmax(table[:, :-1] @ gains, 1).astype(np.int32))], names=["symbol", "class"])

    at = np.arange(len(model.of))
    take(model.of, context_counts(stream, model.of, (at >= first) & (at < model.words)).mapInArrow(best, "symbol int, class int"))


def exchanged(stream: DataFrame, model: ClassModel, joint: np.ndarray, half: int) -> np.ndarray:
    """Classes after half a sweep of the exchange among all symbols but the end.

    All symbols of a half move at once, each to the class that raises the likelihood most while the others stay, so
    the work is spread over the symbols.  Moving halves in turn keeps them from changing places with each other.
    """

    def best(batches):
        for batch in batches:
            for symbol, table in context_tables(batch):
                now = model.of[symbol]
                left, right = table[:, : CLASSES + 1], table[:, CLASSES + 1 : -1]
                gain = exchange_gains(joint, right, left, table[:, -1], now)
                to = np.argmax(gain, 1)
                to = np.where(gain[np.arange(len(to)), to] > gain[np.arange(len(to)), now] + 1e-9, to, now)
                yield pa.RecordBatch.from_arrays([pa.array(symbol), pa.array(to.astype(np.int32))], names=["symbol", "class"])

    at = np.arange(len(model.of))
    chosen = (mix(at.astype(np.uint64) + np.uint64(17)) % np.uint64(2) == half) & (at < len(at) - 1)
    return take(model.of.copy(), context_counts(stream, model.of, chosen).mapInArrow(best, "symbol int, class int"))


def take(of: np.ndarray, chosen: DataFrame) -> np.ndarray:
    """Puts the chosen (symbol, class) rows, a number for each word that executors hold anyway, into ``of``."""
    table = chosen.toArrow()
    of[table["symbol"].to_numpy()] = table["class"].to_numpy()
    return of


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text.

    A token's probability is P(class | class before) * P(symbol | class) * P(word | symbol).  Words
    seen CLASSED_COUNT times are symbols of their own; any rarer word is one of its kind, a hash of its first and
    last two bytes, with an absolutely discounted share of it by its exact count; what is discounted is the share
    of unknown words.  Exchange clustering starts on the driver with the OWN_WORDS commonest and the kinds, each
    other symbol takes the class that its own class bigrams favour, and half sweeps of the exchange then go over all
    symbols, spread over the cluster.  Counts of all words are kept; those of the commoner HELD_WORDS and of all
    symbols travel to the executors, tokens of others are joined with the table.

    A null text is empty: its end alone is scored.  Without training texts every word is unknown.  Repeated rows
    each count and are scored each.  Empty table: no rows.
    """
    model, counts = train(docs)
    base_unknown = -np.log10(model.n + model.v + 1)

    def run(batches):
        for batch in batches:
            for i, n, buf, offs in text_slices(batch, "text"):
                h, kind, csr = tokens(buf, offs)
                doc = owners(csr)
                symbol, at, found = model.symbols(h, kind)
                before = model.before(symbol, csr)
                value = model.step[model.of[before], model.of[symbol]] + model.emit[symbol]
                count = np.where(found, model.held_count[at], 0) if len(model.held) else np.zeros(len(h), np.int64)
                by_kind = (symbol >= model.words) & (symbol < model.words + KINDS)
                k = np.where(by_kind, symbol - model.words, 0)
                part = np.where(count > 0, model.rest[k] + np.log10(np.maximum(count - model.discount, 1e-9)), model.unknown[k])
                value += np.where(by_kind, part, 0)
                base = np.log10(count + 1.0) + base_unknown
                open_ = np.flatnonzero(~found & (h != END)) if model.n else np.zeros(0, np.int64)
                sums = [np.bincount(doc, x, n) for x in (np.ones(len(h)), count > 0, base, value)]
                uid = batch.column(0).slice(i, n)
                held = batch.column(2).slice(i, n)
                head = [uid, batch.column(1).slice(i, n), held, uid, pa.array(np.zeros(n)), *[pa.array(x) for x in sums]]
                nothing = pa.nulls(len(open_), pa.float64())
                tail = [pa.array(uid.to_numpy()[doc[open_]]), pa.nulls(len(open_), pa.int64()), pa.nulls(len(open_), pa.bool_()), pa.array(h[open_]), pa.array(model.rest[kind[open_]] - model.unknown[kind[open_]]), nothing, nothing, nothing, nothing]
                names = ["uid", "doc_id", "held_out", "h", "more", "n_tokens", "n_known", "base", "value"]
                yield pa.RecordBatch.from_arrays(head, names=names)
                if len(open_):
                    yield pa.RecordBatch.from_arrays(tail, names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    parts = rows.mapInArrow(run, "uid long, doc_id long, held_out boolean, h long, more double, n_tokens double, n_known double, base double, value double")
    rare = counts.filter(F.col("h") != END).select(F.col("h").alias("key"), "c")
    joined = parts.join(rare, (F.col("h") == F.col("key")) & F.col("n_tokens").isNull(), "left")
    known = F.col("c").isNotNull()
    out = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").cast("long").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(known, 1.0).otherwise(0.0))).cast("long").alias("n_known"),
        (F.sum("base") + F.sum(F.when(known, F.log10(F.col("c") + 1.0)).otherwise(0.0))).alias("base_score"),
        (F.sum("value") + F.sum(F.when(known, F.col("more") + F.log10(F.col("c") - F.lit(model.discount))).otherwise(0.0))).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
