"""Each corpus operator against a plain brute-force version, and on awkward tables."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mediaquarry.llm import brown_lm, decontaminate, line_dedup, minhash, packing, quality_classifier, quality_rules, queries, suffix_dedup, textkit, token_counts, toxicity
from mediaquarry.llm.textkit import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, kept_text int, spans string, kept string, c0 int, y int, bands string"
LONG = "The quick brown fox jumps over it. " * 20_000
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, "x", 1, "s", "k", 0, 1, "b")


ROWS = [
    row(1, "A line that many hold.\nOwn line number one."),
    row(2, "own line\n  a LINE that many hold. \n"),
    row(3, None),
    row(4, ""),
    row(5, " \n\t "),
    row(6, LONG),
    row(7, LONG + "and an end"),
    row(8, WORDS),
    row(8, WORDS),
    row(9, WORDS.upper()),
    row(10, "naïve café ÉTÉ 中文 字 ² ½ a'b 's don't\r\n　x", None, None),
    row(11, "A line that many hold.\nA line that many hold.\n\n"),
    row(None, "A line that many hold."),
    row(12, "word " * 60, "fr", "b"),
    row(13, "A line that many hold.", "fr", "b"),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "t"), (2, 0, 1, "t"), (2, 0, 1, "t"), (None, 1, 1, "t"), (6, None, None, "t"), (99, 1, 0, "t")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] or "" for r in small.collect()}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


# --- quality classifier and toxicity ---------------------------------------------------------------


@pytest.mark.parametrize("name,column,least", [("op1_quality_classifier", "quality", 0.95), ("op9_toxicity", "toxic", 0.85)])
def test_classifiers_hold_out_accuracy(spark, name, column, least):
    where = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == r[column] for r in got]) >= least
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)


@pytest.mark.parametrize("name,column,recall,precision", [("op1_quality_classifier", "quality", 0.95, 0.95), ("op9_toxicity", "toxic", 0.8, 0.85)])
def test_classifiers_find_the_held_out_label(spark, name, column, recall, precision):
    where = "/root/testdata/sf0.1"
    rows = queries.queries()[name](spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").filter("held_out").select("predicted", column).collect()
    both = sum(r["predicted"] and r[column] for r in rows)
    assert both >= recall * sum(r[column] for r in rows) > 20 and both >= precision * sum(r["predicted"] for r in rows)


@pytest.mark.parametrize("module,added,fit", [(quality_classifier, quality_classifier.classify, quality_classifier.fit), (toxicity, toxicity.score_toxicity, toxicity.fit)])
def test_scores_are_sums_of_weights(spark, module, added, fit):
    docs, known = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    weights, bias = fit(docs, known)
    got = {r["doc_id"]: r["score"] for r in added(docs, known).collect()}
    used = 0
    for k, t in texts.items():
        raw = np.frombuffer(t.encode(), np.uint8)
        _, index, value = module.features(raw, np.array([0, len(raw)]))
        live = [(float(weights[i]), float(v)) for i, v in zip(index.tolist(), value.tolist(), strict=True) if weights[i] != 0]
        total = sum(w * v for w, v in live) if module is quality_classifier else sum(w for w, _ in live) / math.sqrt(max(1, len(live)))
        used += bool(live)
        assert math.isclose(got[k], 1 / (1 + math.exp(-min(40, max(-40, total + bias)))), rel_tol=1e-6)
    assert used > 10


@pytest.mark.parametrize("run", [quality_classifier.classify, toxicity.score_toxicity])
def test_classifiers_on_awkward_tables(messy, empty, labels, run):
    got = run(messy, labels)
    assert got.columns == [c for c in messy.columns if c != "score"] + ["score"]
    assert got.count() == len(ROWS) and got.filter("score between 0 and 1").count() == len(ROWS)
    assert run(empty, labels).count() == 0
    assert run(messy, labels.limit(0)).count() == len(ROWS)


def test_non_negative_risk_finds_the_marked_feature():
    rng = np.random.default_rng(1)
    noise = lambda: rng.integers(1000, 200_000, 30)
    make = lambda toxic: (0, 0, np.unique(np.append(noise(), [7] * toxic).astype(int)), None)
    w, bias = toxicity.NonNegativePu(0.2, steps=400).fit([make(1) for _ in range(200)], [make(int(k % 5 == 0)) for k in range(1000)])
    assert np.argmax(w) == 7 and w[7] + bias > 0 > bias


# --- language model --------------------------------------------------------------------------------


def test_base_score_and_gain(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, sf_dir).collect()}
    token = {k: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    count = collections.Counter(w for k, v in token.items() if not held[k] for w in v)
    n, v = sum(count.values()), len(count)
    for k, r in got.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(token[k]), sum(w in count for w in token[k]), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in token[k]), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_counts_beyond_the_held_words_are_joined(spark, small, monkeypatch):
    plain = {r["doc_id"]: r for r in brown_lm.score_texts(small).collect()}
    monkeypatch.setattr(brown_lm, "HELD_WORDS", 2000)
    for r in brown_lm.score_texts(small).collect():
        p = plain[r["doc_id"]]
        assert r["n_known"] == p["n_known"] and math.isclose(r["base_score"], p["base_score"], rel_tol=1e-9) and math.isclose(r["score"], p["score"], rel_tol=1e-9)


def test_language_model_on_awkward_tables(messy, empty):
    got = brown_lm.score_texts(messy).collect()
    assert len(got) == len(ROWS)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(math.isfinite(r["score"]) for r in got)
    assert brown_lm.score_texts(empty).count() == 0


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(2)
    pairs = rng.poisson(1.0, (21, 21)).astype(float)
    pairs[:10, 10:20] += 20
    value = lambda of: sum(x * math.log(x / (a * b)) for c in [np.eye(4)[of]] for j in [c.T @ pairs @ c] for i, a in enumerate(j.sum(1)) for k, b in enumerate(j.sum(0)) if (x := j[i, k]) > 0)
    start, end = brown_lm.exchange(pairs, 3, 0), brown_lm.exchange(pairs, 3, 10)
    assert value(end) > value(start) and end[-1] == 3


def test_exchange_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(2.0, (12, 12)).astype(float)
    of = np.append(rng.integers(0, 4, 11), 4)
    hot = np.eye(5)[of]
    value = lambda x: brown_lm.likelihood(np.eye(5)[x].T @ pairs @ np.eye(5)[x])
    gain = brown_lm.exchange_gains(hot.T @ pairs @ hot, (pairs @ hot)[:11], (pairs.T @ hot)[:11], np.diag(pairs)[:11], of[:11])
    for w in range(11):
        for k in range(4):
            moved = of.copy()
            moved[w] = k
            assert math.isclose(gain[w, k] - gain[w, of[w]], value(moved) - value(of), abs_tol=1e-6)


def plain_model(texts, classes):
    """Scores by the definition: counts in dictionaries, the classes given by word, kind or end."""
    key = lambda w: tuple(int(x[0]) for x in brown_lm.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[:2])
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    train = [split(t) for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2]
    count = collections.Counter(w for t in train for w in t)
    kind = {w: key(w)[1] for t in texts.values() for w in split(t)}
    symbol = lambda w: w if count[w] >= brown_lm.CLASSED_COUNT else ("kind", kind[w])
    rare = [(w, c) for w, c in count.items() if c < brown_lm.CLASSED_COUNT]
    n1, n2 = (sum(c == x for _, c in rare) for x in (1, 2))
    discount = min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))
    mass, kinds = collections.Counter(), collections.Counter()
    for w, c in rare:
        mass[kind[w]] += c
        kinds[kind[w]] += 1
    freq = collections.Counter(symbol(w) for t in train for w in t) + collections.Counter(end=len(train))
    joint = np.zeros((brown_lm.CLASSES + 1,) * 2)
    for t in train:
        row = ["end", *map(symbol, t), "end"]
        for a, b in zip(row, row[1:], strict=False):
            joint[classes[a], classes[b]] += 1
    prior = (joint.sum(0) + 1) / (joint.sum() + brown_lm.CLASSES + 1)
    members = collections.Counter(classes.values())
    total = collections.Counter()
    for s, c in freq.items():
        total[classes[s]] += c

    def score(text):
        out, before = 0.0, "end"
        for w in [*split(text), "\n"]:
            s = "end" if w == "\n" else symbol(w)
            a, b = classes[before], classes[s]
            p = (joint[a, b] + 5 * prior[b]) / (joint[a].sum() + 5) * (freq[s] + 0.1) / (total[b] + 0.1 * members[b])
            if s == ("kind", kind.get(w)):
                k = kind[w]
                p *= (count[w] - discount if count[w] else discount * kinds[k] + 1) / (mass[k] + 1)
            out += math.log10(p)
            before = s
        return out

    return score


def test_score_equals_the_definition(small, texts):
    model, counts = brown_lm.train(small)
    symbol = dict(zip(model.held.tolist(), model.held_symbol.tolist(), strict=True))
    classes = {("kind", k): int(model.of[model.words + k]) for k in range(brown_lm.KINDS)} | {"end": int(model.of[-1])}
    for t in texts.values():
        raw = np.frombuffer(lower(t).encode(), np.uint8)
        for w, h in zip(re.findall(r"[^\x20\x09-\x0D]+", lower(t)), brown_lm.tokens(raw, np.array([0, len(raw)]))[0].tolist(), strict=False):
            if symbol.get(h, -1) >= 0:
                classes[w] = int(model.of[symbol[h]])
    assert len(classes) > brown_lm.KINDS + 100
    score = plain_model(texts, classes)
    for r in brown_lm.score_texts(small).collect():
        assert math.isclose(r["score"], score(texts[r["doc_id"]]), rel_tol=1e-9), r["doc_id"]


def test_words_beyond_the_exchange_take_the_class_of_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "OWN_WORDS", 8)
    monkeypatch.setattr(brown_lm, "CLASSES", 6)
    rng = np.random.default_rng(8)
    size = [400] * 4 + [20] * 30
    sides = [rng.permutation(np.repeat([f"{x}{k}" for k in range(34)], size)) for x in "ab"]
    rows = [(k, f"{x} {y}") for k, (x, y) in enumerate(zip(*sides, strict=True))] + [(k, "seldom seen") for k in range(9000, 9003)]
    monkeypatch.setattr(brown_lm, "HALF_SWEEPS", 0)
    model, counts = brown_lm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    key = lambda w: int(brown_lm.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
    symbol = dict(zip(model.held.tolist(), model.held_symbol.tolist(), strict=True))
    often = {r["h"] for r in counts.filter(f"c >= {brown_lm.CLASSED_COUNT}").collect()} - {brown_lm.END}
    assert {k for k, v in symbol.items() if v >= 0} == often and len(often) > 60 and symbol[key("seldom")] == -1
    of = lambda x: {int(model.of[symbol[key(f"{x}{k}")]]) for k in range(34) if key(f"{x}{k}") in often}
    assert not of("a") & of("b")


# --- tokens ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, sf_dir, texts, tokenizer):
    n = np.array([len(e.ids) for e in tokenizer.encode_batch(list(texts.values()), add_special_tokens=False)])
    got = queries.op3_token_counts(spark, sf_dir)
    for r in got.collect():
        at = r["n_tokens"]
        assert (r["n_docs"], r["docs_from"], r["tokens_from"], r["truncated_total"]) == ((n == at).sum(), (n >= at).sum(), n[n >= at].sum(), np.minimum(n, at).sum())
    one = token_counts.at_limit(got, 512).first()
    assert (one["docs_longer"], one["truncated_total"]) == ((n > 512).sum(), np.minimum(n, 512).sum())
    assert token_counts.quantile(got, 0.5).first()[0] == np.sort(n)[math.ceil(len(n) / 2) - 1]


def test_packing(spark, sf_dir, texts, tokenizer):
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [0] for k, t in texts.items()}
    got = queries.op10_packing(spark, sf_dir).collect()
    seen, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]].append((r["start"], r["length"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, v in seen.items():
        assert sum(n for _, n in v) == len(ids[k]) and sorted(v)[0][0] == 0
    for v in filled.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 1024


def test_rows_without_id_are_dealt_to_many_groups(spark):
    rows = [(None, "")] * 300 + [(7, f"text {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), group_docs=20)
    size = collections.Counter((r["doc_id"], r["sequence_id"] >> 32) for r in got.collect())
    assert sum(size.values()) == 600 and len(size) > 50 and max(size.values()) < 60


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 1025, 500)
    order = np.argsort(-size, kind="stable")
    bins, _ = packing.first_fit_decreasing(size, order, 1024)
    room: list[int] = []
    for k in order:
        at = next((b for b, r in enumerate(room) if r >= size[k]), len(room))
        room[at:] = room[at:] or [1024]
        room[at] -= size[k]
        assert bins[k] == at


def test_token_operators_on_awkward_tables(messy, empty, tokenizer):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_counts.token_counts(messy, path).collect()
    want = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS]
    assert sum(r["n_docs"] for r in got) == len(ROWS) and got[0]["tokens_total"] == sum(want)
    assert sum(r["length"] for r in packing.pack(messy, path).collect()) == sum(want) + len(ROWS)
    with_ids = packing.pack(messy.filter("doc_id = 10"), path, with_ids=True).first()
    assert with_ids["ids"] == tokenizer.encode(ROWS[10][1], add_special_tokens=False).ids + [0]
    assert token_counts.token_counts(empty, path).count() == 0 == packing.pack(empty, path).count()


def test_added_tokens_in_texts(spark, tokenizer):
    end = "<|endoftext|>"
    said = ["a b" + end + " c", end, end * 3, " " + end + "\n\n" + end + "it's", "x " + end[:-1], "|>  y" + end, end[:6], end[6:], "é" + end + "é  ", "plain", "", None]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(said)}
    assert 50256 in want[0]
    assert {r["doc_id"]: r["ids"] for r in packing.pack(docs, path, with_ids=True).collect()} == {k: v + [0] for k, v in want.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.lengths(docs, path).collect()} == {k: len(v) for k, v in want.items()}


# --- lines -----------------------------------------------------------------------------------------


def plain_line_dedup(docs):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_on_awkward_tables(messy, empty):
    got = line_dedup.dedup_lines(messy)
    rows = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()), key=repr)
    assert rows == plain_line_dedup([r[:2] for r in ROWS])
    assert line_dedup.dedup_lines(empty).count() == 0


def filter_keys(index):
    """How many keys the filters hold, and whether they hold all repeated keys of the counts."""
    made = {r["shard"]: line_dedup.CuckooFilter(1, np.frombuffer(bytes(r["slots"]), np.uint16), r["overflow"]) for r in index.filters.collect()}
    keys = [r["k1"] for r in index.counts.filter("owner < last_doc").collect()]
    assert len(keys) > 20 and all(made[(k >> 20) % index.shards].contains(np.array([k]))[0] for k in keys)
    return sum(int((f.table != 0).sum()) + len(f.overflow) for f in made.values())


@pytest.mark.parametrize("keys,postings", [(50, 1_000_000), (50_000, 100), (20, 30)])
def test_line_dedup_of_many_shards_gives_the_same(small, texts, monkeypatch, keys, postings):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", keys)
    monkeypatch.setattr(line_dedup, "SHARD_POSTINGS", postings)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(small).collect()), key=repr)
    assert got == plain_line_dedup(list(texts.items()))


def test_line_filters_decide_what_meets_the_exact_keys(small):
    index = line_dedup.build_index(small)
    blind = line_dedup.updated_filters(index.filters, index.counts.limit(0), index.counts.filter("owner < last_doc"), index.shards)
    assert line_dedup.dropped_lines(index).count() > 0 == line_dedup.dropped_lines(line_dedup.LineIndex(index.postings, index.counts, blind, index.shards)).count()


def test_line_dedup_takes_documents_out_again(spark, small, texts):
    half = small.filter("doc_id % 2 = 0")
    index = line_dedup.insert_documents(line_dedup.build_index(small.filter("doc_id % 2 = 1")), half)
    whole = {tuple(r) for r in line_dedup.build_index(small).counts.collect()}
    assert {tuple(r) for r in index.counts.collect()} == whole
    back = line_dedup.delete_documents(index, half)
    alone = line_dedup.build_index(small.filter("doc_id % 2 = 1"))
    assert {tuple(r) for r in back.counts.collect()} == {tuple(r) for r in alone.counts.collect()}
    assert filter_keys(index) == filter_keys(line_dedup.build_index(small)) and filter_keys(back) == filter_keys(alone)
    rows = line_dedup.remove_lines(small.filter("doc_id % 2 = 1"), line_dedup.dropped_lines(back))
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows.collect()), key=repr) == plain_line_dedup([(k, t) for k, t in texts.items() if k % 2])


def test_cuckoo_filter_inserts_and_deletes():
    keys = np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 3000)
    cuckoo = line_dedup.CuckooFilter(2500)
    cuckoo.insert_many(keys[:2300])
    for k in keys[2300:2500].tolist():
        cuckoo.insert(k)
    assert cuckoo.contains(keys[:2500]).all() and cuckoo.contains(keys[2500:]).mean() < 0.05
    for k in keys[:1000].tolist():
        assert cuckoo.delete(k)
    assert cuckoo.contains(keys[1000:2500]).all() and cuckoo.contains(keys[:1000]).mean() < 0.05


# --- quality rules ---------------------------------------------------------------------------------


def test_quality_rules_on_awkward_tables(messy, empty):
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(messy).collect()}
    assert len(got) == len({r[0] for r in ROWS})
    for i, t, *_ in ROWS:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {p + k for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for k in range(3)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[i]["n_symbols"], got[i]["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert got[i]["base_failed"] == (len(w) < 50 or 2 * len(cover) > len(w))
    assert quality_rules.apply_rules(empty).count() == 0


def test_quality_rules_keep_clean_documents(spark):
    where = "/root/testdata/sf0.01"
    got = queries.op5_quality_rules(spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert np.mean([r["kept"] for r in got if r["quality"] == 1]) > 0.97


def test_a_group_s_distribution_changes_verdicts(spark):
    text = lambda k, size: " ".join(f"{'abcdefghij'[(k + j) % 10] * (size - 3)}{j:03d}" for j in range(60))
    rows = [row(k, text(k, 5), "en", "short") for k in range(40)] + [row(100 + k, text(k, 9), "en", "long") for k in range(40)]
    rows += [row(900, text(0, 9), "en", "short"), row(901, text(0, 9), "en", "long"), row(902, text(0, 9), "xx", "few"), row(903, "", "xx", "few")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs).collect()}
    assert [k for k, v in sorted(kept.items()) if not v] == [900, 903]


def test_quality_rules_equal_their_sql_on_large_groups(spark):
    where = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.OP5_SQL).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_quality_rules(spark, where).collect()}
    assert got == want


def test_quality_rules_keep_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", "mine", 3, 5)], "doc_id long, text string, lang string, source string, q_words string, g_c2 int, word_length_high int")
    got = quality_rules.apply_rules(docs).first()
    assert (got["q_words"], got["g_c2"], got["n_words"]) == ("mine", 3, 2) and got["word_length_high"] is None


# --- near-duplicates -------------------------------------------------------------------------------


def test_near_duplicates_equal_brute_force(spark, sf_dir, texts):
    token = {k: words(t) for k, t in texts.items()}
    grams = {k: collections.Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []) for k, w in token.items()}
    df = collections.Counter(g for s in grams.values() for g in s)
    n = sum(1 for s in grams.values() if s)
    idf = {g: 1 + math.log((n + 1) / (c + 1)) / math.log(n + 2) for g, c in df.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if grams[a].keys() & grams[b].keys():
                both = sum(min(grams[a][g], grams[b][g]) * idf[g] for g in grams[a].keys() & grams[b].keys())
                if both >= 0.8 * (sum(c * idf[g] for g, c in grams[a].items()) + sum(c * idf[g] for g, c in grams[b].items()) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    assert {r["doc_id"]: r["class_id"] for r in queries.op6_minhash_dedup(spark, sf_dir).collect()} == {k: find(k) for k in texts}


def test_near_duplicates_on_awkward_tables(messy, empty):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(messy).collect()}
    assert got[9] == got[8] == 8 and got[7] == got[6] == 6 and got[13] == 13
    assert all(got[k] == k for k in (1, 3, 4, 5, 10)) and None not in got
    assert minhash.near_duplicates(empty).count() == 0


def test_different_texts_of_one_id_are_texts_of_their_own(spark):
    say = lambda x: " ".join(f"{x}{k}" for k in range(30))
    rows = [(3, say("a")), (5, say("a") + " end"), (5, say("b")), (5, say("c")), (9, say("c")), (9, say("c")), (7, say("d")), (7, say("e")), (8, say("f"))]
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[5, 3] == 1 and sum(v for (i, _), v in got.items() if i == 5) == 3 and got[3, 3] == got[8, 8] == 1
    assert got[9, 9] == 2 or got[9, 5] == 2
    assert got[7, 7] == 2


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_candidates_sent_or_shuffled_give_the_same(small, monkeypatch, sent):
    plain = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(small).collect()}
    monkeypatch.setattr(minhash, "SENT_IDS", sent)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "SALTS", 5)
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(small).collect()} == plain


def test_links_between_members_that_miss_the_leader(spark):
    base = [f"w{i}" for i in range(300)]
    near = lambda cut: " ".join([f"x{cut}{i}" if i in range(cut, cut + 12) else w for i, w in enumerate(base)])
    rows = [(i, near(20 * i)) for i in range(1, 12)] + [(50, " ".join(base))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["class_id"] for r in got.collect()} == {1}


# --- decontamination -------------------------------------------------------------------------------


def test_contamination_spans_and_awkward_tables(spark, messy, empty):
    items = spark.createDataFrame([("q1", WORDS, 1), ("q2", "line number ONE", 1), ("q3", None, 1), ("q4", "--", 1), ("q1", "six seven", 1)], "item_id string, text string, n_hit int")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(messy, items).collect()}
    assert (got[8]["n_words"], got[8]["n_hit"], got[8]["item_ids"]) == (16, 16, ["q1"]) and got[9]["n_hit"] == 16
    assert got[1]["item_ids"] == ["q2"] and [ROWS[0][1][s["start"] : s["end"]] for s in got[1]["spans"]] == ["line number one"]
    assert got[3]["n_words"] == 0 and got[6]["n_hit"] == 0
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_contamination(messy, items.limit(0)).collect()} == {0}


def plain_contamination(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t or "")
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i or "")
    out = {}
    for i, t in docs:
        w = words(t or "")
        found = [(k, n, windows[tuple(w[k : k + n])]) for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows]
        out[i] = (len(w), len({p for k, n, _ in found for p in range(k, k + n)}), sorted(set().union(*[x for _, _, x in found])))
    return out


def test_contamination_equals_brute_force_on_few_words(spark):
    rng = np.random.default_rng(9)
    say = lambda n, k: " ".join(rng.choice(list("abcdef")[:k], n))
    items = [(f"q{k}", say(int(rng.integers(0, 25)), 2 + k % 4)) for k in range(40)] + [("q1", "a b a"), ("q2", "a b a"), (None, "c c c"), ("q9", None)]
    docs = [(k, say(int(rng.integers(0, 400)), 2 + k % 5)) for k in range(60)] + [(70, items[7][1]), (71, None), (72, "z " * 50 + items[9][1])]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.find_contamination(rows, bench).collect()}
    assert got == plain_contamination(docs, items)


def test_a_split_benchmark_gives_the_same(spark, sf_dir, small):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(str, decontaminate.find_contamination(small, items).drop("text").collect()))
    assert sorted(map(str, decontaminate.find_contamination(small, items, automaton_words=500).drop("text").collect())) == whole


# --- repeated strings ------------------------------------------------------------------------------


def plain_suffix_dedup(docs):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            if i is not None:
                first[b[s : s + 50]] = min(first.get(b[s : s + 50], i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if i is not None and first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup_equals_brute_force(spark, sf_dir, texts):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op8_suffix_dedup(spark, sf_dir).collect()), key=repr)
    assert got == plain_suffix_dedup(list(texts.items()))


def spans_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", [{"sent_hashes": 0}, {"hot_contexts": 0}, {"hot_contexts": 3}])
def test_suffix_dedup_by_join_or_split_anchors_gives_the_same(small, texts, how):
    assert spans_of(suffix_dedup.dedup_spans(small, **how)) == plain_suffix_dedup(list(texts.items()))


def test_suffix_dedup_of_contexts_around_one_phrase(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(k, f"{word()} {word()} a phrase that is always here {word()} {word()} {word()}"[: int(rng.integers(40, 80))]) for k in range(300)]
    rows += [(1000 + k, rows[k][1][: int(rng.integers(50, 80))] + word()) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_suffix_dedup(rows)
    assert sum(r[2] for r in want) > 0
    assert spans_of(suffix_dedup.dedup_spans(docs)) == want == spans_of(suffix_dedup.dedup_spans(docs, hot_contexts=20))


def test_suffix_dedup_on_awkward_tables(messy, empty):
    assert spans_of(suffix_dedup.dedup_spans(messy)) == plain_suffix_dedup([r[:2] for r in ROWS])
    assert suffix_dedup.dedup_spans(empty).count() == 0


def test_unequal_segments_of_equal_hash_stay_apart():
    rows = np.zeros((3, suffix_dedup.WIDE), np.uint8)
    rows[0, :50], rows[1, :50], rows[2, :50] = 97, 98, 97
    one = np.ones(3, np.uint64)
    shape = np.ones(3, np.uint16)
    assert suffix_dedup.repeated_strings(np.array([1, 2, 3]), one, one, shape, rows).tolist() == [0, 0, 1]


def test_suffixes_are_sorted_within_groups():
    rng = np.random.default_rng(6)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 700)
    group = np.array([0, 1, 40, 300, 302, 700])
    order = suffix_dedup.sort_suffixes(buf, suffix_dedup.prefix_hash(buf), starts, group)
    for a, b in zip(group[:-1], group[1:], strict=True):
        got = [buf[s : s + 50].tobytes() for s in starts[order[a:b]]]
        assert got == sorted(got) and sorted(order[a:b]) == list(range(a, b))


def test_suffixes_of_many_kinds_are_sorted_in_little_memory():
    rng, n = np.random.default_rng(3), 40_000
    rows = rng.integers(97, 123, (n, suffix_dedup.WIDE), dtype=np.uint8)
    rows[n // 2 :] = rows[: n // 2]
    rows[n // 2 :, 0] = 65
    rows[:, 31 + suffix_dedup.SPAN - 1 :] = 0
    fp, h = np.tile(np.arange(n // 2), 2).astype(np.uint64) * np.uint64(977), rng.integers(0, 1 << 62, n).astype(np.uint64)
    tracemalloc.start()
    mask = suffix_dedup.repeated_strings(np.arange(n), fp, h, np.full(n, 31 | (30 << 8)), rows)
    row, start, end = suffix_dedup.marked_ranges(np.zeros(n, np.int64), mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row.tolist() == list(range(n // 2, n)) and set(start.tolist()) == {1} and set(end.tolist()) == {80}
    assert peak < 200 << 20


def test_memory_is_given_back_after_a_task():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    size = 0

    def run(batches):
        nonlocal size
        held = [bytearray(b"x" * 60_000) for _ in range(4000)]
        pins.extend(held[::400])
        size = resident()
        yield from batches

    pins = []
    assert list(textkit.lean(run)([1, 2])) == [1, 2] and size - resident() > 100 << 20
    assert textkit.lean_groups(lambda table: table.num_rows)(pa.table({"x": range(300_000)})) == 300_000
