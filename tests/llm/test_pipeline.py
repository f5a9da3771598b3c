"""The corpus pipeline stage by stage against what the operators' brute-force versions keep."""

import collections
import shutil

import corpus_pipeline
import pytest
from test_operators import plain_contamination, plain_line_dedup, words

from mediaquarry.llm.textkit import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_hit string, kept_text int, spans string, drop int, tkey string, n_words int, item_ids string"
LINE = "A line that many documents hold."
SAID = "one two three four five six seven eight nine ten eleven twelve"


def row(i, text):
    return (i, text, "en", "a", None if text is None else len(text), 99.0, "mine", 1, "s", 2, "t", 3, "q")


ROWS = [
    row(1, f"{LINE}\nown words of the first one"),
    row(2, LINE),
    row(3, None),
    row(4, ""),
    row(5, " \n\t "),
    row(6, "plain words that go on and on " * 20_000),
    row(7, SAID),
    row(7, SAID),
    row(8, SAID.upper()),
    row(9, "own words and nothing else here"),
    row(9, "the same id but a wholly different text"),
    row(None, SAID),
    row(None, None),
    row(None, LINE),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def plain_packing_faults(rows, ids):
    """What is wrong with the pieces: tokens lost or doubled, sequences with gaps or over their limit."""
    places, tokens = collections.defaultdict(list), collections.Counter()
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        tokens[r["doc_id"]] += r["length"]
    faults = [k for k, v in places.items() if any(a + n != b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) or sum(n for _, n in v) > 1024 or min(v)[0]]
    return faults + [k for k in ids.keys() | tokens.keys() if ids.get(k, 0) != tokens[k]]


def test_each_stage_takes_effect_and_keeps_the_columns(spark):
    where = "/root/testdata/sf0.01"
    docs = documents(spark, where).cache()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    raw, clean, lines, single, pure = [{r["doc_id"]: r["text"] for r in rows} for rows in seen]
    gone = set(raw) - set(clean)
    toxic = {k for k, r in labels.items() if r["toxic"] == 1}
    assert len(gone & toxic) >= 0.8 * len(gone & set(labels)) > 0 and len(gone & toxic) >= 0.7 * len(toxic)
    assert {i: t for i, _, _, t in plain_line_dedup(list(clean.items()))} == lines
    assert len({tuple(words(t)) for t in single.values() if t}) == len([t for t in single.values() if t])
    assert set(pure) <= set(single) <= set(lines) and len(single) < len(lines)
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    hit = {k for k, (_, n, _) in plain_contamination(list(single.items()), items).items() if n}
    assert set(pure) == set(single) - hit and hit
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, where).collect()
    assert plain_packing_faults(packed, {r["doc_id"]: r["doc_tokens"] for r in packed}) == []
    assert {r["doc_id"] for r in packed} == set(pure)


def test_stages_on_awkward_tables(spark, messy):
    where = "/root/testdata/sf0.001"
    first = lambda rows: sorted(((r[0], r[1]) for r in rows), key=repr)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, messy, where)
        assert got.columns == messy.columns
        rows = got.collect()
        assert {tuple(r)[5:] for r in rows} == {ROWS[0][5:]}
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        assert stage(spark, messy.limit(0), where).count() == 0
    kept = first(corpus_pipeline.drop_near_duplicates(spark, messy, where).collect())
    assert kept == first([r for r in ROWS if r[0] != 8])
    assert first(corpus_pipeline.drop_contaminated(spark, messy, where).collect()) == first(ROWS)


def test_lines_of_awkward_tables(spark, messy):
    got = corpus_pipeline.drop_repeated_lines(spark, messy, "").collect()
    want = [(i, None if was is None else kept) for (i, was), kept in zip([r[:2] for r in ROWS], plain_kept(), strict=True)]
    assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(want, key=repr)


def plain_kept():
    """Each row's text without repeated lines, in the order of the rows."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = collections.defaultdict(set)
    for i, t, *_ in ROWS:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders[key(x)].add(i)
    return ["\n".join(x for x in (t or "").split("\n") if i is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i) for i, t, *_ in ROWS]


def test_toxic_rows_of_awkward_tables_go_by_their_text(spark, messy, tmp_path):
    where = tmp_path / "tables"
    where.mkdir()
    shutil.copy("/root/testdata/sf0.01/benchmark.parquet", where)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(where / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, messy, str(where)).count() == len(ROWS)


def test_pack_of_awkward_tables(spark, messy):
    rows = corpus_pipeline.pack(spark, messy, "").collect()
    want = collections.Counter()
    for r in rows:
        want[r["doc_id"]] += r["doc_tokens"] * (r["start"] == 0)
    assert plain_packing_faults(rows, want) == []
    assert sum(r["start"] == 0 for r in rows) == len(ROWS) and corpus_pipeline.pack(spark, messy.limit(0), "").count() == 0


def test_documents_without_id_pass_the_near_dedup(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (None, "one two three four five six"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[0], *rows[2:]], key=repr)
