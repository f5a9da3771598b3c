"""File sources, codecs and streams that end, on small folders."""

import hashlib
import json

import pytest

from mediaquarry.functions.records import canonical, lenient, number_text
from mediaquarry.sources import files
from mediaquarry.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 20)
    (tmp_path / "two.png").write_bytes(b"")
    (tmp_path / "x.json").write_text('{"k": 1, "more": "text"}')
    return tmp_path


def test_walk_and_quarantine(spark, folder):
    assert files.walk(spark, str(folder)).count() == 2  # Spark's reader passes over empty files
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["quarantine"]) for r in files.quarantine(files.with_content(spark, str(folder))).collect()}
    assert got == {"one.txt": ("png", None), "x.json": (None, "unknown_format")}
    short = spark.createDataFrame([("p", 0, bytearray(b""))], "path string, length long, content binary")
    assert files.quarantine(short).first()["quarantine"] == "zero_bytes"


def test_verified(spark, folder):
    path, body = f"file:{folder}/x.json", (folder / "x.json").read_bytes()
    rows = [(path, len(body), hashlib.sha256(body).hexdigest()), (path, len(body), "0"), (path, 1, "0"), ("none", 1, "0")]
    got = files.verified(files.with_content(spark, str(folder)), spark.createDataFrame(rows, "path string, byte_size long, sha256 string"))
    assert sorted(str(r["unreadable"]) for r in got.collect()) == ["None", "digest", "missing", "size"]


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out, state = (tmp_path / x for x in ("in", "out", "state"))
    src.mkdir()
    run = lambda: ingest.run_available(ingest.new_files(spark, str(src), "id long"), str(state), ingest.write_batch(str(out)))
    (src / "1.json").write_text("\n".join(json.dumps({"id": i}) for i in range(5)))
    assert run() == 1 and run() == 0
    (src / "2.json").write_text(json.dumps({"id": 9}))
    assert run() == 1
    assert sorted(r["id"] for r in spark.read.parquet(str(out)).collect()) == [0, 1, 2, 3, 4, 9]


def test_late_members(spark):
    stored = spark.createDataFrame([("s", 1), ("s", 3)], "span_key string, member int")
    got = ingest.merge_members(stored, spark.createDataFrame([("s", 2), ("s", 3)], "span_key string, member int")).first()
    assert (got["members"], got["first_member"], got["complete"]) == (3, 1, True)


@pytest.mark.parametrize("x,text", [(1.0, "1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (-0.0, "0"), (123.456, "123.456"), (7, "7"), (-2.5, "-2.5"), (1.25e30, "1.25e+30")])
def test_number_text(x, text):
    assert number_text(x) == text


def test_canonical_sorts_and_keeps_text():
    assert canonical({"b": [1.0, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[1,null,true]}'


@pytest.mark.parametrize("text,status", [('x {"a": "}"} y', "ok"), ('{"a": [1,]}', "repaired"), ('{"a":1,"a":2}', "duplicate_key"), ("{", "unbalanced"), (None, "no_object"), ("{a}", "malformed")])
def test_lenient(text, status):
    assert lenient(text)[0] == status
