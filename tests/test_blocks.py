"""Records that span lines and blocks: the block readers against Spark's own whole-file readers, on files cut small."""
import re
import csv
import json
import random

import pytest

from ratingspark.sources import blocks as B
from ratingspark.sources import files as IO

CSV_SCHEMA = "id int, a string, b string"
JSON_SCHEMA = "id int, s string, deep struct<x:array<int>,y:map<string,string>>, `odd name` double"


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _text(rng, long=False):
    parts = ['"', ",", "\n", "\r\n", "é", "word ", "}", "{", "[", "]", "\\", "\\\"", "'", " ", "ß", "\t", ":"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 3000 if long else 40)))


def _rows(seed, n=300):
    rng = random.Random(seed)
    return [(i, _text(rng, i % 60 == 7), None if i % 9 == 0 else _text(rng)) for i in range(n)]


def _write_csv(folder, name, rows, end):
    with open(folder / name, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL if name[0] == "q" else csv.QUOTE_MINIMAL)
        w.writerow(["id", "a", "b"])
        w.writerows([(i, a, "" if b is None else b) for i, a, b in rows])


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_equals_the_multiline_reader(spark, tmp_path, small_blocks, end):
    for i, name in enumerate(["q1.csv", "m2.csv", "q3.csv"]):
        _write_csv(tmp_path, name, _rows(i), end)
    schema = spark.createDataFrame([], CSV_SCHEMA).schema
    path = str(tmp_path)
    mine = B.read_csv_blocks(spark, path, schema)
    assert mine.rdd.getNumPartitions() > 20 > IO.read_csv(spark, path, schema).rdd.getNumPartitions()
    theirs = _sorted(IO.read_csv(spark, path, schema))
    if end == "\r\n":  # Spark's reader rewrites line ends inside such values; this one keeps them, as Python's does
        written = {(i, a) for seed in range(3) for i, a, _ in _rows(seed)}
        assert {(r.id, r.a) for r in mine.collect()} == written
        theirs = sorted(({(i, *(x and x.replace("\r\n", "\n") for x in t)): None for i, *t in theirs}), key=repr)
        assert sorted({(i, *(x and x.replace("\r\n", "\n") for x in t)) for i, *t in _sorted(mine)}, key=repr) == theirs
        return
    assert len(theirs) == 900 and _sorted(mine) == theirs
    assert _sorted(B.read_csv_blocks(spark, path, schema, max_blocks=3)) == theirs  # left to Spark's reader


def test_csv_without_a_final_newline_and_with_blank_lines(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('id,a,b\n1,x,y\n\n2,"p\n\nq",z\n3,"",last')
    (tmp_path / "b.csv").write_text("id,a,b\n")
    (tmp_path / "c.csv").write_text("")
    schema = spark.createDataFrame([], CSV_SCHEMA).schema
    assert _sorted(B.read_csv_blocks(spark, str(tmp_path), schema)) == _sorted(IO.read_csv(spark, str(tmp_path), schema))


def _objects(seed, n=200):
    rng = random.Random(seed)
    return [{"id": i, "s": _text(rng, i % 50 == 3), "deep": {"x": [rng.randint(0, 9) for _ in range(rng.randint(0, 5))], "y": {_text(rng): "v}"}},
             "odd name": None if i % 4 else i / 8} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_equals_the_multiline_reader(spark, tmp_path, small_blocks, indent):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(_objects(i), indent=indent, ensure_ascii=bool(i % 2)), encoding="utf-8")
    (tmp_path / "empty.json").write_text("[\n]\n")
    schema = spark.createDataFrame([], JSON_SCHEMA).schema
    mine = B.read_json_blocks(spark, str(tmp_path), schema)
    assert mine.rdd.getNumPartitions() > 20
    theirs = _sorted(IO.read_json(spark, str(tmp_path), schema, multiline=True))
    assert len(theirs) == 600 and _sorted(mine) == theirs
    assert _sorted(B.read_json_blocks(spark, str(tmp_path), schema, max_blocks=2)) == theirs


def test_a_record_longer_than_many_blocks(spark, tmp_path, small_blocks):
    long = ("line\n" * 4000) + 'end "quoted" } {'
    with open(tmp_path / "a.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerows([("id", "a", "b"), (1, "x", "y"), (2, long, "z"), (3, "p", "q")])
    schema = spark.createDataFrame([], CSV_SCHEMA).schema
    assert _sorted(B.read_csv_blocks(spark, str(tmp_path / "a.csv"), schema)) == [(1, "x", "y"), (2, long, "z"), (3, "p", "q")]
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "s": long.replace("line", "l}{")}, {"id": 2, "s": "t"}]))
    schema = spark.createDataFrame([], "id int, s string").schema
    assert _sorted(B.read_json_blocks(spark, str(tmp_path / "a.json"), schema)) == [(1, long.replace("line", "l}{")), (2, "t")]


def test_written_arrays_are_json(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(50)]
    IO.write_json_arrays(spark.createDataFrame(rows, "id int, s string").repartition(3), str(tmp_path / "out"))
    found = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert all(isinstance(x, list) for x in found) and sorted((o["id"], o["s"]) for x in found for o in x) == rows


def test_long_strings_are_read_in_runs():
    import random
    import time

    rng, plain = random.Random(5), re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
    for _ in range(20_000):
        s = "".join(rng.choice('"\\a{') for _ in range(rng.randint(0, 14)))
        assert B._STRINGS.sub("", s) == plain.sub("", s)
    text = '"' + "a word \\n" * 200_000 + '"'
    best = {p: min(_seconds(time, p, text) for _ in range(3)) for p in (plain, B._STRINGS)}
    assert best[B._STRINGS] * 2 < best[plain]


def _seconds(time, pattern, text):
    start = time.perf_counter()
    assert pattern.sub("", text) == ""
    return time.perf_counter() - start
