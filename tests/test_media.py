"""The containment match by both ways against plain Python, and how many rows the automaton emits."""
import glob
import os
import random
import re
import shutil

import pytest

from ratingspark.operators import media as MD
from ratingspark.plans.queries import REGISTRY
from ratingspark.session import checkpoint_root, scratch_path
from ratingspark.sources import files as IO


def _case(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcé1") for _ in range(n))
    names = [word(rng.randint(0, 12)) for _ in range(300)] + [None, "", "same", "same"]
    ids = list({word(rng.randint(1, 6)) for _ in range(120)}) + [None, "", "zzz", "a", "a", "same"]
    return ids, names


def _expected(ids, names):
    out = {}
    for x in set(ids):
        out[x] = min((n for n in names if n is not None and x in n), default=None) if x else None
    return out


@pytest.mark.parametrize("bounds", [{}, {"max_ids": 3}, {"max_chars": 5}])
@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_equal_brute_force(spark, seed, bounds):
    ids, names = _case(seed)
    i = spark.createDataFrame([(x,) for x in ids], "id string")
    n = spark.createDataFrame([(x,) for x in names], "name string").repartition(5)
    rows = MD.match_media(i, n, **bounds).collect()
    assert len(rows) == len(set(ids)) and {r.id: r.name for r in rows} == _expected(ids, names)


def test_a_task_emits_at_most_one_row_per_id(spark):
    names = spark.range(5000).selectExpr("concat('talk_', id % 700, '_take_', id % 9) AS name").repartition(4)
    ids = [str(i) for i in range(900)] + ["_take_", "talk"]
    rows = MD.smallest_by_automaton(names, ids).collect()
    assert len(rows) <= 4 * len(ids) and len({r.sub for r in rows}) == 700 + 2
    assert MD.smallest_by_automaton(names, []).count() == 0
    empty = spark.createDataFrame([], "id string")
    assert MD.match_media(empty, names).count() == 0
    assert [tuple(r) for r in MD.match_media(spark.createDataFrame([(7,)], "id int"), names.limit(0)).collect()] == [("7", None)]


def test_media_files_are_made_by_many_tasks(spark, tmp_path):
    pages = [(i, f"https://videos.example.com/talk_{i % 60}_take") for i in range(80)] + [(80, None), (81, "")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(7,), (59,), (60,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    before = set(glob.glob(checkpoint_root(spark).removeprefix("file:") + "/media-*"))
    rows = {r.id: r.name for r in REGISTRY["media_listing"](spark, str(tmp_path)).collect()}
    (folder,) = set(glob.glob(checkpoint_root(spark).removeprefix("file:") + "/media-*")) - before
    files = glob.glob(f"{folder}/media=*/part-*")
    assert len(files) == len(glob.glob(f"{folder}/media=*")) == 60 + 1  # no name: one folder
    assert len({re.search(r"part-(\d+)", f)[1] for f in files}) > 4
    assert set(rows) == {"7", "59", "60"} and "talk_59_" in rows["59"] and "7" in rows["7"] and rows["60"] is None


def _tree(folder):
    """Files below ``folder``, hidden ones too, with their texts."""
    return sorted((os.path.relpath(os.path.join(d, f), folder), open(os.path.join(d, f), "rb").read()) for d, _, fs in os.walk(folder) for f in fs)


def test_media_files_are_as_sparks_writer_makes_them(spark):
    odd = ["a", "b", None, "", "é ü", "a/b", "x=1:2", "50%", "[q]{r}^", "tab\tnew\nline", "'\"\\", "_hidden", ".dot", "a", "a"]
    names = spark.createDataFrame([(x,) for x in odd], "media string")
    ours, sparks = scratch_path(spark, "media"), scratch_path(spark, "media")
    IO.write_media(names, ours)
    names.selectExpr("nullif(media, '') AS media", "'x' AS value").repartition(4, "media").write.partitionBy("media").text(sparks)
    plain = lambda at: sorted((os.path.dirname(p), text) for p, text in _tree(at) if "/part-" in p)
    assert plain(ours) == plain(sparks) and len(plain(ours)) == len(set(odd) - {None})
    assert not [p for p, _ in _tree(ours) if not re.search(r"/part-\d{5}-[^/]*\.txt$|^_SUCCESS$", p)]  # nothing besides, no check sums
    with pytest.raises(FileExistsError):
        IO.write_media(names, ours)


@pytest.mark.parametrize("folders", [1, 7, 80])
def test_listing_gives_the_rows_of_sparks_reader(spark, folders):
    at = scratch_path(spark, "media")
    for i in range(folders):
        for below in ("", f"/in {i}", f"/in {i}/_metadata", f"/in {i}/_off", f"/in {i}/.off", f"/in {i}/k=%2F é"):
            os.makedirs(f"{at}/d{i}{below}", exist_ok=True)
            for name, n in (("a.mp4", 1 + i), ("b.mp4", 0), ("c.mov", 2), (".d.mp4", 3), ("_e.mp4", 4), ("f=1.mp4", 5), ("_g=1.mp4", 5), ("_metadata.mp4", 6), ("h.mp4._COPYING_", 7)):
                with open(f"{at}/d{i}{below}/{name}", "wb") as f:
                    f.write(b"\0" * n)
    os.symlink(f"{at}/d0", f"{at}/link")
    os.symlink(f"{at}/nothing", f"{at}/gone.mp4")
    shutil.copy(f"{at}/d0/a.mp4", f"{at}/top.mp4")
    for glob_, pattern in (("*.mp4", r"([^/]*)$"), ("{a,f=?}.m[!o]*", r"/d(\d+)/"), ("c.mov", r"([^/]*)$")):
        plain = spark.read.format("binaryFile").option("pathGlobFilter", glob_).option("recursiveFileLookup", "true").load(at)
        expected = plain.selectExpr("path", f"regexp_extract(path, r'{pattern}', 1) AS name", "length")
        got = IO.list_media(spark, at, glob_, name_pattern=pattern)
        assert got.schema.names == expected.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in expected.schema]
        assert sorted(got.collect()) == sorted(expected.collect()) != []
        assert sorted(IO.list_media(spark, "file://" + at, glob_, name_pattern=pattern).collect()) == sorted(expected.collect())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        IO.list_media(spark, at + "/none")
    with pytest.raises(FileNotFoundError):
        IO._listed(spark, at + "/none")


def test_tasks_of_a_listing_do_not_grow_with_the_files(spark):
    at = scratch_path(spark, "media")
    IO.write_media(spark.range(300).selectExpr("concat('n', id) AS media"), at)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    try:
        found = IO.list_media(spark, at, "part-*", name_pattern=r"media=([^/]*)/[^/]*$")
        assert found.count() == 300 and found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("piece", [1, 40, 1 << 19])
def test_substrings_that_cannot_be_ids_are_dropped(spark, monkeypatch, piece):
    monkeypatch.setattr(MD, "PIECE", piece)
    rng = random.Random(3)
    ids = sorted({str(rng.randint(0, 99_999_999)) for _ in range(400)} | {"é", "éa", "日本", "\x00", "z" * 300})
    names = [f"talk_{rng.choice(ids)}_日本é{rng.randint(0, 10**9)}_take" for _ in range(500)] + [None, "", "é", "z" * 301]
    i, n = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame([(x,) for x in names], "name string").repartition(3)
    lengths = MD.id_lengths(i)
    assert lengths == sorted({len(x.encode()) for x in ids})
    true = {(x, s) for x in ids for s in names if s and x in s}
    every = {(s[j:k], s) for s in names if s for j in range(len(s)) for k in range(j + 1, len(s) + 1) if len(s[j:k].encode()) in lengths}
    rows = {tuple(r) for r in MD.name_substrings(n, lengths, MD.id_bits(i, len(ids))).collect()}
    assert true <= rows <= every and len(rows - true) < len(every) / 20
    full = {tuple(r) for r in MD.name_substrings(n, lengths, MD.id_bits(i, len(ids), max_bits=64)).collect()}
    assert full == every  # a table that is too small drops nothing
    assert {r.id: r.name for r in MD.match_media(i, n, max_ids=0).collect()} == _expected(ids, names)
