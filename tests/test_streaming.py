import pytest
from pyspark.sql import functions as F

from ratingspark.operators import enrich as EN
from ratingspark.session import scratch_path
from ratingspark.streaming import sink as S
from ratingspark.streaming.resume import append, latest, new_rows, run_incremental


def _transcribe(rows):
    return EN.enrich(rows.select("doc_id", "text"), EN.failing_transcriber_factory, ["doc_id", "text"],
                     "transcript").select("doc_id", "transcript", "error")


def _source(spark, n0, n1, src):
    spark.range(n0, n1).selectExpr("id AS doc_id", "concat('t', id) AS text").write.mode("append").parquet(src)


def test_incremental_once_per_key(spark):
    src, sink = scratch_path(spark, "src"), scratch_path(spark, "sink")
    _source(spark, 0, 100, src)
    schema = spark.read.parquet(src).schema
    ck = scratch_path(spark, "ck")
    run_incremental(spark, src, schema, sink, ck, "doc_id", _transcribe)
    assert spark.read.parquet(sink).count() == 100
    # New files: only the new keys (and a repeated one) arrive; the repeat is skipped.
    _source(spark, 95, 150, src)
    run_incremental(spark, src, schema, sink, ck, "doc_id", _transcribe)
    out = spark.read.parquet(sink)
    assert out.count() == 150 and out.select("doc_id").distinct().count() == 150
    # A fresh checkpoint replays all files: the anti-join against the sink adds nothing.
    run_incremental(spark, src, schema, sink, scratch_path(spark, "ck2"), "doc_id", _transcribe)
    assert spark.read.parquet(sink).count() == 150


def test_crash_after_append_then_restart(spark):
    src, sink, ck = scratch_path(spark, "src"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    _source(spark, 0, 60, src)
    schema = spark.read.parquet(src).schema
    with pytest.raises(Exception):
        run_incremental(spark, src, schema, sink, ck, "doc_id", _transcribe, fail_after_append=True)
    run_incremental(spark, src, schema, sink, ck, "doc_id", _transcribe)
    out = spark.read.parquet(sink)
    assert out.count() == 60 and out.select("doc_id").distinct().count() == 60


def test_retry_errors_reprocesses_failed_keys(spark):
    src, sink = scratch_path(spark, "src"), scratch_path(spark, "sink")
    _source(spark, 0, 40, src)
    schema = spark.read.parquet(src).schema
    run_incremental(spark, src, schema, sink, scratch_path(spark, "ck"), "doc_id", _transcribe)
    failed = spark.read.parquet(sink).where("error IS NOT NULL").count()
    assert failed == 3  # keys 0, 17, 34

    def fixed(rows):
        return rows.selectExpr("doc_id", "concat('ok ', text) AS transcript", "CAST(NULL AS STRING) AS error")

    run_incremental(spark, src, schema, sink, scratch_path(spark, "ck2"), "doc_id", fixed, retry_errors=True)
    out = spark.read.parquet(sink)
    assert out.count() == 43 and out.where("error IS NULL").select("doc_id").distinct().count() == 40
    view = latest(spark, sink, "doc_id")
    assert view.columns == ["doc_id", "transcript", "error"] and view.count() == 40 and view.where("error IS NOT NULL").count() == 0


def _keys(spark, *ranges):
    df = spark.createDataFrame([], "doc_id long")
    for lo, hi in ranges:
        df = df.union(spark.range(lo, hi).toDF("doc_id"))
    return df


def _rows(spark, lo, hi, by="w"):
    return spark.range(lo, hi).selectExpr("id AS doc_id", f"'{by}' AS writer")


def _found(spark, sink):
    return sorted(tuple(r) for r in S.committed(spark, sink).select("doc_id", "writer").collect())


def test_a_batch_reads_only_the_parts_that_may_hold_its_keys(spark):
    """A sink of 60 parts and 120,000 keys; 1,000 keys of which 30 lie in two parts, and others that lie nowhere."""
    sink = scratch_path(spark, "sink")
    log = S.Log(spark, sink)
    for i in range(60):
        append(_rows(spark, 2000 * i, 2000 * (i + 1)), sink, "doc_id")
    parts = log.parts()
    assert len(parts) == 60 and sum(p.rows for p in parts) == 120_000 and log.version() == 60
    batch = _keys(spark, (5000, 5015), (90_000, 90_015), (10**6, 10**6 + 970))
    hit = S.may_hold(log, parts, batch, "doc_id")
    assert {parts[2], parts[45]} <= set(hit) and sum(p.rows for p in hit) < 12_000  # a tenth of the sink
    files = log.read(hit).select("doc_id").inputFiles()
    assert len({f.split("/_part=")[1].split("/")[0] for f in files}) == len(hit)
    todo = new_rows(batch, sink, "doc_id").collect()
    assert len(todo) == 970 and min(r.doc_id for r in todo) == 10**6
    # nulls and keys of any size of part are found again
    odd = spark.createDataFrame([(None, "n"), (7 * 10**6, "m")], "doc_id long, writer string")
    append(odd, sink, "doc_id")
    assert [p.rows for p in S.may_hold(log, log.parts(), odd, "doc_id")].count(2) == 1


def test_no_key_is_ruled_out_wrongly(spark):
    keys = spark.range(30_000).selectExpr("concat('https://x/', id * 7919) AS k")
    sink = scratch_path(spark, "sink")
    append(keys.withColumn("writer", F.lit("a")), sink, "k")
    log = S.Log(spark, sink)
    asked = keys.select(S._shard(F.col("k"), F.lit(log.parts()[0].shards)).alias("shard"), S._positions(F.col("k")).alias("at"))
    index = log.read(log.parts(), index=True)
    held = index.join(asked, "shard").where("forall(at, p -> shiftright(words[shiftright(p, 6)], p & 63) & 1 = 1)")
    assert held.count() == 30_000
    assert S.may_hold(log, log.parts(), spark.range(300).selectExpr("concat('https://y/', id) AS k"), "k") == []


def test_a_writer_killed_before_its_commit_leaves_nothing(spark, monkeypatch):
    sink = scratch_path(spark, "sink")
    append(_rows(spark, 0, 50), sink, "doc_id")

    def killed(self, version, part):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(S.Log, "commit", killed)
        with pytest.raises(RuntimeError):
            append(_rows(spark, 40, 90), sink, "doc_id")
    assert len(_found(spark, sink)) == 50 and spark.read.parquet(sink).count() == 100  # files, but no part of the table
    half = S.Log(spark, sink).folder_of("phalf")  # rows without an index
    _rows(spark, 50, 60).write.parquet(half)
    append(new_rows(_rows(spark, 40, 90), sink, "doc_id"), sink, "doc_id")
    assert [k for k, _ in _found(spark, sink)] == list(range(90))


def test_a_stream_killed_in_its_append_is_made_good(spark, monkeypatch):
    src, sink, ck = scratch_path(spark, "src"), scratch_path(spark, "sink"), scratch_path(spark, "ck")
    _source(spark, 0, 60, src)
    schema = spark.read.parquet(src).schema
    whole = S.Log.commit
    with monkeypatch.context() as m:
        m.setattr(S.Log, "commit", lambda self, version, part: 1 / 0)
        with pytest.raises(Exception):
            run_incremental(spark, src, schema, sink, ck, "doc_id", _transcribe)
    assert S.committed(spark, sink) is None and S.Log.commit is whole
    run_incremental(spark, src, schema, sink, ck, "doc_id", _transcribe)
    out = latest(spark, sink, "doc_id")
    assert out.count() == S.committed(spark, sink).count() == 60


def test_two_writers_at_once_lose_and_double_nothing(spark):
    """Both compare with the same version, then append overlapping keys at the same time, three times over."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    sink = scratch_path(spark, "sink")
    append(_rows(spark, 0, 10, "old"), sink, "doc_id")
    for turn in range(3):
        meet, lo = Barrier(2), 100 * turn
        ranges = {"a": (lo, lo + 80), "b": (lo + 40, lo + 120)}

        def write(by):
            seen = S.Log(spark, sink).version()
            todo = new_rows(_rows(spark, *ranges[by], by), sink, "doc_id", upto=seen)
            meet.wait(60)
            return append(todo, sink, "doc_id", seen)

        with ThreadPoolExecutor(2) as pool:
            list(pool.map(write, "ab"))
    keys = [k for k, _ in _found(spark, sink)]
    assert keys == sorted(set(keys)) == list(range(320))
    assert len(S.Log(spark, sink)._names()) == S.Log(spark, sink).version()


def test_the_loser_drops_what_the_winner_wrote(spark):
    sink = scratch_path(spark, "sink")
    append(_rows(spark, 0, 5, "old"), sink, "doc_id")
    seen = S.Log(spark, sink).version()
    append(_rows(spark, 10, 20, "first"), sink, "doc_id", seen)
    assert append(_rows(spark, 15, 25, "second"), sink, "doc_id", seen).rows == 5
    assert append(_rows(spark, 10, 20, "third"), sink, "doc_id", seen) is None
    assert [w for _, w in _found(spark, sink)] == ["old"] * 5 + ["first"] * 10 + ["second"] * 5


def test_a_version_is_taken_once_and_summaries_list_all(spark, monkeypatch):
    monkeypatch.setattr(S, "SUMMARY", 3)
    sink = scratch_path(spark, "sink")
    log = S.Log(spark, sink)
    parts = [S.Part(f"p{i}", i, 1) for i in range(1, 9)]
    for i, p in enumerate(parts, 1):
        assert log.commit(i, p) and not log.commit(i, S.Part("other", 0, 1))
        assert log.parts() == parts[:i]
    assert log.parts(after=4) == parts[4:] and log.parts(upto=5) == parts[:5] and log.parts(after=2, upto=4) == parts[2:4]
    opened = []
    monkeypatch.setattr(S.Log, "_load", lambda self, n, f=S.Log._load: opened.append(n) or f(self, n))
    log.parts()
    assert len(opened) <= 3
    names = log.fs.listStatus(log._path(log.folder))
    assert not [s for s in names if s.getPath().getName().startswith(".") and not s.getPath().getName().endswith(".crc")]


def test_a_sink_without_the_key_is_an_error(spark):
    sink = scratch_path(spark, "sink")
    batch = spark.createDataFrame([(3, "a")], "doc_id long, text string")
    assert new_rows(batch, sink, "doc_id").count() == 1  # nothing written yet
    append(spark.range(5), sink, "id")
    with pytest.raises(ValueError):
        new_rows(batch, sink, "doc_id")


def test_commits_on_a_file_system_that_is_not_local(spark, tmp_path):
    """The same log through a mount table, whose commits take Hadoop's rename instead of a link."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.mounted.link./in", f"file://{tmp_path}")
    sink = "viewfs://mounted/in/sink"
    log = S.Log(spark, sink)
    assert log.fs.getUri().getScheme() == "viewfs"
    assert append(_rows(spark, 0, 20), sink, "doc_id").rows == 20
    assert not log.commit(1, S.Part("other", 0, 1)) and log.version() == 1
    append(new_rows(_rows(spark, 10, 30), sink, "doc_id"), sink, "doc_id")
    assert [k for k, _ in _found(spark, sink)] == list(range(30))


def test_documents_stored_as_a_folder_of_files_are_streamed_too(spark, tmp_path):
    from ratingspark.plans.queries import q_stream_resume

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").repartition(3)
    for name, files in (("folder", rows), ("file", rows.coalesce(1))):
        files.write.parquet(str(tmp_path / name / "documents.parquet"))
    one = next((tmp_path / "file" / "documents.parquet").glob("part-*"))
    (tmp_path / "single").mkdir()
    one.rename(tmp_path / "single" / "documents.parquet")
    for name in ("folder", "single"):
        assert sorted(r.doc_id for r in q_stream_resume(spark, str(tmp_path / name)).collect()) == list(range(20))
