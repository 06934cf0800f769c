import json
import os

from ratingspark import schemas as SC
from ratingspark.operators import media as MD
from ratingspark.session import scratch_path
from ratingspark.sources import files as IO


def test_csv_roundtrip_keeps_quotes_newlines_and_padding(spark):
    rows = [("t \"q\"", "l1", "line1\nline2, with comma"), ("  pad  ", "l2", "x")]
    df = spark.createDataFrame(rows, SC.TRANSCRIPTS)
    path = scratch_path(spark, "csv")
    IO.write_csv(df, path)
    back = IO.read_csv(spark, path, SC.TRANSCRIPTS)
    assert sorted(back.collect()) == sorted(df.collect())


def test_json_array_file_reads_nested_records(spark):
    path = scratch_path(spark, "jsonarr")
    os.makedirs(path)
    recs = [{"id": i, "transcript": f"t{i}", "rationales": {r: {"rationale": "é", "score": i % 5 + 1}
                                                             for r in SC.RUBRICS}} for i in range(5)]
    with open(os.path.join(path, "data.json"), "w", encoding="utf-8") as f:
        json.dump(recs, f, ensure_ascii=False, indent=2)
    df = IO.read_json(spark, path, SC.NESTED, multiline=True)
    assert df.count() == 5
    assert df.where("rationales.clarity.rationale = 'é'").count() == 5


def test_list_media_and_containment_match(spark):
    folder = scratch_path(spark, "media")
    os.makedirs(os.path.join(folder, "sub"))
    for name in ("intro_abc123.mp4", "sub/xyz_abc123_final.mp4", "other_777.mp4", "notes_abc123.txt"):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(b"\0" * 10)
    files = IO.list_media(spark, folder)
    assert sorted(r.name for r in files.collect()) == ["intro_abc123.mp4", "other_777.mp4", "xyz_abc123_final.mp4"]
    ids = spark.createDataFrame([("abc123",), ("777",), ("nope",)], "id string")
    got = {r.id: r.name for r in MD.match_media(ids, files.select("name")).collect()}
    assert got == {"abc123": "intro_abc123.mp4", "777": "other_777.mp4", "nope": None}


def test_append_sink(spark):
    path = scratch_path(spark, "append")
    IO.append_parquet(spark.range(3), path)
    IO.append_parquet(spark.range(3, 5), path)
    assert spark.read.parquet(path).count() == 5
