import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratingspark.operators import enrich as EN
from ratingspark.operators import prompts as PR


def _requests(spark):
    return spark.createDataFrame([("1", "clarity", "hello"), ("2", "unknown_thing", "bye"), ("3", None, None)],
                                 "link string, rubric string, transcript string")


def test_unknown_rubric_falls_back_to_default(spark):
    out = {r.link: r for r in PR.resolve_prompts(_requests(spark), PR.rubric_table(spark)).collect()}
    assert out["1"].prompt_rubric == "clarity" and not out["1"].unknown_rubric
    assert out["2"].prompt_rubric == "traction_validation" and out["2"].unknown_rubric
    assert out["3"].unknown_rubric and out["3"].user_prompt.endswith(":\n")


def test_chat_render_and_response_span(spark):
    df = spark.createDataFrame([("sys", "usr", "ans")], "s string, u string, a string")
    chat = PR.build_chat(F.col("s"), F.col("u"), F.col("a"))
    t = PR.DEFAULT_TEMPLATE
    row = df.select(PR.render_chat(chat).alias("text")).select("text", *PR.response_span("text")).first()
    assert row.text.startswith(t.bos) and row.text.endswith("ans" + t.end)
    assert row.response_part == "ans" + t.end
    assert row.prompt_part + row.response_part == row.text
    assert row.text[row.response_start - 1:] == row.response_part
    gen = df.select(PR.render_chat(PR.build_chat(F.col("s"), F.col("u")), add_generation_prompt=True)).first()[0]
    assert gen.endswith(t.header("assistant"))


def _docs(spark):
    return spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")


def test_enrich_policies(spark):
    d = _docs(spark)
    cap = {r.doc_id: r for r in EN.enrich(d, EN.failing_transcriber_factory, ["doc_id", "text"], "t").collect()}
    assert cap[17].t == "ERROR: cannot transcribe 17" and cap[17].error == "cannot transcribe 17"
    assert cap[1].t == "6 chars: text 1" and cap[1].error is None
    emp = {r.doc_id: r for r in EN.enrich(d, EN.failing_transcriber_factory, ["doc_id", "text"], "t",
                                          on_error="empty").collect()}
    assert emp[34].t == "" and emp[34].error
    with pytest.raises(Exception):
        EN.enrich(d, EN.failing_transcriber_factory, ["doc_id", "text"], "t", on_error="raise").collect()


def test_parallel_equals_serial(spark):
    d = _docs(spark)
    a = EN.enrich(d.coalesce(1), EN.failing_transcriber_factory, ["doc_id", "text"], "t")
    b = EN.enrich(d, EN.failing_transcriber_factory, ["doc_id", "text"], "t", num_partitions=6)
    assert sorted(a.collect()) == sorted(b.collect())


def test_judge_one_pass_parses_and_pivots(spark):
    req = PR.resolve_prompts(_requests(spark).where("rubric = 'clarity'"), PR.rubric_table(spark))
    judged = EN.judge_apply(req, EN.length_scorer_factory, ("link",))
    r = judged.first()
    n = len("Rate the clarity of this pitch transcript:\nhello")
    assert r.score == 1 + n % 5 and r.rationale.endswith(f"[[{1 + n % 5}]]")
    wide = EN.judged_wide(judged, "link").first()
    direct = EN.judge_documents(_requests(spark).where("link = '1'"), EN.length_scorer_factory, "transcript", ("link",)).first()
    assert direct.clarity_score_rationale == r.rationale and direct.clarity_score == r.score
    assert wide.clarity_score == r.score and wide.team_market_fit_score is None


def test_model_loaded_once_per_task(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        calls.add(1)
        return lambda pdf: ["[[2]]"] * len(pdf)

    req = PR.resolve_prompts(spark.range(200).select(F.col("id").cast("string").alias("link"),
                                                     F.lit("clarity").alias("rubric"),
                                                     F.lit("x").alias("transcript")).repartition(4),
                             PR.rubric_table(spark))
    assert EN.judge_apply(req, factory, ("link",)).count() == 200
    assert calls.value <= 8


def test_carried_columns_are_untouched(spark):
    big = 9007199254740993
    d = spark.createDataFrame([(big, 1, "a"), (None, None, "b"), (big + 2, 3, None)], "key long, small int, text string")
    seen = spark.sparkContext.accumulator(0)

    def factory(step):
        def fn(key, text):
            assert key is None or isinstance(key, int)
            seen.add(step)
            return str(key)
        return fn

    out = EN.enrich(d.coalesce(1), factory, ["key", "text"], "t", batch_size=2, args={"step": 5})
    got = {(r.key, r.small, r.text, r.t, r.error) for r in out.collect()}
    assert got == {(big, 1, "a", str(big), None), (None, None, "b", "None", None), (big + 2, 3, None, str(big + 2), None)}
    assert seen.value == 15


def test_repeated_rubric_keeps_its_own_rationale(spark):
    from ratingspark.operators.reshape import wide_from_long

    rows = [("k", "clarity", 5, "five"), ("k", "clarity", 1, "zzz one")]
    r = wide_from_long(spark.createDataFrame(rows, "doc_id string, rubric string, score int, rationale string"), "doc_id").first()
    assert (r.clarity_score, r.clarity_score_rationale) == (5, "five")


def test_model_is_called_once_per_row_for_agreement(spark, sf_small):
    from ratingspark.plans import queries as Q

    calls = spark.sparkContext.accumulator(0)
    real = EN.word_scorer_factory

    def counting(**kw):
        inner = real(**kw)

        def score(pdf):
            calls.add(len(pdf))
            return inner(pdf)
        return score

    EN.word_scorer_factory = counting
    try:
        rows = Q.q_judge_agreement(spark, sf_small).collect()
    finally:
        EN.word_scorer_factory = real
    assert calls.value == sum(r.n for r in rows)
