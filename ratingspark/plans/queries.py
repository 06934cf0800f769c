"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads whole driver tables (or tables Spark derives from them); the
twin SQL for the DuckDB oracle lives in :mod:`ratingspark.plans.oracle_queries`.
Floating-point outputs are rounded to 6 decimals for comparison.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark import fixtures as fx
from ratingspark import schemas as SC
from ratingspark.functions import text as tx
from ratingspark.functions.hashing import below
from ratingspark.operators import curate as C
from ratingspark.operators import media as MD
from ratingspark.functions import arrays as AR
from ratingspark.operators import baseline as BL
from ratingspark.operators import enrich as EN
from ratingspark.operators import features as FE
from ratingspark.operators import metrics as M
from ratingspark.operators import splits as SPL
from ratingspark.operators import prompts as PR
from ratingspark.operators import raters as RT
from ratingspark.operators import report as RP
from ratingspark.operators import reshape as R
from ratingspark.session import cut_lineage, scratch_path
from ratingspark.sources import blocks as IB
from ratingspark.sources import files as IO

DIGITS = 6

REGISTRY: dict = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def parsed_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> derived ratings -> long rows -> parsed judge score next to a second rater."""
    wide = fx.rated_with_second_rater(spark, sf_dir)
    long = R.unpivot_ratings(wide, keep=("doc_id",), extra=("pred",))
    return long.select(
        "doc_id",
        R.rubric_of().alias("rubric"),
        tx.extract_score("rationale").alias("y_true"),
        F.col("pred").alias("y_pred"),
    )


@register("unpivot_ratings")
def q_unpivot_ratings(spark, sf_dir):
    wide = fx.rated_wide(spark, sf_dir)
    return R.unpivot_ratings(wide, keep=("doc_id", "title", "link", "transcript"))


@register("extract_score")
def q_extract_score(spark, sf_dir):
    long = R.unpivot_ratings(fx.rated_wide(spark, sf_dir), keep=("doc_id",))
    return long.select("doc_id", "rationale_type", tx.extract_score("rationale").alias("parsed"),
                       tx.extract_score("rationale", strict=True).alias("parsed_strict"))


@register("score_audit")
def q_score_audit(spark, sf_dir):
    long = R.unpivot_ratings(fx.rated_wide(spark, sf_dir), keep=("doc_id",))
    return RP.score_audit(long.withColumn("rubric", R.rubric_of()))


@register("confusion")
def q_confusion(spark, sf_dir):
    return M.confusion(parsed_long(spark, sf_dir), ("rubric",))


@register("qwk")
def q_qwk(spark, sf_dir):
    both = M.qwk_from_confusion(M.confusion(parsed_long(spark, sf_dir), ("rubric",)), ("rubric",), "both")
    return both.select("rubric", "n", F.round("qwk", DIGITS).alias("qwk"), F.round("qwk_fixed", DIGITS).alias("qwk_fixed"))


@register("qwk_macro")
def q_qwk_macro(spark, sf_dir):
    per = M.qwk(parsed_long(spark, sf_dir), ("rubric",))
    return M.qwk_macro(per).select(F.round("qwk_macro", DIGITS).alias("qwk_macro"), "n_groups")


# ---------------------------------------------------------------- curation

KEYWORD = "en"          # stands in for the reference's title keyword on these tables
PAGE_PARAM = "page"     # the query parameter kept when cleaning page links
HOSTS = ("example.org", "blog.")
PER_QUERY_LIMIT = 20


def _hits(spark, sf_dir):
    grid = C.query_grid(spark)
    return C.search_hits_from_pages(fx.read(spark, sf_dir, "pages"), grid, C.grid_size())


@register("query_grid")
def q_query_grid(spark, sf_dir):
    grid = C.query_grid(spark)
    counts = _hits(spark, sf_dir).groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits"))
    return (grid.join(counts, "qid", "left")
            .select("qid", "batch", "query", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits")))


@register("corpus_build")
def q_corpus_build(spark, sf_dir):
    hits = C.top_n_per_group(_hits(spark, sf_dir), ["qid"], ["rank_key", "page_id"], PER_QUERY_LIMIT)
    hits = C.title_filter(hits, KEYWORD)
    hits = C.clean_links(hits, "link", keep=PAGE_PARAM)
    return C.dedup_pairs(hits)


@register("title_filter")
def q_title_filter(spark, sf_dir):
    return C.title_filter(fx.transcripts(spark, sf_dir), KEYWORD).select("doc_id", "title")


@register("clean_url")
def q_clean_url(spark, sf_dir):
    pages = fx.read(spark, sf_dir, "pages")
    return pages.select("page_id", "url", tx.clean_url("url", PAGE_PARAM).alias("clean"),
                        tx.clean_url("url", "v").alias("clean_v"))


@register("sanitize_name")
def q_sanitize_name(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select("page_id", tx.sanitize_name("url").alias("name"))


@register("host_filter")
def q_host_filter(spark, sf_dir):
    pages = fx.read(spark, sf_dir, "pages")
    return pages.where(tx.host_matches("url", HOSTS)).select("page_id", "url")


def _docs_with_labels(spark, sf_dir):
    docs = fx.read(spark, sf_dir, "documents").select("doc_id")
    return docs.join(fx.read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@register("drop_null_text")
def q_drop_null_text(spark, sf_dir):
    return C.drop_null(_docs_with_labels(spark, sf_dir), ["quality"])


@register("null_policy")
def q_null_policy(spark, sf_dir):
    return C.null_to_literal(_docs_with_labels(spark, sf_dir), "quality").withColumnRenamed("quality", "quality_text")


@register("preview")
def q_preview(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", tx.preview("text").alias("preview"))


@register("resume_anti_join")
def q_resume_anti_join(spark, sf_dir):
    todo = fx.transcripts(spark, sf_dir).select("link", "title")
    done = fx.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("link"))
    return C.resume(todo, done, "link")


@register("dedup_pairs")
def q_dedup_pairs(spark, sf_dir):
    return C.dedup_pairs(C.clean_links(_hits(spark, sf_dir), "link", keep="v"))


@register("dedup_links")
def q_dedup_links(spark, sf_dir):
    return C.dedup_links(C.clean_links(_hits(spark, sf_dir), "link", keep="v"))


@register("top_n_per_group")
def q_top_n_per_group(spark, sf_dir):
    ev = fx.read(spark, sf_dir, "events")
    return C.top_n_per_group(ev, ["user_id"], ["ts", "event_id"], PER_QUERY_LIMIT).select(
        "event_id", "user_id", "event_type", "value")


@register("drop_errors")
def q_drop_errors(spark, sf_dir):
    return C.drop_errors(fx.transcripts(spark, sf_dir)).select("doc_id", "link")


# ---------------------------------------------------------------- sources and sinks

@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv_roundtrip")
    IO.write_csv(fx.transcripts(spark, sf_dir).select("title", "link", "transcript"), path)
    return IO.read_csv(spark, path, SC.TRANSCRIPTS)


@register("csv_blocks")
def q_csv_blocks(spark, sf_dir):
    """The transcripts as CSV with records over many lines, read back from all blocks of the files at once."""
    path = scratch_path(spark, "csv_blocks")
    t = fx.transcripts(spark, sf_dir).select("title", "link", "transcript")
    IO.write_csv(t, path)
    return IB.read_csv_blocks(spark, path, t.schema)


@register("json_blocks")
def q_json_blocks(spark, sf_dir):
    """The nested rating records as JSON arrays, one in each file, read back from all blocks of the files at once."""
    path = scratch_path(spark, "json_blocks")
    IO.write_json_arrays(R.nest_ratings(fx.rated_wide(spark, sf_dir)), path)
    return R.flatten_nested(IB.read_json_blocks(spark, path, SC.NESTED))


@register("json_roundtrip")
def q_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "json_roundtrip")
    IO.write_json(R.nest_ratings(fx.rated_wide(spark, sf_dir)), path)
    return R.flatten_nested(IO.read_json(spark, path, SC.NESTED))


@register("text_sink")
def q_text_sink(spark, sf_dir):
    path = scratch_path(spark, "text_sink")
    IO.write_text(fx.read(spark, sf_dir, "documents"), path, col="text")
    return IO.read_text_lines(spark, path).select(F.col("value").alias("line"))


@register("text_documents")
def q_text_documents(spark, sf_dir):
    """Transcripts exported as one keyed record each, and read back whole."""
    path = scratch_path(spark, "text_documents")
    IO.write_documents(fx.transcripts(spark, sf_dir), path, "doc_id", "transcript")
    return IO.read_documents(spark, path, "doc_id long", "transcript")


@register("published_dataset")
def q_published_dataset(spark, sf_dir):
    """The whole rated table as records of one struct column, published as Parquet by language, loaded and flattened again."""
    path = scratch_path(spark, "published")
    wide = fx.rated_wide(spark, sf_dir, carry=("lang",))
    records = wide.select("doc_id", "lang", F.struct(*[c for c in wide.columns if c not in ("doc_id", "lang")]).alias("train"))
    IO.write_parquet(records, path, partition_by=("lang",))
    return R.flatten_struct(spark.read.parquet(path), "train")


@register("absolute_links")
def q_absolute_links(spark, sf_dir):
    """Links without a host, as a search page gives them, made absolute and cleaned."""
    pages = fx.read(spark, sf_dir, "pages")
    hits = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*(.*)$", 1).alias("link"))
    return C.clean_links(hits, "link", keep=PAGE_PARAM, prefix=LINK_PREFIX)


LINK_PREFIX = "https://videos.example.com"


@register("match_media")
def q_match_media(spark, sf_dir):
    ids = fx.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    names = fx.read(spark, sf_dir, "pages").select(tx.sanitize_name("url").alias("name"))
    return MD.match_media(ids, names, "id", "name")


@register("media_listing")
def q_media_listing(spark, sf_dir):
    """Media files, one for each distinct page name, listed from the folder that this query wrote, and matched to ids."""
    folder = scratch_path(spark, "media")
    pages = fx.read(spark, sf_dir, "pages").select(tx.sanitize_name("url").alias("media")).distinct()
    IO.write_media(pages, folder)
    found = IO.list_media(spark, folder, "part-*", name_pattern=r"media=([^/]*)/[^/]*$")
    ids = fx.read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return MD.match_media(ids, found, "id", "name")


# ---------------------------------------------------------------- reshaping, prompts, chats

@register("nest_ratings")
def q_nest_ratings(spark, sf_dir):
    nested = R.nest_ratings(fx.rated_wide(spark, sf_dir))
    return nested.select("id", "transcript", F.to_json("rationales").alias("rationales_json"))


@register("flatten_nested")
def q_flatten_nested(spark, sf_dir):
    return R.flatten_nested(R.nest_ratings(fx.rated_wide(spark, sf_dir)))


@register("seq2seq_pairs")
def q_seq2seq_pairs(spark, sf_dir):
    return R.seq2seq_pairs(fx.rated_wide(spark, sf_dir), keep=("doc_id",))


# Rubric names the requests use: every 13th document asks for a rubric the table
# does not know, which must fall back to the default rubric's prompt.
UNKNOWN_RUBRIC = "pitch_energy"


def _requests(spark, sf_dir):
    long = R.unpivot_ratings(fx.rated_wide(spark, sf_dir), keep=("doc_id", "transcript"))
    rubric = F.when(F.col("doc_id") % 13 == 0, F.lit(UNKNOWN_RUBRIC)).otherwise(R.rubric_of())
    return long.select("doc_id", rubric.alias("rubric"), "transcript", "rationale", "score")


def _prompted(spark, sf_dir):
    return PR.resolve_prompts(_requests(spark, sf_dir), PR.rubric_table(spark))


@register("build_prompts")
def q_build_prompts(spark, sf_dir):
    return _prompted(spark, sf_dir).select("doc_id", "rubric", "prompt_rubric", "unknown_rubric",
                                           "system_prompt", "user_prompt")


def _chats(spark, sf_dir):
    p = _prompted(spark, sf_dir)
    train = _train_flag()
    chat = F.when(train, PR.build_chat(F.col("system_prompt"), F.col("user_prompt"), F.col("rationale"))) \
        .otherwise(PR.build_chat(F.col("system_prompt"), F.col("user_prompt")))
    return p.select("doc_id", "rubric", train.alias("train"), chat.alias("chat"))


def _train_flag():
    """Training rows: documents outside the 20 % test share (group-safe: keyed on the document)."""
    return ~below("42", "doc_id", 0.2)


@register("build_chats")
def q_build_chats(spark, sf_dir):
    return _chats(spark, sf_dir).select("doc_id", "rubric", "train", F.size("chat").alias("n_messages"),
                                        F.to_json("chat").alias("chat_json"))


@register("render_chats")
def q_render_chats(spark, sf_dir):
    c = _chats(spark, sf_dir)
    return c.select("doc_id", "rubric", "train",
                    F.when(F.col("train"), PR.render_chat("chat"))
                    .otherwise(PR.render_chat("chat", add_generation_prompt=True)).alias("text"))


@register("response_span")
def q_response_span(spark, sf_dir):
    c = _chats(spark, sf_dir).where("train")
    return c.select("doc_id", "rubric", PR.render_chat("chat").alias("_t")).select(
        "doc_id", "rubric", *PR.response_span("_t"))


# ---------------------------------------------------------------- token arrays, argmax, loss

SEQ_LEN = 512


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _ids_of(toks: pa.Array) -> pa.Array:
    words = toks.flatten().dictionary_encode()
    ids = pa.array([int(md5(w.encode(), usedforsecurity=False).hexdigest()[:4], 16) + 1 for w in words.dictionary.to_pylist()], pa.int32())
    sizes = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(toks), 0).to_numpy()))
    offsets = pa.array(sizes, pa.int32(), mask=np.append(toks.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, ids.take(words.indices))


def token_ids(toks):
    """Stand-in subword ids: each word token hashed to 1..65536 (0 is the pad id). A batch hashes each distinct word once."""
    return _ids_of(toks)


@register("tokenize")
def q_tokenize(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents")
    return d.select("doc_id", tx.tokens("text").alias("_t")).select(
        "doc_id", F.size("_t").alias("n_tokens"), F.array_join("_t", " ").alias("tokens"))


@register("pad_truncate")
def q_pad_truncate(spark, sf_dir):
    # Ids are only needed for the first SEQ_LEN tokens; the count is of all of them.
    d = fx.read(spark, sf_dir, "documents").select("doc_id", tx.tokens("text").alias("_t"))
    d = d.select("doc_id", F.size("_t").alias("n_tokens"), token_ids(F.slice("_t", 1, SEQ_LEN)).alias("ids"))
    return d.select("doc_id", "n_tokens",
                    AR.join_ints(AR.pad_truncate("ids", SEQ_LEN)).alias("input_ids"),
                    AR.join_ints(AR.attention_mask("ids", SEQ_LEN)).alias("attention_mask"))


@register("response_mask")
def q_response_mask(spark, sf_dir):
    """Labels of response-only training: every token of a rendered chat, -100 outside the response. Of the whole vectors
    (as digests) and of what is left of them at the training length."""
    c = _chats(spark, sf_dir).where("train").select("doc_id", "rubric", PR.render_chat("chat").alias("_t"))
    c = c.select("doc_id", "rubric", F.lower("_t").alias("_l"), PR.response_span("_t")[2].alias("_from"), F.length("_t").alias("_n"))
    place = F.when(F.col("_from") > 0, F.col("_from")).otherwise(F.col("_n") + 1)
    c = c.select("doc_id", "rubric", "_l", tx.token_bound("_l", place).alias("_at"))
    # The response runs to the end of the chat. Each part is split once; the prompt's tokens are masked and need no ids.
    c = c.select("doc_id", "rubric", F.size(tx.tokens_of_lower(F.substring("_l", F.lit(1), F.col("_at")))).alias("first_token"),
                 token_ids(tx.tokens_of_lower(F.substring("_l", F.col("_at") + 1, F.length("_l")))).alias("_ids"))
    c = c.select("doc_id", "rubric", "first_token", F.size("_ids").alias("n_tokens"),
                 F.concat(F.array_repeat(F.lit(-100), F.col("first_token")), "_ids").alias("_padded"))
    c = c.select("doc_id", "rubric", F.size("_padded").alias("n_ids"), "first_token", "n_tokens",
                 AR.response_labels("_padded", "first_token", "n_tokens").alias("_whole"))
    return c.select("doc_id", "rubric", "n_ids", "first_token", "n_tokens", F.md5(AR.join_ints("_whole")).alias("labels_md5"),
                    F.md5(AR.join_ints(AR.pad_truncate("_whole", SEQ_LEN, -100))).alias("cut_md5"))


@register("argmax_class")
def q_argmax_class(spark, sf_dir):
    e = fx.read(spark, sf_dir, "embeddings")
    pos = AR.argmax_label("embedding")
    return e.select("vec_id", "label", (pos - 1).alias("pred_class"), pos.alias("pred_score"))


# Three heads that together take the whole 64-element vector (first position, classes, weight); targets from the label.
LOSS_TASKS = (("a", 1, 22, 1.0), ("b", 23, 21, 0.5), ("c", 44, 21, 2.0))


@register("multitask_loss")
def q_multitask_loss(spark, sf_dir):
    e = fx.read(spark, sf_dir, "embeddings").select(
        "embedding", (F.col("label") % 22 + 1).alias("t_a"), (F.floor(F.col("label") / 2) % 21 + 1).alias("t_b"),
        ((F.col("vec_id") + F.col("label")) % 21 + 1).alias("t_c"), (F.col("vec_id") % 4).alias("grp"))
    for name, start, size, _ in LOSS_TASKS:
        e = e.withColumn(f"s_{name}", F.slice("embedding", start, size))
    tasks = [(name, f"s_{name}", f"t_{name}", w) for name, _, _, w in LOSS_TASKS]
    out = M.multitask_loss(e, tasks, group_cols=("grp",))
    return out.select("grp", "n", *[F.round(f"ce_{n}", DIGITS).alias(f"ce_{n}") for n, *_ in LOSS_TASKS],
                      F.round("loss", DIGITS).alias("loss"))


# ---------------------------------------------------------------- splits and folds

SEED = 42


@register("split_holdout")
def q_split_holdout(spark, sf_dir):
    return SPL.split_holdout(fx.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2, SEED)


@register("split_three_way")
def q_split_three_way(spark, sf_dir):
    return SPL.split_three_way(fx.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.15, 0.15, SEED)


@register("split_three_way_exact")
def q_split_three_way_exact(spark, sf_dir):
    return SPL.split_three_way_exact(fx.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.3, 0.5, SEED)


def _long_keys(spark, sf_dir):
    long = R.unpivot_ratings(fx.rated_wide(spark, sf_dir), keep=("doc_id",))
    return long.select("doc_id", R.rubric_of().alias("rubric"))


@register("split_grouped")
def q_split_grouped(spark, sf_dir):
    return SPL.split_holdout(_long_keys(spark, sf_dir), "doc_id", 0.2, SEED)


@register("leak_count")
def q_leak_count(spark, sf_dir):
    long = _long_keys(spark, sf_dir).withColumn("_row", F.concat_ws(":", "doc_id", "rubric"))
    by_row = SPL.leak_count(SPL.split_holdout(long, "_row", 0.2, SEED), "doc_id")
    by_doc = SPL.leak_count(SPL.split_holdout(long, "doc_id", 0.2, SEED), "doc_id")
    return (by_row.select(F.lit("row").alias("split_key"), "*")
            .unionByName(by_doc.select(F.lit("document").alias("split_key"), "*")))


@register("kfold")
def q_kfold(spark, sf_dir):
    return SPL.kfold_exact(fx.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5, SEED)


@register("kfold_hash")
def q_kfold_hash(spark, sf_dir):
    return SPL.kfold_hash(fx.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5, SEED)


# ---------------------------------------------------------------- baselines and metrics

def _parsed_split(spark, sf_dir):
    return SPL.split_holdout(parsed_long(spark, sf_dir), "doc_id", 0.2, SEED)


@register("label_shares")
def q_label_shares(spark, sf_dir):
    train = _parsed_split(spark, sf_dir).where("split = 'train'")
    return BL.label_shares(train, ("rubric",), "y_true").select(
        "rubric", "label", "n", F.round("share", DIGITS).alias("share"), "place")


def _majority(spark, sf_dir):
    p = _parsed_split(spark, sf_dir)
    train = p.where("split = 'train'")
    test = p.where("split = 'test'").select("doc_id", "rubric", "y_true")
    return BL.baseline_majority(train, test, ("rubric",), "y_true", "y_pred")


@register("baseline_majority")
def q_baseline_majority(spark, sf_dir):
    return _majority(spark, sf_dir)


N_DRAWS = 1000


def _sampled(spark, sf_dir):
    p = _parsed_split(spark, sf_dir)
    train = p.where("split = 'train'")
    test = p.where("split = 'test'").select("doc_id", "rubric", "y_true")
    return BL.baseline_sampled(train, test, "doc_id", N_DRAWS, SEED, ("rubric",), "y_true", "y_pred")


@register("baseline_sampled")
def q_baseline_sampled(spark, sf_dir):
    return _sampled(spark, sf_dir)


@register("align_predictions")
def q_align_predictions(spark, sf_dir):
    truth = parsed_long(spark, sf_dir).select("doc_id", "rubric", "y_true")
    preds = fx.second_rater(spark, sf_dir)
    return M.align_predictions(truth, preds, ("doc_id", "rubric"))


@register("qwk_cv")
def q_qwk_cv(spark, sf_dir):
    folds = SPL.kfold_exact(fx.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5, SEED)
    p = parsed_long(spark, sf_dir).join(folds, "doc_id")
    per_rubric, _ = M.qwk_cv(p, "fold", "rubric")
    # One row per rubric: the macro mean is a window over that tiny table.
    macro = F.avg("qwk_mean").over(Window.partitionBy())
    return per_rubric.select("rubric", F.round("qwk_mean", DIGITS).alias("qwk_mean"), "n_folds",
                             F.round(macro, DIGITS).alias("qwk_macro"))


def _metrics_log(spark, sf_dir):
    """A training log stand-in: run = event type, epoch = event id, qwk from the value."""
    ev = fx.read(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("run"), F.col("event_id").alias("epoch"),
                     ((F.col("value") - 10.0) / 10.0).alias("qwk"))


@register("best_run")
def q_best_run(spark, sf_dir):
    b = M.best_run(_metrics_log(spark, sf_dir), ("run",), "epoch", "qwk")
    return b.select("run", "epoch", F.round("qwk", DIGITS).alias("qwk"))


@register("model_compare")
def q_model_compare(spark, sf_dir):
    """Second rater, majority and sampled baselines on the test split, compared by macro QWK.

    The parsed, split table is written once (a reliable checkpoint) and read by all
    three raters; their predictions are stacked and scored by one QWK aggregate
    grouped by (model, rubric).
    """
    p = cut_lineage(_parsed_split(spark, sf_dir))
    train = p.where("split = 'train'")
    test = p.where("split = 'test'").select("doc_id", "rubric", "y_true")
    preds = (p.where("split = 'test'").select(F.lit("second_rater").alias("model"), "doc_id", "rubric", "y_true",
                                             "y_pred")
             .unionByName(BL.baseline_majority(train, test, ("rubric",), "y_true", "y_pred")
                          .select(F.lit("majority").alias("model"), "doc_id", "rubric", "y_true", "y_pred"))
             .unionByName(BL.baseline_sampled(train, test, "doc_id", N_DRAWS, SEED, ("rubric",), "y_true", "y_pred")
                          .select(F.lit("sampled").alias("model"), "doc_id", "rubric", "y_true", "y_pred")))
    per = M.qwk(preds.where(F.col("y_pred").isNotNull()), ("model", "rubric"))
    models = M.qwk_macro(per, by=("model",)).select("model", F.col("qwk_macro").alias("qwk"))
    out = M.model_compare(models, "model", "qwk")
    return out.select("model", F.round("qwk", DIGITS).alias("qwk"), F.round("gain", DIGITS).alias("gain"))


# ---------------------------------------------------------------- report

def _parsed_wide(spark, sf_dir):
    """Wide table whose scores are parsed from the rationales (as the judge stage produces)."""
    wide = fx.rated_wide(spark, sf_dir)
    return wide.select("doc_id", "link", "transcript", *[
        c for r in SC.RUBRICS for c in (tx.extract_score(f"{r}_score_rationale").alias(f"{r}_score"),
                                        F.col(f"{r}_score_rationale"))])


@register("rating_report")
def q_rating_report(spark, sf_dir):
    wide = _parsed_wide(spark, sf_dir).withColumn(
        "transcript", F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("transcript")))
    return RP.rating_report(wide, "doc_id")


@register("explanation")
def q_explanation(spark, sf_dir):
    return RP.explanation(_parsed_wide(spark, sf_dir), "doc_id")


@register("verdict")
def q_verdict(spark, sf_dir):
    v = RP.verdict(_parsed_wide(spark, sf_dir), "doc_id")
    return v.select("doc_id", F.round("overall", DIGITS).alias("overall"), "passed", "verdict")


# ---------------------------------------------------------------- text features

def _doc_split(spark, sf_dir):
    return SPL.split_holdout(fx.read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 0.2, SEED)


@register("top_terms")
def q_top_terms(spark, sf_dir):
    return FE.top_terms(_doc_split(spark, sf_dir).where("split = 'train'"), FE.MAX_FEATURES)


@register("tfidf")
def q_tfidf(spark, sf_dir):
    docs = _doc_split(spark, sf_dir)
    model = FE.fit_tfidf(docs.where("split = 'train'"), FE.MAX_FEATURES)
    out = FE.transform_tfidf(docs, model, "doc_id")
    return out.select("doc_id", "idx", "term", F.round("weight", DIGITS).alias("weight"))


# Words whose share of a text gives each rubric a target that its words explain.
TARGET_WORDS = {"clarity": "the", "team_market_fit": "of", "traction_validation": "is"}


def learnable_scores():
    """Score columns that depend on the tokens ``_t``: 1 to 5 by occurrences of the rubric's word per hundred tokens."""
    return [F.expr(f"cast(1 + least(4, 100 * size(filter(_t, x -> x = '{w}')) div greatest(size(_t), 1)) as int) as {r}_score")
            for r, w in TARGET_WORDS.items()]


def _learnable(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").select("doc_id", "text", tx.tokens("text").alias("_t"))
    return SPL.split_holdout(d.select("doc_id", "text", *learnable_scores()), "doc_id", 0.2, SEED)


@register("pca")
def q_pca(spark, sf_dir):
    """PCA of the documents' TF-IDF vectors, 500 terms reduced to 100 components. Of the whole spectrum: its sum, and how
    many axes of one size would have the same sum and sum of squares (and the same sums of squares and fourth powers); of the
    reduced rows: how many components, whether their means are 0 and their variances those of the axes."""
    docs = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    space = RT.fit_features(docs)
    rows = RT.featurize(space, docs).select(vector_to_array("features").alias("x"))
    axes = F.array(*[F.lit(float(v)) for v in space.variances[:RT.PCA_K]])
    per = rows.select(F.posexplode("x").alias("axis", "x")).groupBy("axis").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    e = space.variances
    numbers = {"total_variance": e.sum(), "effective_axes": e.sum() ** 2 / (e**2).sum(), "peak_axes": (e**2).sum() ** 2 / (e**4).sum()}
    return per.agg(F.lit(len(space.terms)).cast("bigint").alias("n_terms"), F.count(F.lit(1)).alias("n_axes"),
                   (F.round(F.max(F.abs("mean")), DIGITS) + F.lit(0.0)).alias("largest_mean"),
                   (F.max(F.abs(F.col("var") - F.get(axes, F.col("axis")))) < 1e-9).alias("variances_match"),
                   *[F.round(F.lit(float(v)), DIGITS).alias(name) for name, v in numbers.items()])


def _rated_by_svm(spark, sf_dir):
    wide = _learnable(spark, sf_dir)
    return wide, RT.fit_predict(wide.where("split = 'train'"), wide.where("split = 'test'"), "doc_id")


@register("svm_rater")
def q_svm_rater(spark, sf_dir):
    """Every rubric's rater on the test split: rows, predictions outside the trained labels, and whether it is right more
    often than the majority class."""
    wide, preds = _rated_by_svm(spark, sf_dir)
    train = wide.where("split = 'train'").select(F.explode(F.array(*[F.struct(F.lit(r).alias("rubric"), F.col(f"{r}_score").alias("label"))
                                                                     for r in SC.RUBRICS])).alias("s")).select("s.*")
    known = train.select("rubric", F.col("label").alias("y_pred"), F.lit(True).alias("known")).distinct()
    major = BL.majority_class(train).withColumnRenamed("label", "major")
    scored = preds.join(known, ["rubric", "y_pred"], "left").join(major, "rubric")
    return scored.groupBy("rubric").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("n_unknown"),
        (F.count_if(F.col("y_pred") == F.col("y_true")) > F.count_if(F.col("major") == F.col("y_true"))).alias("beats_majority"))


def _test_qwk(spark, sf_dir):
    per = M.qwk(_rated_by_svm(spark, sf_dir)[1], ("rubric",))
    return per.withColumn("macro", F.avg("qwk").over(Window.partitionBy()))


@register("svm_test")
def q_svm_test(spark, sf_dir):
    """TF-IDF -> PCA -> one-vs-rest SVM per rubric, fitted on the train split: QWK on the test split, and its mean. The
    majority class has QWK 0; ``learned`` says that the rater does clearly better."""
    return _test_qwk(spark, sf_dir).select("rubric", "n", (F.col("qwk") > 0.2).alias("learned"), (F.col("macro") > 0.2).alias("macro_learned"))


@register("svm_test_qwk")
def q_svm_test_qwk(spark, sf_dir):
    """The numbers of ``svm_test``: QWK of every rubric on the test split, and their mean."""
    return _test_qwk(spark, sf_dir).select("rubric", "n", F.round("qwk", DIGITS).alias("qwk"), F.round("macro", DIGITS).alias("qwk_macro"))


def _cv_qwk(spark, sf_dir):
    train = SPL.kfold_hash(_learnable(spark, sf_dir).where("split = 'train'"), "doc_id", 5, SEED)
    return _both_sides(RT.cross_validate(train, "doc_id", "fold", 5)[0])


def _both_sides(per_rubric):
    return per_rubric.groupBy("rubric").agg(
        F.max("n_folds").alias("n_folds"), F.max(F.when(F.col("side") == "train", F.col("qwk_mean"))).alias("qwk_train"),
        F.max(F.when(F.col("side") == "test", F.col("qwk_mean"))).alias("qwk_held_out"))


@register("svm_cv")
def q_svm_cv(spark, sf_dir):
    """5-fold cross-validation on the train split, features and raters fitted for each fold: mean QWK of the rows
    fitted on and of the held-out folds, checked for sign and order."""
    return _cv_qwk(spark, sf_dir).select("rubric", "n_folds", (F.col("qwk_train") >= F.col("qwk_held_out")).alias("train_not_worse"),
                                         (F.col("qwk_held_out") > 0.1).alias("learned"))


@register("svm_cv_qwk")
def q_svm_cv_qwk(spark, sf_dir):
    """The numbers of ``svm_cv``: mean QWK over the folds, of the rows fitted on and of the rows held out."""
    return _cv_qwk(spark, sf_dir).select("rubric", "n_folds", F.round("qwk_train", DIGITS).alias("qwk_train"),
                                         F.round("qwk_held_out", DIGITS).alias("qwk_held_out"))


#: Words whose share of a text (per hundred tokens) are the two features of ``svm_words_cv``.
FEATURE_WORDS = ("the", "of")


@register("svm_words_cv")
def q_svm_words_cv(spark, sf_dir):
    """Squared-hinge raters on two numbers per document, shares of words, cross-validated over all documents: rows
    predicted and mean QWK over the folds, fitted on and held out. Small enough for SQL to fit them too."""
    d = fx.read(spark, sf_dir, "documents").select("doc_id", tx.tokens("text").alias("_t"))
    shares = [F.expr(f"100.0D * size(filter(_t, x -> x = '{w}')) / greatest(size(_t), 1) as share_{w}") for w in FEATURE_WORDS]
    folds = SPL.kfold_hash(d.select("doc_id", *shares, *learnable_scores()), "doc_id", 5, SEED)
    preds = RT.rate_columns(folds, "doc_id", [f"share_{w}" for w in FEATURE_WORDS], "fold", 5)
    rows = M.qwk_cv(preds, "fold", "rubric", by=("side",))[0]
    return _both_sides(rows).select("rubric", "n_folds", F.round("qwk_train", DIGITS).alias("qwk_train"),
                                    F.round("qwk_held_out", DIGITS).alias("qwk_held_out"))


# ---------------------------------------------------------------- enrichment

@register("judge_apply")
def q_judge_apply(spark, sf_dir):
    """Every rubric of every document judged in one pass, one wide row per document; failed transcripts are left out."""
    todo = C.drop_errors(fx.transcripts(spark, sf_dir, with_errors=True))
    return EN.judge_documents(todo, EN.length_scorer_factory, "transcript", ("doc_id",))


@register("judge_capture")
def q_judge_capture(spark, sf_dir):
    """The judging pass with a scorer that fails whole batches: the rows that cause it are found, kept with their error
    and left without a score; all others are judged."""
    docs = fx.transcripts(spark, sf_dir, with_errors=False)
    return EN.judge_documents(docs, EN.failing_scorer_factory, "transcript", ("doc_id",), on_error="capture", batch_size=256)


@register("judge_agreement")
def q_judge_agreement(spark, sf_dir):
    """A second rater (the distilled model's role, a scorer of its own) re-rates the test split; its parsed scores are
    compared with the first rater's by QWK per rubric. The first rater's scores ride along as key columns."""
    wide = SPL.split_holdout(fx.rated_wide(spark, sf_dir), "doc_id", 0.2, SEED).where("split = 'test'")
    truth = [tx.extract_score(f"{r}_score_rationale").alias(f"{r}_true") for r in SC.RUBRICS]
    judged = EN.judge_documents(wide.select("doc_id", "transcript", *truth), EN.word_scorer_factory, "transcript",
                                ("doc_id", *[f"{r}_true" for r in SC.RUBRICS]), args={"marker": "the", "per": 10})
    pairs = R.unpivot_ratings(judged, keep=("doc_id",), extra=("true",))
    return M.qwk(pairs.select(R.rubric_of().alias("rubric"), F.col("true").alias("y_true"), F.col("score").alias("y_pred")),
                 ("rubric",)).select("rubric", "n", F.round("qwk", DIGITS).alias("qwk"))


@register("enrich_empty")
def q_enrich_empty(spark, sf_dir):
    """The empty-text policy, a batch size and an argument of the model: every 10th document fails and stays, without text."""
    d = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = EN.enrich(d, EN.failing_transcriber_factory, ["doc_id", "text"], "transcript", on_error="empty", batch_size=64,
                    args={"fail_every": 10})
    return out.select("doc_id", "transcript", "error")


@register("enrich_nullable")
def q_enrich_nullable(spark, sf_dir):
    """Nullable integers only carried: large keys beside NULLs come out of the map as they went in."""
    d = fx.read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 7).cast("int").alias("small"),
        F.when(F.col("doc_id") % 3 > 0, F.lit(9007199254740993) + F.col("doc_id")).alias("big"))
    out = EN.enrich(d, EN.failing_transcriber_factory, ["big", "text"], "transcript", on_error="capture")
    return out.select("doc_id", "small", "big", F.col("error").isNotNull().alias("failed"))


@register("enrich_capture")
def q_enrich_capture(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = EN.enrich(d, EN.failing_transcriber_factory, ["doc_id", "text"], "transcript", on_error="capture")
    return out.select("doc_id", "transcript", "error")


@register("stream_resume")
def q_stream_resume(spark, sf_dir):
    """documents arrive as a file stream; each new doc_id is transcribed once. A second run
    with a fresh checkpoint finds every key in the sink and appends nothing."""
    from ratingspark.streaming.resume import latest, run_incremental

    schema = fx.read(spark, sf_dir, "documents").select("doc_id", "text").schema
    sink = scratch_path(spark, "stream_sink")

    def transcribe(rows):
        return EN.enrich(rows.select("doc_id", "text"), EN.failing_transcriber_factory, ["doc_id", "text"],
                         "transcript", on_error="capture").select("doc_id", "transcript", "error")

    # A table is one file or a folder of files. A file stream takes a single file only if its path is a pattern.
    source = f"{sf_dir}/{{documents.parquet}}"
    for run in ("first", "again"):
        run_incremental(spark, source, schema, sink, scratch_path(spark, f"stream_ckpt_{run}"), "doc_id", transcribe)
    return latest(spark, sink, "doc_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_qwk(spark, sf_dir)
