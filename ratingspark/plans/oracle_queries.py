"""DuckDB SQL for each registered query (same names and column aliases)."""

from __future__ import annotations

from ratingspark.functions.hashing import threshold_hex
from ratingspark.plans import oracle as O
from ratingspark.schemas import RUBRICS

SQL: dict[str, str] = {}

_PARSED_LONG = (
    f"SELECT doc_id, regexp_replace(rationale_type, '_score$', '') AS rubric, "
    f"{O.extract_score_sql('rationale')} AS y_true, pred AS y_pred "
    f"FROM ({O.long_sql(with_pred=True, keep=('doc_id',))})"
)

SQL["unpivot_ratings"] = O.long_sql()

SQL["extract_score"] = (
    f"SELECT doc_id, rationale_type, {O.extract_score_sql('rationale')} AS parsed, "
    f"{O.extract_score_sql('rationale', None)} AS parsed_strict FROM ({O.long_sql(keep=('doc_id',))})"
)

_STRICT = O.extract_score_sql("rationale", None)
SQL["score_audit"] = (
    f"SELECT regexp_replace(rationale_type, '_score$', '') AS rubric, count(*) AS n, "
    f"count(*) FILTER (WHERE {_STRICT} IS NOT NULL) AS n_parsed, "
    f"count(*) FILTER (WHERE {_STRICT} IS NULL) AS n_defaulted, "
    f"count(*) FILTER (WHERE {_STRICT} IS NOT NULL AND ({_STRICT} < 1 OR {_STRICT} > 5)) AS n_out_of_range "
    f"FROM ({O.long_sql(keep=('doc_id',))}) GROUP BY 1"
)

SQL["confusion"] = f"SELECT rubric, y_true, y_pred, count(*) AS n FROM ({_PARSED_LONG}) GROUP BY ALL"

SQL["qwk"] = (
    f"SELECT o.rubric, o.n, o.qwk, f.qwk AS qwk_fixed FROM ({O.qwk_sql(_PARSED_LONG)}) o "
    f"JOIN ({O.qwk_sql(_PARSED_LONG, label_space='fixed')}) f USING (rubric)"
)

SQL["qwk_macro"] = (
    f"SELECT round(avg(qwk), 6) AS qwk_macro, count(*) AS n_groups FROM "
    f"({O.qwk_sql(_PARSED_LONG, digits=None)})"
)

# ---------------------------------------------------------------- curation

_GRID = (
    "SELECT CAST(row_number() OVER (ORDER BY batch) - 1 AS INTEGER) AS qid, batch, "
    "'YC ' || batch || ' Application Video' AS query FROM ("
    "SELECT s || CAST(y AS VARCHAR) AS batch FROM (VALUES ('W'), ('S')) t(s), range(10, 26) r(y) "
    "UNION SELECT s || ' ' || CAST(y AS VARCHAR) FROM (VALUES ('Winter'), ('Summer')) t(s), range(2010, 2026) r(y) "
    "UNION SELECT 'F24' UNION SELECT 'Fall 2024')"
)
_HITS = (
    f"SELECT h.*, g.query FROM (SELECT page_id, CAST({O.unit_hash_sql('q', 'page_id')} % 66 AS INTEGER) AS qid, "
    f"{O.unit_hash_sql('r', 'page_id')} AS rank_key, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, "
    f"url AS link FROM pages) h JOIN ({_GRID}) g USING (qid)"
)


def clean_url_sql(u: str, keep: str) -> str:
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\\-]*:)', 1))"
    base = f"regexp_replace(regexp_extract({u}, '^([^?#]*)', 1), '^[A-Za-z][A-Za-z0-9+.\\-]*:', '')"
    query = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    frag = f"regexp_extract({u}, '#(.*)$', 1)"
    kept = (f"array_to_string(list_filter(string_split({query}, '&'), "
            f"lambda x: starts_with(x, '{keep}=') AND length(x) > {len(keep) + 1}), '&')")
    return (f"({scheme} || {base} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END || "
            f"CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END)")


SANITIZE = "regexp_replace({0}, '[^a-zA-Z0-9_\\-]', '_', 'g')"

SQL["query_grid"] = (
    f"SELECT g.qid, g.batch, g.query, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hits FROM ({_GRID}) g "
    f"LEFT JOIN (SELECT qid, count(*) AS n FROM ({_HITS}) GROUP BY qid) c USING (qid)"
)
SQL["corpus_build"] = (
    f"SELECT DISTINCT title, {clean_url_sql('link', 'page')} AS link FROM ("
    f"SELECT * FROM ({_HITS}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank_key, page_id) <= 20) "
    f"WHERE contains(lower(title), 'en')"
)
SQL["title_filter"] = f"SELECT doc_id, title FROM ({O.transcripts_sql()}) WHERE contains(lower(title), 'en')"
SQL["clean_url"] = (f"SELECT page_id, url, {clean_url_sql('url', 'page')} AS clean, "
                    f"{clean_url_sql('url', 'v')} AS clean_v FROM pages")
SQL["sanitize_name"] = f"SELECT page_id, {SANITIZE.format('url')} AS name FROM pages"
SQL["host_filter"] = "SELECT page_id, url FROM pages WHERE contains(url, 'example.org') OR contains(url, 'blog.')"
_DL = "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"
SQL["drop_null_text"] = f"SELECT * FROM ({_DL}) WHERE quality IS NOT NULL"
SQL["null_policy"] = f"SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'nan') AS quality_text FROM ({_DL})"
SQL["preview"] = ("SELECT doc_id, substr(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), 1, 200) "
                  "AS preview FROM documents")
SQL["resume_anti_join"] = (f"SELECT link, title FROM ({O.transcripts_sql()}) t "
                           "WHERE link NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
SQL["dedup_pairs"] = f"SELECT DISTINCT title, {clean_url_sql('link', 'v')} AS link FROM ({_HITS})"
SQL["dedup_links"] = (f"SELECT min(title) AS title, {clean_url_sql('link', 'v')} AS link FROM ({_HITS}) "
                      "GROUP BY 2")
SQL["top_n_per_group"] = ("SELECT event_id, user_id, event_type, value FROM events "
                          "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 20")
SQL["drop_errors"] = f"SELECT doc_id, link FROM ({O.transcripts_sql()}) WHERE NOT starts_with(transcript, 'ERROR: ')"

# ---------------------------------------------------------------- sources and sinks

SQL["csv_roundtrip"] = f"SELECT title, link, transcript FROM ({O.transcripts_sql()})"
SQL["json_roundtrip"] = (
    "SELECT CAST(doc_id AS BIGINT) AS id, transcript, "
    + ", ".join(f"{r}_score, {r}_score_rationale" for r in RUBRICS)
    + f" FROM ({O.rated_wide_sql()})"
)
SQL["csv_blocks"] = SQL["csv_roundtrip"]
SQL["json_blocks"] = SQL["json_roundtrip"]
SQL["text_sink"] = "SELECT line FROM documents, unnest(string_split(text, chr(10))) AS t(line)"
SQL["text_documents"] = f"SELECT doc_id, transcript FROM ({O.transcripts_sql()})"
SQL["published_dataset"] = ("SELECT w.*, d.lang"
                            f" FROM ({O.rated_wide_sql()}) w JOIN documents d USING (doc_id)")
_SUFFIX = "('https://videos.example.com' || regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1))"
SQL["absolute_links"] = f"SELECT page_id, {clean_url_sql(_SUFFIX, 'page')} AS link FROM pages"
SQL["match_media"] = (
    "SELECT l.id, min(p.name) AS name FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM labels) l "
    f"LEFT JOIN (SELECT DISTINCT {SANITIZE.format('url')} AS name FROM pages) p ON contains(p.name, l.id) GROUP BY l.id"
)

SQL["media_listing"] = SQL["match_media"]

# ---------------------------------------------------------------- reshaping, prompts, chats

_NEST = ("struct_pack(" + ", ".join(
    f"{r} := struct_pack(rationale := {r}_score_rationale, score := {r}_score)" for r in RUBRICS) + ")")
SQL["nest_ratings"] = (f"SELECT CAST(doc_id AS BIGINT) AS id, transcript, to_json({_NEST}) AS rationales_json "
                       f"FROM ({O.rated_wide_sql()})")
SQL["flatten_nested"] = SQL["json_roundtrip"]
SQL["seq2seq_pairs"] = (
    "SELECT doc_id, 'Rate this pitch transcript: ' || coalesce(transcript, '') AS input_text, "
    + " || chr(10) || ".join(
        f"'{r}: ' || coalesce({r}_score_rationale, '') || ' (score ' || coalesce(CAST({r}_score AS VARCHAR), '') || ')'"
        for r in RUBRICS)
    + f" AS target_text FROM ({O.rated_wide_sql()})"
)


def _rubric_values() -> str:
    rows = []
    for r in RUBRICS:
        label = r.replace("_", " ")
        sys_p = f"You grade pitch transcripts on {label}. Explain briefly, then give a score as [[n]] with n from 1 to 5."
        rows.append(f"('{r}', '{sys_p}', 'Rate the {label} of this pitch transcript:' || chr(10))")
    return "(VALUES " + ", ".join(rows) + ") AS rt(rubric, system_prompt, user_prefix)"


_REQ = (f"SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'pitch_energy' "
        f"ELSE regexp_replace(rationale_type, '_score$', '') END AS rubric, transcript, rationale, score "
        f"FROM ({O.long_sql(keep=('doc_id', 'transcript'))})")
def _prompted_sql(req: str) -> str:
    known = ", ".join(repr(r) for r in RUBRICS)
    return (
        f"SELECT q.*, q.rubric IN ({known}) IS NOT TRUE AS unknown_rubric, "
        f"rt.rubric AS prompt_rubric, rt.system_prompt, rt.user_prefix || coalesce(q.transcript, '') AS user_prompt "
        f"FROM ({req}) q JOIN {_rubric_values()} ON rt.rubric = CASE WHEN q.rubric IN ({known}) "
        f"THEN q.rubric ELSE '{RUBRICS[-1]}' END"
    )


_PROMPTED = _prompted_sql(_REQ)
SQL["build_prompts"] = (f"SELECT doc_id, rubric, prompt_rubric, unknown_rubric, system_prompt, user_prompt "
                        f"FROM ({_PROMPTED})")
_TRAIN = f"(NOT ({O.below_sql('42', 'doc_id', 0.2)}))"
_MSG = "struct_pack(role := '{0}', content := {1})"
_EMPTY_COALESCE = "coalesce(rationale, '')"
_CHATS = (
    f"SELECT doc_id, rubric, {_TRAIN} AS train, CASE WHEN {_TRAIN} THEN ["
    f"{_MSG.format('system', 'system_prompt')}, {_MSG.format('user', 'user_prompt')}, "
    f"{_MSG.format('assistant', _EMPTY_COALESCE)}] ELSE ["
    f"{_MSG.format('system', 'system_prompt')}, {_MSG.format('user', 'user_prompt')}] END AS chat "
    f"FROM ({_PROMPTED})"
)
SQL["build_chats"] = ("SELECT doc_id, rubric, train, CAST(len(chat) AS INTEGER) AS n_messages, "
                      f"to_json(chat) AS chat_json FROM ({_CHATS})")
_BOS, _ST, _EOT = "'<|begin_of_text|>'", "'<|start_header_id|>'", "'<|eot_id|>'"
_MID = "'<|end_header_id|>' || chr(10) || chr(10)"
_RENDER = (f"{_BOS} || array_to_string(list_transform(chat, lambda m: {_ST} || m.role || {_MID} || "
           f"coalesce(m.content, '') || {_EOT}), '')")
_AHDR = f"({_ST} || 'assistant' || {_MID})"
SQL["render_chats"] = (f"SELECT doc_id, rubric, train, CASE WHEN train THEN {_RENDER} ELSE {_RENDER} || {_AHDR} END "
                       f"AS text FROM ({_CHATS})")
SQL["response_span"] = (
    f"SELECT doc_id, rubric, CASE WHEN r IS NOT NULL THEN substr(t, 1, length(t) - length(r)) END AS prompt_part, "
    f"r AS response_part, CAST(CASE WHEN r IS NOT NULL THEN length(t) - length(r) + 1 ELSE 0 END AS INTEGER) "
    f"AS response_start FROM (SELECT doc_id, rubric, t, CASE WHEN contains(t, {_AHDR}) THEN "
    f"string_split(t, {_AHDR})[-1] END AS r FROM (SELECT doc_id, rubric, {_RENDER} AS t FROM ({_CHATS}) WHERE train))"
)

# ---------------------------------------------------------------- token arrays, argmax, loss

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
SQL["tokenize"] = (f"SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS n_tokens, array_to_string({_TOK}, ' ') AS tokens "
                   "FROM documents")
_IDS = f"list_transform({_TOK}, lambda t: CAST(('0x' || substr(md5(t), 1, 4)) AS INTEGER) + 1)"
SQL["pad_truncate"] = (
    "SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tokens, "
    "array_to_string(list_resize(ids[1:512], 512, 0), ',') AS input_ids, "
    "array_to_string(list_transform(range(1, 513), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ',') "
    f"AS attention_mask FROM (SELECT doc_id, {_IDS} AS ids FROM documents)"
)
_TOKS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_IDS_OF = "list_transform({0}, lambda t: CAST(('0x' || substr(md5(t), 1, 4)) AS INTEGER) + 1)"
SQL["response_mask"] = (
    "SELECT doc_id, rubric, CAST(len(p) + len(r) AS INTEGER) AS n_ids, CAST(len(p) AS INTEGER) AS first_token, CAST(len(r) AS INTEGER) AS n_tokens, "
    "md5(array_to_string(labels, ',')) AS labels_md5, md5(array_to_string(list_resize(labels[1:512], 512, -100), ',')) AS cut_md5 FROM ("
    f"SELECT *, list_concat(list_transform(p, lambda x: -100), {_IDS_OF.format('r')}) AS labels FROM ("
    f"SELECT doc_id, rubric, {_TOKS.format('prompt_part')} AS p, {_TOKS.format('response_part')} AS r FROM ({SQL['response_span']})))"
)
SQL["argmax_class"] = (
    "SELECT vec_id, label, CAST(p - 1 AS INTEGER) AS pred_class, CAST(p AS INTEGER) AS pred_score FROM "
    "(SELECT vec_id, label, list_position(embedding, list_max(embedding)) AS p FROM embeddings)"
)


def _ce(arr: str, target: str) -> str:
    a = f"list_transform({arr}, lambda x: CAST(x AS DOUBLE))"
    return (f"(list_max({a}) + ln(list_sum(list_transform({a}, lambda x: exp(x - list_max({a})))))"
            f" - {a}[{target}])")


_LOSS_ROWS = (
    "SELECT vec_id % 4 AS grp, "
    f"{_ce('embedding[1:22]', 'label % 22 + 1')} AS ce_a, "
    f"{_ce('embedding[23:43]', 'CAST(floor(label / 2) AS BIGINT) % 21 + 1')} AS ce_b, "
    f"{_ce('embedding[44:64]', '(vec_id + label) % 21 + 1')} AS ce_c FROM embeddings"
)
SQL["multitask_loss"] = (
    "SELECT grp, count(*) AS n, round(avg(ce_a), 6) AS ce_a, round(avg(ce_b), 6) AS ce_b, "
    "round(avg(ce_c), 6) AS ce_c, round(avg(ce_a * 1.0 + ce_b * 0.5 + ce_c * 2.0), 6) AS loss "
    f"FROM ({_LOSS_ROWS}) GROUP BY grp"
)

# ---------------------------------------------------------------- splits and folds

_HOLD = f"CASE WHEN {O.below_sql('42', 'doc_id', 0.2)} THEN 'test' ELSE 'train' END"
SQL["split_holdout"] = f"SELECT doc_id, {_HOLD} AS split FROM documents"
_H8 = "substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)"
SQL["split_three_way"] = (f"SELECT doc_id, CASE WHEN {_H8} < '{threshold_hex(0.15)}' THEN 'test' "
                          f"WHEN {_H8} < '{threshold_hex(0.3)}' THEN 'val' ELSE 'train' END AS split FROM documents")
_LONG_KEYS = (f"SELECT doc_id, regexp_replace(rationale_type, '_score$', '') AS rubric "
              f"FROM ({O.long_sql(keep=('doc_id',))})")
SQL["split_grouped"] = f"SELECT doc_id, rubric, {_HOLD} AS split FROM ({_LONG_KEYS})"
_ROW_HOLD = ("CASE WHEN substr(md5('42:' || CAST(doc_id AS VARCHAR) || ':' || rubric), 1, 8) < "
             f"'{threshold_hex(0.2)}' THEN 'test' ELSE 'train' END")


def _leak(side: str) -> str:
    return (f"SELECT count(*) AS n_groups, count(*) FILTER (WHERE s > 1) AS n_leaked FROM "
            f"(SELECT doc_id, count(DISTINCT {side}) AS s FROM ({_LONG_KEYS}) GROUP BY doc_id)")


SQL["leak_count"] = (f"SELECT 'row' AS split_key, * FROM ({_leak(_ROW_HOLD)}) "
                     f"UNION ALL SELECT 'document', * FROM ({_leak(_HOLD)})")
SQL["kfold"] = ("SELECT doc_id, CAST(ntile(5) OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 "
                "AS INTEGER) AS fold FROM documents")
SQL["kfold_hash"] = f"SELECT doc_id, CAST({O.unit_hash_sql('42', 'doc_id')} % 5 AS INTEGER) AS fold FROM documents"

# ---------------------------------------------------------------- baselines and metrics

_PSPLIT = f"SELECT *, {_HOLD} AS split FROM ({_PARSED_LONG})"
_TRAIN_ROWS = f"SELECT * FROM ({_PSPLIT}) WHERE split = 'train'"
_TEST_ROWS = f"SELECT doc_id, rubric, y_true FROM ({_PSPLIT}) WHERE split = 'test'"
SQL["label_shares"] = (
    "SELECT rubric, label, n, round(n / sum(n) OVER (PARTITION BY rubric), 6) AS share, "
    "CAST(row_number() OVER (PARTITION BY rubric ORDER BY label) AS INTEGER) AS place FROM "
    f"(SELECT rubric, y_true AS label, count(*) AS n FROM ({_TRAIN_ROWS}) WHERE y_true IS NOT NULL GROUP BY ALL)"
)
_MAJ = (f"SELECT rubric, label AS y_pred FROM (SELECT rubric, y_true AS label, count(*) AS n FROM ({_TRAIN_ROWS}) "
        "WHERE y_true IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rubric ORDER BY n DESC, label) = 1")
_MAJ_ROWS = f"SELECT t.doc_id, t.rubric, t.y_true, CAST(m.y_pred AS INTEGER) AS y_pred FROM ({_TEST_ROWS}) t LEFT JOIN ({_MAJ}) m USING (rubric)"
SQL["baseline_majority"] = _MAJ_ROWS
_CUM = (
    "SELECT rubric, label, sum(c) OVER (PARTITION BY rubric ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c AS lo, "
    "sum(c) OVER (PARTITION BY rubric ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, "
    "sum(c) OVER (PARTITION BY rubric) AS tot FROM "
    f"(SELECT rubric, y_true AS label, count(*) AS c FROM ({_TRAIN_ROWS}) WHERE y_true IS NOT NULL GROUP BY ALL)"
)
_DRAWS = (
    "SELECT t.doc_id, t.rubric, CAST(('0x' || substr(md5('42:' || CAST(t.doc_id AS VARCHAR) || ':' || t.rubric || "
    "':' || CAST(b.j AS VARCHAR)), 8 * k.k + 1, 8)) AS BIGINT) AS u "
    f"FROM ({_TEST_ROWS}) t, range(0, 250) b(j), range(0, 4) k(k) WHERE b.j * 4 + k.k < 1000"
)
_PICK = (
    f"SELECT d.doc_id, d.rubric, c.label, count(*) AS k FROM ({_DRAWS}) d JOIN ({_CUM}) c ON c.rubric = d.rubric "
    "AND CAST(c.lo AS HUGEINT) * 4294967296 <= CAST(d.u AS HUGEINT) * c.tot "
    "AND CAST(d.u AS HUGEINT) * c.tot < CAST(c.hi AS HUGEINT) * 4294967296 GROUP BY ALL"
)
_SAMPLED_ROWS = (
    f"SELECT t.doc_id, t.rubric, t.y_true, CAST(p.label AS INTEGER) AS y_pred FROM ({_TEST_ROWS}) t LEFT JOIN "
    f"(SELECT * FROM ({_PICK}) QUALIFY row_number() OVER (PARTITION BY doc_id, rubric ORDER BY k DESC, label) = 1) p "
    "USING (doc_id, rubric)"
)
SQL["baseline_sampled"] = _SAMPLED_ROWS
_SECOND = (
    "WITH w AS (SELECT doc_id, " + ", ".join(f"{O.pred_sql(r)} AS p{i}" for i, r in enumerate(RUBRICS))
    + " FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rubric, p{i} AS y_pred FROM w"
                                               for i, r in enumerate(RUBRICS))
)
SQL["align_predictions"] = (
    f"SELECT t.doc_id, t.rubric, t.y_true, s.y_pred FROM (SELECT doc_id, rubric, y_true FROM ({_PARSED_LONG})) t "
    f" JOIN ({_SECOND}) s USING (doc_id, rubric)"
)
_FOLDS = ("SELECT doc_id, CAST(ntile(5) OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 "
          "AS INTEGER) AS fold FROM documents")
_CV_ROWS = f"SELECT p.*, f.fold FROM ({_PARSED_LONG}) p JOIN ({_FOLDS}) f USING (doc_id)"
SQL["qwk_cv"] = (
    "SELECT rubric, round(qm, 6) AS qwk_mean, n_folds, round(avg(qm) OVER (), 6) AS qwk_macro FROM "
    f"(SELECT rubric, avg(qwk) AS qm, count(*) AS n_folds FROM ({O.qwk_sql(_CV_ROWS, ('rubric', 'fold'), digits=None)}) "
    "GROUP BY rubric)"
)
SQL["best_run"] = (
    "SELECT run, epoch, round(qwk, 6) AS qwk FROM (SELECT event_type AS run, event_id AS epoch, "
    "(value - 10.0) / 10.0 AS qwk FROM events) WHERE qwk > 0 "
    "QUALIFY row_number() OVER (PARTITION BY run ORDER BY qwk DESC, epoch) = 1"
)


def _macro(src: str, model: str) -> str:
    return (f"SELECT '{model}' AS model, avg(qwk) AS qwk FROM "
            f"({O.qwk_sql(f'SELECT * FROM ({src}) WHERE y_pred IS NOT NULL', digits=None)})")


_MODELS = (f"{_macro(f'SELECT * FROM ({_PSPLIT}) WHERE split = ' + chr(39) + 'test' + chr(39), 'second_rater')} "
           f"UNION ALL {_macro(_MAJ_ROWS, 'majority')} UNION ALL {_macro(_SAMPLED_ROWS, 'sampled')}")
SQL["model_compare"] = (
    "SELECT model, round(qwk, 6) AS qwk, round(qwk / nullif(lag(qwk) OVER (ORDER BY qwk ASC NULLS FIRST, model), 0) - 1, 6) "
    f"AS gain FROM ({_MODELS})"
)

# ---------------------------------------------------------------- report

_LEVELS = {5: "excellent", 4: "good", 3: "adequate", 2: "weak", 1: "poor"}


def _cat(r: str) -> str:
    return r.replace("_", " ").title()


def _desc(r: str, score: str) -> str:
    whens = " ".join(f"WHEN {score} = {s} THEN '{_cat(r)} is {_LEVELS[s]} ({s} of 5).'" for s in (5, 4, 3, 2))
    return f"CASE {whens} ELSE '{_cat(r)} is {_LEVELS[1]} (1 of 5).' END"


_PWIDE = ("SELECT doc_id, link, transcript, " + ", ".join(
    f"{O.extract_score_sql(f'{r}_score_rationale')} AS {r}_score, {r}_score_rationale" for r in RUBRICS)
    + f" FROM ({O.rated_wide_sql()})")
SQL["rating_report"] = " UNION ALL ".join(
    f"SELECT doc_id, '{_cat(r)}' AS Category, {r}_score AS \"Score (1-5)\", {_desc(r, f'{r}_score')} AS Description "
    f"FROM ({_PWIDE}) WHERE length(CASE WHEN doc_id % 11 = 0 THEN '' ELSE transcript END) > 0"
    for r in RUBRICS)
SQL["explanation"] = (
    "SELECT doc_id, concat_ws(chr(10) || chr(10), " + ", ".join(
        f"concat_ws(chr(10), {_desc(r, f'{r}_score')}, {r}_score_rationale)" for r in RUBRICS)
    + f") AS explanation FROM ({_PWIDE})"
)
_TOT = " + ".join(f"{r}_score" for r in RUBRICS)
SQL["verdict"] = (
    f"SELECT doc_id, round(({_TOT}) / 3.0, 6) AS overall, ({_TOT}) * 2 >= 21 AS passed, "
    f"CASE WHEN ({_TOT}) * 2 >= 21 THEN 'Promising pitch' WHEN ({_TOT}) * 2 < 21 THEN 'Needs more work' END AS verdict FROM ({_PWIDE})"
)

# ---------------------------------------------------------------- text features

_DSPLIT = f"SELECT doc_id, text, {_HOLD} AS split FROM documents"
_TERMS = (f"SELECT doc_id, split, term, count(*) AS tf FROM (SELECT doc_id, split, unnest({_TOK}) AS term "
          f"FROM ({_DSPLIT})) GROUP BY ALL")
_TOP = (f"SELECT term, sum(tf) AS n FROM ({_TERMS}) WHERE split = 'train' GROUP BY term "
        "ORDER BY n DESC, term LIMIT 500")
SQL["top_terms"] = _TOP
_MODEL = (
    "SELECT CAST(row_number() OVER (ORDER BY v.n DESC, v.term) - 1 AS INTEGER) AS idx, v.term, "
    f"ln((1.0 + (SELECT count(*) FROM ({_DSPLIT}) WHERE split = 'train')) / (1.0 + d.df)) + 1.0 AS idf "
    f"FROM ({_TOP}) v JOIN (SELECT term, count(*) AS df FROM ({_TERMS}) WHERE split = 'train' GROUP BY term) d "
    "USING (term)"
)
SQL["tfidf"] = (
    "SELECT doc_id, idx, term, round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)), 6) "
    f"AS weight FROM ({_TERMS}) t JOIN ({_MODEL}) m USING (term)"
)

# ---------------------------------------------------------------- enrichment

_REQ_KNOWN = (f"SELECT doc_id, regexp_replace(rationale_type, '_score$', '') AS rubric, transcript "
              f"FROM ({O.long_sql(keep=('doc_id', 'transcript'))}) WHERE doc_id % 17 <> 0")
_JUDGED = (
    "SELECT doc_id, rubric, 'Assessed ' || rubric || ' over ' || CAST(length(user_prompt) AS VARCHAR) || "
    "' characters. [[' || CAST(1 + length(user_prompt) % 5 AS VARCHAR) || ']]' AS rationale "
    f"FROM ({_prompted_sql(_REQ_KNOWN)})"
)
SQL["judge_apply"] = (
    "SELECT doc_id, " + ", ".join(
        f"max(CASE WHEN rubric = '{r}' THEN {O.extract_score_sql('rationale')} END) AS {r}_score, "
        f"max(CASE WHEN rubric = '{r}' THEN rationale END) AS {r}_score_rationale" for r in RUBRICS)
    + f" FROM ({_JUDGED}) GROUP BY doc_id"
)
_CAPTURED = (
    "SELECT doc_id, rubric, CASE WHEN length(user_prompt) % 13 = 0 THEN 'cannot rate ' || CAST(length(user_prompt) AS VARCHAR) || "
    "' characters' END AS error, CAST(1 + length(user_prompt) % 5 AS INTEGER) AS score, "
    "'Assessed ' || rubric || ' over ' || CAST(length(user_prompt) AS VARCHAR) || ' characters. [[' || "
    "CAST(1 + length(user_prompt) % 5 AS VARCHAR) || ']]' AS rationale FROM ("
    + _prompted_sql(f"SELECT doc_id, regexp_replace(rationale_type, '_score$', '') AS rubric, transcript FROM ({O.long_sql(keep=('doc_id', 'transcript'))})")
    + ")"
)
SQL["judge_capture"] = (
    "SELECT doc_id, " + ", ".join(
        f"max(CASE WHEN rubric = '{r}' AND error IS NULL THEN score END) AS {r}_score, "
        f"max(CASE WHEN rubric = '{r}' THEN coalesce('ERROR: ' || error, rationale) END) AS {r}_score_rationale, "
        f"max(CASE WHEN rubric = '{r}' THEN error END) AS {r}_score_error" for r in RUBRICS)
    + f" FROM ({_CAPTURED}) GROUP BY doc_id"
)
SQL["enrich_capture"] = (
    "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'ERROR: cannot transcribe ' || CAST(doc_id AS VARCHAR) "
    "ELSE CAST(length(coalesce(text, '')) AS VARCHAR) || ' chars: ' || coalesce(text, '') END "
    "AS transcript, CASE WHEN doc_id % 17 = 0 THEN 'cannot transcribe ' || CAST(doc_id AS VARCHAR) END AS error "
    "FROM documents"
)

SQL["enrich_empty"] = (
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE CAST(length(coalesce(text, '')) AS VARCHAR) || ' chars: ' || "
    "coalesce(text, '') END AS transcript, CASE WHEN doc_id % 10 = 0 THEN 'cannot transcribe ' || CAST(doc_id AS VARCHAR) END "
    "AS error FROM documents"
)
SQL["enrich_nullable"] = (
    "SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 7 AS INTEGER) END AS small, "
    "CASE WHEN doc_id % 3 > 0 THEN 9007199254740993 + doc_id END AS big, "
    "coalesce(doc_id % 3 > 0 AND (9007199254740993 + doc_id) % 17 = 0, false) AS failed FROM documents"
)
SQL["stream_resume"] = SQL["enrich_capture"]

_TEST_LONG = (f"SELECT doc_id, regexp_replace(rationale_type, '_score$', '') AS rubric, transcript, "
              f"{O.extract_score_sql('rationale')} AS y_true FROM ({O.long_sql(keep=('doc_id', 'transcript'))}) "
              f"WHERE {O.below_sql('42', 'doc_id', 0.2)}")
_WORDS = "string_split(p.user_prompt, ' ')"
_AGREE = (
    "SELECT p.doc_id, p.rubric, t.y_true, CAST(1 + least(4, (1000 * len(list_filter("
    f"{_WORDS}, lambda x: x = 'the'))) // len({_WORDS}) // 10) AS INTEGER) AS y_pred "
    f"FROM ({_prompted_sql(_TEST_LONG)}) p JOIN ({_TEST_LONG}) t USING (doc_id, rubric)"
)
SQL["judge_agreement"] = O.qwk_sql(_AGREE)

SQL["split_three_way_exact"] = (
    "SELECT doc_id, CASE WHEN r < ceil(CAST(0.5 AS DOUBLE) * ceil(CAST(0.3 AS DOUBLE) * n)) THEN 'test' "
    "WHEN r < ceil(CAST(0.3 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS split FROM ("
    "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r, "
    "count(*) OVER () AS n FROM documents)"
)

# ---------------------------------------------------------------- raters (F2-F5): properties that SQL can state

_ALL_TERMS = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL"
_PCA_MODEL = (
    "SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM "
    f"({_ALL_TERMS}) GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 500"
)
# The spectrum of the covariance C by its traces: of C, C^2 and C^4.
SQL["pca"] = (
    "WITH x AS MATERIALIZED (SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w "
    f"FROM ({_ALL_TERMS}) JOIN ({_PCA_MODEL}) USING (term)), "
    "s AS MATERIALIZED (SELECT term, sum(w) AS s, (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS n FROM x GROUP BY term), "
    "g AS (SELECT a.term AS i, b.term AS j, sum(a.w * b.w) AS g FROM x a JOIN x b USING (doc_id) GROUP BY ALL), "
    "c AS MATERIALIZED (SELECT a.term AS i, b.term AS j, (coalesce(g.g, 0) - a.s * b.s / a.n) / (a.n - 1) AS c "
    "FROM s a CROSS JOIN s b LEFT JOIN g ON g.i = a.term AND g.j = b.term), "
    "t AS (SELECT sum(c) FILTER (WHERE i = j) AS t1, sum(c * c) AS t2, sqrt(count(*)) AS k FROM c), "
    "f AS (SELECT sum(q * q) AS t4 FROM (SELECT a.i, b.j, sum(a.c * b.c) AS q FROM c a JOIN c b ON a.j = b.i GROUP BY ALL)) "
    "SELECT CAST(k AS BIGINT) AS n_terms, CAST(least(k, 100) AS BIGINT) AS n_axes, CAST(0 AS DOUBLE) AS largest_mean, "
    "true AS variances_match, round(t1, 6) AS total_variance, round(t1 * t1 / t2, 6) AS effective_axes, "
    "round(t2 * t2 / t4, 6) AS peak_axes FROM t, f"
)
_N_TEST = f"SELECT count(*) AS n FROM ({_DSPLIT}) WHERE split = 'test'"
_EACH = ", ".join(f"('{r}')" for r in RUBRICS)
SQL["svm_rater"] = (f"SELECT rubric, n, CAST(0 AS BIGINT) AS n_unknown, true AS beats_majority FROM (VALUES {_EACH}) AS r(rubric), "
                    f"({_N_TEST})")
SQL["svm_test"] = (f"SELECT rubric, n, true AS learned, true AS macro_learned FROM (VALUES {_EACH}) AS r(rubric), "
                   f"({_N_TEST})")
SQL["svm_cv"] = (f"SELECT rubric, CAST(5 AS BIGINT) AS n_folds, true AS train_not_worse, true AS learned "
                 f"FROM (VALUES {_EACH}) AS r(rubric)")

# Newton's method for three weights (two shares and the constant) of every fold, rubric and class, and QWK of what they say.
_SHARE = "100.0::DOUBLE * len(list_filter(t, lambda x: x = '{0}')) / greatest(len(t), 1)"
_LEARN = "CAST(1 + least(4, (100 * len(list_filter(t, lambda x: x = '{0}'))) // greatest(len(t), 1)) AS INTEGER)"
_WORD_OF = {"clarity": "the", "team_market_fit": "of", "traction_validation": "is"}
_SVM_ROWS = " UNION ALL ".join(f"SELECT doc_id, fold, a, b, '{r}' AS rubric, {_LEARN.format(w)} AS y FROM d" for r, w in _WORD_OF.items())
_NEWTON = (
    f"WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, CAST({O.unit_hash_sql('42', 'doc_id')} % 5 AS INTEGER) AS fold, t, "
    f"{_SHARE.format('the')} AS a, {_SHARE.format('of')} AS b FROM (SELECT doc_id, {_TOK} AS t FROM documents)), "
    f"r AS MATERIALIZED ({_SVM_ROWS}), "
    "m AS MATERIALIZED (SELECT DISTINCT o.fold, r.rubric, r.y AS label FROM range(5) AS o(fold) JOIN r ON r.fold <> o.fold), "
    "x AS MATERIALIZED (SELECT m.*, r.a, r.b, CASE WHEN r.y = m.label THEN 1.0 ELSE -1.0 END::DOUBLE AS s "
    "FROM m JOIN r ON r.rubric = m.rubric AND r.fold <> m.fold), "
    "step(k, fold, rubric, label, u, v, w) AS (SELECT 0, fold, rubric, label, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM m UNION ALL "
    # With the active rows' sums, the minimum of their quadratic is (I + 2 sum(x x')) w = 2 sum(s x).
    "SELECT k + 1, fold, rubric, label, (p * (yy * zz - yz * yz) - q * (xy * zz - xz * yz) + o * (xy * yz - xz * yy)) / det, "
    "(xx * (q * zz - o * yz) - xy * (p * zz - o * xz) + xz * (p * yz - q * xz)) / det, "
    "(xx * (yy * o - yz * q) - xy * (xy * o - yz * p) + xz * (xy * q - yy * p)) / det FROM ("
    "SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - xz * yz) + xz * (xy * yz - xz * yy) AS det FROM ("
    "SELECT k, fold, rubric, label, 1 + coalesce(2 * sum(a * a) FILTER (WHERE act), 0) AS xx, coalesce(2 * sum(a * b) FILTER (WHERE act), 0) AS xy, "
    "coalesce(2 * sum(a) FILTER (WHERE act), 0) AS xz, 1 + coalesce(2 * sum(b * b) FILTER (WHERE act), 0) AS yy, coalesce(2 * sum(b) FILTER (WHERE act), 0) AS yz, "
    "1 + 2 * count(*) FILTER (WHERE act) AS zz, coalesce(2 * sum(s * a) FILTER (WHERE act), 0) AS p, coalesce(2 * sum(s * b) FILTER (WHERE act), 0) AS q, "
    "coalesce(2 * sum(s) FILTER (WHERE act), 0) AS o FROM (SELECT step.k, x.*, x.s * (step.u * x.a + step.v * x.b + step.w) < 1 AS act "
    "FROM step JOIN x USING (fold, rubric, label) WHERE step.k < 30) GROUP BY k, fold, rubric, label))), "
    "fit AS (SELECT * FROM step WHERE k = 30), "
    "said AS (SELECT r.doc_id, r.rubric, fit.fold, CASE WHEN r.fold = fit.fold THEN 'test' ELSE 'train' END AS side, r.y AS y_true, "
    "arg_max(fit.label, struct_pack(m := fit.u * r.a + fit.v * r.b + fit.w, c := -fit.label)) AS y_pred "
    "FROM r JOIN fit USING (rubric) GROUP BY ALL) SELECT * FROM said"
)
SQL["svm_words_cv"] = (
    "SELECT rubric, CAST(count(DISTINCT fold) AS BIGINT) AS n_folds, round(avg(qwk) FILTER (WHERE side = 'train'), 6) AS qwk_train, "
    "round(avg(qwk) FILTER (WHERE side = 'test'), 6) AS qwk_held_out FROM "
    f"({O.qwk_sql(_NEWTON, ('side', 'rubric', 'fold'), digits=None)}) GROUP BY rubric"
)
