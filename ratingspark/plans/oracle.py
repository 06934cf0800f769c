"""ANSI SQL (DuckDB dialect) twins of the registered queries.

Each entry reads the pre-registered views (documents, pages, labels, ...) and
computes, independently of Spark, what the matching query must return.
Shared pieces (derived ratings, hashing, QWK) are generated by small helpers.
"""

from __future__ import annotations

from ratingspark.functions.hashing import threshold_hex
from ratingspark.schemas import RUBRICS


def _h(rubric: str) -> str:
    return f"md5('{rubric}:' || CAST(doc_id AS VARCHAR))"


def score_sql(r: str) -> str:
    return f"CAST(1 + ascii(substr({_h(r)},1,1)) % 5 AS INTEGER)"


def pred_sql(r: str) -> str:
    return f"CAST(greatest(1, least(5, {score_sql(r)} + ascii(substr({_h(r)},2,1)) % 3 - 1)) AS INTEGER)"


def rationale_sql(r: str, text: str = "text") -> str:
    q = f"('Quote: ' || {text})"
    s = f"CAST({score_sql(r)} AS VARCHAR)"
    p = f"CAST({pred_sql(r)} AS VARCHAR)"
    return (f"CASE doc_id % 10 WHEN 0 THEN {q} "
            f"WHEN 1 THEN {q} || ' [[' || {s} || ']] then [[' || {p} || ']]' "
            f"WHEN 2 THEN {q} || ' [[10]]' "
            f"ELSE {q} || ' [[' || {s} || ']]' END")


TITLE = "(source || ' ' || lang)"


def rated_wide_sql(with_pred: bool = False) -> str:
    cols = ["doc_id", f"{TITLE} AS title", "CAST(doc_id AS VARCHAR) AS link", "text AS transcript"]
    for r in RUBRICS:
        cols += [f"{score_sql(r)} AS {r}_score", f"{rationale_sql(r)} AS {r}_score_rationale"]
        if with_pred:
            cols.append(f"{pred_sql(r)} AS {r}_pred")
    return "SELECT " + ", ".join(cols) + " FROM documents"


def transcripts_sql() -> str:
    return (f"SELECT doc_id, {TITLE} AS title, CAST(doc_id AS VARCHAR) AS link, "
            "CASE WHEN doc_id % 17 = 0 THEN 'ERROR: ' || CAST(doc_id AS VARCHAR) ELSE text END AS transcript "
            "FROM documents")


def long_sql(with_pred: bool = False, keep=("doc_id", "title", "link", "transcript")) -> str:
    """Wide -> long with one UNION ALL branch per rubric."""
    w = rated_wide_sql(with_pred)
    parts = []
    for r in RUBRICS:
        extra = f", {r}_pred AS pred" if with_pred else ""
        kc = ", ".join(keep)
        parts.append(f"SELECT {kc}, '{r}_score' AS rationale_type, {r}_score_rationale AS rationale, "
                     f"{r}_score AS score{extra} FROM w")
    return f"WITH w AS ({w}) " + " UNION ALL ".join(parts)


def extract_score_sql(text: str, default: int | None = 3) -> str:
    raw = f"try_cast(nullif(regexp_extract({text}, '\\[\\[([0-9]+)\\]\\]', 1), '') AS INTEGER)"
    return raw if default is None else f"coalesce({raw}, {int(default)})"


def below_sql(salt: str, key: str, p: float) -> str:
    return f"substr(md5('{salt}:' || coalesce(CAST({key} AS VARCHAR), '')), 1, 8) < '{threshold_hex(p)}'"


def unit_hash_sql(salt: str, *cols: str) -> str:
    inner = " || ':' || ".join([f"'{salt}'"] + [f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols])
    return f"CAST(('0x' || substr(md5({inner}),1,8)) AS BIGINT)"


def qwk_sql(source: str, group_cols=("rubric",), y_true: str = "y_true", y_pred: str = "y_pred",
            label_space: str = "observed", digits: int | None = 6) -> str:
    """QWK per group over the rows of ``source`` (a SELECT or view name)."""
    g = list(group_cols)
    gl = ", ".join(g)
    gsel = (gl + ", ") if g else ""
    on = lambda t, l: " AND ".join([f"{t}.{c} = cm.{c}" for c in g] + [f"{t}.label = cm.{l}"])
    if label_space == "observed":
        part = f"PARTITION BY {gl} " if g else ""
        lab = (f"lab AS (SELECT {gsel}label, dense_rank() OVER ({part}ORDER BY label) AS pos FROM "
               f"(SELECT {gsel}y_true AS label FROM cm UNION SELECT {gsel}y_pred FROM cm)), ")
        j = (f"j AS (SELECT {', '.join('cm.' + c for c in g) + (', ' if g else '')}cm.n, la.pos AS a, lb.pos AS b "
             f"FROM cm JOIN lab la ON {on('la', 'y_true')} JOIN lab lb ON {on('lb', 'y_pred')}), ")
    else:
        lab = ""
        j = f"j AS (SELECT {gsel}n, y_true AS a, y_pred AS b FROM cm), "
    grp = f" GROUP BY {gl}" if g else ""
    rnd_open, rnd_close = ("round(", f", {digits})") if digits is not None else ("", "")
    return (
        f"WITH src AS ({source}), "
        f"cm AS (SELECT {gsel}{y_true} AS y_true, {y_pred} AS y_pred, count(*) AS n FROM src "
        f"WHERE {y_true} IS NOT NULL AND {y_pred} IS NOT NULL GROUP BY ALL), "
        + lab + j +
        f"s AS (SELECT {gsel}CAST(sum(n) AS HUGEINT) AS sn, CAST(sum(n*(a-b)*(a-b)) AS HUGEINT) AS d2, "
        f"CAST(sum(n*(a*a+b*b)) AS HUGEINT) AS sq, CAST(sum(n*a) AS HUGEINT) AS sa, CAST(sum(n*b) AS HUGEINT) AS sb "
        f"FROM j{grp}) "
        f"SELECT {gsel}CAST(sn AS BIGINT) AS n, {rnd_open}1 - CAST(sn*d2 AS DOUBLE) / "
        f"CAST(nullif(sn*sq - 2*sa*sb, 0) AS DOUBLE){rnd_close} AS qwk FROM s"
    )
