"""Prompt and chat assembly for judging and for training a distilled rater.

A request row is (document, rubric). The rubric table is a handful of rows whose
size is fixed by its parameters; everything else is per-row
column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.schemas import RUBRIC_TABLE, RUBRICS


# Our own short wording for tests and defaults; real prompts are data passed in.
def default_rubric_rows(rubrics=RUBRICS) -> list[tuple[str, str, str]]:
    rows = []
    for r in rubrics:
        label = r.replace("_", " ")
        rows.append((r,
                     f"You grade pitch transcripts on {label}. Explain briefly, then give a score as [[n]] with n from 1 to 5.",
                     f"Rate the {label} of this pitch transcript:\n"))
    return rows


def rubric_table(spark: SparkSession, rows=None) -> DataFrame:
    """``rubric, system_prompt, user_prefix``: one row per rubric (small, parameter-sized)."""
    rows = rows or default_rubric_rows()
    names = [f.name for f in RUBRIC_TABLE.fields]
    structs = [F.struct(*[F.lit(v).cast("string").alias(n) for v, n in zip(r, names)]) for r in rows]
    # Built from literals in the JVM: no Python-side data conversion.
    return spark.range(1).select(F.inline(F.array(*structs)))


def resolve_prompts(requests: DataFrame, rubrics: DataFrame, rubric_col: str = "rubric",
                    text_col: str = "transcript", default_rubric: str = RUBRICS[-1]) -> DataFrame:
    """Attach ``system_prompt`` and ``user_prompt`` to each request row.

    An unknown rubric name falls back to ``default_rubric`` (the reference's
    if/elif/else); ``prompt_rubric`` says which rubric's text was used and
    ``unknown_rubric`` flags the fallback so it can be counted.
    The rubric table is the caller's: the planner broadcasts it if its measured size allows.
    """
    names = rubrics.select(F.col("rubric").alias("_r")).distinct()
    flagged = requests.join(names, requests[rubric_col] == names["_r"], "left")
    unknown = F.col("_r").isNull()
    flagged = flagged.select(*[F.col(c) for c in requests.columns],
                             F.coalesce(F.col("_r"), F.lit(default_rubric)).alias("prompt_rubric"),
                             unknown.alias("unknown_rubric"))
    rb = rubrics.select(F.col("rubric").alias("prompt_rubric"), "system_prompt", "user_prefix")
    out = flagged.join(rb, "prompt_rubric", "left")
    return out.select(
        *[F.col(c) for c in requests.columns], "prompt_rubric", "unknown_rubric", "system_prompt",
        F.concat(F.col("user_prefix"), F.coalesce(F.col(text_col), F.lit(""))).alias("user_prompt"),
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_chat(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """System and user messages, plus the assistant answer only for training rows."""
    msgs = [message("system", system), message("user", user)]
    if assistant is not None:
        msgs.append(message("assistant", F.coalesce(assistant, F.lit(""))))
    return F.array(*msgs)


@dataclass(frozen=True)
class ChatTemplate:
    """How a chat becomes one string: ``start + role + mid + content + end`` per message.

    Fixed values: the defaults are the header markers of a widely used public chat format.
    """
    bos: str = "<|begin_of_text|>"
    start: str = "<|start_header_id|>"
    mid: str = "<|end_header_id|>\n\n"
    end: str = "<|eot_id|>"

    def header(self, role: str) -> str:
        return f"{self.start}{role}{self.mid}"


DEFAULT_TEMPLATE = ChatTemplate()


def render_chat(chat, template: ChatTemplate = DEFAULT_TEMPLATE, add_generation_prompt: bool = False) -> Column:
    """Render an ``ARRAY<STRUCT<role, content>>`` to one string; optionally open an assistant turn."""
    c = F.col(chat) if isinstance(chat, str) else chat
    body = F.array_join(F.transform(c, lambda m: F.concat(
        F.lit(template.start), m["role"], F.lit(template.mid), F.coalesce(m["content"], F.lit("")),
        F.lit(template.end))), "")
    parts = [F.lit(template.bos), body]
    if add_generation_prompt:
        parts.append(F.lit(template.header("assistant")))
    return F.concat(*parts)


def response_span(text, template: ChatTemplate = DEFAULT_TEMPLATE, role: str = "assistant") -> list[Column]:
    """Split a rendered chat at its last ``role`` header.

    Returns ``prompt_part`` (up to and including the header), ``response_part``
    (the rest, the training target) and ``response_start`` (1-based character
    offset). A text without the header has no response: NULL, NULL, 0.
    """
    t = F.col(text) if isinstance(text, str) else text
    hdr = template.header(role)
    has = F.instr(t, hdr) > 0
    resp = F.substring_index(t, hdr, -1)
    start = F.length(t) - F.length(resp) + 1
    return [
        F.when(has, F.substring(t, F.lit(1), start - 1)).alias("prompt_part"),
        F.when(has, resp).alias("response_part"),
        F.when(has, start).otherwise(F.lit(0)).cast("int").alias("response_start"),
    ]
