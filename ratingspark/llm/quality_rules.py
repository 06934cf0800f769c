"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``features`` measures a text (lengths, symbols, stop words, repeated lines and windows); ``verdict`` turns a table of
thresholds into one boolean column. Nothing is shuffled: each text is judged from its own row.

Defined results: a null or empty text, or one of white space only, has no words, so every count is 0 and it fails the
base rule; null ids pass through; repeated rows are judged alike; columns that the rules do not know are not touched.
Repeated windows are found by a 64-bit hash of the window's words within one text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import SPACE, WORD, let

#: Frequent function words of the four languages of the corpus; a text must hold two different ones.
STOP_WORDS = (
    "the be to of and that have with in is it for on as by this was a an are from or at "
    "le la les des du de et en un une est que pour pas dans il elle ce sur au "
    "der die das und den von zu mit ist ein eine nicht sich auf für im dem "
    "el los las del y que por con para una es se no su lo"
).split()
#: Fixed value: the characters that count as symbols (each is one byte of UTF-8).
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A text passes while ``numerator`` stays within ``low``..``high`` times ``denominator`` (None: no bound)."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


#: The threshold table. Ratios are compared by multiplication, so an empty text divides by nothing.
RULES = (
    Rule("words", "n_words", None, 20, None),
    Rule("mean_word_length", "word_chars", "n_words", 2, 12),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.3),
    Rule("stop_words", "n_stop_words", None, 2, None),
    Rule("shouts", "n_shouts", "n_words", None, 0.3),
)


def _with_step(f, step: int):
    return lambda h: f(h, step)


def _repeated_words(words: Column, window: int) -> Column:
    """Words inside a window of ``window`` words that occurs at least twice in ``words``."""

    def covered(marks: Column) -> Column:
        # marks: (hash, start) sorted; a window is repeated where a neighbour has its hash.
        last = F.size(marks) - 1
        same = lambda i, j: F.get(marks, i)["h"] == F.get(marks, j)["h"]
        repeated = F.filter(marks, lambda m, i: ((i > 0) & same(i, i - 1)) | ((i < last) & same(i, i + 1)))
        starts = F.sort_array(F.transform(repeated, lambda m: m["i"]))
        width = F.lit(window)
        return let(starts, lambda s: F.aggregate(
            s, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")),
            lambda acc, x: F.struct((acc["n"] + F.least(width, x - acc["at"])).alias("n"), x.alias("at")))["n"])

    # Hashes of runs of 1, 2, 4, ... words, each from two of the run half as long: three passes for eight words,
    # and no slice per window, which would copy the whole array each time.
    def longer(h: Column, step: int) -> Column:
        n = F.size(h) - step
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    hashes, length = F.transform(words, lambda w: F.xxhash64(w)), 1
    while length < window:
        step = min(length, window - length)
        hashes = let(hashes, _with_step(longer, step))
        length += step
    marks = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    once = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
               .otherwise(let(marks(h), covered)))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(once)


def _without(text: Column, strings) -> Column:
    for x in strings:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def features(docs: DataFrame, text: str = "text", window: int = 8, stop_words=STOP_WORDS,
             symbols: str = SYMBOLS) -> DataFrame:
    """The rows of ``docs`` with one struct column ``quality`` of counts (all long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda l: l.rlike(WORD))

    def counts(words: Column) -> Column:
        return let(lines, lambda ls: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.octet_length(t) - F.octet_length(_without(t, symbols))).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeated_words(words, window).cast("long").alias("n_repeat_words"),
            F.size(F.array_intersect(words, F.array(*map(F.lit, stop_words)))).cast("long").alias("n_stop_words"),
            F.floor((F.octet_length(t) - F.octet_length(_without(t, ["!!"]))) / 2).alias("n_shouts"),
        ))

    return docs.withColumn("quality", let(F.array_remove(F.split(t, SPACE), ""), counts))


def verdict(rules=RULES, source: str = "quality") -> Column:
    """The threshold table as one boolean column: true when no rule is broken."""
    passed = F.lit(True)
    for r in rules:
        value = F.col(f"{source}.{r.numerator}")
        unit = F.col(f"{source}.{r.denominator}") if r.denominator else F.lit(1)
        if r.low is not None:
            passed = passed & (value >= r.low * unit)
        if r.high is not None:
            passed = passed & (value <= r.high * unit)
    return passed


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """Per row: the key, the counts, ``base_failed`` (fewer than 20 words, or over 30 % of them in repeated
    windows) and ``kept`` (the base passed and so did every rule)."""
    q = F.col("quality")
    base_failed = (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])
    return (features(docs.select(F.col(key).alias(key), F.col(text).alias(text)), text)
            .select(key, "quality.*", base_failed.alias("base_failed"), (~base_failed & verdict(rules)).alias("kept")))
