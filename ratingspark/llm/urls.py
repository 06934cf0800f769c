"""URL filter: longest matching rule, else naive Bayes over the words that a host and path are made of.

A host's labels are cut at dots, hyphens and between letters and digits, and what is left is segmented into words by a unigram Viterbi search
(``cheappills`` becomes ``cheap pills``). Multinomial naive Bayes then scores those words and the path's tokens. Unigram
counts come from all page titles, path tokens and hyphenated host labels; class counts from all pages, where a page is
an example of ``block`` if a delimited part of its host or a word that it is segmented into is a seed, and of ``allow`` otherwise. Every counted
word enters the segmentation: each distinct host part is joined with the counts of its own substrings. Class
counts hold one row per token with both classes; the ``VOCABULARY`` most frequent tokens are broadcast as a fast path,
and a page's other tokens join the table of all, with the same result.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and has no words, so the
class priors decide; hosts, paths and words of any length are read whole; an empty page table gives an empty table; repeated pages are judged alike; null titles add nothing.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import LOWER, UPPER, stored

VOCABULARY = 100_000
#: Letters of substrings that a batch may hold.
BATCH = 1 << 22
#: Words of host names that mark examples of unwanted sites.
SEEDS = ("ads adult bet bets betting buy casino cheap farm free gamble loan lottery pharma pill pills poker porn prize "
         "sex slots spam track tracker viagra win xxx").split()


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the registered query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules, host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Rules are a parameter, a few lines."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        here = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fit = F.when(here, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(fit)
    return fit


class Segmenter:
    """Most probable split of a name into words under unigram counts; unknown words cost ten times more a letter. Words and
    unknown pieces may have any length: of the pieces that end at a letter, the best start is kept from letter to letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.cost = {w: math.log(self.total / n) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)

    def __call__(self, name: str) -> list[str]:
        best, cut, letter = [0.0], [0], math.log(10)
        unknown = (math.log(self.total), 0)
        for end in range(1, len(name) + 1):
            known = ((best[end - n] + self.cost[name[end - n:end]], end - n) for n in self.lengths
                     if n <= end and name[end - n:end] in self.cost)
            cost, start = min(((unknown[0] + end * letter, unknown[1]), *known))
            best.append(cost)
            cut.append(start)
            unknown = min(unknown, (cost + math.log(self.total) - end * letter, end))
        words, end = [], len(name)
        while end:
            words.append(name[cut[end]:end])
            end = cut[end]
        return words[::-1]


def parts(host: str) -> list[str]:
    """The letter runs and digit runs of a host, top-level domain left out."""
    labels = host.split(".")[:-1] or [host]
    return [part for label in labels for part in re.findall("[a-z]+|[0-9]+", label)]


def unigrams(pages: DataFrame) -> DataFrame:
    """(word, n): all words of titles, paths and hyphenated host labels. pages: host, path, html. Seeds count once at least."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>([^<]*)", 1)
    labels = F.filter(F.split("host", r"\."), lambda x: x.contains("-"))
    text = F.lower(F.concat_ws(" ", title, F.col("path"), F.array_join(labels, " ")))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
    found = words.filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    least = pages.sparkSession.createDataFrame([(w, 0) for w in SEEDS], "word string, n long")
    return found.unionByName(least).groupBy("word").agg(F.greatest(F.sum("n"), F.lit(1)).alias("n"))


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of distinct (host). counts: stored (word, n); each distinct name meets the counts of its own
    substrings, by a join with all of them. Only substrings as long as some word can be one."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    # One number for each length that occurs; the words of n letters are at least one, so their lengths are few.
    lengths = sorted(r.n for r in counts.select(F.length("word").alias("n")).distinct().collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parts(h.as_py()) for h in b.column(0)], pa.list_(pa.string()))],
                                             ["host", "parts"])

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n in itertools.takewhile(lambda n: n <= len(name), lengths):
                    step = max(1, BATCH // n)
                    for first in range(0, len(name) - n + 1, step):
                        found = {name[i:i + n] for i in range(first, min(first + step, len(name) - n + 1))}
                        yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(found), pa.binary()), "word": pa.array(sorted(found), pa.string())})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Segmenter({x["word"]: x["n"] for x in known}, total)(name)
                     for name, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], ["name", "split"])

    cuts = stored(hosts.mapInArrow(cut, "host string, parts array<string>"), "url-hosts")
    each = cuts.select("host", F.posexplode("parts").alias("at", "name"))
    alpha = F.col("name").rlike("^[a-z]+$")
    names = each.filter(alpha).select(F.unhex(F.md5("name")).alias("key"), "name").distinct()
    known = names.mapInArrow(substrings, "key binary, word string").join(counts, "word")
    lists = known.groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    splits = (names.join(lists, "key", "left").select("name", F.coalesce("known", F.array().cast("array<struct<word:string,n:bigint>>")).alias("known"))
              .mapInArrow(split, "name string, split array<string>"))
    placed = each.join(splits, "name", "left").groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("split", F.array("name")).alias("split")))).alias("found"))
    return cuts.select("host").join(placed, "host", "left").select(
        "host", F.coalesce(F.flatten(F.col("found.split")), F.array().cast("array<string>")).alias("words"))


def tokenised(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, host, path, tokens): words of the host, then tokens of the path. counts: stored (word, n)."""
    rows = pages.select("id", "host", "path")
    words = stored(segmented(rows.select("host").distinct(), counts), "url-splits")
    marked = F.transform(F.filter(F.split(F.lower("path"), "[^0-9a-z]+"), lambda t: t != ""),
                         lambda t: F.concat(F.lit("/"), F.when(t.rlike("^[0-9]+$"), "#").otherwise(t)))
    return rows.join(words, "host").select("id", "host", "path", F.concat("words", marked).alias("tokens"))


class Bayes(NamedTuple):
    """Log odds of ``block`` over ``allow``: of no token, of each token of the head, and of one in no example."""

    prior: float
    head: dict[str, float]
    other: float


def train(words: DataFrame, seeds=SEEDS) -> tuple[Bayes, DataFrame]:
    """Multinomial naive Bayes from all rows of (host, tokens): the model with its broadcast head, and the stored
    (token, odds) of all tokens."""
    parts = F.array_union(F.split("host", "[^0-9a-z]+"), "tokens")  # path tokens begin with a slash and are no seeds
    named = words.withColumn("bad", F.arrays_overlap(parts, F.array(*map(F.lit, seeds))))
    docs = {r.bad: r.n for r in named.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = stored(named.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count_if("bad").alias("block"), F.count_if(~F.col("bad")).alias("allow")), "url-counts")
    sums = counts.agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.sum("block"), F.lit(0)).alias("block"),
                      F.coalesce(F.sum("allow"), F.lit(0)).alias("allow")).first()
    size = sums.size + 1
    other = math.log(1 / (sums.block + size)) - math.log(1 / (sums.allow + size))
    odds = counts.select("token", (F.col("block") + F.col("allow")).alias("n"),
                         (F.log((F.col("block") + 1) / F.lit(float(sums.block + size)))
                          - F.log((F.col("allow") + 1) / F.lit(float(sums.allow + size)))).alias("odds"))
    head = odds.orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()
    return Bayes(math.log((docs.get(True, 0) + 1) / (docs.get(False, 0) + 1)), {r.token: r.odds for r in head}, other), odds


def scored(words: DataFrame, model: Bayes, odds: DataFrame) -> DataFrame:
    """Adds ``log_odds`` to stored (row, id, host, path, tokens); row is unique."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            tokens = b.column(1).to_pylist()
            part = [m.prior + math.fsum(m.head.get(t, 0.0) for t in x) for x in tokens]
            tail = [list(Counter(t for t in x if t not in m.head).items()) for x in tokens]
            kind = pa.list_(pa.struct([("token", pa.string()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(part, pa.float64()), pa.array([[{"token": t, "times": n} for t, n in x] for x in tail], kind)],
                ["row", "part", "tail"])

    parts = stored(words.select("row", "tokens").mapInArrow(
        run, "row long, part double, tail array<struct<token:string,times:long>>"), "url-parts")
    more = (parts.select("row", F.inline("tail")).join(odds, "token", "left").groupBy("row")
            .agg(F.sum(F.col("times") * F.coalesce("odds", F.lit(model.other))).alias("more")))
    sums = parts.select("row", "part").join(more, "row", "left").select(
        "row", (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("log_odds"))
    return words.join(sums, "row")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, seeds=SEEDS) -> DataFrame:
    """One row per row of ``pages``: its id, host, path, the fitting rule (or null), the verdict (``allow`` or
    ``block``), the naive Bayes log odds of ``block``, and the words they are made of."""
    u = F.col(url)
    rows = pages.select(F.col(key).alias("id"), host(u).alias("host"), path(u).alias("path"), F.col(html).alias("html"))
    words = tokenised(rows, stored(unigrams(rows), "url-unigrams"))
    words = stored(words.withColumn("row", F.monotonically_increasing_id()), "url-words")
    judged = scored(words, *train(words, seeds))
    fit = fitting(rules, F.col("host"), F.col("path"))
    return judged.withColumn("fit", fit).select(
        F.col("id").alias(key), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"),
        "log_odds", "tokens")
