"""The registered queries ``opN_<name>`` over the driver's tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm import (bpe, brown, compression, exact_dedup, licenses, mix, periodic, quality_rules, repeats, shards, simhash,
                             urls, whitening)
from ratingspark.llm.common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path() -> str:
    """The public byte-level vocabulary; only the driver reads the file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_mix(spark, sf_dir):
    """Every document's share of the mix: weights 1, 2, 3 by source, at most 3 passes."""
    return mix.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.get("positions", 0).alias("position"))


@query
def op2_simhash(spark, sf_dir):
    """Components of documents whose fingerprints are at most 4 bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, bits=4)


@query
def op3_urls(spark, sf_dir):
    """Every page's rule and verdict."""
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op4_repeats(spark, sf_dir):
    """Every document without the bytes that strings of 400 bytes occurring more than once cover."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 400, with_kept=False)


@query
def op5_brown(spark, sf_dir):
    """Every document's log10 probability under the class model, beside that of add-half unigrams."""
    return brown.score(table(spark, sf_dir, "documents"))


@query
def op6_compression(spark, sf_dir):
    """Every document's quality score, learned from the labels outside the held-out fold."""
    return compression.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_bpe(spark, sf_dir):
    """Every document's tokens and the text that they decode to, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op8_quality_rules(spark, sf_dir):
    """Counts and verdict of the threshold table for every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words", "n_shouts")


@query
def op9_shards(spark, sf_dir):
    """Every document's shard and slot; 16 contiguous shards of nearly equal bytes."""
    return shards.assign(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_exact_dedup(spark, sf_dir):
    """Groups of equal texts (A-Z lower-cased); the largest doc_id stays."""
    return exact_dedup.assign(table(spark, sf_dir, "documents"), keep="max")


@query
def op11_periodic(spark, sf_dir):
    """The runs of every document, of which every tenth hash of an id is given a periodic end first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.digests(periodic.find_runs(docs))


@query
def op12_licenses(spark, sf_dir):
    """Every document's licence phrases and the labels of the templates found in it."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark, sf_dir):
    """Every embedding on the first eight whitened components of all of them."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 8, scale=1024, offset=100_000).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")


SQL["op1_mix"] = r"""
WITH sized AS (
  SELECT doc_id, '=' || source AS s, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('11:' || doc_id::VARCHAR) AS h
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1 AS k
  FROM sized GROUP BY source),
weighted AS (SELECT *, (k % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM ranked),
levelled AS (
  SELECT *, row_number() OVER o AS turn,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted WINDOW o AS (ORDER BY source_size::DOUBLE / w, (source IS NULL), source)),
marked AS (SELECT *, cap <= level * w AS capped FROM levelled),
plan AS (
  SELECT source, source_size, w, k, CASE WHEN capped THEN cap ELSE
         (SELECT arg_min(level, turn) FROM marked WHERE NOT capped) * w END AS target,
         CASE k % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE * w AS w0,
         CASE k % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 ELSE 1.0 END::DOUBLE * w AS w1
  FROM marked),
placed AS (
  SELECT d.*, p.source_size, p.target, p.w, p.w0, p.w1, round(p.target)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
taken AS (
  SELECT *, least(greatest(goal - start, 0), size) AS a, least(greatest(goal - (start + source_size), 0), size) AS b,
         least(greatest(goal - (start + 2 * source_size), 0), size) AS c,
         start / target * w AS demand
  FROM placed)
SELECT doc_id, size, source_size, target, (a + b + c)::BIGINT AS taken,
       CASE WHEN a > 0 THEN CASE WHEN w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * demand, 0)) > 0
       THEN least(1.0::DOUBLE, 2 * demand / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * demand, 0)))) ELSE 0 END END AS position
FROM taken"""

SQL["op8_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) AS r(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, len(list_intersect(words, [STOPS]))::BIGINT AS n_stop_words,
             ((strlen(t) - strlen(replace(t, '!!', ''))) // 2)::BIGINT AS n_shouts
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words >= 20 AND word_chars BETWEEN 2 * n_words AND 12 * n_words
          AND n_symbols <= 0.1::DOUBLE * n_words AND n_dup_lines <= 0.5::DOUBLE * n_lines
          AND n_repeat_words <= 0.3::DOUBLE * n_words AND n_stop_words >= 2 AND n_shouts <= 0.3::DOUBLE * n_words AS kept
FROM b""".replace("STOPS", ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS))

# CRC-32 byte by byte: its table of 256 remainders comes from eight shifts of each byte.
SQL["op9_shards"] = r"""
WITH RECURSIVE shifts AS (
  SELECT range AS byte, range::BIGINT AS c, 0 AS step FROM range(256)
  UNION ALL SELECT byte, xor(c >> 1, (c & 1) * 3988292384), step + 1 FROM shifts WHERE step < 8),
crc AS (SELECT list(c ORDER BY byte) AS steps FROM shifts WHERE step = 8),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
s AS (SELECT doc_id, size, xor(list_reduce(list_transform(bytes, lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
      FROM d, crc),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS earlier, sum(size) OVER () AS total FROM s),
p AS (SELECT *, ((2 * earlier + size) * 16 // (2 * total))::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::INT AS slot,
       NULL::INT AS grown_shard FROM p"""

SQL["op10_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
h AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM h"""


def _licenses_sql() -> str:
    words = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    rows = ", ".join(f"({i}, '{t.label}', '{t.text}', {str(t.phrase).lower()})" for i, t in enumerate(licenses.TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS words FROM documents),
tw AS (SELECT t, label, phrase, {words} AS words FROM (VALUES {rows}) AS v(t, label, text, phrase)),
tk AS (SELECT *, len(words) AS length, least({licenses.K}, len(words)) AS k FROM tw),
tg AS (SELECT t, label, phrase, length, k, t_at, array_to_string(words[t_at + 1:t_at + k], ' ') AS gram
       FROM (SELECT *, unnest(range(length - k + 1)) AS t_at FROM tk)),
g AS (SELECT rid, pos, k, array_to_string(words[pos + 1:pos + k], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(len(words))) AS pos FROM d), (SELECT DISTINCT k FROM tg) WHERE pos + k <= len(words)),
hit AS (SELECT DISTINCT rid, t, label, phrase, length, k, pos - t_at AS diagonal, t_at FROM g JOIN tg USING (k, gram)),
v AS (SELECT rid, t, label, phrase, length, k, diagonal, min(t_at) AS t_from, diagonal + min(t_at) AS start,
             diagonal + max(t_at) + k AS stop, count(*) = length - k + 1 AS whole
      FROM hit GROUP BY rid, t, label, phrase, length, k, diagonal),
c AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER o) <= {licenses.SHIFT} AND t_from > lag(t_from) OVER o
                     AND start <= lag(stop) OVER o + {licenses.SHIFT} + k THEN 0 ELSE 1 END AS fresh
      FROM v WINDOW o AS (PARTITION BY rid, t ORDER BY start, diagonal)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, t ORDER BY start, diagonal) AS span FROM c),
cov AS (SELECT rid, t, span, count(DISTINCT t_at + j) AS n FROM s JOIN hit USING (rid, t, diagonal), range({licenses.K}) AS r(j)
        WHERE j < s.k GROUP BY ALL),
p AS (SELECT rid, t, label, phrase, span, any_value(cov.n) / any_value(length) AS coverage, count(*) FILTER (WHERE whole) AS n_whole,
             min(diagonal) FILTER (WHERE whole) AS first_whole, max(diagonal) FILTER (WHERE whole) AS last_whole
      FROM s JOIN cov USING (rid, t, span) GROUP BY rid, t, label, phrase, span),
f AS (SELECT rid, sum(n_whole) FILTER (WHERE phrase) AS n_base, min(first_whole) FILTER (WHERE phrase) AS first_word,
             max(last_whole) FILTER (WHERE phrase) AS last_word, max(coverage) AS score,
             list_sort(list(DISTINCT label) FILTER (WHERE phrase AND n_whole > 0)) AS base_labels,
             list_sort(list(DISTINCT label) FILTER (WHERE CASE WHEN phrase THEN n_whole > 0 ELSE coverage >= {licenses.SHARE} END)) AS labels
      FROM p GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
       coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (rid)"""


SQL["op12_licenses"] = _licenses_sql()
