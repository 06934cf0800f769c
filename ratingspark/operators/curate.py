"""Corpus curation: query grid, per-query limit, title filter, URL cleaning,
de-duplication, resume anti-join, error quarantine and null handling.

Per-row work is built-in column expressions; the only shuffles are the ones the
semantics need (de-duplication, per-group limit, anti-join), and each of them is
combined map-side before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingspark.functions import text as tx
from ratingspark.functions.hashing import unit_hash

# The batch naming of the search grid. Short codes are a season
# letter plus a two-digit year, full names a season name plus a four-digit year,
# plus the fall batch in both forms; queries read "<prefix><batch><suffix>".
SEASONS = (("W", "Winter"), ("S", "Summer"))
SHORT_YEARS = (10, 25)
FULL_YEARS = (2010, 2025)
EXTRA_BATCHES = ("F24", "Fall 2024")
QUERY_PREFIX = "YC "
QUERY_SUFFIX = " Application Video"


def query_grid(spark: SparkSession, prefix: str = QUERY_PREFIX, suffix: str = QUERY_SUFFIX,
               seasons=SEASONS, short_years=SHORT_YEARS, full_years=FULL_YEARS,
               extra=EXTRA_BATCHES) -> DataFrame:
    """One row per search query: ``qid, batch, query``; ``qid`` numbers batches in text order.

    Built from generators (no join); its size is fixed by the parameters.
    """
    short = spark.range(short_years[0], short_years[1] + 1).select(
        F.explode(F.array(*[F.concat(F.lit(code), F.col("id").cast("string")) for code, _ in seasons])).alias("batch"))
    full = spark.range(full_years[0], full_years[1] + 1).select(
        F.explode(F.array(*[F.concat(F.lit(name + " "), F.col("id").cast("string")) for _, name in seasons]))
        .alias("batch"))
    batches = short.unionByName(full)
    if extra:
        batches = batches.unionByName(spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in extra]))
                                                            .alias("batch")))
    batches = batches.distinct().coalesce(1)
    w = Window.orderBy("batch")
    return batches.select((F.row_number().over(w) - 1).cast("int").alias("qid"), "batch",
                          F.concat(F.lit(prefix), F.col("batch"), F.lit(suffix)).alias("query"))


def grid_size(seasons=SEASONS, short_years=SHORT_YEARS, full_years=FULL_YEARS, extra=EXTRA_BATCHES) -> int:
    n = len(seasons) * (short_years[1] - short_years[0] + 1 + full_years[1] - full_years[0] + 1)
    return n + len(set(extra))


def search_hits_from_pages(pages: DataFrame, grid: DataFrame, n_queries: int) -> DataFrame:
    """Stand-in search results: each page is a hit of one grid query with a rank key.

    ``qid, query, rank_key, page_id, title, link``. The grid is the caller's: the planner broadcasts it if its
    measured size allows.
    """
    hits = pages.select(
        "page_id",
        F.pmod(unit_hash("q", "page_id"), F.lit(n_queries)).cast("int").alias("qid"),
        unit_hash("r", "page_id").alias("rank_key"),
        tx.html_title("html").alias("title"),
        F.col("url").alias("link"),
    )
    return hits.join(grid.select("qid", "query"), "qid")


# Fixed value: the largest limit for which the planner puts a partial per-group limit before the exchange by default.
PLANNED_LIMIT = 1000
SPREAD = 64


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int) -> DataFrame:
    """Keep the first ``n`` rows of each group by ``order_cols``.

    Up to ``PLANNED_LIMIT`` each map task forwards at most ``n`` rows per group (a partial window-group limit). For a
    larger ``n`` each group is first cut to ``n`` in each of ``SPREAD`` parts, by a hash of the order columns, so the
    task that finishes a hot group sees at most ``SPREAD * n`` of its rows.
    """
    groups, order = list(group_cols), list(order_cols)

    def first(rows: DataFrame, keys: list) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")

    if n > PLANNED_LIMIT:
        names = [c for c in order if isinstance(c, str)]
        part = F.pmod(F.xxhash64(*names), F.lit(SPREAD)) if names else F.pmod(F.spark_partition_id(), F.lit(SPREAD))
        df = first(df.withColumn("_part", part), [*groups, "_part"]).drop("_part")
    return first(df, groups)


def title_filter(df: DataFrame, keyword: str, title_col: str = "title") -> DataFrame:
    return df.where(tx.title_has(title_col, keyword))


def clean_links(df: DataFrame, link_col: str = "link", keep: str = "v", prefix: str | None = None) -> DataFrame:
    c = F.col(link_col)
    if prefix:
        c = tx.absolute_link(c, prefix)
    return df.withColumn(link_col, tx.clean_url(c, keep))


def dedup_pairs(df: DataFrame, cols=("title", "link")) -> DataFrame:
    """Set semantics on (title, link): a partial aggregate before the shuffle."""
    return df.select(*cols).distinct()


def dedup_links(df: DataFrame, link_col: str = "link", title_col: str = "title") -> DataFrame:
    """One row per link, keeping the smallest title (deterministic)."""
    return df.groupBy(link_col).agg(F.min(title_col).alias(title_col)).select(title_col, link_col)


def first_by_key(df: DataFrame, key: str) -> DataFrame:
    """One row per non-null or null key: the least by the remaining columns, so a re-run picks the same row."""
    others = [c for c in df.columns if c != key]
    if not others:
        return df.distinct()
    best = df.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def resume(df: DataFrame, done: DataFrame, key: str = "link", retry_errors: bool = False,
           done_text_col: str = "transcript") -> DataFrame:
    """Rows of ``df`` whose key is not in ``done`` yet; of rows that repeat a key, the least one runs.

    Failed rows count as done unless ``retry_errors``. The anti-join comes first, so finished rows are not
    shuffled for the de-duplication; AQE decides from the runtime sizes how to join.
    """
    finished = done
    if retry_errors and done_text_col in done.columns:
        finished = finished.where(~tx.is_error(done_text_col))
    finished = finished.select(key).distinct()
    return first_by_key(df.join(finished, key, "left_anti").select(*df.columns), key)


def drop_errors(df: DataFrame, text_col: str = "transcript", enabled: bool = True) -> DataFrame:
    return df.where(~tx.is_error(text_col)) if enabled else df


def drop_null(df: DataFrame, cols) -> DataFrame:
    return df.na.drop(subset=list(cols))


def null_to_literal(df: DataFrame, col: str, literal: str = "nan") -> DataFrame:
    """Python's ``str(NaN)``: a missing value becomes the text ``nan``."""
    return df.withColumn(col, F.coalesce(F.col(col).cast("string"), F.lit(literal)))
