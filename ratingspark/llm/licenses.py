"""License scans by diagonal voting, on DataFrames only.

Every text is a sequence of words, and so is every template (a notice or a phrase). All rolling word k-grams of the texts
are joined by hash to the k-grams of the templates, their words compared in the join; k is ``K``, or the template's
length if it is shorter. A match at word ``pos`` of a text and ``at`` of a template votes for the diagonal pos - at: an
unchanged notice puts all its votes on one. Words put in or left out move the rest of a notice to a diagonal nearby, so
diagonals at most ``SHIFT`` apart that go on in text and template are merged into one span. A span is verified
by the share of its template's words that it covers, each of them equal to the text's by the joined words; from
``SHARE`` on it gives the template's label. Phrases count where all their words stand consecutively.

The templates are a parameter: up to ``BROADCAST`` of their k-grams are broadcast, more are left to a shuffled join. A task
drops all k-grams without a match and combines equal votes before anything is shuffled; what is merged in one place are the
votes of one text for one template. The rows of the answer find their spans by id and 96 bits of hashes of the text, so
copies share them; the spans are written first, which lets the planner broadcast them or split a hot key.

Defined results: a null text counts as empty; a text without words has no labels (empty strings), null places and score 0; rows
with null or repeated ids, and repeated rows, are each judged by their own text; an empty table gives an empty one; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingspark.llm.common import ascii_lower, stored

K, SHIFT, SHARE, BROADCAST = 4, 3, 0.9, 100_000
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    label: str
    text: str
    phrase: bool = False


#: The phrases whose places count, and opening or binding sentences of common public licences.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-4.0", "licensed under CC BY 4.0"),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                    "Free Software Foundation"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                    "granted"),
    Template("mit", "released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                    "documentation files"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)
ROW = ["id", "hash_a", "hash_b"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _grams(rows: DataFrame, sizes: list[int], carried: list[str]) -> DataFrame:
    """One row for each k-gram of the ``words`` of ``rows``, k one of ``sizes``: the carried columns, its place ``at``, k, its
    words w0, w1, ... and the hash of the first k of them."""
    last = max(sizes)
    beside = F.arrays_zip(*[F.slice("words", F.lit(i + 1), F.size("words")).alias(f"w{i}") for i in range(last)])
    placed = rows.select(*carried, F.posexplode(beside).alias("at", "w")).select(*carried, "at", "w.*")
    hashes = [F.struct(F.lit(k).alias("k"), F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(F.lit(k), *[f"w{i}" for i in range(k)]))
                       .alias("hash")) for k in sizes]
    return (placed.select("*", F.explode(F.array(*hashes)).alias("g")).select(*carried, "at", *[f"w{i}" for i in range(last)], "g.*")
            .filter("hash is not null"))


def _gram(k: Column, widest: int) -> Column:
    """The first k words as one string."""
    return F.array_join(F.slice(F.array(*[f"w{i}" for i in range(widest)]), F.lit(1), k), " ")


def template_grams(spark: SparkSession, templates: tuple[Template, ...], k: int = K) -> tuple[DataFrame, list[int], int]:
    """The k-grams of the templates, the different values of k among them and the number of rows."""
    literal = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(x.label).alias("label"), F.lit(x.phrase).alias("phrase"),
                                 F.lit(x.text).alias("text")) for i, x in enumerate(templates)])
    rows = spark.range(1).select(F.inline(literal)).withColumn("words", words_of(F.col("text")))
    rows = rows.select("t", "label", "phrase", "words", F.size("words").alias("length")).filter("length > 0")
    # The templates are few: their lengths are looked up once, to know which k occur.
    lengths = [r["length"] for r in rows.select("length").collect()]
    sizes = sorted({min(k, n) for n in lengths}) or [k]
    grams = _grams(rows, sizes, ["t", "label", "phrase", "length"]).filter(F.col("k") == F.least(F.lit(k), "length"))
    grams = grams.select("t", "label", "phrase", "length", "k", F.col("at").alias("t_at"), "hash", _gram(F.col("k"), max(sizes)).alias("gram"))
    return grams, sizes, sum(n - min(k, n) + 1 for n in lengths)


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.xxhash64(content).alias("hash_a"), F.hash(content).alias("hash_b"),
                       words_of(F.col(text)).alias("words"))


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text", k: int = K,
          shift: int = SHIFT) -> DataFrame:
    """Verified spans, one row for each place of a template in a text: the text's ``id``, ``hash_a`` and ``hash_b``; ``t``,
    ``label`` and ``phrase`` of the template; ``start`` and ``end`` (words of the text, the end beyond the span);
    ``coverage``, the share of the template's words found; and how many diagonals hold the whole template (``n_whole``),
    their first and last start."""
    grams, sizes, n = template_grams(docs.sparkSession, templates, k)
    ours = _grams(_identified(docs, key, text), sizes, ROW).drop("k")
    same = (ours["hash"] == grams["hash"]) & (_gram(grams["k"], max(sizes)) == grams["gram"])
    hits = ours.join(F.broadcast(grams) if n <= BROADCAST else grams, same)
    about = ["t", "label", "phrase", "length", "k"]
    votes = (hits.groupBy(*ROW, *about, (F.col("at") - F.col("t_at")).alias("diagonal"))
             .agg(F.sort_array(F.collect_set("t_at")).alias("voted"))
             .withColumn("t_from", F.col("voted")[0])
             .withColumn("start", F.col("diagonal") + F.col("t_from"))
             .withColumn("end", F.col("diagonal") + F.element_at("voted", -1) + F.col("k")))
    # Diagonals of one text and template, by their place in the text: one goes on where the last one ended, within the shift.
    order = Window.partitionBy(*ROW, "t").orderBy("start", "diagonal")
    before = lambda c: F.lag(c).over(order)
    goes_on = ((F.abs(F.col("diagonal") - before("diagonal")) <= shift) & (F.col("t_from") > before("t_from"))
               & (F.col("start") <= before("end") + shift + F.col("k")))
    whole = F.size("voted") == F.col("length") - F.col("k") + 1
    covered = F.flatten(F.transform("voted", lambda v: F.sequence(v, v + F.col("k") - 1)))
    return (votes.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("span", F.sum("new").over(order))
            .groupBy(*ROW, *about, "span")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                 F.size(F.array_distinct(F.flatten(F.collect_list(covered)))).alias("n_covered"),
                 F.count_if(whole).alias("n_whole"), F.min(F.when(whole, F.col("diagonal"))).alias("first_whole"),
                 F.max(F.when(whole, F.col("diagonal"))).alias("last_whole"))
            .select(*ROW, "t", "label", "phrase", "start", "end", (F.col("n_covered") / F.col("length")).alias("coverage"),
                    "n_whole", "first_whole", "last_whole"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text", k: int = K,
         shift: int = SHIFT, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: its key, ``n_words``, ``n_base`` (places of all phrases), ``first_word`` and ``last_word`` (their
    smallest and largest start), ``base_labels`` (of the phrases), ``labels`` (of phrases, and of templates covered to at least
    ``share``), both sorted and joined by commas, and ``score``, the largest coverage of any template."""
    placed = F.col("phrase") & (F.col("n_whole") > 0)
    named = placed | (~F.col("phrase") & (F.col("coverage") >= share))
    joined = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    found = (spans(docs, templates, key, text, k, shift).groupBy(*ROW)
             .agg(F.sum(F.when(placed, F.col("n_whole"))).alias("n_base"), F.min(F.when(placed, F.col("first_whole"))).alias("first_word"),
                  F.max(F.when(placed, F.col("last_whole"))).alias("last_word"), joined(placed).alias("base_labels"),
                  joined(named).alias("labels"), F.max("coverage").alias("score")))
    found = stored(found, "licenses")
    rows = _identified(docs, key, text).select(*ROW, F.size("words").cast("long").alias("n_words"))
    same = rows["id"].eqNullSafe(found["id"]) & (rows["hash_a"] == found["hash_a"]) & (rows["hash_b"] == found["hash_b"])
    return rows.join(found, same, "left").select(
        rows["id"].alias(key), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long"),
        F.col("last_word").cast("long"), F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
