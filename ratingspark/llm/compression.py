"""Quality classifier by compression: how much better a text packs with a dictionary of good texts than of bad ones.

Two zstandard dictionaries are trained on whole labelled texts of either class. A text is cut into blocks, so that the
dictionary weighs alike at its start and end, and every block is compressed with both. The difference of the two sizes
over their mean, together with the packed share of the text (repetition packs well with any dictionary), is calibrated
to a probability by logistic regression on labelled texts that the dictionaries have not seen.

What is fitted uses bounded samples (``DICTIONARY_TEXTS``, ``CALIBRATION_TEXTS`` per class, in hash order of the id, and
for dictionaries texts of at most ``LONGEST`` bytes); every row is scored, whole.

Defined results: a null text counts as empty; an empty text gets the calibrated score of no evidence; labels other than
0 and 1, or null, are not learned from; without labels of both classes every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICTIONARY_TEXTS, CALIBRATION_TEXTS, LONGEST = 600, 6000, 1 << 16
DICTIONARY_BYTES, BLOCK, LEVEL = 1 << 15, 1024, 3


def held_out(key: Column, fold: int = 0, folds: int = 5) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds == fold


def _blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


def train_dictionary(texts: list[bytes]) -> bytes:
    """Dictionary bytes from whole texts; too few of them to train on serve as they are."""
    import zstandard

    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of a text with each of the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.compress = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False).compress)

    def features(self, text: bytes) -> tuple[float, float]:
        """Normalised difference (over 0: packs better as a good text), and log of the packed share."""
        if not text:
            return 0.0, 0.0
        blocks = _blocks(text)
        good, bad = (sum(map(len, map(c, blocks))) for c in self.compress)
        return 2 * (bad - good) / (bad + good), float(np.log(min(good, bad) / len(text)))


def _sample(labelled: DataFrame, label: int, n: int, for_dictionary: bool) -> DataFrame:
    """At most ``n`` rows of a class, the first in hash order: a top-k, not a sort of the table. A quarter of the hashes
    is for dictionaries, the rest for calibration, so neither sees the other's texts at any size of the table."""
    order = F.md5(F.col("id").cast("string"))
    pool = order < "4" if for_dictionary else order >= "4"
    return labelled.filter((F.col("label") == label) & pool).orderBy(order, "id").limit(n)


def dictionaries(docs: DataFrame, labelled: DataFrame) -> tuple[bytes, bytes] | None:
    """(good, bad) dictionaries. docs: (id, text); labelled: (id, label). None if a class has no text."""
    ids = _sample(labelled, 1, DICTIONARY_TEXTS, True).unionByName(_sample(labelled, 0, DICTIONARY_TEXTS, True))
    # At most 2 * DICTIONARY_TEXTS ids are broadcast, and as many texts of LONGEST bytes collected.
    found = (docs.filter(F.octet_length("text").between(1, LONGEST)).join(F.broadcast(ids), "id")
             .dropDuplicates(["id", "label"]).orderBy("id").select("label", "text").collect())
    texts = {k: [r.text.encode() for r in found if r.label == k] for k in (1, 0)}
    return (train_dictionary(texts[1]), train_dictionary(texts[0])) if texts[1] and texts[0] else None


def measure(docs: DataFrame, dicts: tuple[bytes, bytes], text: str = "text", name: str = "packing") -> DataFrame:
    """``docs`` with a struct column ``name`` (difference, packed) for every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(dicts)
    out = docs.select("*", F.struct(F.lit(0.0).alias("difference"), F.lit(0.0).alias("packed")).alias(name)).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*shared.value)
        for b in batches:
            pairs = np.array([sizes.features((t.as_py() or "").encode()) for t in b.column(at)]).reshape(-1, 2)
            packing = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["difference", "packed"])
            yield pa.RecordBatch.from_arrays([*b.columns, packing], [*b.schema.names, name])

    return docs.mapInArrow(run, out)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias first) of a logistic regression by Newton steps; a little ridge keeps separable data finite."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, a.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


class Classifier(NamedTuple):
    """What is fitted: the two dictionaries (None without labels of both classes) and the calibration weights."""

    dicts: tuple[bytes, bytes] | None
    weights: tuple[float, float, float]

    def of(self, packing: Column) -> Column:
        """Score 0 to 1 from a text's packing; higher: label 1 likelier."""
        bias, difference, packed = self.weights
        return 1 / (1 + F.exp(-(F.lit(bias) + packing["difference"] * difference + packing["packed"] * packed)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Classifier:
    """Learns from labelled rows outside the held-out fold (crc32 of the id mod 5 is 0)."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    labelled = (labels.select(F.col(key).alias("id"), F.col(label).alias("label"))
                .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).distinct())
    dicts = dictionaries(rows, labelled)
    if dicts is None:
        return Classifier(None, (0.0, 0.0, 0.0))
    ids = _sample(labelled, 1, CALIBRATION_TEXTS, False).unionByName(_sample(labelled, 0, CALIBRATION_TEXTS, False))
    # At most 2 * CALIBRATION_TEXTS ids are broadcast, and as many rows of three numbers collected.
    sample = measure(rows.join(F.broadcast(ids), "id"), dicts).select("id", "label", "packing.*").dropDuplicates(["id", "label"])
    seen = sample.orderBy("id", "label").collect()
    y = np.array([r.label for r in seen], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return Classifier(dicts, (0.0, 0.0, 0.0))
    w = calibrate(np.array([[r.difference, r.packed] for r in seen]), y)
    # The sample holds both classes alike; the bias is moved to their shares of all labels.
    totals = {r.label: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    w[0] += np.log(totals[1] / totals[0]) - np.log(n1 / n0)
    return Classifier(dicts, tuple(map(float, w)))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: its id, ``held_out`` (crc32 of the id mod 5 is 0: never learned from), ``score``
    (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on)."""
    model = fit(docs, labels, key, text, label)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    out = (rows.select("id", F.lit(0.5).alias("score")) if model.dicts is None
           else measure(rows, model.dicts).select("id", model.of(F.col("packing")).alias("score")))
    return out.select(F.col("id").alias(key), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; all columns kept."""
    model = fit(docs, labels, key, text, label)
    if model.dicts is None:
        return docs
    name = "packing"
    while name in docs.columns:
        name = f"_{name}"
    return measure(docs, model.dicts, text, name).filter(model.of(F.col(name)) >= threshold).drop(name)
