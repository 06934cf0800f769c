"""Byte-pair encoding and decoding with a byte-level vocabulary, by contiguous rank arrays.

A word's parts and the ranks of its adjacent pairs lie side by side in two arrays. The least rank is found by a scan,
the boundary between its two parts is deleted, and the ranks to its left and right are refreshed, until no pair can be
merged. Words longer than ``LONG`` parts, where repeated scans would cost the square of the length, are merged in the
same order (least rank, then leftmost) from a heap. Words are encoded once per task and then looked up.

The vocabulary is read on the driver (its size is that of the tokenizer file) and broadcast; texts travel in Arrow
batches and never leave their partition, so nothing is shuffled.

Defined results: a null or empty text has no tokens, and decodes to the empty text; the special tokens of the file are
matched in texts first, as the library does; all columns of repeated rows are computed alike; unknown ids are an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 128
#: Words remembered per task; beyond it the memory is emptied, which changes no result.
REMEMBERED = 400_000
NO_MERGE = 1 << 62


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What the tasks need of a tokenizer file: token bytes by id, merges by pair of ids, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = printable_bytes()
    ids = spec["model"]["vocab"]
    token_bytes = {i: bytes(back[c] for c in t) for t, i in ids.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes |= {i: t.encode() for t, i in special.items()}
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in spec["model"]["merges"]]
    return {"token_bytes": [token_bytes.get(i) for i in range(max(token_bytes) + 1)], "merges": merges, "special": special}


class Encoder(dict):
    """Maps a word to the bytes of its ids (little-endian, 32 bits each); computes and remembers what it lacks."""

    def __init__(self, vocabulary: dict):
        import regex

        self.token_bytes = vocabulary["token_bytes"]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(vocabulary["merges"])}
        self.merged = [c for _, _, c in vocabulary["merges"]]
        self.byte_id = {t[0]: i for i, t in enumerate(self.token_bytes) if t is not None and len(t) == 1}
        self.special = {s: np.uint32(i).astype("<u4").tobytes() for s, i in vocabulary["special"].items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.words = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> bytes:
        parts = [self.byte_id[b] for b in word.encode()]
        ids = self.merge_short(parts) if len(parts) <= LONG else self.merge_long(parts)
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found

    def merge_short(self, parts: list[int]) -> list[int]:
        rank = self.rank.get
        ranks = [rank(pair, NO_MERGE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < NO_MERGE:
            at = ranks.index(least)
            parts[at] = self.merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NO_MERGE)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NO_MERGE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        rank, end = self.rank.get, len(parts)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(end - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else end
            if j >= end or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < end:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < end and (s := rank((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (s, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self.marks is None or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.words(text)))
        return b"".join(self.special[piece] if i % 2 else b"".join(map(self.__getitem__, self.words(piece)))
                        for i, piece in enumerate(self.marks.split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


def _vocabulary(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(load(path))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``ids``, the token ids of its whole text as packed 32-bit integers."""
    vocabulary = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for b in batches:
            for i in range(b.num_rows):  # one text at a time: ids take four bytes a token
                ids = encoder.encode(b.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([ids], pa.binary())], [key, "ids"])

    rows = docs.select(F.col(key), F.col(text).alias("text"))
    return rows.mapInArrow(run, rows.select(key).withColumn("ids", F.lit(None).cast("binary")).schema)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: its id and the text that its ids stand for."""
    vocabulary = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for b in batches:
            for i in range(b.num_rows):
                text = encoder.decode(b.column(1)[i].as_py() or b"")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([text], pa.string())], [key, "text"])

    rows = encoded.select(F.col(key), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, rows.select(key).withColumn("text", F.lit(None).cast("string")).schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass over it: its id, ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the decoded text in UTF-8)."""
    vocabulary = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for b in batches:
            n, of_ids, of_text = [], [], []
            for value in b.column(1):
                ids = encoder.encode(value.as_py() or "")
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                                              pa.array(of_text, pa.string())],
                                             [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, "
                                "decoded_sha256 string")
