"""Distinct-word tables: chunks of documents that share a dictionary, whose words are dealt by hash to be met once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import release, stored_by

#: Characters of text in a chunk: the rows that share one dictionary of words.
CHUNK = 2_000_000
#: Words of documents that are compressed together.
TOGETHER = 50_000
#: Numbers from which they are packed in whole bytes.
MANY = 1000
COLUMNS = ["chunk", "bucket", "words", "train", "ids", "counts", "weights"]


def pack(words: list[str]) -> bytes:
    return zstandard.compress("\n".join(words).encode("utf-8", "surrogatepass"), 5)


def unpack(blob: bytes) -> list[str]:
    return zstandard.decompress(blob).decode("utf-8", "surrogatepass").split("\n")


def pack_numbers(a: np.ndarray) -> bytes:
    """Numbers below 2^28, compressed: few ones with seven bits to a byte, many with one or two bytes each, or two and two apart. The first byte tells which."""
    a = a.astype(np.uint32)
    if len(a) >= MANY:
        top = int(a.max())
        if top < 1 << 16:
            return (b"\1" if top < 256 else b"\2") + zstandard.compress(a.astype("u1" if top < 256 else "<u2").tobytes(), 5)
        low = zstandard.compress((a & 0xFFFF).astype("<u2").tobytes(), 5)
        return b"\4" + len(low).to_bytes(4, "little") + low + zstandard.compress((a >> 16).astype("<u2").tobytes(), 5)
    parts = np.stack([a & 127, a >> 7 & 127, a >> 14 & 127, a >> 21], 1).astype(np.uint8)
    more = np.stack([a >> 7 > 0, a >> 14 > 0, a >> 21 > 0, np.zeros(len(a), bool)], 1)
    kept = np.concatenate([np.ones((len(a), 1), bool), more[:, :3]], 1)
    return b"\0" + zstandard.compress((parts | more.astype(np.uint8) << 7)[kept].tobytes(), 5)


def unpack_numbers(blob: bytes) -> np.ndarray:
    if blob[0] == 4:
        end = 5 + int.from_bytes(blob[1:5], "little")
        low, high = (np.frombuffer(zstandard.decompress(x), "<u2").astype(np.int64) for x in (blob[5:end], blob[end:]))
        return low | high << 16
    b = np.frombuffer(zstandard.decompress(blob[1:]), "<u2" if blob[0] == 2 else np.uint8)
    last = b < 128
    if blob[0] or last.all():
        return b.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, starts)


def numbers_of(bucket: int, n: int, buckets: int) -> np.ndarray:
    """Numbers of a chunk's n words of a bucket, in their order: the bucket's, then every buckets-th."""
    return bucket + buckets * np.arange(n, dtype=np.int64)


class Numbers(dict):
    """Numbers of words by their buckets, given as they are met."""

    def __init__(self, buckets: int):
        self.buckets, self.by = buckets, [[] for _ in range(buckets)]

    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        own = self.by[bucket]
        self[word] = number = bucket + self.buckets * len(own)
        own.append(word)
        return number

    def end(self) -> int:
        """Beyond all numbers."""
        return self.buckets * max(map(len, self.by))


def _chunks(splitter: Callable[[], Callable[[str | None], list[str]]], buckets: int):
    """Rows of documents (chunk, ids, word counts and weights of some, their words as numbers of the chunk's dictionary)
    and of dictionaries (chunk, bucket, words, sums of weights). A word's number follows from its bucket and its place in it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        split, task = splitter(), TaskContext.get().partitionId()
        numbers = Numbers(buckets)
        size, k, train = 0, 0, np.zeros(1 << 16, np.int64)

        def dictionary() -> pd.DataFrame:
            rows = [(f"{task}-{k}", b, pack(ws), pack_numbers(train[numbers_of(b, len(ws), buckets)])) for b, ws in enumerate(numbers.by) if ws]
            return pd.DataFrame(rows, columns=["chunk", "bucket", "words", "train"]).assign(ids=None, counts=None, weights=None)[COLUMNS]

        def documents(ids: list, counts: list, weights: list, found: list) -> pd.DataFrame:
            nonlocal train
            own = np.array(found, np.int64)
            if (end := numbers.end()) > len(train):
                train = np.concatenate([train, np.zeros(2 * end - len(train), np.int64)])
            times = np.repeat(weights, counts)
            if times.any():
                train += np.bincount(own[times > 0], minlength=len(train))
            return pd.DataFrame({"chunk": [f"{task}-{k}"], "bucket": [-1], "words": [pack_numbers(own)], "train": [None], "ids": [ids], "counts": [counts], "weights": [weights]})[COLUMNS]

        for part in parts:
            ids, counts, weights, found = [], [], [], []
            for id_, text, weight in zip(part["id"], part["text"], part["weight"], strict=True):
                words = split(text)
                size += len(text or "")
                ids.append(None if pd.isna(id_) else id_)
                counts.append(len(words))
                weights.append(int(weight))
                found += map(numbers.__getitem__, words)
                if len(found) > TOGETHER or size > CHUNK:
                    yield documents(ids, counts, weights, found)
                    ids, counts, weights, found = [], [], [], []
                if size > CHUNK:
                    if numbers:
                        yield dictionary()
                    numbers, size, k, train = Numbers(buckets), 0, k + 1, np.zeros(1 << 16, np.int64)
            if ids:
                yield documents(ids, counts, weights, found)
        if numbers:
            yield dictionary()

    return run


def chunked(rows: DataFrame, splitter: Callable[[], Callable[[str | None], list[str]]], buckets: int) -> DataFrame:
    """(id, text, weight) as a stored table of chunks, bucketed by chunk. Rows of bucket -1 are documents, the others dictionaries.

    splitter makes, in each task, the function from a text to its words. A row's weight is 0 or 1.
    """
    kind = dict(rows.dtypes)["id"]
    chunks = rows.mapInPandas(_chunks(splitter, buckets), f"chunk string, bucket int, words binary, train binary, ids array<{kind}>, counts array<int>, weights array<int>")
    return stored_by(chunks, "chunks", "chunk")
