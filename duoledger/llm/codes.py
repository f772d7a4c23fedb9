"""Vector code compression: product codebooks learned in whole numbers, nearest entries found by VA-file filtering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, mapped, read, stored

#: A component x is stored as floor(SCALE * x), between -WIDEST and WIDEST: squares of differences then fit a long.
SCALE, WIDEST = 4096, 1 << 26
#: Bits of a cell of an entry's coordinate; vectors that meet the cells at once.
BITS, AT_ONCE = 3, 2048


def _whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose vector is whole, its components as 32-bit integers, and their number."""
    for part in parts:
        own = [np.asarray([] if v is None else v, np.float32) for v in part["vector"]]
        size = np.array([len(v) for v in own], np.int64)
        flat = np.concatenate([np.zeros(0, np.float32), *own]).astype(np.float64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        ends = np.cumsum(size)
        keep = (bad[ends] == bad[ends - size]) & np.array([v is not None for v in part["vector"]], bool)
        whole = np.clip(np.floor(SCALE * np.where(np.isfinite(flat), flat, 0)), -WIDEST, WIDEST).astype(np.int32)
        rows = part[keep]
        yield pd.DataFrame({"id": rows["id"], "label": rows["label"], "vec": [whole[e - n : e].tobytes() for e, n in zip(ends[keep].tolist(), size[keep].tolist(), strict=True)], "size": size[keep]})


def unpacked(blobs: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of `width` whole numbers; shorter ones end with zeros."""
    return np.frombuffer(b"".join(b.ljust(4 * width, b"\0") for b in blobs), np.int32).reshape(len(blobs), width).astype(np.int64)


class Cells:
    """The entries of one codebook, their coordinates quantised into 2^BITS cells of equal width in each dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        low = entries.min(0)
        width = (entries.max(0) - low) // (1 << BITS) + 1
        self.cell = (entries - low) // width
        self.low = low[:, None] + width[:, None] * np.arange(1 << BITS)
        self.high = self.low + width[:, None] - 1

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry (the lower of equals) and squared distance of each row, and the number of distances computed.

        Each query's table has, for every dimension and cell, the least and the greatest
        square that a coordinate of the cell can add. Sums of them bound the distance to
        each entry; entries whose least is above the smallest greatest can't be nearest.
        """
        below, above = self.low - x[:, :, None], x[:, :, None] - self.high
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.minimum(below, above) ** 2  # both are negative inside, and the smaller is the farther bound
        lower, upper = (sum(table[:, j, self.cell[:, j]] for j in range(x.shape[1])) for table in (least, most))
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        distance = np.full(lower.shape, np.iinfo(np.int64).max)
        distance[row, entry] = ((x[row] - self.entries[entry]) ** 2).sum(1)
        best = distance.argmin(1)
        return best, distance[np.arange(len(x)), best], len(row)


def _assigned(blobs: pd.Series, books: np.ndarray, cells: list[Cells]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their parts, entry of each part, sum of squared distances), some rows at a time."""
    parts, _, width = books.shape
    for i in range(0, len(blobs), AT_ONCE):
        at = slice(i, i + AT_ONCE)
        x = unpacked(blobs.iloc[at], parts * width).reshape(-1, parts, width)
        found = [c.nearest(x[:, p]) for p, c in enumerate(cells)]
        yield at, x, np.stack([f[0] for f in found], 1), sum(f[1] for f in found)


def _sums(books: np.ndarray):
    """(part, entry, position, sum, count) of the parts assigned in this task."""
    parts, k, width = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = [Cells(b) for b in books]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for _, x, entry, _ in _assigned(batch["vec"], books, cells):
                for p in range(parts):
                    counts[p] += np.bincount(entry[:, p], minlength=k)
                    for e in np.unique(entry[:, p]):
                        sums[p, e] += x[entry[:, p] == e, p].sum(0)
        p, e, j = (a.ravel() for a in np.indices(books.shape))
        out = pd.DataFrame({"part": p, "entry": e, "place": j, "total": sums.ravel(), "n": np.repeat(counts.ravel(), width)})
        yield out[out["n"] > 0]

    return run


def learn(vectors: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) of a table (id, vec, size): Lloyd's rounds in whole numbers, starting from the vectors of the smallest ids.

    Each round sums the parts of every entry within tasks, then across them; parts x
    entries x components sums reach the driver, a number that the data don't set (but for
    the vectors' length).
    """
    longest = vectors.agg(F.max("size")).first()[0] or 0
    width = -(-longest // parts)
    first = vectors.select("id", "vec").orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).toPandas()
    books = unpacked(first["vec"], parts * width).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if books.size else 0):
        sums = vectors.select("vec").mapInPandas(_sums(books), "part int, entry int, place int, total long, n long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    """Of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _coded(books: np.ndarray):
    digits = 2 if books.shape[1] <= 256 else 4

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = [Cells(b) for b in books] if books.size else []
        for batch in batches:
            code, error = [], []
            if cells:
                for _, _, entry, distance in _assigned(batch["vec"], books, cells):
                    code += ["".join(f"{e:0{digits}x}" for e in row) for row in entry.tolist()]
                    error.append(distance)
            else:  # vectors without components: all are the first entry
                code, error = ["0" * digits * books.shape[0]] * len(batch), [np.zeros(len(batch), np.int64)]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "code": code, "error": np.concatenate([np.zeros(0, np.int64), *error])})

    return run


def compress(table: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every row whose vector is whole.

    Vectors become whole numbers (floor of 4096 times a component), are cut into equal
    parts, and each part is replaced by the nearest entry of its codebook (at most 65,536
    entries). error is the squared distance, in whole numbers; label_error its sum over a
    label. Vectors stay in one stored table; a round reads it and moves sums alone.

    Rows whose vector is null or holds null or non-finite numbers go. Components beyond
    16,384 count as that. Where lengths differ or parts don't divide them, vectors count as
    ended with zeros; those without components are the first entry. Fewer rows than entries
    make fewer entries. Rows of a null id are coded but start codebooks last; of rows of one
    id, the least vector is the first. Null labels are one label. Repeated rows weigh as
    often as they stand. label_error is null where the sum leaves a long. Lengths, not
    texts, are what can be long here: parts of n components take n steps. An empty
    table gives no rows. Other columns are ignored.
    """
    if not 1 <= entries <= 1 << 16 or parts < 1:
        raise ValueError("entries: 1 to 65536; parts: 1 or more")
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), F.col(label_col).alias("label"))
    vectors = stored(mapped(rows, _whole, "vec binary, size long", "id", "label"), "whole")
    books = learn(vectors, parts, entries, rounds)
    coded = mapped(vectors.select("id", "label", "vec"), _coded(books), "code string, error long", "id", "label")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = stored(coded.withColumn("key", key), "coded")
    totals = coded.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("copies"))
    return looked_up(coded, totals, "key").select("id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").drop("label").withColumnRenamed("id", "vec_id")
