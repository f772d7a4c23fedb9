"""N-gram Jaccard join: links and groups of documents by exact Jaccard similarity of their word shingles.

The Jaccard distance of two sets is at most 1 - t exactly when their symmetric difference
has at most (a + b) (1 - t) / (1 + t) elements; both are metrics. Sets meet in cells, one for
each element of their prefix in one global order (rare elements first), which no similar
pair escapes. A short sketch of counts, whose distance never exceeds the symmetric
difference, carries the metric: in a large cell pivots make Voronoi regions, rows within
the triangle-inequality window of a boundary are replicated across it as rows of Spark, and
regions are parted again until they are small. Pairs that survive are compared exactly by
their whole sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, mapped, read, release, small, stored

#: Counters of a sketch, each kept modulo 16; rows of a region that are compared outright; pivots of a larger one.
COUNTERS, LEAF, PIVOTS = 64, 48, 8
#: A region is dense, and not parted further, if one of its parts has more than this share of its rows.
DENSE = 0.75
#: Dense regions are compared with further pivots as long as that links this share of their rows.
STARRED = 0.1
#: Counters of the sketches by which pairs are checked before their whole sets.
FINE = 1024
#: Elements of a set for each further element that prefixes of similar sets have in common at least.
SHARED = 64
#: An element is frequent, and so comes late in the order, from this number of prefixes on; most of them that are named.
FREQUENT, MOST_FREQUENT = 64, 1 << 17
#: Rows of a block of a dense region, which is dealt as pairs of blocks. Pairs of rows that are compared at once.
BLOCK, PAIRS = 1024, 1 << 14
#: A group with this share of the rows of a dense region has blocks of its own, which never meet.
MAIN = 0.25
#: Size from which the sets of a cell count as equally large.
LARGE = (1 << 15) - 1
#: Rows up to which a table of ids, or of regions with their pivots, is broadcast.
BROADCAST, REGIONS = 1_000_000, 50_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


#: For each byte a random number, and whether words hold it. Bytes of texts that are hashed at once; powers of an odd number and of its inverse modulo 2^64.
LETTERS, INK, AT_ONCE = np.random.default_rng(1).integers(0, 1 << 64, 256, np.uint64), np.array([b not in b" \t\n\r\v\f" for b in range(256)]), 1 << 17
UP, DOWN = (np.cumprod(np.full(AT_ONCE, x, np.uint64)) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))


def spread(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Shingler:
    """Sets of 64-bit shingle hashes."""

    def __init__(self, k: int):
        self.k = k

    def words_of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of data (sums of their letters' numbers, weighted by powers), and where they start."""
        text = np.frombuffer(data, np.uint8)
        ink = np.zeros(len(text) + 2, bool)
        ink[1:-1] = INK[text]
        edges = np.flatnonzero(ink[1:] != ink[:-1])
        starts, ends = edges[::2], edges[1::2]
        h, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            low = starts[i]
            j = int(np.searchsorted(ends, low + AT_ONCE, side="right"))
            if j > i:
                total = np.zeros(ends[j - 1] - low + 1, np.uint64)
                np.cumsum(LETTERS[text[low : ends[j - 1]]] * UP[: len(total) - 1], out=total[1:])
                h[i:j] = (total[ends[i:j] - low] - total[starts[i:j] - low]) * DOWN[starts[i:j] - low]
            else:  # a word longer than that
                j = i + 1
                h[i] = xxhash.xxh64_intdigest(data[low : ends[i]])
            i = j
        return spread(h), starts

    def sets_of(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for text in texts:
            own = text.encode("utf-8", "surrogatepass").lower() if text else b""
            if held and size + len(own) >= AT_ONCE:
                yield from self.sets_at_once(held)
                held, size = [], 0
            held.append(own)
            size += len(own) + 1
        yield from self.sets_at_once(held)

    def sets_at_once(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        h, starts = self.words_of(b" ".join(texts))
        first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        n = len(h) - self.k + 1
        s = np.zeros(max(n, 0), np.uint64)
        for i in range(self.k if n > 0 else 0):
            s += h[i : i + n] * FACTORS[i]
        spread(s)
        for i, j in itertools.pairwise(first.tolist()):
            if j - i >= self.k:
                own = np.sort(s[i : j - self.k + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            else:  # the whole sequence
                yield spread(np.array([xxhash.xxh64_intdigest(h[i:j].tobytes())] if j > i else [], np.uint64))

    def set_of(self, text: str | None) -> np.ndarray:
        return next(self.sets_of([text]))


def least_shared(n: int, num: int, den: int) -> int:
    """Elements at least that the prefix of a set of n has in common with the prefix of every similar set no smaller."""
    return min(1 + n // SHARED, -(-num * n // den))


def prefix_length(n: int, num: int, den: int) -> int:
    """With n - ceil(t n) + k elements each, prefixes of similar sets share k."""
    return n - -(-num * n // den) + least_shared(n, num, den) if n else 0


def short_length(n: int, num: int, den: int) -> int:
    """Elements of that prefix that are enough on one side: a set shares as many with the prefix of every similar set no smaller in its first n - ceil(2 t n / (1 + t)) + k, as they have at least ceil(2 t n / (1 + t)) in common."""
    return n - -(-2 * num * n // (num + den)) + least_shared(n, num, den) if n else 0


#: What elements are counted by, their lower bits: which of them come late decides no result, and so less is moved.
LOWER = np.uint32


def is_in(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which elements are frequent (sorted, whole or their lower bits)."""
    own = own.astype(frequent.dtype, copy=False)
    return frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own


def prefix_of(own: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first elements of a sorted set in the order: those not frequent by hash, then the frequent by hash."""
    p = prefix_length(len(own), num, den)
    if not len(frequent) or not p:
        return own[:p]
    first = own[: 2 * p]  # mostly enough
    first = first[~is_in(first, frequent)][:p]
    if len(first) == p:
        return first
    late = is_in(own, frequent)
    first = own[~late][:p]
    return first if len(first) == p else np.concatenate([first, own[late][: p - len(first)]])


def sketch_of(own: np.ndarray, counters: int = COUNTERS) -> bytes:
    """Two counters to a byte."""
    counts = (np.bincount((own >> np.uint64(40)).astype(np.int64) % counters, minlength=counters) & 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def sketches_of(blobs) -> np.ndarray:
    if not len(blobs):
        return np.zeros((0, COUNTERS), np.uint8)
    packed = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(blobs), -1)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of circular distances modulo 16: a metric that never exceeds the symmetric difference."""
    d = (a - b) & 15
    return np.minimum(d, 16 - d).sum(-1, dtype=np.int64)


def _first_prefixes(k: int, num: int, den: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for part in parts:
            own = [s[: prefix_length(len(s), num, den)] for s in shingler.sets_of(part["text"])]
            lower, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]).astype(LOWER), return_counts=True)
            yield pd.DataFrame({"lower": lower.view(np.int32), "n": n.astype(np.int64)})

    return run


def _records(k: int, num: int, den: int, frequent):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        shingler, late = Shingler(k), frequent.value
        for part in parts:
            rows = []
            for id_, s in zip(part["id"], shingler.sets_of(part["text"]), strict=True):
                rows.append((id_, len(s), short_length(len(s), num, den), xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63), prefix_of(s, late, num, den).view(np.int64), sketch_of(s), sketch_of(s, FINE)))
            yield pd.DataFrame(rows, columns=["id", "n", "short", "s1", "s2", "prefix", "sketch", "fine"])

    return run


def _sets(k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "elements": [s.view(np.int64) for s in shingler.sets_of(part["text"])]})

    return run


def _possible(num: int, den: int):
    """Pairs whose fine sketches do not differ by more than similar sets' can."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keep = [np.zeros(0, bool)]
            for i in range(0, len(part), 1000):
                own = part.iloc[i : i + 1000]
                keep.append(similar_by(sketches_of(own["fa"]), sketches_of(own["fb"]), own["na"].to_numpy(), own["nb"].to_numpy(), num, den))
            yield part[["a", "b"]][np.concatenate(keep)]

    return run


def similar_by(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs that neither their sizes m and n nor their sketches x and y rule out."""
    m, n = m.astype(np.int64), n.astype(np.int64)
    return (den * np.minimum(m, n) >= num * np.maximum(m, n)) & (sketch_distance(x, y) * (num + den) <= (m + n) * (den - num))


# ---------------------------------------------------------------- cells and regions


class Rows:
    """Rows of one or more regions: ids, set sizes, sketches, the groups that they are known to be in, whether the region is their home, their blocks, and whether the cell's element is in the short part of their prefix."""

    def __init__(self, rows: pd.DataFrame, num: int, den: int):
        self.ids, self.n, self.groups, self.home = (rows[c].to_numpy() for c in ("id", "n", "grp", "home"))
        self.sketches, self.num, self.den = sketches_of(rows["sketch"]), num, den
        self.fine = sketches_of(rows["fine"]) if "fine" in rows else None
        self.blocks = rows["block"].to_numpy() if "block" in rows else None
        self.short = rows["short"].to_numpy() if "short" in rows else None
        self.found: list[pd.DataFrame] = []

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Keep the pairs of rows that sizes, sketches, groups and the smaller set's short part do not rule out. A pair is made where its smaller id is at home, so once in a cell."""
        keep = (self.groups[a] != self.groups[b]) & (self.ids[a] != self.ids[b])
        if self.blocks is not None:
            keep &= self.blocks[a] != self.blocks[b]
        if self.short is not None:
            m, n = self.n[a], self.n[b]
            keep &= np.where(m <= n, self.short[a], True) & np.where(m >= n, self.short[b], True)
        a, b = a[keep], b[keep]
        for i in range(0, len(a), PAIRS):
            x, y = a[i : i + PAIRS], b[i : i + PAIRS]
            x, y = np.where(self.ids[x] < self.ids[y], x, y), np.where(self.ids[x] < self.ids[y], y, x)
            x, y = x[self.home[x]], y[self.home[x]]
            near = similar_by(self.sketches[x], self.sketches[y], self.n[x], self.n[y], self.num, self.den)
            x, y = x[near], y[near]
            if self.fine is not None:
                near = similar_by(self.fine[x], self.fine[y], self.n[x], self.n[y], self.num, self.den)
                x, y = x[near], y[near]
            if len(x):
                self.found.append(self.pair(x, y))

    def pair(self, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": self.ids[x], "b": self.ids[y], "n": np.minimum(self.n[x], self.n[y])})

    def across(self) -> None:
        """Compare the rows that are not of one known group; other pairs are never made."""
        rows = np.argsort(self.groups, kind="stable")
        end = np.searchsorted(self.groups[rows], self.groups[rows], side="right")
        count = len(rows) - end
        total, i = np.cumsum(count), 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(total, total[i] - count[i] + PAIRS, side="right")))
            own = count[i:j]
            a = np.repeat(np.arange(i, j), own)
            b = np.arange(len(a)) + np.repeat(end[i:j] - (np.cumsum(own) - own), own)
            self.compare(rows[a], rows[b])
            i = j

    def pairs(self) -> pd.DataFrame:
        return pd.concat(self.found) if self.found else pd.DataFrame({"a": self.ids[:0], "b": self.ids[:0], "n": self.n[:0]})


class Bridges(Rows):
    """Rows that keep one pair of any two groups, the closest by fine sketches: if it is a link, the others tell nothing. more is the number of the others, low the least n of all."""

    def pair(self, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        far = sketch_distance(self.fine[x], self.fine[y]) / (self.n[x] + self.n[y])
        g, h = self.groups[x], self.groups[y]
        found = super().pair(x, y).assign(g=np.minimum(g, h), h=np.maximum(g, h), far=far, more=1)
        return self.closest(found.assign(low=found["n"]))

    def closest(self, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["g", "h", "far", "a", "b"], ignore_index=True)
        of = found.groupby(["g", "h"], sort=False)
        return found.assign(more=of["more"].transform("sum"), low=of["low"].transform("min"))[~found.duplicated(["g", "h"])]

    def pairs(self) -> pd.DataFrame:
        if not self.found:
            return super().pairs().assign(low=self.n[:0], more=0)
        found = self.closest(pd.concat(self.found))
        return found.assign(more=found["more"] - 1)[["a", "b", "n", "low", "more"]]


def _runs(parts: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows sorted by key in pieces that no run of a key crosses; where runs start, and their sizes."""
    held: pd.DataFrame | None = None
    for part in parts:
        rows = part if held is None else pd.concat([held, part], ignore_index=True)
        if not len(rows):
            continue
        last = (rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy()
        held = rows[last]
        if not last.all():
            yield _run(rows[~last], key)
    if held is not None and len(held):
        yield _run(held, key)


def _run(rows: pd.DataFrame, key: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    rows = rows.reset_index(drop=True)
    starts = np.flatnonzero((rows[key] != rows[key].shift()).any(axis=1).to_numpy())
    return rows, starts, np.diff(np.append(starts, len(rows)))


def _stars(num: int, den: int):
    """Of each small cell, the first row with each of the others."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, sizes in _runs(parts, ["element"]):
            own = Rows(rows, num, den)
            own.compare(np.repeat(starts, sizes), np.arange(len(rows)))
            yield own.pairs().drop_duplicates(["a", "b"])[["a", "b"]]

    return run


def _leaves(num: int, den: int):
    """Of each region (of LEAF rows at most), all pairs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, sizes in _runs(parts, ["element", "region"]):
            own = Rows(rows, num, den)
            for m in np.unique(sizes[sizes > 1]).tolist():
                i, j = np.triu_indices(m, 1)
                of_size = starts[sizes == m]
                step = max(1, PAIRS // len(i))
                for s in range(0, len(of_size), step):
                    base = of_size[s : s + step, None]
                    own.compare((base + i).reshape(-1), (base + j).reshape(-1))
            yield own.pairs()

    return run


def _blocks(num: int, den: int, kind: type[Rows] = Rows):
    """Of each pair of blocks of a dense region, the pairs across that kind keeps; of a block with itself, all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, sizes in _runs(parts, ["element", "region", "b0", "b1"]):
            for s, m in zip(starts.tolist(), sizes.tolist(), strict=True):
                part = rows.iloc[s : s + m]
                own = kind(part if part["b0"].iloc[0] != part["b1"].iloc[0] else part.drop(columns="block"), num, den)
                own.across()
                yield own.pairs()

    return run


def _parted(num: int, den: int):
    """Rows of large regions, each with its region's pivots (sketches, pid, pn, pg): once for each part that it belongs to or whose boundary is near, and as a pair (pivot, id) with one pivot that may be similar.

    Which pivot that is follows a hash of ids, so that it is mostly the same in all cells of a row. The window of a row is twice the greatest distance of sets similar to it.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for i in range(0, len(whole), 2000):
                yield from one(whole.iloc[i : i + 2000])

    def one(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        own, n = sketches_of(part["sketch"])[:, None], part["n"].to_numpy().astype(np.int64)
        pivots = sketches_of(part["pivots"]).reshape(len(part), PIVOTS, -1)
        d = sketch_distance(own, pivots)
        nearest = d.argmin(1)
        row, j = np.nonzero(d <= d.min(1, keepdims=True) + (2 * (n * (den - num) // num))[:, None])
        out = part[["element", "region", "id", "n", "sketch"]].iloc[row].rename(columns={"region": "parent"})
        out["short"] = part["short"].to_numpy()[row] if "short" in part else True
        yield out.assign(region=out["parent"].to_numpy() * PIVOTS + j + 1, home=part["home"].to_numpy()[row] & (nearest[row] == j), pivot=pd.array([None] * len(row), dtype="Int64"))[COLUMNS]
        pid, pn, pg = (np.stack(part[c].to_numpy()).astype(np.int64) for c in ("pid", "pn", "pg"))
        x, y = np.maximum(n[:, None], pn), np.minimum(n[:, None], pn)
        near = (d * (num + den) <= (x + y) * (den - num)) & (den * y >= num * x) & (part["grp"].to_numpy()[:, None] != pg)
        order = np.where(near, pid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1), np.uint64((1 << 64) - 1))
        row = np.flatnonzero(near.any(1))
        pairs = pd.DataFrame({"id": part["id"].to_numpy()[row], "pivot": pid[row, order[row].argmin(1)]}).drop_duplicates()
        yield pairs.assign(pivot=pairs["pivot"].astype("Int64"), element=0, parent=0, region=0, n=0, sketch=b"", home=False, short=False)[COLUMNS]

    return run


COLUMNS = ["element", "parent", "region", "id", "n", "sketch", "home", "short", "pivot"]


def known_groups(links: DataFrame) -> DataFrame:
    """(id, grp): a row reached by the id's links, the same for rows about one of least id; rows of equal grp are connected."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("c"))
    near = both.join(least.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("c"))
    jump = least.select(F.col("u").alias("c"), F.col("c").alias("cc"))
    return stored(near.join(jump, "c").select(F.col("u").alias("id"), F.col("cc").alias("grp")), "known")


class Join:
    """The steps of a join over one table of records; links grow from step to step."""

    def __init__(self, rows: DataFrame, records: DataFrame, k: int, num: int, den: int):
        self.rows, self.k, self.num, self.den = rows, k, num, den
        self.fine = records.select("id", "n", "fine")
        self.links: DataFrame | None = None
        self.groups: DataFrame | None = None

    def ids_of(self, pairs: DataFrame) -> DataFrame:
        return small(stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "named"), BROADCAST)

    def verify(self, pairs: DataFrame) -> int:
        """Adds the pairs (a, b) that are links, and counts them: those that fine sketches let through, by their whole sets. Only rows that are in a pair move."""
        pairs = stored(pairs.select("a", "b").distinct(), "pairs")
        fine = self.fine.join(self.ids_of(pairs), "id", "left_semi")
        one, other = (fine.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"f{c}")) for c in ("a", "b"))
        pairs = stored(pairs.join(one, "a").join(other, "b").mapInPandas(_possible(self.num, self.den), "a long, b long"), "possible")
        sets = stored(self.rows.join(self.ids_of(pairs), "id", "left_semi").mapInPandas(_sets(self.k), "id long, elements array<long>"), "sets")
        one, other = (sets.join(pairs.select(F.col(c).alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias(c), F.col("elements").alias(f"e{c}")) for c in ("a", "b"))
        common = F.size(F.array_intersect("ea", "eb"))
        exact = pairs.join(one, "a").join(other, "b").where(common * self.den >= self.num * (F.size("ea") + F.size("eb") - common)).select("a", "b").distinct()
        exact = stored(exact, "links")
        self.links = exact if self.links is None else self.links.unionByName(exact)
        return exact.count()

    def learn(self) -> None:
        """Groups by near links, in one step."""
        self.groups = small(known_groups(self.links), BROADCAST)

    def join_up(self) -> None:
        """Groups by all links, whole."""
        self.groups = small(stored(components(self.links).select(F.col("node").alias("id"), F.col("component").alias("grp")), "groups"), BROADCAST)

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with grp, the group that they are known to be in."""
        if self.groups is None:
            return rows.withColumn("grp", F.col("id"))
        return rows.join(self.groups, "id", "left").withColumn("grp", F.coalesce("grp", "id"))

    def pivoted(self, regions: DataFrame, turn: int) -> DataFrame:
        """Regions that are not of one known group: rows, and PIVOTS of them, found by aggregation: by least hash, but from turn 1 on, of each class of hashes the row that is in the most regions (cells)."""
        by_class = lambda j: F.struct((F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(PIVOTS)) + j) % PIVOTS, -F.col("cells"), F.xxhash64("id"))
        pivots = [F.min_by(F.struct("id", "n", "grp", "sketch"), by_class(j) if turn else F.xxhash64("id", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)]
        stats = self.placed(regions).groupBy("element", "region").agg(F.count("*").alias("rows"), F.min("grp").alias("low"), F.max("grp").alias("high"), F.max("home").alias("homes"), F.max("short").alias("shorts"), *pivots).where("low < high and homes and shorts")
        of = lambda f: F.array(*[F.col(f"p{j}")[f] for j in range(PIVOTS)])
        return stored(stats.select("element", "region", "rows", F.concat(*[F.col(f"p{j}")["sketch"] for j in range(PIVOTS)]).alias("pivots"), of("id").alias("pid"), of("n").alias("pn"), of("grp").alias("pg")), "regions")

    def compared(self, regions: DataFrame, stats: DataFrame) -> DataFrame:
        """Rows of the regions in the parts that their pivots make, and pairs with pivots."""
        rows = self.placed(regions).join(small(stats, REGIONS), ["element", "region"])
        return rows.select("element", "region", "id", "n", "sketch", "home", "short", "grp", "pivots", "pid", "pn", "pg").mapInPandas(_parted(self.num, self.den), "element long, parent long, region long, id long, n int, sketch binary, home boolean, short boolean, pivot long")

    def part(self, regions: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
        """Parts regions (element, region, id, n, sketch, home, short) of more than LEAF rows until they are small or dense: small ones, and dense ones with their rows' count.

        Pivots are compared with all rows of their region, so that groups of near copies are
        known early. Regions of one known group have nothing to compare and go.
        """
        leaves, dense, key = [], [], ["element", "region"]
        while True:
            stats = self.pivoted(regions, 0)
            leaves.append(regions.join(small(stats.where(F.col("rows") <= LEAF).select(*key), REGIONS), key, "left_semi"))
            stats = stats.where(F.col("rows") > LEAF)
            if not stats.limit(1).count():
                return leaves, self.starred(stored(reduce(DataFrame.unionByName, dense), "dense")) if dense else None
            parted = stored(self.compared(regions, stats), "parted")
            sizes = parted.where("pivot is null").groupBy("element", "parent", "region").count().groupBy("element", F.col("parent").alias("region")).agg(F.max("count").alias("most"))
            full = small(stored(stats.select(*key, "rows").join(sizes, key).where(F.col("most") > DENSE * F.col("rows")).select(*key, "rows"), "full"), REGIONS)
            dense.append(regions.join(full, key))
            pairs = parted.where("pivot is not null").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))
            regions = parted.where("pivot is null").join(full.select("element", F.col("region").alias("parent")), ["element", "parent"], "left_anti").select(*key, "id", "n", "sketch", "home", "short")
            self.verify(pairs)
            self.learn()

    def starred(self, dense: DataFrame) -> DataFrame:
        """Compares dense regions with other pivots, turn by turn, as long as that links many of their rows: groups grow, and few rows are left whose pairs must be made.

        Of near copies, those that differ least from what all have in common are in the most
        dense regions. They are the nearest to all others, so they are the pivots.
        """
        dense, turn = stored(dense.join(dense.groupBy("id").agg(F.count("*").alias("cells")), "id"), "dense"), 1
        while True:
            stats = self.pivoted(dense, turn)
            pairs = self.compared(dense, stats).where("pivot is not null").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))
            found = self.verify(pairs)
            self.join_up()
            if found < STARRED * dense.join(small(stats.select("element", "region"), REGIONS), ["element", "region"], "left_semi").select("id").distinct().count() or not found:
                return dense
            turn += 1

    def leaf_pairs(self, leaves: list[DataFrame]) -> DataFrame:
        rows = self.placed(reduce(DataFrame.unionByName, leaves)).repartition("element", "region").sortWithinPartitions("element", "region")
        return rows.mapInPandas(_leaves(self.num, self.den), "a long, b long, n int")

    def dealt(self, dense: DataFrame) -> DataFrame:
        """Rows of dense regions that are not of one known group, once for each pair of blocks (b0, b1) that theirs is in.

        A region is two: in one, rows with the short part of their prefix meet each other;
        in the other they meet, where they are smaller, the rows without. There, rows of one
        side are never compared with each other, and in the first those of its main group:
        blocks below 0 only meet those from 0 on. So of a group that a few rows are left
        apart from, each row is dealt once, whatever the group's size.
        """
        key, rows = ["element", "region"], self.placed(dense.drop("rows", "cells"))
        sizes = rows.groupBy(*key).agg(F.min(F.when(F.col("short"), F.col("n"))).alias("least"), F.max(F.when(~F.col("short"), F.col("n"))).alias("largest"))
        rows = rows.join(small(stored(sizes, "sizes"), REGIONS), key)
        sides = F.when(F.col("short"), F.when(F.col("n") < F.col("largest"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).when(F.col("n") > F.col("least"), F.array(F.lit(1)))
        rows = rows.withColumn("side", F.explode(sides)).withColumn("region", 2 * F.col("region") + F.col("side"))
        of_group = rows.groupBy(*key, "side", "grp").agg(F.count("*").alias("own"), F.count_if("short").alias("shorts"))
        regions = of_group.groupBy(*key, "side").agg(F.sum("own").alias("rows"), F.max("own").alias("most"), F.max_by("grp", F.struct("own", "grp")).alias("main"), F.sum("shorts").alias("shorts")).where("most < rows")
        regions = regions.withColumn("inside", F.when(F.col("side") == 1, F.col("shorts")).when((F.col("rows") > BLOCK) & (F.col("most") >= MAIN * F.col("rows")), F.col("most")).otherwise(0))
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        regions = regions.select(*key, F.when(F.col("inside") > 0, F.col("main")).alias("main"), blocks(F.col("inside")).alias("inner"), blocks(F.col("rows") - F.col("inside")).alias("outer"))
        rows = rows.join(small(stored(regions, "open"), REGIONS), key)
        inside, at = F.when(F.col("side") == 1, F.col("short")).otherwise(F.coalesce(F.col("grp") == F.col("main"), F.lit(False))), F.xxhash64("id")
        rows = rows.withColumn("block", F.when(inside, -1 - F.pmod(at, F.col("inner"))).otherwise(F.pmod(at, F.col("outer"))).cast("int"))
        rows = rows.withColumn("other", F.explode(F.when(inside, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(-F.col("inner"), F.when(F.col("side") == 1, -1).otherwise(F.col("outer") - 1)))))
        return rows.select(*key, F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "block", "id", "n", "sketch", "home", "short", "grp")

    def dense_pairs(self, dense: DataFrame, kind: type[Rows]) -> DataFrame:
        """Of dense regions, by fine sketches too: their rows are much alike."""
        key = ["element", "region", "b0", "b1"]
        ids = small(stored(dense.select("id").distinct(), "named"), BROADCAST)
        rows = self.dealt(dense).join(self.fine.join(ids, "id", "left_semi").select("id", "fine").dropDuplicates(["id"]), "id")
        rows = rows.select(*key, "block", "id", "n", "sketch", "fine", "home", "short", "grp")
        return rows.repartition(*key).sortWithinPartitions(*key).mapInPandas(_blocks(self.num, self.den, kind), "a long, b long, n int" + ", low int, more long" * (kind is Bridges))

    def settle(self, leaves: list[DataFrame], dense: DataFrame | None) -> DataFrame:
        """Compares leaves and dense regions; (id, grp) of every row that has a link.

        Of any two groups that meet in a dense region, one pair is verified first: where a
        row is alike a whole group, that mostly settles all its pairs. Of groups that it
        leaves apart, all pairs are made.
        """
        found, bridged = self.leaf_pairs(leaves).withColumns({"low": F.col("n"), "more": F.lit(0).cast("long"), "apart": F.lit(1)}), None
        if dense is not None:
            found = found.unionByName(self.dense_pairs(dense, Bridges).withColumn("apart", F.lit(0)))
        met = stored(found.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("n").alias("n"), F.min("low").alias("low"), F.sum("more").alias("more"), F.sum("apart").alias("apart")), "met")
        pairs = met.where(enough(self.num, self.den)).select("a", "b")
        if dense is not None and met.where("more > 0").limit(1).count():
            of = lambda end, g: self.placed(met.select(F.col(end).alias("id")).distinct()).select(F.col("id").alias(end), F.col("grp").alias(g))
            between = stored(met.join(of("a", "g"), "a").join(of("b", "h"), "b").withColumns({"g": F.least("g", "h"), "h": F.greatest("g", "h")}), "between")
            bridged = between.groupBy("g", "h").agg(F.sum("met").alias("met"), F.min("low").alias("n"), F.sum("more").alias("more")).where("more > 0").where(enough(self.num, self.den)).select("g", "h")
            bridged = stored(bridged, "bridged")
            pairs = pairs.unionByName(between.where("more > 0").join(bridged, ["g", "h"], "left_semi").select("a", "b"))
        self.verify(pairs)
        self.join_up()
        if bridged is not None:
            now = lambda g: self.placed(bridged.select(F.col(g).alias("id")).distinct()).select(F.col("id").alias(g), F.col("grp").alias(f"{g}_now"))
            apart = bridged.join(now("g"), "g").join(now("h"), "h").where("g_now <> h_now").select(F.explode(F.array("g_now", "h_now")).alias("grp")).distinct()
            apart = stored(apart, "apart")
            if apart.limit(1).count():
                rows = stored(self.placed(dense).join(small(apart, BROADCAST), "grp", "left_semi").select(*dense.columns), "dense")
                again = stored(self.dense_pairs(rows, Rows).groupBy("a", "b").agg(F.count("*").alias("met"), F.min("n").alias("n")), "again")
                again = again.join(met.where("apart > 0").select("a", "b", "apart"), ["a", "b"], "left").withColumn("met", F.col("met") + F.coalesce("apart", F.lit(0)))
                self.verify(again.where(enough(self.num, self.den)))
                self.join_up()
        return self.groups


def enough(num: int, den: int) -> Column:
    """Whether pairs (of smaller size n) met in as many cells (met) as similar ones do."""
    return F.col("met") >= F.least(1 + F.floor(F.col("n") / SHARED), F.ceil(F.col("n") * num / den))


def posts_of(single: DataFrame) -> DataFrame:
    """(element, row, size, short) of each element of the prefixes, the rows of an element in one partition; size is n, LARGE at most.

    Most posts meet no other. They move as two whole numbers, and what a window makes of them
    is made after that: an element is known by its upper 48 bits, and size and short take the place of
    the others (elements that share the upper bits share a cell, which adds pairs at most).
    """
    element = F.expr(f"element & ~{2 * LARGE + 1}L")
    posts = single.select("n", "short", "row", F.posexplode("prefix").alias("at", "element"))
    posts = posts.select(element.bitwiseOR(F.expr(f"if(at < short, {LARGE + 1}L, 0L) | least(n, {LARGE})")).alias("element"), "row").repartition(element)
    return posts.select(element.alias("element"), "row", F.expr(f"int(element & {LARGE})").alias("size"), F.expr(f"element & {LARGE + 1} <> 0").alias("short"))


def similar(docs: DataFrame, id_col: str, text_col: str, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) of every row: groups of documents linked by Jaccard >= num / den of their k-word shingles.

    Words are runs of anything but six white-space signs, A-Z lower-cased. A text of fewer
    than k words has its whole sequence as one shingle. Sets are of 64-bit hashes. Rows of equal
    sets are one class, whose smallest id stands for it, so copies are never paired.

    Null texts and texts without words have the empty set, are linked with nothing and
    are their own component. Rows of a null id are linked with nothing and have a null
    component. Rows that repeat an id are one document. Ids are whole numbers. Very long
    texts are whole sets, at eight bytes an element in their task. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = rows.select("text").mapInPandas(_first_prefixes(k, num, den), "lower int, n long").groupBy("lower").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    late = counted.orderBy(F.desc("n"), "lower").limit(MOST_FREQUENT).select("lower").toPandas()["lower"].to_numpy(np.int32).view(LOWER)
    frequent = spark.sparkContext.broadcast(np.sort(late))
    records = stored(mapped(rows, _records(k, num, den, frequent), "n int, short int, s1 long, s2 long, prefix array<long>, sketch binary, fine binary", "id").withColumn("row", F.monotonically_increasing_id()), "records")

    key = ["n", "s1", "s2"]
    classes = records.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    classes = small(stored(classes, "classes"), BROADCAST)
    members = records.select("id", *key).join(classes, key, "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    single = records.where("n > 0 and id is not null").join(classes, key, "left").where("rep is null or rep = id")

    # of a cell, what has nothing to meet goes: a pair needs the smaller set's short part, or both sets' where they are equal in size
    posts = posts_of(single)
    seen = posts.withColumns({name: F.expr(f"{f} over (partition by element)") for name, f in (("m", "count(*)"), ("shorts", "count_if(short)"), ("least", "min(if(short, size, null))"), ("largest", "max(if(short, null, size))"))})
    shared = seen.where(f"m > 1 and if(short, shorts > 1 or largest > size or largest = {LARGE}, least < size or size = {LARGE})").select("element", "row", "short", "m")
    cells = stored(shared.join(single.select("row", "id", "n", "sketch"), "row").select("element", F.lit(0).cast("long").alias("region"), "id", "n", "sketch", F.lit(True).alias("home"), "short", "m"), "cells")
    join = Join(rows, records, k, num, den)
    little, large = cells.where(F.col("m") <= LEAF), cells.where(F.col("m") > LEAF).drop("m")
    first = little.select("element", "id", "n", "sketch").repartition("element").sortWithinPartitions("element", F.xxhash64("id"))
    join.verify(first.withColumns({"grp": F.col("id"), "home": F.lit(True)}).mapInPandas(_stars(num, den), "a long, b long"))
    join.learn()
    leaves, dense = join.part(large)
    little = little.where("m > 2").drop("m")  # of two rows, the pair has been verified
    groups = join.settle([little, *leaves], dense).select(F.col("id").alias("rep"), F.col("grp").alias("component"))
    frequent.unpersist()
    return members.join(small(groups, BROADCAST), "rep", "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents"), "doc_id", "text", 4, 85, 100).withColumnRenamed("id", "doc_id")
