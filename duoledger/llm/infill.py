"""Fill-in-middle transformation: texts are cut at units found through run-length encoded character classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, mapped, read, release

#: What a run of a class does to the count of units: nothing, closes one at its end, closes one at each of its characters.
OPEN, ONCE, EACH = 0, 1, 2
#: The six characters of white space that part words.
SPACE = np.array([9, 10, 11, 12, 13, 32], np.uint32)
MARKERS = ("<P>", "<S>", "<M>")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """OPEN, ONCE or EACH of every code point.

    line: a line ends with its line feed. word: a word takes the white space before it.
    char: every code point is a unit. What is open at the end of a text is a unit too.
    """
    if unit == "line":
        return np.where(points == 10, EACH, OPEN).astype(np.int8)
    if unit == "word":
        return np.where(np.isin(points, SPACE), OPEN, ONCE).astype(np.int8)
    if unit == "char":
        return np.full(len(points), EACH, np.int8)
    raise ValueError(f"unknown unit {unit!r}")


@dataclass
class Runs:
    """Maximal runs of one class over texts that lie behind each other: where each starts and ends, its class, and the units closed by its end, of all texts so far."""

    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    closed: np.ndarray
    first: np.ndarray  # code point at which each text starts
    before: np.ndarray  # units closed before each text
    units: np.ndarray  # units of each text

    @classmethod
    def of(cls, texts: list[str], unit: str) -> Runs:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        last = np.cumsum(size)
        kinds = classes(points, unit)
        some = size > 0
        start = np.union1d(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, (last - size)[some]).astype(np.int64)
        end = np.append(start[1:], len(points))[: len(start)]
        kind = kinds[start].astype(np.int64)
        kind[np.searchsorted(end, last[some])] += kind[np.searchsorted(end, last[some])] == OPEN  # the rest of a text
        closed = np.cumsum(np.where(kind == EACH, end - start, kind))
        total = np.concatenate([[0], closed])[np.searchsorted(end, last, "right")]
        before = np.concatenate([[0], total])[:-1]
        return cls(start, end, kind, closed, last - size, before, total - before)

    def offsets(self, cut: np.ndarray) -> np.ndarray:
        """Code points before the end of the cut-th unit of each text: the run that closes it is found by bisection, the place in it by subtraction."""
        if not len(self.start):
            return np.zeros(len(cut), np.int64)
        sought = self.before + cut
        run = np.minimum(np.searchsorted(self.closed, sought), len(self.closed) - 1)
        inside = self.end[run] - np.where(self.kind[run] == EACH, self.closed[run] - sought, 0)
        return np.where(cut == 0, 0, inside - self.first)


def _cut(unit: str, markers: tuple[str, str, str], rate: int, spm: int):
    """(id, n, form, prefix_chars, middle_chars, output) of rows (id, text, h1 to h4)."""
    p, s, m = markers

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for part in parts:
            texts = part["text"].tolist()
            runs = Runs.of(texts, unit)
            cuts = np.stack([part[h].to_numpy() % (runs.units + 1) for h in ("h1", "h2")])
            a, b = runs.offsets(cuts.min(0)), runs.offsets(cuts.max(0))
            changed = (part["h3"].to_numpy() % 100 < rate) & np.array([bool(t) and p not in t and s not in t and m not in t for t in texts], bool)
            form = np.where(~changed, "plain", np.where(part["h4"].to_numpy() % 100 < spm, "spm", "psm"))
            out = []
            for t, f, i, j in zip(texts, form.tolist(), a.tolist(), b.tolist(), strict=True):
                out.append(t if f == "plain" else p + t[:i] + s + t[j:] + m + t[i:j] if f == "psm" else s + t[j:] + p + t[:i] + m + t[i:j])
            yield pd.DataFrame({
                "id": part["id"], "n": runs.units, "form": form, "prefix_chars": pd.array(np.where(changed, a, -1), "Int64"), "middle_chars": pd.array(np.where(changed, b - a, -1), "Int64"), "output": out,
            }).assign(prefix_chars=lambda x: x["prefix_chars"].mask(~changed), middle_chars=lambda x: x["middle_chars"].mask(~changed))

    return run


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of; the markers' first places part it."""
    p, s, m = markers
    head = F.substring_index(output, m, 1)
    middle = F.substr(output, F.length(head) + len(m) + 1)

    def two(first: str, second: str) -> tuple[Column, Column]:
        left = F.substring_index(head, second, 1)
        return F.substr(left, F.lit(len(first) + 1)), F.substr(head, F.length(left) + len(second) + 1)

    prefix, suffix = two(p, s)
    back, front = two(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(front, middle, back)).otherwise(output)


def _tellable(markers: tuple[str, str, str]) -> None:
    """Markers must be found again wherever they stand between texts that hold none of them."""
    for a in markers:
        for b in markers:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError("markers must not be empty, lie in each other, or start as one ends")


def fill_in_middle(docs: DataFrame, id_col: str, text_col: str, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: its text cut at two units into prefix, middle and suffix, the middle put last.

    n counts the text's units (line, word or char, see `classes`). Two cuts, the form
    (psm: prefix first; spm: suffix first, in `spm` of 100) and whether a text is changed
    at all (`rate` of 100) rest on the digest of seed and id alone. A text is
    encoded as runs of character classes, with counts of units; a cut is found by
    bisection over the runs. Rows never move between tasks.

    Null and empty texts, and those that hold a marker, stay plain: their output is the
    text ("" for null), their numbers of characters are null. A null id is drawn like an
    empty one. Repeated rows give equal rows. Very long texts are cut whole, at four bytes a
    character and a few more for each run. An empty table gives no rows. Other columns are
    ignored.
    """
    _tellable(markers)
    bounded(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])
    return mapped(rows, _cut(unit, markers, rate, spm), "n long, form string, prefix_chars long, middle_chars long, output string", "id")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(read(spark, sf_dir, "documents"), "doc_id", "text")
    return done.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
