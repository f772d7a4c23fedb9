"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, release, stored

#: A token is what stands between white space, lower-cased; its words are its runs of letters.
LETTERS = re.compile(r"[^\W\d_]+")
PUNCTUATION = ".,;:!?\"'()[]{}|*-"
#: Token classes from general to special; a class's parent is the prior of the next.
PREFIXES = (3, 4, 5)
#: Most labelled rows of each label that training reads, chosen by a hash of the id.
TRAIN_ROWS = 10_000


@dataclass
class Model:
    """odds: log-odds of words and of prefixes (keys end in '*') that differ from their parent's. lam, k: of the
    extreme-value law of segment scores in clean text. a, b: logistic map of a document's evidence."""

    odds: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    lam: float = 1.0
    k: float = 0.1
    a: float = -3.0
    b: float = 1.0
    fitted: bool = False


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def words_of(token: str) -> list[str]:
    bare = token.strip(PUNCTUATION)
    return [bare] if bare.isalpha() else LETTERS.findall(bare)


def word_odds(word: str, odds: dict[str, float]) -> float:
    """The most special class that the model knows decides: the word, or its longest known prefix."""
    if (found := odds.get(word)) is not None:
        return found
    for n in reversed(PREFIXES):
        if len(word) > n and (found := odds.get(word[:n] + "*")) is not None:
            return found
    return 0.0


def token_odds(token: str, odds: dict[str, float]) -> float:
    return max([word_odds(w, odds) for w in words_of(token)], default=0.0)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) in linear time.

    Each positive run looks down the candidates for the nearest whose left sum is lower,
    jumping along the ones that were found before; it stands apart where its right sum is
    no higher than that one's, else it is merged with it and looks again. Where there is
    none, its left sum is the lowest so far and what lies before is final.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], scores > 0, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    left, right, first, last, lower = [], [], [], [], []
    final: list[tuple[float, int, int]] = []
    for a, b, x, y in zip(starts.tolist(), ends.tolist(), sums[starts].tolist(), sums[ends].tolist(), strict=True):
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= x:
                j = lower[j]
            if j < 0:
                final += [(r - l, s, e) for l, r, s, e in zip(left, right, first, last, strict=True)]
                for part in (left, right, first, last, lower):
                    part.clear()
            if j < 0 or right[j] >= y:
                for part, v in zip((left, right, first, last, lower), (x, y, a, b, j), strict=True):
                    part.append(v)
                break
            x, a = left[j], first[j]
            for part in (left, right, first, last, lower):
                del part[j:]
    return final + [(r - l, s, e) for l, r, s, e in zip(left, right, first, last, strict=True)]


def evidence(found: list[tuple[float, int, int]], n: int, model: Model) -> float:
    """Sum over segments of the surprise of their scores in n clean tokens: log of 1 over the expected number."""
    base = math.log(max(model.k * max(n, 1), 1e-9))
    return sum(e for s, _, _ in found if (e := model.lam * s - base) > 0)


class Scorer:
    """Scores texts; remembers the log-odds of words that it met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def scores(self, words: list[str]) -> np.ndarray:
        known, odds, drift = self.known, self.model.odds, self.model.drift
        if len(known) > 500_000:
            known.clear()
        try:
            return np.array([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = token_odds(w, odds) - drift
            return np.array([known[w] for w in words])

    def passages(self, text: str | None) -> tuple[float, int, list[tuple[float, int, int]]]:
        """(evidence, tokens, segments whose expected number in clean text is below one)."""
        words = tokens(text)
        found = segments(self.scores(words)) if words else []
        base = math.log(max(self.model.k * max(len(words), 1), 1e-9))
        return evidence(found, len(words), self.model), len(words), [s for s in found if self.model.lam * s[0] > base]


def contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, before, toxic): each word with the token before its own, once for each batch."""
    for part in parts:
        seen = set()
        for text, toxic in zip(part["text"], part["toxic"], strict=True):
            words = tokens(text)
            seen.update(zip(words, ["", *words], [int(toxic)] * len(words), strict=False))
        rows = {(w, zlib.crc32(before.encode()), toxic) for token, before, toxic in seen for w in words_of(token)}
        word, before, toxic = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        yield pd.DataFrame({"word": pd.Series(word, dtype=object), "before": pd.Series(before, dtype="int64"), "toxic": pd.Series(toxic, dtype="int32")})


def learn_odds(train: DataFrame, strength: float, least: int) -> dict[str, float]:
    """Log-odds of words and prefixes from (text, toxic).

    A word counts once for each word before it, so copies of a text add nothing. Each
    class's share of toxic contexts has a Dirichlet prior of the given strength, centred
    on its parent's share. Classes seen fewer than `least` times, and those whose odds are
    their parent's, are left out; so the table is bounded by the training rows, of which
    TRAIN_ROWS of each label are read at most.
    """
    met = train.mapInPandas(contexts, "word string, before long, toxic int").distinct()
    counts = stored(met.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")), "words")
    lengths = F.array([F.struct(F.lit(n).alias("level"), F.concat(F.substring("word", 1, n), F.lit("*")).alias("key"), (F.length("word") > n).alias("ok")) for n in PREFIXES])
    prefixes = counts.select(F.explode(lengths).alias("p"), "t", "n").where("p.ok").groupBy(F.col("p.key").alias("key"), F.col("p.level").alias("level")).agg(
        F.sum("t").alias("t"), F.sum("n").alias("n"))
    total = counts.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not total["t"] or total["t"] == total["n"]:
        return {}
    root = total["t"] / total["n"]
    share: dict[str, float] = {}
    odds: dict[str, float] = {}

    def add(key: str, t: int, n: int) -> None:
        word = key.rstrip("*")
        above = next((share[c] for m in reversed(PREFIXES) if m < len(word) and (c := word[:m] + "*") in share and c != key), root)
        p = (t + strength * above) / (n + strength)
        if abs(math.log(p / (1 - p)) - math.log(above / (1 - above))) >= 0.1:
            share[key] = p
            odds[key] = math.log(p / (1 - p)) - math.log(root / (1 - root))

    for r in sorted(prefixes.where(F.col("n") >= 4 * least).collect(), key=lambda r: (r["level"], r["key"])):
        add(r["key"], r["t"], r["n"])
    for r in counts.where(F.col("n") >= least).toLocalIterator():
        add(r["word"], r["t"], r["n"])
    return odds


def _maxima(model: Model):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for part in parts:
            rows = []
            for text, toxic in zip(part["text"], part["toxic"], strict=True):
                s = scorer.scores(tokens(text))
                near = np.bincount(np.clip(np.round(s * 4) + 80, 0, 160).astype(int), minlength=161) if len(s) else np.zeros(161, int)
                rows.append((int(toxic), len(s), max((x[0] for x in segments(s)), default=0.0), near.tolist()))
            yield pd.DataFrame(rows, columns=["toxic", "n", "best", "near"])

    return run


def fit(labelled: DataFrame, strength: float = 20.0, least: int = 3, drift: float = 1.0) -> Model:
    """A model from (text, toxic, fold); folds 0 and 1. Fold 0 teaches log-odds, fold 1 the two calibrations.

    lam solves sum p(s) exp(lam s) = 1 over the token scores of clean texts; k follows from
    the mean of their best segments. The logistic map is fitted to the evidence of both
    labels. Without rows of both labels the model is unfitted and scores 0.
    """
    labelled = stored(labelled, "labelled")
    odds = learn_odds(labelled.where("fold = 0").select("text", "toxic"), strength, least)
    model = Model(odds=odds, drift=drift)
    if not odds:
        return model
    rows = labelled.where("fold = 1").select("text", "toxic").mapInPandas(_maxima(model), "toxic int, n int, best double, near array<int>")
    sums = [F.sum(F.col("near")[i]).alias(f"s{i}") for i in range(161)]
    clean = rows.where("toxic = 0").agg(F.avg("best").alias("best"), F.avg(F.log(F.greatest("n", F.lit(1)))).alias("log_n"), F.count("*").alias("rows"), *sums).first()
    if clean["rows"]:
        s, p = (np.arange(161) - 80) / 4, np.array([clean[f"s{i}"] or 0 for i in range(161)], float)
        p /= max(p.sum(), 1)
        lo, hi = 1e-3, 5.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if float(p @ np.exp(np.minimum(mid * s, 500))) > 1 else (mid, hi)
        model.lam = max(lo, 0.05)
        model.k = math.exp(min(max(model.lam * clean["best"] - clean["log_n"] - 0.5772, -12), 3))
    scored = labelled.where("fold = 1").select("text", "toxic").mapInPandas(_evidence(model), "toxic int, x double")
    bins = scored.groupBy("toxic", F.round(F.least(F.sqrt("x"), F.lit(20.0)), 1).alias("x")).count().collect()
    x, y, w = (np.array([float(r[c]) for r in bins]) for c in ("x", "toxic", "count"))
    if not len(x) or y.min() == y.max():
        return model
    w = w * np.where(y == 1, 0.5 / w[y == 1].sum(), 0.5 / w[y == 0].sum())
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (w * (y - q)) - 1e-3 * beta * [0, 1]
        beta += np.linalg.solve(design.T @ (design * (w * q * (1 - q))[:, None]) + np.diag([1e-6, 1e-3]), grad)
    model.a, model.b, model.fitted = float(beta[0]), float(beta[1]), True
    return model


def _evidence(model: Model):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for part in parts:
            yield pd.DataFrame({"toxic": part["toxic"].astype("int32"), "x": [scorer.passages(t)[0] for t in part["text"]]})

    return run


def probability(x: float, model: Model) -> float:
    return 1 / (1 + math.exp(-min(max(model.a + model.b * min(math.sqrt(x), 20.0), -30), 30))) if model.fitted else 0.0


def score(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, score, evidence, n_passages, passages): of every row of docs.

    passages: start and end token and score of each significant segment. Null and empty
    texts, and texts without letters, have no passages and the score of no evidence. Very long
    texts are scanned whole, in time of their length. Ties
    and repeated rows are scored alike; the row's other columns are ignored.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        scorer = Scorer(model)
        for part in parts:
            rows = [scorer.passages(t) for t in part["text"]]
            yield pd.DataFrame({
                "id": part["id"], "score": [probability(x, model) for x, _, _ in rows], "evidence": [x for x, _, _ in rows],
                "n_passages": [len(s) for _, _, s in rows],
                "passages": [[{"start": a, "end": b, "score": float(v)} for v, a, b in s] for _, _, s in rows]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(run, f"id {kind}, score double, evidence double, n_passages int, passages array<struct<start:int,end:int,score:double>>")


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids have none."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out: Column, folds: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic, fold) of labelled rows that are not held out, at most about `most` of each label.

    A label that has more keeps those whose hash of the id is under most / rows; so the
    rows that are joined to the texts are bounded by `most`, and the labels are broadcast.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.where(~held_out)
    rows = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, most / max(rows.get(1, 0), 1)).otherwise(most / max(rows.get(0, 0), 1))
    chosen = chosen.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("fold", folds)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "toxic", "fold")


def model_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The production model: rows whose remainder is 0 or 2 teach."""
    r = remainder(F.col("id"), 3)
    return fit(training_rows(docs, read(spark, sf_dir, "labels"), "doc_id", "text", "toxic", r == 1, F.when(r == 0, 1).otherwise(0)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, "doc_id", "text", model_of(spark, docs, sf_dir))
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(remainder(F.col("id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence", "n_passages")
