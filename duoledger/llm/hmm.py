"""LM scoring with a hidden Markov model: Baum-Welch over the whole corpus, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored, words
from .dictionary import chunked, numbers_of, pack_numbers, unpack, unpack_numbers

#: Latent states; classes of rare words; share of all tokens from which a word is a class of its own (so 20,000 at most).
STATES, RARE, OWN = 8, 4096, 5e-5
#: Rounds of Baum-Welch; tokens of a training segment; tokens that are handled at once.
ROUNDS, SEGMENT, AT_ONCE = 4, 256, 400_000
#: Tokens that the base distribution counts for in each state's emissions.
PRIOR = 500.0
#: Pieces in which sums travel.
PIECES = 16
UNKNOWN, END = 0, 1


def rare_class(word: str) -> int:
    """Words that begin and end alike share a class."""
    return 2 + zlib.crc32(f"{word[:2]}|{word[-2:]}".encode("utf-8", "surrogatepass")) % RARE


@dataclass
class Emission:
    """total: training tokens, N; distinct: their kinds, V; own: classes of frequent words; mass: base probability of each class."""

    total: int
    distinct: int
    ends: int
    own: dict[str, int]
    mass: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.total + 0.5 * (self.distinct + 1))


def _train_counts(rows: pd.DataFrame) -> dict[str, int]:
    sums: dict[str, int] = {}
    for blob, train in zip(rows["words"], rows["train"], strict=True):
        for w, n in zip(unpack(blob), unpack_numbers(train).tolist(), strict=True):
            sums[w] = sums.get(w, 0) + n
    return sums


def _statistics(least: float):
    """Of a bucket of words: frequent words with their counts, and kinds and tokens of the rare classes, in pieces (number, sums)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, sums = [], np.zeros((2, 2 + RARE))
        for w, c in _train_counts(rows).items():
            if c >= least:
                out.append((w, c, -1, None))
            elif c:
                sums[:, rare_class(w)] += 1, c
        out += [(None, 0, k, x.tobytes()) for k, x in enumerate(np.array_split(sums.reshape(-1), PIECES))]
        return pd.DataFrame(out, columns=["word", "c", "piece", "sums"])

    return run


def _classed(own):
    """Of a bucket of words: for each chunk, count and class of its words."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table, sums, out = own.value, _train_counts(rows), []
        for chunk, bucket, blob in zip(rows["chunk"], rows["bucket"], rows["words"], strict=True):
            ws = unpack(blob)
            c = [sums[w] for w in ws]
            kinds = [table.get(w) or (rare_class(w) if n else UNKNOWN) for w, n in zip(ws, c, strict=True)]
            out.append((chunk, bucket, pack_numbers(np.array(c, np.int64)), pack_numbers(np.array(kinds, np.int64))))
        return pd.DataFrame(out, columns=["chunk", "bucket", "c", "classes"])

    return run


def _sequences(fields, buckets: int):
    """Documents as sequences of classes, with the parts of their scores that need the words' counts."""

    def run(docs: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        e = Emission(**fields.value)
        own_c, own_kinds = ([unpack_numbers(x) for x in tables[k]] for k in ("c", "classes"))
        c, kinds = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if own_c:
            at = np.concatenate([numbers_of(b, len(x), buckets) for b, x in zip(tables["bucket"].tolist(), own_c, strict=True)])
            c, kinds = np.zeros(int(at.max()) + 1, np.int64), np.zeros(int(at.max()) + 1, np.int64)
            c[at], kinds[at] = np.concatenate(own_c), np.concatenate(own_kinds)
        base = np.log10(e.base(c))
        within = base - np.log10(e.mass[kinds])
        end = float(np.log10(e.base(np.array([e.ends]))[0]))
        end_within = end - float(np.log10(e.mass[END]))
        out = []
        for ids, counts, weights, blob in zip(docs["ids"], docs["counts"], docs["weights"], docs["words"], strict=True):
            numbers, b = unpack_numbers(blob) if sum(counts) else np.zeros(0, np.int64), 0
            for id_, n, weight in zip(ids, counts, weights, strict=True):
                own, b = numbers[b : b + n], b + n
                out.append((id_, weight, n + 1, int((c[own] > 0).sum()) + (e.ends > 0), float(base[own].sum()) + end, float(within[own].sum()) + end_within, pack_numbers(np.append(kinds[own], END))))
        return pd.DataFrame(out, columns=["id", "weight", "n_tokens", "n_known", "base_score", "within", "classes"])

    return run


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """start: at a document's start and at a later segment's; move: between states; emit: classes x states."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(mass: np.ndarray) -> Model:
    """The base distribution, moved apart at random (of a fixed seed) for each state, which mostly follow themselves."""
    rng = np.random.default_rng(1)
    emit = mass[:, None] * np.exp(rng.normal(0, 0.5, (len(mass), STATES)))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full((2, STATES), 1 / STATES), move, emit / emit.sum(0))


def batches(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Indices of sequences, long ones first, AT_ONCE tokens at a time."""
    order, own, size = sorted(range(len(sequences)), key=lambda i: (-len(sequences[i]), i)), [], 0
    for i in order:
        own.append(i)
        size += len(sequences[i])
        if size >= AT_ONCE:
            yield own
            own, size = [], 0
    if own:
        yield own


def forward(model: Model, sequences: list[np.ndarray], later: np.ndarray, keep: bool = False):
    """Natural log-likelihoods of sequences in order of falling length; with keep also states, scales and steps, for the backward pass."""
    lengths = np.array([len(s) for s in sequences])
    flat = np.concatenate(sequences)
    starts = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    log, states, scales = np.zeros(len(lengths)), [], []
    a = None
    for t in range(int(lengths[0])):
        n = int(active[t])
        a = (model.start[later] if t == 0 else a[:n] @ model.move) * model.emit[flat[starts[:n] + t]]
        scale = a.sum(1)
        a /= scale[:, None]
        log[:n] += np.log(scale)
        if keep:
            states.append(a)
            scales.append(scale)
    return (log, states, scales, flat, starts, active) if keep else log


def expected(model: Model, sequences: list[np.ndarray], later: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood and expected counts of starts, moves and emissions."""
    log, states, scales, flat, starts, active = forward(model, sequences, later, True)
    start, move = np.zeros_like(model.start), np.zeros_like(model.move)
    gamma = np.zeros((len(flat), STATES))
    b = np.ones((0, STATES))
    for t in range(len(states) - 1, -1, -1):
        n, a = int(active[t]), states[t]
        full = np.ones((n, STATES))
        if t + 1 < len(states):
            m = int(active[t + 1])
            g = model.emit[flat[starts[:m] + t + 1]] * b / scales[t + 1][:, None]
            move += a[:m].T @ g
            full[:m] = g @ model.move.T
        b = full
        gamma[starts[:n] + t] = a * b
    for k in (0, 1):
        start[k] = gamma[starts[later == k]].sum(0)
    emit = np.stack([np.bincount(flat, gamma[:, k], len(model.emit)) for k in range(STATES)], 1)
    return float(log.sum()), start, move * model.move, emit


def _round(fields, pieces: int):
    """Expected counts of the task's sequences, in pieces (number, sums)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(**fields.value)
        sums = np.zeros(1 + model.start.size + model.move.size + model.emit.size)
        for part in parts:
            own, later = [], []
            for blob in part["classes"]:
                s = unpack_numbers(blob)
                for i in range(0, len(s), SEGMENT):
                    own.append(s[i : i + SEGMENT])
                    later.append(int(i > 0))
            later = np.array(later)
            for some in batches(own):
                log, *counts = expected(model, [own[i] for i in some], later[some])
                sums += np.concatenate([[log], *[c.reshape(-1) for c in counts]])
        yield pd.DataFrame({"piece": range(pieces), "sums": [x.tobytes() for x in np.array_split(sums, pieces)]})

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "sums": [np.sum([np.frombuffer(b) for b in rows["sums"]], 0).tobytes()]})


def train(sequences: DataFrame, model: Model, mass: np.ndarray) -> Model:
    """Baum-Welch over all training sequences, cut in segments of SEGMENT tokens; counts are summed across tasks.

    Emission counts have the base distribution as a prior. Training texts hold no unknown
    words, so these keep their base probability in every state.
    """
    spark, pieces = sequences.sparkSession, PIECES
    for _ in range(ROUNDS):
        fields = spark.sparkContext.broadcast(vars(model))
        found = sequences.mapInPandas(_round(fields, pieces), "piece int, sums binary").groupBy("piece").applyInPandas(_summed, "piece int, sums binary").orderBy("piece").collect()
        if not found:
            return model
        sums = np.concatenate([np.frombuffer(r["sums"]) for r in found])[1:]
        start, move, emit = np.split(sums, [model.start.size, model.start.size + model.move.size])
        start, move, emit = start.reshape(model.start.shape) + 1, move.reshape(model.move.shape) + 1, emit.reshape(model.emit.shape) + PRIOR * mass[:, None]
        emit[UNKNOWN] = 0
        emit *= (1 - mass[UNKNOWN]) / emit.sum(0)
        emit[UNKNOWN] = mass[UNKNOWN]
        model = Model(start / start.sum(1, keepdims=True), move / move.sum(1, keepdims=True), emit)
    return model


def _scores(fields):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(**fields.value)
        for part in parts:
            own = [unpack_numbers(b) for b in part["classes"]]
            log = np.zeros(len(own))
            for some in batches(own):
                log[some] = forward(model, [own[i] for i in some], np.zeros(len(some), int))
            yield part.drop(columns=["classes", "within"]).assign(score=part["within"] + log / np.log(10))

    return run


def score(docs: DataFrame, id_col: str, text_col: str, weight) -> DataFrame:
    """(id, weight, n_tokens, n_known, train_tokens, base_score, score) of every row; rows of weight 1 teach.

    Tokens are words, A-Z lower-cased, and an end. Counts of words come from a distinct-word
    table over all training rows. Words of at least OWN of all tokens are classes of their
    own, others share classes by their first and last letters, words never seen are one class. The
    model is a chain of latent states that emit classes; a class emits its words by their
    base probabilities. score is log10 of the probability of the whole text: exact, by the
    scaled forward recursion over its classes.

    Null and empty texts are the end alone. Without training rows all words are unknown.
    Null ids and repeated rows are kept. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("weight", weight)
    kind = dict(rows.dtypes)["id"]
    chunks = chunked(rows, lambda: words, buckets)
    own = chunks.where("bucket < 0").select("chunk", "ids", "counts", "weights", "words")
    dictionaries = chunks.where("bucket >= 0").select("bucket", "chunk", "words", "train").groupBy("bucket")
    sums = own.select(F.explode(F.arrays_zip("counts", "weights")).alias("d")).where("d.weights = 1").agg(F.sum("d.counts").alias("tokens"), F.count("*").alias("ends")).first()
    total, ends = (sums["tokens"] or 0) + sums["ends"], sums["ends"]
    found = stored(dictionaries.applyInPandas(_statistics(max(OWN * total, 1)), "word string, c long, piece int, sums binary"), "statistics")
    frequent = found.where("piece = -1").orderBy("word").collect()
    rare = found.where("piece >= 0").select("piece", "sums").groupBy("piece").applyInPandas(_summed, "piece int, sums binary").orderBy("piece").collect()
    kinds, tokens = np.concatenate([np.frombuffer(r["sums"]) for r in rare]).reshape(2, -1) if rare else np.zeros((2, 2 + RARE))
    table = {r["word"]: 2 + RARE + i for i, r in enumerate(frequent)}
    distinct = len(frequent) + int(kinds.sum()) + (ends > 0)
    emission = Emission(total, distinct, ends, {}, np.zeros(2 + RARE + len(frequent)))
    mass = emission.mass
    mass[: 2 + RARE] = tokens + 0.5 * kinds
    mass[2 + RARE :] = [r["c"] + 0.5 for r in frequent]
    mass[[UNKNOWN, END]] = 0.5, ends + 0.5
    mass /= total + 0.5 * (distinct + 1)
    fields = spark.sparkContext.broadcast(vars(emission))
    classed = dictionaries.applyInPandas(_classed(spark.sparkContext.broadcast(table)), "chunk string, bucket int, c binary, classes binary")
    sequences = stored(own.groupBy("chunk").cogroup(classed.groupBy("chunk")).applyInPandas(
        _sequences(fields, buckets), f"id {kind}, weight int, n_tokens long, n_known long, base_score double, within double, classes binary"), "sequences")
    model = train(sequences.where("weight = 1").select("classes"), first_model(mass / mass.sum()), mass / mass.sum())
    scored = sequences.mapInPandas(_scores(spark.sparkContext.broadcast(vars(model))), f"id {kind}, weight int, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scored = score(read(spark, sf_dir, "documents"), "doc_id", "text", F.when(held, 0).otherwise(1))
    return scored.select(F.col("id").alias("doc_id"), (F.col("weight") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
