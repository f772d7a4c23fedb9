"""Token counts through a cache of digests: only texts that no earlier run has met are encoded, each of them once."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, looked_up, read, release, shared_dir, small, stored

#: Characters that are encoded together.
TOGETHER = 200_000
#: Digests up to which a list of them is broadcast.
BROADCAST = 1_000_000
CACHED = "digest binary, n_tokens long"


def version(kind: str, content: bytes) -> str:
    """Digest of a tokenizer: its file and the library that reads it."""
    if kind == "model":
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(b"|".join([library.__name__.encode(), library.__version__.encode(), b"no begin, no end", content])).hexdigest()


#: The tokenizer that a worker has open, by its digest.
_OPEN: dict[str, Callable[[list[str]], list[int]]] = {}


def _counter_of(kind: str, broadcast) -> Callable[[list[str]], list[int]]:
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=broadcast.value)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    import tokenizers

    own = tokenizers.Tokenizer.from_buffer(broadcast.value)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]


def _encoded(kind: str, digest: str, broadcast):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        if digest not in _OPEN:
            _OPEN.clear()
            _OPEN[digest] = _counter_of(kind, broadcast)
        count = _OPEN[digest]
        for part in parts:
            texts, found = part["text"].tolist(), []
            groups = np.cumsum([len(t) for t in texts]) // TOGETHER
            for cut in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(groups)) + 1):
                found += count([texts[i] for i in cut])
            yield pd.DataFrame({"digest": part["digest"], "n_tokens": np.array(found, np.int64)})

    return run


def cached(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n_tokens) of all batches under path, each digest once. A digest has one count, so it doesn't matter whose batch is read."""
    spark.createDataFrame([], CACHED).write.mode("ignore").parquet(f"{path}/batch=none")
    return spark.read.schema(CACHED).parquet(path).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, id_col: str, text_col: str, path: str, cache: str | None = None, normalise: Callable[[Column], Column] = lambda c: c, limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; path: of a tokenizer file (.json or .model); cache: folder of the counts.

    Contents (normalised, null as empty) are known by their SHA-256, tokenizers by that of
    their file and library. Digests join the stored counts; what is missing is encoded once
    for each different content and appended as a batch of its own, so jobs that run side by
    side or die leave whole, true entries behind. Texts that stand once are encoded where
    they are read; only those that repeat, or, where digests to leave out are too many to
    broadcast, all that are missing, move. Where all is known, no text is encoded and texts
    are read for their digests alone.

    Null and empty texts have 0 bytes and the count of nothing (0). Null ids and repeated rows are kept.
    Texts are encoded whole, however long; a task holds what it encodes together
    (200,000 characters, or one text). An empty table gives no rows and appends nothing. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    bounded(spark)
    kind = path.rsplit(".", 1)[-1]
    with open(path, "rb") as f:
        content = f.read()
    own = version(kind, content)
    home = f"{(cache or shared_dir(spark).rstrip('/') + '/duoledger/token-counts').rstrip('/')}/tokenizer={own}"

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw")).select("id", "raw", F.coalesce(normalise(F.col("raw")), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = stored(texts.select("id", "digest", F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long").alias("n_bytes")), "digests")
    known = cached(spark, home)
    found = stored(rows.groupBy("digest").agg(F.count("*").alias("copies")).join(known, "digest", "left"), "found")
    missing = found.where("n_tokens is null").select("digest", "copies")
    if missing.limit(1).count():
        broadcast = spark.sparkContext.broadcast(content)
        texts = texts.select("digest", "text")
        leave = found.where("n_tokens is not null or copies > 1").select("digest")
        if leave.limit(BROADCAST + 1).count() <= BROADCAST:
            once = texts.join(F.broadcast(leave), "digest", "left_anti")
            again = texts.join(F.broadcast(missing.where("copies > 1").select("digest")), "digest", "left_semi").dropDuplicates(["digest"])
            fresh = once.unionByName(again)
        else:
            fresh = texts.dropDuplicates(["digest"]).join(small(missing.select("digest"), BROADCAST), "digest", "left_semi")
        batch = f"{home}/batch={uuid.uuid4().hex}"
        fresh.mapInPandas(_encoded(kind, own, broadcast), CACHED).write.parquet(batch)
        broadcast.destroy()
        fresh = spark.read.schema(CACHED).parquet(batch)
        found = found.where("n_tokens is not null").unionByName(missing.join(fresh, "digest"))
    return looked_up(rows, found, "digest").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
