"""BPE encoding and decoding through a distinct-word table."""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, release
from .dictionary import chunked, numbers_of, pack_numbers, unpack, unpack_numbers

#: The vocabulary's own split, with the white space of Unicode spelled out.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


@dataclass
class Vocabulary:
    """From a tokenizer file: ranks of merges, ids of pieces, pieces of ids, and special strings. Its size is the file's."""

    ranks: dict[tuple[str, str], int]
    ids: dict[str, int]
    pieces: dict[int, str]
    special: list[str]
    end: str


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model = found["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in found["added_tokens"]}
    ids = model["vocab"] | special
    return Vocabulary({m: i for i, m in enumerate(merges)}, ids, {i: p for p, i in ids.items()}, sorted(special, key=len, reverse=True), model.get("end_of_word_suffix") or "")


def byte_signs() -> list[str]:
    """A printable sign for each byte: printable Latin-1 stands for itself, the rest follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Splitter:
    """Words of a text as the vocabulary splits it; special strings stand alone, with a space before."""

    def __init__(self, special: list[str]):
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.special is None or "<" not in text or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a sign is lower-cased by itself, whatever follows
        return self.split.findall(text.lower())


def merged(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Parts after all merges; pairs wait in a heap, and neighbours are linked, so n parts take n log n steps."""
    n = len(parts)
    waiting = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(p)) is not None]
    heapq.heapify(waiting)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while waiting:
        _, i, pair = heapq.heappop(waiting)
        j = after[i]
        if j >= n or parts[i] != pair[0] or parts[j] != pair[1]:
            continue  # one of the two was merged meanwhile
        parts[i], parts[j], after[i] = pair[0] + pair[1], "", after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get(p := (parts[k], parts[after[k]]))) is not None:
                heapq.heappush(waiting, (r, k, p))
    return [p for p in parts if p]


def encode_word(word: str, vocabulary: Vocabulary, signs: list[str]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost first, until none has one."""
    if word.startswith(" "):
        return [vocabulary.ids[word[1:]]]
    parts = [signs[b] for b in word.encode("utf-8", "surrogatepass")]
    parts[-1] += vocabulary.end
    parts = merged(parts, vocabulary.ranks)
    return [i for p in parts if (i := vocabulary.ids.get(p)) is not None]


def _encoded(fields):
    """Of one bucket of words, from all chunks: every distinct word is encoded once; its ids go back to each chunk."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        release()  # of what earlier groups held
        v, signs, done, out = Vocabulary(**fields.value), byte_signs(), {}, []
        for chunk, bucket, blob in zip(rows["chunk"], rows["bucket"], rows["words"], strict=True):
            flat, lengths = [], []
            for w in unpack(blob):
                if w not in done:
                    done[w] = encode_word(w, v, signs)
                flat += done[w]
                lengths.append(len(done[w]))
            out.append((chunk, bucket, pack_numbers(np.array(lengths, np.int64)), pack_numbers(np.array(flat, np.int64))))
        return pd.DataFrame(out, columns=["chunk", "bucket", "lengths", "flat"])

    return run


def _joined(shown_as, buckets: int):
    """The ids of each document by the numbers of its words; the text that they decode to by the pieces of the ids."""

    def run(docs: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        release()
        pieces = shown_as.value
        lengths = [unpack_numbers(x) for x in tables["lengths"]]
        at = [numbers_of(b, len(x), buckets) for b, x in zip(tables["bucket"].tolist(), lengths, strict=True)]
        flat = [unpack_numbers(x) for x in tables["flat"]]
        if at:
            at, lengths, flat = np.concatenate(at), np.concatenate(lengths), np.concatenate(flat).astype(np.int32)
            ends = np.cumsum(lengths)
            most = int(at.max()) + 1
            starts, n, texts = np.zeros(most, np.int64), np.zeros(most, np.int64), [""] * most
            starts[at], n[at] = ends - lengths, lengths
            shown = [pieces[i] for i in flat.tolist()]
            for i, a, b in zip(at.tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                texts[i] = shown[a] if b == a + 1 else " ".join(shown[a:b])
        all_ids, ids, decoded = [], [], []
        for own_ids, counts, blob in zip(docs["ids"], docs["counts"], docs["words"], strict=True):
            all_ids += list(own_ids)
            if not sum(counts):
                ids += [np.zeros(0, np.int32)] * len(counts)
                decoded += [""] * len(counts)
                continue
            words = unpack_numbers(blob)
            own = n[words]
            first = np.repeat(starts[words] - (np.cumsum(own) - own), own)
            found = flat[first + np.arange(own.sum())]
            stops = np.cumsum(counts)
            ids += np.split(found, np.concatenate([[0], np.cumsum(own)])[stops[:-1]])
            numbers = words.tolist()
            decoded += [" ".join([texts[i] for i in numbers[b - c : b]]) for b, c in zip(stops.tolist(), counts, strict=True)]
        return pd.DataFrame({"id": pd.Series(all_ids, dtype=object), "ids": ids, "decoded": decoded})

    return run


def encode(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, ids, decoded) of every row of docs; path: of the tokenizer file.

    Texts are split in their own tasks, and rows are gathered in chunks of about CHUNK
    characters that share a dictionary. The dictionaries' words are dealt by hash, so that
    each distinct word of the corpus is encoded in one place and once; its ids and their
    pieces (an id-to-piece table of the vocabulary's size) return to the chunks, and join
    the documents by the numbers of their words. Documents move as compressed numbers.

    Null and empty texts have no ids and decode to "". Null ids and repeated rows are
    kept. Very long texts are one row of a chunk; a word of n letters takes n log n steps. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = load(path)
    fields = spark.sparkContext.broadcast(vars(vocabulary))
    pieces = spark.sparkContext.broadcast(vocabulary.pieces)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    special = vocabulary.special
    chunks = chunked(rows.withColumn("weight", F.lit(0)), lambda: Splitter(special).words, buckets)
    tables = chunks.where("bucket >= 0").select("bucket", "chunk", "words").groupBy("bucket").applyInPandas(
        _encoded(fields), "chunk string, bucket int, lengths binary, flat binary")
    own = chunks.where("bucket < 0").select("chunk", "ids", "counts", "words")
    return own.groupBy("chunk").cogroup(tables.groupBy("chunk")).applyInPandas(_joined(pieces, buckets), f"id {kind}, ids array<int>, decoded string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode(read(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
