"""Cutting texts, coding vectors and counting tokens: brute force, round trips and odd rows."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duoledger.llm import codes, common, counts, infill, jaccard

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "char": r"(?s:.)"}
LONG = "lorem ipsum\n dolor " * 30_000
TEXTS = [None, "", "\n", "one", "one\ntwo\n\n\nthree", "\n\nüber\n naïve 😀 x\r\n", "with <P> inside\nx", "<S", "a<M\n>b\n", "two\nlines", "two\nlines", LONG]
OTHERS = ["id", "n", "digest", "copies", "key", "form", "h1", "batch", "code", "vec"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, "no\nid"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in OTHERS})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="a\n \t<P😀é", max_size=12), max_size=6), st.sampled_from(list(UNITS)), st.integers(0, 1 << 31))
def test_offsets_are_those_of_the_pattern(texts, unit, draw):
    runs = infill.Runs.of(texts, unit)
    found = [re.findall(UNITS[unit], t) for t in texts]
    assert runs.units.tolist() == [len(f) for f in found]
    cut = draw % (runs.units + 1)
    assert runs.offsets(cut).tolist() == [sum(map(len, f[:c])) for f, c in zip(found, cut.tolist(), strict=True)]


@pytest.mark.parametrize(("unit", "rate", "markers"), [("line", 100, infill.MARKERS), ("word", 60, infill.MARKERS), ("char", 100, ("<pre>", "<suf>", "<mid>"))])
def test_fill_in_middle(odd, unit, rate, markers):
    done = infill.fill_in_middle(odd, "doc_id", "text", unit=unit, rate=rate, markers=markers)
    rows = done.withColumn("back", infill.restored(F.col("output"), F.col("form"), markers)).collect()
    assert len(rows) == 15 and infill.fill_in_middle(odd.where("false"), "doc_id", "text").count() == 0
    p, s, m = markers
    for r in rows:
        texts = {"no\nid", ""} if r.id is None else {TEXTS[r.id] or ""}
        assert r.back in texts
        text, parts = r.back, re.findall(UNITS[unit], r.back)
        digest = hashlib.sha256(f"7:{'' if r.id is None else r.id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(parts) + 1) for x in h[:2])
        form = "plain" if not text or any(x in text for x in markers) or h[2] % 100 >= rate else "spm" if h[3] % 100 < 50 else "psm"
        head, mid, tail = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
        assert (r.n, r.form) == (len(parts), form)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(head), len(mid)))
        assert r.output == {"plain": text, "psm": p + head + s + tail + m + mid, "spm": s + tail + p + head + m + mid}[form]


def test_large_ids_beside_a_null_one_stay_whole(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "a b c d e f"), (None, "x"), (big + 1, "a b c d e f")], "doc_id long, text string").coalesce(1)
    assert {r.id for r in infill.fill_in_middle(docs, "doc_id", "text").collect()} == {big, big + 1, None}
    assert {(r.id, r.component_id) for r in jaccard.similar(docs, "doc_id", "text").collect()} == {(big, big), (big + 1, big), (None, None)}
    vectors = docs.select("doc_id", F.array(F.lit(1.0)).alias("v"), F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).alias("label"))
    assert {(r.id, r.label) for r in codes.compress(vectors, "doc_id", "v", "label").collect()} == {(big, big), (big + 1, big + 1), (None, None)}


def test_markers_that_cannot_be_told_are_refused(odd):
    for markers in [("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "ba", "<M>")]:
        with pytest.raises(ValueError, match="markers"):
            infill.fill_in_middle(odd, "doc_id", "text", markers=markers)


def plain_codes(vectors, parts, entries, rounds):
    """The codebooks, and entry and distance of each part, in plain whole numbers."""
    width = -(-max(map(len, vectors)) // parts)
    x = [[math.floor(4096 * float(np.float32(c))) for c in v] + [0] * (parts * width - len(v)) for v in vectors]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    books = [[cut[i][p] for i in range(min(entries, len(x)))] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for k in range(rounds + 1):
        best = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [v[p] for v, b in zip(cut, best, strict=True) if b[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return books, best


def test_codes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.3, (150, 24)).astype(np.float32)
    v[40:60] = v[3]
    v[70] *= 1000
    label = [None if i % 5 == 0 else i % 3 for i in range(150)]
    rows = [(i, x, label[i]) for i, x in enumerate(v.tolist())] + [(900, None, 0), (901, [None] + [1.0] * 23, 0), (902, [float("inf")] * 24, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "vec", "size", "key", "copies", "code", "error")}).repartition(3)
    books, best = plain_codes(v.tolist(), 8, 16, 6)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = [sum(d for d, _ in b) for b in best]
    for few in (common.FEW, 1):  # with one row of a table to broadcast at most, labels are joined by shuffle, hot ones apart
        monkeypatch.setattr(common, "FEW", few)
        monkeypatch.setattr(common, "HOT", 40)
        got = {r.id: r for r in codes.compress(table, "vec_id", "embedding", "label").collect()}
        assert sorted(got) == list(range(150))
        for i, r in got.items():
            assert r.code == "".join(f"{e:02x}" for _, e in best[i]) and r.error == errors[i] and r.codebooks_sha256 == sha
            assert r.label_error == sum(e for e, x in zip(errors, label, strict=True) if x == label[i])


def test_codes_of_odd_vectors(spark):
    rows = [(1, [], 0), (None, [1.0, 2.0, 3.0], None), (2, [1e30, -1e30, 0.5], None), (2, [0.25], 1), (2, [0.25], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = codes.compress(table, "vec_id", "embedding", "label", parts=2, entries=3, rounds=2).collect()
    assert sorted((r.id is None, r.id) for r in got) == [(False, 1), (False, 2), (False, 2), (False, 2), (True, None)] and all(len(r.code) == 4 and r.error >= 0 for r in got)
    assert codes.compress(table.where("false"), "vec_id", "embedding", "label").count() == 0
    none = codes.compress(table.where("size(embedding) = 0"), "vec_id", "embedding", "label").collect()
    assert [(r.code, r.error, r.label_error) for r in none] == [("00" * 8, 0, 0)]


def test_bounds_enclose_distances_and_spare_work():
    rng = np.random.default_rng(6)
    books = rng.integers(-4000, 4000, (64, 8))
    x = np.concatenate([books[rng.integers(0, 64, 400)] + rng.integers(-300, 300, (400, 8)), rng.integers(-9000, 9000, (100, 8)), books[:5]])
    entry, distance, refined = codes.Cells(books).nearest(x)
    exact = ((x[:, None] - books[None]) ** 2).sum(2)
    assert entry.tolist() == exact.argmin(1).tolist() and distance.tolist() == exact.min(1).tolist()
    assert refined < 0.25 * exact.size
    tied = codes.Cells(np.array([[5, 5], [1, 1], [5, 5], [1, 9]])).nearest(np.array([[5, 5], [1, 5], [3, 3]]))
    assert tied[0].tolist() == [0, 0, 0]


def plain_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, tmp_path, monkeypatch, name):
    texts = [*TEXTS, "<|endoftext|> and <s>", "a  b   c　​", "x" * 5000, *(f"w{i} " * 40 for i in range(40))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "copy of one") for i in range(300)] + [(None, "copy of one"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in OTHERS}).repartition(5)
    path, want = public_tokenizers.path(name), plain_counts(name, [t for _, t in rows])

    def check(cache):
        got = counts.count_tokens(docs, "doc_id", "text", path, cache=str(cache)).collect()
        assert sorted((str(r.id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, want, strict=True))

    check(tmp_path / "one")
    monkeypatch.setattr(counts, "BROADCAST", 1)  # the other way: all that is missing moves
    monkeypatch.setattr(common, "FEW", 1)
    monkeypatch.setattr(common, "HOT", 100)
    check(tmp_path / "two")
    assert counts.count_tokens(docs.where("false"), "doc_id", "text", path, cache=str(tmp_path / "three")).count() == 0


def test_the_cache_spares_what_is_known(spark, tmp_path):
    """Stored counts are taken as they are; only what is missing is encoded, once, and appended; another tokenizer has its own."""
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    home = f"{cache}/tokenizer={counts.version('json', open(path, 'rb').read())}"
    stored = spark.createDataFrame([("known text",)], "t string").select(F.unhex(F.sha2("t", 256)).alias("digest"), F.lit(12345).cast("long").alias("n_tokens"))
    stored.write.parquet(f"{home}/batch=a")
    stored.write.parquet(f"{home}/batch=b")
    docs = spark.createDataFrame([(1, "known text"), (2, "new text"), (3, "new text"), (4, "Known Text")], "doc_id long, text string")
    run = lambda **more: {r.id: r.n_tokens for r in counts.count_tokens(docs, "doc_id", "text", path, cache=cache, **more).collect()}
    assert run() == {1: 12345, 2: 2, 3: 2, 4: 2}
    assert counts.cached(spark, home).count() == 3 and spark.read.parquet(home).count() == 4
    batches = lambda: {f.name for f in (tmp_path / "cache").glob("*/batch=*")}
    before = batches()
    assert run() == {1: 12345, 2: 2, 3: 2, 4: 2} and batches() == before
    assert run(normalise=F.lower) == {1: 12345, 2: 2, 3: 2, 4: 12345} and batches() == before
    other = {r.id: r.n_tokens for r in counts.count_tokens(docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"), cache=cache).collect()}
    assert other[1] == plain_counts("piece_bpe_32k.model", ["known text"])[0]
