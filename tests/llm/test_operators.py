"""The operators over small tables: odd rows have their stated results, and the rest equals brute force."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from duoledger.llm import bpe, common, hmm, jaccard, langid, mixing, neighbours, sharding, toxicity, webp, wrappers

LONG = "lorem ipsum dolor " * 30_000
TEXTS = [None, "", "   ", "one", "One two three", "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog", "<|endoftext|> don't", "über Straße naïve", LONG]
#: Other columns have the names that operators use inside.
OTHERS = ["id", "n", "size", "chunk", "words", "shard", "component", "row", "cell", "weight"]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "a", "b"][i % 3], [None, "en", "xx"][i % 3]) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "b", "en"), (None, "one two", None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in OTHERS})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_sharding(spark, odd, none):
    rows = sharding.shard(odd, "doc_id", "text", 4).collect()
    assert len(rows) == 12 and {r.shard for r in rows} <= set(range(4)) and sharding.shard(none, "doc_id", "text").count() == 0
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.size for r in rows if r.id in (0, 1)} == {1} and {r.text_crc32 for r in rows if r.id == 0} == {0}
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    loads = [r.b for r in sharding.shard(many, "doc_id", "text").groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) <= 1.01 * sum(loads) / 16 and min(loads) >= 0.97 * sum(loads) / 16


def test_a_further_shard_moves_little(spark):
    """The ring against a plain walk; without bounds, cells move to the new shard alone, a seventeenth of them; with bounds, few others."""
    rings = {n: [(p, a) for r in sharding.ring(spark, n, 64).collect() for p, a in zip(r.vpos, r.after, strict=True)] for n in (16, 17)}
    nodes = dict((p, a[0]) for p, a in rings[17])
    assert [(p, a[0]) for p, a in rings[16]] == [(p, s) for p, s in nodes.items() if s != 16] and len(nodes) == 17 * 64
    for k, (_, after) in enumerate(rings[16][:50]):
        plain = []
        for _, a in rings[16][k:] + rings[16][:k]:
            plain += [a[0]] * (a[0] not in plain)
        assert list(after) == plain
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    moved = {}
    for slack in (0.001, 1e6):
        was, now = ({r.id: r.shard for r in sharding.shard(docs, "doc_id", "text", n, slack=slack).collect()} for n in (16, 17))
        moved[slack] = [now[i] for i in was if was[i] != now[i]]
    assert set(moved[1e6]) == {16} and 0.03 < len(moved[1e6]) / 20_000 < 0.09 and len(moved[0.001]) < 0.2 * 20_000


def test_mixing(spark, odd, none):
    rows = mixing.mix(odd, "doc_id", "text", "source").collect()
    assert len(rows) == 12 and all(r.taken == r.copies * r.size <= 2 * r.size for r in rows) and mixing.mix(none, "doc_id", "text", "source").count() == 0
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 10), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, 1.5, (3, 1, 2), 2.0).collect()}
    assert got == pytest.approx({"a": 200, "c": 20, "b": 230 / 4, None: 230 * 3 / 4}) or sum(got.values()) == pytest.approx(450)
    many = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"))
    mixed = [mixing.mix(many, "doc_id", "text", "source") for _ in range(2)]
    for r in mixed[0].groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 60
    assert mixed[0].exceptAll(mixed[1]).count() == 0


def test_jaccard(spark, odd, none):
    got = by_id(jaccard.similar(odd, "doc_id", "text", 4, 85, 100))
    assert got[0].n_shingles == got[2].n_shingles == 0 and got[2].component_id == 2 and got[6].component_id == 5 and got[4].component_id == 4 and got[None].component_id is None
    assert jaccard.similar(none, "doc_id", "text").count() == 0
    rng = np.random.default_rng(0)
    base = [[f"w{x}" for x in rng.integers(0, 3000, 60)] for _ in range(30)]
    texts = [" ".join(base[i % 30]) if i < 90 else " ".join(np.where(rng.random(60) < 0.02, "new", base[i % 3])) for i in range(400)]
    got = by_id(jaccard.similar(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text", 5, 80, 100))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert [got[i].component_id for i in range(len(sets))] == group


@pytest.mark.parametrize("limits", [{"BLOCK": 60}, {"LEAF": 20}])
def test_jaccard_of_large_cells(spark, monkeypatch, limits):
    """Cells of many more rows than a block or a leaf: near copies of a text, and texts that only share a line with them."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 3000, 60)]
    texts = [" ".join(np.where(rng.random(60) < 0.03, f"new{i}", base)) if i < 250 else " ".join([*base[:20], *(f"v{x}" for x in rng.integers(0, 9000, 10))]) for i in range(400)]
    got = by_id(jaccard.similar(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text", 5, 80, 100))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert [got[i].component_id for i in range(len(sets))] == group


def brute_force(texts, k=5, num=80, den=100):
    """The component of each text, by comparing all with all."""
    sets = [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_what_jaccard_moves(spark, monkeypatch):
    """Posts of elements move as two numbers, whatever windows are made of them; cells of two rows are dealt once; of dense regions only their own rows bring fine sketches."""
    cells, leaves, fine = [], [], []
    stored, leaf_pairs, dropped = jaccard.stored, jaccard.Join.leaf_pairs, type(spark.range(0)).dropDuplicates
    monkeypatch.setattr(jaccard, "stored", lambda df, name: (cells.append(df._jdf.queryExecution().executedPlan().toString()) if name == "cells" else None, stored(df, name))[1])
    monkeypatch.setattr(jaccard.Join, "leaf_pairs", lambda join, dfs: (leaves.append(sum(df.count() for df in dfs)), leaf_pairs(join, dfs))[1])
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 60)) for _ in range(40)]
    texts += [t.rsplit(" ", 1)[0] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(jaccard.similar(docs, "doc_id", "text", 5, 80, 100))
    assert [got[i].component_id for i in range(80)] == brute_force(texts) == [*range(40)] * 2
    moved = re.search(r"Window (?s:.)*?Exchange hashpartitioning.*\n.*Project \[(.*)\]\n", cells[0]).group(1)
    assert re.fullmatch(r"\(.* AS element#\d+L, row#\d+L", moved) and moved.count(" AS ") == 1 and leaves == [0]
    rows = spark.range(1000).select("id", F.lit(100).alias("n"), F.lit(bytes(512)).alias("fine"))
    dense = rows.where("id < 20").select(F.lit(5).cast("long").alias("element"), F.lit(0).cast("long").alias("region"), "id", "n", F.lit(bytes(32)).alias("sketch"), F.lit(True).alias("home"), F.lit(True).alias("short"), F.lit(20).cast("long").alias("rows"))
    monkeypatch.setattr(type(rows), "dropDuplicates", lambda df, key: (fine.append(df.count()), dropped(df, key))[1])
    assert jaccard.Join(rows, rows, 5, 80, 100).dense_pairs(dense, jaccard.Rows).count() == 190 and fine == [20]


@pytest.mark.parametrize("large", [31])
def test_jaccard_of_sets_beyond_the_size_of_a_post(spark, monkeypatch, large):
    """Sets as large as a post can say, and larger ones, are linked as others are."""
    monkeypatch.setattr(jaccard, "LARGE", large)
    rng = np.random.default_rng(6)
    base = [[f"w{x}" for x in rng.integers(0, 3000, n)] for n in (8, 35, 36, 60, 120, 131, 150, 400)]
    texts = [" ".join(np.where(rng.random(len(b)) < 0.03, f"new{i}", b)[rng.integers(0, 1 + len(b) // 8) :]) for i in range(15) for b in base]
    got = by_id(jaccard.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 5, 80, 100))
    assert [got[i].component_id for i in range(len(texts))] == brute_force(texts)


@pytest.mark.parametrize("worst", [False, True])
def test_jaccard_of_groups_that_one_pair_does_not_settle(spark, monkeypatch, worst):
    """Near copies at the bound, few of them linked by pivots: what the pair that stands for two groups leaves open is made whole; links are those of all pairs."""
    monkeypatch.setattr(jaccard, "STARRED", 2)

    class Farthest(jaccard.Bridges):
        def closest(self, found):
            return jaccard_closest(self, found.assign(far=-found["far"].abs()))

    jaccard_closest = jaccard.Bridges.closest
    if worst:
        monkeypatch.setattr(jaccard, "Bridges", Farthest)
    made, dense_pairs = [], jaccard.Join.dense_pairs
    monkeypatch.setattr(jaccard.Join, "dense_pairs", lambda join, dense, kind: made.append((kind, common.stored(dense_pairs(join, dense, kind), "made"))) or made[-1][1])
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 3000, 100)]
    texts = [" ".join(np.where(rng.random(100) < 0.018, f"new{i}", base)) for i in range(300)]
    got = by_id(jaccard.similar(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text", 5, 80, 100))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert [got[i].component_id for i in range(len(sets))] == group
    assert made[0][0] is jaccard.Bridges and (len(made) == 2 or not worst)


@pytest.mark.parametrize("short", [True, False])
def test_rows_of_a_dense_region_are_dealt_in_proportion(spark, monkeypatch, short):
    """A group of near copies, and a few rows (or many that are long only) that it is not linked with: rows that are dealt grow as the group does."""
    def counted(*_):
        return lambda parts: (p[["id"]].assign(a=p["id"], b=p["id"], n=1)[["a", "b", "n"]] for p in parts)

    monkeypatch.setattr(jaccard, "BLOCK", 100)
    monkeypatch.setattr(jaccard, "_blocks", counted)
    for m in (1000, 4000):
        rows = spark.range(m).select("id", F.lit(100).alias("n"), F.lit(bytes(512)).alias("fine"))
        dense = rows.select(F.lit(5).cast("long").alias("element"), F.lit(0).cast("long").alias("region"), "id", "n", F.lit(bytes(32)).alias("sketch"), F.lit(True).alias("home"), (F.lit(short) | (F.col("id") < 5)).alias("short"), F.lit(m).cast("long").alias("rows"))
        join = jaccard.Join(rows, rows, 5, 80, 100)
        join.groups = rows.select("id", F.when(F.col("id") < m - 10, 0).otherwise(F.col("id")).alias("grp")) if short else rows.select("id", F.col("id").alias("grp"))
        assert join.dense_pairs(dense, jaccard.Rows).count() < 1.5 * m


def test_bpe(odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, rows = Tokenizer.from_file(path), bpe.encode(odd, "doc_id", "text", path).collect()
    assert len(rows) == 12 and bpe.encode(none, "doc_id", "text", path).count() == 0
    for r in rows:
        text = "one two" if r.id is None else TEXTS[r.id] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False)


def test_webp(odd, none):
    rows = webp.media(odd, "doc_id", "text").collect()
    assert len(rows) == 12 and webp.media(none, "doc_id", "text").count() == 0
    for r in rows:
        raw = ("one two" if r.id is None else TEXTS[r.id] or "").encode()
        assert bytes(r.payload) == raw + bytes(-len(raw) % 64 if raw else 64) and r.n_bytes == len(raw) and bytes(r.media[:4]) == b"RIFF"
    assert webp.features(bytes(64)) == "64,0,0,64" + ",0" * 15


def test_hidden_markov(spark, odd, none):
    got = by_id(hmm.score(odd, "doc_id", "text", F.when(F.col("id") % 2 == 1, 0).otherwise(1)))
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\0"] for i, t in enumerate(TEXTS)} | {None: ["one", "two", "\0"]}
    counts = collections.Counter(w for i, ws in tokens.items() if i is None or i % 2 == 0 for w in ws) + collections.Counter(tokens[4])
    total, kinds = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        assert got[i].base_score == pytest.approx(base) and got[i].n_tokens == len(ws) and got[i].train_tokens == total and got[i].n_known == sum(counts[w] > 0 for w in ws) and math.isfinite(got[i].score)
    assert hmm.score(none, "doc_id", "text", F.lit(1)).count() == 0
    unknown = by_id(hmm.score(odd, "doc_id", "text", F.lit(0)))
    assert unknown[3].train_tokens == 0 and unknown[3].n_known == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16))
    v[100:160] = v[0] + rng.normal(0, 0.15, (60, 16))
    v[200:210] = v[1]
    label = [0] * 250 + [1] * 50
    rows = [(i, v[i].astype(np.float32).tolist(), label[i]) for i in range(300)] + [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None] + [1.0] * 15, 0), (905, v[1].astype(np.float32).tolist(), None), (906, [1.0, 2.0], 0), (5, v[5].astype(np.float32).tolist(), 0), (None, v[1].astype(np.float32).tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "sim": F.lit(2)})
    got = by_id(neighbours.near_duplicates(table, "vec_id", "embedding", "label"))
    d = v.astype(np.float32).astype(np.float64)
    d /= np.linalg.norm(d, axis=1)[:, None]
    linked = (d @ d.T >= 0.93) & (np.array(label)[:, None] == label)
    np.fill_diagonal(linked, False)
    group = list(range(300))
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        if group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    assert [got[i].n_links for i in range(300)] == linked.sum(1).tolist() and [got[i].component_id for i in range(300)] == group
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 907)) and got[None].n_links == 0
    assert neighbours.near_duplicates(table.where("false"), "vec_id", "embedding", "label").count() == 0


def test_neighbours_of_isolated_pairs(spark):
    """Pairs that hyperplanes and descent miss, of more rows than a block, are found all the same; a group is linked to each of its many."""
    rng = np.random.default_rng(11)
    one = rng.normal(size=(3000, 24))
    one /= np.linalg.norm(one, axis=1)[:, None]
    off = rng.normal(size=one.shape)
    off -= (off * one).sum(1)[:, None] * one
    two = 0.935 * one + math.sqrt(1 - 0.935**2) * off / np.linalg.norm(off, axis=1)[:, None]
    v = np.concatenate([one, two]).astype(np.float32)
    table = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v.tolist())] + [(9000 + i, v[0].tolist(), 1) for i in range(3)], "vec_id long, embedding array<float>, label int")
    got = by_id(neighbours.near_duplicates(table, "vec_id", "embedding", "label"))
    d = v.astype(np.float64)
    d /= np.linalg.norm(d, axis=1)[:, None]
    linked = d @ d.T >= 0.93
    np.fill_diagonal(linked, False)
    assert [got[i].n_links for i in range(6000)] == linked.sum(1).tolist() and all(got[3000 + i].component_id <= i for i in range(3000))
    assert all(got[9000 + i].n_links == 2 and got[9000 + i].component_id == 9000 for i in range(3))


def by_brute_force(v, label):
    """Links of each row, and the least row that each reaches."""
    d = v.astype(np.float32).astype(np.float64)
    d /= np.linalg.norm(d, axis=1)[:, None]
    linked = (d @ d.T >= 0.93) & (np.array(label)[:, None] == label)
    np.fill_diagonal(linked, False)
    group = np.arange(len(v))
    while True:
        low = np.minimum(group, np.where(linked, group, len(v)).min(1))
        if (low == group).all():
            return linked.sum(1).tolist(), group.tolist()
        group = low


@pytest.mark.parametrize("block", [4096, 60])
def test_large_groups_are_counted_by_shells(spark, monkeypatch, block):
    """A tight group, a loose one and a chain, of more nodes than a block; ids of two labels are two nodes."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(5)
    tight, loose = rng.normal(size=(2, 16))
    turn = np.linspace(0, 1.5, 90)[:, None]
    chain = np.cos(turn) * np.eye(16)[0] + np.sin(turn) * np.eye(16)[1]
    v = np.concatenate([tight + rng.normal(0, 0.08, (150, 16)), loose + rng.normal(0, 0.22, (150, 16)), chain, rng.normal(size=(60, 16))])
    rows = [(i, x, i % 2 if i >= 390 else 0) for i, x in enumerate(v.astype(np.float32).tolist())]
    links, group = by_brute_force(v, [r[2] for r in rows])
    got = by_id(neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label"))
    assert [got[i].n_links for i in range(450)] == links and [got[i].component_id for i in range(450)] == group and {r.recall for r in got.values()} == {1.0}
    two = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 1), (4, [0.01, 1.0], 1), (5, [1.0, 0.0], 1)]
    got = by_id(neighbours.near_duplicates(spark.createDataFrame(two, "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label"))
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {1: (3, 1), 2: (1, 1), 3: (2, 1), 4: (2, 1), 5: (0, 5)}


def test_links_come_through_descent_and_its_audit(spark, monkeypatch):
    """Without descent nothing is linked, and the audit says so aloud; without enough seeds, it asks for more."""
    rng = np.random.default_rng(7)
    v = np.repeat(rng.normal(size=(40, 16)), 2, axis=0) + rng.normal(0, 0.02, (80, 16))
    table = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v.astype(np.float32).tolist())], "vec_id long, embedding array<float>, label int")
    with monkeypatch.context() as m:
        m.setattr(neighbours, "descend", lambda nodes, graph, *_: graph.where("false"))
        m.setattr(neighbours, "TURNS", 1)
        with pytest.raises(RuntimeError, match="missing"):
            neighbours.near_duplicates(table, "vec_id", "embedding", "label")
    turns, real = [], neighbours.seeds
    monkeypatch.setattr(neighbours, "seeds", lambda nodes, sizes, turn, tables: (turns.append(tables), real(nodes, sizes, turn, tables) if turn else real(nodes, sizes, 0, 1).where("false"))[1])
    got = by_id(neighbours.near_duplicates(table, "vec_id", "embedding", "label"))
    links, group = by_brute_force(v, [0] * 80)
    assert turns[:2] == [6, 12] and [got[i].n_links for i in range(80)] == links and [got[i].component_id for i in range(80)] == group


def test_language(spark, odd, none):
    said = {"en": "the cat and the dog of this house with that thing", "de": "der hund und die katze mit einem schönen haus nicht", "fr": "le chat et la maison avec une très belle chose où"}
    rows = [(f"{x}{i}", " ".join(np.random.default_rng(i).permutation(t.split())), x if i % 7 else None, f"h{i % 3}.{x}", x) for x, t in said.items() for i in range(40)]
    rows += [("wrong", said["de"], "en", "h1.de", "de"), ("null", None, "en", "h1.en", "en"), ("junk", "123 !! ??", "de", None, None), ("empty", "", None, None, None)]
    got = {r.key: r for r in langid.identify(spark.createDataFrame(rows, "key string, text string, declared string, host string, suffix string")).collect()}
    assert all(got[k].language == k[:2] and got[k].accepted for k in got if k[2:].isdigit())
    assert got["wrong"].language == "de" and got["null"].language == "en" and not got["null"].accepted and not got["junk"].accepted and not got["empty"].accepted
    assert langid.identify(langid.documents_as_rows(none)).count() == 0 and langid.identify(langid.documents_as_rows(odd)).count() == 12
    pages = spark.createDataFrame([(1, "https://u@www.X.example.de:80/a", '<html lang="de-AT"><script>x</script>Hallo<!-- c --> Welt</html>'), (2, None, None)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in langid.pages_as_rows(pages).collect()}
    assert (rows[1].declared, rows[1].host, rows[1].suffix, rows[1].text.split()) == ("de-AT", "www.x.example.de", "de", ["Hallo", "Welt"]) and rows[2].text is None


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(2)
    clean = [" ".join(f"w{x}" if x % 3 else f"word{chr(97 + x % 26)}" for x in rng.integers(0, 300, 40)) for _ in range(500)]
    rows = [(t if i % 4 else " ".join([t, "vile", t[:50], "Scumbag!"]), int(i % 4 == 0), i // 4 % 2) for i, t in enumerate(clean)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int, fold int"), least=2)
    probes = spark.createDataFrame([(1, "wordb wordc vile wordd scumbag wordf"), (2, clean[3]), (3, None), (4, ""), (5, "12 ..")], "doc_id long, text string")
    got = by_id(toxicity.score(probes, "doc_id", "text", model))
    assert got[1].score >= 0.7 and got[1].n_passages >= 1 and all(got[k].score < 0.5 for k in (2, 3, 4, 5)) and got[3].passages == []
    assert toxicity.score(odd, "doc_id", "text", model).count() == 12 and toxicity.score(none, "doc_id", "text", model).count() == 0
    untaught = toxicity.fit(spark.createDataFrame([], "text string, toxic int, fold int"))
    assert by_id(toxicity.score(probes, "doc_id", "text", untaught))[1].score == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    held = toxicity.remainder(F.col("id"), 3) == 1
    taught = toxicity.training_rows(odd.drop("id"), labels, "doc_id", "text", "toxic", held, F.lit(0)).count()
    assert taught == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in [*range(10), 4])


def test_pages(spark):
    def page(title, body, extra=""):
        return f'<html><body><nav><a href="/">Home</a></nav><div><h1>{title}</h1><p>Every page says this.</p><p>{body}</p>{extra}</div><footer>f</footer></body></html>'

    rows = [(i, "http://h.example/x", page(f"T{i}", f"Body {i}", "<table><tr><td>x</table>" if i % 3 == 0 else "")) for i in range(12)] + [(20, None, None), (21, "nonsense", ""), (0, "http://h.example/x", page("T0", "Body 0", "<table><tr><td>x</table>"))]
    got = by_id(wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "title": F.lit(2), "at": F.lit(3)}), "page_id", "url", "html"))
    assert got[1].text == "T1\nBody 1" and got[0].text == "T0\nBody 0\nx" and got[20].text == got[21].text == "" and got[1].n_chars == 9
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html").count() == 0


def test_pages_of_small_hosts_and_of_one_opening(spark):
    """Plain blocks that a host's pages share go, also where it has three pages or all begin with one line."""
    rows = [(i, f"http://{'few' if i < 3 else 'many'}.example/{i}", f"<html><body><div>Site name</div><div>Home | News</div><p>Body {i}</p><p>More of {i}</p></body></html>") for i in range(14)]
    rows += [(99, "http://many.example/99", "<div>" * 5_000 + "deep")]
    got = by_id(wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html"))
    assert all(got[i].text == f"Body {i}\nMore of {i}" for i in range(14)) and got[99].text == "deep"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    texts = [" ".join(["the and of to in", *(f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}" for x in rng.integers(0, 600, 30))]) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*texts, texts[0], texts[1] + " more", "123 456 !!", ""])] + [(None, texts[2] + " z", "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {None, *range(62)} and kept.columns == corpus_pipeline.COLUMNS
    single = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs.where("doc_id = 5")), str(tmp_path))
    ids = sorted(r.doc_id for r in single.where("doc_id is not null").collect())
    assert ids == [*range(60), 62, 63]
    two = spark.createDataFrame([(1, texts[7], "en", "a", 1), (1, texts[8], "en", "a", 1), (2, texts[8] + " end", "en", "a", 1), (1, texts[7], "en", "a", 1)], docs.schema)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, two, str(tmp_path)).collect()) == sorted([(1, texts[7]), (1, texts[8])])
    mixed = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    assert mixed.columns == corpus_pipeline.COLUMNS and max(r["count"] for r in mixed.where("doc_id is not null").groupBy("doc_id").count().collect()) <= 2
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out and set(out) <= {None, *range(60)} and all(n > 0 for n in out.values())


def shares(sizes, factor=1.5):
    """Targets of sources (by weight 3, 1, 2, at most twice the size each), by handing the excess on."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, target = factor * sum(sizes.values()), set(sizes), {}
    while True:
        all_ = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / all_ > 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / all_ for s in open_}
        target |= {s: 2 * sizes[s] for s in full}
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full


def test_pipeline_stage_by_stage_against_brute_force(spark, tmp_path):
    import collections

    import corpus_pipeline
    import public_tokenizers
    import tokenizers

    rng, bad = np.random.default_rng(8), "vile scum filth idiot trash hateful worthless pathetic".split()
    drawn = lambda n: [f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}" for x in rng.integers(0, 600, n)]
    rows = [(i, " ".join(["the and of to in", *drawn(20), *(rng.choice(bad, 15) if i % 4 == 0 else []), *drawn(20)]), "en", f"s{i % 3}" if i % 7 else None) for i in range(240)]
    rows += [(300 + j, rows[j][1] + " more", "en", "s1") for j in range(1, 140, 7)] + [(900, "123 456 !!", "en", "s2")]
    rows += [(None, "the and of to in " + " ".join(drawn(30)), "en", "s0")] * 3
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    toxic = lambda i: i is not None and (i if i < 240 else i - 300) % 4 == 0
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    before = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in docs.collect()]
        if name == "language_id":
            assert sorted(after, key=str) == sorted((r for r in before if r[0] != 900), key=str)
        elif name == "toxicity":
            assert sorted(after, key=str) == sorted((r for r in before if not toxic(r[0])), key=str)
        elif name == "ngram_jaccard":
            sets = {r[0]: {tuple(w[i : i + 5]) for w in [r[1].split()] for i in range(len(w) - 4)} for r in before if r[0] is not None}
            gone = {b for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
            assert gone and sorted(after, key=str) == sorted((r for r in before if r[0] not in gone), key=str)
        elif name == "mixing":
            sizes = collections.Counter()
            taken = collections.Counter()
            for out, of in ((before, sizes), (after, taken)):
                for r in out:
                    of[r[3]] += len(r[1].split())
            assert all(abs(taken[s] - t) <= 100 for s, t in shares(sizes).items())
            had, has = collections.Counter(before), collections.Counter(after)
            assert all(has[r] <= 2 * had[r] for r in has)
            seen = collections.Counter((r[0], r[1]) for r in after)
        else:
            tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = collections.Counter()
            for (i, text), n in seen.items():
                want[i, tuple(tok.encode(text, add_special_tokens=False).ids)] += n
            assert collections.Counter((r[0], tuple(r[2])) for r in after) == want and all(r[1] == len(r[2]) for r in after)
        before = after


def test_rare_languages_are_known_and_wrong_codes_are_not(spark):
    said = {"en": "the cat and the dog of this house with that thing", "pl": "kot oraz pies w domu gdzie jest bardzo dużo rzeczy które wszyscy znamy", "zz": "the cat and the dog of this house with that thing"}
    rows = [(f"{x}{i}", " ".join(np.random.default_rng(i).permutation(t.split())), x, "h", None) for x, t in said.items() for i in range(1200 if x == "en" else 16)]
    got = langid.identify(spark.createDataFrame(rows, "key string, text string, declared string, host string, suffix string"))
    assert {(r.k, r.language) for r in got.select(F.substring("key", 1, 2).alias("k"), "language").distinct().collect()} == {("en", "en"), ("pl", "pl"), ("zz", "en")}


def test_many_languages(spark):
    """Eighty codes of ten rows each: what is planned doesn't grow with their square, and texts are told by their own letters."""
    code = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = [(f"{k}-{i}", " ".join(f"{code(k)}{chr(97 + x % 26)}{code(k)}" for x in np.random.default_rng(i).integers(0, 26, 12)), code(k) if i < 9 else None, f"h{k % 3}", None) for k in range(80) for i in range(10)]
    found = langid.identify(spark.createDataFrame(rows, "key string, text string, declared string, host string, suffix string"))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    got = {r.key: r.language for r in found.collect()}
    assert len(got) == 800 and sum(language == code(int(key.split("-")[0])) for key, language in got.items()) > 780
