"""The parts of the operators against brute force, round trips and libraries."""

import itertools
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from duoledger.llm import bpe, dictionary, hmm, jaccard, langid, mixing, toxicity, webp, wrappers
from duoledger.llm.common import byte_words, words


def test_words_are_those_of_the_pattern():
    text = "A\x1cb  Ç\x85É x\tY\x0bz\r\n"
    assert words(text) == ["a\x1cb", "Ç\x85É x", "y", "z"] == [w.decode() for w in byte_words(text)]
    assert words(None) == words("") == byte_words(None) == []


def brute_segments(s):
    def rec(a, b):
        best = max(((sum(s[i:j]), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        return [*rec(a, -best[1]), (best[0], -best[1], -best[2]), *rec(-best[2], b)] if best[0] > 0 else []

    return rec(0, len(s))


def test_segments():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(-0.2, 1, rng.integers(0, 18))
        assert [(round(v, 6), a, b) for v, a, b in sorted(toxicity.segments(s), key=lambda x: x[1])] == [(round(v, 6), a, b) for v, a, b in brute_segments(s)]


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 400):
        size, p = rng.integers(1, 500, n), np.full(n, 0.3)
        free = mixing.flight(size, p, np.random.default_rng(2), False)
        assert ((free > 0) & (free < 1)).sum() <= 2 and abs(free.sum() - p.sum()) < 1e-6 and abs(free @ size - p @ size) < 1e-3
        landed = mixing.flight(size, p, np.random.default_rng(2), True)
        assert set(landed) <= {0, 1}
        if n == 400:
            assert abs(landed @ size - p @ size) <= 2


def test_numbers_round_trip():
    rng = np.random.default_rng(3)
    for top in (2, 100, 20_000, 1 << 27):
        a = rng.integers(0, top, 1000)
        assert (dictionary.unpack_numbers(dictionary.pack_numbers(a)) == a).all()
    assert dictionary.unpack_numbers(dictionary.pack_numbers(np.zeros(0, int))).tolist() == []


def test_many_numbers_round_trip_and_stay_small():
    rng = np.random.default_rng(4)
    for top in (2, 255, 256, 60_000, 1 << 16, 1 << 27):
        a = np.append((rng.random(50_000) ** 9 * top).astype(np.int64), top)
        assert (dictionary.unpack_numbers(dictionary.pack_numbers(a)) == a).all() and len(dictionary.pack_numbers(a)) < 0.95 * a.astype(np.uint16 if top < 1 << 16 else np.uint32).nbytes
    a = rng.integers(0, 50_000, 50_000)
    assert len(dictionary.pack_numbers(a)) <= 2 * len(a) + 100  # seven bits to a byte took 2.3 bytes each


def test_numbers_of_words_follow_from_their_buckets():
    numbers = dictionary.Numbers(48)
    words = [f"w{x}" for x in np.random.default_rng(5).integers(0, 9000, 20_000)]
    given = [numbers[w] for w in words]
    assert len(set(given)) == len(numbers) == len(set(words)) and max(given) < numbers.end() < 1.5 * len(numbers)
    for bucket, own in enumerate(numbers.by):
        assert [numbers[w] for w in own] == dictionary.numbers_of(bucket, len(own), 48).tolist()
    assert not {"at"} & set(dictionary.COLUMNS)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.load(path)
    split, signs = bpe.Splitter(own.special), bpe.byte_signs()
    random.seed(4)
    alphabet = "aàéÀÉÜßΣσς'sStTreLlİıǅ²½Ⅷ٣1234 \t\n\x1c\x85  ́eE.,!?<|>🎉漢字가각가\x00\x7f~"
    for _ in range(2000):
        s = "".join(random.choice(alphabet) for _ in range(random.randint(0, 14))) + random.choice(["", "<|endoftext|>", "<|startoftext|>a", "I'LL don't"])
        ids = [i for w in split.words(s) for i in bpe.encode_word(w, own, signs)]
        assert ids == library.encode(s, add_special_tokens=False).ids
        assert " ".join(own.pieces[i] for i in ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_very_long_words():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary, library = bpe.load(path), Tokenizer.from_file(path)
    rng = random.Random(5)
    for word in ("a" * 3001, "".join(rng.choices("abcdefgh", k=20_000)), "é" * 501, "the" * 1000):
        assert bpe.encode_word(word, vocabulary, bpe.byte_signs()) == library.encode(word, add_special_tokens=False).ids
    assert bpe.encode_word("".join(rng.choices("etaoin", k=1_000_000)), vocabulary, bpe.byte_signs())


def test_webp_round_trip():
    rng = np.random.default_rng(5)
    tiles = [bytes(64), b"ab" * 32, rng.integers(0, 256, 4096, dtype=np.uint8).tobytes(), b"x" * 60 + bytes(900), b"abcdefgh" * 200]
    tiles += [bytes(rng.integers(97, 101, 64 * int(rng.integers(1, 12)), dtype=np.uint8)) for _ in range(60)]
    tiles += [np.repeat(rng.integers(0, 256, (k, 4), dtype=np.uint8), 16, 0).tobytes() for k in range(1, 5)]
    tiles = [t + bytes(-len(t) % 64) for t in tiles]
    assert {min(zlib.crc32(t) & 7, 4) for t in tiles} == {0, 1, 2, 3, 4}
    assert [p.tobytes() for p in webp.decode(webp.encode(tiles))] == tiles


class Image:
    """Writes one image by hand, so that parts of the format that the writer leaves out are read too."""

    def __init__(self):
        self.w = webp.Writer()

    def codes(self, green, others=None):
        lengths = [np.concatenate([green, np.zeros(280 - len(green), np.uint8)])] + [others if others is not None else np.full(256, 8, np.uint8)] * 3
        for x in lengths:
            self.w.code(x)
        return [webp.codes_of(x) for x in lengths], lengths

    def file(self, width, height):
        total = at = 0
        for v, n in zip(self.w.values, self.w.sizes, strict=True):
            total |= int(v) << at
            at += n
        head = b"\x2f" + ((width - 1) | (height - 1) << 14 | 1 << 28).to_bytes(4, "little")
        return webp.riff(head + total.to_bytes((at + 7) // 8, "little"))


def pixels_by(predictors, width, height, residual):
    """Predictor transform, pixel by pixel, as the format says it."""
    out = np.zeros((height, width, 4), np.int32)
    for y, x in itertools.product(range(height), range(width)):
        at = lambda j, i: out[j, i]
        if y == 0:
            guess = np.array([0, 0, 0, 255]) if x == 0 else at(0, x - 1)
        elif x == 0:
            guess = at(y - 1, 0)
        else:
            guess = webp.predict(predictors, at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), at(y - 1, x + 1) if x + 1 < width else at(y, 0))
        out[y, x] = (residual[y, x] + guess) & 255
    return out


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    rng, width, height = np.random.default_rng(mode), 7, 5
    residual = rng.integers(0, 256, (height, width, 4))
    image = Image()
    w = image.w
    for v, n in ((1, 1), (0, 2), (7, 3), (0, 1)):
        w(v, n)
    for v in (mode, 0, 0, 255):
        w.code(np.eye(1, 256, v, dtype=np.uint8)[0])
    w.code(np.eye(1, 40, 0, dtype=np.uint8)[0])
    for _ in range(3):
        w(0, 1)
    codes, lengths = image.codes(np.full(256, 8, np.uint8))
    w.code(np.eye(1, 40, 0, dtype=np.uint8)[0])
    for blue, green, red, alpha in residual.reshape(-1, 4).tolist():
        for c, v in enumerate((green, red, blue, alpha)):
            w(int(codes[c][v]), int(lengths[c][v]))
    got = webp.decode([image.file(width, height)])[0]
    assert (got[..., [2, 1, 0, 3]] == pixels_by(mode, width, height, residual)).all()


def test_copies_from_the_line_above_and_groups_of_codes():
    """Two groups of codes by an entropy image, and a copy of the line above."""
    image = Image()
    w = image.w
    w(0, 1)  # no transform
    w(0, 1)  # no cache
    w(1, 1)  # groups
    w(0, 3)  # blocks of four
    w(0, 1)
    for lengths in (np.array([1, 1], np.uint8), *[np.eye(1, 256, 0, dtype=np.uint8)[0]] * 3):
        w.code(np.concatenate([lengths, np.zeros(256 - len(lengths), np.uint8)]))
    w.code(np.eye(1, 40, 0, dtype=np.uint8)[0])
    w(0, 1)
    w(1, 1)  # left block: group 0, right block: group 1
    for values in ((5, 6, 7), (8, 9, 7)):
        full = np.zeros(280, np.uint8)
        full[[10, 20, 262]] = 1, 2, 2  # two literals, or a copy whose length has two extra bits
        w.code(full)
        for v in values:
            w.code(np.eye(1, 256, v, dtype=np.uint8)[0])
        w.code(np.eye(1, 40, 0, dtype=np.uint8)[0])  # distance code 1: the pixel above
    codes = webp.codes_of(np.array([1 if i == 10 else 2 if i in (20, 262) else 0 for i in range(280)], np.uint8))
    lengths = {10: 1, 20: 2, 262: 2}
    for v in (10, 20, 10, 10, 20, 20, 10, 10):
        w(int(codes[v]), lengths[v])
    w(int(codes[262]), 2)  # length prefix 6: 9 to 12
    w(0, 2)
    got = webp.decode([image.file(8, 3)])
    first = [(5, g, 6, 7) if x < 4 else (8, g, 9, 7) for x, g in enumerate((10, 20, 10, 10, 20, 20, 10, 10))]
    assert [tuple(p) for p in got[0].reshape(-1, 4)[:8].tolist()] == first
    assert [tuple(p) for p in got[0].reshape(-1, 4)[8:16].tolist()] == first


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 62, 40).astype(np.uint64)]))
        s, t = (jaccard.sketches_of([jaccard.sketch_of(x)])[0] for x in (a, b))
        assert jaccard.sketch_distance(s, t) <= len(np.setxor1d(a, b))


def test_regions_lose_no_pair():
    """Of every similar pair, each row is in the region where the other is at home."""
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 1 << 62, 120).astype(np.uint64) for _ in range(40)]
    sets = [np.unique(np.concatenate([b[rng.random(120) > 0.03], rng.integers(0, 1 << 62, 3).astype(np.uint64)])) for b in base for _ in range(6)]
    n, sketches = np.array([len(s) for s in sets]), [jaccard.sketch_of(s) for s in sets]
    pivots = rng.choice(len(sets), jaccard.PIVOTS, replace=False)
    rows = pd.DataFrame({"element": 5, "region": 0, "id": np.arange(len(sets)), "n": n.astype(np.int32), "sketch": sketches, "home": True, "grp": np.arange(len(sets)), "pivots": b"".join(sketches[p] for p in pivots),
                         "pid": [pivots] * len(sets), "pn": [n[pivots]] * len(sets), "pg": [pivots] * len(sets)})
    out = pd.concat(jaccard._parted(80, 100)(iter([rows])))
    inside = out[out["pivot"].isna()]
    own = dict(inside[inside["home"]][["id", "region"]].itertuples(index=False))
    held, near = set(inside[["id", "region"]].itertuples(index=False, name=None)), set(out[out["pivot"].notna()][["pivot", "id"]].itertuples(index=False, name=None))
    assert sorted(own) == list(range(len(sets))) and len(held) < 0.9 * jaccard.PIVOTS * len(sets)
    for i, j in itertools.permutations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both * 100 >= 80 * (n[i] + n[j] - both):
            assert (j, own[i]) in held and (i not in pivots or j in {y for _, y in near})


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 40)).astype(np.uint64)]))
        frequent = np.sort(rng.choice(a, len(a) // 3, replace=False))
        both = len(np.intersect1d(a, b))
        if both * 100 >= 80 * (len(a) + len(b) - both):
            met = len(np.intersect1d(*(jaccard.prefix_of(x, frequent, 80, 100) for x in (a, b))))
            assert met >= jaccard.least_shared(min(len(a), len(b)), 80, 100)


def test_short_parts_of_smaller_sets_share_enough():
    rng, found = np.random.default_rng(12), 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.9, 1])], rng.integers(0, 1 << 62, rng.integers(0, 1 + len(a) // 8)).astype(np.uint64)]))
        a, b = sorted((a, b), key=len)
        frequent, both = np.sort(rng.choice(a, len(a) // 3, replace=False)), len(np.intersect1d(a, b))
        if both * 100 >= 80 * (len(a) + len(b) - both):
            short = [jaccard.prefix_of(x, frequent, 80, 100)[: jaccard.short_length(len(x), 80, 100)] for x in (a, b)]
            whole = jaccard.prefix_of(b, frequent, 80, 100)
            met = len(np.intersect1d(short[0], short[1] if len(a) == len(b) else whole))
            assert met >= jaccard.least_shared(len(a), 80, 100) and len(short[1]) <= len(whole)
            found += 1
    assert found > 100


def test_sets_of_many_texts_at_once(monkeypatch):
    """Hashes tell apart what words tell apart, wherever a text stands and however texts are cut for hashing."""
    rng = np.random.default_rng(13)
    texts = [None, "", " \t", "a", "A b\x0bC", "x\x1cy z \x85 q  é", "a b c d a b c d a b c d", "w" * 500 + " b c d e " + "w" * 501]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in rng.integers(0, 300, 60)]
    got = list(jaccard.Shingler(4).sets_of(texts))
    shingles = [(lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()))(byte_words(t)) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in shingles] and all((np.diff(x.astype(object)) > 0).all() for x in got)
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert len(np.intersect1d(got[i], got[j])) == len(shingles[i] & shingles[j])
    assert all((jaccard.Shingler(4).set_of(t) == x).all() for t, x in zip(texts, got, strict=True))
    monkeypatch.setattr(jaccard, "AT_ONCE", 60)  # words of more are hashed by themselves
    few = [t for t in texts if max(map(len, byte_words(t)), default=0) <= 60]
    assert all((x == y).all() for x, y in zip(jaccard.Shingler(4).sets_of(few), (x for t, x in zip(texts, got, strict=True) if t in few), strict=True))
    assert [len(x) for x in jaccard.Shingler(4).sets_of(texts)] == [len(x) for x in shingles]


def rows_of(groups, **columns):
    own = np.random.default_rng(9).integers(0, 1 << 62, 100).astype(np.uint64)
    return pd.DataFrame({"id": np.arange(len(groups)), "n": np.int32(100), "grp": groups, "home": True, "sketch": [jaccard.sketch_of(own)] * len(groups)} | columns)


def test_rows_of_a_known_group_are_never_paired(monkeypatch):
    """A region of near copies known as one group, with a row of its own: only the pairs with that row are made."""
    made, compare = [], jaccard.Rows.compare
    monkeypatch.setattr(jaccard.Rows, "compare", lambda rows, a, b: (made.append(len(a)), compare(rows, a, b))[1])
    m = 3000
    found = pd.concat(jaccard._blocks(80, 100)(iter([rows_of([0] * (m - 1) + [m - 1], element=5, region=0, b0=0, b1=0, block=0)])))
    assert sorted(zip(found["a"], found["b"], strict=True)) == [(i, m - 1) for i in range(m - 1)] and sum(made) < 10 * m


def test_rows_alike_a_whole_group_make_one_pair_each(monkeypatch):
    """Rows that a known group of near copies is yet to be linked with: one pair each leaves the task, whatever the group's size, and tells of the others."""
    monkeypatch.setattr(jaccard, "PAIRS", 500)
    m, k = 300, 7
    rows = rows_of([0] * m + list(range(m, m + k)), element=5, region=0, b0=0, b1=0, block=0, fine=None)
    own = np.random.default_rng(9).integers(0, 1 << 62, 100).astype(np.uint64)
    rows["fine"] = [jaccard.sketch_of(np.concatenate([own[: 100 - i % 9], own[:1] + np.uint64(1 << 40) * np.arange(1, i % 9 + 1).astype(np.uint64)]), jaccard.FINE) for i in range(m + k)]
    every, some = (pd.concat(jaccard._blocks(80, 100, kind)(iter([rows]))) for kind in (jaccard.Rows, jaccard.Bridges))
    assert len(every) == m * k + k * (k - 1) // 2 and len(some) == k + k * (k - 1) // 2
    assert (some["more"] + 1).sum() == len(every) and (some["low"] == 100).all()
    assert all(i % 9 == j % 9 for i, j in zip(some["a"], some["b"], strict=True) if i < m)


def test_across_makes_each_pair_of_two_groups_once(monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    groups, made = np.random.default_rng(10).integers(0, 5, 60), []
    monkeypatch.setattr(jaccard.Rows, "compare", lambda rows, a, b: made.extend(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)))
    jaccard.Rows(rows_of(groups), 80, 100).across()
    assert sorted(made) == [(i, j) for i, j in itertools.combinations(range(60), 2) if groups[i] != groups[j]]


def test_likelihoods_are_exact():
    rng = np.random.default_rng(8)
    mass = rng.random(6)
    model = hmm.first_model(mass / mass.sum())
    sequences = [rng.integers(0, 6, n) for n in (4, 3, 1)]
    got = hmm.forward(model, sequences, np.zeros(3, int))
    for s, log in zip(sequences, got, strict=True):
        p = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(s)) if len(s) < 4 else ():
            q = model.start[0, path[0]] * model.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:], strict=False):
                q *= model.move[a, b] * model.emit[o, b]
            p += q
        assert len(s) == 4 or abs(np.log(p) - log) < 1e-9
    total, start, move, emit = hmm.expected(model, sequences, np.zeros(3, int))
    assert abs(total - got.sum()) < 1e-9 and abs(start.sum() - 3) < 1e-9 and abs(move.sum() - 5) < 1e-9 and abs(emit.sum() - 8) < 1e-9


def test_blocks_of_pages():
    page = ('<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href=x>menu</a></nav><main><div class="sidebar">x</div><article><header><h1>T &amp; U</h1></header>'
            '<p>a<b>b</b>  c<br>d<p>e <i>f</i><!-- no --><div class="comments"><p>bad</p></div><div class="ad">buy</div><ul><li>one<li>two</ul>tail</article></main><form>f</form><footer>z</footer></body></html>')
    assert texts_of(page) == ["T & U", "ab c d", "e f", "one", "two", "tail"]
    assert texts_of("") == [] and texts_of("<p>x<div>y") == ["x", "y"] and texts_of("a<nav>b</nav>c <button>d</button>e") == ["a", "c e"]


def test_paragraphs_hold_what_may_stand_in_them():
    for tag in ("svg", "script", "style", "noscript", "iframe", "math", "template", "textarea", "object", "video", "select", "button"):
        assert texts_of(f"<p>click <{tag} a=1><b>not</b></{tag}> here</p><p>on") == ["click here", "on"]
    assert texts_of("<p>one <input> two <img> three <link> four<xmp>x</xmp>five") == ["one two three four", "five"]


@pytest.mark.parametrize(("names", "gone"), [
    ("ad", True), ("ad-slot", True), ("adSlot2", True), ("related-posts", True), ("site-header", True), ("comment-list", True), ("sidebar_left", True), ("cookieConsent", True), ("x promo__box", True), ("advertisement", True), ("skip-link", True),
    ("share-price", False), ("related-work", False), ("comment-culture", False), ("header", False), ("content main", False), ("adventure", False), ("social-history", False), ("load", False), ("", False)])
def test_names_of_what_is_no_article(names, gone):
    assert wrappers.not_article(names) is gone
    assert texts_of(f'<div><p>before</p><div class="{names}"><p>this</p></div></div>') == ["before"] + ([] if gone else ["this"])
    assert texts_of('<article class="comment-culture"><h1 class="share-price">T</h1><p>x') == ["T", "x"]


def texts_of(html):
    page = wrappers.parse(html)
    return [t for _, t in wrappers.blocks(page, wrappers.skeleton(page)[2])]


def test_deep_and_wide_pages():
    """Ten thousand levels of blocks, inline elements and unknown ones, and pages of many blocks."""
    for tag in ("div", "b", "x", "p", "ul><li"):
        assert texts_of(f"<{tag}>" * 10_000 + "inmost")[-1] == "inmost"
    page = wrappers.parse("<div>" * 10_000 + "x")
    shapes, shape, place = wrappers.skeleton(page)
    written = shapes.written(shape)
    assert place[-1] == 10_000 and len(set(wrappers.slots_of(written, written))) == 10_001
    assert wrappers.slots_of(written, "0 #root\n1 div")[:2] == wrappers.slots_of("0 #root\n1 div", written)
    wide = wrappers.parse("".join(f"<p>{i}<h{i % 5 + 1}>{i}" for i in range(3_000)))
    shapes, shape, place = wrappers.skeleton(wide)
    assert len(wrappers.slots_of(shapes.written(shape), "0 #root" + "\n1 h2\n1 p" * 2_000)) == 6_001 and max(place) == 6_000


def brute_match(a, b):
    """Nested tuples (label, children): most pairs, by the recurrence."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        return 0 if not x or not y else max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + brute_match(x[0], y[0]))

    return 1 + best(a[1], b[1])


def test_tree_matching():
    rng = random.Random(11)

    def tree(depth):
        children = []
        for c in (tree(depth - 1) for _ in range(rng.randint(0, 4) if depth else 0)):
            children += [c] if not children or children[-1] != c else []
        return rng.choice("ab"), tuple(children)

    def lines(t, depth=0):
        return [f"{depth} {t[0]}", *(x for c in t[1] for x in lines(c, depth + 1))]

    for _ in range(300):
        a, b = tree(3), tree(3)
        shapes = wrappers.Shapes()
        x, y = shapes.read("\n".join(lines(a))), shapes.read("\n".join(lines(b)))
        align = wrappers.Alignment(shapes)
        assert align.match(x, y) == brute_match(a, b) and shapes.written(x) == "\n".join(lines(a))
        if a[0] == b[0]:
            slots, of = (wrappers.slots_of("\n".join(lines(t)), "\n".join(lines(b))) for t in (a, b))
            assert len(set(slots) & set(of)) == brute_match(a, b)
    a = "0 div\n1 p\n1 ul\n2 li\n1 p"
    b = "0 div\n1 ul\n2 li\n1 p\n1 hr"
    to = wrappers.slots_of(b, b)
    assert wrappers.slots_of(a, b)[0] == to[0] and wrappers.slots_of(a, b)[2:] == to[1:4] and wrappers.slots_of(a, b)[1] not in to


def test_trigrams_are_of_letters():
    letters = langid._letters()
    assert len(langid.trigrams("", letters)[0]) == 0 and len(langid.trigrams("123 ..", letters)[0]) == 0
    grams, n = langid.trigrams("Été", letters)
    assert len(grams) == n == 3 and (grams == langid.trigrams("éTÉ", letters)[0]).all()
