"""Lossless WebP: a decoder that walks many images at once, and a writer for byte payloads."""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Fixed values of the format: (x, y) offsets of the first 120 distance codes.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)]
LENGTHS, DISTANCES, HASH = 24, 40, 0x1E35A7BD
# ---------------------------------------------------------------- prefix codes


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the lengths, first bit lowest."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = int(f"{code:0{last}b}"[::-1], 2)
        code += 1
    return codes


_tables: dict[bytes, np.ndarray] = {}


def table_of(packed: bytes) -> np.ndarray:
    """For all bits that may come, as many as the longest code has: symbol * 16 + length. One symbol alone takes no bits."""
    if packed not in _tables:
        if len(_tables) > 1000:
            _tables.clear()
        _tables[packed] = _table_of(packed)
    return _tables[packed]


def _table_of(packed: bytes) -> np.ndarray:
    lengths = np.frombuffer(packed, np.uint8)
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        return np.array([(used[0] if len(used) else 0) << 4], np.int32)
    table, codes = np.zeros(1 << int(lengths.max()), np.int32), codes_of(lengths)
    for s in used:
        table[codes[s] :: 1 << int(lengths[s])] = s << 4 | int(lengths[s])
    return table


class Bits:
    """Reads bits of one image's header, lowest first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def __call__(self, n: int) -> int:
        if n == 0:
            return 0
        a = self.at >> 3
        v = int.from_bytes(self.data[a : a + (n + 14 >> 3)], "little") >> (self.at & 7)
        self.at += n
        return v & (1 << n) - 1

    def symbol(self, table: np.ndarray) -> int:
        a = self.at >> 3
        v = int(table[int.from_bytes(self.data[a : a + 3], "little") >> (self.at & 7) & len(table) - 1])
        self.at += v & 15
        return v >> 4


def read_code(bits: Bits, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.uint8)
    if bits(1):
        two = bits(1)
        lengths[bits(8 if bits(1) else 1)] = 1
        if two:
            lengths[bits(8)] = 1
        return lengths
    own = np.zeros(19, np.uint8)
    for k in CODE_LENGTH_ORDER[: 4 + bits(4)]:
        own[k] = bits(3)
    left = 2 + bits(2 + 2 * bits(3)) if bits(1) else size
    table, at, before = table_of(own.tobytes()), 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(table)
        if s < 16:
            lengths[at] = s
            at, before = at + 1, s or before
        else:
            n = 3 + bits(2) if s == 16 else 3 + bits(3) if s == 17 else 11 + bits(7)
            lengths[at : at + n] = before if s == 16 else 0
            at += n
    return lengths


# ---------------------------------------------------------------- pixels, many images at once


def walk(buffer: np.ndarray, bit: np.ndarray, width: np.ndarray, count: np.ndarray, cache_bits: np.ndarray, groups: np.ndarray, first: np.ndarray,
         masks: np.ndarray, flat: np.ndarray, blocks: list[tuple[int, np.ndarray] | None]) -> list[np.ndarray]:
    """Pixels (ARGB) of each image. All images move pixel by pixel together: a step reads a symbol of each that is not copying.

    groups, masks: where the tables of the five codes of each group begin in flat, and
    the bits that they take; first: an image's first group;
    blocks: block bits and the groups of its blocks, where an image has more than one.
    """
    n = len(bit)
    order = np.argsort(-count, kind="stable")
    bit, width, count, cache_bits, first = (x[order].copy() for x in (bit, width, count, cache_bits, first))
    words = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer, strides=(1,))
    most = int(count[0]) if n else 0
    out = np.zeros((n, most), np.uint32)
    copy, distance = np.zeros(n, np.int64), np.ones(n, np.int64)
    cached = bool(cache_bits.any())
    cache = np.zeros((n, 1 << int(cache_bits.max(initial=0))), np.uint32) if cached else None
    shift = (32 - cache_bits).astype(np.uint32)
    copying = 0
    mapped = any(blocks[i] is not None for i in order)
    active = np.searchsorted(-count, -np.arange(most), side="left")
    everyone = np.arange(n)
    for t in range(most):
        a = int(active[t])
        who = np.flatnonzero(copy[:a] == 0) if copying else everyone[:a]
        if len(who):
            at = bit[who]
            group = first[who]
            if mapped:
                for k, i in enumerate(who.tolist()):
                    if (b := blocks[order[i]]) is not None:
                        x, y = t % int(width[i]), t // int(width[i])
                        group[k] = first[i] + b[1][y >> b[0], x >> b[0]]
            code, mask = groups[group], masks[group]
            w = words[at >> 3] >> (at & 7).astype(np.uint64)
            v = flat[code[:, 0] + (w & mask[:, 0]).astype(np.int64)]
            green, used = v >> 4, v & 15
            plain = green < 256
            all_plain = bool(plain.all())
            lit = slice(None) if all_plain else np.flatnonzero(plain)
            w, u = w[lit] >> used[lit].astype(np.uint64), used[lit].astype(np.int64)
            v = flat[code[lit, 1] + (w & mask[lit, 1]).astype(np.int64)]
            red, k = v >> 4, v & 15
            w, u = w >> k.astype(np.uint64), u + k
            v = flat[code[lit, 2] + (w & mask[lit, 2]).astype(np.int64)]
            blue, u = v >> 4, u + (v & 15)
            now = at[lit] + u
            w = words[now >> 3] >> (now & 7).astype(np.uint64)
            v = flat[code[lit, 3] + (w & mask[lit, 3]).astype(np.int64)]
            alpha = v >> 4
            argb = (alpha.astype(np.uint32) << 24) | (red.astype(np.uint32) << 16) | (green[lit].astype(np.uint32) << 8) | blue.astype(np.uint32)
            out[who[lit], t] = argb
            bit[who[lit]] = now + (v & 15)
            if not all_plain:
                rest = np.flatnonzero(~plain)
                bit[who[rest]] = at[rest] + used[rest]
                hit = rest[green[rest] >= 256 + LENGTHS]
                out[who[hit], t] = cache[who[hit], green[hit] - 256 - LENGTHS] if len(hit) else 0
                for k in rest[green[rest] < 256 + LENGTHS].tolist():
                    i = int(who[k])
                    length, bit[i] = _value(words, int(bit[i]), int(green[k]) - 256)
                    v = int(flat[code[k, 4] + (int(words[bit[i] >> 3]) >> int(bit[i] & 7) & int(mask[k, 4]))])
                    far, bit[i] = _value(words, int(bit[i]) + (v & 15), v >> 4)
                    dx, dy = NEAR[far - 1] if far <= len(NEAR) else (far - len(NEAR), 0)
                    distance[i] = max(1, dx + dy * int(width[i])) if far <= len(NEAR) else dx
                    copy[i] = min(length, int(count[i]) - t)
                    copying += 1
        if copying:
            who = np.flatnonzero(copy[:a])
            out[who, t] = out[who, t - distance[who]]
            copy[who] -= 1
            copying -= int((copy[who] == 0).sum())
        if cached:
            pixel = out[:a, t]
            place = np.where(cache_bits[:a] > 0, (pixel * np.uint32(HASH)) >> np.minimum(shift[:a], 31), 0)
            cache[everyone[:a], place] = pixel
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for i, k in enumerate(order.tolist()):
        found[k] = out[i, : count[i]]
    return found, bit[np.argsort(order)]


def _value(words: np.ndarray, at: int, symbol: int) -> tuple[int, int]:
    if symbol < 4:
        return symbol + 1, at
    n = (symbol - 2) >> 1
    extra = int(words[at >> 3]) >> (at & 7) & (1 << n) - 1
    return (2 + (symbol & 1) << n) + extra + 1, at + n


# ---------------------------------------------------------------- headers


class Header:
    """What stands before an image's pixels: transforms in order, cache bits, groups of codes, and its bits."""

    def __init__(self, transforms, cache_bits, codes, blocks, width, bits):
        self.transforms, self.cache_bits, self.codes, self.blocks, self.width, self.bits = transforms, cache_bits, codes, blocks, width, bits


def _image_header(bits: Bits, width: int, height: int, main: bool) -> tuple[int, list, tuple | None]:
    cache_bits = bits(4) if bits(1) else 0
    blocks, groups = None, 1
    if main and bits(1):
        b = bits(3) + 2
        w, h = -(-width // (1 << b)), -(-height // (1 << b))
        image = (_sub_image(bits, w, h) >> 8 & 0xFFFF).astype(np.int64).reshape(h, w)
        blocks, groups = (b, image), int(image.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, s) for s in sizes] for _ in range(groups)]
    return cache_bits, codes, blocks


def _sub_image(bits: Bits, width: int, height: int) -> np.ndarray:
    cache_bits, codes, blocks = _image_header(bits, width, height, False)
    pixels, ends = _walk_all([(bits.data, bits.at, width, width * height, cache_bits, codes, blocks)])
    bits.at = ends[0]
    return pixels[0]


def read_header(data: bytes, at: int, width: int, height: int) -> Header:
    bits, transforms, w = Bits(data, at), [], width
    while bits(1):
        kind = bits(2)
        if kind == 2:
            transforms.append((kind, w, 0, None))
        elif kind == 3:
            n = bits(8) + 1
            table = _sub_image(bits, n, 1).view(np.uint8).reshape(n, 4)
            table = np.cumsum(table, 0, dtype=np.uint8).reshape(-1).view(np.uint32)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, w, pack, table))
            w = -(-w // (1 << pack))
        else:
            b = bits(3) + 2
            bw, bh = -(-w // (1 << b)), -(-height // (1 << b))
            transforms.append((kind, w, b, _sub_image(bits, bw, bh).reshape(bh, bw)))
    cache_bits, codes, blocks = _image_header(bits, w, height, True)
    return Header(transforms, cache_bits, codes, blocks, w, bits.at - at)


def _walk_all(images: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
    """images: (data, bit, width, count, cache bits, codes of each group, blocks)."""
    places: dict[bytes, tuple[int, int]] = {}
    tables: list[np.ndarray] = []
    groups, first, starts, size, at = [], [], [], 0, 0
    seen: dict[int, int] = {}
    for data, _, _, _, _, codes, _ in images:
        starts.append(size)
        size += len(data)
        if id(codes) not in seen:
            seen[id(codes)] = len(groups)
            for g in codes:
                for c in g:
                    if (key := c.tobytes()) not in places:
                        tables.append(table_of(key))
                        places[key] = at, len(tables[-1]) - 1
                        at += len(tables[-1])
                groups.append([places[c.tobytes()] for c in g])
        first.append(seen[id(codes)])
    buffer = np.frombuffer(b"".join([x[0] for x in images]) + bytes(16), np.uint8).copy()
    column = lambda k: np.array([x[k] for x in images], np.int64)
    bit = column(1) + 8 * np.array(starts, np.int64)
    both = np.array(groups, np.int64)
    pixels, ends = walk(buffer, bit, column(2), column(3), column(4), both[..., 0].copy(), np.array(first, np.int64),
                        both[..., 1].astype(np.uint64), np.concatenate(tables), [x[6] for x in images])
    return pixels, ends - 8 * np.array(starts, np.int64)


# ---------------------------------------------------------------- inverse transforms


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """One pixel, channels as int32."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255], np.int32)  # blue, green, red, alpha
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _mean(_mean(left, top_right), top)
    if mode == 6:
        return _mean(left, top_left)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(top_left, top)
    if mode == 9:
        return _mean(top, top_right)
    if mode == 10:
        return _mean(_mean(left, top_left), _mean(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    half = _mean(left, top)
    return np.clip(half + np.fix((half - top_left) / 2).astype(np.int32), 0, 255)


def undo_predictor(pixels: np.ndarray, width: int, block_bits: int, modes: np.ndarray) -> np.ndarray:
    rows = pixels.view(np.uint8).reshape(-1, width, 4).copy()
    modes = modes >> 8 & 15
    rows[0, 0] += np.array([0, 0, 0, 255], np.uint8)
    rows[0] = np.cumsum(rows[0], 0, dtype=np.uint8)
    if (modes == 2).all():
        rows = np.cumsum(rows, 0, dtype=np.uint8)
    elif (modes == 1).all():
        rows[:, 0] = np.cumsum(rows[:, 0], 0, dtype=np.uint8)
        rows[1:] = np.cumsum(rows[1:], 1, dtype=np.uint8)
    else:
        for y in range(1, len(rows)):
            rows[y, 0] += rows[y - 1, 0]
            for x in range(1, width):
                at = [rows[y, x - 1], rows[y - 1, x], rows[y - 1, x - 1], rows[y - 1, x + 1] if x + 1 < width else rows[y, 0]]
                guess = predict(int(modes[y >> block_bits, x >> block_bits]), *[p.astype(np.int32) for p in at])
                rows[y, x] = (rows[y, x] + guess) & 255
    return rows.reshape(-1).view(np.uint32)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5


def undo_cross_colour(pixels: np.ndarray, width: int, block_bits: int, factors: np.ndarray) -> np.ndarray:
    rows = pixels.view(np.uint8).reshape(-1, width, 4).copy()
    y, x = np.arange(len(rows)) >> block_bits, np.arange(width) >> block_bits
    f = np.ascontiguousarray(factors[y][:, x]).view(np.uint8).reshape(len(rows), width, 4)
    green = rows[..., 1]
    rows[..., 2] += _delta(f[..., 0], green).astype(np.uint8)
    rows[..., 0] += (_delta(f[..., 1], green) + _delta(f[..., 2], rows[..., 2])).astype(np.uint8)
    return rows.reshape(-1).view(np.uint32)


def undo_palette(pixels: np.ndarray, width: int, pack: int, table: np.ndarray) -> np.ndarray:
    index = (pixels >> 8 & 255).astype(np.uint8).reshape(-1, -(-width // (1 << pack)))
    if pack:
        each = 8 >> pack
        index = ((index[:, :, None] >> (np.arange(1 << pack, dtype=np.uint8) * each)) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index].reshape(-1)


def undo(pixels: np.ndarray, transforms: list) -> np.ndarray:
    for kind, width, bits, data in reversed(transforms):
        if kind == 0:
            pixels = undo_predictor(pixels, width, bits, data)
        elif kind == 1:
            pixels = undo_cross_colour(pixels, width, bits, data)
        elif kind == 2:
            rows = pixels.view(np.uint8).reshape(-1, 4).copy()
            rows[:, 0] += rows[:, 1]
            rows[:, 2] += rows[:, 1]
            pixels = rows.reshape(-1).view(np.uint32)
        else:
            pixels = undo_palette(pixels, width, bits, data)
    return pixels


#: Headers met before, by their bytes: (header, its bytes but the last, bits of the last, that last byte's bits).
_met: list[tuple[Header, bytes, int, int, tuple[int, int]]] = []


def decode(files: list[bytes]) -> list[np.ndarray]:
    """Pixel arrays (height, width, 4: red, green, blue, alpha) of whole files. Headers alike are read once."""
    images, headers, shapes = [], [], []
    for data in files:
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
        size = int.from_bytes(data[21:25], "little")
        width, height = (size & 0x3FFF) + 1, (size >> 14 & 0x3FFF) + 1
        header = next((h for h, head, n, tail, shape in _met if shape == (width, height if h.transforms else 0) and data.startswith(head, 25) and data[25 + len(head)] & (1 << n) - 1 == tail), None)
        if header is None:
            header = read_header(data, 25 * 8, width, height)
            if all(t[0] != 3 for t in header.transforms) and len(_met) < 64:
                whole, n = divmod(header.bits, 8)
                _met.append((header, data[25 : 25 + whole], n, data[25 + whole] & (1 << n) - 1, (width, height if header.transforms else 0)))
        headers.append(header)
        shapes.append((height, width))
        images.append((data, 200 + header.bits, header.width, header.width * height, header.cache_bits, header.codes, header.blocks))
    if not images:
        return []
    found = []
    for pixels, header, (height, width) in zip(_walk_all(images)[0], headers, shapes, strict=True):
        found.append(undo(np.ascontiguousarray(pixels), header.transforms).view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]])
    return found


# ---------------------------------------------------------------- writing


def lengths_of(weights: list[float]) -> np.ndarray:
    """Huffman code lengths."""
    heap = [(w, i, [i]) for i, w in enumerate(weights) if w > 0]
    lengths = np.zeros(len(weights), np.uint8)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        lengths[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return lengths


def text_weights() -> list[float]:
    """A rule for how often bytes of prose come: letters by rank, then space, signs and bytes of other scripts."""
    weights = [1.0] * 256
    for rank, c in enumerate("etaoinshrdlucmfwypvbgkjqxz"):
        weights[ord(c)] = 250 / (rank + 2.5)
        weights[ord(c.upper())] = 4.0
    for c in "0123456789.,;:!?-\n\"'|()":
        weights[ord(c)] = 5.0
    for b in range(128, 256):
        weights[b] = 2.0
    weights[32], weights[0] = 140.0, 6.0
    return weights


class Writer:
    def __init__(self):
        self.values, self.sizes = [], []

    def __call__(self, value: int, n: int) -> None:
        if n:
            self.values.append(value)
            self.sizes.append(n)

    def code(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 2 and (not used or used[-1] < 256):
            self(1, 1)
            self(max(len(used) - 1, 0), 1)
            self(1, 1)
            for s in used or [0]:
                self(s, 8)
            return
        self(0, 1)
        own = lengths_of([float((lengths == i).sum()) for i in range(16)])
        if not own.any():  # one length alone would take no bits; two symbols keep it plain
            own[[int(lengths[0]), (int(lengths[0]) + 1) % 16]] = 1
        own = np.concatenate([own, np.zeros(3, np.uint8)])
        if own.max() > 7:
            own[:16], own[16:] = 4, 0
        self(15, 4)
        for k in CODE_LENGTH_ORDER:
            self(int(own[k]), 3)
        self(0, 1)
        codes = codes_of(own)
        for n in lengths.tolist():
            self(int(codes[n]), int(own[n]))


#: Bits of the colour cache; pixels across; pixels of a tile at most.
CACHE, WIDTH, TILE = 8, 16, 1024
#: Bytes of texts whose tiles are read together.
AT_ONCE = 12_000_000
#: Factors of the cross-colour transform that the writer uses: green to red, green to blue, red to blue.
FACTORS = (8, 248, 4)


_profiles: dict = {}


def profile(kind: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Header of a kind of tile (values, sizes), and (codes, lengths) of green, red, blue, alpha. Kinds: 0 text with cache and copies, 1 and 2 predicted from the left and from above, 3 cross-colour."""
    if kind not in _profiles:
        _profiles[kind] = _profile(kind)
    return _profiles[kind]


def _profile(kind: int) -> tuple:
    w, plain = Writer(), kind == 0

    def single(argb: int) -> None:
        w(0, 1)
        for shift in (8, 16, 0, 24):
            w.code(np.eye(1, 256, argb >> shift & 255, dtype=np.uint8)[0])
        w.code(np.eye(1, DISTANCES, 0, dtype=np.uint8)[0])

    if kind:
        w(1, 1)
        w({1: 0, 2: 0, 3: 1}[kind], 2)
        w(7, 3)  # blocks of 512: one for a tile
        single(kind << 8 if kind < 3 else FACTORS[2] << 16 | FACTORS[1] << 8 | FACTORS[0])
    w(0, 1)
    w(int(plain), 1)
    if plain:
        w(CACHE, 4)
    w(0, 1)
    flat = np.full(256, 8, np.uint8)
    text = lengths_of(text_weights())
    green = lengths_of([*text_weights(), *[1.0] * LENGTHS, *[1.5] * (1 << CACHE)]) if plain else np.concatenate([flat, np.zeros(LENGTHS, np.uint8)])
    lengths = [green, *[text if plain else flat] * 3, np.eye(1, DISTANCES, 1, dtype=np.uint8)[0]]
    for own in lengths:
        w.code(own)
    return np.array(w.values, np.uint64), np.array(w.sizes, np.int64), [(codes_of(x).astype(np.uint64), x.astype(np.int64)) for x in lengths[:4]]


def riff(body: bytes) -> bytes:
    pad = len(body) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(pad)


def _sizes(height: int) -> bytes:
    return b"\x2f" + struct.pack("<I", (WIDTH - 1) | (height - 1) << 14 | 1 << 28)


def write_palette(pixels: np.ndarray, colours: np.ndarray) -> bytes:
    """A tile of at most four colours: colour table, packed indices."""
    w = Writer()
    w(1, 1)
    w(3, 2)
    w(len(colours) - 1, 8)
    steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.int64)  # blue, green, red, alpha
    pack = 3 if len(colours) <= 2 else 2
    index = np.searchsorted(colours, pixels).reshape(-1, WIDTH // (1 << pack), 1 << pack)
    packed = (index << (np.arange(1 << pack) * (8 >> pack))).sum(2).reshape(-1)

    def image(channels: list[np.ndarray], main: bool) -> None:
        w(0, 1)
        if main:
            w(0, 1)
        codes = []
        for c in channels:
            lengths = lengths_of(np.bincount(c, minlength=256).astype(float).tolist())
            if (lengths > 0).sum() == 0:
                lengths[c[0]] = 1
            full = np.concatenate([lengths, np.zeros(LENGTHS, np.uint8)]) if not codes else lengths
            w.code(full)
            codes.append((codes_of(lengths), lengths if (lengths > 0).sum() > 1 else np.zeros(256, np.uint8)))
        w.code(np.eye(1, DISTANCES, 0, dtype=np.uint8)[0])
        for pixel in zip(*channels, strict=True):
            for (code, length), v in zip(codes, pixel, strict=True):
                w(int(code[v]), int(length[v]))

    image([steps[:, 1], steps[:, 2], steps[:, 0], steps[:, 3]], False)
    w(0, 1)
    zero = np.zeros(len(packed), np.int64)
    image([packed, zero, zero, zero], True)
    total, at = 0, 0
    for v, n in zip(w.values, w.sizes, strict=True):
        total |= int(v) << at
        at += n
    return riff(_sizes(len(pixels) // WIDTH) + total.to_bytes(at + 7 >> 3, "little"))


def encode(tiles: list[bytes]) -> list[bytes]:
    """A file for each tile, of a positive multiple of 64 bytes and TILE pixels at most; four bytes are a pixel's red, green, blue, alpha.

    Tiles of up to four colours take the palette transform. Of the others, by their
    checksum, one in eight each is predicted from the left, from above, or cross-coloured;
    the rest hold prose codes, colour-cache hits and, for equal pixels at the end, a copy.
    """
    out: list[bytes] = [b""] * len(tiles)
    kinds = np.array([min(zlib.crc32(t) & 7, 4) for t in tiles])
    rows = [np.frombuffer(t, np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]] for t in tiles]
    for i, r in enumerate(rows):
        pixels = np.ascontiguousarray(r).reshape(-1).view(np.uint32)
        if pixels[0] == pixels[-1] or len(pixels) <= 64:
            colours = np.unique(pixels)
            if len(colours) <= 4:
                out[i], kinds[i] = write_palette(pixels, colours), -1
    for kind in range(4):
        own = np.flatnonzero(kinds == (kind or 4)).tolist() + (np.flatnonzero(kinds == 0).tolist() if kind == 0 else [])
        if own:
            for i, data in zip(own, _write(kind, [rows[i] for i in own]), strict=True):
                out[i] = data
    return out


def _forward(kind: int, r: np.ndarray) -> np.ndarray:
    r = r.reshape(-1, WIDTH, 4)
    if kind in (1, 2):
        out = r.copy()
        out[0, 1:] -= r[0, :-1]
        out[0, 0] -= np.array([0, 0, 0, 255], np.uint8)
        if kind == 1:
            out[1:, 0] -= r[:-1, 0]
            out[1:, 1:] -= r[1:, :-1]
        else:
            out[1:] -= r[:-1]
        return out.reshape(-1, 4)
    if kind == 3:
        out = r.copy()
        f = [np.full(1, x, np.uint8) for x in FACTORS]
        out[..., 2] -= _delta(f[0], r[..., 1]).astype(np.uint8)
        out[..., 0] -= (_delta(f[1], r[..., 1]) + _delta(f[2], r[..., 2])).astype(np.uint8)
        return out.reshape(-1, 4)
    return r.reshape(-1, 4)


def _write(kind: int, rows: list[np.ndarray]) -> list[bytes]:
    head, head_sizes, codes = profile(kind)
    heights = [len(r) // WIDTH for r in rows]
    n = np.array([len(r) for r in rows], np.int64)
    raw = np.concatenate([_forward(kind, r) for r in rows])
    ends = np.cumsum(n)
    starts = ends - n
    image = np.repeat(np.arange(len(rows)), n)
    value, size = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint64)
    for c, k in enumerate((1, 2, 0, 3)):  # a pixel's four codes stand one above the other: 44 bits at most
        value |= codes[c][0][raw[:, k]] << size
        size += codes[c][1].astype(np.uint64)[raw[:, k]]
    values, sizes = value, size.astype(np.int64)
    tail = np.zeros(len(rows), np.int64)
    if kind == 0:
        pixels = np.ascontiguousarray(raw).reshape(-1).view(np.uint32)
        place = (pixels * np.uint32(HASH)) >> np.uint32(32 - CACHE)
        order = np.argsort(image * (1 << CACHE) + place, kind="stable")
        again = np.zeros(len(pixels), bool)
        same = (image[order][1:] == image[order][:-1]) & (place[order][1:] == place[order][:-1]) & (pixels[order][1:] == pixels[order][:-1])
        again[order[1:][same]] = True
        values[again], sizes[again] = codes[0][0][280 + place[again]], codes[0][1][280 + place[again]]
        change = np.concatenate([[True], (pixels[1:] != pixels[:-1]) | (image[1:] != image[:-1])])
        run = np.maximum.accumulate(np.where(change, np.arange(len(pixels)), 0))[ends - 1]
        tail = np.where(ends - run > 4, ends - run - 1, 0)
        copied = np.arange(len(pixels)) >= np.repeat(ends - tail, n)
        sizes[copied] = 0
        values[copied] = 0
        for i in np.flatnonzero(tail).tolist():  # a copy of the pixel before: length symbol and its extra bits; the distance code has one symbol
            v = int(tail[i]) - 1
            symbol, extra, extra_size = v, 0, 0
            if v >= 4:
                top = v.bit_length() - 1
                second = v >> (top - 1) & 1
                extra_size = top - 1
                symbol, extra = 2 * top + second, v & (1 << extra_size) - 1
            at = ends[i] - tail[i]
            values[at] = int(codes[0][0][256 + symbol]) | extra << int(codes[0][1][256 + symbol])
            sizes[at] = codes[0][1][256 + symbol] + extra_size
    h = len(head)
    total = h + n + 1
    offset = np.cumsum(total) - total
    value, size = np.zeros(int(total.sum()), np.uint64), np.zeros(int(total.sum()), np.int64)
    at = offset[:, None] + np.arange(h)
    value[at], size[at] = head, head_sizes
    at = np.repeat(offset + h - starts, n) + np.arange(len(raw))
    value[at], size[at] = values, sizes
    whole = np.add.reduceat(size, offset)
    size[offset + total - 1] = -whole % 8
    bit = np.cumsum(size) - size
    word, within = bit >> 6, (bit & 63).astype(np.uint64)
    low = value << within
    cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    packed = np.zeros(int(bit[-1] >> 6) + 2, np.uint64)
    packed[word[cut]] = np.add.reduceat(low, cut)
    over = np.flatnonzero((bit & 63) + size > 64)
    packed[word[over] + 1] += value[over] >> (np.uint64(64) - within[over])
    data = packed.tobytes()
    first = (bit[offset] >> 3).tolist()
    last = ((bit[offset + total - 1] + size[offset + total - 1]) >> 3).tolist()
    return [riff(_sizes(height) + data[a:b]) for height, a, b in zip(heights, first, last, strict=True)]


# ---------------------------------------------------------------- the operator


def _media(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    step = TILE * 4
    for part in parts:
        held, size = [], 0
        for id_, text in zip(part["id"], part["text"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            held.append((id_, raw))
            size += len(raw)
            if size > AT_ONCE:
                yield _stored_and_read(held, step)
                held, size = [], 0
        if held:
            yield _stored_and_read(held, step)


def _stored_and_read(held: list[tuple], step: int) -> pd.DataFrame:
    tiles, counts = [], []
    for _, raw in held:
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        own = [payload[i : i + step] for i in range(0, len(payload), step)]
        tiles += own
        counts.append(len(own))
    files = [f for i in range(0, len(tiles), 1000) for f in encode(tiles[i : i + 1000])]
    pixels = decode(files)
    rows, at = [], 0
    for (id_, raw), n in zip(held, counts, strict=True):
        rows.append((id_, len(raw), b"".join(files[at : at + n]), b"".join(p.tobytes() for p in pixels[at : at + n])))
        at += n
    return pd.DataFrame(rows, columns=["id", "n_bytes", "media", "payload"])


def media(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, media, payload): each text as lossless WebP files, and the bytes read back from them.

    A text is cut in tiles of TILE pixels; each is a file, and they stand one after another
    (a file says its length). Tiles of many texts are decoded together, pixel by pixel, so
    a very long text costs no more than others. Null texts are empty; an empty text is one
    tile of zeros. Ties and repeated rows give equal values. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(_media, f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary, payload binary")


def features(payload: bytes) -> str:
    """Of 8-bit samples: their number, sum and sum of squares, then the counts of their high halves."""
    samples = np.frombuffer(payload, np.uint8)
    high = np.bincount(samples >> 4, minlength=16)
    return ",".join(map(str, [len(samples), int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum()), *high.tolist()]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({
                "doc_id": part["id"], "n_bytes": part["n_bytes"], "payload_bytes": [len(p) for p in part["payload"]],
                "payload_sha256": [hashlib.sha256(p).hexdigest() for p in part["payload"]],
                "tail_crc32": [zlib.crc32(p[-64:]) for p in part["payload"]],
                "media_bytes": [len(m) for m in part["media"]], "media_sha256": [hashlib.sha256(m).hexdigest() for m in part["media"]],
                "feature": [features(p) for p in part["payload"]]})

    rows = media(read(spark, sf_dir, "documents"), "doc_id", "text")
    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(digests, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
