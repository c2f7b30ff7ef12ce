"""Lossless WebP (VP8L, RFC 9649): a decoder to pixel arrays, and the encoder that stores bytes as images.

The decoder reads every part of the format: simple and normal prefix codes, groups of them by a meta
image, back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette
transforms (with bundled pixels). Pixel data with a varying green channel only, and groups that change
with rows only, as the encoder here and palette images have it, is decoded with numpy for all bit
offsets at once (through a cache: pixel by pixel); other data is decoded symbol by symbol.
"""

from __future__ import annotations

import re
import struct
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# fmt: off
NEAR = (  # (x, y) of the first 120 distance codes
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
# fmt: on
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE = 1 << 14
OPAQUE_BLACK = 0xFF000000
WINDOW = 1 << 19


class Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + b"\0" * 8, 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        if n and at + n > self.size:
            raise ValueError("the image ends too early")
        self.at = at + n
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & (1 << n) - 1


@cache
def reversed_bits(n: int) -> np.ndarray:
    """All numbers of n bits, read backwards."""
    out = np.zeros(1, "i8")
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


REVERSED_7 = reversed_bits(7).tolist()


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes (bit-reversed, as they stand in the stream) of code lengths, along the last axis."""
    order = np.argsort(lengths, -1, kind="stable")
    sizes = np.take_along_axis(lengths, order, -1).astype("i8")
    room = (1 << 15 - sizes) * (sizes > 0)
    codes = np.empty(lengths.shape, "i8")
    np.put_along_axis(codes, order, reversed_bits(15)[np.cumsum(room, -1) - room & 0x7FFF] * (sizes > 0), -1)
    return codes


class Code:
    """A prefix code as tables over the next 15 bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else None if len(used) else 0
        if self.only is None:
            n = lengths[used].astype("i8")
            if (1 << 15 - n).sum() != 1 << 15:
                raise ValueError("a prefix code is not complete")
            self.bits = int(n.max())
            self.mask = (1 << self.bits) - 1
            order = np.argsort(n, kind="stable")
            place = np.repeat(used[order], 1 << self.bits - n[order])[reversed_bits(self.bits)]
            self.symbols, self.lengths = place, lengths[place]
            self.both = place << 4 | self.lengths

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        at = bits.at
        peek = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & self.mask
        bits.at = at + int(self.lengths[peek])
        if bits.at > bits.size:
            raise ValueError("the image ends too early")
        return int(self.symbols[peek])


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise ValueError("a symbol beyond its alphabet")
        return only(symbols[0]) if len({*symbols}) == 1 else Code(np.isin(np.arange(alphabet), symbols).astype("i1"))
    n, first = 4 + bits.read(4), [0] * 19
    packed = bits.read(3 * n) if n <= 17 else bits.read(51) | bits.read(3 * n - 51) << 51
    for i in range(n):
        first[CODE_LENGTH_ORDER[i]] = packed >> 3 * i & 7
    table, sizes = small_table(first)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, before, data, at, mask = bytearray(), 8, bits.data, bits.at, len(table) - 1
    while len(lengths) < alphabet and most and at <= bits.size:
        most -= 1
        byte = at >> 3
        peek = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (at & 7)
        s = table[peek & mask]
        k = sizes[s]
        at += k
        if s < 16:
            lengths.append(s)
            before = s or before
            continue
        peek >>= k
        if s == 16:
            n, value = 3 + (peek & 3), before
            at += 2
        elif s == 17:
            n, value = 3 + (peek & 7), 0
            at += 3
        else:
            n, value = 11 + (peek & 127), 0
            at += 7
        lengths += bytes([value]) * n
        if len(lengths) > alphabet:
            raise ValueError("too many code lengths")
    if at > bits.size:
        raise ValueError("the image ends too early")
    bits.at = at
    return Code(np.frombuffer(bytes(lengths).ljust(alphabet, b"\0"), "i1"))


def small_table(lengths: list[int]) -> tuple[list[int], list[int]]:
    """Of few symbols: which one each number of 7 bits begins with, and their bits."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [used[0][1] if used else 0], [0] * len(lengths)
    if sum(128 >> n for n, _ in used) != 128:
        raise ValueError("a prefix code is not complete")
    table, at = [0] * 128, 0
    for n, s in used:
        k = 128 >> n
        table[REVERSED_7[at] :: 1 << n] = [s] * k
        at += k
    return table, lengths


@cache
def only(symbol: int) -> Code:
    lengths = np.zeros(symbol + 1, "i1")
    lengths[symbol] = 1
    return Code(lengths)


def _value(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out, at: int, distance: int, n: int):
    if distance > at:
        raise ValueError("a back-reference before the image")
    out[at : at + n] = out[at - 1] if distance == 1 else np.resize(out[at - distance : at], n)


def cache_places(bits: int, rest: int) -> np.ndarray:
    """Where the colour cache has pixels of each green value."""
    return np.array([(CACHE_MULTIPLIER * (rest | g << 8) & 0xFFFFFFFF) >> 32 - bits for g in range(256)])


def jumps(after: np.ndarray, end: int, begin: int = 0) -> np.ndarray:
    """The places before `end` reached from begin by going on to after[place]: every eighth by a walk, the others from those."""
    hop = after
    for _ in range(3):
        hop = hop.take(hop)
    walk, p, jump = [], begin, memoryview(np.ascontiguousarray(hop))
    while p < end:
        walk.append(p)
        q = jump[p]
        if q <= p:
            break
        p = q
    places = np.empty((len(walk), 8), after.dtype)
    places[:, 0] = walk
    for k in range(1, 8):
        places[:, k] = after.take(places[:, k - 1])
    places = places.ravel()
    return places[places < end]


EXTRA = np.array([0, 0, 0, 0, *(s - 2 >> 1 for s in range(4, 40))])
BASE = np.array([1, 2, 3, 4, *((2 + (s & 1) << (s - 2 >> 1)) + 1 for s in range(4, 40))])


def _tokens(bits: Bits, group: list[Code], at: int, stop: int):
    """From pixel `at` on, symbols of which only green has a varying code, until `stop` is reached, by windows: symbols, pixels, distance codes."""
    green, dist = group[0], group[4]
    if green.only is not None and not 256 <= green.only < 280:
        for i in range(at, stop, WINDOW):
            n = min(WINDOW, stop - i)
            yield np.full(n, green.only), np.ones(n, "i8"), np.zeros(n, "i8")
        return
    raw = np.frombuffer(bits.data, "u1")
    while at < stop:
        first = bits.at >> 3
        part = raw[first : first + min(WINDOW // 8, stop - at) + 128].astype("u4")
        words = part.copy()
        words[:-1] |= part[1:] << 8
        words[:-2] |= part[2:] << 16
        limit = 8 * len(part)
        peek = (words[:, None] >> np.arange(8, dtype="u4")[None, :]).ravel()
        if green.only is None:
            both = green.both.take(peek & green.mask)
        else:
            both = np.full(limit, green.only << 4)
        after = np.minimum(np.arange(limit) + (both & 15), limit - 1)
        far = np.flatnonzero((both >= 256 << 4) & (both < 280 << 4))
        if len(far):
            p = after[far] + EXTRA.take((both[far] >> 4) - 256)
            if dist.only is None:
                p += (dist.lengths + EXTRA[dist.symbols]).take(peek.take(np.minimum(p, limit - 17)) & dist.mask)
            else:
                p += EXTRA[dist.only]
            after[far] = np.minimum(p, limit - 1)
        last = first + len(part) == len(raw)
        begin, end = bits.at - 8 * first, bits.size + 1 - 8 * first if last else limit - 512
        places = jumps(after, end, begin)
        if not len(places):
            raise ValueError("the image ends too early")
        got = both[places] >> 4
        sizes, codes, back = np.ones(len(got), "i8"), np.zeros(len(got), "i8"), np.flatnonzero((got >= 256) & (got < 280))
        if len(back):

            def field(p, k):  # up to 16 bits at each of the places p
                return peek[np.minimum(p, limit - 17)].astype("i8") & (1 << k) - 1

            s = got[back] - 256
            p = places[back] + (both[places[back]] & 15)
            sizes[back] = BASE[s] + field(p, EXTRA[s])
            p = p + EXTRA[s]
            if dist.only is None:
                idx = peek[np.minimum(p, limit - 17)] & dist.mask
                d = dist.symbols[idx]
                p = p + dist.lengths[idx]
            else:
                d = np.full(len(p), dist.only, "i8")
            k = EXTRA[d]
            codes[back] = BASE[d] + field(p, np.minimum(k, 16)) + (field(p + 16, np.maximum(k - 16, 0)) << 16)
        ends = at + np.cumsum(sizes)
        keep = int(np.searchsorted(ends, stop)) + 1
        at = int(ends[:keep][-1])
        bits.at = 8 * first + int(after[places[:keep][-1]])
        if bits.at > bits.size:
            raise ValueError("the image ends too early")
        yield got[:keep], sizes[:keep], codes[:keep]


@lru_cache(64)
def near_distances(width: int) -> np.ndarray:
    return np.array([0, *(_distance(k, width) for k in range(1, len(NEAR) + 1))])


def _distances(codes: np.ndarray, width: int) -> np.ndarray:
    """Distances of distance codes; 0 stays."""
    return np.where(codes > len(NEAR), codes - len(NEAR), near_distances(width)[np.minimum(codes, len(NEAR))])


def _fill(out: np.ndarray, at: int, symbols: np.ndarray, sizes: np.ndarray, distances: np.ndarray) -> None:
    """Green values of tokens, without a cache, from `at` on."""
    token = np.repeat(np.arange(len(sizes)), sizes)[: len(out) - at]
    back = distances[token]
    # A copied pixel's source is followed, each time from where the last round came, until it is a literal or stands before `at`.
    source = np.arange(len(token)) - back
    open_ = np.flatnonzero(back)
    while len(open_):
        from_ = source[open_]
        open_ = open_[(from_ >= 0) & (back[np.maximum(from_, 0)] > 0)]
        source[open_] = source[source[open_]]
    new = symbols[token[np.maximum(source, 0)]].astype("u1")
    before = np.flatnonzero(source < 0)
    new[before] = out[at + source[before]]
    out[at : at + len(new)] = new


def _fill_cached(out: np.ndarray, at: int, symbols: np.ndarray, sizes: np.ndarray, distances: np.ndarray, place: list[int], held: list[int]) -> None:
    for s, size, d in zip(symbols.tolist(), sizes.tolist(), distances.tolist(), strict=True):
        if s >= 280:
            s = held[s - 280]
            if s < 0:
                raise ValueError("a place of the colour cache without a pixel of the image's")
        if s < 256:
            out[at] = s
            held[place[s]] = s
        else:
            _copy(out, at, d, min(size, len(out) - at))
            for v in out[at : at + size].tolist():
                held[place[v]] = v
        at += size


def _green_only(bits: Bits, groups: list[list[Code]], rows: list[int] | None, row_bits: int, width: int, n: int, cache_bits: int) -> np.ndarray:
    """Pixels of which only green has a varying code; groups change with rows only."""
    if rows is None:
        ends = [(0, n)]
    else:
        ends = [(g, min(n, (k + 1 << row_bits) * width)) for k, g in enumerate(rows) if k + 1 == len(rows) or rows[k + 1] != g]
    _, red, blue, alpha, _ = groups[0]
    rest = alpha.only << 24 | red.only << 16 | blue.only
    place, held = cache_places(cache_bits, rest).tolist() if cache_bits else [], [-1] * (1 << cache_bits)
    out, at = np.empty(n, "u1"), 0
    for g, stop in ends:
        for symbols, sizes, codes in _tokens(bits, groups[g], at, stop) if at < stop else ():
            distances, until, k = _distances(codes, width), np.cumsum(sizes), 0
            if (distances > at + until - sizes).any():
                raise ValueError("a back-reference before the image")
            begin = at
            while k < len(sizes):  # so many tokens at once that their pixels stay few
                more = min(len(sizes), max(k + 1, int(np.searchsorted(until, at - begin + WINDOW))))
                part = symbols[k:more], sizes[k:more], distances[k:more]
                _fill_cached(out, at, *part, place, held) if cache_bits else _fill(out, at, *part)
                at, k = begin + int(until[more - 1]), more
    argb = out.astype("u4")
    argb <<= 8
    argb |= rest
    return argb


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, row by row, as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, groups_n = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta_width = (width + (1 << meta_bits) - 1) >> meta_bits
        meta = _pixels(bits, meta_width, (height + (1 << meta_bits) - 1) >> meta_bits, False) >> 8 & 0xFFFF
        groups_n = int(meta.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, k) for k in sizes] for _ in range(groups_n)]
    n = width * height
    rows = meta.reshape(-1, meta_width) if meta is not None else None
    if all(c.only is not None and c.only == first.only for group in groups for c, first in zip(group[1:4], groups[0][1:4], strict=True)) and (rows is None or (rows == rows[:, :1]).all()):
        return _green_only(bits, groups, rows if rows is None else rows[:, 0].tolist(), meta_bits, width, n, cache_bits)
    out, at, filled = np.zeros(n, "u4"), 0, 0
    cache = [0] * (1 << cache_bits)

    def fill(to: int) -> None:
        for v in out[filled:to].tolist():
            cache[(CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> 32 - cache_bits] = v

    while at < n:
        if meta is not None:
            y, x = divmod(at, width)
            group = groups[int(meta[(y >> meta_bits) * meta_width + (x >> meta_bits)])]
        else:
            group = groups[0]
        s = group[0].next(bits)
        if s < 256:
            r, b, a = group[1].next(bits), group[2].next(bits), group[3].next(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = _value(s - 256, bits)
            distance = _distance(_value(group[4].next(bits), bits), width)
            length = min(length, n - at)
            _copy(out, at, distance, length)
            at += length
        else:
            fill(at)
            filled = at
            out[at] = cache[s - 280]
            at += 1
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> k & 255 for k in (24, 16, 8, 0)], -1).astype("i4")


def _packed(c: np.ndarray) -> np.ndarray:
    c = c.astype("u4") & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, top_right, top_left):
    """Prediction from four neighbours (tuples of A, R, G, B)."""
    avg = lambda a, b: tuple((x + y) // 2 for x, y in zip(a, b, strict=True))
    clamp = lambda v: min(255, max(0, v))
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return avg(avg(left, top_right), top)
    if mode == 6:
        return avg(left, top_left)
    if mode == 7:
        return avg(left, top)
    if mode == 8:
        return avg(top_left, top)
    if mode == 9:
        return avg(top, top_right)
    if mode == 10:
        return avg(avg(left, top_left), avg(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return tuple(clamp(x + y - z) for x, y, z in zip(left, top, top_left, strict=True))
    if mode == 13:
        return tuple(clamp(m + int((m - z) / 2)) for m, z in zip(avg(left, top), top_left, strict=True))
    return (255, 0, 0, 0)


def _unpredict_green(res: np.ndarray, width: int, height: int, size_bits: int, modes: list[int], across: int) -> np.ndarray:
    out = np.empty((height, width), "u1")
    res = res.reshape(height, width)
    out[0] = np.cumsum(res[0], dtype="u1")
    by_left = {
        5: lambda a, t, r, z: ((a + r >> 1) + t) >> 1,
        6: lambda a, t, r, z: a + z >> 1,
        7: lambda a, t, r, z: a + t >> 1,
        10: lambda a, t, r, z: ((a + z >> 1) + (t + r >> 1)) >> 1,
        11: lambda a, t, r, z: a if abs(t - z) < abs(a - z) else t,
        12: lambda a, t, r, z: min(255, max(0, a + t - z)),
        13: lambda a, t, r, z: min(255, max(0, (a + t >> 1) + int(((a + t >> 1) - z) / 2))),
    }
    for y in range(1, height):
        row, above, left = out[y], out[y - 1].astype("i2"), res[y]
        row[:1] = left[:1] + out[y - 1, :1]
        top_right = np.append(above[1:], row[0])
        of_row = modes[(y >> size_bits) * across :][:across]
        for k, mode in enumerate(of_row):
            a, b = max(1, k << size_bits), min(width, k + 1 << size_bits)
            if a >= b:
                continue
            t, r, z = above[a:b], top_right[a:b], above[a - 1 : b - 1]
            if mode == 1:
                row[a:b] = np.cumsum(left[a:b], dtype="u1") + row[a - 1]
            elif mode in by_left:
                guess, v, new = by_left[mode], int(row[a - 1]), []
                for x, *near in zip(left[a:b].tolist(), t.tolist(), r.tolist(), z.tolist(), strict=True):
                    v = x + guess(v, *near) & 255
                    new.append(v)
                row[a:b] = new
            else:
                guess = t if mode == 2 else r if mode == 3 else z if mode == 4 else z + t >> 1 if mode == 8 else t + r >> 1 if mode == 9 else 0
                row[a:b] = (left[a:b] + guess) & 255
    return out.ravel()


def _unpredict(argb: np.ndarray, width: int, height: int, size_bits: int, modes: np.ndarray) -> np.ndarray:
    across = (width + (1 << size_bits) - 1) >> size_bits
    modes = (modes >> 8 & 15).tolist()
    if not (argb & 0xFFFF00FF).any():  # green only: every mode predicts an opaque pixel without red and blue
        return OPAQUE_BLACK | _unpredict_green((argb >> 8).astype("u1"), width, height, size_bits, modes, across).astype("u4") << 8
    res = [tuple(p) for p in _channels(argb).tolist()]
    out: list = []
    for i, p in enumerate(res):
        y, x = divmod(i, width)
        if i == 0:
            guess = (255, 0, 0, 0)
        elif y == 0:
            guess = out[-1]
        elif x == 0:
            guess = out[i - width]
        else:
            guess = predict(modes[(y >> size_bits) * across + (x >> size_bits)], out[-1], out[i - width], out[i - width + 1], out[i - width - 1])
        out.append(tuple(a + b & 255 for a, b in zip(p, guess, strict=True)))
    return _packed(np.array(out, "i4").reshape(-1, 4))


def _uncross(argb: np.ndarray, width: int, height: int, size_bits: int, factors: np.ndarray) -> np.ndarray:
    across = (width + (1 << size_bits) - 1) >> size_bits
    y, x = np.divmod(np.arange(width * height), width)
    f = _channels(factors)[(y >> size_bits) * across + (x >> size_bits)].astype("i1").astype("i4")
    c = _channels(argb)
    signed = lambda v: (v & 255).astype("i1").astype("i4")
    c[:, 1] += f[:, 3] * signed(c[:, 2]) >> 5
    c[:, 3] += f[:, 2] * signed(c[:, 2]) >> 5
    c[:, 3] += f[:, 1] * signed(c[:, 1]) >> 5
    return _packed(c)


def _unpalette(argb: np.ndarray, width: int, height: int, bits: int, table: np.ndarray) -> np.ndarray:
    index = (argb >> 8 & 255).reshape(height, -1)
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = (index[:, :, None] >> each * np.arange(per, dtype="u4") & (1 << each) - 1).reshape(height, -1)[:, :width]
    full = np.zeros(256, "u4")
    full[: len(table)] = table
    return full[index.ravel()]


def decode_stream(data: bytes) -> tuple[int, int, np.ndarray]:
    """width, height, ARGB numbers (u32, row by row) of a VP8L chunk."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, wide, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            k = bits.read(3) + 2
            sub = _pixels(bits, (wide + (1 << k) - 1) >> k, (height + (1 << k) - 1) >> k, False)
            undo.append((_unpredict if kind == PREDICTOR else _uncross, wide, k, sub))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _packed(np.cumsum(_channels(_pixels(bits, n, 1, False)), 0))
            k = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((_unpalette, wide, k, table))
            wide = (wide + (1 << k) - 1) >> k
        else:
            undo.append((None, wide, 0, None))
    argb = _pixels(bits, wide, height, True)
    for f, w, k, sub in reversed(undo):
        if f:
            argb = f(argb, w, height, k, sub)
        else:
            green = argb >> 8 & 255
            argb = argb & 0xFF00FF00 | ((argb >> 16) + green & 255) << 16 | argb + green & 255
    return width, height, argb


def decode(raw: bytes) -> list[tuple[int, int, np.ndarray]]:
    """Images of one or more RIFF files, one after the other; chunks beside the lossless one (an extended header, profiles, metadata) are passed over."""
    images, at = [], 0
    while at < len(raw):
        riff, size, kind = struct.unpack_from("<4sI4s", raw, at) if len(raw) >= at + 12 else (b"", 0, b"")
        if (riff, kind) != (b"RIFF", b"WEBP"):
            raise ValueError("not a WebP file")
        end, inner = min(len(raw), at + 8 + size), at + 12
        found = None
        while found is None and inner + 8 <= end:
            chunk, length = struct.unpack_from("<4sI", raw, inner)
            if chunk == b"VP8L":
                found = decode_stream(raw[inner + 8 : inner + 8 + length])
            inner += 8 + length + (length & 1)
        if found is None:
            raise ValueError("no lossless image in a WebP file")
        images.append(found)
        at += 8 + size + (size & 1)
    return images


# The encoder: bytes as grey samples, one pixel each.

#: Pixels of an image at most, and of the images that are encoded together; so a match reaches back no further.
IMAGE_PIXELS = 1 << 19
BATCH_PIXELS = 1 << 17
FARTHEST = (1 << 20) - 120
LONGEST = 4096
SHORTEST = 5
#: Pixels of references that are compared at once.
COMPARED = 1 << 18
#: Blocks of the predictor have 64 x 64 pixels.
MODE_BITS = 6
#: Sizes of colour cache that are tried, in bits. Places that few grey values share only rename literals: 2 to 4 bits were never the best for 8,000 texts.
CACHES = (1,)
#: Bits of a code: longer ones save next to nothing and make the decoder's tables large.
MOST_BITS = 11
#: Tokens from which groups of prefix codes are tried; fewer save less than a second code takes.
GROUP_TOKENS = 2048
GREEN, DISTANCES = 280 + (1 << CACHES[-1]), 40
# A code's estimated cost is its symbols' entropy and this many bits for each used symbol.
SYMBOL_BITS = 4


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a complete prefix code (one used symbol: length 1, which stands for no bits)."""
    lengths, used = np.zeros(len(counts), "i1"), np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[counts[used].argsort(kind="stable")]
    lengths[order] = tree_depths(counts[order].tolist(), most)
    return lengths


def tree_depths(weights: list[int], most: int) -> list[int]:
    """Depths of a Huffman tree's leaves, given in ascending order; where one is too deep, weights are halved."""
    n = len(weights)
    while True:
        # The least two are among the next leaves and the next sums, both in ascending order.
        parent, sums, leaf, inner = [0] * (2 * n - 1), [], 0, 0
        for free in range(n - 1):
            if leaf < n and (inner >= free or weights[leaf] <= sums[inner]):
                total = weights[leaf]
                parent[leaf] = free
                leaf += 1
            else:
                total = sums[inner]
                parent[n + inner] = free
                inner += 1
            if leaf < n and (inner >= free or weights[leaf] <= sums[inner]):
                total += weights[leaf]
                parent[leaf] = free
                leaf += 1
            else:
                total += sums[inner]
                parent[n + inner] = free
                inner += 1
            sums.append(total)
        depth = [0] * (n - 1)
        for i in range(n - 3, -1, -1):
            depth[i] = depth[parent[n + i]] + 1
        depths = [depth[p] + 1 for p in parent[:n]]
        if depths[0] <= most:
            return depths
        weights = [w + 1 >> 1 for w in weights]


class Fields:
    """Values and their numbers of bits, in the order of the stream."""

    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)


def packed_words(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Fields (33 bits at most) one after the other, least significant bit first, in words of 32 bits."""
    ends = np.cumsum(sizes)
    at = ends - sizes
    word, shifted = at >> 5, values.astype("u8") << (at & 31).astype("u8")
    n = (int(ends[-1]) >> 5) + 2
    # Bits of a word are disjoint, so its sum is exact in a double.
    words = np.bincount(word, weights=shifted & 0xFFFFFFFF, minlength=n)
    words[1:] += np.bincount(word, weights=shifted >> 32, minlength=n)[:-1]
    return words.astype("<u4").tobytes()


RUNS = re.compile(b"|".join([rb"\0{1,138}", *(re.escape(bytes([n])) + b"{1,7}" for n in range(1, 16))]), re.S)


@cache
def run_tokens(run: bytes) -> tuple:
    """How equal code lengths in a row are written: symbols, extra bits' values and numbers."""
    n = len(run)
    if run[0]:
        return ((run[0], 0, 0), (16, n - 4, 2)) if n > 3 else ((run[0], 0, 0),) * n
    return ((18, n - 11, 7),) if n > 10 else ((17, n - 3, 3),) if n > 2 else ((0, 0, 0),) * n


def small_code(counts: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Codes and lengths (up to 7) of few symbols."""
    ascending = sorted((n, s) for s, n in enumerate(counts) if n)
    sizes, codes, code, last = [0] * len(counts), [0] * len(counts), 0, 0
    for (_, s), n in zip(ascending, tree_depths([n for n, _ in ascending], 7) if len(ascending) > 1 else [1], strict=True):
        sizes[s] = n
    for n, s in sorted((n, s) for s, n in enumerate(sizes) if n):
        code <<= n - last
        codes[s], last = REVERSED_7[code << 7 - n], n
        code += 1
    return codes, sizes


def write_only(out: Fields, symbol: int) -> None:
    """A code of one symbol below 256."""
    out.put(1 | (symbol > 1) << 2, 3)
    out.put(symbol, 8 if symbol > 1 else 1)


def write_code(out: Fields, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        return write_only(out, int(used[0]) if len(used) else 0)
    tokens = [t for run in RUNS.findall(lengths.tobytes()) for t in run_tokens(run)]
    counts = [0] * 19
    for t in tokens:
        counts[t[0]] += 1
    codes, sizes = small_code(tuple(counts))
    order = [sizes[s] for s in CODE_LENGTH_ORDER]
    while len(order) > 4 and not order[-1]:
        order.pop()
    out.put(len(order) - 4 << 1, 5)
    out.values += order
    out.sizes += [3] * len(order)
    out.put(0, 1)
    if sum(map(bool, counts)) == 1:
        sizes = [0] * len(counts)
    out.values += [codes[s] | extra << sizes[s] for s, extra, _ in tokens]
    out.sizes += [sizes[s] + k for s, _, k in tokens]
    return None


def usable(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and bits of the symbols of each row as they stand in the stream, flat; a lone symbol takes none."""
    lengths = lengths * (np.count_nonzero(lengths, -1) > 1)[:, None]
    return canonical(lengths).ravel(), lengths.ravel().astype("i8")


def write_small(out: Fields, values: list[int]) -> None:
    """A sub-image whose green channel has the values: without a cache, references or groups."""
    lengths = code_lengths(np.bincount(values, minlength=280), 15)
    codes, sizes = (x.tolist() for x in usable(lengths[None]))
    out.put(0, 1)
    write_code(out, lengths)
    for _ in range(4):
        write_only(out, 0)
    for v in values:
        out.put(codes[v], sizes[v])


def prefix_symbols(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra bits' values and numbers of length or distance codes."""
    v = n.astype("i8") - 1
    top = np.maximum(np.frexp(v.astype("f8"))[1] - 1, 1).astype("i8")
    small, extra = v < 4, top - 1
    return np.where(small, v, 2 * top + (v >> extra & 1)), np.where(small, 0, v & (1 << extra) - 1), np.where(small, 0, extra)


def extra_bits_of(n: np.ndarray) -> np.ndarray:
    return np.maximum(np.frexp((n - 1).astype("f4"))[1] - 2, 0)


@lru_cache(64)
def near_codes(width: int) -> np.ndarray:
    out = np.zeros(8 * width + 9, "i8")
    for k in range(len(NEAR), 0, -1):
        out[_distance(k, width)] = k
    return out


def distance_codes(distances: np.ndarray, width: int) -> np.ndarray:
    """The least code of each distance: that of a near pixel, by columns and rows, where there is one."""
    near = near_codes(width)
    found = near[np.minimum(distances, len(near) - 1)] * (distances < len(near))
    return np.where(found, found, distances + len(NEAR))


def _weighed(counts: np.ndarray) -> np.ndarray:
    c = counts.astype("f4")
    return c * np.log2(np.maximum(c, 1)) - SYMBOL_BITS * (c > 0)


WEIGHED = _weighed(np.arange(1 << 13))


def entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of all symbols, along the last axis, with those that a code's description takes."""
    total = counts.sum(-1).astype("f4")
    small = counts.size and counts.max() < len(WEIGHED)
    return total * np.log2(np.maximum(total, 1)) - (WEIGHED.take(counts) if small else _weighed(counts)).sum(-1)


def predictions(values: np.ndarray, width: int):
    """For each mode, what it predicts for the pixels of one channel (i2); the first row and column are the caller's."""
    v = np.concatenate([np.zeros(width + 1, "i2"), values.astype("i2")])
    n = len(values)
    left, top, top_right, top_left = v[width : width + n], v[1 : n + 1], v[2 : n + 2], v[:n]
    yield np.zeros(n, "i2")
    yield left
    yield top
    yield top_right
    yield top_left
    yield ((left + top_right >> 1) + top) >> 1
    yield left + top_left >> 1
    average = left + top >> 1
    yield average
    yield top_left + top >> 1
    yield top + top_right >> 1
    yield ((left + top_left >> 1) + (top + top_right >> 1)) >> 1
    yield np.where(np.abs(top - top_left) < np.abs(left - top_left), left, top)
    yield np.clip(left + top - top_left, 0, 255)
    d = average - top_left
    yield np.clip(average + (d + (d < 0) >> 1), 0, 255)


def predicted(values: np.ndarray, sizes: list[int], width: int) -> list[tuple[np.ndarray, list[int]] | None]:
    """Of images one after the other: what is left of the pixels and the mode of each block, where that promises to be smaller."""
    n, at = len(values), np.arange(len(values))
    image = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    x, y = at % width, (at - begin) // width
    across = (width + (1 << MODE_BITS) - 1) >> MODE_BITS
    blocks = [across * ((size // width + (1 << MODE_BITS) - 1) >> MODE_BITS) for size in sizes]
    first = np.cumsum(blocks) - blocks
    block, n_blocks = first[image] + (y >> MODE_BITS) * across + (x >> MODE_BITS), sum(blocks)
    edge = np.flatnonzero((x == 0) | (y == 0))
    at_edge = np.where(y[edge] == 0, values[edge - 1], values[edge - width])
    at_edge[at[edge] == begin[edge]] = 0
    left, cost, left_at_edge = np.empty((14, n), "u1"), np.empty((14, n_blocks), "i8"), values[edge] - at_edge
    columns = np.arange(0, width, 1 << MODE_BITS)
    # Runs of a block's rows: where an image or a row of blocks begins.
    strips = np.flatnonzero((y[::width] & (1 << MODE_BITS) - 1) == 0)
    for mode, guess in enumerate(predictions(values, width)):
        np.subtract(values, guess, out=left[mode], casting="unsafe")
        left[mode, edge] = left_at_edge
        size = np.minimum(left[mode], -left[mode]).reshape(-1, width)
        cost[mode] = np.add.reduceat(np.add.reduceat(size, columns, axis=1, dtype="i4"), strips, axis=0).ravel()
    # The mode of the least differences, unless a block's values themselves have less entropy.
    modes = cost[1:].argmin(0) + 1
    moved = left[modes[block], at]
    plain, other = (entropy(np.bincount((block << 8) + v, minlength=256 * n_blocks).reshape(n_blocks, 256)) for v in (left[0], moved))
    modes[plain <= other] = 0
    residual = np.where((plain <= other)[block], left[0], moved)
    whole = [entropy(np.bincount(image * 256 + v, minlength=256 * len(sizes)).reshape(-1, 256)) for v in (values, residual)]
    better = whole[1] + 4 * np.array(blocks) + 40 < whole[0]
    found: list = [None] * len(sizes)
    for i in np.flatnonzero(better).tolist():
        b = int(first[i])
        a = sum(sizes[:i])
        found[i] = residual[a : a + sizes[i]], modes[b : b + blocks[i]].tolist()
    return found


class Stream(NamedTuple):
    """Pixels of one channel as they are coded, by one choice of transforms."""

    image: int
    height: int
    width: int  # of the coded image
    values: np.ndarray
    table: np.ndarray | None  # of the palette
    modes: list[int] | None  # of the predictor


def streams_of(images: list[np.ndarray], width: int) -> list[Stream]:
    """Each image with a palette, if 16 values or fewer, or else without and, where it promises to be smaller, with the predictor."""
    out, many = [], []
    for i, values in enumerate(images):
        table = np.flatnonzero(np.bincount(values, minlength=256))
        height = len(values) // width
        if len(table) > 16:
            out.append(Stream(i, height, width, values, None, None))
            many.append(out[-1])
            continue
        k = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1
        per, wide = 1 << k, (width + (1 << k) - 1) >> k
        index = np.zeros((height, wide * per), "u1")
        index[:, :width] = np.searchsorted(table, values).reshape(height, width)
        bundled = (index.reshape(height, wide, per) << (8 >> k) * np.arange(per, dtype="u1")).sum(-1).astype("u1").ravel()
        out.append(Stream(i, height, wide, bundled, table, None))
    if many:
        for s, found in zip(many, predicted(np.concatenate([s.values for s in many]), [len(s.values) for s in many], width), strict=True):
            if found:
                out.append(s._replace(values=found[0], modes=found[1]))
    return out


def matches(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the distance to the last place in its image with the same SHORTEST pixels (0: none), and how far both agree."""
    n = len(values)
    padded = values.tobytes() + bytes(8)
    words = np.ndarray((n + 1,), "<u8", padded, 0, (1,)).copy()
    keys = (words[:n] & (1 << 8 * SHORTEST) - 1) << 24 | np.arange(n, dtype="u8")
    keys.sort()
    places = (keys & 0xFFFFFF).astype("i8")
    same = np.flatnonzero((keys[1:] ^ keys[:-1]) < 1 << 24)
    here, before = places[same + 1], places[same]
    good = (before >= begin[here]) & (here + SHORTEST <= end[here]) & (here - before <= FARTHEST)
    distance, length = np.zeros(n + 1, "i8"), np.zeros(n + 1, "i8")
    distance[here[good]] = here[good] - before[good]
    # Neighbours of one distance agree as far as the last of them: only those are compared.
    ending = (distance[:-1] > 0) & ((distance[1:] != distance[:-1]) | (np.arange(1, n + 1) == end))
    last = np.flatnonzero(ending)
    known = np.full(len(last), SHORTEST)
    open_, at, back, room = np.arange(len(last)), last, last - distance[last], end[last] - last
    far = 0  # of most, eight pixels tell; the few that go on are compared many words at a time
    while len(open_):
        k = known[open_]
        if far:
            ahead = k[:, None] + np.arange(0, far, 8)
            unlike = words[np.minimum(at[:, None] + ahead, n)] != words[np.minimum(back[:, None] + ahead, n)]
            skip = np.where(unlike.any(1), 8 * unlike.argmax(1), far)
        else:
            skip = 0
        differ = words[np.minimum(at + k + skip, n)] ^ words[np.minimum(back + k + skip, n)]
        low = differ & -differ
        equal = np.minimum(skip + np.where(differ == 0, 8, (np.frexp(low.astype("f8"))[1] - 1) >> 3), room - k)
        known[open_] = k + equal
        go = (equal == far + 8) & (k + far + 8 < LONGEST)
        open_, at, back, room = open_[go], at[go], back[go], room[go]
        far = min(504, max(56, COMPARED // max(1, len(open_)) & ~7))
    has = np.flatnonzero(distance[:n])
    run = (np.cumsum(ending) - ending)[has]
    length[has] = np.minimum(known[run] + last[run] - has, LONGEST)
    return distance[:n], length[:n]


def merged(counts: np.ndarray) -> list[int]:
    """Groups of bands: two are joined as long as that saves bits, those first that save most."""
    cost_of = lambda c: entropy(c[..., :GREEN]) + entropy(c[..., GREEN:])
    n = len(counts)
    group, counts, cost = list(range(n)), counts.copy(), cost_of(counts)
    saves, (i, j) = np.full((n, n), -np.inf), np.triu_indices(n, 1)
    saves[i, j] = cost[i] + cost[j] - cost_of(counts[i] + counts[j])
    while (best := int(saves.argmax())) >= 0 and saves.flat[best] > 0:
        i, j = divmod(best, n)
        counts[i] += counts[j]
        cost[i] = cost_of(counts[i])
        saves[j], saves[:, j] = -np.inf, -np.inf
        group = [i if g == j else g for g in group]
        rest = np.array([g for g in sorted(set(group)) if g != i], "i8")
        if len(rest):
            saves[np.minimum(rest, i), np.maximum(rest, i)] = cost[i] + cost[rest] - cost_of(counts[i] + counts[rest])
    names = {g: k for k, g in enumerate(sorted(set(group)))}
    return [names[g] for g in group]


def with_cache(streams: list[Stream], values: np.ndarray, stream: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> tuple[list[int], np.ndarray]:
    """For each stream the size of its cache (0: none) that promises to be smallest, and its tokens' symbols with it."""
    literal, of_token = symbols < 256, stream[at]
    moved = np.array([s.modes is not None for s in streams])
    cost, options = [], [symbols]
    count = lambda x: entropy(np.bincount(of_token * GREEN + x, minlength=GREEN * len(streams)).reshape(-1, GREEN))
    cost.append(count(symbols))
    for bits in CACHES:
        place = cache_places(bits, OPAQUE_BLACK)[values]
        if moved.any():
            place = np.where(moved[stream], cache_places(bits, 0)[values], place)
        hit = np.zeros(len(values), bool)
        for k in range(1 << bits):
            held = np.flatnonzero(place == k)
            v, of = values[held], stream[held]
            hit[held[1:]] = (v[1:] == v[:-1]) & (of[1:] == of[:-1])
        options.append(np.where(literal & hit[at], 280 + place[at], symbols))
        cost.append(count(options[-1]))
    best = np.array(cost).argmin(0)
    return [(0, *CACHES)[b] for b in best.tolist()], np.choose(best[of_token], options)


def riff(data: bytes) -> bytes:
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def encode_batch(images: list[np.ndarray], width: int) -> list[bytes]:
    """RIFF files of images of grey samples (u1), row by row. What an image becomes does not hang on the others.

    Green carries the sample, red and blue follow by subtract-green; 16 or fewer values go through a palette
    with bundled pixels. Predictor, colour cache and groups of prefix codes (by bands of rows) are used
    where they make an image smaller by the entropy of its symbols; back-references where they cost less
    than their pixels, the next pixel's first if that saves more. Cross-colour is left out: red and blue are
    zero once green is subtracted, and nothing is smaller than that.
    """
    streams = streams_of(images, width)
    sizes = [len(s.values) for s in streams]
    values, stream = np.concatenate([s.values for s in streams]), np.repeat(np.arange(len(sizes)), sizes)
    n, ends = len(values), np.cumsum(sizes)
    begins = ends - sizes
    distance, length = matches(values, begins[stream], ends[stream])
    counts = np.bincount(stream * 256 + values, minlength=256 * len(sizes)).reshape(-1, 256)
    bits = np.rint(256 * np.log2(np.array(sizes)[:, None] / np.maximum(counts, 1))).astype("i8")
    bits = np.maximum(bits, 256 * (np.count_nonzero(counts, 1) > 1)[:, None])
    spent = np.concatenate([[0], np.cumsum(bits.ravel()[stream * 256 + values])])
    has = np.flatnonzero(distance)
    code, gain = np.zeros(n, "i8"), np.zeros(n + 1, "i8")
    for w in {s.width for s in streams}:
        mine = has[np.array([s.width == w for s in streams])[stream[has]]]
        code[mine] = distance_codes(distance[mine], w)
    # In 256ths of a bit. Both symbols of a reference take some twelve bits.
    gain[has] = spent[has + length[has]] - spent[has] - 256 * (12 + extra_bits_of(code[has]) + extra_bits_of(length[has]))
    take = (gain[:n] > 0) & (gain[:n] >= gain[1:] * (np.arange(1, n + 1) < ends[stream]))
    # Of those wanted, each that begins where the one before has ended, or later.
    wanted = np.flatnonzero(take)
    until = wanted + length[wanted]
    following, k, chosen = np.searchsorted(wanted, until).tolist(), 0, []
    while k < len(following):
        chosen.append(k)
        k = following[k]
    inside = np.zeros(n + 1, "i1")
    inside[wanted[chosen] + 1] = 1
    inside[until[chosen]] -= 1
    at = np.flatnonzero(np.cumsum(inside[:n], dtype="i1") == 0)
    far = np.zeros(n, bool)
    far[wanted[chosen]] = True
    far = far[at]
    l_symbol, l_extra, l_bits = prefix_symbols(length[at[far]])
    d_symbol, d_extra, d_bits = prefix_symbols(code[at[far]])
    symbols = values[at].astype("i8")
    symbols[far] = 256 + l_symbol
    caches, symbols = with_cache(streams, values, stream, at, symbols)
    extra, dist, dist_extra, extra_bits, dist_bits = np.zeros((5, len(at)), "i8")
    extra[far], extra_bits[far], dist[far], dist_extra[far], dist_bits[far] = l_extra, l_bits, d_symbol, d_extra, d_bits
    cuts = np.searchsorted(at, [*begins.tolist(), n])
    headers, lengths_of, table = [], [], np.empty(len(at), "i8")
    for i, s in enumerate(streams):
        t = slice(cuts[i], cuts[i + 1])
        header, of_group, group = write_header(s, width, caches[i], at[t] - begins[i], symbols[t], far[t], dist[t])
        table[t] = len(lengths_of) if group is None else len(lengths_of) + group
        headers.append(header)
        lengths_of += of_group
    (code, size), (d_code, d_size) = (usable(np.stack(x)) for x in zip(*lengths_of, strict=True))
    of, d_of = table * GREEN + symbols, (table * DISTANCES + dist)[far]
    place = np.arange(len(at)) + np.cumsum(far) - far
    values, sizes = np.empty((2, len(at) + int(far.sum())), "i8")
    values[place], sizes[place] = code[of] | extra << size[of], size[of] + extra_bits
    place = place[far] + 1
    values[place], sizes[place] = d_code[d_of] | dist_extra[far] << d_size[d_of], d_size[d_of] + dist_bits[far]
    # Each stream begins with a word of its own.
    cuts = cuts + np.concatenate([[0], np.cumsum(far)])[cuts]
    ends = np.concatenate([[0], np.cumsum(sizes)])[cuts]
    all_values, all_sizes, words, best = [], [], [0], [None] * len(images)
    for i, header in enumerate(headers):
        t = slice(cuts[i], cuts[i + 1])
        n_bits = sum(header.sizes) + int(ends[i + 1] - ends[i])
        all_values += [np.array(header.values), values[t], np.zeros(1, "i8")]
        all_sizes += [np.array(header.sizes), sizes[t], np.array([-n_bits % 32])]
        words.append(words[-1] + (n_bits + 31 >> 5))
        headers[i] = n_bits + 7 >> 3
    data = packed_words(np.concatenate(all_values), np.concatenate(all_sizes))
    for s, word, n_bytes in zip(streams, words, headers, strict=False):
        if best[s.image] is None or n_bytes < len(best[s.image]):
            best[s.image] = data[4 * word : 4 * word + n_bytes]
    return [riff(x) for x in best]


def write_header(s: Stream, width: int, cache_bits: int, at, symbols, far, dist) -> tuple[Fields, list[tuple], np.ndarray | None]:
    """What stands before the tokens; code lengths of each group, and the tokens' groups if there are several."""
    out = Fields()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(s.height - 1, 14)
    out.put(0, 4)
    if s.table is not None:
        write_palette(out, s.table)
    else:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
    if s.modes is not None:
        out.put(1 | PREDICTOR << 1 | MODE_BITS - 2 << 3, 6)
        write_small(out, s.modes)
    out.put(0, 1)  # no more transforms
    out.put(1 | cache_bits << 1, 5) if cache_bits else out.put(0, 1)
    counts, far_counts, group = np.bincount(symbols, minlength=GREEN)[None], np.bincount(dist[far], minlength=DISTANCES)[None], None
    if len(at) >= GROUP_TOKENS:
        rows = min(9, max(2, (s.height - 1).bit_length() - 2))
        band = at // s.width >> rows
        n = (s.height - 1 >> rows) + 1
        by_band = np.bincount(band * GREEN + symbols, minlength=n * GREEN).reshape(n, GREEN)
        far_by_band = np.bincount(band[far] * DISTANCES + dist[far], minlength=n * DISTANCES).reshape(n, DISTANCES)
        of_band = np.array(merged(np.concatenate([by_band, far_by_band], 1)))
        if of_band.any():
            group = of_band[band]
            counts, far_counts = (np.stack([x[of_band == g].sum(0) for g in range(of_band.max() + 1)]) for x in (by_band, far_by_band))
    out.put(group is not None, 1)
    if group is not None:
        out.put(rows - 2, 3)
        write_small(out, np.repeat(of_band, (s.width - 1 >> rows) + 1).tolist())
    lengths_of, alphabet = [], 280 + (1 << cache_bits if cache_bits else 0)
    for of_green, of_far in zip(counts, far_counts, strict=True):
        lengths, d_lengths = code_lengths(of_green, MOST_BITS), code_lengths(of_far, MOST_BITS)
        write_code(out, lengths[:alphabet])
        for symbol in (0, 0, 255 if s.modes is None else 0):
            write_only(out, symbol)
        write_code(out, d_lengths)
        lengths_of.append((lengths, d_lengths))
    return out, lengths_of, group


def write_palette(out: Fields, table: np.ndarray) -> None:
    n = len(table)
    out.put(1 | PALETTE << 1, 3)
    out.put(n - 1, 8)
    out.put(0, 1)
    deltas = np.diff(table, prepend=0)
    grey, alpha = code_lengths(np.bincount(deltas, minlength=280), 15), code_lengths(np.bincount([255, *[0] * (n - 1)], minlength=256), 15)
    for lengths in (grey, grey[:256], grey[:256], alpha, np.zeros(DISTANCES, "i1")):
        write_code(out, lengths)
    (codes, sizes), (alphas, alpha_sizes) = usable(grey[None]), usable(alpha[None])
    for i, d in enumerate(deltas.tolist()):
        for _ in range(3):
            out.put(int(codes[d]), int(sizes[d]))
        a = 0 if i else 255
        out.put(int(alphas[a]), int(alpha_sizes[a]))


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A RIFF file whose pixels are the samples (u1); the last row is filled up with its last sample."""
    return encode_batch([np.concatenate([samples, np.full(-len(samples) % width, samples[-1], "u1")])], width)[0]


def encode_many(payloads: list[bytes], row: int = 192) -> list[bytes]:
    """Of each payload (not empty) one image, or several one after the other where it has over IMAGE_PIXELS; rows have `row` samples."""
    most = row * max(1, min(MAX_SIDE, IMAGE_PIXELS // row))
    files: list[list[bytes]] = [[] for _ in payloads]
    batch, owners, held = [], [], 0

    def flush() -> None:
        for k, data in zip(owners, encode_batch(batch, row) if batch else [], strict=True):
            files[k].append(data)
        batch.clear(), owners.clear()

    for k, payload in enumerate(payloads):
        samples = np.frombuffer(payload, "u1")
        for i in range(0, len(samples), most):
            part = samples[i : i + most]
            if held + len(part) > BATCH_PIXELS:
                flush()
                held = 0
            batch.append(np.concatenate([part, np.full(-len(part) % row, part[-1], "u1")]))
            owners.append(k)
            held += len(part)
    flush()
    return [b"".join(f) for f in files]


def encode_bytes(payload: bytes, row: int = 192) -> bytes:
    """payload (not empty) as images, one after the other."""
    return encode_many([payload], row)[0]
