"""The decoder against a writer of its own that uses every part of the format: all predictors, cross-colour, palettes, groups, cache, back-references in two dimensions."""

import random
import struct

import numpy as np
import pytest

from groundspark.llm import media, webp

W, H = 21, 13


class Stream:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))


class Flat:
    """A complete code over an alphabet of n symbols with two neighbouring lengths."""

    def __init__(self, n):
        k = max(1, (n - 1).bit_length())
        short = (1 << k) - n  # symbols with one bit less
        self.lengths = [k - 1] * short + [k] * (n - short) if short else [k] * n
        code, self.codes, last = 0, {}, 0
        for s in sorted(range(n), key=lambda s: (self.lengths[s], s)):
            code <<= self.lengths[s] - last
            last = self.lengths[s]
            self.codes[s] = code
            code += 1

    def describe(self, out):
        kinds = sorted(set(self.lengths))
        out.put(0, 1)
        order = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
        last = max(order.index(k) for k in kinds) + 1
        out.put(max(4, last) - 4, 4)
        for s in order[: max(4, last)]:
            out.put(1 if s in kinds else 0, 3)
        out.put(0, 1)
        for n in self.lengths:
            if len(kinds) > 1:
                out.put(kinds.index(n), 1)

    def put(self, out, s):
        for i in range(self.lengths[s] - 1, -1, -1):  # prefix codes go out from their first bit
            out.put(self.codes[s] >> i & 1, 1)


def prefix(n):
    """Symbol, extra bits and their number of a length or distance code, by the tables' rule."""
    for s in range(40):
        extra = 0 if s < 4 else (s - 2) // 2
        first = s + 1 if s < 4 else ((2 + s % 2) << extra) + 1
        if first <= n < first + (1 << extra):
            return s, n - first, extra
    raise AssertionError(n)


def entropy_image(out, symbols, main, cache_bits=0, meta=None):
    """symbols: (group, ("px", argb) | ("ref", length, distance code) | ("cache", index)); meta: (bits, group of each block, blocks across)."""
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups = 1
    if main:
        out.put(1 if meta else 0, 1)
        if meta:
            out.put(meta[0] - 2, 3)
            entropy_image(out, [(0, ("px", g << 8)) for g in meta[1]], False)
            groups = max(meta[1]) + 1
    codes = [[Flat(280 + (1 << cache_bits if cache_bits else 0)), Flat(256), Flat(256), Flat(256), Flat(40)] for _ in range(groups)]
    for group in codes:
        for code in group:
            code.describe(out)
    for g, (kind, *what) in symbols:
        green, red, blue, alpha, dist = codes[g]
        if kind == "px":
            p = what[0]
            for code, shift in ((green, 8), (red, 16), (blue, 0), (alpha, 24)):
                code.put(out, p >> shift & 255)
        elif kind == "ref":
            s, extra, n = prefix(what[0])
            green.put(out, 256 + s)
            out.put(extra, n)
            s, extra, n = prefix(what[1])
            dist.put(out, s)
            out.put(extra, n)
        else:
            green.put(out, 280 + what[0])


def riff(out, extended=False):
    data = out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    if extended:
        chunk = b"VP8X" + struct.pack("<I", 10) + bytes(10) + b"ICCP" + struct.pack("<I", 3) + b"abc\0" + chunk
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def start(w=W, h=H):
    out = Stream()
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 1), (0, 3)):
        out.put(v, n)
    return out


def picture(seed, w=W, h=H):
    rng = random.Random(seed)
    return [[rng.randrange(1 << 32) if rng.random() < 0.5 else 0xFF203040 + x * 3 + y * 700 for x in range(w)] for y in range(h)]


def split(p):
    return [p >> k & 255 for k in (24, 16, 8, 0)]


def join(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def guess(mode, left, top, tr, tl):
    """The 14 predictors, from their definitions."""
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 11:
        p = [x + y - z for x, y, z in zip(left, top, tl)]
        to_left, to_top = sum(abs(a - b) for a, b in zip(p, left)), sum(abs(a - b) for a, b in zip(p, top))
        return left if to_left < to_top else top
    if mode == 13:
        out = []
        for a, z in zip(half(left, top), tl):
            d = a - z
            out.append(clamp(a + (d // 2 if d >= 0 else -(-d // 2))))
        return out
    return [
        lambda: [255, 0, 0, 0], lambda: left, lambda: top, lambda: tr, lambda: tl, lambda: half(half(left, tr), top), lambda: half(left, tl), lambda: half(left, top), lambda: half(tl, top), lambda: half(top, tr), lambda: half(half(left, tl), half(top, tr)),
        None, lambda: [clamp(x + y - z) for x, y, z in zip(left, top, tl)],
    ][mode]()


def residuals(img, mode_of):
    flat = [split(p) for row in img for p in row]
    out = []
    for i, p in enumerate(flat):
        y, x = divmod(i, W)
        if i == 0:
            g = [255, 0, 0, 0]
        elif y == 0:
            g = flat[i - 1]
        elif x == 0:
            g = flat[i - W]
        else:
            g = guess(mode_of(x, y), flat[i - 1], flat[i - W], flat[i - W + 1], flat[i - W - 1])
        out.append(join([(a - b) & 255 for a, b in zip(p, g)]))
    return out


def pixels(raw):
    ((w, h, argb),) = webp.decode(raw)
    return w, h, argb.tolist()


def flat(img):
    return [p for row in img for p in row]


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    img, out = picture(mode), start()
    out.put(1, 1), out.put(0, 2), out.put(0, 3)  # predictor, blocks of 4
    across, down = -(-W // 4), -(-H // 4)
    modes = [mode if k % 3 else (mode + k) % 14 for k in range(across * down)]
    entropy_image(out, [(0, ("px", 0xFF000000 | m << 8)) for m in modes], False)
    out.put(0, 1)
    entropy_image(out, [(0, ("px", p)) for p in residuals(img, lambda x, y: modes[(y >> 2) * across + (x >> 2)])], True)
    assert pixels(riff(out, extended=mode % 2 == 1)) == (W, H, flat(img))


def test_cross_colour_and_subtract_green():
    img, out, rng = picture(30), start(), random.Random(2)
    across, down = -(-W // 8), -(-H // 8)
    factors = [[rng.randrange(256) for _ in range(3)] for _ in range(across * down)]  # green to red, green to blue, red to blue
    signed = lambda v: v - 256 if v > 127 else v
    delta = lambda t, c: signed(t) * signed(c) >> 5
    left = []
    for i, p in enumerate(flat(img)):
        y, x = divmod(i, W)
        a, r, g, b = split(p)
        r, b = (r - g) & 255, (b - g) & 255  # subtract green comes first here, so it is undone last
        gr, gb, rb = factors[(y >> 3) * across + (x >> 3)]
        left.append(join([a, (r - delta(gr, g)) & 255, g, (b - delta(gb, g) - delta(rb, r)) & 255]))
    out.put(1, 1), out.put(2, 2)
    out.put(1, 1), out.put(1, 2), out.put(1, 3)
    entropy_image(out, [(0, ("px", 0xFF << 24 | rb << 16 | gb << 8 | gr)) for gr, gb, rb in factors], False)
    out.put(0, 1)
    entropy_image(out, [(0, ("px", p)) for p in left], True)
    assert pixels(riff(out)) == (W, H, flat(img))


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 40])
def test_palettes(colours):
    rng = random.Random(colours)
    table = [rng.randrange(1 << 32) for _ in range(colours)]
    index = [[rng.randrange(colours) for _ in range(W)] for _ in range(H)]
    out = start()
    out.put(1, 1), out.put(3, 2), out.put(colours - 1, 8)
    before = [0, 0, 0, 0]
    deltas = []
    for p in table:
        deltas.append(join([(a - b) & 255 for a, b in zip(split(p), before)]))
        before = split(p)
    entropy_image(out, [(0, ("px", d)) for d in deltas], False)
    out.put(0, 1)
    k = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, each = 1 << k, 8 >> k
    packed = [sum(v << (each * j) for j, v in enumerate(row[x : x + per])) for row in index for x in range(0, W, per)]
    entropy_image(out, [(0, ("px", 0xFF000000 | v << 8)) for v in packed], True)
    assert pixels(riff(out)) == (W, H, [table[i] for row in index for i in row])


def test_groups_cache_and_back_references_in_two_dimensions():
    rng = random.Random(8)
    cache_bits, bits = 4, 2
    across, down = -(-W >> bits) if W % 4 == 0 else (W >> bits) + 1, (H >> bits) + 1
    blocks = [rng.randrange(3) for _ in range(across * down)]
    blocks[-1] = 2
    place = {0: (0, 1), 1: (1, 0), 2: (1, 1), 3: (-1, 1), 4: (0, 2), 5: (2, 0)}  # the first distance codes: columns back, rows up
    img, symbols, cache = [], [], [0] * (1 << cache_bits)
    key = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while len(img) < W * H:
        at = len(img)
        y, x = divmod(at, W)
        g = blocks[(y >> bits) * across + (x >> bits)]
        kind = rng.random()
        if kind < 0.3 and at > 2 * W + 2:
            code = rng.choice([*place, "far"])
            n = min(rng.choice([1, 2, 3, 4, 5, 9, 30]), W * H - at)
            d = 7 if code == "far" else max(1, place[code][0] + place[code][1] * W)
            symbols.append((g, ("ref", n, 120 + 7 if code == "far" else code + 1)))
            new = []
            for _ in range(n):
                new.append((img + new)[at + len(new) - d])
        elif kind < 0.45 and any(cache):
            k = rng.choice([i for i, v in enumerate(cache) if v])
            symbols.append((g, ("cache", k)))
            new = [cache[k]]
        else:
            new = [rng.choice([0xFF00FF00, 0x80123456, rng.randrange(1, 1 << 32)])]
            symbols.append((g, ("px", new[0])))
        for p in new:
            img.append(p)
            cache[key(p)] = p
    out = start()
    out.put(0, 1)
    entropy_image(out, symbols, True, cache_bits, (bits, blocks))
    kinds = {s[1][0] for s in symbols}
    assert kinds == {"px", "ref", "cache"} and pixels(riff(out)) == (W, H, img)


def test_damaged_and_other_values(spark):
    good = webp.encode_bytes(b"some text" * 60)
    rows = [(1, good), (2, good[:40]), (3, b"not an image"), (4, None), (5, b""), (6, good.replace(b"VP8L", b"VP8 ")), (7, good + good), (8, good[:-20] + bytes(20))]
    table = spark.createDataFrame(rows, "doc_id long, media binary").withColumnsRenamed({}).selectExpr("*", "'own' AS width", "'own' AS error")
    got = {}
    for r in media.pixel_arrays(table).collect():
        got.setdefault(r.doc_id, []).append((r.image, r.error))
    assert got[1] == [(0, None)] and got[7] == [(0, None), (1, None)] and 4 not in got and 5 not in got
    assert all(len(got[k]) == 1 and got[k][0][0] is None and got[k][0][1] for k in (2, 3, 6))
    digests = {r.doc_id: r for r in media.digests(table.where("doc_id in (1, 3)").selectExpr("doc_id", "540L AS n_bytes", "576L AS payload_bytes", "media")).collect()}
    assert digests[1].payload_bytes == 576 and digests[3].payload_sha256 is None and digests[3].media_bytes == 12


def test_long_texts_go_through_the_media_column():
    rng = np.random.default_rng(3)
    for n in (192, 193, 100_000, 3_200_001):
        payload = media.payload_of("".join(map(chr, rng.integers(32, 127, n).tolist())))
        images = webp.decode(webp.encode_bytes(payload, media.ROW))
        assert b"".join((a >> 8 & 255).astype("u1").tobytes() for _, _, a in images)[: len(payload)] == payload
