"""The encoder uses each part of the format where it makes an image smaller, and what it stores is read back."""

import numpy as np
import pytest

from groundspark.llm import media, webp

RNG = np.random.default_rng(11)


def noise(n, low=32, high=127):
    return RNG.integers(low, high, n, dtype="u1").tobytes()


def filled(payload):
    return payload + b" " * (-len(payload) % 192)


def bytes_of(images):
    return b"".join((argb >> 8 & 255).astype("u1").tobytes() for _, _, argb in images)


@pytest.fixture
def parts(monkeypatch):
    """What decoded images make use of."""
    seen, green_only, unpredict = {}, webp._green_only, webp._unpredict

    def see_tokens(bits, groups, rows, row_bits, width, n, cache_bits):
        seen["groups"], seen["cache"] = len(groups), cache_bits
        return green_only(bits, groups, rows, row_bits, width, n, cache_bits)

    def see_modes(argb, width, height, size_bits, modes):
        seen["modes"] = {*(modes >> 8 & 15).tolist()}
        return unpredict(argb, width, height, size_bits, modes)

    monkeypatch.setattr(webp, "_green_only", see_tokens)
    monkeypatch.setattr(webp, "_unpredict", see_modes)
    return seen


def entropy(payload):
    n = np.bincount(np.frombuffer(payload, "u1"))
    n = n[n > 0]
    return int((n * np.log2(n.sum() / n)).sum()) // 8


def test_back_references():
    phrases = [noise(k) for k in (20, 33, 47, 61)]
    payload = filled(b"".join(noise(3) + phrases[k] for k in RNG.integers(0, 4, 200)))
    stored = webp.encode_bytes(payload)
    assert bytes_of(webp.decode(stored))[: len(payload)] == payload and len(stored) < entropy(payload) // 4


def test_rows_above_are_near():
    row = noise(192)
    payload = b"".join(row[:k] + noise(1) + row[k + 1 :] for k in RNG.integers(0, 192, 100))
    stored = webp.encode_bytes(payload)
    assert bytes_of(webp.decode(stored)) == payload and len(stored) < entropy(payload) // 10


def test_predictor(parts):
    y, x = np.mgrid[:130, :192]
    image = (x * 5 // 7 + y * 3 + RNG.integers(0, 3, (130, 192))).astype("u1")
    image[64:, 64:128] = RNG.integers(0, 24, (66, 64))  # blocks that are best left alone
    stored = webp.encode_bytes(image.tobytes())
    assert bytes_of(webp.decode(stored)) == image.tobytes() and len(stored) < entropy(image.tobytes()) // 2
    assert 0 in parts["modes"] and len(parts["modes"]) > 1


def test_groups_of_codes(parts):
    payload = noise(64 * 192, 48, 58) + noise(64 * 192, 97, 123)
    stored = webp.encode_bytes(payload)
    assert bytes_of(webp.decode(stored)) == payload and parts["groups"] > 1 and len(stored) < 0.85 * entropy(payload)


def test_colour_cache(parts):
    place = webp.cache_places(1, webp.OPAQUE_BLACK)
    sides = [np.flatnonzero(place == k).tolist() for k in (0, 1)]
    held, out = [sides[0][0], sides[1][0]], []
    for side, new in zip(RNG.integers(0, 2, 9000).tolist(), RNG.random(9000).tolist(), strict=True):
        if new < 0.15:
            held[side] = int(RNG.choice(sides[side]))
        out.append(held[side])
    payload = filled(bytes(out))
    stored = webp.encode_bytes(payload)
    assert bytes_of(webp.decode(stored)) == payload and parts["cache"] == 1 and len(stored) < entropy(payload) // 2


@pytest.mark.parametrize("mode", range(14))
def test_one_channel_is_predicted_back_as_four(mode):
    w, h = 21, 13
    res = RNG.integers(0, 256, w * h).astype("u4")
    modes = np.array([mode if k % 3 else (mode + k) % 14 for k in range(24)], "u4") << 8
    got, want = webp._unpredict(res << 8, w, h, 2, modes), []
    for i, r in enumerate(res.tolist()):
        y, x = divmod(i, w)
        near = [want[i - k] if i >= k else None for k in (1, w, w - 1, w + 1)]
        guess = (255, 0, 0, 0) if i == 0 else near[0] if y == 0 else near[1] if x == 0 else webp.predict(int(modes[(y >> 2) * 6 + (x >> 2)] >> 8), *near)
        want.append((guess[0], guess[1], guess[2] + r & 255, guess[3]))
    assert got.tolist() == [a << 24 | r << 16 | g << 8 | b for a, r, g, b in want]


def test_an_image_does_not_hang_on_those_stored_with_it():
    payloads = [filled(noise(int(k)) * 3) for k in RNG.integers(1, 3000, 40)] + [b" " * 192, filled(b"ab" * 5000), filled(noise(200_000)), filled(bytes(range(256)) * 9)]
    stored = webp.encode_many(payloads)
    assert stored == [webp.encode_bytes(p) for p in payloads] == webp.encode_many(payloads[::-1])[::-1]
    assert [bytes_of(webp.decode(s))[: len(p)] for s, p in zip(stored, payloads, strict=True)] == payloads


def test_more_than_an_image_holds():
    payload = filled(noise(1000) * 1200)
    images = webp.decode(webp.encode_bytes(payload))
    assert len(images) == 3 and bytes_of(images)[: len(payload)] == payload


def test_groups_of_the_largest_image(parts):
    payload = filled(noise(300_000, 48, 58) + noise(200_000, 97, 123))
    images = webp.decode(webp.encode_bytes(payload))
    assert bytes_of(images) == payload and parts["groups"] > 1 and len(images) == 1


@pytest.mark.parametrize("window", [1 << 10, 1 << 12])
def test_windows_may_end_anywhere(monkeypatch, window):
    words = [noise(int(k)) for k in RNG.integers(2, 60, 90)]
    payload = filled(b"".join(words[k] for k in RNG.integers(0, 90, 900)))
    stored = webp.encode_bytes(payload)
    monkeypatch.setattr(webp, "WINDOW", window)
    assert bytes_of(webp.decode(stored)) == payload


def test_damage_is_told_by_errors_that_are_caught():
    stored = webp.encode_bytes(filled(b"".join([noise(50), noise(30)] * 20 + [noise(3000)])))
    for _ in range(200):
        raw = bytearray(stored)
        for k in RNG.integers(27, len(raw), 3).tolist():
            raw[k] ^= 1 << int(RNG.integers(0, 8))
        images, error = media._decoded(bytes(raw))
        assert (images is None) == (error is not None)


def test_long_matches_are_compared_many_pixels_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    once = rng.integers(0, 256, 3000).astype("u1")
    values = np.concatenate([once, once[40:50], once[1500:1510], once[:700], rng.integers(0, 256, 300).astype("u1"), np.zeros(6000, "u1"), once[:2900]])
    n, rounds, frexp = len(values), [], np.frexp
    monkeypatch.setattr(np, "frexp", lambda x: rounds.append(len(x)) or frexp(x))
    distance, length = webp.matches(values, np.zeros(n, "i8"), np.full(n, n))
    monkeypatch.undo()
    assert len(rounds) <= 12
    data, seen = values.tobytes(), {}
    for i in range(n):
        key = data[i : i + webp.SHORTEST]
        before = seen.get(key) if len(key) == webp.SHORTEST else None
        seen[key] = i
        if before is None:
            assert distance[i] == length[i] == 0
            continue
        k = webp.SHORTEST
        while k < webp.LONGEST and i + k < n and data[i + k] == data[before + k]:
            k += 1
        assert (distance[i], length[i]) == (i - before, k)
