"""Eight bits of each bin are stored: texts without a common shingle hardly agree by chance."""

import numpy as np

from groundspark.llm import minhash


def test_unlike_texts_agree_by_chance_in_one_bin_of_256():
    rng = np.random.default_rng(2)
    signatures = [minhash.signature(rng.integers(0, 1 << 63, 400, dtype="u8")) for _ in range(200)]
    agree = np.mean([(a == b).mean() for a, b in zip(signatures, signatures[1:])])
    assert agree < 0.008 and len(minhash.packed(signatures[0])) == minhash.BINS
    assert np.mean([minhash.likeness(a, b) for a, b in zip(signatures, signatures[1:])]) < 0.003
