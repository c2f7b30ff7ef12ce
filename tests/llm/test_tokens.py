"""The memoised encoder against the library on whole texts, strings of special tokens included."""

import random

import numpy as np
import pytest

from groundspark.llm.queries import BYTE_BPE, WORD_BPE
from groundspark.llm.tokens import Encoder

PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endof", "text|>", "hello", " ", "  ", "\n", "\n\n", "don't", "WORLD", "\u00a0", "\u212a", "1234", "!?", "\u65e5\u672c", "\U0001f600", "e\u0301", "\t", "|", "<"]


@pytest.mark.parametrize(("path", "kind"), [(WORD_BPE, "word"), (BYTE_BPE, "byte")])
def test_ids_are_those_of_the_library(path, kind):
    from tokenizers import Tokenizer

    rng, whole, mine = random.Random(4), Tokenizer.from_file(path), Encoder(path, kind)
    texts = ["hello <|startoftext|> world", "hello <|endoftext|> world", "<|ENDOFTEXT|>", "<|endoftext|>", "", None]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for text, got in zip(texts, mine.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)
