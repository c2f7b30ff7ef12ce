"""Exact, memoised encoding with a public tokenizer file.

A BPE tokenizer cuts a text at fixed places before it merges anything, so the ids of a text are the
ids of its chunks, one after the other, as long as every chunk starts where the tokenizer itself
starts a new piece whatever stands before. `Encoder` cuts at such places only, keeps the ids of
chunks it has seen (bounded, per worker process) and asks the tokenizers library for the others.
A text that holds the string of one of the file's special tokens goes to the library as a whole.
Tests hold it against the library on whole texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

_WS = "\t-\r \x85\xa0  -     　"  # Unicode White_Space
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PUNCT = r"!-/:-@\[-`{-~"

_LAST = re.compile(f"(.*[{_LETTERS}])([{_PUNCT}]+)", re.S).fullmatch

#: Chunks of any text, cut where a new piece starts in any case.
_CHUNKS = {
    "byte": f"[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}]?[^{_WS}]+|[{_WS}]+",  # of a longer white space the last one goes with the word
    "word": "[^\t\n\r ]+",  # white space never reaches the ids
}
#: A text without these is cut by str.split alone.
_ODD = {"byte": "[\0\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", "word": "[\x1c-\x1f]"}
#: Separator that is always a piece of its own, and chunks that may be joined by it.
_JOIN = {"byte": ("\n", f" ?[^{_WS}]+"), "word": (" | ", f"[^{_WS}|]+")}

MAX_CACHED = 700_000


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers; as in the library, special tokens' strings in a text are those tokens."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # chunks hold none, but for what lower-casing makes, which is none either
        self._merges = self._tokenizer.model.tokenize
        self._word = kind == "word"
        self._chunks = re.compile(_CHUNKS[kind]).findall
        self._odd = re.compile(_ODD[kind]).search
        self._sep, plain = _JOIN[kind]
        self._plain = re.compile(plain).fullmatch
        (self._sep_id,) = self._tokenizer.encode(self._sep, add_special_tokens=False).ids
        self._cache: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        if self._word:
            try:
                text.encode("latin-1")
                text = text.lower()  # there, equal to the tokenizer's own lower-casing of single characters
            except UnicodeEncodeError:
                pass
            return self._chunks(text) if self._odd(text) else text.split()
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self._odd(text):
            return ["\0" + c for c in self._chunks(text)]
        return f"\0{text}".replace("\n", " \n \0").split(" ")

    def _learn(self, keys: list[str]) -> None:
        """Keys of the byte kind: \\0 and a chunk, a line end alone, or a word after a space."""
        cache, joined, alone, ends, merges = self._cache, {}, {}, [], self._merges
        for key in keys:
            if m := _LAST(key):
                ends.append((key, m[1], m[2] if self._word else "\0" + m[2]))
        for key in {x for e in ends for x in e[1:] if x not in cache}.union(keys).difference(e[0] for e in ends):
            if key.isascii() and (key.isalpha() and (key.islower() or not self._word) or key[1:].isalpha() and key[0] == "\0" and not self._word):
                # One piece: straight to the library's merges, its byte alphabet writes a space as \u0120.
                piece = key if self._word else key[1:] if key[0] == "\0" else "\u0120" + key
                cache[key] = np.array([x.id for x in merges(piece)], "<u4").tobytes()
                continue
            chunk = key if self._word else key[1:] if key[:1] == "\0" else key if key == "\n" else " " + key
            (joined if len(chunk) < 200 and self._plain(chunk) else alone)[key] = chunk
        names, chunks = list(joined), list(joined.values())
        for i in range(0, len(names), 2000):
            part = names[i : i + 2000]
            ids = np.array(self._tokenizer.encode_batch_fast([self._sep.join(chunks[i : i + 2000])], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(ids == self._sep_id) * 4).tolist()
            if len(cuts) == len(part) - 1:
                raw, at = ids.tobytes(), 0
                for key, cut in zip(part, [*cuts, len(raw)], strict=True):
                    cache[key] = raw[at:cut]
                    at = cut + 4
            else:
                alone.update({key: joined[key] for key in part})
        names = list(alone)
        for i in range(0, len(names), 500):
            part = names[i : i + 500]
            for key, e in zip(part, self._tokenizer.encode_batch_fast([alone[x] for x in part], add_special_tokens=False), strict=True):
                cache[key] = np.array(e.ids, "<u4").tobytes()
        for key, stem, end in ends:
            cache[key] = cache[stem] + cache[end]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text; None counts as empty."""
        if len(self._cache) > MAX_CACHED:
            self._cache.clear()
        get = self._cache.get
        whole = {i: t for i, t in enumerate(texts) if t and any(x in t for x in self._special)}
        cut = [self._cut(t) if t and i not in whole else [] for i, t in enumerate(texts)]
        found = [list(map(get, keys)) for keys in cut]
        missing = []
        for keys, got in zip(cut, found, strict=True):
            i = -1
            for _ in range(got.count(None)):
                i = got.index(None, i + 1)
                missing.append((got, i, keys[i]))
        if missing:
            self._learn(sorted({key for _, _, key in missing}))
            for got, i, key in missing:
                got[i] = get(key)
        out = [b"".join(got) for got in found]
        for i, t in whole.items():
            out[i] = np.array(self._whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path, kind)
