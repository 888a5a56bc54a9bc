"""Exact whole-text byte-level BPE through a bounded cache of pre-tokens.

Merges never cross a pre-token, and natural text repeats its pre-tokens, so a
text's ids are the concatenation of its pre-tokens' ids.  Every id comes from
the library's BPE model; each worker merely remembers the pre-tokens it has
seen.  The pattern is run by ``re`` where its classes agree with the Unicode
properties of the pattern, else by ``regex`` itself.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

#: Fixed value: the pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Pre-tokens a worker keeps: about 180 MB.
CACHE = 1_000_000
LONG = 48


@lru_cache(1)
def _odd() -> re.Pattern:
    """Characters that ``re`` and the Unicode properties put into different classes."""
    found = []
    for i in range(sys.maxunicode + 1):
        c, kind = chr(i), unicodedata.category(chr(i))
        letter, digit = kind[0] == "L", kind[0] == "N"
        word = c.isalnum()
        if (c.isspace() and c not in " \t\n\r\x0b\x0c") or word != (letter or digit) or (kind in ("Nl", "No")) or (letter and c.isdecimal()):
            found.append(i)
    parts, i = [], 0
    while i < len(found):
        j = i
        while j + 1 < len(found) and found[j + 1] == found[j] + 1:
            j += 1
        parts.append(f"\\U{found[i]:08x}-\\U{found[j]:08x}")
        i = j + 1
    return re.compile(f"[{''.join(parts)}]")


@lru_cache(1)
def _exact():
    import regex

    return regex.compile(PATTERN)


def pre_tokens(text: str) -> list[str]:
    """The pattern's matches; they cover the text."""
    return _exact().findall(text) if _odd().search(text) else _PLAIN.findall(text)


@lru_cache(1)
def byte_alphabet() -> tuple[str, ...]:
    """The printable character that stands for each byte: itself if visible Latin-1, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return tuple(out)


@lru_cache(1)
def _from_latin() -> dict[int, str]:
    return dict(enumerate(byte_alphabet()))


def as_symbols(piece: str) -> str:
    """A text's UTF-8 bytes in the byte alphabet."""
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_from_latin())


class PreTokenEncoder:
    """Texts to little-endian uint32 ids as bytes; ``encode_many(pre-tokens) -> list of bytes``."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], most: int = CACHE):
        self.encode_many, self.most, self.cache = encode_many, most, {}

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        return [b"".join(x) for x in self.parts(texts)]

    def parts(self, texts: Iterable[str]) -> list[list]:
        """Each text's pre-tokens as the cache holds them.

        All texts are cut by the fast pattern first.  A character on which the
        two patterns differ can only lie in a piece not yet seen, since such
        pieces are never kept; texts that hold one are cut again exactly.
        """
        get = self.cache.get
        texts = list(texts)
        split = [_PLAIN.findall(t) for t in texts]
        done = [list(map(get, x)) for x in split]
        holes = _holes(done, range(len(done)))
        missing = {split[i][k] for i, k in holes}
        odd: set[str] = set()
        suspects = [p for p in missing if not p.isascii() or not p.isprintable()]
        if suspects and _odd().search("\n".join(suspects)):
            odd = {p for p in suspects if _odd().search(p)}
            again = {i for i, k in holes if split[i][k] in odd}
            for i in again:
                split[i] = _exact().findall(texts[i])
                done[i] = list(map(get, split[i]))
            holes = [h for h in holes if h[0] not in again] + _holes(done, again)
            missing = {split[i][k] for i, k in holes}
            odd |= {p for p in missing if _odd().search(p)}
        if missing:
            missing = list(missing)
            fresh = dict(zip(missing, self.encode_many(missing)))
            for i, k in holes:
                done[i][k] = fresh[split[i][k]]
            if len(self.cache) > self.most:  # what these texts use stays: it holds the common pre-tokens
                kept = {p: self.cache[p] for p in set().union(*split) if p in self.cache}
                self.cache.clear()
                self.cache.update(kept)
            self.cache.update((p, v) for p, v in fresh.items() if len(p) <= LONG and p not in odd)
        return done


def _holes(lists: list[list], which: Iterable[int]) -> list[tuple[int, int]]:
    """Where lists hold None."""
    out = []
    for i in which:
        find, k = lists[i].index, -1
        try:
            while True:
                k = find(None, k + 1)
                out.append((i, k))
        except ValueError:
            pass
    return out


class WholeTextEncoder:
    """Any other tokenizer file: the library encodes whole texts."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]


@lru_cache(2)
def library_encoder(path: str, cache: int = CACHE):
    """The ``tokenizers`` library on a tokenizer file; the strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec["normalizer"] or model.get("type", "BPE") != "BPE" or model.get("dropout") or any(not t["special"] for t in spec["added_tokens"]):
        return WholeTextEncoder(tokenizer)
    tokenize = tokenizer.model.tokenize

    space = as_symbols(" ")

    def encode_many(pieces: list[str]) -> list[bytes]:
        mapped = [p.replace(" ", space) if p.isascii() and p.isprintable() else as_symbols(p) for p in pieces]
        return [array("I", [t.id for t in tokenize(m)]).tobytes() for m in mapped]

    return PreTokenEncoder(encode_many, cache)


@lru_cache(2)
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()
