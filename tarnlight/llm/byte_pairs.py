"""Byte-pair tokenization of whole texts, word by word with bounded caches.

A text is first cut into words as the vocabulary's own normaliser and pre-tokenizer do.
Words recur, so what a word becomes is kept in a cache of bounded size. Texts of
characters below U+0180 (and common punctuation) are cut by one regular expression; all
others, and texts that hold the strings of special tokens, go through the library's steps.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np

#: Characters on which the short cut and the library agree: printable ASCII and its usual white space, Latin letters without the dotted capital I, general punctuation, the euro sign.
_UNCOMMON = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧€]")
_LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")
#: The pattern for which the short cut above was written; with any other, the library cuts the texts.
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHED_WORDS = 200_000
CACHED_LENGTH = 64


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE vocabulary of the tokenizers library, with the cutting of texts into words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        del spec["model"]  # tens of MB of small objects, of which the library has its own
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self._special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = any(c.get("pattern", {}).get("Regex") == _KNOWN_PATTERN for c in cuts)
        lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.short_cut = known and lowers
        self._alphabet = byte_alphabet()

    def symbols(self, word: str) -> str:
        """The word in the byte alphabet, in which printable ASCII stands for itself."""
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return "".join(map(self._alphabet.__getitem__, word.encode()))

    def is_common(self, text: str) -> bool:
        """True if the short cut gives what the library gives."""
        return self.short_cut and not _UNCOMMON.search(text) and not (self._special and self._special.search(text))

    def common_words(self, text: str) -> list[str]:
        return _WORDS.findall(text.lower())

    def library_words(self, text: str) -> tuple[list[str], int]:
        """The words in the byte alphabet as the library cuts them, and the number of special tokens among them."""
        parts = self._special.split(text) if self._special else [text]
        words: list[str] = []
        for part in parts:
            if part:
                norm = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                words += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return words, len(parts) - 1


class Merger:
    """Counts a word's tokens by merging: a heap of adjacent pairs by rank over a linked list of symbols."""

    def __init__(self, vocabulary: Vocabulary):
        with open(vocabulary.path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.suffix = model.get("end_of_word_suffix") or ""

    def count(self, symbols: str) -> int:
        """Initial symbols minus merges. symbols: a word in the byte alphabet, not empty."""
        ranks = self.ranks
        at: list[str | None] = [*symbols]
        size = len(at)
        at[-1] += self.suffix
        after = [*range(1, size), -1]
        before = [*range(-1, size - 1)]
        heap = [(rank, i, at[i], at[i + 1]) for i in range(size - 1) if (rank := ranks.get((at[i], at[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heappop(heap)
            j = after[i]
            if at[i] != left or j < 0 or at[j] != right:
                continue  # one of the two has been merged since
            at[i], at[j] = left + right, None
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (rank := ranks.get((at[i], at[k]))) is not None:
                    heappush(heap, (rank, i, at[i], at[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get((at[h], at[i]))) is not None:
                heappush(heap, (rank, h, at[h], at[i]))
        return size - merges


class Cache(dict):
    """What each word becomes, made when first asked for.

    Two generations of bounded size: when the young one is full it becomes the old one, from which words that
    are asked for again return. So frequent words stay and those seen once go.
    """

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, word: str):
        made = self.old.get(word)
        if made is None:
            made = self.make(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = made
        return made


class Counter:
    """Token counts of texts; no identifiers are made."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        merger = Merger(self.vocabulary)
        self._common = Cache(lambda w: merger.count(self.vocabulary.symbols(w)))
        self._any = Cache(merger.count)

    def count(self, text: str) -> int:
        if self.vocabulary.is_common(text):
            return sum(map(self._common.__getitem__, self.vocabulary.common_words(text)))
        words, specials = self.vocabulary.library_words(text)
        return specials + sum(map(self._any.__getitem__, words))


class Encoder:
    """Identifiers of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._common = Cache(self._encode_word)

    def _encode_word(self, word: str) -> bytes:
        return _packed([token.id for token in self.vocabulary.library.model.tokenize(self.vocabulary.symbols(word))])

    def encode_bytes(self, text: str) -> bytes:
        if self.vocabulary.is_common(text):
            return b"".join(map(self._common.__getitem__, self.vocabulary.common_words(text)))
        return _packed(self.vocabulary.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker and vocabulary."""
    return Counter(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
