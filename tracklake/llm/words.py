"""Encoders over the ``tokenizers`` library that encode every distinct word of a task once.

Both vocabularies split a text into words before any merge, and no word
crosses a blank between two non-blank characters.  A document's ids are therefore the joined
ids of its blank-separated pieces, and a piece seen before is a dictionary
lookup.  Ids are kept as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from functools import lru_cache

import numpy as np

from .common import held_by

# a full cache is emptied: memory stays bounded, only speed depends on it
CACHE_PIECES = 300_000
KEY_LENGTH = 32  # so many characters a key on average fill it too


class Memo(dict):
    """Dictionary that computes and keeps missing values, as many and as long keys as the limit allows."""

    def __init__(self, compute, limit: int = CACHE_PIECES):
        super().__init__()
        self.compute, self.limit, self.length = compute, limit, 0

    def __missing__(self, key):
        value = self.compute(key)
        if hasattr(key, "__len__"):
            if len(key) > self.limit:  # not worth its room
                return value
            self.length += len(key)
        if len(self) >= self.limit or self.length > self.limit * KEY_LENGTH:
            self.clear()
            self.length = 0
        self[key] = value
        return value


def byte_chars() -> list[str]:
    """Character that stands for each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others for the characters from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


# white space, digits, case or normal form of these differ between Python and the library
UNSAFE = re.compile("[\x1c-\x1f\x85\xa0²³¹¼½¾İɐ-\U0010ffff]")
ASCII_BLANKS = re.compile("[ \t\n\r\x0b\x0c]+")


class WordBpe:
    """Lower-cased BPE with word ends (``word_bpe_49k.json``)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.chars = byte_chars()
        # the splitting pattern of the file, written for Python's classes; used on safe texts only
        self.words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
        self.word_ids = Memo(self._word)
        self.safe = Memo(self._safe)
        self.any = Memo(lambda piece: packed(self.lib.encode(piece, add_special_tokens=False).ids), 100_000)

    def _word(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        mapped = word if plain else "".join(map(self.chars.__getitem__, word.encode()))
        return packed([t.id for t in self.model.tokenize(mapped)])

    def _safe(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.word_ids[piece]
        if piece[:-1].isalpha():  # a word and one mark
            return self.word_ids[piece[:-1]] + self.word_ids[piece[-1]]
        return b"".join(map(self.word_ids.__getitem__, self.words.findall(piece)))

    def encode(self, text: str) -> bytes:
        if UNSAFE.search(text) or "<|" in text:
            return b"".join(map(self.any.__getitem__, filter(None, ASCII_BLANKS.split(text))))
        return b"".join(map(self.safe.__getitem__, text.lower().split()))


class ByteBpe:
    """Byte-level BPE from a rank file (token in base 64, rank), as merges of the library's model.

    Merging the adjacent pair whose joined token has the lowest rank is BPE
    with every way of cutting a token in two as a merge, in order of rank.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers.models import BPE
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.chars = byte_chars()
        as_text = {t: "".join(map(self.chars.__getitem__, t)) for t in ranks}
        merges = [(as_text[t[:i]], as_text[t[i:]]) for t in sorted(ranks, key=ranks.get)
                  for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = BPE({as_text[t]: r for t, r in ranks.items()}, merges)
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token_bytes = {r: t for t, r in ranks.items()}
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for t, r in ranks.items():
            self.length[r] = len(t)
        self.word_ids = Memo(self._word)
        self.first = Memo(self._piece, 50_000)
        self.later = Memo(lambda piece: self._piece(" " + piece))

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        rank = self.ranks.get(raw)
        if rank is not None:
            return packed([rank])
        return packed([t.id for t in self.model.tokenize("".join(map(self.chars.__getitem__, raw)))])

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.word_ids.__getitem__, self.pattern.findall(piece)))

    # a blank between two characters that are not white space starts a new word
    TOUCHING = re.compile(r" \s|\s ")
    CUT = re.compile(r"(?<=\S) (?=\S)")

    def _touching(self, text: str) -> bool:
        """Whether a blank may touch other white space, or end the text."""
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text:
            return True
        blanks = text.count(" ") + text.count("\n")
        # no other white space: as many words as blanks allow
        return len(text.split()) != blanks + 1 and self.TOUCHING.search(text) is not None

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = self.CUT.split(text) if self._touching(text) else text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))

    def decode(self, ids) -> bytes:
        """Bytes of the ids; a token may hold part of a character, only the joined bytes are text."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def offsets(self, text: str, ids) -> tuple[list[int], list[int]]:
        """Character offsets [start, end) of each token; a token that holds part
        of a character covers the whole character."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # character that each byte belongs to
        ends = np.cumsum(self.length[np.asarray(ids, dtype=np.int64)])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return char_of[starts].tolist(), (char_of[ends - 1] + 1).tolist()


@held_by("dac", "packing")
@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@held_by("bytebpe")
@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)
