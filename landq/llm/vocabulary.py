"""Whole texts to token ids with the tokenizers library, one call for each word that a worker has not met yet.

The pre-tokenizers of both vocabularies never look across the places where a text is cut here, so the ids of a text
are the ids of its words in a row. Texts whose white space runs on (where that would not hold) go to the library whole.
"""

from __future__ import annotations

import re
import struct

import regex

from landq.llm.common import per_worker

#: Words kept by one worker; further ones are encoded anew each time they occur.
KEPT_WORDS = 600_000
KEPT_PIECES = 100_000
#: Texts beyond Latin letters leave the split into pieces to the library.
LATIN = re.compile("[\x00-ɏ]*")
#: White space for which words don't stand alone: other kinds than blank and line feed, or two in a row.
IRREGULAR = re.compile(r"[^\S \n]|[ \n]{2}")
#: Characters that Python takes for white space, or that normalize to it, and the word vocabulary may not.
ODD_SPACES = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
#: The split patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Kept(dict):
    """A dictionary that makes missing values, and keeps them while it is not full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers; special tokens inside texts are recognized."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.specials = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.model, self.letters, self.split = self.whole.model, byte_letters(), regex.compile(pattern)
        self.pieces = Kept(self.piece, KEPT_PIECES)
        self.words = Kept(self.word, KEPT_WORDS)

    def library(self, text: str) -> bytes:
        return packed(self.whole.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        shown = piece.replace(" ", "\u0120") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return packed([token.id for token in self.model.tokenize(shown)])

    def part(self, text: str) -> bytes:
        if not (text.isascii() or LATIN.fullmatch(text)):
            return self.library(text)
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))

    def word(self, word: str) -> bytes:
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        raise NotImplementedError


class ByteEncoder(Encoder):
    """Byte-level vocabulary: a blank belongs to the word behind it."""

    def __init__(self, path: str):
        super().__init__(path, BYTE_PATTERN)

    def word(self, word: str) -> bytes:
        if word.isalpha() and (word.isascii() or LATIN.fullmatch(word)):
            return self.piece(" " + word)
        if word[-1] in ".,":
            body = word[:-1]
            if body.isalpha() and (body.isascii() or LATIN.fullmatch(body)):
                return self.words[body] + self.pieces[word[-1]]
        return self.part(word if word[0] == "\n" else " " + word)

    def encode(self, text: str) -> bytes:
        if IRREGULAR.search(text) or any(s in text for s in self.specials):
            return self.library(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        if rest and not rest[-1]:  # white space at the end
            return self.library(text)
        return b"".join([self.part(first), *map(self.words.__getitem__, rest)])


class WordEncoder(Encoder):
    """Lower-case vocabulary with word ends: white space only separates."""

    def __init__(self, path: str):
        super().__init__(path, WORD_PATTERN)
        self.normalize = self.whole.normalizer.normalize_str

    def word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            lowered = word.lower()
            return self.piece(word) if lowered == word else self.words[lowered]
        if word[-1] in ".,":
            body = word[:-1]
            if body.isalpha() and (body.isascii() or LATIN.fullmatch(body) and self.normalize(body).isalpha()):
                return self.words[body] + self.pieces[word[-1]]
        # what is split is the normalized word: a letter may become a letter and a mark
        plain = self.normalize(word)
        if plain.isalpha() and LATIN.fullmatch(plain):
            return self.piece(plain)
        if not LATIN.fullmatch(plain) or any(s in word for s in self.specials):
            return self.library(word)
        return b"".join(map(self.pieces.__getitem__, self.split.findall(plain)))

    def encode(self, text: str) -> bytes:
        if ODD_SPACES.search(text):
            return self.library(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def vocabulary_path(name: str) -> str:
    """A name among the public vocabularies, or a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(kind: type[Encoder], vocabulary: str) -> Encoder:
    """The worker's encoder, with the words it knows already."""
    return per_worker((kind.__name__, vocabulary), lambda: kind(vocabulary_path(vocabulary)))
