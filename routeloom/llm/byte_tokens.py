"""Exact byte-level BPE ids by the tokenizers library, with a memory of words seen.

The vocabulary's pre-tokenizer cuts a text into words that are encoded each by itself, so a word needs encoding once.
Texts are cut where such a word surely ends: before each space that a non-space follows, behind plain letters and behind
plain punctuation and line ends after these; other chunks go through the pre-tokenizer's own pattern.  A text that has a space
before other white space, or rare control characters, is encoded whole.  So is one that holds the string of an added token: that is one
id, and cuts the text before the pre-tokenizer does.
"""

from __future__ import annotations

import re
from array import array

import regex

#: Words remembered by a worker at most; beyond that new ones are encoded each time they come.
REMEMBERED = 500_000

# The word pattern of this vocabulary's byte-level pre-tokenizer.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Letters to U+024F, all of which are \p{L}; a run of them is a word, with the space before it, unless a character outside ASCII or
# an apostrophe follows.  Of several line ends before a letter the last is a word of its own.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
CHUNK = rf" ?[{_LETTER}]++(?![^\0-\x7f'])|[.,;:!?]++(?=[ \n]|\Z)|\n+(?=\n[{_LETTER}])|\n(?=[{_LETTER}])|[\s\S][^ ]*(?: \Z)?"

_ENCODERS: dict[str, Encoder] = {}


class _Memory(dict):
    """Makes and, from the second time on, remembers values; most keys of a corpus come once."""

    def __init__(self, make):
        self.make = make
        self.once = bytearray(1 << 22)

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        slot = hash(key) & 0x3FFFFF
        if self.once[slot] and len(self) < REMEMBERED:
            self[key] = value
        self.once[slot] = 1
        return value


class Encoder:
    """Ids as little-endian unsigned 16-bit numbers, or 32-bit ones for a vocabulary that needs them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = f"<u{array(self.code).itemsize}"
        self.tokenize = self.tokenizer.model.tokenize
        # how a byte-level vocabulary writes bytes: as the printable characters of Latin-1, others from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in printable)
        self.written = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}
        self.space = chr(self.written[32])
        self.words = _Memory(self.word)
        self.chunks = _Memory(self._chunk)
        self.find = regex.compile(WORD).findall
        self.cut = re.compile(CHUNK).findall
        self.odd = re.compile(r" \s|[\0-\x08\x0e-\x1f\x7f-\x9f\u180e]")
        self.rare = re.compile("[\u0250-\U0010ffff]")  # here two libraries may differ in what is a letter

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Of a text that the pre-tokenizer would not cut."""
        if word.isascii() and word.isprintable():
            written = word.replace(" ", self.space)
        else:
            written = word.encode().decode("latin-1").translate(self.written)
        return array(self.code, [t.id for t in self.tokenize(written)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        letters = chunk[1:] if chunk[0] == " " else chunk
        if letters.isascii() and letters.isalpha():
            return array(self.code, [t.id for t in self.tokenize(chunk.replace(" ", self.space))]).tobytes()
        if not chunk.isascii() and self.rare.search(chunk):
            return self.whole(chunk)
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self.word(chunk)
        return b"".join(map(self.words.__getitem__, self.find(chunk)))

    def encode(self, text: str) -> bytes:
        plain = "  " not in text and " \n" not in text and text.replace("\n", " ").isprintable()
        if not plain and self.odd.search(text):
            return self.whole(text)
        for token in self.added:
            if token in text:
                return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, self.cut(text)))


def encoder(path: str) -> Encoder:
    """One per process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
