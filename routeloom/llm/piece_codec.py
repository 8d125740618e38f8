"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback, exactly as the library's.

A sequence of pieces is the result of merging if each piece and each two neighbours are what merging makes of their own
characters.  So encoding walks along the text with the longest piece that matches (all matches come from one pass of an
Aho-Corasick automaton), checks it against the piece before by merging the two again, takes shorter ones where that
fails, and steps back where none is left, marking the position as failed in a bitfield.

No piece has a space after another character, so texts fall apart before spaces, and at characters that are in no
piece and come out as bytes; parts seen before are remembered.  A run of spaces, whose pieces have equal scores, is
merged plainly.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Batches, map_batches, record, text_of

#: Parts and pairs of pieces remembered by a task at most.
REMEMBERED = 600_000

SPACE = "▁"
NEVER = float("-inf")

_CODECS: dict[str, Codec] = {}


class _Parts(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < REMEMBERED:
            self[key] = value
        return value


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.id = {model.id_to_piece(i): i for i in ids if i not in special and not model.is_byte(i)}
        self.score = {piece: model.get_score(i) for piece, i in self.id.items()}
        self.end = model.eos_id()
        if any(SPACE in piece.lstrip(SPACE) for piece in self.id) or any(c not in self.id for piece in self.id for c in piece):
            raise ValueError("a piece with an inner space, or with a character that is no piece, is not supported")
        self.code = "H" if len(ids) <= 1 << 16 else "I"
        self.dtype = f"<u{array(self.code).itemsize}"
        surface = {i: bytes([b]) for b, i in self.byte.items()} | {i: piece.replace(SPACE, " ").encode() for piece, i in self.id.items()}
        self.surface = [surface.get(i, b"") for i in ids]
        self.decimal = [b"%d" % i for i in ids]
        self.matches = ahocorasick.Automaton()
        for piece in self.id:
            if self.merged(piece) == [piece]:  # else no text gives it
                self.matches.add_word(piece, len(piece))
        self.matches.make_automaton()
        alphabet = "".join(re.escape(c) for c in self.id if len(c) == 1)
        self.parts = re.compile(f"[{alphabet}]+|[^{alphabet}]").findall
        self.spaces = re.compile(f"{SPACE}*[^{SPACE}]*").findall
        self.fits = _Parts(self._fits)
        self.segments = _Parts(self._segment)
        self.chunks = _Parts(self._chunk)

    def merged(self, text: str) -> list[str]:
        """Plain merging: again and again the neighbours with the best score, the leftmost first."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != NEVER:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def _fits(self, pair: tuple[str, str]) -> bool:
        return self.merged(pair[0] + pair[1]) == [*pair]

    def walked(self, text: str) -> list[str]:
        """The pieces of a text of known characters, by backtracking."""
        ends: list[list[int]] = [[] for _ in text]
        for last, length in self.matches.iter(text):
            ends[last + 1 - length].append(last + 1)  # for each start from near to far
        taken: list[str] = []
        fits, failed, before, at, size = self.fits, 0, "", 0, len(text)
        limit = size
        while at < size:
            for end in reversed(ends[at]):
                if end <= limit and not failed >> end & 1:
                    piece = text[at:end]
                    if not before or fits[before, piece]:
                        taken.append(piece)
                        before, at, limit = piece, end, size
                        break
            else:
                failed |= 1 << at
                limit = at - 1  # of the piece before, shorter ones are left to try
                at -= len(taken.pop())
                before = taken[-1] if taken else ""
        return taken

    def _segment(self, text: str) -> bytes:
        """Ids of a part that is of known characters, or one other character."""
        if text[0] not in self.id:
            return array(self.code, [self.byte[b] for b in text.encode()]).tobytes()
        pieces = self.merged(text) if SPACE * 2 in text else self.walked(text)
        return array(self.code, [self.id[p] for p in pieces]).tobytes()

    def _chunk(self, text: str) -> bytes:
        parts = self.parts(text)
        return self._segment(text) if len(parts) == 1 else b"".join(map(self.segments.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """Ids with the end id, as little-endian unsigned numbers."""
        end = array(self.code, [self.end]).tobytes()
        if not text:
            return end
        text = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 in text or "\0" in text:
            chunks = self.spaces(text)
        else:
            chunks = text.replace(SPACE, "\0" + SPACE).split("\0")
        return b"".join(map(self.chunks.__getitem__, chunks)) + end

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((self.surface[i] for i in ids if self.surface[i]), b"")
        if first[:1] == b" " and self.byte.get(32) != next(i for i in ids if self.surface[i]):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # ids that no text gives: every stray byte is a replacement character
            return raw.decode(errors="surrogateescape").translate({0xDC00 + b: 0xFFFD for b in range(128, 256)})


def codec(path: str) -> Codec:
    """One per process and model."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every whole text.

    Null or empty text is the end id alone and decodes to the empty text.  Each row is by itself: repeated rows, null
    doc_ids and no rows are no special case; other columns of ``docs`` are ignored.
    """

    def work(batches: Batches) -> Batches:
        c = codec(model)
        for batch in batches:
            ids = [np.frombuffer(c.encode(t.as_py()), c.dtype).tolist() for t in batch.column(1)]
            yield record(doc_id=batch.column(0), n_tokens=np.array([len(x) for x in ids], np.int64), ids=pa.array(ids, pa.list_(pa.int32())), decoded=[c.decode(x) for x in ids])

    return map_batches(docs.select("doc_id", text_of().alias("text")), work, "doc_id bigint, n_tokens bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests of the decimal ids and of the decoded text in place of these."""

    def work(batches: Batches) -> Batches:
        c = codec(model)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for t in batch.column(1):
                ids = np.frombuffer(c.encode(t.as_py()), c.dtype).tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(b" ".join(map(c.decimal.__getitem__, ids))).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield record(doc_id=batch.column(0), n_tokens=np.array(n, np.int64), ids_sha256=pa.array(of_ids, pa.string()), decoded_sha256=pa.array(of_text, pa.string()))

    return map_batches(docs.select("doc_id", text_of().alias("text")), work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
