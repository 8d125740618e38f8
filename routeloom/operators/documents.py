"""Document corpus: cleaning, chunking, vectors."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from hashlib import md5
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line breaks and blanks as Unicode text handling has them, and the headings of back matter.
LINE_BREAKS = ["\r\n", *"\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"]
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BACK_MATTER = [
    "normative references", "informative references", "full copyright statement", "editors' addresses",
    "intellectual property",
]

CHUNK_SIZE = 800
CHUNK_OVERLAP = 100

#: Rows that a Python worker gives back at once.
BATCH = 256


# ``m``: ^ at every line; ``d``: only \\n ends a line, as all breaks are turned into it first.
_FLAGS = "(?imd)"


def _line_with(text: str, *words: str) -> Column:
    """Position of the first line that holds one of the words, in any case; 0 when none does.

    Words are searched one by one, which takes a fifth of the time of a pattern of lines or of alternatives.
    """
    each = [F.nullif(F.regexp_instr(F.col(text), F.lit(f"(?i){word}")), F.lit(0)) for word in words]
    found = F.least(*each) if len(each) > 1 else each[0]
    return F.coalesce(found - F.length(F.substring_index(_until(text, found), "\n", -1)), F.lit(0))


def _until(text: str, position: Column) -> Column:
    return F.substr(F.col(text), F.lit(1), position - 1)


def clean_documents(documents: DataFrame, text: str = "text", skip_lines: int = 250, strict_toc: bool = False) -> DataFrame:
    """Replace ``text`` by its cleaned form.

    Starts at the abstract; drops the table of contents up to the first "1. Introduction" line (which usually is the
    entry inside the contents; ``strict_toc`` takes the last one); cuts at the first back-matter heading past
    ``skip_lines``; trims lines and drops blank ones.  All but the last step works on positions in the text, so it is a
    few linear passes of generated code; plain replacing, cutting and trimming take a tenth of the time of patterns.
    """
    introduction = r"[ \t]*1\.[ \t]+introduction"
    if strict_toc:
        before_last = F.regexp_extract("_t", rf"(?is)\A(.*\n)?{introduction}", 1)
        body = F.when(F.col("_t").rlike(rf"{_FLAGS}^{introduction}"), F.length(before_last) + 1).otherwise(0)
    else:
        body = F.regexp_instr(F.col("_t"), F.lit(f"{_FLAGS}^{introduction}"))
    if skip_lines > 0:
        kept = F.substring_index("_t", "\n", skip_lines)
        tail_at = F.length(kept) + 2
    else:
        tail_at = F.lit(1)
    broken = F.col(text)
    for mark in LINE_BREAKS:
        broken = F.replace(broken, F.lit(mark), F.lit("\n"))
    lines = F.transform(F.split("_t", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    return (
        documents.withColumn("_t", broken)
        .withColumn("_t", F.substr(F.col("_t"), F.greatest(_line_with("_t", "abstract"), F.lit(1))))
        .withColumn("_toc", _line_with("_t", "table of contents"))
        .withColumn("_body", body)
        .withColumn(
            "_t",
            F.when(
                (F.col("_toc") > 0) & (F.col("_toc") < F.col("_body")),
                F.concat(_until("_t", F.col("_toc")), F.substr(F.col("_t"), F.col("_body"))),
            ).otherwise(F.col("_t")),
        )
        .withColumn("_tail_at", tail_at)
        .withColumn("_tail", F.substr(F.col("_t"), F.col("_tail_at")))
        .withColumn("_cut", _line_with("_tail", *BACK_MATTER))
        .withColumn("_t", F.when(F.col("_cut") > 0, _until("_t", F.col("_tail_at") + F.col("_cut") - 1)).otherwise(F.col("_t")))
        .withColumn(text, F.array_join(F.filter(lines, lambda line: line != ""), "\n"))
        .drop("_t", "_toc", "_body", "_tail_at", "_tail", "_cut")
    )


def clean_name(source: Column | str) -> Column:
    """``x.txt`` to ``x_clean.txt``, at every occurrence."""
    return F.replace(F.col(source) if isinstance(source, str) else source, F.lit(".txt"), F.lit("_clean.txt"))


def document_label(source: Column | str) -> Column:
    """``rfc<N>_clean.txt`` to ``RFC <N>``, anything else to ``Unknown RFC``."""
    source = F.col(source) if isinstance(source, str) else source
    number = F.replace(F.replace(source, F.lit("rfc"), F.lit("")), F.lit("_clean.txt"), F.lit(""))
    known = F.startswith(source, F.lit("rfc")) & F.endswith(source, F.lit("_clean.txt"))
    return F.when(known, F.concat(F.lit("RFC "), number)).otherwise("Unknown RFC")


# -- chunks ---------------------------------------------------------------------------------------------------

SEPARATORS = ["\n\n", "\n", " ", ""]


def _runs(text: str, size: int, level: int = 0) -> Iterator[list[str]]:
    """Runs of pieces that may be packed together.

    Text is cut at the coarsest separator it holds, which stays at the head of the piece after it.  A piece as long as a
    chunk ends the run and is cut at the next finer separator, giving runs of its own.
    """
    while SEPARATORS[level] not in text:
        level += 1
    sep = SEPARATORS[level]
    if sep:
        first, *rest = text.split(sep)
        pieces = [first, *(sep + piece for piece in rest)]
    else:
        pieces = list(text)
    run: list[str] = []
    for piece in filter(None, pieces):
        if len(piece) < size or not sep:
            run.append(piece)
        else:
            yield run
            run = []
            yield from _runs(piece, size, level + 1)
    yield run


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Longest chunks of at most ``size``; each starts with as many trailing pieces of the last as fit ``overlap``."""
    ends = [0, *accumulate(map(len, pieces))]
    start, last = 0, len(pieces)
    while start < last:
        end = bisect_right(ends, ends[start] + size) - 1
        chunk = "".join(pieces[start:end]).strip()
        if chunk:
            yield chunk
        if end == last:
            return
        start = bisect_left(ends, max(ends[end] - overlap, ends[end + 1] - size), start)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    return [chunk for run in _runs(text, size) for chunk in _pack(run, size, overlap)]


def chunk_documents(
    documents: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk, ``chunk_no`` from 0 per document; documents without text give none.

    Packing is a fold over the pieces of one text, linear here, while the array functions of SQL would copy their
    result at every step; so it is an Arrow batch function.
    """

    @F.pandas_udf("array<string>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:  # given back some documents at a time
            for at in range(0, len(texts), BATCH):
                yield texts.iloc[at : at + BATCH].map(lambda t: split_text(t, size, overlap) if t else [])

    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.posexplode(chunks(text)).alias("chunk_no", text))


# -- vectors --------------------------------------------------------------------------------------------------


def term_slots(text: str, dims: int) -> Column:
    """Slot of every term of a text, repeats included: runs of letters and digits, in lower case, by their MD5."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    slot = lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("int"), F.lit(dims))
    return F.transform(F.coalesce(terms, F.array().cast("array<string>")), slot)


#: Texts whose letters, digits and lower case are the same in Python and in the JVM, whatever their Unicode versions.
_PLAIN = re.compile("[\x00-\u012f\u0131-\u024f\u2000-\u206f\u20a0-\u20bf]*").fullmatch
_BREAKS = {c: " " for c in [*range(0x250), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)] if not chr(c).isalnum()}

#: Terms whose slots a worker remembers.
REMEMBERED = 1 << 19


class _Slots(dict):
    def __init__(self, dims: int) -> None:
        self.dims = dims

    def __missing__(self, term: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[term] = slot = int(md5(term.encode()).hexdigest()[:7], 16) % self.dims
        return slot


def _packed(texts: pd.Series, slots: _Slots) -> list[bytes | None]:
    known = [not t or t.isascii() or _PLAIN(t) is not None for t in texts]
    cut = [t.lower().translate(_BREAKS) if t and ok else "" for t, ok in zip(texts, known)]
    words = pc.ascii_split_whitespace(pa.array(cut, "large_string"))
    distinct = words.flatten().dictionary_encode()
    # blanks at the ends leave an empty word
    slot = np.array([slots[w] if w else -1 for w in distinct.dictionary.to_pylist()], np.int64)[distinct.indices.to_numpy()]
    ends = np.concatenate([[0], np.cumsum(slot >= 0)])[words.offsets.to_numpy()] * 2
    packed = slot[slot >= 0].astype("<u2").tobytes()
    return [packed[a:b] if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), known)]


def packed_slots(text: str, dims: int) -> Column:
    """``term_slots`` as two bytes each; plain texts are taken apart in Python, which remembers the slots of terms."""
    if dims > 1 << 16:
        raise ValueError("packed slots take two bytes")

    @F.pandas_udf("binary")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = _Slots(dims)
        for texts in batches:
            yield pd.Series(_packed(texts, slots), texts.index, object)

    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    both = F.transform(term_slots(text, dims), lambda s: F.concat(byte(s.bitwiseAND(F.lit(255))), byte(F.shiftright(s, 8))))
    return F.coalesce(plain(text), F.unhex(F.array_join(both, "")))


def fit_packed(rows: DataFrame, dims: int = 1024) -> np.ndarray:
    """``fit_vectorizer`` from packed embeddings."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            cells = batch["embedding"]
            n += len(cells)
            terms = np.repeat(np.arange(len(cells)) * dims, [len(c) // 2 for c in cells])
            found += np.bincount(np.unique(terms + np.frombuffer(b"".join(cells), "<u2")) % dims, minlength=dims)
        yield pd.DataFrame({"slot": np.arange(-1, dims), "n": np.concatenate([[n], found])})

    parts = rows.select("embedding").mapInPandas(counts, "slot int, n bigint")
    found = parts.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # a row for each dimension, and one for all texts
    n = np.zeros(dims + 1)
    n[found["slot"].to_numpy() + 1] = found["n"].to_numpy()
    return np.log((n[0] + 1) / (n[1:] + 1))


def fit_vectorizer(chunks: DataFrame, text: str = "text", dims: int = 1024) -> np.ndarray:
    """Inverse document frequencies of hashed terms: ``dims`` numbers, whatever the data; one pass."""
    slots = chunks.select(F.explode(F.array_distinct(term_slots(text, dims))).alias("slot"))
    found = slots.groupBy("slot").agg(F.count("*").alias("n")).toArrow()  # at most ``dims`` rows
    n = np.zeros(dims)
    n[found["slot"].to_numpy()] = found["n"].to_numpy()
    return np.log((chunks.count() + 1) / (n + 1))


def vectorize(rows: DataFrame, weights: np.ndarray, text: str = "text", packed: bool = False) -> DataFrame:
    """Add ``embedding``, hashed TF-IDF of unit length; the zero vector if no term has weight.

    ``packed`` gives the slots of the terms instead, two bytes each, of which ``unpacked`` makes the same vectors: some
    hundred bytes for a chunk in place of eight for each dimension.
    """
    dims = len(weights)
    if packed:
        return rows.withColumn("embedding", packed_slots(text, dims))

    @F.pandas_udf("array<double>")
    def unit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return vectorized(batches, weights)

    return rows.withColumn("embedding", unit(term_slots(text, dims)))


def vectorized(batches: Iterable[pd.Series], weights: np.ndarray) -> Iterator[pd.Series]:
    """Vectors of batches of slots, given back a few rows at a time, as they take eight bytes a dimension."""

    def one(own) -> np.ndarray:
        v = np.bincount(own, minlength=len(weights)) * weights
        return v / (np.linalg.norm(v) or 1.0)

    for slots in batches:
        for at in range(0, len(slots), BATCH):
            yield slots.iloc[at : at + BATCH].map(one)


def unpacked(weights: np.ndarray) -> Callable[[pd.Series], np.ndarray]:
    """What turns packed embeddings into a matrix of their vectors."""
    dims = len(weights)

    def matrix(cells: pd.Series) -> np.ndarray:
        slots = np.frombuffer(b"".join(cells), "<u2").astype(np.int64)
        rows = np.repeat(np.arange(len(cells)), [len(c) // 2 for c in cells])
        return np.bincount(rows * dims + slots, minlength=len(cells) * dims).reshape(len(cells), dims) * weights

    return matrix
