"""Language identification by prediction by partial matching over bytes.

Per language a tree of contexts of up to ``order`` bytes holds how often each byte followed.  A byte costs, at the
longest context that the language has, either its own code length or that of an escape, and so on at the next shorter
context, where bytes seen in the longer one are excluded (escapes by method C: as many as there were distinct bytes).
Below the empty context all bytes not yet excluded are equally likely.  Statistics are frozen after training, so a
text's code length is a sum of table entries, and the language with the least length is the prediction.

The model is bounded: training reads at most about ``train_bytes`` bytes a language, chosen by a hash of the text over
all learned documents, and at most ``contexts`` contexts of each length above one are kept, the most frequent ones; a text whose context is not
kept goes on from its longest suffix that is.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, map_batches, record, text_of, utf8

UNKNOWN = "und"

_LETTER = r"\p{L}"


@dataclass
class Model:
    """Code lengths in bits, ``cost[row, symbol, language]``.

    Bytes that training did not meet share the last symbol.  ``row`` gives the row of each code of the last ``order``
    symbols; texts begin as if line ends stood before them.
    """

    languages: list[str]
    symbol: np.ndarray
    order: int
    row: np.ndarray
    cost: np.ndarray

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The code length of each text in each language; work goes by slices of bounded size."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        at = 0
        while at < len(offsets) - 1:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
            out[at:end] = self._sums(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end
        return out

    def _sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        s = self.symbol[data]
        codes = context_codes(s, offsets, self.order, self.cost.shape[1], self.symbol[10])
        cost = self.cost.reshape(-1, len(self.languages))[self.row[codes] * self.cost.shape[1] + s]
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        used = np.flatnonzero(np.diff(offsets))
        if len(used):
            sums[used] = np.add.reduceat(cost, offsets[used], axis=0, dtype=np.float64)
        return sums


def context_codes(s: np.ndarray, offsets: np.ndarray, order: int, n: int, start: int) -> np.ndarray:
    """The last ``order`` symbols before each position as one number of base n."""
    codes = np.zeros(len(s), np.int64)
    for back in range(order, 0, -1):
        before = np.empty(len(s), np.int64)
        before[back:], before[:back] = s[:-back] if back < len(s) else [], start
        for i in range(back):  # positions that have fewer bytes before them
            near = offsets[:-1] + i
            before[near[near < offsets[1:]]] = start
        codes = codes * n + before
    return codes


def fit(docs: DataFrame, order: int = 3, train_bytes: int = 4_000_000, contexts: int = 16_000) -> Model:
    """Learns from (text, lang); rows whose text or lang is null are left out.  No rows give a model of no languages."""
    learned = docs.select(text_of().alias("text"), "lang").where("lang IS NOT NULL AND text <> ''")
    size = F.octet_length("text")
    totals = {r.lang: r.n for r in learned.groupBy("lang").agg(F.sum(size).alias("n")).collect()}  # a row per language
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros(256, np.int64), order, np.zeros(1, np.int32), np.zeros((1, 1, 0), np.float32))
    number = {lang: i for i, lang in enumerate(languages)}
    share = F.create_map(*(x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, train_bytes / n)))))
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)

    def work(batches: Batches) -> Batches:
        gathered: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            langs = np.array([number[x] for x in batch.column(1).to_pylist()])
            grams = context_codes(data, offsets, order, 256, 10) * 256 + data
            of = np.repeat(langs, np.diff(offsets))
            for i in np.unique(langs):
                keys, n = np.unique(grams[of == i], return_counts=True)
                if i in gathered:
                    keys, inverse = np.unique(np.concatenate([gathered[i][0], keys]), return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([gathered[i][1], n])).astype(np.int64)
                gathered[int(i)] = keys, n
        for i, (keys, n) in gathered.items():
            yield record(lang=np.full(len(keys), i, np.int32), gram=keys.astype(np.int64), n=n.astype(np.int64))

    sums = map_batches(learned.where(chosen), work, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # bounded by the bytes trained on
    return build(languages, order, contexts, *(found[c].to_numpy().astype(np.int64) for c in ("lang", "gram", "n")))


def build(languages: list[str], order: int, contexts: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The tables of code lengths from counts of (order + 1)-grams of bytes."""
    present = np.unique(np.concatenate([gram >> 8 * i & 255 for i in range(order + 1)] + [np.array([10])]))
    symbol = np.full(256, len(present), np.int64)
    symbol[present] = np.arange(len(present))
    a = len(present) + 1
    code = sum(symbol[gram >> 8 * i & 255] * a**i for i in range(order + 1))

    # contexts kept of each order, as codes: all up to one byte, of longer ones the most frequent, ties by code
    nodes = [np.arange(a**o) for o in range(min(order, 1) + 1)]
    for o in range(2, order + 1):
        context, inverse = np.unique(code // a % a**o, return_inverse=True)
        frequency = np.bincount(inverse, n)
        nodes.append(np.sort(context[np.lexsort((context, -frequency))[:contexts]]))
    firsts = np.cumsum([0] + [len(x) for x in nodes])
    row = np.zeros(a**order, np.int32)
    for o, own in enumerate(nodes):  # the row of the longest context kept
        last = np.full(a**o, -1, np.int32)
        last[own] = firsts[o] + np.arange(len(own))
        last = np.tile(last, a ** (order - o))
        row = np.where(last >= 0, last, row)

    shares = np.ones(a)
    shares[-1] = 256 - len(present)  # bytes that share the last symbol
    cost = np.zeros((firsts[-1], a, len(languages)), np.float32)
    for i in range(len(languages)):
        own = lang == i
        counts = [np.bincount(code[own] % a ** (o + 1), n[own], a ** (o + 1)).astype(np.float32).reshape(-1, a) for o in range(order)]
        longest = np.zeros((len(nodes[order]), a), np.float32)
        use = own & np.isin(code // a, nodes[order])
        np.add.at(longest, (np.searchsorted(nodes[order], code[use] // a), code[use] % a), n[use])
        for o, rows in enumerate(nodes):
            levels = [counts[j][rows % a**j] if j < order else longest for j in range(o + 1)]
            cost[firsts[o] : firsts[o + 1], :, i] = _escaping(levels, shares)
    return Model(languages, symbol, order, row, cost)


def _escaping(counts: list[np.ndarray], shares: np.ndarray) -> np.ndarray:
    """Bits of each symbol after each of the same rows of contexts, counts given from the shortest to the longest.

    A context without counts is passed over free of charge; a symbol is charged where it is first found.
    """
    out = np.zeros(counts[0].shape)
    open_ = np.ones(out.shape, bool)
    for c in reversed(counts):
        c = np.where(open_, c, 0)  # bytes of longer contexts are excluded
        distinct = (c > 0).sum(axis=1, keepdims=True)
        total = c.sum(axis=1, keepdims=True) + distinct
        hit = c > 0
        left = (open_ & ~hit).any(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(left, total, total - distinct)  # no escape where nothing is left to escape to
            out += np.where(hit, np.log2(total) - np.log2(np.where(hit, c, 1)), np.where(open_ & (distinct > 0), np.log2(total) - np.log2(np.maximum(distinct, 1)), 0))
        open_ &= ~hit
    rest = (open_ * shares).sum(axis=1, keepdims=True)
    return out + np.where(open_, np.log2(np.maximum(rest, 1)), 0)


def predict(docs: DataFrame, model: Model, keep: dict[str, Column]) -> DataFrame:
    """The columns of ``keep``, lang_pred, score: the language of the least code length (ties to the first in order) and its posterior.

    ``und`` with score 0 if the text is null or has no letter, or no language was learned.  Rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    cached: list[Model] = []
    names = list(keep)
    text = text_of().alias("__text"), text_of().rlike(_LETTER).alias("__letter")
    prepared = docs.select(*(c.alias(x) for x, c in keep.items()), *text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prepared.schema[: len(keep)]) + ", lang_pred string, score double"

    def work(batches: Batches) -> Batches:
        for batch in batches:
            if not cached:
                cached.append(pickle.loads(shared.value))
            m = cached[0]
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if m.languages:
                bits = m.lengths(*utf8(batch.column("__text")))
                best = bits.argmin(axis=1)
                odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                letter = np.array(batch.column("__letter").to_pylist(), bool)
                lang = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter)]
                score = np.where(letter, 1 / odds, 0.0)
            yield record(**{x: batch.column(x) for x in names}, lang_pred=pa.array(lang, pa.string()), score=score)

    return map_batches(prepared, work, schema)
