"""Removal of long repeated strings, by buckets of a sparse suffix array.

Only starts of strings of ``length`` bytes matter, and of these only those that may repeat.  Every such string has an
anchor: the least, by hash, of the short strings of ``length - SPAN + 1`` bytes in it, which equal strings have at the
same place.  Suffixes that begin with an anchor's short string are one interval of the suffix array, so counting short
strings over the corpus finds the intervals of one suffix, in which nothing repeats, without sorting the rest.  The
consecutive string starts with the same anchor and the bytes they cover are its context.  An interval whose contexts
are all alike repeats as a whole.  Of the others each different context goes once, with its bytes, to the task of its
interval, which orders the string starts so that equal strings stand together, and finds for each the nearest smaller
position before and after it in that order: one that is of an equal string makes the longest previous factor at least
``length``, and the same with larger positions gives the longest next factor.  A large interval is cut, and what its
parts do not find is found by counting hashes of its strings, one row each.

Strings are compared by two 64-bit hashes together: of the short string, and of all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEYS, Batches, kept, keyed, map_batches, mixed, record, text_of, utf8
from .words import prefix_hashes, range_hashes

#: Short strings that a string has; a power of two.
SPAN = 256

#: Contexts of a part of an interval on average.
PART = 2000

_SLICE = 1 << 18


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts of bytes: each anchor's text number, first and last string start, place (all within the text), both hashes."""
    found = []
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, side="right")) - 1)
        part = _anchors(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], length)
        found.append((part[0] + at, *part[1:]))
        at = end
    if not found:
        return _anchors(data, np.zeros(1, np.int64), length)
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    short = length - SPAN + 1
    prefix = prefix_hashes(data)
    begin = np.arange(len(data) - short + 1)
    hashes = range_hashes(prefix, begin, begin + short)
    least, step = begin.astype(np.int32), 1
    while step < SPAN:  # the leftmost least of 1, 2, 4, ... short strings from each on
        a, b = least[:-step], least[step:]
        least = np.where(hashes[b] < hashes[a], b, a)
        step *= 2
    change = np.zeros(len(data) + 1, np.int32)
    long = sizes >= length
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(change[:-1]))
    place = least[start].astype(np.int64)
    text = np.searchsorted(offsets, start, side="right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    a, b, p, text = start[first], start[last], place[first], text[first]
    whole = mixed(range_hashes(prefix, a, b + length) + (p - a).astype(np.uint64))
    base = offsets[text]
    return text, a - base, b - base, p - base, hashes[p], whole


def anchored(docs: DataFrame, length: int) -> DataFrame:
    """(row, doc_id, text_sha256, n_bytes, short, whole) of each row, written once: both hashes of its anchors in order."""

    def work(batches: Batches) -> Batches:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            text, *_, short, whole = anchors(data, offsets, length)
            first = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(first, pa.array(x.view(np.int64))) for x in (short, whole))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets)), *lists], names=["row", "doc_id", "text_sha256", "n_bytes", "short", "whole"])

    text = text_of()
    prepared = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("sha"), text.alias("text"))
    return kept(map_batches(prepared, work, "row bigint, doc_id bigint, text_sha256 string, n_bytes bigint, short array<bigint>, whole array<bigint>"), "anchored")


_MARKS = "array<struct<i:int,first:int,last:int,place:int,short:bigint,all:boolean,sent:boolean,parts:int>>"


def marked(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(row, text, marks) of each different text that has an anchor whose short string repeats, written once.

    ``marks`` are these anchors.  ``all``: all its strings repeat.  ``sent``: its context goes to the interval's task.
    """
    one = rows.groupBy("text_sha256").agg(F.min("row").alias("row"))  # a text's copies share its result
    of = rows.select("row", F.posexplode(F.arrays_zip("short", "whole")).alias("i", "h")).select("row", "i", "h.short", "h.whole")
    n, low, high = F.count(F.lit(1)).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")
    repeats = of.groupBy("short").agg(n, low, high).where("n > 1").select("short", (F.col("low") != F.col("high")).alias("varied"))
    found = kept(of.join(kept(repeats, "repeats"), "short"), "found")
    contexts = found.where("varied").groupBy("short", "whole").agg(n, F.min(F.struct("row", "i")).alias("at"))
    contexts = kept(contexts, "contexts")
    parts = contexts.groupBy("short").agg(F.expr(f"cast(ceil(count(1) / {PART}) as int)").alias("parts"))
    contexts = kept(contexts.join(kept(parts, "parts"), "short"), "contexts")
    # contexts that stand once are sent from where they stand, others from their first place
    several = found.join(contexts.select("short", "whole", "n", "at", "parts"), ["short", "whole"], "left")
    sent = F.coalesce((F.col("at.row") == F.col("row")) & (F.col("at.i") == F.col("i")), F.lit(False))
    mark = F.struct("i", "short", F.coalesce(F.col("n") > 1, F.lit(True)).alias("all"), sent.alias("sent"), F.coalesce("parts", F.lit(1)).alias("parts"))
    marks = several.groupBy("row").agg(F.collect_list(mark).alias("marks"))  # of one text
    wanted = rows.select("row", "doc_id", "text_sha256").join(one.select("row"), "row", "left_semi").join(marks, "row")
    wanted = keyed(wanted, F.col("text_sha256")).select("row", "marks", *ROW_KEYS)
    texts = keyed(docs.select("doc_id", "text")).join(wanted.hint("merge"), ROW_KEYS).select("row", "text", "marks")

    def work(batches: Batches) -> Batches:
        for batch in batches:
            text, first, last, place, *_ = anchors(*utf8(batch.column(1)), length)
            begin = np.searchsorted(text, np.arange(batch.num_rows + 1))
            out = [[m | {"first": int(first[b + m["i"]]), "last": int(last[b + m["i"]]), "place": int(place[b + m["i"]])} for m in marks] for b, marks in zip(begin, batch.column(2).to_pylist())]
            kind = pa.list_(pa.struct([("i", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("place", pa.int32()), ("short", pa.int64()), ("all", pa.bool_()), ("sent", pa.bool_()), ("parts", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["row", "text", "marks"])

    return kept(map_batches(texts.dropDuplicates(["row"]), work, f"row bigint, text string, marks {_MARKS}"), "marked")


def factors(order: np.ndarray, value: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a suffix has an equal one at a smaller, and at a larger, position.

    ``order`` has equal values together.  The nearest smaller position in the order, before or after, lies in the same
    run of equal values unless the suffix has the run's least position; likewise for larger ones.
    """
    v, p = value[order], position[order]
    run = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    earlier, later = np.zeros(len(v), bool), np.zeros(len(v), bool)
    earlier[order] = p > np.minimum.reduceat(p, first)[run]
    later[order] = p < np.maximum.reduceat(p, first)[run]
    return earlier, later


def strings_of(contexts: pa.RecordBatch | pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts (bytes, left): each string's context number, start within the context, and hash.

    Strings at different distances from the anchor differ, so the distance is a part of the hash.
    """
    raw = contexts.column("bytes").to_pylist()
    sizes = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    which = np.repeat(np.arange(len(raw)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = begin[which] + at
    distance = contexts.column("left").to_numpy()[which] - at
    return which, at, mixed(range_hashes(prefix_hashes(data), start, start + length) + distance.astype(np.uint64))


def runs(which: np.ndarray, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, low, high): maximal runs of consecutive starts that are hit."""
    w, a = which[hit], at[hit]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1] + 1)
    first = np.flatnonzero(new)
    return w[first], a[first], a[np.append(first[1:], len(w)) - 1] if len(w) else a


_FOUND = "row bigint, i int, low int, high int"


def repeating(marks: DataFrame, length: int) -> DataFrame:
    """(row, i, low, high): runs of string starts, counted from the anchor's first, that repeat where not all do."""

    def contexts(batches: Batches) -> Batches:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for row, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for m in own:
                    if m["sent"]:
                        values = (row, m["i"], m["short"], m["all"], m["parts"], m["place"] - m["first"], raw[m["first"] : m["last"] + length])
                        for column, value in zip(out, values):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["row", "i", "short", "all", "parts", "left", "bytes"])

    sent = kept(map_batches(marks, contexts, "row bigint, i int, short bigint, all boolean, parts int, left int, bytes binary"), "sent")

    def intervals(batches: Batches) -> Batches:
        """Whole intervals of the rows so far; the last one may go on in the next batch."""
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            short, part = (rows.column(c).to_numpy() for c in ("short", "part"))
            last = int(np.flatnonzero((short != short[-1]) | (part != part[-1])).max(initial=-1)) + 1
            held = rows.slice(last)
            if last:
                yield of_intervals(rows.slice(0, last))
        if held is not None and held.num_rows:
            yield of_intervals(held)

    def of_intervals(rows: pa.Table) -> pa.RecordBatch:
        which, at, value = strings_of(rows, length)
        interval = rows.column("short").to_numpy().view(np.uint64) * np.uint64(0xD1342543DE82EF95) + rows.column("part").to_numpy().astype(np.uint64)
        value = mixed(value + interval[which])
        earlier, later = factors(np.argsort(value, kind="stable"), value, np.arange(len(value)))
        which, low, high = runs(which, at, (earlier | later) & ~np.array(rows.column("all").to_pylist(), bool)[which])
        return record(row=rows.column("row").to_numpy()[which], i=rows.column("i").to_numpy()[which], low=low.astype(np.int32), high=high.astype(np.int32))

    part = F.pmod(F.xxhash64("row", "i"), "parts").cast("int")
    ordered = sent.withColumn("part", part).repartition("short", "part").sortWithinPartitions("short", "part", "row", "i")
    within = map_batches(ordered, intervals, _FOUND)

    def strings(batches: Batches) -> Batches:
        for batch in batches:
            which, at, value = strings_of(batch, length)
            row, i, short = (batch.column(c).to_numpy()[which] for c in ("row", "i", "short"))
            n = 1 + np.array(batch.column("all").to_pylist(), bool)[which].astype(np.int32)
            yield record(row=row, i=i, at=at.astype(np.int32), short=short, value=value.view(np.int64), n=n)

    # of intervals that were cut: across the parts
    large = sent.where("parts > 1").drop("parts").select("row", "i", "short", "all", "left", "bytes")
    each = map_batches(large, strings, "row bigint, i int, at int, short bigint, value bigint, n int")
    several = each.groupBy("short", "value").agg(F.sum("n").alias("n")).where("n > 1").select("short", "value")
    across = each.where("n = 1").join(several, ["short", "value"], "left_semi").select("row", "i", F.col("at").alias("low"), F.col("at").alias("high"))
    return within.unionByName(across)


def remaining(docs: DataFrame, length: int = 400, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``; with ``texts`` also spans and kept.

    Every byte goes that is covered by a string of ``length`` bytes that also starts anywhere else in the same or any
    other row, as judged on the input; matches lie within a row.  Texts are UTF-8 bytes, null is empty; ``kept`` is
    binary as a character may be cut.  Repeated rows count as rows.  No rows give no rows.
    """
    if length <= SPAN:
        raise ValueError(f"length must be over {SPAN}")
    rows = anchored(docs, length)
    marks = marked(docs, rows, length)
    found = repeating(marks, length).groupBy("row").agg(F.collect_list(F.struct("i", "low", "high")).alias("found"))  # of one text

    def work(batches: Batches) -> Batches:
        for batch in batches:
            removed, spans, digests, texts_ = [], [], [], []
            for text, own, hits in zip(*(batch.column(c).to_pylist() for c in ("text", "marks", "found"))):
                raw = np.frombuffer(text.encode(), np.uint8)
                change = np.zeros(len(raw) + 1, np.int32)
                first = {m["i"]: m["first"] for m in own}
                starts = [(m["first"], m["last"]) for m in own if m["all"]] + [(first[h["i"]] + h["low"], first[h["i"]] + h["high"]) for h in hits or ()]
                for low, high in starts:
                    change[low] += 1
                    change[high + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                rest = raw[~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(edge.tolist())
                digests.append(hashlib.sha256(rest).hexdigest())
                texts_.append(rest)
            more = {"spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(texts_, pa.binary())} if texts else {}
            yield record(row=batch.column("row"), n_removed=np.array(removed, np.int64), n_spans=np.array([len(s) for s in spans], np.int64), kept_sha256=pa.array(digests, pa.string()), **more)

    more = ", spans array<array<bigint>>, kept binary" if texts else ""
    changed = map_batches(marks.join(found, "row", "left"), work, f"row bigint, n_removed bigint, n_spans bigint, kept_sha256 string{more}")
    # a text's copies share the result of its least row; many copies meet one row there, which the join can split
    one = rows.groupBy("text_sha256").agg(F.min("row").alias("row"))
    results = kept(one.join(changed, "row").drop("row"), "results")
    out = rows.select("doc_id", "n_bytes", "text_sha256").join(results, "text_sha256", "left")
    zero = F.lit(0).cast("bigint")
    whole = [F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"), "kept"] if texts else []
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256"), *whole)
