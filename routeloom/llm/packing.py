"""Packing of documents into sequences of at most ``capacity`` tokens by reciprocal classes.

A document is cut into pieces of exactly capacity, capacity/2, capacity/4 ... down to ``least`` tokens, and a tail below
that.  A piece of length n is in class k = capacity // n, and a sequence of class k holds exactly k pieces of the class,
so pieces of the exact sizes leave no padding and a tail of class k leaves less than capacity/k^2 tokens each.  Which
sequence a piece goes to follows from its number within its class alone: numbers are given per task when the pieces
are made, and shifted by the counts of the tasks before, so tasks fill sequences independently.  What is left of the
classes, fewer than k pieces of each and thus a bounded number over all, shares sequences, longest pieces first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import encoder
from .common import Batches, kept, map_batches, record, text_of

_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, class int, task int, pos bigint, ids binary"


def cuts(n: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of n tokens."""
    sizes, size = [capacity] * (n // capacity), capacity // 2
    n %= capacity
    while size >= least:
        if n >= size:
            sizes.append(size)
            n -= size
        size //= 2
    return sizes + [n] * (n > 0)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, least: int, end_id: int = 0) -> DataFrame:
    """The pieces of every whole text with the end id: their class, and their number in the class within a task."""

    def work(batches: Batches) -> Batches:
        e = encoder(tokenizer)
        size = np.dtype(e.dtype).itemsize
        end = np.array([end_id], e.dtype).tobytes()
        task = TaskContext.get().partitionId()
        count = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = e.encode(text.as_py()) + end
                n, start = len(ids) // size, 0
                for length in cuts(n, capacity, least):
                    k = capacity // length
                    wide = np.frombuffer(ids[start * size : (start + length) * size], e.dtype).astype("<u4").tobytes()
                    for column, value in zip(rows, (doc_id, start, length, n, k, count[k], wide)):
                        column.append(value)
                    count[k] += 1
                    start += length
            doc_id, start, length, n, k, pos, ids = rows
            yield record(doc_id=pa.array(doc_id, pa.int64()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), doc_tokens=pa.array(n, pa.int64()), **{"class": pa.array(k, pa.int32())}, task=np.full(len(k), task, np.int32), pos=pa.array(pos, pa.int64()), ids=pa.array(ids, pa.binary()))

    return map_batches(docs.select("doc_id", text_of().alias("text")), work, _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, least: int = 64, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class of each piece; with ``ids`` if asked for.

    Sequences are numbered without gaps from 0: per class, then the sequences of what is left (class null).  Every id of
    every document lies in exactly one piece; null or empty text is the end id alone; repeated rows are packed each.
    No rows give no rows; other columns of ``docs`` are ignored.
    """
    made = pieces(docs, tokenizer, capacity, least)
    made = made.withColumn("ids_crc32", F.crc32("ids"))
    made = kept(made if with_ids else made.drop("ids"), "pieces")

    # a row per task and class; as many rows per class as tasks
    counts = made.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("class")
    counts = counts.select("class", "task", (F.sum("n").over(by_class.orderBy("task")) - F.col("n")).alias("before"), F.sum("n").over(by_class).alias("total"))
    # a row per class: at most capacity
    classes = counts.groupBy("class").agg(F.first("total").alias("total"))
    full = F.expr("total div class")
    firsts = classes.select("class", (F.sum(full).over(Window.orderBy("class")) - full).alias("first"))
    shifts = counts.join(F.broadcast(firsts), "class").select("class", "task", "before", "total", "first")

    number = F.col("before") + F.col("pos")
    placed = made.join(shifts, ["class", "task"]).select(made["*"], number.alias("number"), "total", "first")
    whole = F.col("number") < F.expr("total div class * class")
    filled = placed.where(whole).withColumn("sequence_id", F.col("first") + F.expr("number div class"))
    filled = filled.withColumn("offset", F.sum("length").over(Window.partitionBy("sequence_id").orderBy("number")) - F.col("length"))

    # fewer than ``class`` pieces of each class: at most capacity * (1 + ln capacity) rows, whatever the input
    rest = first_fit(placed.where(~whole).select("class", "task", "pos", "length").repartition(1), capacity)
    n_full = classes.agg(F.coalesce(F.sum(full), F.lit(0))).scalar()
    rest = placed.where(~whole).join(rest, ["class", "task", "pos"]).withColumn("sequence_id", n_full + F.col("bin"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return filled.select(*columns, "class").unionByName(rest.select(*columns, F.lit(None).cast("int").alias("class")))


def first_fit(rest: DataFrame, capacity: int) -> DataFrame:
    """(class, task, pos, bin, offset): the few rows left, longest first, each to the first sequence with room."""

    def work(batches: Batches) -> Batches:
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort(key=lambda r: (-r[3], r[0], r[1], r[2]))
        filled: list[int] = []
        bins, offsets = [], []
        for *_, length in rows:
            b = next((i for i, used in enumerate(filled) if used + length <= capacity), len(filled))
            if b == len(filled):
                filled.append(0)
            bins.append(b)
            offsets.append(filled[b])
            filled[b] += length
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=["class", "task", "pos", "bin", "offset"])

    return rest.mapInArrow(work, "class int, task int, pos bigint, bin bigint, offset bigint")
