"""Token-ID files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file set is a folder of two Parquet tables that Spark writes, so that commits are atomic and any store will do:

* ``ranks`` (rank, id): ids by falling frequency over the whole corpus, ties by id.  At most one row per vocabulary entry.
* ``blocks`` (shard, block, doc_ids, lengths, control, data): whole documents in ascending doc_id order within and
  across (shard, block).  A block's ranks are coded in 1 to 4 bytes; ``control`` has 2 bits per rank (four ranks a byte,
  lowest bits first), ``data`` the bytes.  The last four of a block are filled up with rank 0.

Decoding looks each control byte up in a table of 256 layouts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import new_folder
from .byte_tokens import encoder
from .common import Batches, kept, map_batches, record, text_of

#: Ids after which a block ends.
BLOCK = 1 << 18

BLOCKS = "shard int, block int, doc_ids array<bigint>, lengths array<int>, control binary, data binary"

_CODES = np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3
#: For each control byte, which of its four little-endian 32-bit numbers' 16 bytes are present.
LAYOUT = (np.arange(4) <= _CODES[:, :, None]).reshape(256, 16)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    filled = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    filled[: len(ranks)] = ranks
    codes = ((filled > 0xFF).astype(np.uint8) + (filled > 0xFFFF) + (filled > 0xFFFFFF)).reshape(-1, 4)
    control = (codes << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), filled.view(np.uint8).reshape(-1, 16)[LAYOUT[control]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n ranks."""
    present = LAYOUT[np.frombuffer(control, np.uint8)]
    out = np.zeros(present.shape, np.uint8)
    out[present] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")[:n]


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """(doc_id, n_tokens, ids, counts): every whole text's ids, with the end id; null text is empty.  Repeated rows stay.

    ``counts`` is null but in one more row of each task, which has nothing else: how often each id came, 64 bits each.
    """

    def work(batches: Batches) -> Batches:
        e = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], e.dtype).tobytes()
        size = np.dtype(e.dtype).itemsize
        counts = np.zeros(e.tokenizer.get_vocab_size() + 1, np.int64)
        none = pa.array([None], pa.binary())
        for batch in batches:
            ids = [e.encode(t) + end for t in batch.column(1).to_pylist()]
            raw = b"".join(ids)
            counts += np.bincount(np.frombuffer(raw, e.dtype), minlength=len(counts))
            first = np.cumsum([0, *map(len, ids)])
            kept_ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(first), pa.py_buffer(raw)])
            yield record(doc_id=batch.column(0), n_tokens=np.diff(first) // size, ids=kept_ids.cast(pa.binary()), counts=pa.nulls(len(ids), pa.binary()))
        yield record(doc_id=pa.array([None], pa.int64()), n_tokens=pa.array([None], pa.int64()), ids=none, counts=pa.array([counts.tobytes()], pa.binary()))

    return map_batches(docs.select("doc_id", text_of().alias("text")), work, "doc_id bigint, n_tokens bigint, ids binary, counts binary")


def frequency_ranks(counts: DataFrame) -> DataFrame:
    """(rank, id) of the ids in use, from the ``counts`` of tasks."""

    def work(batches: Batches) -> Batches:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = np.frombuffer(x, np.int64)
                total = own.copy() if not len(total) else total + own
        used = np.flatnonzero(total)
        yield record(id=used.astype(np.int64), n=total[used])

    sums = map_batches(counts, work, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    # one row per vocabulary entry at most, so the window's single task is bounded
    return sums.select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 0) -> str:
    """Encodes ``docs`` (doc_id, text) into a file set at ``path``; rows with a null doc_id come first."""
    spark = docs.sparkSession
    dtype = encoder(tokenizer).dtype
    encoded = kept(encode(docs, tokenizer, end_id), "ids")
    frequency_ranks(encoded.where("counts IS NOT NULL").select("counts")).write.parquet(f"{path}/ranks")
    rank_of = spark.sparkContext.broadcast(_rank_table(spark, path))

    def work(batches: Batches) -> Batches:
        shard = TaskContext.get().partitionId()
        block, ids, lengths, chunks, total = 0, [], [], [], 0

        def done():
            ranks = rank_of.value[np.frombuffer(b"".join(chunks), dtype)] if total else np.zeros(0, "<u4")
            control, data = pack(ranks)
            return record(shard=pa.array([shard], pa.int32()), block=pa.array([block], pa.int32()), doc_ids=pa.array([ids], pa.list_(pa.int64())), lengths=pa.array([lengths], pa.list_(pa.int32())), control=pa.array([control], pa.binary()), data=pa.array([data], pa.binary()))

        for batch in batches:
            for doc_id, n, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(doc_id)
                lengths.append(n)
                chunks.append(chunk)
                total += n
                if total >= BLOCK:
                    yield done()
                    block, ids, lengths, chunks, total = block + 1, [], [], [], 0
        if ids:
            yield done()

    documents = encoded.where("counts IS NULL").select("doc_id", "n_tokens", "ids")
    ordered = documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    map_batches(ordered, work, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return path


def _rank_table(spark: SparkSession, path: str) -> np.ndarray:
    """rank by id; as long as the vocabulary at most."""
    rows = spark.read.parquet(f"{path}/ranks").toArrow()
    ids = rows["id"].to_numpy()
    table = np.full(int(ids.max(initial=-1)) + 1, 0xFFFFFFFF, "<u4")  # ids not in use
    table[ids] = rows["rank"].to_numpy()
    return table


def read(spark: SparkSession, path: str, crc: bool = False) -> DataFrame:
    """(shard, block, pos, doc_id, n_tokens, within, ids): documents of a file set, ``ids`` as little-endian 32-bit numbers.

    ``within`` counts the ids of the block's documents before it.  With ``crc``, ids_crc32 stands in place of ids.
    """
    rank_of = _rank_table(spark, path)
    used = np.flatnonzero(rank_of != 0xFFFFFFFF)
    id_of = np.zeros(len(used), "<u4")
    id_of[rank_of[used]] = used
    ids = spark.sparkContext.broadcast(id_of)

    def work(batches: Batches) -> Batches:
        for batch in batches:
            for shard, block, doc_ids, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                ends = np.cumsum(lengths, dtype=np.int64)
                flat = ids.value[unpack(control, data, int(ends[-1]))]
                parts = [flat[e - k : e] for e, k in zip(ends.tolist(), lengths)]
                last = {"ids_crc32": np.array([zlib.crc32(p) for p in parts], np.int64)} if crc else {"ids": pa.array([p.tobytes() for p in parts], pa.binary())}
                n = len(doc_ids)
                yield record(shard=np.full(n, shard, np.int32), block=np.full(n, block, np.int32), pos=np.arange(n, dtype=np.int32), doc_id=pa.array(doc_ids, pa.int64()), n_tokens=np.array(lengths, np.int64), within=ends - lengths, **last)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return map_batches(blocks, work, "shard int, block int, pos int, doc_id bigint, n_tokens bigint, within bigint, " + ("ids_crc32 bigint" if crc else "ids binary"))


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, before): the ids of all blocks before each; sums per shard first, then over the shards."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))  # a row per writing task
    first = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    inner = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    return sizes.select("shard", "block", inner.alias("inner")).join(first, "shard").select("shard", "block", (F.col("first") + F.col("inner")).alias("before"))


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes ``docs`` to token files and reads them back: doc_id, start, n_tokens, ids_crc32 of each row.

    Null or empty text is the end id alone.  Repeated doc_ids each keep their row, in no set order among themselves.
    Long texts make a block of their own.  No rows give no rows; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    write(docs, tokenizer, path)
    found = read(spark, path, crc=True)
    return found.join(block_starts(spark, path), ["shard", "block"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
