"""What the operators share: reading texts batch by batch in Python tasks, and tables that are written once and read again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import stored

Batches = Iterator[pa.RecordBatch]

#: Rows that a task handles at a time; bounds its memory to so many texts.
ROWS = 1000


def kept(df: DataFrame, name: str = "llm") -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts lineage and survives lost executors."""
    return stored(df, name, compression="zstd")


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, work: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``work`` over batches of at most ROWS rows of each partition."""

    def small(batches: Batches) -> Batches:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield batch.slice(start, ROWS)

    return df.mapInArrow(lambda batches: work(small(batches)), schema)


ROW_KEYS = ["__id", "__null", "__sha"]


def keyed(df: DataFrame, sha: Column | None = None) -> DataFrame:
    """``df`` with columns ROW_KEYS that tell its rows by doc_id, which may be null, and text."""
    sha = F.sha2(text_of(), 256) if sha is None else sha
    return df.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__null": F.col("doc_id").isNull(), "__sha": sha})


def only(docs: DataFrame, staying: DataFrame, repeats: bool = False) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are in ``staying`` (doc_id, text_sha256); of repeated rows one unless asked for all.

    Names that begin with two underscores are reserved.
    """
    stay = keyed(staying, F.col("text_sha256")).select(ROW_KEYS)
    # sorted and merged whatever the sizes: neither side has a bound
    found = keyed(docs).join(stay.hint("merge"), ROW_KEYS, "left_semi")
    return (found if repeats else found.dropDuplicates(ROW_KEYS)).select(docs.columns)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of bytes, and where each begins (one more than texts); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
