"""Sinks.  Writes that may be repeated replace what the first attempt wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, rib
from ..storage import stored


def append_rib(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def append_updates(updates: DataFrame, path: str, time: str = "timestamp") -> None:
    """Append to the log, partitioned by day and clustered by prefix inside it, so a prefix is found by file statistics.

    Adaptive execution sizes the tasks by their bytes: it joins small ones and splits a large day or a hot prefix.
    """
    rows = rib.update_log(updates).withColumn("date", F.to_date(time))
    (
        rows.hint("rebalance", "date", "prefix")
        .sortWithinPartitions("date", "prefix", time)
        .write.mode("append")
        .partitionBy("date")
        .parquet(path)
    )


def save_state(state: DataFrame, folder: str, version: int, keep: int = 3) -> None:
    """Write a version of the state; writing the same version again replaces it.

    The number of the newest version is written last, next to the versions, so readers need not look through them.
    Versions older than the newest ``keep`` are removed then.
    """
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(f"{folder}/version={version}")
    newest = max(version, newest_version(spark, folder) or version)
    spark.range(1).select(F.lit(newest).cast("bigint").alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/_newest")
    path, files = _files(spark, folder)
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and int(name.removeprefix("version=")) <= newest - keep:
            files.delete(status.getPath(), True)


def newest_version(spark: SparkSession, folder: str) -> int | None:
    """The number that ``save_state`` wrote last; None if there is none."""
    path, files = _files(spark, f"{folder}/_newest")
    return spark.read.schema("version bigint").parquet(f"{folder}/_newest").first().version if files.exists(path) else None


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_cleaned(raw: DataFrame, path: str, **options) -> None:
    """Clean documents ``source, text`` and store them under their cleaned names."""
    cleaned = documents.clean_documents(raw, **options).withColumn("source", documents.clean_name("source"))
    cleaned.write.mode("overwrite").parquet(path)


def write_vectors(cleaned: DataFrame, path: str, dims: int = 1024) -> bool:
    """Chunk, vectorize and store documents ``source, text``; without chunks nothing is written."""
    chunks = stored(documents.chunk_documents(cleaned))
    if chunks.isEmpty():
        return False
    vectors = documents.vectorize(chunks, documents.fit_vectorizer(chunks, dims=dims))
    vectors.select("source", "chunk_no", "text", "embedding").write.mode("overwrite").parquet(path)
    return True


def build_corpus(raw: DataFrame, cleaned_path: str, vectors_path: str, **options) -> bool:
    """Clean, store, chunk, vectorize, store; each step only when the one before gave rows."""
    if raw.isEmpty():
        return False
    write_cleaned(raw, cleaned_path, **options)
    return write_vectors(raw.sparkSession.read.schema("source string, text string").parquet(cleaned_path), vectors_path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
