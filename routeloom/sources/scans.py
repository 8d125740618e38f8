"""Scans.  Schemas are explicit; rows or files that cannot be read are left out, as the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import rib
from .sinks import newest_version


def rib_dump(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Routing-table elements of decoded dumps."""
    return rib.rib_elements(spark.read.format(format).schema(schemas.RIB_ELEMENTS).load(path))


def update_table(spark: SparkSession, path: str) -> DataFrame:
    """The update log, partitioned by ``date``."""
    return spark.read.schema(schemas.UPDATES + ", date date").parquet(path)


def updates_between(
    spark: SparkSession,
    path: str,
    start: Column,
    end: Column,
    collectors: list[str] | None = None,
    prefix: str | None = None,
    asn: str | None = None,
    **limits,
) -> DataFrame:
    """Updates of ``[start, end)`` from the log; whole days outside the range are pruned as partitions."""
    days = update_table(spark, path).where((F.col("date") >= F.to_date(start)) & (F.col("date") <= F.to_date(end)))
    return rib.updates_in_range(days, start, end, collectors, prefix, asn, time="timestamp", **limits)


def prefix_history(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Updates of one prefix, newest first; the filter reaches the Parquet scan."""
    rows = rib.update_history(update_table(spark, path), prefix, time="timestamp")
    return rows.select("prefix", "origin_as", "timestamp", "update_type", "as_path")


def incidents(spark: SparkSession, path: str) -> DataFrame:
    """Labelled incidents from a CSV file without header: seven columns, a missing confidence is 0."""
    rows = spark.read.schema(schemas.INCIDENTS_CSV).option("mode", "PERMISSIVE").csv(path)
    number = lambda c, t="bigint": F.trim(c).try_cast(t)
    given = F.nullif(F.trim("confidence"), F.lit(""))
    return (
        rows.select(
            number("event_id").alias("event_id"),
            F.btrim("prefix", F.lit('"')).alias("prefix"),
            number("hijacker_asn").alias("hijacker_asn"),
            number("victim_asn").alias("victim_asn"),
            F.when(given.isNull(), 0).otherwise(given.try_cast("int")).alias("confidence"),
        )
        .where("event_id IS NOT NULL AND prefix IS NOT NULL AND hijacker_asn IS NOT NULL")
        .where("victim_asn IS NOT NULL AND confidence IS NOT NULL")
    )


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Whole files as ``source, text``; ``source`` is the file name.  Files that are not UTF-8 are left out."""
    reader = spark.read.option("ignoreCorruptFiles", True)
    files = reader.text(path, wholetext=True, pathGlobFilter=pattern)
    readable = files.where(F.is_valid_utf8("value"))
    return readable.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def cleaned_files(spark: SparkSession, path: str) -> DataFrame:
    return text_files(spark, path, "*_clean.txt")


def registry_answers(spark: SparkSession, path: str) -> DataFrame:
    """Registry answers landed as JSON lines ``{"prefix": ..., "answer": "<JSON text>"}``."""
    return spark.read.schema("prefix string, answer string").json(path)


def stored_state(
    spark: SparkSession, folder: str, schema: str = schemas.RIB_STATE, before: int | None = None
) -> DataFrame:
    """The newest version of a state (the version before ``before``, if given); an empty one when there is none yet.

    Only the files of that version are read.
    """
    newest = newest_version(spark, folder)
    if newest is not None and before is not None and newest >= before:
        newest = before - 1 if before > 0 else None
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/version={newest}")
