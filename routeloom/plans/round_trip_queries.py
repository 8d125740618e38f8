"""Queries that write a derived table with the library's sinks and read it back with its scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import flaps, rib
from ..schemas import RIB_STATE
from ..sources import scans, sinks
from ..storage import new_folder
from . import fixtures as fx
from .document_queries import CHUNK_FOLD_SQL, CHUNK_SQL, CLEAN_SQL, SKIP_LINES
from .heuristic_queries import FLAP_SQL, FLAPS
from .registry import register
from .routing_queries import REPLAY_SQL, tokens


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """Updates in the shape of the log."""
    updates = fx.load(spark, sf, "fx_updates").withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")
    none = lambda t: F.lit(None).cast(t)
    return updates.withColumns(
        {
            "origin_as": F.try_element_at(paths.strict_path_numbers("as_path"), F.lit(-1)),
            "next_hop": F.concat("peer_address", F.lit("!")),
            "communities": none("string"),
            "med": F.col("peer_asn"),
            "local_pref": none("bigint"),
            "atomic_aggregate": F.lit(True),
            "aggregator": F.concat("collector", F.lit("!")),
        }
    )


def _log(spark: SparkSession, sf: str) -> str:
    path = new_folder(spark, "log")
    sinks.append_updates(_typed(spark, sf), path)
    return path


@register(
    "log_round_trip",
    fx.cte("fx_updates") + """
    SELECT ts AS timestamp, seq, collector, peer_address, peer_asn, prefix, update_type, CASE WHEN a THEN as_path END AS as_path,
      CASE WHEN a THEN peer_address || '!' END AS next_hop, CASE WHEN a THEN peer_asn END AS med, CASE WHEN a THEN true END AS atomic_aggregate,
      CASE WHEN a THEN collector || '!' END AS aggregator, list_filter(regexp_split_to_array(CASE WHEN a THEN as_path END, '\\s+'), lambda x: x <> '')[-1] AS origin_text
    FROM (SELECT *, update_type = 'A' AS a FROM fx_updates WHERE update_type IN ('A', 'W')) WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25'""",
)
def log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The log appended and read for a range of days; what a withdrawal does not keep is NULL."""
    at = lambda t: F.lit(t).cast("timestamp")
    rows = scans.updates_between(spark, _log(spark, sf), at("2024-01-03"), at("2024-01-25"))
    return rows.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "seq", "collector", "peer_address", "peer_asn", "prefix", "update_type",
        "as_path", "next_hop", "med", "atomic_aggregate", "aggregator", "origin_text",
    )


_BUSY = "(SELECT prefix FROM fx_updates WHERE update_type IN ('A', 'W') GROUP BY prefix ORDER BY count(*) DESC, prefix LIMIT 1)"


@register(
    "prefix_round_trip",
    fx.cte("fx_updates") + f"""
    SELECT prefix, ts AS timestamp, update_type, CASE WHEN update_type = 'A' THEN as_path END AS as_path FROM fx_updates
    WHERE update_type IN ('A', 'W') AND prefix = {_BUSY}""",
)
def prefix_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """History, from the log, of the prefix that has the most updates."""
    logged = rib.announced_or_withdrawn(fx.load(spark, sf, "fx_updates"))
    busy = logged.groupBy("prefix").count().orderBy(F.desc("count"), "prefix").first()
    rows = scans.prefix_history(spark, _log(spark, sf), busy.prefix if busy else "")
    return rows.select("prefix", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "update_type", "as_path")


@register(
    "rib_round_trip",
    fx.cte("fx_rib") + """ SELECT seq, prefix, peer_asn, as_path FROM fx_rib WHERE orderkey % 5 <> 0""",
)
def rib_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Dump elements appended in two parts and read as a dump, which keeps valid routing-table elements."""
    path = new_folder(spark, "rib")
    elements = fx.load(spark, sf, "fx_rib").selectExpr(
        "seq", "CASE WHEN orderkey % 5 = 0 THEN 'corrupted' ELSE 'valid' END AS status", "'R' AS elem_type", "prefix", "peer_asn", "as_path"
    )
    for part in (0, 1):
        sinks.append_rib(elements.where(F.col("seq") % 2 == part), path)
    return scans.rib_dump(spark, path).select("seq", "prefix", "peer_asn", "as_path")


@register(
    "state_round_trip",
    fx.cte("fx_updates") + "," + REPLAY_SQL + f"""
    SELECT prefix, ({tokens('path')})[-1]::BIGINT AS origin_as FROM last WHERE t = 'A'""",
)
def state_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a state; the newer one is read."""
    folder = new_folder(spark, "state")
    state = rib.replay(spark.createDataFrame([], RIB_STATE), fx.load(spark, sf, "fx_updates"))
    sinks.save_state(state.where("origin_as = 1000"), folder, 1)
    sinks.save_state(state, folder, 2)
    return scans.stored_state(spark, folder).select("prefix", "origin_as")


@register(
    "incidents_round_trip",
    fx.cte("fx_incidents") + """
    SELECT event_id, prefix, hijacker_asn, victim_asn, coalesce(confidence, 0)::INT AS confidence FROM fx_incidents WHERE event_id % 9 <> 0""",
)
def incidents_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents as CSV without header; every ninth has a victim that is no number."""
    path = new_folder(spark, "incidents")
    rows = fx.load(spark, sf, "fx_incidents").selectExpr(
        "event_id", "prefix", "hijacker_asn", "CASE WHEN event_id % 9 = 0 THEN 'none' ELSE concat(' ', victim_asn) END AS victim_asn",
        "'x' AS e5", "'y' AS e6", "confidence",
    )
    rows.write.csv(path)
    return scans.incidents(spark, path)


@register(
    "corpus_round_trip",
    fx.cte("fx_docs").replace("WITH ", "WITH RECURSIVE ", 1) + "," + CLEAN_SQL + "," + CHUNK_SQL
    + CHUNK_FOLD_SQL.replace("SELECT doc_id, replace(source", "SELECT replace(source"),
)
def corpus_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Raw documents cleaned, stored, chunked, vectorized and stored; the stored chunks."""
    folder = new_folder(spark, "corpus")
    sinks.build_corpus(fx.load(spark, sf, "fx_docs").select("source", "text"), f"{folder}/cleaned", f"{folder}/vectors", skip_lines=SKIP_LINES)
    stored = spark.read.schema("source string, chunk_no int, text string, embedding array<double>").parquet(f"{folder}/vectors")
    return stored.where("size(embedding) > 0").select("source", F.col("chunk_no").cast("bigint").alias("chunk_no"), "text")


@register(
    "report_round_trip",
    fx.cte("fx_updates") + "," + FLAP_SQL + " SELECT prefix, transition_count, severity FROM fl",
)
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Flap verdicts as JSON lines, read again."""
    path = new_folder(spark, "report")
    sinks.write_report(flaps.flap_summary(rib.announced_or_withdrawn(fx.load(spark, sf, "fx_updates")), **FLAPS), path)
    return spark.read.schema("prefix string, transition_count bigint, severity string").json(path)


@register(
    "dump_times",
    "SELECT DISTINCT ts, strftime(ts, '%Y%m%d.%H%M') AS name FROM (SELECT date_trunc('minute', ts) AS ts FROM events)",
)
def dump_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times of dumps out of their names."""
    names = fx.read(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd.HHmm").alias("name")).distinct()
    return names.select(paths.rib_timestamp("name").cast("timestamp_ntz").alias("ts"), "name")
