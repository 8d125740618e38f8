"""Queries over the update feed as a stream, run to the end of what has landed; results are read from their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rib
from ..storage import new_folder
from ..streaming import feeds
from . import fixtures as fx
from .registry import register
from .routing_queries import REPLAY_SQL, tokens

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


FILES = 3


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    """The updates as a stream of several files, one per micro-batch, in the order of their numbers and not of time."""
    folder = f"{_folder(spark)}/in"
    fx.read(spark, sf, "events").withColumn("_part", F.pmod("event_id", F.lit(FILES))).repartition(FILES, "_part").drop("_part").write.parquet(folder)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    return _timed(fx.derive(spark, "fx_updates", {"events": events}))


def _timed(updates: DataFrame) -> DataFrame:
    return updates.withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def _run(spark: SparkSession, result: DataFrame) -> DataFrame:
    """Append-mode result written to files, then read."""
    folder = _folder(spark)
    query = (
        result.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


@register(
    "stream_rib_state",
    fx.cte("fx_updates") + "," + REPLAY_SQL + f"""
    SELECT prefix, ({tokens('path')})[-1]::BIGINT AS origin_as, array_to_string({tokens('path')}, ' ') AS as_path FROM last WHERE t = 'A'""",
)
def stream_rib_state(spark: SparkSession, sf: str) -> DataFrame:
    """Log and state kept by one feed; the routes of the state."""
    folder = _folder(spark)
    changes = f"{folder}/changes"
    feeds.maintain_state(_updates(spark, sf), f"{folder}/log", changes, f"{folder}/progress").awaitTermination()
    state = feeds.state_of(feeds.changes_before(spark, changes))
    return state.select("prefix", "origin_as", F.array_join("as_path", " ").alias("as_path"))


@register(
    "stream_log",
    fx.cte("fx_updates") + """
    SELECT ts AS timestamp, seq, prefix, update_type, CASE WHEN update_type = 'A' THEN as_path END AS as_path FROM fx_updates
    WHERE update_type IN ('A', 'W')""",
)
def stream_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log that the feed leaves."""
    folder = _folder(spark)
    feeds.maintain_state(_updates(spark, sf), f"{folder}/log", f"{folder}/changes", f"{folder}/progress").awaitTermination()
    schema = "timestamp timestamp, seq bigint, prefix string, update_type string, as_path string"
    rows = spark.read.schema(schema).parquet(f"{folder}/log")
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "seq", "prefix", "update_type", "as_path")


@register(
    "stream_summary",
    fx.cte("fx_updates") + f"""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, collector, count(*) AS total_updates, count(DISTINCT nullif(as_path, '')) AS unique_as_paths,
      count(*) FILTER (update_type = 'A') AS announcements, count(*) FILTER (update_type = 'W') AS withdrawals,
      min(ts) AS start, max(ts) AS "end", CASE WHEN arg_max(update_type, (ts, seq)) = 'W' THEN 'withdrawn' ELSE 'announced' END AS most_recent_state
    FROM fx_updates GROUP BY 1, 2""",
)
def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = lambda rows: feeds.stream_summary(rows, "1 hour", by=["collector"])
    log = _timed(fx.load(spark, sf, "fx_updates"))
    counted = log.groupBy(F.window("timestamp", "1 hour"), "collector").agg(F.count("*").alias("total_updates"))
    counted = counted.withColumns({"lo": F.col("window.start"), "hi": F.col("window.end")})
    rows = feeds.completed(_run(spark, summary(_updates(spark, sf))), counted, summary, log, ["window", "collector"], "timestamp")
    plain = lambda c, name: F.col(c).cast("timestamp_ntz").alias(name)
    return rows.select(
        plain("window.start", "window_start"), "collector", "total_updates", "announcements", "withdrawals", "unique_as_paths",
        plain("start", "start"), plain("end", "end"), "most_recent_state",
    )


@register(
    "stream_flaps",
    fx.cte("fx_updates") + f""",
    u AS (SELECT * FROM fx_updates WHERE update_type IN ('A', 'W')),
    w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * k AS window_start, u.* FROM u, range(4) r(k)),
    l AS (SELECT *, lag(update_type) OVER p AS prev FROM w WINDOW p AS (PARTITION BY window_start, prefix ORDER BY ts, seq)),
    t AS (SELECT window_start, prefix, ts, lag(ts) OVER (PARTITION BY window_start, prefix ORDER BY ts, seq) AS before FROM l WHERE prev <> update_type),
    tc AS (SELECT window_start, prefix, count(*) AS n, count(*) FILTER (epoch_us(ts) - epoch_us(before) <= 21600000000) AS rapid FROM t GROUP BY ALL),
    c AS (SELECT window_start, prefix, count(*) AS total_updates, count(*) FILTER (update_type = 'A') AS announcements, count(*) FILTER (update_type = 'W') AS withdrawals
          FROM w GROUP BY ALL),
    x AS (SELECT c.*, CASE WHEN total_updates < 3 THEN 0 ELSE coalesce(n, 0) END AS transition_count,
            CASE WHEN total_updates < 3 THEN 0 ELSE coalesce(rapid, 0) END AS rapid_transitions
          FROM c LEFT JOIN tc USING (window_start, prefix))
    SELECT *, transition_count >= 4 AS flap_detected,
      CASE WHEN transition_count < 4 THEN 'normal' WHEN transition_count > 8 OR rapid_transitions > 2 THEN 'high'
           WHEN transition_count > 6 OR rapid_transitions > 0 THEN 'medium' ELSE 'low' END AS severity FROM x""",
)
def stream_flaps(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = lambda rows: feeds.stream_flaps(rows, "2 days", "12 hours", "1 hour", rapid_seconds=21600)
    log = rib.announced_or_withdrawn(_timed(fx.load(spark, sf, "fx_updates")))
    counted = log.groupBy(F.window("timestamp", "2 days", "12 hours"), "prefix").agg(F.count("*").alias("total_updates"))
    counted = counted.select(F.col("window.start").alias("window_start"), "prefix", "total_updates", F.col("window.start").alias("lo"), F.col("window.end").alias("hi"))
    emitted = _run(spark, verdicts(_updates(spark, sf)))
    found = feeds.completed(emitted, counted, verdicts, log, ["window_start", "prefix"], "timestamp")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
