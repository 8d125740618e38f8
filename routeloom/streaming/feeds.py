"""Update feeds: current state, log, summaries and flaps over streams.

State is kept per prefix (bounded by the number of prefixes) or per window and prefix (dropped by the watermark).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.netaddr import KEY, with_canonical_text, with_network
from ..operators import flaps, rib
from ..schemas import UPDATES
from ..sources import scans, sinks
from ..storage import stored

# Last change per network, withdrawals included, so that a late update is recognized as older.
CHANGES = (
    "family int, net_hi bigint, net_lo bigint, plen int, update_type string, given_origin bigint, as_path string, "
    "timestamp timestamp, seq bigint"
)
_PAYLOAD = ["update_type", "given_origin", "as_path", "timestamp", "seq"]


def update_stream(
    spark: SparkSession, path: str, schema: str = UPDATES, format: str = "parquet", files_per_slice: int | None = None
) -> DataFrame:
    """Updates landed as files."""
    reader = spark.readStream.format(format).schema(schema)
    if files_per_slice is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_slice)
    return reader.load(path)


def latest_changes(updates: DataFrame) -> DataFrame:
    """Last usable update per network; on a stream, a running aggregate for update or complete mode.

    The order is ``(timestamp, seq)``, so neither late nor repeated updates change the result.
    """
    rows = with_network(rib.usable_updates(updates).select("prefix", *_PAYLOAD))
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*_PAYLOAD), F.struct("timestamp", "seq")).alias("last"))
    return last.select(*KEY, "last.*")


def state_of(changes: DataFrame) -> DataFrame:
    """Current routes out of the last changes."""
    live = rib.with_route(changes.where("update_type = 'A'"))
    return with_canonical_text(live).select(*rib.STATE)


def changes_of(state: DataFrame) -> DataFrame:
    """A snapshot as changes older than every update."""
    return state.select(
        *KEY,
        F.lit("A").alias("update_type"),
        F.col("origin_as").alias("given_origin"),
        F.array_join("as_path", " ").alias("as_path"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(None).cast("bigint").alias("seq"),
    )


def merge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.select(*KEY, *_PAYLOAD).unionByName(new.select(*KEY, *_PAYLOAD))
    last = both.groupBy(*KEY).agg(F.max_by(F.struct(*_PAYLOAD), F.struct("timestamp", "seq")).alias("last"))
    return last.select(*KEY, "last.*")


def log_and_apply(log_path: str, changes_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: append the batch to the log and merge what the log then has of it into the stored changes.

    Both writes are keyed by the batch, so a batch that is run again after a failure replaces its own output.  The log is
    clustered by prefix within a day.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = rib.update_log(batch).withColumn("date", F.to_date("timestamp")).withColumn("batch", F.lit(batch_id))
        (
            rows.repartitionByRange("date", "prefix")
            .sortWithinPartitions("date", "prefix", "timestamp")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch", "date")
            .parquet(log_path)
        )
        logged = spark.read.schema(rows.schema).parquet(log_path).where(F.col("batch") == batch_id)
        merged = merge_changes(changes_before(spark, changes_path, batch_id), latest_changes(logged))
        sinks.save_state(merged, changes_path, batch_id)

    return body


def changes_before(spark: SparkSession, changes_path: str, batch_id: int | None = None) -> DataFrame:
    """Newest stored changes, or those a batch starts from: it may be running again, its own version there already."""
    return scans.stored_state(spark, changes_path, CHANGES, before=batch_id)


def maintain_state(
    updates: DataFrame, log_path: str, changes_path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep log and state up to date from one feed.  ``every`` such as ``1 minute``; without it, what is there now."""
    writer = updates.writeStream.foreachBatch(log_and_apply(log_path, changes_path)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def stream_summary(
    updates: DataFrame, width: str = "5 minutes", late: str = "5 minutes", by: list[str] | None = None, time: str = "timestamp"
) -> DataFrame:
    """Counts per window and, if given, per group.

    The state holds a row per window, group and distinct path until the watermark passes; paths are counted from these.
    The same on a table gives all windows, as a watermark means nothing there.
    """
    by = by or []
    place = F.struct(F.col(time), F.col("seq"), F.col("update_type"))
    per_path = (
        updates.withWatermark(time, late)
        .groupBy(F.window(time, width), *by, F.nullif("as_path", F.lit("")).alias("_path"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("update_type") == "A").alias("a"),
            F.count_if(F.col("update_type") == "W").alias("w"),
            F.min(time).alias("lo"),
            F.max(time).alias("hi"),
            F.max(place).alias("last"),
        )
    )
    out = per_path.groupBy(F.window(F.col("window"), width).alias("window"), *by).agg(
        F.sum("n").alias("total_updates"),
        F.sum("a").alias("announcements"),
        F.sum("w").alias("withdrawals"),
        F.count("_path").alias("unique_as_paths"),
        F.min("lo").alias("start"),
        F.max("hi").alias("end"),
        F.max("last").alias("_last"),
    )
    state = F.when(F.col("_last.update_type") == "W", "withdrawn").otherwise("announced")
    return out.withColumn("most_recent_state", state).drop("_last")


def completed(emitted: DataFrame, counted: DataFrame, again: Callable[[DataFrame], DataFrame], log: DataFrame, key: list[str], time: str) -> DataFrame:
    """Windows a stream gave out, made to agree with the log.

    ``counted`` has the windows (``key``, with ``lo`` and ``hi``, the bounds of the window) and their ``total_updates``
    as the log has them.  Windows that are still open or had late rows are worked out anew by ``again`` from the log,
    of which only the time that they span is read.
    """
    stale = stored(counted.join(emitted.select(*key, "total_updates"), [*key, "total_updates"], "left_anti"))
    span = stale.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if span.lo is None:
        return emitted
    part = log.where((F.col(time) >= F.lit(span.lo)) & (F.col(time) < F.lit(span.hi)))
    anew = again(part).join(stale.select(*key), key, "left_semi")
    return emitted.join(stale.select(*key), key, "left_anti").unionByName(anew)


def _slice_summary(events: Column, rapid: int) -> list[Column]:
    """Counters of one slice from its events in order, each ``(us, seq, update_type)``."""
    at = F.transform(
        F.filter(events, lambda x, i: (i > 0) & (x["update_type"] != F.get(events, i - 1)["update_type"])), lambda x: x["us"]
    )
    close = F.filter(at, lambda x, i: (i > 0) & (x - F.get(at, i - 1) <= rapid))
    return [
        F.get(events, F.lit(0))["us"].alias("lo"),
        F.try_element_at(events, F.lit(-1))["us"].alias("hi"),
        F.get(events, F.lit(0))["update_type"].alias("first_type"),
        F.try_element_at(events, F.lit(-1))["update_type"].alias("last_type"),
        F.size(events).cast("bigint").alias("n"),
        F.size(F.filter(events, lambda x: x["update_type"] == "A")).cast("bigint").alias("a"),
        F.size(at).cast("bigint").alias("transitions"),
        F.size(close).cast("bigint").alias("rapid"),
        F.get(at, F.lit(0)).alias("first_at"),
        F.try_element_at(at, F.lit(-1)).alias("last_at"),
    ]


def stream_flaps(
    updates: DataFrame,
    window: str = "5 minutes",
    step: str = "1 minute",
    slice: str = "1 second",
    moment: str = "100 milliseconds",
    late: str = "5 minutes",
    least: int = 4,
    rapid_seconds: int = 60,
    time: str = "timestamp",
) -> DataFrame:
    """Flap verdict per prefix and sliding window, in append mode.

    The windows are fixed to the clock, while ``operators.flaps`` takes the window that ends at the latest update of each
    prefix: a burst over a window border counts in both windows here.

    Updates are reduced per moment, these per slice, and these per window, so the state gathers no more than the raw
    updates of a moment, slice / moment and window / slice small rows per prefix, however many updates the prefix has.
    """
    rapid = int(rapid_seconds * 1_000_000)
    event = F.struct(F.unix_micros(time).alias("us"), "seq", "update_type")
    moments = (
        rib.announced_or_withdrawn(updates)
        .withWatermark(time, late)
        .groupBy(F.window(time, moment), "prefix")
        .agg(F.sort_array(F.collect_list(event)).alias("events"))
        .select("window", "prefix", F.struct(*_slice_summary(F.col("events"), rapid)).alias("s"))
    )

    def reduced(rows: DataFrame, to: Column) -> DataFrame:
        gathered = rows.groupBy(to.alias("window"), "prefix").agg(F.sort_array(F.collect_list("s")).alias("s"))
        return gathered.select("window", "prefix", _merged(F.col("s"), rapid).alias("s"))

    slices = reduced(moments, F.window(F.col("window"), slice))
    windows = reduced(slices, F.window(F.col("window"), window, step))
    found = windows.select(
        F.col("window.start").alias("window_start"),
        "prefix",
        F.col("s.n").alias("total_updates"),
        F.col("s.a").alias("announcements"),
        F.col("s.transitions").alias("transition_count"),
        F.col("s.rapid").alias("rapid_transitions"),
    )
    enough = (F.col("total_updates") >= 3) & (F.col("transition_count") >= least)
    level = flaps.flap_severity(F.col("transition_count"), F.col("rapid_transitions"), least)
    few = F.col("total_updates") < 3
    return (
        found.withColumn("withdrawals", F.col("total_updates") - F.col("announcements"))
        .withColumn("transition_count", F.when(few, 0).otherwise(F.col("transition_count")))
        .withColumn("rapid_transitions", F.when(few, 0).otherwise(F.col("rapid_transitions")))
        .withColumn("flap_detected", enough)
        .withColumn("severity", F.when(enough, level).otherwise("normal"))
    )


def _merged(parts: Column, rapid: int) -> Column:
    """One summary of consecutive ones, with the transitions and rapid pairs that cross from one to the next."""

    def step(acc: Column, x: Column) -> Column:
        head = acc["last_type"] != x["first_type"]
        head_at = F.when(head, x["lo"])
        one = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
        crossing = one(x["first_at"] - head_at <= rapid) + one(F.coalesce(head_at, x["first_at"]) - acc["last_at"] <= rapid)
        return F.struct(
            acc["lo"].alias("lo"),
            x["hi"].alias("hi"),
            acc["first_type"].alias("first_type"),
            x["last_type"].alias("last_type"),
            (acc["n"] + x["n"]).alias("n"),
            (acc["a"] + x["a"]).alias("a"),
            (acc["transitions"] + x["transitions"] + one(head)).alias("transitions"),
            (acc["rapid"] + x["rapid"] + crossing).alias("rapid"),
            F.coalesce(acc["first_at"], head_at, x["first_at"]).alias("first_at"),
            F.coalesce(x["last_at"], head_at, acc["last_at"]).alias("last_at"),
        )

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), step)
