"""Route-flap detection over update logs.

A prefix may hold a large share of all updates, so its rows are never brought together in one task:

* the latest time per prefix is a map-side combined aggregate;
* a bounded filter (latest time per hash slot, ``SLOTS`` rows whatever the data) is broadcast and drops old rows before
  anything is shuffled;
* what is left is reduced to its distinct (prefix, time bucket), which meet the latest time of their prefix; the rows
  then meet their bucket, so that join and window share one exchange and a hot prefix is spread over its buckets;
* each bucket is reduced to one summary row, and only the summaries, at most window / bucket of them per prefix, are put
  in order per prefix to join the ends of neighbouring buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

SLOTS = 1 << 18
BUCKETS_PER_WINDOW = 256

# The sentences of a verdict, here and in ``_pattern``.
TOO_FEW = "Insufficient updates to analyze for route flaps."
TOO_FEW_IN_WINDOW = "Insufficient updates in the analyzed time window."


def _micros(seconds: float) -> int:
    return int(seconds * 1_000_000)


def trailing_window(updates: DataFrame, minutes: float = 5, time: str = "ts") -> DataFrame:
    """Updates no older than ``minutes`` before the latest one of their prefix; adds ``_us``, ``_bucket`` and ``_total``."""
    width = _micros(minutes * 60)
    rows = updates.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    # one row per prefix, read by both joins below, so that the log is scanned twice and not three times
    latest = stored(rows.groupBy("prefix").agg(F.max("_us").alias("_latest"), F.count("*").alias("_total")))
    slot = F.pmod(F.xxhash64("prefix"), F.lit(SLOTS)).cast("int")
    floor = latest.groupBy(slot.alias("_slot")).agg(F.min("_latest").alias("_floor"))
    near = (
        rows.withColumn("_slot", slot)
        .join(F.broadcast(floor), "_slot")
        .where(F.col("_us") >= F.col("_floor") - width)
        .drop("_slot", "_floor")
    )
    step = max(width // BUCKETS_PER_WINDOW, 1)
    near = stored(near.withColumn("_bucket", F.col("_us") - F.pmod("_us", F.lit(step))))
    buckets = near.select("prefix", "_bucket").distinct().join(latest, "prefix").where(F.col("_bucket") + step > F.col("_latest") - width)
    return near.join(buckets, ["prefix", "_bucket"]).where(F.col("_us") >= F.col("_latest") - width)


def _in_bucket():
    return Window.partitionBy("prefix", "_bucket").orderBy("_us", "seq")


def _neighbours(summaries: DataFrame) -> DataFrame:
    """Per bucket, the last type of the bucket before it: a change there makes the bucket's first row a transition."""
    order = Window.partitionBy("prefix").orderBy("_bucket")
    return summaries.withColumn("_carried", F.lag("last_type").over(order)).withColumn(
        "_head", F.coalesce(F.col("_carried") != F.col("first_type"), F.lit(False))
    )


def flap_transitions(updates: DataFrame, minutes: float = 5, time: str = "ts") -> DataFrame:
    """One row per change of state inside the trailing window: ``prefix, ts, seq, transition, as_path``."""
    rows = trailing_window(updates, minutes, time).select("prefix", "_bucket", "_us", "seq", "update_type", "as_path")
    seen = rows.withColumn("_prev", F.lag("update_type").over(_in_bucket()))
    inside = seen.where(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("update_type"))).select(
        "prefix", "_us", "seq", "as_path", F.concat("_prev", F.lit("->"), "update_type").alias("transition")
    )
    key = F.struct("_us", "seq")
    ends = rows.groupBy("prefix", "_bucket").agg(
        F.min_by(F.struct("_us", "seq", "update_type", "as_path"), key).alias("first"),
        F.max_by("update_type", key).alias("last_type"),
    )
    heads = _neighbours(ends.withColumn("first_type", F.col("first.update_type"))).where("_head")
    across = heads.select(
        "prefix", "first._us", "first.seq", "first.as_path",
        F.concat("_carried", F.lit("->"), "first_type").alias("transition"),
    )
    return inside.unionByName(across).select(
        "prefix", F.timestamp_micros("_us").alias(time), "seq", "transition",
        F.coalesce("as_path", F.lit("Unknown")).alias("as_path"),
    )


def _window_counts(updates: DataFrame, minutes: float, rapid_seconds: float, time: str) -> DataFrame:
    rapid = _micros(rapid_seconds)
    rows = trailing_window(updates, minutes, time).select("prefix", "_bucket", "_us", "seq", "update_type", "_total")
    before = _in_bucket().rowsBetween(Window.unboundedPreceding, -1)
    changed = F.coalesce(F.lag("update_type").over(_in_bucket()) != F.col("update_type"), F.lit(False))
    stepped = rows.withColumn("_at", F.when(changed, F.col("_us")))
    stepped = stepped.withColumn("_last_at", F.last("_at", ignorenulls=True).over(before))
    key = F.struct("_us", "seq")
    buckets = stepped.groupBy("prefix", "_bucket").agg(
        F.max("_total").alias("_total"),
        F.count("*").alias("n"),
        F.count_if(F.col("update_type") == "A").alias("a"),
        F.count("_at").alias("transitions"),
        F.count_if(F.col("_at") - F.col("_last_at") <= rapid).alias("rapid"),
        F.min("_us").alias("lo"),
        F.max("_us").alias("hi"),
        F.min("_at").alias("first_at"),
        F.max("_at").alias("last_at"),
        F.min_by("update_type", key).alias("first_type"),
        F.max_by("update_type", key).alias("last_type"),
    )
    upto = Window.partitionBy("prefix").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    head_at = F.when(F.col("_head"), F.col("lo"))
    joined = (
        _neighbours(buckets)
        .withColumn("_from", F.coalesce(head_at, "first_at"))
        .withColumn("_to", F.coalesce("last_at", head_at))
        .withColumn("_before", F.last("_to", ignorenulls=True).over(upto))
    )
    extra_rapid = F.coalesce((F.col("first_at") - head_at <= rapid).cast("int"), F.lit(0)) + F.coalesce(
        (F.col("_from") - F.col("_before") <= rapid).cast("int"), F.lit(0)
    )
    return joined.groupBy("prefix").agg(
        F.max("_total").alias("all_updates"),
        F.sum("n").alias("total_updates"),
        F.sum("a").alias("announcements"),
        F.sum(F.col("transitions") + F.col("_head").cast("int")).alias("transitions"),
        F.sum(F.col("rapid") + extra_rapid).alias("rapid"),
        (F.max("hi") - F.min("lo")).alias("span"),
    )


def _share(part: Column, total: Column) -> Column:
    return part / total * 100


def flap_severity(transitions: Column, rapid: Column, least: int) -> Column:
    return (
        F.when((transitions > least + 4) | (rapid > least // 2), "high")
        .when((transitions > least + 2) | (rapid > 0), "medium")
        .otherwise("low")
    )


def _pattern(detected: Column, rapid_seconds: int) -> Column:
    up, down = _share(F.col("announcements"), F.col("total_updates")), _share(F.col("withdrawals"), F.col("total_updates"))
    mix = (
        F.when(F.abs(up - down) < 20, F.lit("Balanced mix of announcements and withdrawals."))
        .when(up > down, F.format_string("Predominantly announcements (%.1f%% of changes).", up))
        .otherwise(F.format_string("Predominantly withdrawals (%.1f%% of changes).", down))
    )
    rapid_text = F.when(
        F.col("rapid") > 0,
        F.concat("rapid", F.lit(f" segments involved rapid changes (within {rapid_seconds}s).")),
    )
    found = F.concat(F.lit("Route instability detected: "), "transitions", F.lit(" state transitions observed."))
    return F.when(detected, F.concat_ws(" ", found, rapid_text, mix)).otherwise(
        F.lit("No significant route flapping detected within the analyzed window.")
    )


def flap_summary(
    updates: DataFrame, minutes: float = 5, least: int = 4, rapid_seconds: int = 60, time: str = "ts"
) -> DataFrame:
    """Flap verdict per prefix.  The single transitions are ``flap_transitions``, a table of rows, not a list here.

    With fewer than three updates, overall or in the window, the counters are NULL or zero and the window is the
    parameter; otherwise ``window_minutes`` is the span the updates in the window cover.
    """
    counts = _window_counts(updates, minutes, rapid_seconds, time).withColumn(
        "withdrawals", F.col("total_updates") - F.col("announcements")
    )
    short, empty = F.col("all_updates") < 3, F.col("total_updates") < 3
    detected = ~empty & (F.col("transitions") >= least)
    known = lambda c: F.when(~empty, F.col(c))
    return counts.select(
        "prefix",
        detected.alias("flap_detected"),
        F.when(empty, 0).otherwise(F.col("transitions")).alias("transition_count"),
        F.when(empty, 0).otherwise(F.col("rapid")).alias("rapid_transitions"),
        F.when(short, TOO_FEW).when(empty, TOO_FEW_IN_WINDOW).otherwise(_pattern(detected, rapid_seconds)).alias("pattern_analysis"),
        F.when(detected, flap_severity(F.col("transitions"), F.col("rapid"), least)).otherwise("normal").alias("severity"),
        F.when(empty, F.lit(float(minutes))).otherwise(F.col("span") / 1_000_000 / 60).alias("window_minutes"),
        known("announcements").alias("announcements"),
        known("withdrawals").alias("withdrawals"),
        known("total_updates").alias("total_updates"),
    )
