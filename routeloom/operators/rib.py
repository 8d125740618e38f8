"""Routing table and update log: filters, table rows, snapshot, replay, summaries, history."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.netaddr import KEY, with_canonical_text, with_network

STATE = [*KEY, "prefix", "origin_as", "as_path"]


# -- rows -----------------------------------------------------------------------------------------------------


def rib_elements(elements: DataFrame) -> DataFrame:
    """Routing-table elements of valid records."""
    return elements.where("status = 'valid' AND elem_type = 'R'")


def rib_entries(elements: DataFrame, dump_time: Column | str) -> DataFrame:
    """Elements to table rows: path and origin parsed leniently, communities and aggregator rendered as text."""
    dump_time = F.lit(dump_time).cast("timestamp") if isinstance(dump_time, str) else dump_time
    return rib_elements(elements).select(
        dump_time.alias("dump_time"),
        paths.epoch_timestamp("time").alias("record_time"),
        "collector",
        "peer_address",
        "peer_asn",
        "prefix",
        paths.normalized_path("as_path").alias("as_path"),
        paths.path_origin("as_path").alias("origin_as"),
        "next_hop",
        paths.communities_text("communities").alias("communities"),
        "med",
        "local_pref",
        F.col("atomic_aggregate").isNotNull().alias("atomic_aggregate"),
        paths.aggregator_as("aggregator").try_cast("bigint").alias("aggregator_as"),
        paths.aggregator_address("aggregator").alias("aggregator_address"),
        "seq",
    )


def announced_or_withdrawn(updates: DataFrame) -> DataFrame:
    """Updates of type A or W with a non-blank prefix; all others are ignored."""
    return updates.where(F.col("update_type").isin("A", "W") & (F.trim("prefix") != ""))


def update_log(updates: DataFrame) -> DataFrame:
    """Rows of the update log: a withdrawal keeps only time, collector, peer, prefix and type."""
    kept = {"timestamp", "collector", "peer_address", "peer_asn", "prefix", "update_type", "seq"}
    announced = F.col("update_type") == "A"
    return announced_or_withdrawn(updates).select(
        *[F.col(c) if c in kept else F.when(announced, F.col(c)).alias(c) for c in updates.columns]
    )


def updates_in_range(
    updates: DataFrame,
    start: Column,
    end: Column,
    collectors: list[str] | None = None,
    prefix: str | None = None,
    asn: str | None = None,
    longest: timedelta | None = None,
    time: str = "ts",
) -> DataFrame:
    """Updates of ``[start, end)``, cut to ``longest`` from its start if given; a NULL bound selects nothing.

    The time bounds are literals, so they reach the Parquet scan as pushed filters.
    """
    if longest is not None:
        end = F.least(end, start + F.lit(longest))
    keep = start.isNotNull() & end.isNotNull() & (F.col(time) >= start) & (F.col(time) < end)
    if collectors:
        keep = keep & F.col("collector").isin(*collectors)
    if prefix:
        keep = keep & (F.col("prefix") == prefix)
    if asn:
        keep = keep & F.array_contains(paths.path_tokens("as_path"), asn)
    return updates.where(keep).withColumn("origin_text", paths.raw_origin("as_path"))


# -- state ----------------------------------------------------------------------------------------------------


def _latest(rows: DataFrame, key: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Last row per key.  ``max_by`` combines on the map side, so a hot prefix sends one row per task."""
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_last"))
    return last.select(*key, *[F.col("_last")[c].alias(c) for c in payload])


def snapshot(rib: DataFrame, order: list[str] | None = None, per_peer: bool = False) -> DataFrame:
    """Route per network from table rows with raw paths: the last row in arrival order wins, whatever its peer.

    Rows carry the raw path; only the winner's is taken apart.
    """
    extra = ["peer_asn"] if per_peer else []
    order = order or ["seq"]
    usable = rib.where(F.col("prefix").isNotNull() & paths.has_numbers("as_path"))
    rows = with_network(usable.select("prefix", "as_path", *dict.fromkeys(c for c in [*order, *extra] if c != "as_path")))
    last = _latest(rows, [*KEY, *extra], order, ["as_path"]).withColumn("as_path", paths.path_numbers("as_path"))
    state = with_canonical_text(last).withColumn("origin_as", F.try_element_at("as_path", F.lit(-1)))
    return state.select(*STATE, *extra)


def usable_updates(updates: DataFrame) -> DataFrame:
    """Updates that change the state: withdrawals, and announcements whose path holds numbers only.

    Adds ``given_origin``, the origin that came with the update, when it is not the path that gives it.
    """
    if "origin_as" in updates.columns:
        given = F.nullif(F.col("origin_as").cast("string"), F.lit(""))
        known = given.isNull() | given.try_cast("bigint").isNotNull()
    else:
        given, known = F.lit(None).cast("string"), F.lit(True)
    announced = paths.is_strict("as_path") & known
    rows = announced_or_withdrawn(updates).where((F.col("update_type") == "W") | announced)
    return rows.withColumn("given_origin", given.try_cast("bigint"))


def rejected_updates(updates: DataFrame) -> DataFrame:
    """``reason, n``: updates that ``usable_updates`` or the parse of their prefix leaves out, by the first reason that holds."""
    reason = (
        F.when(~F.coalesce(F.col("update_type").isin("A", "W"), F.lit(False)), "type")
        .when(~F.coalesce(F.trim("prefix") != "", F.lit(False)), "blank prefix")
        .when(F.col("family").isNull(), "prefix")
        .when((F.col("update_type") == "A") & ~F.coalesce(paths.is_strict("as_path"), F.lit(False)), "path")
    )
    rows = with_network(updates.select("prefix", "update_type", "as_path"), drop_invalid=False)
    return rows.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def with_route(rows: DataFrame) -> DataFrame:
    """``origin_as, as_path`` as numbers, from the raw path and ``given_origin``."""
    numbers = rows.withColumn("as_path", paths.strict_path_numbers("as_path"))
    origin = F.coalesce("given_origin", F.try_element_at("as_path", F.lit(-1)))
    return numbers.withColumn("origin_as", origin).drop("given_origin")


def replay(state: DataFrame, updates: DataFrame, since: Column | None = None, time: str = "ts") -> DataFrame:
    """Apply updates to a state: A sets the route of its network, W removes it, in order of ``(time, seq)``.

    The log is first reduced to the last usable update per prefix text, on raw columns, and combined on the map side;
    addresses and paths are parsed for what is left.  State rows sort before every update.  ``since`` drops updates
    older than the snapshot; a cut-off in the past is a filter on ``updates``.
    """
    if since is not None:
        updates = updates.where(F.col(time) >= since)
    usable = usable_updates(updates).withColumnRenamed(time, "_time")
    payload = ["_time", "seq", "update_type", "given_origin", "as_path"]
    changes = with_network(_latest(usable, ["prefix"], ["_time", "seq"], payload))
    announced = F.col("update_type") == "A"
    route = F.when(announced, F.struct("origin_as", "as_path"))
    changed = with_route(changes).select(*KEY, F.struct(F.lit(1).alias("gen"), "_time", "seq").alias("_at"), route.alias("_route"))
    never = F.struct(
        F.lit(0).alias("gen"),
        F.lit(None).cast(updates.schema[time].dataType).alias("_time"),
        F.lit(None).cast("bigint").alias("seq"),
    )
    base = state.select(*KEY, never.alias("_at"), F.struct("origin_as", "as_path").alias("_route"))
    last = _latest(base.unionByName(changed), KEY, ["_at"], ["_route"])
    live = with_canonical_text(last.where("_route IS NOT NULL"))
    return live.select(*KEY, "prefix", "_route.origin_as", "_route.as_path")


def routes_by_origin(state: DataFrame, asn: int | Column) -> DataFrame:
    """Routes an AS originates."""
    return state.where(F.col("origin_as") == asn)


# -- reports --------------------------------------------------------------------------------------------------


def summarize_updates(updates: DataFrame, by: list[str] | None = None, time: str = "ts") -> DataFrame:
    """Counts, distinct non-empty paths, time range and most recent state; global when ``by`` is empty.

    The distinct paths are counted from one row per path, combined on the map side, so neither a hot prefix nor the
    global summary meets in one task before it is small.
    """
    by = by or []
    # (time, seq) as one number keeps the aggregation buffers fixed-width, hence a hash aggregation
    us = F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(17,0)")
    place = us * F.lit("1" + "0" * 20).cast("decimal(21,0)") + (F.col("seq").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)"))
    withdrawn = F.col("update_type") == "W"
    placed = updates.select(*by, F.nullif("as_path", F.lit("")).alias("_path"), "update_type", time, place.alias("_place"))
    per_path = placed.groupBy(*by, "_path").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("update_type") == "A").alias("a"),
        F.count_if(withdrawn).alias("w"),
        F.min(time).alias("lo"),
        F.max(time).alias("hi"),
        F.max(F.when(withdrawn, F.col("_place"))).alias("last_w"),
        F.max(F.when(withdrawn, None).otherwise(F.col("_place"))).alias("last_other"),
    )
    summary = per_path.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_updates"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("announcements"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("withdrawals"),
        F.count("_path").alias("unique_as_paths"),
        F.min("lo").alias("start"),
        F.max("hi").alias("end"),
        F.max("last_w").alias("_w"),
        F.max("last_other").alias("_other"),
    )
    is_withdrawn = F.col("_w").isNotNull() & (F.col("_other").isNull() | (F.col("_w") > F.col("_other")))
    return (
        summary.withColumn("most_recent_state", F.when(is_withdrawn, "withdrawn").when(F.col("total_updates") > 0, "announced"))
        .withColumn("status", F.when(F.col("total_updates") == 0, "No updates found"))
        .drop("_w", "_other")
    )


def update_slices(updates: DataFrame, width: str = "1 minute", by: list[str] | None = None, time: str = "ts") -> DataFrame:
    """Updates per tumbling slice; slices are half open, so a boundary update belongs to one slice."""
    slices = updates.groupBy(F.window(time, width), *(by or [])).agg(
        F.count("*").alias("updates"),
        F.count_if(F.col("update_type") == "A").alias("announcements"),
        F.count_if(F.col("update_type") == "W").alias("withdrawals"),
    )
    return slices.select(
        F.col("window.start").alias("slice_start"), *(by or []), "updates", "announcements", "withdrawals"
    )


def update_history(updates: DataFrame, prefix: str | None = None, time: str = "ts") -> DataFrame:
    """Updates newest first, of one prefix or per prefix.  A range sort on time too, so a hot prefix spreads."""
    rows = updates if prefix is None else updates.where(F.col("prefix") == prefix)
    order = [F.col(time).desc(), F.col("seq").desc()]
    return rows.orderBy(*order) if prefix is not None else rows.orderBy("prefix", *order)
