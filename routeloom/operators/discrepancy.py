"""Flags, severity and recommendations for observed routes, from RPKI, IRR and flap results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import registry

# The order of severities.
SEVERITIES = ["normal", "low", "medium", "high", "critical"]

HIJACK_FLAGS = ["POTENTIAL_HIJACK", "RPKI_INVALID", "IRR_MISMATCH"]


def _rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def _raise_to(severity: Column, level: str) -> Column:
    return F.when(_rank(severity) < SEVERITIES.index(level) + 1, F.lit(level)).otherwise(severity)


def _raise_lexically(severity: Column, level: str) -> Column:
    return F.greatest(severity, F.lit(level))


def _stepwise(start: Column, invalid: Column, mismatch: Column, several: Column, conflict: Column, raise_to) -> Column:
    s = F.when(invalid, raise_to(start, "high")).otherwise(start)
    s = F.when(mismatch, raise_to(s, "medium")).otherwise(s)
    s = F.when(several & (s == "normal"), F.lit("low")).otherwise(s)
    return F.when(conflict, raise_to(s, "medium")).otherwise(s)


def score_discrepancies(rows: DataFrame) -> DataFrame:
    """Add ``flags, recommendations, severity, severity_lexical``.

    Reads ``rpki_status``, ``irr_mismatch``, ``irr_origin_count`` and the flap columns ``flap_detected``,
    ``flap_severity``, ``transition_count``, ``rapid_transitions``, ``pattern_analysis``, ``window_minutes``; any of
    them may be NULL.  ``severity`` escalates in the order of ``SEVERITIES``; ``severity_lexical`` escalates by comparing
    the words as text, for results that must agree with a scorer that does so.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    flapping = yes(F.col("flap_detected"))
    rapid = flapping & (F.col("rapid_transitions") > 0)
    invalid = yes(F.startswith("rpki_status", F.lit("invalid")))
    mismatch = yes(F.col("irr_mismatch"))
    both = invalid & mismatch
    lone_invalid, lone_mismatch = invalid & ~mismatch, mismatch & ~invalid
    several = ~both & yes(F.col("irr_origin_count") > 1)
    conflict = mismatch & yes(F.col("rpki_status") == "valid")

    flags = [
        F.when(
            flapping,
            F.when(F.col("flap_severity") == "critical", "SEVERE_ROUTE_FLAPPING")
            .when(F.col("flap_severity") == "high", "FREQUENT_ROUTE_FLAPPING")
            .otherwise("ROUTE_FLAPPING"),
        ),
        F.when(rapid, "RAPID_STATE_CHANGES"),
        F.when(both, "POTENTIAL_HIJACK"),
        F.when(lone_invalid, "RPKI_INVALID"),
        F.when(lone_mismatch, "IRR_MISMATCH"),
        F.when(several, "MULTIPLE_IRR_ORIGINS"),
        F.when(conflict, "RPKI_IRR_CONFLICT"),
    ]
    # The text of each recommendation.
    recommendations = [
        F.when(
            flapping,
            F.concat(
                F.lit("Route instability detected: "), F.col("transition_count").cast("string"),
                F.lit(" state transitions\nPattern: "), "pattern_analysis",
            ),
        ),
        F.when(
            rapid,
            F.concat(
                F.lit("Found "), F.col("rapid_transitions").cast("string"),
                F.lit(" rapid transitions (state transitions within "), F.col("window_minutes").cast("string"), F.lit(" minutes)"),
            ),
        ),
        F.when(both, "URGENT: Investigate potential route hijacking"),
        F.when(lone_invalid, F.concat(F.lit("Verify route authorization with ROA - RPKI status: "), "rpki_status")),
        F.when(lone_mismatch, "Check IRR registration for current origin AS"),
        F.when(several, "Review multiple origin registrations"),
        F.when(conflict, "RPKI shows valid but IRR has different origin"),
    ]
    start = F.when(flapping, F.col("flap_severity")).otherwise("normal")

    def severity(raise_to) -> Column:
        step = _stepwise(start, lone_invalid, lone_mismatch, several, conflict, raise_to)
        return F.when(both, "critical").otherwise(step)

    return (
        rows.withColumn("flags", F.array_compact(F.array(*flags)))
        .withColumn("recommendations", F.array_compact(F.array(*recommendations)))
        .withColumn("severity", severity(_raise_to))
        .withColumn("severity_lexical", severity(_raise_lexically))
    )


FLAP_COLUMNS = [
    "flap_detected", "flap_severity", "transition_count", "rapid_transitions", "pattern_analysis", "window_minutes"
]


def analyze_routes(observed: DataFrame, roas: DataFrame, irr: DataFrame, flaps: DataFrame | None = None) -> DataFrame:
    """Add RPKI, IRR and, if given, flap results and the score to rows with ``prefix, origin_as``.

    A column ``history_prefix`` says whose updates count as the history of the route; without it, its own.  Every join
    brings at most one row, so rows keep their number.
    """
    joined = registry.with_irr_match(registry.with_roa_status(observed, roas), irr)
    if flaps is None:
        types = ["boolean", "string", "bigint", "bigint", "string", "double"]
        joined = joined.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(FLAP_COLUMNS, types)])
    else:
        key = "history_prefix" if "history_prefix" in observed.columns else "prefix"
        flaps = flaps.withColumnRenamed("severity", "flap_severity").select(F.col("prefix").alias("_p"), *FLAP_COLUMNS)
        # rows without a history match nothing; a key of their own each keeps them from one task
        none = F.concat(F.lit("-"), F.xxhash64("prefix", "origin_as").cast("string"))
        joined = joined.withColumn("_key", F.coalesce(key, none))
        joined = joined.join(flaps, F.col("_key") == F.col("_p"), "left").drop("_p", "_key")
    return score_discrepancies(joined)


def incident_observations(incidents: DataFrame) -> DataFrame:
    """What an incident would show in a routing table: the hijacker as origin, one hop."""
    return incidents.select(
        "event_id", "prefix", F.col("hijacker_asn").alias("origin_as"), F.array("hijacker_asn").alias("as_path"),
        F.coalesce("confidence", F.lit(0)).alias("confidence"),
    )


def detect_incidents(incidents: DataFrame, roas: DataFrame, irr: DataFrame) -> DataFrame:
    """Incidents with flags and whether one of the hijack flags is among them."""
    scored = analyze_routes(incident_observations(incidents), roas, irr)
    return scored.withColumn("detected", F.arrays_overlap("flags", F.array(*[F.lit(f) for f in HIJACK_FLAGS])))


def detection_rate(detections: DataFrame) -> DataFrame:
    """Detected, total and rate; NULL rate when there are no incidents."""
    return detections.agg(
        F.count_if("detected").alias("detected"),
        F.count("*").alias("total"),
        F.avg(F.col("detected").cast("double")).alias("rate"),
    )
