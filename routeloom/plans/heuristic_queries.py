"""Queries over flaps, registries and discrepancies, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discrepancy, flaps, registry, rib
from . import fixtures as fx
from .registry import register

# Updates of the test data are minutes apart, so the window is two days and a rapid pair six hours.
FLAPS = {"minutes": 2880, "least": 4, "rapid_seconds": 21600}

FLAP_SQL = """
 u AS (SELECT *, max(ts) OVER (PARTITION BY prefix) AS latest, count(*) OVER (PARTITION BY prefix) AS all_n
       FROM fx_updates WHERE update_type IN ('A', 'W')),
 win AS (SELECT * FROM u WHERE ts >= latest - INTERVAL 2880 MINUTE),
 lagged AS (SELECT *, lag(update_type) OVER (PARTITION BY prefix ORDER BY ts, seq) AS prev FROM win),
 trans AS (SELECT *, lag(ts) OVER (PARTITION BY prefix ORDER BY ts, seq) AS prev_ts FROM lagged WHERE prev <> update_type),
 tcount AS (SELECT prefix, count(*) AS t, count(*) FILTER (epoch_us(ts) - epoch_us(prev_ts) <= 21600000000) AS rapid FROM trans GROUP BY prefix),
 wcount AS (SELECT prefix, max(all_n) AS all_n, count(*) AS n, count(*) FILTER (update_type = 'A') AS a,
              (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 / 60 AS span FROM win GROUP BY prefix),
 fl0 AS (SELECT prefix, all_n, n, a, n - a AS w, span, coalesce(t, 0) AS t, coalesce(rapid, 0) AS rapid FROM wcount LEFT JOIN tcount USING (prefix)),
 fl AS (
   SELECT prefix, n >= 3 AND t >= 4 AS flap_detected, CASE WHEN n < 3 THEN 0 ELSE t END AS transition_count,
     CASE WHEN n < 3 THEN 0 ELSE rapid END AS rapid_transitions,
     CASE WHEN all_n < 3 THEN 'Insufficient updates to analyze for route flaps.'
          WHEN n < 3 THEN 'Insufficient updates in the analyzed time window.'
          WHEN t < 4 THEN 'No significant route flapping detected within the analyzed window.'
          ELSE concat('Route instability detected: ', t, ' state transitions observed.',
            CASE WHEN rapid > 0 THEN concat(' ', rapid, ' segments involved rapid changes (within 21600s).') ELSE '' END,
            CASE WHEN abs(a / n * 100 - w / n * 100) < 20 THEN ' Balanced mix of announcements and withdrawals.'
                 WHEN a > w THEN printf(' Predominantly announcements (%.1f%% of changes).', a / n * 100)
                 ELSE printf(' Predominantly withdrawals (%.1f%% of changes).', w / n * 100) END) END AS pattern_analysis,
     CASE WHEN n < 3 OR t < 4 THEN 'normal' WHEN t > 8 OR rapid > 2 THEN 'high' WHEN t > 6 OR rapid > 0 THEN 'medium' ELSE 'low' END AS severity,
     CASE WHEN n < 3 THEN 2880.0::DOUBLE ELSE span END AS window_minutes,
     CASE WHEN n >= 3 THEN a END AS announcements, CASE WHEN n >= 3 THEN w END AS withdrawals, CASE WHEN n >= 3 THEN n END AS total_updates
   FROM fl0)"""


def _logged(spark: SparkSession, sf: str) -> DataFrame:
    return rib.announced_or_withdrawn(fx.load(spark, sf, "fx_updates"))


@register(
    "flap_transitions",
    fx.cte("fx_updates") + "," + FLAP_SQL + """
    SELECT prefix, ts, seq, concat(prev, '->', update_type) AS transition, coalesce(as_path, 'Unknown') AS as_path FROM trans""",
)
def flap_transitions(spark: SparkSession, sf: str) -> DataFrame:
    found = flaps.flap_transitions(_logged(spark, sf), FLAPS["minutes"])
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("flap_summary", fx.cte("fx_updates") + "," + FLAP_SQL + """
    SELECT * REPLACE (round(window_minutes, 6) AS window_minutes) FROM fl""")
def flap_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = flaps.flap_summary(_logged(spark, sf), **FLAPS)
    return found.withColumn("window_minutes", F.round("window_minutes", 6))


# -- registries -----------------------------------------------------------------------------------------------


def irr_items(spark: SparkSession, sf: str) -> DataFrame:
    """Registry records as ``key, value`` items."""
    rows = fx.load(spark, sf, "fx_irr")
    key = F.when(F.col("section") == "records", "OriginAS").otherwise("origin")
    items = F.array(
        F.struct(F.lit(0).alias("i"), key.alias("key"), F.col("origin").alias("value")),
        F.struct(F.lit(1).alias("i"), F.lit("source").alias("key"), F.col("source").alias("value")),
    )
    return rows.select("prefix", "section", "record_id", F.inline(items)).select(
        "prefix", "section", (F.col("record_id") * 2 + F.col("i")).alias("pos"), "key", "value"
    )


IRR_SQL = """
 it AS (SELECT prefix, section, record_id, regexp_extract(trim(replace(origin, 'AS', '')), '^[0-9]+$') AS o, trim(source) AS s FROM fx_irr),
 prim AS (SELECT prefix, count(*) FILTER (o <> '' AND section = 'irr_records') > 0 AS primary_found FROM it GROUP BY prefix),
 firsts AS (
   SELECT prefix, o, min((CASE WHEN section = 'irr_records' THEN 0 ELSE 1 END, record_id)) AS f
   FROM it JOIN prim USING (prefix) WHERE o <> '' AND (section = 'irr_records' OR NOT primary_found) GROUP BY ALL),
 firsts_s AS (
   SELECT prefix, s, min((CASE WHEN section = 'irr_records' THEN 0 ELSE 1 END, record_id)) AS f
   FROM it JOIN prim USING (prefix) WHERE s <> '' AND (section = 'irr_records' OR NOT primary_found) GROUP BY ALL),
 irr AS (
   SELECT prefix, coalesce(os, '') AS irr_origins, coalesce(n, 0) AS irr_origin_count, coalesce(ss, '') AS authorities,
     CASE WHEN n > 0 THEN 'success' ELSE 'not-found' END AS status
   FROM prim LEFT JOIN (SELECT prefix, string_agg(o, ',' ORDER BY f) AS os, count(*) AS n FROM firsts GROUP BY prefix) USING (prefix)
             LEFT JOIN (SELECT prefix, string_agg(s, ',' ORDER BY f) AS ss FROM firsts_s GROUP BY prefix) USING (prefix))"""


@register("irr_origins", fx.cte("fx_irr") + "," + IRR_SQL + " SELECT prefix, irr_origins, authorities, status FROM irr")
def irr_origins(spark: SparkSession, sf: str) -> DataFrame:
    found = registry.irr_origins(irr_items(spark, sf))
    return found.select(
        "prefix", F.array_join("irr_origins", ",").alias("irr_origins"),
        F.array_join("authorities", ",").alias("authorities"), "status",
    )


ROA_SQL = """
 ro AS (SELECT prefix, pos, replace(origin, 'AS', '') AS o, validity FROM fx_roa),
 own AS (SELECT prefix, o, arg_max(CASE WHEN validity = 'valid' THEN 'valid' ELSE 'invalid' END, pos)
           FILTER (validity IN ('valid', 'invalid', 'invalid_asn', 'invalid_length')) AS verdict,
           count(*) FILTER (validity = 'valid') AS own_valid FROM ro GROUP BY ALL),
 tot AS (SELECT prefix, count(*) AS n, count(*) FILTER (validity = 'valid') AS n_valid FROM ro GROUP BY prefix),
 rpki AS (
   SELECT a.*, coalesce(verdict, CASE WHEN coalesce(n_valid, 0) - coalesce(own_valid, 0) > 0 THEN 'invalid' ELSE 'not-found' END) AS rpki_status,
     coalesce(n, 0) AS covering_roas
   FROM asked a LEFT JOIN own ON own.prefix = a.prefix AND own.o = a.origin_as::VARCHAR LEFT JOIN tot ON tot.prefix = a.prefix)"""

ASKED_INCIDENTS = " asked AS (SELECT DISTINCT prefix, hijacker_asn AS origin_as FROM fx_incidents)"
# The last announced origin of every logged prefix.
ASKED_UPDATES = f""" lastr AS (
   SELECT prefix, arg_max(regexp_extract(as_path, '([0-9]+)$', 1)::BIGINT, (ts, seq)) AS origin_as FROM fx_updates
   WHERE update_type = 'A' AND regexp_full_match(as_path, '[0-9 ]+') GROUP BY prefix),
 asked AS (SELECT prefix, origin_as FROM lastr)"""


@register(
    "roa_status",
    fx.cte("fx_incidents", "fx_roa") + "," + ASKED_INCIDENTS + "," + ROA_SQL + " SELECT * FROM rpki",
)
def roa_status(spark: SparkSession, sf: str) -> DataFrame:
    asked = fx.load(spark, sf, "fx_incidents").select("prefix", F.col("hijacker_asn").alias("origin_as"))
    return registry.roa_status(asked, fx.load(spark, sf, "fx_roa"))


SCORE_SQL = """
 facts AS (
   SELECT r.*, coalesce(i.irr_origin_count, 0) AS n_irr,
     coalesce(i.irr_origin_count > 0 AND NOT list_contains(string_split(i.irr_origins, ','), r.origin_as::VARCHAR), false) AS mis,
     r.rpki_status = 'invalid' AS inv
   FROM rpki r LEFT JOIN irr i USING (prefix)),
 parts AS (
   SELECT f.*, flap_detected AS fnull, coalesce(flap_detected, false) AS fd, severity AS fs, transition_count AS tc, rapid_transitions AS rt,
     pattern_analysis AS pa, window_minutes AS wm, CASE WHEN coalesce(flap_detected, false) THEN severity ELSE 'normal' END AS s0
   FROM facts f LEFT JOIN {flaps}),
 s1 AS (SELECT *,
     CASE WHEN inv AND s0 IN ('normal','low','medium') THEN 'high' WHEN mis AND s0 IN ('normal','low') THEN 'medium' ELSE s0 END AS o1,
     CASE WHEN inv THEN greatest(s0, 'high') WHEN mis THEN greatest(s0, 'medium') ELSE s0 END AS l1 FROM parts),
 s2 AS (SELECT *, CASE WHEN n_irr > 1 AND o1 = 'normal' THEN 'low' ELSE o1 END AS o2,
     CASE WHEN n_irr > 1 AND l1 = 'normal' THEN 'low' ELSE l1 END AS l2 FROM s1),
 scored AS (SELECT {keys}prefix, origin_as, rpki_status, covering_roas, n_irr AS irr_origin_count,
     array_to_string([x FOR x IN [
       CASE WHEN fd THEN CASE WHEN fs = 'high' THEN 'FREQUENT_ROUTE_FLAPPING' ELSE 'ROUTE_FLAPPING' END END,
       CASE WHEN fd AND rt > 0 THEN 'RAPID_STATE_CHANGES' END, CASE WHEN inv AND mis THEN 'POTENTIAL_HIJACK' END,
       CASE WHEN inv AND NOT mis THEN 'RPKI_INVALID' END, CASE WHEN mis AND NOT inv THEN 'IRR_MISMATCH' END,
       CASE WHEN NOT (inv AND mis) AND n_irr > 1 THEN 'MULTIPLE_IRR_ORIGINS' END,
       CASE WHEN mis AND rpki_status = 'valid' THEN 'RPKI_IRR_CONFLICT' END] IF x IS NOT NULL], ',') AS flags,
     array_to_string([x FOR x IN [
       CASE WHEN fd THEN concat('Route instability detected: ', tc, ' state transitions', chr(10), 'Pattern: ', pa) END,
       CASE WHEN fd AND rt > 0 THEN concat('Found ', rt, ' rapid transitions (state transitions within ', wm, ' minutes)') END,
       CASE WHEN inv AND mis THEN 'URGENT: Investigate potential route hijacking' END,
       CASE WHEN inv AND NOT mis THEN 'Verify route authorization with ROA - RPKI status: ' || rpki_status END,
       CASE WHEN mis AND NOT inv THEN 'Check IRR registration for current origin AS' END,
       CASE WHEN NOT (inv AND mis) AND n_irr > 1 THEN 'Review multiple origin registrations' END,
       CASE WHEN mis AND rpki_status = 'valid' THEN 'RPKI shows valid but IRR has different origin' END] IF x IS NOT NULL], '|') AS recommendations,
     CASE WHEN inv AND mis THEN 'critical' WHEN mis AND rpki_status = 'valid' AND o2 IN ('normal','low') THEN 'medium' ELSE o2 END AS severity,
     CASE WHEN inv AND mis THEN 'critical' WHEN mis AND rpki_status = 'valid' THEN greatest(l2, 'medium') ELSE l2 END AS severity_lexical
   FROM s2)"""


@register(
    "discrepancies",
    fx.cte("fx_updates", "fx_roa", "fx_irr") + "," + ",".join([ASKED_UPDATES, FLAP_SQL, ROA_SQL, IRR_SQL, SCORE_SQL.format(flaps="fl USING (prefix)", keys="")])
    + " SELECT * FROM scored",
)
def discrepancies(spark: SparkSession, sf: str) -> DataFrame:
    updates = fx.load(spark, sf, "fx_updates")
    announced = rib.with_route(rib.usable_updates(updates).where("update_type = 'A'"))
    observed = announced.groupBy("prefix").agg(F.max_by("origin_as", F.struct("ts", "seq")).alias("origin_as"))
    verdicts = flaps.flap_summary(rib.announced_or_withdrawn(updates), **FLAPS)
    scored = discrepancy.analyze_routes(observed, fx.load(spark, sf, "fx_roa"), irr_items(spark, sf), verdicts)
    return _scored(scored, "prefix", "origin_as", "rpki_status", "covering_roas", "irr_origin_count")


def _scored(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(
        *columns, F.array_join("flags", ",").alias("flags"), F.array_join("recommendations", "|").alias("recommendations"),
        "severity", "severity_lexical",
    )


NO_FLAPS = """(SELECT NULL::VARCHAR AS prefix, NULL::BOOLEAN AS flap_detected, NULL::VARCHAR AS severity, 0 AS transition_count,
   0 AS rapid_transitions, NULL::VARCHAR AS pattern_analysis, NULL::DOUBLE AS window_minutes) nf USING (prefix)"""

INCIDENT_SQL = (
    fx.cte("fx_incidents", "fx_roa", "fx_irr")
    + "," + ",".join([ASKED_INCIDENTS, ROA_SQL, IRR_SQL, SCORE_SQL.format(flaps=NO_FLAPS, keys="")])
    + """, det AS (
    SELECT event_id, i.prefix, hijacker_asn AS origin_as, coalesce(confidence, 0) AS confidence, flags, severity, severity_lexical,
      flags LIKE '%POTENTIAL_HIJACK%' OR flags LIKE '%RPKI_INVALID%' OR flags LIKE '%IRR_MISMATCH%' AS detected
    FROM fx_incidents i JOIN scored s ON s.prefix = i.prefix AND s.origin_as = i.hijacker_asn)"""
)


def _detected(spark: SparkSession, sf: str) -> DataFrame:
    return discrepancy.detect_incidents(
        fx.load(spark, sf, "fx_incidents"), fx.load(spark, sf, "fx_roa"), irr_items(spark, sf)
    )


@register("incident_detection", INCIDENT_SQL + " SELECT * FROM det")
def incident_detection(spark: SparkSession, sf: str) -> DataFrame:
    return _detected(spark, sf).select(
        "event_id", "prefix", "origin_as", "confidence", F.array_join("flags", ",").alias("flags"), "severity",
        "severity_lexical", "detected",
    )


@register(
    "incident_detection_rate",
    INCIDENT_SQL + " SELECT count(*) FILTER (detected) AS detected, count(*) AS total, round(avg(detected::INT), 6) AS rate FROM det",
)
def incident_detection_rate(spark: SparkSession, sf: str) -> DataFrame:
    return discrepancy.detection_rate(_detected(spark, sf)).withColumn("rate", F.round("rate", 6))
