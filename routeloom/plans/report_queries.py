"""Queries that turn questions into answer contexts, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import raw_origin
from ..operators import entities, flaps, report, rib
from ..storage import stored
from . import fixtures as fx
from .document_queries import SEARCH_SQL, _found
from .heuristic_queries import FLAP_SQL, FLAPS, IRR_SQL, ROA_SQL, SCORE_SQL, irr_items
from .registry import register
from .routing_queries import REPLAY_SQL, SNAPSHOT_SQL, current_state, tokens, v4_text, v4_value
from .text_queries import CLASSIFY_SQL, entities_sql, questions

ENTITY_LINES_SQL = """
 elines AS (SELECT qid, array_to_string([x FOR x IN [
   concat('Query Types: ', replace(query_types, ',', ', ')),
   CASE WHEN len(ip_addresses) > 0 THEN concat('IP Addresses: ', array_to_string(ip_addresses, ', ')) END,
   CASE WHEN len(prefixes) > 0 THEN concat('Prefixes: ', array_to_string(prefixes, ', ')) END,
   CASE WHEN len(asns) > 0 THEN concat('AS Numbers: ', array_to_string(list_transform(asns, lambda a: 'AS' || a), ', ')) END,
   CASE WHEN len(time_references) > 0 THEN concat('Time References: ', array_to_string(time_references, ', ')) END
   ] IF x IS NOT NULL], chr(10)) AS entities FROM classified)"""


@register(
    "entity_lines",
    fx.cte("fx_questions") + "," + entities_sql("fx_questions", "question", "qid") + "," + CLASSIFY_SQL + "," + ENTITY_LINES_SQL
    + " SELECT * FROM elines",
)
def entity_lines(spark: SparkSession, sf: str) -> DataFrame:
    return entities.classify(questions(spark, sf)).select("qid", report.entity_lines().alias("entities"))


REPORT_SQL = (
    fx.cte("fx_rib", "fx_updates", "fx_questions", "fx_roa", "fx_irr") + ","
    + ",".join([SNAPSHOT_SQL, REPLAY_SQL, entities_sql("fx_questions", "question", "qid"), CLASSIFY_SQL, ENTITY_LINES_SQL])
    + f""",
 state AS (
   SELECT net, plen, {v4_text('net', 'plen')} AS prefix, nums[-1]::BIGINT AS origin_as, array_to_string(nums, ', ') AS path FROM snap
   UNION ALL
   SELECT {v4_value("split_part(prefix, '/', 1)")}, 24, prefix, ({tokens('path')})[-1]::BIGINT, array_to_string({tokens('path')}, ', ')
   FROM last WHERE t = 'A' AND NOT contains(prefix, ':')),
 hist AS (SELECT qid, CASE WHEN contains(query_types, 'historical') THEN prefixes[1] END AS history_prefix FROM classified),
 ap AS (SELECT qid, unnest(prefixes) AS asked, generate_subscripts(prefixes, 1) AS pos FROM classified WHERE contains(query_types, 'live')),
 ai AS (SELECT qid, unnest(ip_addresses) AS asked, generate_subscripts(ip_addresses, 1) AS pos FROM classified WHERE contains(query_types, 'live')),
 ips AS (SELECT asked, {v4_value('asked')} AS v FROM (SELECT DISTINCT asked FROM ai)),
 best AS (SELECT asked, arg_max(s.prefix, s.plen) AS prefix, arg_max(origin_as, s.plen) AS origin_as, arg_max(path, s.plen) AS path
          FROM ips JOIN state s ON v BETWEEN s.net AND s.net + (1::BIGINT << (32 - s.plen)) - 1 GROUP BY asked),
 routes AS (
   SELECT qid, 0 AS kind, pos, asked, s.prefix AS matching_prefix, origin_as, path FROM ap JOIN state s ON s.prefix = ap.asked
   UNION ALL SELECT qid, 1, pos, ai.asked, best.prefix, origin_as, path FROM ai JOIN best USING (asked)),
 firstr AS (SELECT *, CASE WHEN kind = 0 THEN asked ELSE matching_prefix END AS prefix FROM routes
            QUALIFY row_number() OVER (PARTITION BY qid ORDER BY kind, pos) = 1),
 qr AS (SELECT f.qid, f.prefix, f.origin_as, h.history_prefix FROM firstr f JOIN hist h USING (qid) WHERE f.origin_as <> 0),
 asked AS (SELECT DISTINCT prefix, origin_as, history_prefix FROM qr),"""
    + ",".join([FLAP_SQL, ROA_SQL, IRR_SQL, SCORE_SQL.format(
        flaps="(SELECT prefix AS fp, * EXCLUDE (prefix) FROM fl) fl ON fl.fp = f.history_prefix",
        keys="history_prefix, fnull AS flap_detected, tc, pa, ")])
    + """,
 validated AS (
   SELECT q.qid, s.*, coalesce(i.irr_origins, '') AS irr_origins, coalesce(i.authorities, '') AS authorities, coalesce(i.status, 'not-found') AS irr_status
   FROM qr q JOIN scored s ON s.prefix = q.prefix AND s.origin_as = q.origin_as AND s.history_prefix IS NOT DISTINCT FROM q.history_prefix
   LEFT JOIN irr i ON i.prefix = q.prefix)"""
)


def _parts(spark: SparkSession, sf: str):
    classified = stored(entities.classify(questions(spark, sf)))
    routes = stored(report.question_routes(classified, current_state(spark, sf)))
    verdicts = flaps.flap_summary(rib.announced_or_withdrawn(fx.load(spark, sf, "fx_updates")), **FLAPS)
    validated = report.validated_questions(
        classified, routes, fx.load(spark, sf, "fx_roa"), irr_items(spark, sf), verdicts
    )
    return classified, routes, validated


@register(
    "question_routes",
    REPORT_SQL + " SELECT qid, kind, pos - 1 AS pos, asked, matching_prefix, origin_as, path AS as_path FROM routes",
)
def question_routes(spark: SparkSession, sf: str) -> DataFrame:
    classified = stored(entities.classify(questions(spark, sf)))
    routes = report.question_routes(classified, current_state(spark, sf))
    return routes.withColumn("as_path", F.array_join("as_path", ", "))


@register(
    "question_validation",
    REPORT_SQL + """ SELECT qid, prefix, origin_as, history_prefix, rpki_status, covering_roas, irr_origins, authorities, irr_status, flags, severity
    FROM validated""",
)
def question_validation(spark: SparkSession, sf: str) -> DataFrame:
    _, _, validated = _parts(spark, sf)
    listed = [F.array_join(c, ",").alias(c) for c in ("irr_origins", "authorities", "flags")]
    return validated.select(
        "qid", "prefix", "origin_as", "history_prefix", "rpki_status", "covering_roas", "irr_status", "severity", *listed
    )


CONTEXT_SQL = """,
 rtext AS (SELECT qid, concat('=== CURRENT BGP STATE ===', chr(10), string_agg(concat(
     CASE WHEN kind = 0 THEN concat('Exact Match for Prefix: ', asked)
          ELSE concat('Longest Prefix Match for IP: ', asked, chr(10), 'Matching Prefix: ', matching_prefix) END,
     chr(10), 'Origin AS: ', origin_as, chr(10), 'AS Path: [', path, ']', chr(10)), chr(10) ORDER BY kind, pos)) AS t FROM routes GROUP BY qid),
 vtext AS (SELECT qid, array_to_string([x FOR x IN ['=== RPKI & IRR VALIDATION ===', 'RPKI Status: ' || rpki_status, 'Prefix: ' || prefix,
     concat('Origin AS: ', origin_as), CASE WHEN covering_roas > 0 THEN concat('Covering ROAs: ', covering_roas, ' found') END,
     'IRR Status: ' || irr_status, CASE WHEN irr_origins <> '' THEN 'IRR Origins: ' || replace(irr_origins, ',', ', ') END,
     CASE WHEN authorities <> '' THEN 'IRR Authorities: ' || replace(authorities, ',', ', ') END, '',
     '=== HEURISTIC ANALYSIS ===', 'Severity: ' || severity, CASE WHEN flags <> '' THEN 'Flags: ' || replace(flags, ',', ', ') END,
     CASE WHEN recommendations <> '' THEN concat('Recommendations:', chr(10), '- ', replace(recommendations, '|', chr(10) || '- ')) END,
     CASE WHEN flap_detected IS NOT NULL THEN concat('Route Flapping Detected: ', CASE WHEN flap_detected THEN 'True' ELSE 'False' END) END,
     CASE WHEN flap_detected THEN concat('Transition Count: ', tc) END, CASE WHEN flap_detected THEN concat('Pattern: ', pa) END, '']
     IF x IS NOT NULL], chr(10)) AS t FROM validated)"""

@register(
    "context_report",
    REPORT_SQL + CONTEXT_SQL + """
 SELECT qid, e.entities, coalesce(nullif(concat_ws(chr(10), r.t, v.t), ''), 'No context data available.') AS context, h.history_prefix
 FROM elines e JOIN hist h USING (qid) LEFT JOIN rtext r USING (qid) LEFT JOIN vtext v USING (qid)""",
)
def context_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.context_report(*_parts(spark, sf))


HISTORY_TEXT_SQL = """concat(
      'Timestamp: ', CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END, chr(10),
      'Type: ', update_type, ' (A=Announcement, W=Withdrawal)', chr(10), 'Prefix: ', prefix, chr(10),
      'Origin AS: ', coalesce(list_filter(regexp_split_to_array(as_path, '\\s+'), lambda x: x <> '')[-1], 'None'), chr(10),
      'AS Path: ', coalesce(as_path, 'None'), chr(10))"""


@register(
    "context_sections",
    REPORT_SQL.replace("WITH ", f"WITH fx_found AS ({fx.SQL['fx_found']}), ", 1) + CONTEXT_SQL + f""",
 dtext AS (SELECT qid, concat('=== RFC DOCUMENTATION ===', chr(10), string_agg(concat('Source: ', source, chr(10), 'Content: ', content, chr(10)), chr(10) ORDER BY rank)) AS t
           FROM fx_found SEMI JOIN (SELECT qid FROM classified WHERE contains(query_types, 'static')) USING (qid) GROUP BY qid),
 logged AS (SELECT * FROM fx_updates WHERE update_type IN ('A', 'W') AND prefix IN (SELECT history_prefix FROM hist)),
 pieces AS (
   SELECT qid, NULL::VARCHAR AS prefix, 'documents' AS section, 0::BIGINT AS pos, t AS text FROM dtext
   UNION ALL SELECT qid, NULL, 'live', 0, t FROM rtext
   UNION ALL SELECT qid, NULL, 'validation', 0, split_part(t, chr(10) || '=== HEURISTIC', 1) FROM vtext
   UNION ALL SELECT qid, NULL, 'analysis', 0, '=== HEURISTIC' || split_part(t, chr(10) || '=== HEURISTIC', 2) FROM vtext
   UNION ALL SELECT DISTINCT NULL::BIGINT, prefix, 'history', (-9223372036854775807 - 1)::BIGINT, '=== HISTORICAL BGP UPDATES ===' FROM logged
   UNION ALL SELECT NULL, prefix, 'history', -epoch_us(ts), {HISTORY_TEXT_SQL} FROM logged)
 SELECT * FROM pieces""",
)
def context_sections(spark: SparkSession, sf: str) -> DataFrame:
    """All five sections of the context, as rows."""
    logged = rib.announced_or_withdrawn(fx.load(spark, sf, "fx_updates")).withColumn("origin_as", raw_origin("as_path"))
    return report.context_sections(*_parts(spark, sf), fx.load(spark, sf, "fx_found"), logged)


@register(
    "context_history",
    fx.cte("fx_updates") + """
    SELECT prefix, ts, seq, """ + HISTORY_TEXT_SQL + """ AS text
    FROM fx_updates WHERE update_type IN ('A', 'W')""",
)
def context_history(spark: SparkSession, sf: str) -> DataFrame:
    logged = rib.announced_or_withdrawn(fx.load(spark, sf, "fx_updates"))
    return report.history_entries(logged.withColumn("origin_as", raw_origin("as_path")))


@register(
    "context_documents",
    SEARCH_SQL + """ SELECT qid, concat('=== RFC DOCUMENTATION ===', chr(10), string_agg(concat('Source: ', source, chr(10), 'Content: ', content, chr(10)), chr(10) ORDER BY rank)) AS documents_text
    FROM shaped GROUP BY qid""",
)
def context_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Document section of the context of every user turn."""
    return report.document_section(_found(spark, sf))
