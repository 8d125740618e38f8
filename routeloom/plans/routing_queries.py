"""Queries over routing tables, updates and lookups, each with the SQL it is checked against."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import covering, registry, rib
from ..schemas import RIB_STATE
from ..storage import stored
from . import fixtures as fx
from .registry import register

RIB_ORDER = ["seq", "peer_asn", "as_path"]

# -- SQL fragments of the oracles -----------------------------------------------------------------------------

TOKENS = "list_filter(regexp_split_to_array({p}, '\\s+'), lambda x: x <> '')"
NUMBERS = (
    "list_filter(list_transform(" + TOKENS + ", lambda x: CASE WHEN contains(x, '{{') THEN split_part(trim(x, '{{}}'), ',', 1) "
    "WHEN contains(x, '(') THEN '' ELSE x END), lambda x: regexp_full_match(x, '[0-9]+'))"
)
STRICT = "(len(" + TOKENS + ") > 0 AND len(list_filter(" + TOKENS + ", lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0)"


def numbers(p: str) -> str:
    return NUMBERS.format(p=p)


def tokens(p: str) -> str:
    return TOKENS.format(p=p)


def strict(p: str) -> str:
    return STRICT.format(p=p)


def v4_value(ip: str) -> str:
    return " + ".join(f"split_part({ip}, '.', {i + 1})::BIGINT * {256 ** (3 - i)}" for i in range(4))


def v4_mask(value: str, plen: str) -> str:
    return f"(({value}) - ({value}) % (1::BIGINT << (32 - ({plen})::INT)))"


def v6_high(p: str) -> str:
    """The first 64 bits of a prefix of three groups at most."""
    group = lambda i: f"lpad(split_part(split_part({p}, '::', 1), ':', {i}), 4, '0')"
    return f"('0x' || {group(1)} || {group(2)} || {group(3)} || '0000')::BIGINT"


def v4_text(value: str, plen: str) -> str:
    return (
        f"concat(({value}) // 16777216, '.', ({value}) // 65536 % 256, '.', ({value}) // 256 % 256, '.', ({value}) % 256, "
        f"'/', {plen})"
    )


SNAPSHOT_SQL = f"""
 rib_rows AS (
   SELECT seq, peer_asn, as_path, split_part(prefix, '/', 2)::INT AS plen, {v4_value("split_part(prefix, '/', 1)")} AS v,
     {numbers('as_path')} AS nums FROM fx_rib),
 snap AS (
   SELECT {v4_mask('v', 'plen')} AS net, plen, arg_max(nums, (seq, peer_asn, as_path)) AS nums
   FROM rib_rows WHERE len(nums) > 0 GROUP BY ALL)
"""

REPLAY_SQL = f"""
 good AS (
   SELECT seq, ts, prefix, update_type, as_path FROM fx_updates
   WHERE update_type = 'W' OR (update_type = 'A' AND {strict("coalesce(as_path, '')")})),
 last AS (SELECT prefix, arg_max(update_type, (ts, seq)) AS t, arg_max(coalesce(as_path, ''), (ts, seq)) AS path FROM good GROUP BY prefix)
"""


# -- routing table --------------------------------------------------------------------------------------------


def _joined(path: str = "as_path"):
    return F.array_join(path, " ").alias(path)


@register(
    "rib_snapshot",
    fx.cte("fx_rib") + "," + SNAPSHOT_SQL + f"""
    SELECT net AS net_hi, plen, {v4_text('net', 'plen')} AS prefix, nums[-1]::BIGINT AS origin_as,
      array_to_string(nums, ' ') AS as_path FROM snap""",
)
def rib_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return rib.snapshot(fx.load(spark, sf, "fx_rib"), RIB_ORDER).select(
        "net_hi", "plen", "prefix", "origin_as", _joined()
    )


@register(
    "rib_snapshot_v6",
    fx.cte("fx_rib6") + f""",
    keyed AS (SELECT *, ('0x' || '20010db8' || lpad(g3::VARCHAR, 4, '0') || lpad(g4::VARCHAR, 4, '0'))::BIGINT AS hi FROM fx_rib6)
    SELECT hi - hi % (1::HUGEINT << (64 - len)::INT)::BIGINT AS net_hi, 0::BIGINT AS net_lo, len AS plen,
      arg_max(as_path, seq) AS as_path FROM keyed GROUP BY ALL""",
)
def rib_snapshot_v6(spark: SparkSession, sf: str) -> DataFrame:
    state = rib.snapshot(fx.load(spark, sf, "fx_rib6"))
    return state.select("net_hi", "net_lo", F.col("plen").cast("bigint").alias("plen"), _joined())


def rib_elements(spark: SparkSession, sf: str) -> DataFrame:
    """The derived table in the shape of decoded dump elements."""
    seq = F.col("seq")
    return fx.load(spark, sf, "fx_rib").select(
        seq.alias("seq"),
        F.when(F.col("orderkey") % 19 == 0, "corrupted").otherwise("valid").alias("status"),
        F.when(F.col("orderkey") % 17 == 0, "S").otherwise("R").alias("elem_type"),
        F.when(F.col("linenumber") == 7, 0).otherwise(F.unix_seconds(F.col("shipdate").cast("timestamp"))).alias("time"),
        F.lit("rrc03").alias("collector"),
        F.concat(F.lit("192.0.2."), F.col("peer_asn") % 256).alias("peer_address"),
        "peer_asn",
        "prefix",
        "as_path",
        F.lit("192.0.2.1").alias("next_hop"),
        F.when(
            F.col("linenumber") > 1,
            F.array(
                F.struct(F.lit(65000).cast("bigint").alias("asn"), F.col("partkey").alias("value")),
                F.struct(F.when(F.col("linenumber") > 2, F.col("peer_asn")).alias("asn"), F.lit(None).cast("bigint").alias("value")),
            ),
        ).alias("communities"),
        F.lit(None).cast("bigint").alias("med"),
        F.col("linenumber").cast("bigint").alias("local_pref"),
        F.when(F.col("linenumber") == 3, "").alias("atomic_aggregate"),
        F.when(F.col("linenumber") == 4, F.concat(F.col("peer_asn"), F.lit(":2001:db8::1")))
        .when(F.col("linenumber") == 5, F.lit("65000")).alias("aggregator"),
    )


@register(
    "rib_entries",
    fx.cte("fx_rib") + f"""
    SELECT seq, CASE WHEN linenumber <> 7 THEN shipdate END AS record_time, peer_asn, prefix,
      CASE WHEN len({numbers('as_path')}) > 0 THEN array_to_string({numbers('as_path')}, ' ')
           WHEN len({tokens('as_path')}) > 0 THEN array_to_string({tokens('as_path')}, ' ') END AS as_path,
      ({numbers('as_path')})[-1]::BIGINT AS origin_as,
      CASE WHEN linenumber > 2 THEN concat('65000:', partkey, ' ', peer_asn, ':0')
           WHEN linenumber > 1 THEN concat('65000:', partkey, ' 0:0') END AS communities,
      linenumber::BIGINT AS local_pref, linenumber = 3 AS atomic_aggregate,
      CASE WHEN linenumber = 4 THEN peer_asn END AS aggregator_as,
      CASE WHEN linenumber = 4 THEN '2001:db8::1' END AS aggregator_address
    FROM fx_rib WHERE orderkey % 19 <> 0 AND orderkey % 17 <> 0""",
)
def rib_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = rib.rib_entries(rib_elements(spark, sf), "2025-05-04 08:00:00")
    return rows.select(
        "seq", F.col("record_time").cast("timestamp_ntz").alias("record_time"), "peer_asn", "prefix", "as_path",
        "origin_as", "communities", "local_pref", "atomic_aggregate", "aggregator_as", "aggregator_address",
    )


@register(
    "as_path_parse",
    fx.cte("fx_updates") + f""",
    paths AS (SELECT as_path, count(*) AS n FROM fx_updates GROUP BY as_path)
    SELECT as_path AS raw_path, n,
      CASE WHEN len({numbers('as_path')}) > 0 THEN array_to_string({numbers('as_path')}, ' ')
           WHEN len({tokens('as_path')}) > 0 THEN array_to_string({tokens('as_path')}, ' ') END AS as_path,
      ({numbers('as_path')})[-1]::BIGINT AS origin_as, ({tokens('as_path')})[-1] AS last_token,
      coalesce(contains(({tokens('as_path')})[-1], '{{'), false) AS origin_is_set,
      coalesce({strict('as_path')}, false) AS is_strict
    FROM paths""",
)
def as_path_parse(spark: SparkSession, sf: str) -> DataFrame:
    counted = fx.load(spark, sf, "fx_updates").groupBy("as_path").agg(F.count("*").alias("n"))
    return counted.select(
        F.col("as_path").alias("raw_path"),
        "n",
        paths.normalized_path("as_path").alias("as_path"),
        paths.path_origin("as_path").alias("origin_as"),
        paths.raw_origin("as_path").alias("last_token"),
        paths.origin_is_set("as_path").alias("origin_is_set"),
        paths.strict_path_numbers("as_path").isNotNull().alias("is_strict"),
    )


# -- updates --------------------------------------------------------------------------------------------------


@register(
    "rib_replay",
    fx.cte("fx_updates") + f""",
    base_rows AS (SELECT *, {numbers("coalesce(as_path, '')")} AS nums FROM fx_updates WHERE update_type = 'A' AND ts < TIMESTAMP '2024-01-08'),
    base AS (SELECT prefix, arg_max(nums, seq) AS nums FROM base_rows WHERE len(nums) > 0 GROUP BY prefix),
    good AS (SELECT * FROM fx_updates WHERE ts >= TIMESTAMP '2024-01-08' AND (update_type = 'W' OR (update_type = 'A' AND {strict("coalesce(as_path, '')")}))),
    ev AS (
      SELECT prefix, 0 AS gen, NULL::TIMESTAMP AS ts, NULL::BIGINT AS seq, 'A' AS t, nums FROM base
      UNION ALL SELECT prefix, 1, ts, seq, update_type, {tokens("coalesce(as_path, '')")} FROM good),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY gen DESC, ts DESC, seq DESC) AS rn FROM ev)
    SELECT prefix, nums[-1]::BIGINT AS origin_as, array_to_string(nums, ' ') AS as_path FROM ranked WHERE rn = 1 AND t = 'A'""",
)
def rib_replay(spark: SparkSession, sf: str) -> DataFrame:
    updates = fx.load(spark, sf, "fx_updates")
    cut = F.lit("2024-01-08").cast("timestamp_ntz")
    base = rib.snapshot(updates.where((F.col("update_type") == "A") & (F.col("ts") < cut)))
    return rib.replay(base, updates, since=cut).select("prefix", "origin_as", _joined())


@register(
    "update_log",
    fx.cte("fx_updates") + """
    SELECT ts AS timestamp, seq, collector, peer_address, peer_asn, prefix, update_type,
      CASE WHEN update_type = 'A' THEN as_path END AS as_path,
      CASE WHEN update_type = 'A' THEN collector || '!' END AS aggregator
    FROM fx_updates WHERE update_type IN ('A', 'W')""",
)
def update_log(spark: SparkSession, sf: str) -> DataFrame:
    updates = fx.load(spark, sf, "fx_updates").withColumnRenamed("ts", "timestamp")
    return rib.update_log(updates.withColumn("aggregator", F.concat("collector", F.lit("!"))))


@register(
    "update_range_filter",
    fx.cte("fx_updates") + """
    SELECT seq, ts, collector, prefix, update_type, as_path,
      list_filter(regexp_split_to_array(as_path, '\\s+'), lambda x: x <> '')[-1] AS origin_text
    FROM fx_updates WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' AND collector IN ('rrc00', 'rrc02')
      AND list_contains(regexp_split_to_array(as_path, '\\s+'), '1003')""",
)
def update_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = rib.updates_in_range(
        fx.load(spark, sf, "fx_updates"), at("2024-01-02"), at("2024-01-20"), ["rrc00", "rrc02"], asn="1003"
    )
    return rows.select("seq", "ts", "collector", "prefix", "update_type", "as_path", "origin_text")


@register(
    "update_range_one_hour",
    fx.cte("fx_updates") + """
    SELECT seq, ts, prefix, update_type FROM fx_updates
    WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-02 01:00:00'""",
)
def update_range_one_hour(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = rib.updates_in_range(fx.load(spark, sf, "fx_updates"), at("2024-01-02"), at("2024-01-20"), longest=timedelta(hours=1))
    return rows.select("seq", "ts", "prefix", "update_type")


@register(
    "update_history",
    fx.cte("fx_updates") + """
    SELECT prefix, ts, update_type, as_path, seq FROM fx_updates WHERE update_type IN ('A', 'W')
    ORDER BY prefix, ts DESC, seq DESC""",
)
def update_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = rib.announced_or_withdrawn(fx.load(spark, sf, "fx_updates"))
    return rib.update_history(rows).select("prefix", "ts", "update_type", "as_path", "seq")


_SUMMARY = """count(*) AS total_updates, count(*) FILTER (update_type = 'A') AS announcements,
      count(*) FILTER (update_type = 'W') AS withdrawals, count(DISTINCT nullif(as_path, '')) AS unique_as_paths,
      min(ts) AS start, max(ts) AS "end",
      CASE WHEN arg_max(update_type, (ts, seq)) = 'W' THEN 'withdrawn' ELSE 'announced' END AS most_recent_state"""


@register("update_summary", fx.cte("fx_updates") + f" SELECT prefix, {_SUMMARY} FROM fx_updates GROUP BY prefix")
def update_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rib.summarize_updates(fx.load(spark, sf, "fx_updates"), ["prefix"]).drop("status")


@register("update_summary_total", fx.cte("fx_updates") + f" SELECT {_SUMMARY} FROM fx_updates")
def update_summary_total(spark: SparkSession, sf: str) -> DataFrame:
    return rib.summarize_updates(fx.load(spark, sf, "fx_updates")).drop("status")


@register(
    "update_slices",
    fx.cte("fx_updates") + """
    SELECT date_trunc('minute', ts) AS slice_start, collector, count(*) AS updates,
      count(*) FILTER (update_type = 'A') AS announcements, count(*) FILTER (update_type = 'W') AS withdrawals
    FROM fx_updates GROUP BY ALL""",
)
def update_slices(spark: SparkSession, sf: str) -> DataFrame:
    return rib.update_slices(fx.load(spark, sf, "fx_updates"), by=["collector"])


# -- lookups --------------------------------------------------------------------------------------------------


def current_state(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot of the table rows with the updates applied."""
    base = rib.snapshot(fx.load(spark, sf, "fx_rib"), RIB_ORDER)
    return stored(rib.replay(base, fx.load(spark, sf, "fx_updates")))


STATE_SQL = (
    fx.cte("fx_rib", "fx_updates", "fx_addresses") + "," + SNAPSHOT_SQL + "," + REPLAY_SQL + f""",
 state AS (
   SELECT net, plen, {v4_text('net', 'plen')} AS prefix, nums[-1]::BIGINT AS origin_as, array_to_string(nums, ' ') AS as_path FROM snap
   UNION ALL
   SELECT {v4_value("split_part(prefix, '/', 1)")}, 24, prefix, ({tokens('path')})[-1]::BIGINT, path
   FROM last WHERE t = 'A' AND NOT contains(prefix, ':')),
 addr AS (SELECT addr_id, ip, {v4_value('ip')} AS v FROM fx_addresses)"""
)

LPM_SQL = """,
 hits AS (
   SELECT addr_id, ip, prefix, origin_as, as_path, row_number() OVER (PARTITION BY addr_id ORDER BY plen DESC) AS rn
   FROM addr JOIN {state} s ON v BETWEEN s.net AND s.net + (1::BIGINT << (32 - s.plen)) - 1)
 SELECT a.addr_id, a.ip, h.prefix AS matching_prefix, h.origin_as, h.as_path
 FROM addr a LEFT JOIN (FROM hits WHERE rn = 1) h USING (addr_id)"""


def _routes(found: DataFrame) -> DataFrame:
    return found.select("addr_id", "ip", "matching_prefix", "origin_as", _joined())


@register("address_routes_after_replay", STATE_SQL + LPM_SQL.format(state="state"))
def address_routes_after_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The route in force for each address once the updates are applied, and who originates it."""
    return _routes(covering.longest_match(fx.load(spark, sf, "fx_addresses"), current_state(spark, sf)))


@register(
    "lpm_lookup",
    fx.cte("fx_rib", "fx_addresses") + "," + SNAPSHOT_SQL + f""",
    state AS (SELECT net, plen, {v4_text('net', 'plen')} AS prefix, nums[-1]::BIGINT AS origin_as, array_to_string(nums, ' ') AS as_path FROM snap),
    addr AS (SELECT addr_id, ip, {v4_value('ip')} AS v FROM fx_addresses)""" + LPM_SQL.format(state="state"),
)
def lpm_lookup(spark: SparkSession, sf: str) -> DataFrame:
    state = stored(rib.snapshot(fx.load(spark, sf, "fx_rib"), RIB_ORDER))
    return _routes(covering.longest_match(fx.load(spark, sf, "fx_addresses"), state))


@register(
    "lpm_lookup_v6",
    fx.cte("fx_rib6", "fx_addresses6") + """,
    keyed AS (SELECT *, ('0x' || '20010db8' || lpad(g3::VARCHAR, 4, '0') || lpad(g4::VARCHAR, 4, '0'))::BIGINT AS hi FROM fx_rib6),
    state AS (SELECT hi - hi % (1::HUGEINT << (64 - len)::INT)::BIGINT AS net, len AS plen, arg_max(as_path, seq) AS as_path FROM keyed GROUP BY ALL),
    addr AS (SELECT addr_id, ip, ('0x' || '20010db8' || lpad(g3::VARCHAR, 4, '0') || lpad(g4::VARCHAR, 4, '0'))::BIGINT AS hi FROM fx_addresses6),
    hits AS (
      SELECT addr_id, plen, as_path, row_number() OVER (PARTITION BY addr_id ORDER BY plen DESC) AS rn
      FROM addr JOIN state s ON hi - hi % (1::HUGEINT << (64 - plen)::INT)::BIGINT = s.net)
    SELECT a.addr_id, a.ip, h.plen AS plen, h.as_path FROM addr a LEFT JOIN (FROM hits WHERE rn = 1) h USING (addr_id)""",
)
def lpm_lookup_v6(spark: SparkSession, sf: str) -> DataFrame:
    found = covering.longest_match(fx.load(spark, sf, "fx_addresses6"), stored(rib.snapshot(fx.load(spark, sf, "fx_rib6"))))
    return found.select("addr_id", "ip", F.col("plen").cast("bigint").alias("plen"), _joined())


@register(
    "exact_lookup",
    fx.cte("fx_updates", "fx_vrp") + "," + REPLAY_SQL + f"""
    SELECT v.vrp_id, v.prefix, l.prefix AS matching_prefix, ({tokens('path')})[-1]::BIGINT AS origin_as, path AS as_path
    FROM fx_vrp v JOIN last l ON l.prefix = v.prefix WHERE t = 'A'""",
)
def exact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    updates = fx.load(spark, sf, "fx_updates")
    state = rib.replay(spark.createDataFrame([], RIB_STATE), updates)
    found = covering.exact_lookup(fx.load(spark, sf, "fx_vrp").select("vrp_id", "prefix"), state)
    return found.select("vrp_id", "prefix", "matching_prefix", "origin_as", _joined())


@register(
    "routes_by_origin",
    fx.cte("fx_rib") + "," + SNAPSHOT_SQL + f"""
    SELECT {v4_text('net', 'plen')} AS prefix, nums[-1]::BIGINT AS origin_as FROM snap WHERE nums[-1] = '1003'""",
)
def routes_by_origin(spark: SparkSession, sf: str) -> DataFrame:
    return rib.routes_by_origin(rib.snapshot(fx.load(spark, sf, "fx_rib"), RIB_ORDER), 1003).select("prefix", "origin_as")


# -- origin validation ----------------------------------------------------------------------------------------


@register(
    "origin_validation",
    fx.cte("fx_rib", "fx_updates", "fx_vrp", "fx_vrp6") + f""",
    routes AS (
      SELECT DISTINCT prefix, nums[-1]::BIGINT AS origin_as, contains(toks[-1], '{{') AS is_set FROM (
        SELECT prefix, {numbers('as_path')} AS nums, {tokens('as_path')} AS toks FROM fx_rib
        UNION ALL SELECT prefix, {numbers('as_path')}, {tokens('as_path')} FROM fx_updates WHERE update_type = 'A')
      WHERE len(nums) > 0),
    r AS (
      SELECT *, 32 AS bits, {v4_value("split_part(prefix, '/', 1)")} AS v, split_part(prefix, '/', 2)::INT AS plen FROM routes WHERE NOT contains(prefix, ':')
      UNION ALL SELECT *, 64, {v6_high('prefix')}, split_part(prefix, '/', 2)::INT FROM routes WHERE contains(prefix, ':')),
    w AS (SELECT max_length, asn, 32 AS bits, {v4_value("split_part(prefix, '/', 1)")} AS wv, split_part(prefix, '/', 2)::INT AS wlen FROM fx_vrp
          UNION ALL SELECT max_length, asn, 64, {v6_high('prefix')}, split_part(prefix, '/', 2)::INT FROM fx_vrp6),
    wn AS (SELECT bits, wv >> (bits - wlen) AS net, wlen, coalesce(max_length, wlen) AS max_length, asn FROM w)
    SELECT r.prefix, r.origin_as, r.is_set AS origin_is_none, count(wn.net) AS covering_vrps,
      CASE WHEN coalesce(bool_or(NOT r.is_set AND wn.asn = r.origin_as AND wn.asn > 0 AND r.plen <= wn.max_length), false) THEN 'valid'
           WHEN count(wn.net) > 0 THEN 'invalid' ELSE 'not-found' END AS rpki_status
    FROM r LEFT JOIN wn ON r.bits = wn.bits AND r.plen >= wn.wlen AND r.v >> (r.bits - wn.wlen) = wn.net
    GROUP BY ALL""",
)
def origin_validation(spark: SparkSession, sf: str) -> DataFrame:
    seen = fx.load(spark, sf, "fx_updates").where("update_type = 'A'").select("prefix", "as_path")
    rows = fx.load(spark, sf, "fx_rib").select("prefix", "as_path").unionByName(seen)
    routes = rows.select(
        "prefix", paths.path_origin("as_path").alias("origin_as"), paths.origin_is_set("as_path").alias("origin_is_set")
    ).where("origin_as IS NOT NULL")
    vrps = fx.load(spark, sf, "fx_vrp").unionByName(fx.load(spark, sf, "fx_vrp6"))
    return covering.validate_origins(routes, vrps)


# -- registry answers, rejected rows --------------------------------------------------------------------------


@register(
    "irr_answers",
    fx.cte("fx_answers") + """
    SELECT prefix, CASE WHEN cust % 6 IN (1, 3) THEN nation_as::VARCHAR ELSE '' END AS irr_origins,
      CASE WHEN cust % 6 = 1 THEN 'RIPE' ELSE '' END AS authorities,
      CASE WHEN cust % 6 IN (0, 5) THEN 'error' WHEN cust % 6 IN (1, 3) THEN 'success' ELSE 'not-found' END AS status FROM fx_answers""",
)
def irr_answers(spark: SparkSession, sf: str) -> DataFrame:
    """IRR answers as landed JSON: no JSON, NULL records, empty lists, fallback records."""
    found = registry.irr_origins(registry.irr_items(fx.load(spark, sf, "fx_answers").select("prefix", "answer")))
    text = lambda c: F.array_join(c, ",").alias(c)
    return found.select("prefix", text("irr_origins"), text("authorities"), "status")


@register(
    "roa_answers",
    fx.cte("fx_answers") + """
    SELECT prefix, roa_as AS origin_as, CASE cust % 4 WHEN 0 THEN 'not-found' WHEN 1 THEN 'valid' ELSE 'invalid' END AS rpki_status,
      (cust % 4 <> 0)::INT::BIGINT AS covering_roas FROM fx_answers""",
)
def roa_answers(spark: SparkSession, sf: str) -> DataFrame:
    """RPKI answers as landed JSON, some without authorizations."""
    answers = fx.load(spark, sf, "fx_answers")
    roas = registry.roa_rows(answers.select("prefix", F.col("roa_answer").alias("answer")))
    return registry.roa_status(answers.select("prefix", F.col("roa_as").alias("origin_as")), roas)


@register(
    "rejected_rows",
    fx.cte("fx_updates") + f"""
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN update_type NOT IN ('A', 'W') THEN 'type'
        WHEN update_type = 'A' AND NOT {strict("coalesce(as_path, '')")} THEN 'path' END AS reason FROM fx_updates)
    WHERE reason IS NOT NULL GROUP BY reason""",
)
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    """How many updates change nothing, and why."""
    return rib.rejected_updates(fx.load(spark, sf, "fx_updates"))
