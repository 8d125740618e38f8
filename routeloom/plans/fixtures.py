"""Routing tables derived from the given tables, by one SQL text for Spark and DuckDB alike.

Every row of a source table gives a row, so the derived tables grow with the given ones.  Users, customers, suppliers
and orders are mapped to the same family of /24 (or IPv6 /48) networks, which makes the tables joinable.
Only arithmetic is used, because the hash functions of the two engines differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _int(x: str) -> str:
    return f"cast(floor({x}) as bigint)"


def net24(n: str) -> str:
    """Text of the n-th /24 from 10.0.0.0 on."""
    return f"concat(10 + {_int(f'({n})/65536')} % 200, '.', {_int(f'({n})/256')} % 256, '.', ({n}) % 256, '.0/24')"


def net48(n: str) -> str:
    return f"concat('2001:', {_int(f'({n})/10000')} % 10000 + 1, ':', ({n}) % 10000, '::/48')"


def quad(a: str) -> str:
    return f"concat({_int(f'{a}/16777216')}, '.', {_int(f'{a}/65536')} % 256, '.', {_int(f'{a}/256')} % 256, '.', {a} % 256)"


UPDATE_PREFIX = f"CASE WHEN user_id % 10 = 9 THEN {net48('user_id')} ELSE {net24('user_id')} END"

SQL: dict[str, str] = {
    # Updates: about 40 % A, 40 % W, 20 % S (a state message, to be ignored); sets, confederations, empty paths.
    "fx_updates": f"""
        SELECT event_id AS seq, ts, concat('rrc0', event_id % 3) AS collector,
          concat('192.0.2.', event_id % 4) AS peer_address, 64500 + event_id % 4 AS peer_asn,
          {UPDATE_PREFIX} AS prefix,
          CASE WHEN event_type IN ('error','signup') THEN 'W' WHEN event_type = 'purchase' THEN 'S' ELSE 'A' END AS update_type,
          CASE WHEN event_type IN ('error','signup') THEN NULL WHEN event_id % 31 = 0 THEN ''
               WHEN event_id % 29 = 0 THEN concat('3333 ', 64000 + user_id % 7, ' {{', 1000 + event_id % 5, ',64999}}')
               WHEN event_id % 37 = 0 THEN concat('3333 (65001 65002) ', 1000 + event_id % 5)
               ELSE concat('3333 ', 64000 + user_id % 7, ' ', 1000 + event_id % 5) END AS as_path
        FROM events""",
    "fx_rib": f"""
        SELECT l_orderkey * 8 + l_linenumber AS seq, concat({quad('a')}, '/', 8 + (l_linenumber + l_suppkey) % 17) AS prefix,
          CASE WHEN l_orderkey % 23 = 0 THEN concat('3333 {{', 1000 + l_partkey % 5, ',7}}') WHEN l_orderkey % 41 = 0 THEN ''
               ELSE concat('3333 ', 64000 + l_suppkey % 7, ' ', 1000 + l_partkey % 5) END AS as_path,
          l_suppkey AS peer_asn, l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey,
          l_shipdate AS shipdate
        FROM (SELECT *, (l_partkey * 2654435761) % 3758096384 AS a FROM lineitem) t""",
    "fx_rib6": """
        SELECT p_partkey AS seq, concat('2001:db8:', p_partkey % 100, ':', p_size, '::/', 32 + p_partkey % 5 * 8) AS prefix,
          concat('3333 ', 64000 + p_size % 7, ' ', 1000 + p_partkey % 5) AS as_path, p_partkey % 4 AS peer_asn,
          p_partkey % 100 AS g3, p_size AS g4, 32 + p_partkey % 5 * 8 AS len
        FROM part""",
    "fx_vrp": f"""
        SELECT p_partkey AS vrp_id, concat({quad('a')}, '/', 8 + p_size % 13) AS prefix,
          8 + p_size % 13 + p_partkey % 5 AS max_length,
          CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1000 + p_partkey % 5 END AS asn
        FROM (SELECT *, (p_partkey * 2654435761) % 3758096384 AS a FROM part) t
        UNION ALL
        SELECT 1000000000000 + s_suppkey, {net24('s_suppkey')}, CASE WHEN s_suppkey % 4 = 0 THEN 23 WHEN s_suppkey % 4 = 1 THEN NULL ELSE 24 END,
          1000 + s_suppkey % 5 FROM supplier""",
    # Some without a maximum length; the shorter ones cover all IPv6 updates of a user group.
    "fx_vrp6": f"""
        SELECT s_suppkey AS vrp_id, {net48('s_suppkey * 10 + 9')} AS prefix, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 47 + s_suppkey % 3 END AS max_length,
          1000 + s_suppkey % 5 AS asn FROM supplier
        UNION ALL
        SELECT 1000000000000 + n_nationkey, concat('2001:', n_nationkey % 4 + 1, '::/32'), CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 40 + n_nationkey % 3 * 8 END,
          1000 + n_nationkey % 5 FROM nation""",
    # Registry answers as JSON text: no JSON, a NULL record before a good one, empty lists, fallback records, no lists, none.
    "fx_answers": f"""
        SELECT c_custkey AS cust, {net24('c_custkey')} AS prefix, CASE c_custkey % 6
          WHEN 0 THEN 'not json'
          WHEN 1 THEN concat('{{"data":{{"irr_records":[null,[{{"key":"origin","value":"AS', 1000 + c_nationkey, '"}},{{"key":"source","value":"RIPE"}}]],"records":[]}}}}')
          WHEN 2 THEN '{{"data":{{"irr_records":[],"records":[]}}}}'
          WHEN 3 THEN concat('{{"data":{{"irr_records":[],"records":[[{{"key":"OriginAS","value":" AS', 1000 + c_nationkey, '"}}]]}}}}')
          WHEN 4 THEN '{{"data":{{}}}}' END AS answer,
          concat('{{"data":{{"validating_roas":[', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('{{"origin":"', 1000 + c_nationkey % 5, '","prefix":"x","max_length":24,"validity":"', CASE WHEN c_custkey % 4 = 1 THEN 'valid' ELSE 'invalid_asn' END, '"}}') END, ']}}}}') AS roa_answer,
          1000 + c_nationkey AS nation_as, 1000 + c_nationkey % 5 AS roa_as
        FROM customer""",
    # Registry records: one in five networks is known to the fallback records only, one in seven to none.
    "fx_irr": f"""
        SELECT c_custkey AS record_id, {net24(_int('c_custkey/10'))} AS prefix,
          CASE WHEN {_int('c_custkey/10')} % 5 = 0 THEN 'records' ELSE 'irr_records' END AS section,
          CASE WHEN c_custkey % 11 = 0 OR {_int('c_custkey/10')} % 7 = 0 THEN 'ASX' ELSE concat('AS', 1000 + c_nationkey % 5) END AS origin,
          CASE WHEN c_custkey % 3 = 0 THEN ' RIPE ' WHEN c_custkey % 3 = 1 THEN 'ARIN' ELSE '' END AS source
        FROM customer""",
    "fx_roa": f"""
        SELECT {net24(_int('c_custkey/13'))} AS prefix, c_custkey AS pos, concat('AS', 1000 + c_nationkey % 5) AS origin, 24 AS max_length,
          CASE c_custkey % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid_asn' WHEN 2 THEN 'invalid_length' WHEN 3 THEN 'unknown' ELSE 'valid' END AS validity
        FROM customer""",
    "fx_addresses": f"""
        SELECT c_custkey AS addr_id, {quad('a')} AS ip
        FROM (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN 3758096384 + c_custkey % 500000000
                             WHEN c_custkey % 10 = 1 THEN 167772160 + {_int('c_custkey/10')} * 256 + 7
                             ELSE (c_custkey * 2246822519) % 3758096384 END AS a FROM customer) t""",
    "fx_addresses6": """
        SELECT c_custkey AS addr_id, concat('2001:db8:', c_custkey % 150, ':', c_custkey % 50, '::', c_custkey % 1000) AS ip,
          c_custkey % 150 AS g3, c_custkey % 50 AS g4 FROM customer""",
    "fx_questions": f"""
        SELECT o_orderkey AS qid, concat('Check AS', CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END, 1000 + o_orderkey % 5, ' announcing ', {net24(_int('o_custkey/10'))},
          CASE WHEN o_orderkey % 4 = 0 THEN concat(' and ', replace({net24(_int('o_custkey/10'))}, '/24', ''))
               WHEN o_orderkey % 4 = 1 THEN concat(' to ', 1 + o_custkey % 220, '.8.', o_custkey % 256, '.8') ELSE '' END,
          CASE WHEN o_orderkey % 3 = 0 THEN ' since yesterday' WHEN o_orderkey % 3 = 1 THEN ' is it valid per RPKI' ELSE '' END) AS question
        FROM orders""",
    "fx_incidents": f"""
        SELECT s_suppkey AS event_id, {net24('s_suppkey')} AS prefix, 1000 + s_suppkey % 5 AS hijacker_asn, 1000 + (s_suppkey + 1) % 5 AS victim_asn,
          CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 6 * 2 END AS confidence FROM supplier""",
    # Two documents for each question.
    "fx_found": """
        SELECT o_orderkey AS qid, 1 AS rank, concat('RFC ', o_custkey % 90) AS source, concat('text ', o_orderkey % 7) AS content FROM orders
        UNION ALL SELECT o_orderkey, 2, 'Unknown RFC', concat('more of ', o_orderkey) FROM orders""",
    # Labels of the questions; a NULL value says there is none of the type.
    "fx_truth": f"""
        SELECT o_orderkey AS qid, 'asns' AS entity_type, concat('AS', 1000 + o_orderkey % 5) AS value FROM orders
        UNION ALL SELECT o_orderkey, 'prefixes', CASE WHEN o_orderkey % 6 <> 0 THEN replace({net24(_int('o_custkey/10'))}, '.0/24', '/24') END FROM orders
        UNION ALL SELECT o_orderkey, 'ip_addresses', CASE WHEN o_orderkey % 4 = 1 THEN concat(1 + o_custkey % 220, '.8.', o_custkey % 256, '.8 ') END FROM orders
        UNION ALL SELECT o_orderkey, 'keywords', CASE WHEN o_orderkey % 3 = 1 THEN ' RPKI' ELSE 'announce' END FROM orders
        UNION ALL SELECT o_orderkey, 'time_references', CASE WHEN o_orderkey % 3 = 0 THEN ' Yesterday' END FROM orders""",
    "fx_docs": """
        SELECT doc_id, concat(CASE WHEN doc_id % 2 = 0 THEN 'rfc' ELSE 'doc' END, doc_id, '.txt') AS source,
          concat(CASE WHEN doc_id % 2 = 0 THEN concat('Front matter', chr(10), 'ABSTRACT', chr(10)) ELSE '' END,
                 CASE WHEN doc_id % 3 = 0 THEN concat('Table of Contents', chr(10), ' 1.  Introduction ... 2', chr(10), ' 2. Rest ... 3', chr(10), '1. Introduction', chr(10)) ELSE '' END,
                 text,
                 CASE WHEN doc_id % 5 < 2 THEN concat(chr(10), '9. Normative References', chr(10), 'tail line') ELSE '' END) AS text
        FROM documents""",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame over the given Parquet files."""
    used = [t for t in TABLES if f"FROM {t}" in SQL[name]]
    return derive(spark, name, {t: read(spark, sf_dir, t) for t in used})


def derive(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    # the formatter of ``spark.sql`` reads braces, so those of the data are doubled first
    text = SQL[name].replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **tables)


def cte(*names: str) -> str:
    """``WITH`` clause of the derived tables for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
