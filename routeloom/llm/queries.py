"""Registered queries of the subpackage, one per operator, and the DuckDB SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, divergence, exact_dedup, language_id, ngram_join, packing, personal_data, piece_codec, quality_model, quality_rules, repeated_bytes, simhash, token_files
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), BYTES)


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query
def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(table(spark, sf_dir, "documents"), PIECES)


@query
def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_sha256")


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).drop("text_sha256")


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.report(table(spark, sf_dir, "documents"))


@query
def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # after the contract's columns, what was done: whether the document stays unchanged
    return repeated_bytes.remaining(table(spark, sf_dir, "documents")).withColumn("kept", F.col("n_removed") == 0)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTES)


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT rid, lang, term FROM t) GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS V FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS cnt FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
ns AS (SELECT lang, source, sum(cnt) AS N FROM c GROUP BY lang, source),
n AS (SELECT g.lang, g.source, coalesce(ns.N, 0) AS N, coalesce(v.V, 0) AS V
      FROM g LEFT JOIN ns ON ns.lang = g.lang AND ns.source = g.source LEFT JOIN v ON v.lang = g.lang),
gp AS (SELECT n.lang, n.source, k.term, coalesce(c.cnt, 0) AS cnt,
              1 + (CAST(1000000000 AS BIGINT) * (coalesce(c.cnt, 0) + 5)) // (n.N + 5 * n.V) AS p
       FROM n JOIN kept k ON k.lang = n.lang
       LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
pv AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
       FROM gp x JOIN gp y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
       GROUP BY x.lang, x.source, y.source),
lc AS (SELECT lang, term, sum(cnt) AS cnt FROM c GROUP BY lang, term),
ln AS (SELECT lang, sum(cnt) AS N FROM lc GROUP BY lang),
lp AS (SELECT lc.lang, lc.term, 1 + (CAST(1000000000 AS BIGINT) * (lc.cnt + 5)) // (ln.N + 5 * v.V) AS q
       FROM lc JOIN ln ON ln.lang = lc.lang JOIN v ON v.lang = lc.lang),
everything AS (
  SELECT pairs.lang, pairs.source, 'pair' AS part, pairs.item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
  FROM pairs LEFT JOIN pv ON pv.lang = pairs.lang AND pv.source = pairs.source AND pv.item = pairs.item
  UNION ALL
  SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, CAST(gp.p - lp.q AS BIGINT) AS value
  FROM gp JOIN lp ON lp.lang = gp.lang AND lp.term = gp.term WHERE gp.cnt > 0 AND gp.p > lp.q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM everything)
WHERE part = 'pair' OR rank <= 50"""


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTES, PIECES)
