"""Queries over documents, chunks, vectors and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, evaluate, retrieval, term_search, vector_index
from ..storage import stored
from . import fixtures as fx
from .registry import register

SKIP_LINES = 5  # many test documents are shorter than the 250 lines of the default

_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_HEADINGS = "|".join(h.replace("'", "''") for h in documents.BACK_MATTER)


def _at(lines: str, test: str) -> str:
    return f"coalesce(list_position(list_transform({lines}, lambda l: {test}), true), 0)"


CLEAN_SQL = f"""
 d1 AS (SELECT doc_id, source, regexp_split_to_array(text, '{_BREAK}') AS l FROM fx_docs),
 d2 AS (SELECT doc_id, source, l[greatest({_at('l', "contains(lower(l), 'abstract')")}, 1):] AS l FROM d1),
 d3 AS (SELECT *, {_at('l', "contains(lower(l), 'table of contents')")} AS toc, {_at('l', "regexp_matches(lower(l), '^\\s*1\\.\\s+introduction')")} AS body FROM d2),
 d4 AS (SELECT doc_id, source, CASE WHEN toc > 0 AND toc < body THEN list_concat(CASE WHEN toc > 1 THEN l[:toc - 1] ELSE [] END, l[body:]) ELSE l END AS l FROM d3),
 d5 AS (SELECT *, {_at(f'l[{SKIP_LINES + 1}:]', f"regexp_matches(lower(l), '{_HEADINGS}')")} AS cut FROM d4),
 d6 AS (SELECT doc_id, source, CASE WHEN cut > 0 THEN l[:cut + {SKIP_LINES} - 1] ELSE l END AS l FROM d5),
 d7 AS (SELECT doc_id, source, list_filter(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '^{_BLANKS}+', ''), '{_BLANKS}+$', '')), lambda x: x <> '') AS l FROM d6),
 cleaned AS (SELECT doc_id, replace(source, '.txt', '_clean.txt') AS source, array_to_string(l, chr(10)) AS text FROM d7)"""


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents.clean_documents(fx.load(spark, sf, "fx_docs"), skip_lines=SKIP_LINES)
    return docs.withColumn("source", documents.clean_name("source"))


@register("clean_documents", fx.cte("fx_docs") + "," + CLEAN_SQL + " SELECT * FROM cleaned")
def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf)


@register("corpus_count", fx.cte("fx_docs") + "," + CLEAN_SQL + " SELECT count(*) AS documents, sum(length(text))::BIGINT AS characters FROM cleaned")
def corpus_count(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf).agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


@register(
    "document_labels",
    fx.cte("fx_docs") + """ SELECT doc_id, replace(source, '.txt', '_clean.txt') AS filename,
      CASE WHEN source LIKE 'rfc%' THEN concat('RFC ', doc_id) ELSE 'Unknown RFC' END AS label FROM fx_docs""",
)
def document_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.load(spark, sf, "fx_docs").select("doc_id", documents.clean_name("source").alias("filename"))
    return docs.withColumn("label", documents.document_label("filename"))


CHUNK_SQL = f"""
 ln AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS t FROM d7),
 pl AS (SELECT doc_id, i, CASE WHEN i > 1 THEN chr(10) || t ELSE t END AS p FROM ln),
 flagged AS (SELECT *, length(p) >= 800 AS long FROM pl),
 grp AS (SELECT *, sum(CASE WHEN long THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM flagged),
 wds AS (SELECT doc_id, i, generate_subscripts(string_split(p, ' '), 1) AS j, unnest(string_split(p, ' ')) AS t FROM grp WHERE long),
 wp AS (SELECT doc_id, i, j, CASE WHEN j > 1 THEN ' ' || t ELSE t END AS p FROM wds WHERE j > 1 OR t <> ''),
 wg AS (SELECT *, length(p) >= 800 AS long, sum(CASE WHEN length(p) >= 800 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY j) AS g FROM wp),
 runs AS (
   SELECT doc_id, min(i) AS o1, 0 AS o2, list(p ORDER BY i) AS ps FROM grp WHERE NOT long GROUP BY doc_id, g
   UNION ALL SELECT doc_id, i, min(j), list(p ORDER BY j) FROM wg WHERE NOT long GROUP BY doc_id, i, g
   UNION ALL SELECT doc_id, i, j, string_split(p, '') FROM wg WHERE long),
 ends AS (SELECT doc_id, o1, o2, ps, list_transform(range(0, len(ps) + 1), lambda k: coalesce(list_sum(list_transform(ps[:k], lambda x: length(x))), 0) * (k > 0)::INT) AS c FROM runs),
"""

CHUNK_FOLD_SQL = """
 fold AS (
   SELECT doc_id, o1, o2, ps, c, 0::BIGINT AS s, len(list_filter(c, lambda x: x <= 800)) - 1 AS e FROM ends
   UNION ALL
   SELECT doc_id, o1, o2, ps, c, s2 AS s, len(list_filter(c, lambda x: x <= c[s2 + 1] + 800)) - 1 AS e FROM (
     SELECT *, len(list_filter(c, lambda x: x < greatest(c[e + 1] - 100, c[e + 2] - 800))) AS s2 FROM fold WHERE e < len(ps))),
 texts AS (SELECT doc_id, o1, o2, s, regexp_replace(regexp_replace(array_to_string(ps[s + 1:e], ''), '^\\s+', ''), '\\s+$', '') AS text FROM fold)
 SELECT doc_id, replace(source, '.txt', '_clean.txt') AS source, row_number() OVER (PARTITION BY doc_id ORDER BY o1, o2, s) - 1 AS chunk_no, text
 FROM texts JOIN (SELECT doc_id, source FROM fx_docs) USING (doc_id) WHERE text <> ''"""


@register(
    "chunk_documents",
    fx.cte("fx_docs").replace("WITH ", "WITH RECURSIVE ", 1) + "," + CLEAN_SQL + "," + CHUNK_SQL + CHUNK_FOLD_SQL,
)
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents.chunk_documents(cleaned(spark, sf))


# -- vectors --------------------------------------------------------------------------------------------------

TOPK_SQL = """
 WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 sim AS (SELECT q.vec_id AS qid, d.vec_id AS id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id),
 ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, score FROM sim),
 topk AS (SELECT * FROM ranked WHERE rank <= 3)"""


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = fx.read(spark, sf, "embeddings")
    return retrieval.top_k(
        vectors.select(F.col("vec_id").alias("qid"), "embedding"),
        vectors.select(F.col("vec_id").alias("id"), "embedding"),
        exclude_same=True,
    )


@register("similarity_topk", TOPK_SQL + " SELECT qid, rank, id, score FROM topk")
def similarity_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf)


def similarity_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest other vectors of every vector by an inverted-file index; recall against the exact way in tests.

    Not registered: its rows are approximate, so no SQL can be its oracle, and every registered query has one.
    """
    vectors = stored(fx.read(spark, sf, "embeddings").select("vec_id", "embedding"))
    corpus = vectors.select(F.col("vec_id").alias("id"), "embedding")
    # half the square root of the rows in lists; these vectors are near uniform in 64 dimensions, so recall 0.9
    # needs seven lists in ten probed (README)
    lists = max(1, round(corpus.count() ** 0.5 / 2))
    centroids = vector_index.fit(corpus, lists)
    probes = -(-7 * lists // 10)
    return vector_index.top_k(vectors.select(F.col("vec_id").alias("qid"), "embedding"), corpus, centroids, probes=probes, exclude_same=True)


@register(
    "retrieval_scores",
    TOPK_SQL + """,
    hit AS (SELECT qid, max((d.label = q.label)::INT) AS own, max((d.label = (q.label + 1) % 10)::INT) AS nxt
            FROM topk JOIN v q ON q.vec_id = qid JOIN v d ON d.vec_id = id GROUP BY qid),
    t AS (SELECT count(*) AS n, sum(own + nxt) AS m, count(*) FILTER (own + nxt > 0) AS h FROM hit)
    SELECT n AS total_queries, round(h / n, 6) AS hit_rate_at_k, round(m / (n * 3), 6) AS precision, round(m / (n * 2), 6) AS recall,
      round(2 * (m / (n * 3)) * (m / (n * 2)) / (m / (n * 3) + m / (n * 2)), 6) AS f1_score FROM t""",
)
def retrieval_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector asks for documents of its own label and of the next one; a document is named after its label."""
    labels = fx.read(spark, sf, "embeddings").select("vec_id", "label")
    found = _nearest(spark, sf).join(labels.withColumnRenamed("vec_id", "id"), "id").select(
        "qid", "rank", F.concat(F.lit("RFC"), F.lpad(F.col("label").cast("string"), 4, "0"), F.lit("_clean.txt")).alias("source"),
        F.lit("").alias("content"),
    )
    name = lambda label: F.concat(F.lit("RFC"), F.lpad(label.cast("string"), 4, "0"), F.lit("-1"))
    expected = labels.select(
        F.col("vec_id").alias("qid"), F.array(name(F.col("label")), name((F.col("label") + 1) % 10)).alias("expected_docs")
    )
    scores = evaluate.retrieval_scores(evaluate.retrieval_matches(found, expected))
    return scores.select("total_queries", *[F.round(c, 6).alias(c) for c in ("hit_rate_at_k", "precision", "recall", "f1_score")])


DIMS = 1024

_SLOT = f"(('0x' || substr(md5(t), 1, 7))::BIGINT % {DIMS})"

SEARCH_SQL = (
    fx.cte("fx_docs").replace("WITH ", "WITH RECURSIVE ", 1) + "," + CLEAN_SQL + "," + CHUNK_SQL
    + CHUNK_FOLD_SQL.replace(" SELECT doc_id, replace(source", ", chunks AS (SELECT doc_id, replace(source", 1).replace("WHERE text <> ''", "WHERE text <> ''),")
    + f"""
 texts2 AS (
   SELECT 0 AS side, concat(source, '#', lpad(chunk_no::VARCHAR, 9, '0')) AS id, text FROM chunks
   UNION ALL SELECT 1, concat(conv_id, '/', turn), text FROM conversations WHERE role = 'user'),
 words AS (SELECT side, id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM texts2),
 tf AS (SELECT side, id, {_SLOT} AS slot, count(*) AS n FROM words WHERE t <> '' GROUP BY ALL),
 idf AS (SELECT slot, ln(((SELECT count(*) FROM chunks) + 1) / (count(*) + 1)) AS w FROM tf WHERE side = 0 GROUP BY slot),
 raw AS (SELECT side, id, slot, n * coalesce(w, ln((SELECT count(*) FROM chunks) + 1.0)) AS v FROM tf LEFT JOIN idf USING (slot)),
 units AS (SELECT side, id, slot, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY side, id)), 0) AS v FROM raw),
 dots AS (SELECT q.id AS qid, c.id, sum(q.v * c.v) AS s FROM units q JOIN units c ON q.side = 1 AND c.side = 0 AND q.slot = c.slot GROUP BY ALL),
 every AS (SELECT q.id AS qid, c.id, round(coalesce(s, 0), 6) AS score FROM (SELECT id FROM texts2 WHERE side = 1) q CROSS JOIN (SELECT id FROM texts2 WHERE side = 0) c LEFT JOIN dots ON dots.qid = q.id AND dots.id = c.id),
 best AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM every QUALIFY rank <= 3),
 shaped AS (
   SELECT qid, rank, text AS content, score, c.source AS filename,
     CASE WHEN c.source LIKE 'rfc%\\_clean.txt' ESCAPE '\\' THEN concat('RFC ', replace(replace(c.source, 'rfc', ''), '_clean.txt', '')) ELSE 'Unknown RFC' END AS source
   FROM best JOIN (SELECT *, concat(source, '#', lpad(chunk_no::VARCHAR, 9, '0')) AS id FROM chunks) c USING (id))"""
)


@register("chunk_search", SEARCH_SQL + " SELECT qid, rank, content, source, filename, score FROM shaped WHERE rank <= 2")
def chunk_search(spark: SparkSession, sf: str) -> DataFrame:
    """Top chunks of the cleaned documents for every user turn, by hashed TF-IDF: two of the best three."""
    return _found(spark, sf, 2)


def _found(spark: SparkSession, sf: str, max_docs: int | None = None) -> DataFrame:
    numbered = F.concat("source", F.lit("#"), F.lpad(F.col("chunk_no").cast("string"), 9, "0"))
    chunks = stored(chunk_documents(spark, sf).withColumn("id", numbered).withColumn("embedding", documents.packed_slots("text", DIMS)))
    weights = documents.fit_packed(chunks, dims=DIMS)
    turns = fx.read(spark, sf, "conversations").where("role = 'user'").select(
        F.concat("conv_id", F.lit("/"), "turn").alias("qid"), "text"
    )
    turns = stored(turns.select("qid", documents.packed_slots("text", DIMS).alias("embedding")))
    # every pair is bounded; term_index's bounds are too loose on these chunks to keep its candidate pairs small
    found = term_search.top_k(turns, chunks, weights)
    return retrieval.shaped_documents(found, chunks, max_docs)
