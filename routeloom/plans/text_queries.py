"""Queries over question text and extraction metrics, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, evaluate
from ..schemas import ENTITY_TYPES
from . import fixtures as fx
from .registry import register


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _in_text(words: list[str], text: str) -> str:
    return f"list_sort(list_filter({_list(words)}, lambda w: contains(lower({text}), w)))"


def entities_sql(source: str, text: str, key: str) -> str:
    """CTE ``ents`` of the five entity lists."""
    return f"""
 ents0 AS (SELECT {key}, {text} AS question, list_sort(list_distinct(regexp_extract_all({text}, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}/\\d{{1,2}}\\b'))) AS prefixes,
     list_distinct(regexp_extract_all({text}, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')) AS ips,
     list_sort(list_distinct(regexp_extract_all({text}, '(?i)\\bAS\\s*(\\d+)\\b', 1))) AS asns,
     {_in_text(entities.KEYWORDS, text)} AS keywords, {_in_text(entities.TIME_WORDS, text)} AS time_references FROM {source}),
 ents AS (SELECT *, list_sort(list_filter(ips, lambda i: NOT list_contains(list_transform(prefixes, lambda p: split_part(p, '/', 1)), i))) AS ip_addresses FROM ents0)"""


LISTS_SQL = ", ".join(f"array_to_string({t}, ',') AS {t}" for t in ENTITY_TYPES)

CLASSIFY_SQL = f"""
 typed AS (SELECT *, array_to_string([x FOR x IN [
     CASE WHEN len(list_filter({_list(entities.STATIC_PHRASES)}, lambda w: contains(lower(question), w))) > 0 THEN 'static' END,
     CASE WHEN len(prefixes) + len(ip_addresses) + len(asns) > 0 THEN 'live' END,
     CASE WHEN contains(lower(question), 'rpki') OR contains(lower(question), 'roa') OR contains(lower(question), 'valid') THEN 'rpki' END,
     CASE WHEN contains(lower(question), 'histor') AND (contains(lower(question), 'history') OR contains(lower(question), 'historical')) OR len(time_references) > 0 THEN 'historical' END
   ] IF x IS NOT NULL], ',') AS t FROM ents),
 classified AS (SELECT * EXCLUDE (t), CASE WHEN t = '' THEN 'static' ELSE t END AS query_types FROM typed)"""


def joined_lists(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.array_join(t, ",").alias(t) for t in ENTITY_TYPES])


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return entities.extract_entities(fx.load(spark, sf, "fx_questions"))


@register(
    "extract_entities",
    fx.cte("fx_questions") + "," + entities_sql("fx_questions", "question", "qid") + f" SELECT qid, {LISTS_SQL} FROM ents",
)
def extract_entities(spark: SparkSession, sf: str) -> DataFrame:
    return joined_lists(questions(spark, sf), "qid")


@register(
    "extract_entities_documents",
    "WITH " + entities_sql("documents", "text", "doc_id") + f" SELECT doc_id, {LISTS_SQL} FROM ents",
)
def extract_entities_documents(spark: SparkSession, sf: str) -> DataFrame:
    return joined_lists(entities.extract_entities(fx.read(spark, sf, "documents"), "text"), "doc_id")


@register(
    "classify_questions",
    fx.cte("fx_questions") + "," + entities_sql("fx_questions", "question", "qid") + "," + CLASSIFY_SQL
    + " SELECT qid, query_types FROM classified",
)
def classify_questions(spark: SparkSession, sf: str) -> DataFrame:
    return entities.classify(questions(spark, sf)).select("qid", F.array_join("query_types", ",").alias("query_types"))


@register(
    "classify_conversations",
    "WITH turns AS (SELECT concat(conv_id, '/', turn) AS qid, text FROM conversations)," + entities_sql("turns", "text", "qid")
    + "," + CLASSIFY_SQL + " SELECT qid, query_types FROM classified",
)
def classify_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = fx.read(spark, sf, "conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("qid"), "text")
    typed = entities.classify(entities.extract_entities(turns, "text"), "text")
    return typed.select("qid", F.array_join("query_types", ",").alias("query_types"))


# The second extractor of the tests: what the labels say, asns without "AS", and no keyword list at all.
MODEL_SQL = """
 model AS (SELECT qid, list_sort(list(DISTINCT replace(value, 'AS', '')) FILTER (entity_type = 'asns' AND value IS NOT NULL)) AS asns,
    list_sort(list(DISTINCT value) FILTER (entity_type = 'prefixes' AND value IS NOT NULL)) AS prefixes,
    list_sort(list(DISTINCT trim(value)) FILTER (entity_type = 'ip_addresses' AND value IS NOT NULL)) AS ip_addresses FROM fx_truth GROUP BY qid)"""


def model_extraction(spark: SparkSession, sf: str) -> DataFrame:
    truth = fx.load(spark, sf, "fx_truth")
    kind = F.col("entity_type")
    value = (
        F.when(kind == "asns", F.replace("value", F.lit("AS"), F.lit("")))
        .when(kind == "prefixes", F.col("value"))
        .when(kind == "ip_addresses", F.trim("value"))
    )
    # a question's rows are few and of different tasks: they are brought together once, without combining them before
    rows = truth.select("qid", F.when(value.isNotNull(), F.struct("entity_type", value.alias("value"))).alias("entity"))
    found = rows.repartition("qid").groupBy("qid").agg(F.collect_set("entity").alias("found"))
    of = lambda t: F.transform(F.filter("found", lambda e: e["entity_type"] == t), lambda e: e["value"]).alias(t)
    return found.select("qid", of("asns"), of("prefixes"), of("ip_addresses"))


@register(
    "merge_extractions",
    fx.cte("fx_questions", "fx_truth") + "," + entities_sql("fx_questions", "question", "qid") + "," + MODEL_SQL + """
    SELECT qid,
      array_to_string(list_sort(list_distinct(list_concat(e.ip_addresses, coalesce(m.ip_addresses, [])))), ',') AS ip_addresses,
      array_to_string(list_sort(list_distinct(list_concat(e.prefixes, coalesce(m.prefixes, [])))), ',') AS prefixes,
      array_to_string(list_sort(list_distinct(list_concat(e.asns, coalesce(m.asns, [])))), ',') AS asns,
      array_to_string(keywords, ',') AS keywords, array_to_string(time_references, ',') AS time_references
    FROM ents e LEFT JOIN model m USING (qid)""",
)
def merge_extractions(spark: SparkSession, sf: str) -> DataFrame:
    merged = entities.merge_extractions(questions(spark, sf), model_extraction(spark, sf), strategy="merge_results")
    return joined_lists(merged, "qid")


@register(
    "merge_llm_primary",
    fx.cte("fx_questions", "fx_truth") + "," + entities_sql("fx_questions", "question", "qid") + "," + MODEL_SQL + """
    SELECT qid, array_to_string(CASE WHEN m.qid IS NOT NULL AND qid % 3 <> 0 THEN m.asns ELSE e.asns END, ',') AS asns,
      array_to_string(CASE WHEN m.qid IS NOT NULL AND qid % 3 <> 0 THEN [] ELSE e.keywords END, ',') AS keywords
    FROM ents e LEFT JOIN model m USING (qid)""",
)
def merge_llm_primary(spark: SparkSession, sf: str) -> DataFrame:
    """The model answers two questions of three; the pattern's lists stand in for the rest."""
    merged = entities.merge_extractions(questions(spark, sf), model_extraction(spark, sf).where("qid % 3 <> 0"))
    return joined_lists(merged, "qid").select("qid", "asns", "keywords")


NORMAL_FORM_SQL = """CASE WHEN value IS NULL OR value = '' THEN NULL ELSE nullif(CASE entity_type
   WHEN 'asns' THEN regexp_replace(value, '[^0-9]', '', 'g')
   WHEN 'prefixes' THEN CASE WHEN NOT contains(value, '/') OR contains(value, ':') THEN value
     ELSE concat(split_part(value, '/', 1), CASE
       WHEN len(string_split(split_part(value, '/', 1), '.')) = 3 AND NOT ends_with(split_part(value, '/', 1), '.0') THEN '.0'
       WHEN len(string_split(split_part(value, '/', 1), '.')) = 2 THEN '.0.0'
       WHEN len(string_split(split_part(value, '/', 1), '.')) = 1 THEN '.0.0.0' ELSE '' END, '/', split_part(value, '/', 2)) END
   WHEN 'time_references' THEN array_to_string(list_transform(regexp_split_to_array(trim(lower(value)), '\\s+'), lambda w: translate(w, 'aeiou', '')), ' ')
   WHEN 'keywords' THEN trim(lower(value)) ELSE trim(value) END, '') END"""

SCORES_SQL = (
    fx.cte("fx_questions", "fx_truth") + "," + entities_sql("fx_questions", "question", "qid") + f""",
 erows AS ({' UNION ALL '.join(f"SELECT qid, '{t}' AS entity_type, unnest({t}) AS value FROM ents" for t in ENTITY_TYPES)}),
 en AS (SELECT DISTINCT qid, entity_type, {NORMAL_FORM_SQL} AS v FROM erows),
 tn AS (SELECT DISTINCT qid, entity_type, {NORMAL_FORM_SQL} AS v FROM fx_truth),
 cases AS (SELECT DISTINCT qid, entity_type FROM fx_truth),
 ec AS (SELECT qid, entity_type, count(v) AS e FROM en GROUP BY ALL), tc AS (SELECT qid, entity_type, count(v) AS t FROM tn GROUP BY ALL),
 bc AS (SELECT en.qid, en.entity_type, count(*) AS b FROM en JOIN tn USING (qid, entity_type, v) GROUP BY ALL),
 cnt AS (SELECT qid, entity_type, coalesce(e, 0) AS e, coalesce(t, 0) AS t, coalesce(b, 0) AS b
   FROM cases LEFT JOIN ec USING (qid, entity_type) LEFT JOIN tc USING (qid, entity_type) LEFT JOIN bc USING (qid, entity_type)),
 pr AS (SELECT *, CASE WHEN e = 0 THEN 1.0::DOUBLE WHEN t = 0 THEN 0 ELSE b / e END AS p, CASE WHEN t = 0 THEN 1.0::DOUBLE WHEN e = 0 THEN 0 ELSE b / t END AS r FROM cnt),
 scores AS (SELECT qid, entity_type, e AS n_extracted, t AS n_truth, b AS n_both, p AS precision, r AS recall,
   CASE WHEN e = 0 AND t = 0 THEN 1.0::DOUBLE WHEN e = 0 OR t = 0 OR p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""
)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.extraction_scores(entities.entity_rows(questions(spark, sf)), fx.load(spark, sf, "fx_truth"))


@register(
    "extraction_case_scores",
    SCORES_SQL + " SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1) FROM scores",
)
def extraction_case_scores(spark: SparkSession, sf: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("precision", "recall", "f1")}
    return _scores(spark, sf).withColumns(rounded)


@register(
    "extraction_scores",
    SCORES_SQL + """ SELECT 'regex' AS extractor, entity_type, count(*) AS cases, round(avg(precision), 6) AS precision,
    round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(qid % 7 / 8), 6) AS seconds FROM scores GROUP BY ALL""",
)
def extraction_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scores(spark, sf).withColumns({"extractor": F.lit("regex"), "seconds": F.col("qid") % 7 / 8})
    rounded = {c: F.round(c, 6) for c in ("precision", "recall", "f1", "seconds")}
    return evaluate.mean_scores(scores, ["extractor", "entity_type"]).withColumns(rounded)


@register(
    "timing_stats",
    """WITH t AS (SELECT event_type AS component, value AS seconds FROM events
      UNION ALL SELECT 'total_pipeline', sum(value) FROM events GROUP BY user_id, date_trunc('day', ts)),
    w AS (SELECT avg(seconds) AS m FROM t WHERE component = 'total_pipeline')
    SELECT component, round(avg(seconds), 6) AS mean, round(coalesce(stddev_samp(seconds), 0), 6) AS std_dev, round(min(seconds), 6) AS min,
      round(max(seconds), 6) AS max, round(CASE WHEN component = 'total_pipeline' THEN 100 ELSE avg(seconds) / (SELECT m FROM w) * 100 END, 6) AS percentage
    FROM t GROUP BY component""",
)
def timing_stats(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.read(spark, sf, "events")
    runs = events.groupBy("user_id", F.date_trunc("day", "ts")).agg(F.sum("value").alias("seconds"))
    timings = events.select(F.col("event_type").alias("component"), F.col("value").alias("seconds")).unionByName(
        runs.select(F.lit("total_pipeline").alias("component"), "seconds")
    )
    stats = evaluate.timing_stats(timings)
    return stats.select("component", *[F.round(c, 6).alias(c) for c in ("mean", "std_dev", "min", "max", "percentage")])
