"""Metrics: entity extraction, document retrieval, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entities import normalized_entity


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def extraction_scores(extracted: DataFrame, truth: DataFrame, key: str = "qid") -> DataFrame:
    """Precision, recall and F1 per question and entity type.

    Both sides are rows ``key, entity_type, value``.  A truth row with a NULL value says the type is labelled and empty.
    The two sides are united and counted per value, so no join is needed and counting starts on the map side.
    """
    form = normalized_entity(F.col("entity_type"), F.col("value")).alias("v")
    sides = extracted.select(key, "entity_type", form, F.lit(1).alias("e"), F.lit(0).alias("t"), F.lit(0).alias("labelled")).unionByName(
        truth.select(key, "entity_type", form, F.lit(0).alias("e"), F.lit(1).alias("t"), F.lit(1).alias("labelled"))
    )
    values = sides.groupBy(key, "entity_type", "v").agg(
        F.max("e").alias("e"), F.max("t").alias("t"), F.max("labelled").alias("labelled")
    )
    real = F.col("v").isNotNull()
    cases = values.groupBy(key, "entity_type").agg(
        F.count_if(real & (F.col("e") == 1)).alias("n_extracted"),
        F.count_if(real & (F.col("t") == 1)).alias("n_truth"),
        F.count_if(real & (F.col("e") == 1) & (F.col("t") == 1)).alias("n_both"),
        F.max("labelled").alias("_labelled"),
    )
    e, t, both = F.col("n_extracted"), F.col("n_truth"), F.col("n_both")
    p, r = both / F.nullif(e, F.lit(0)), both / F.nullif(t, F.lit(0))
    precision = F.when(e == 0, 1.0).when(t == 0, 0.0).otherwise(p)
    recall = F.when(t == 0, 1.0).when(e == 0, 0.0).otherwise(r)
    f1 = F.when((t == 0) & (e == 0), 1.0).when((t == 0) | (e == 0), 0.0).otherwise(_harmonic(p, r))
    return cases.where("_labelled = 1").select(
        key, "entity_type", "n_extracted", "n_truth", "n_both",
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    )


def mean_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """Macro means of the scores per extractor and entity type; of ``seconds``, the time taken, too if it is there."""
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "f1", "seconds") if c in scores.columns]
    return scores.groupBy(*by).agg(F.count("*").alias("cases"), *means)


def retrieval_matches(retrieved: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """Per question and expected document number, whether one of its top ``k`` results names it.

    ``retrieved``: ``qid, rank, source, content``; ``expected``: ``qid, expected_docs`` such as ``RFC4271-9``.
    """
    number = lambda d: F.replace(F.split(d, "-")[0], F.lit("RFC"), F.lit(""))
    wanted = expected.select(
        "qid", F.explode_outer(F.array_distinct(F.transform("expected_docs", number))).alias("number")
    )
    # ``rfc<n>`` is part of ``rfc<n>_``, so three spellings are enough.
    named = lambda text: (
        F.contains(text, F.concat(F.lit("rfc "), "number"))
        | F.contains(text, F.concat(F.lit("rfc"), "number"))
        | F.contains(text, F.concat(F.lit("rfc_"), "number"))
    )
    top = retrieved.where(F.col("rank") <= k).select("qid", F.lower("source").alias("source"), F.lower("content").alias("content"))
    hit = F.coalesce(named(F.col("content")) | named(F.col("source")), F.lit(False))
    return wanted.join(top, "qid", "left").groupBy("qid", "number").agg(F.max(hit).alias("matched"))


def retrieval_scores(matches: DataFrame, k: int = 3) -> DataFrame:
    """Hit rate at ``k``, precision, recall and F1 over all questions."""
    per_question = matches.groupBy("qid").agg(
        F.count("number").alias("expected"), F.count_if("matched").alias("matched")
    )
    totals = per_question.agg(
        F.count("*").alias("total_queries"),
        F.coalesce(F.sum("expected"), F.lit(0)).alias("e"),
        F.coalesce(F.sum("matched"), F.lit(0)).alias("m"),
        F.count_if(F.col("matched") > 0).alias("hits"),
    )
    n, m = F.col("total_queries"), F.col("m")
    p, r = _ratio(m, n * k), _ratio(m, F.col("e"))
    return totals.select(
        "total_queries", (F.col("hits") / F.nullif(n, F.lit(0))).alias("hit_rate_at_k"), p.alias("precision"),
        r.alias("recall"), _harmonic(p, r).alias("f1_score"),
    )


def timing_stats(timings: DataFrame, total: str = "total_pipeline") -> DataFrame:
    """Mean, sample deviation, extremes and share of the total's mean per component of ``component, seconds``."""
    stats = timings.groupBy("component").agg(
        F.avg("seconds").alias("mean"),
        F.coalesce(F.stddev_samp("seconds"), F.lit(0.0)).alias("std_dev"),
        F.min("seconds").alias("min"),
        F.max("seconds").alias("max"),
    )
    whole = timings.where(F.col("component") == total).agg(F.avg("seconds")).scalar()
    return stats.withColumn(
        "percentage", F.when(F.col("component") == total, 100.0).otherwise(F.col("mean") / whole * 100)
    )
