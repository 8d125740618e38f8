"""Registry tables: RPKI authorizations as a registry answers them, and IRR route objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import IRR_ANSWER, ROA_ANSWER


def roa_rows(answers: DataFrame) -> DataFrame:
    """Answers ``prefix, answer`` (JSON text) to one row per authorization; ``pos`` keeps the order of the list."""
    parsed = answers.select("prefix", F.from_json("answer", ROA_ANSWER).alias("a"))
    return parsed.select("prefix", F.posexplode("a.data.validating_roas").alias("pos", "roa")).select(
        "prefix", F.col("pos").cast("bigint").alias("pos"), F.col("roa.prefix").alias("roa_prefix"),
        "roa.max_length", "roa.origin", "roa.validity",
    )


def irr_items(answers: DataFrame) -> DataFrame:
    """Answers ``prefix, answer`` (JSON text) to one row per ``key, value`` item of either record list.

    A list without items gives a row without key and value, so that no asked prefix is lost; NULL records are passed
    over.  An answer that is no JSON gives a row of section ``error``.
    """
    unreadable = F.try_parse_json("answer").isNull()
    parsed = answers.select("prefix", F.from_json("answer", IRR_ANSWER).alias("a"), unreadable.alias("_bad"))

    def items(section: str) -> DataFrame:
        records = F.flatten(F.filter(f"a.data.{section}", lambda r: r.isNotNull()))
        return parsed.where("NOT _bad").select("prefix", F.posexplode_outer(records).alias("pos", "item")).select(
            "prefix", F.lit(section).alias("section"), F.col("pos").cast("bigint").alias("pos"), "item.key", "item.value"
        )

    none = F.lit(None).cast("string")
    errors = parsed.where("_bad").select(
        "prefix", F.lit("error").alias("section"), F.lit(None).cast("bigint").alias("pos"), none.alias("key"), none.alias("value")
    )
    return items("irr_records").unionByName(items("records")).unionByName(errors)


def with_roa_status(rows: DataFrame, roas: DataFrame) -> DataFrame:
    """Add ``rpki_status, covering_roas`` to rows with ``prefix, origin_as``, from the authorizations of the prefix.

    Authorizations of the asked origin decide, the last one with a verdict winning; failing that, a valid one of
    another origin makes it invalid.  They are combined per (prefix, origin) and per prefix before the join, so each
    row meets at most one of either and no pairs arise.
    """
    verdicts = roas.select(
        "prefix",
        paths.roa_asn("origin").alias("_origin"),
        F.when(F.col("validity") == "valid", F.col("pos")).alias("_valid"),
        F.when(F.col("validity").isin("invalid", "invalid_asn", "invalid_length"), F.col("pos")).alias("_invalid"),
    )
    own = verdicts.groupBy("prefix", "_origin").agg(
        F.max("_valid").alias("_last_valid"), F.max("_invalid").alias("_last_invalid"), F.count("_valid").alias("_own_valid")
    )
    every = verdicts.groupBy("prefix").agg(F.count("*").alias("_n"), F.count("_valid").alias("_n_valid"))
    joined = (
        rows.withColumn("_origin", paths.asked_asn("origin_as"))
        .join(own, ["prefix", "_origin"], "left")
        .join(every, "prefix", "left")
    )
    never = F.lit(-(2**63)).cast("bigint")
    valid, invalid = F.coalesce("_last_valid", never), F.coalesce("_last_invalid", never)
    others = F.coalesce("_n_valid", F.lit(0)) - F.coalesce("_own_valid", F.lit(0))
    status = (
        F.when(valid > invalid, "valid").when(invalid > valid, "invalid").when(others > 0, "invalid").otherwise("not-found")
    )
    return joined.select(*rows.columns, status.alias("rpki_status"), F.coalesce("_n", F.lit(0)).alias("covering_roas"))


def roa_status(asked: DataFrame, roas: DataFrame) -> DataFrame:
    """RPKI status of each distinct ``(prefix, origin_as)``."""
    return with_roa_status(asked.select("prefix", "origin_as").distinct(), roas)


def _clean_items(items: DataFrame) -> DataFrame:
    """Distinct usable origins and sources per prefix and section, with their first position."""
    origin_key = F.when(F.col("section") == "irr_records", F.col("key") == "origin").otherwise(
        F.col("key").isin("OriginAS", "origin")
    )
    kind = F.when(origin_key, "origin").when(F.col("key") == "source", "source")
    cleaned = items.select(
        "prefix",
        "section",
        kind.alias("kind"),
        F.when(origin_key, paths.registry_asn("value")).otherwise(F.nullif(F.trim("value"), F.lit(""))).alias("v"),
        "pos",
    ).where("kind IS NOT NULL AND v IS NOT NULL")
    return cleaned.groupBy("prefix", "section", "kind", "v").agg(F.min("pos").alias("pos"))


def irr_origins(items: DataFrame) -> DataFrame:
    """Origins and authorities per prefix, distinct, in the order first seen.

    Origins come from ``irr_records``; when these name none, from ``records``, and authorities then from both.  The lists
    hold distinct values only, combined before they are collected.  A prefix without items has status ``not-found`` and
    empty lists; one whose answer could not be read, status ``error``.
    """
    found = F.struct(F.when(F.col("section") == "irr_records", 0).otherwise(1).alias("s"), "pos", "v")
    lists = (
        _clean_items(items)
        .groupBy("prefix")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("kind") == "origin", found))).alias("o"),
            F.sort_array(F.collect_list(F.when(F.col("kind") == "source", found))).alias("a"),
        )
    )
    primary = F.exists("o", lambda x: x["s"] == 0)
    values = lambda c: F.array_distinct(
        F.transform(F.filter(c, lambda x: (x["s"] == 0) | ~F.col("_primary")), lambda x: x["v"])
    )
    return (
        items.groupBy("prefix")
        .agg(F.max(F.col("section") == "error").alias("_error"))
        .join(lists, "prefix", "left")
        .withColumn("_primary", F.coalesce(primary, F.lit(False)))
        .select(
            "prefix",
            F.coalesce(values("o"), F.array().cast("array<string>")).alias("irr_origins"),
            F.coalesce(values("a"), F.array().cast("array<string>")).alias("authorities"),
            "_error",
        )
        .withColumn("status", F.when(F.size("irr_origins") > 0, "success").when(F.col("_error"), "error").otherwise("not-found"))
        .drop("_error")
    )


def with_irr_match(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``irr_origin_count, irr_mismatch`` to rows with ``prefix, origin_as``: how many origins the registry names for
    the prefix, and whether they exclude this one.

    The membership test is a join on (prefix, origin), never a search through a list per prefix.
    """
    registered = (
        _clean_items(items)
        .where("kind = 'origin'")
        .groupBy("prefix", F.col("v").alias("_v"))
        .agg(
            F.max(F.col("section") == "irr_records").alias("_primary"), F.max(F.col("section") == "records").alias("_fallback")
        )
    )
    per_prefix = registered.groupBy("prefix").agg(
        F.count_if("_primary").alias("_n_primary"), F.count_if("_fallback").alias("_n_fallback")
    )
    joined = (
        rows.withColumn("_v", paths.registry_asn("origin_as"))
        .join(registered, ["prefix", "_v"], "left")
        .join(per_prefix, "prefix", "left")
    )
    use_fallback = F.coalesce("_n_primary", F.lit(0)) == 0
    listed: Column = F.when(use_fallback, F.col("_fallback")).otherwise(F.col("_primary"))
    count = F.coalesce(F.when(use_fallback, F.col("_n_fallback")).otherwise(F.col("_n_primary")), F.lit(0))
    mismatch = (count > 0) & F.col("_v").isNotNull() & ~F.coalesce(listed, F.lit(False))
    return joined.select(*rows.columns, count.alias("irr_origin_count"), mismatch.alias("irr_mismatch"))
