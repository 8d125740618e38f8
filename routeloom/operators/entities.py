"""Routing entities in question text, and which data a question asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ENTITY_TYPES

# Patterns and word lists.  ``\d`` and ``\b`` are ASCII here; prefix a pattern with ``(?U)`` for Unicode.
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PREFIX_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}/\d{1,2}\b"
ASN_PATTERN = r"(?i)\bAS\s*(\d+)\b"
KEYWORDS = [
    "route", "prefix", "path", "bgp", "origin", "as", "rpki", "roa", "routing", "announce", "valid", "invalid", "peer",
    "hijack",
]
TIME_WORDS = [
    "yesterday", "today", "now", "current", "hour", "minute", "week", "month", "day", "ago", "since", "last", "this",
    "recent",
]
STATIC_PHRASES = [
    "what is", "explain", "definition", "how does", "describe", "route flapping", "flapping", "bgp",
    "border gateway protocol", "routing protocol", "autonomous system", "convergence", "rfc",
]
RPKI_WORDS = ["rpki", "roa", "valid"]
HISTORY_WORDS = ["history", "historical"]


def _as_set(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def _words_in(lowered: Column, words: list[str]) -> Column:
    """The words that occur in the text, also inside longer words."""
    found = [F.when(F.contains(lowered, F.lit(w)), F.lit(w)).otherwise("") for w in sorted(words)]
    return F.array_remove(F.array(*found), "")


def _any_of(lowered: Column, words: list[str]) -> Column:
    # One alternation, searched in a single pass over the text.
    return lowered.rlike("|".join(words))


def extract_entities(questions: DataFrame, text: str = "question") -> DataFrame:
    """Add the five entity lists, each distinct and sorted.

    An address that is also the address of a prefix in the text is left out.
    """
    # most texts hold no slash, and looking for one is cheap
    prefixes = F.when(F.contains(F.col(text), F.lit("/")), F.regexp_extract_all(text, F.lit(PREFIX_PATTERN), 0)).otherwise(
        F.array().cast("array<string>")
    )
    addresses = F.regexp_extract_all(text, F.lit(IP_PATTERN), 0)
    in_prefixes = F.transform(F.col("prefixes"), lambda p: F.substring_index(p, "/", 1))
    lowered = F.col("_lowered")
    return (
        questions.withColumn("_lowered", F.lower(text))
        .withColumn("prefixes", _as_set(prefixes))
        .withColumn("ip_addresses", F.sort_array(F.array_except(addresses, in_prefixes)))
        .withColumn("asns", _as_set(F.regexp_extract_all(text, F.lit(ASN_PATTERN), 1)))
        .withColumn("keywords", _words_in(lowered, KEYWORDS))
        .withColumn("time_references", _words_in(lowered, TIME_WORDS))
        .drop("_lowered")
    )


def classify(extracted: DataFrame, text: str = "question") -> DataFrame:
    """Add ``query_types``: static, live, rpki, historical, in this order; static when nothing else applies."""
    lowered = F.col("_lowered")
    named = (F.size("prefixes") > 0) | (F.size("ip_addresses") > 0) | (F.size("asns") > 0)
    types = F.array_compact(
        F.array(
            F.when(_any_of(lowered, STATIC_PHRASES), "static"),
            F.when(named, "live"),
            F.when(_any_of(lowered, RPKI_WORDS), "rpki"),
            F.when(_any_of(lowered, HISTORY_WORDS) | (F.size("time_references") > 0), "historical"),
        )
    )
    nothing = F.size("query_types") == 0
    return (
        extracted.withColumn("_lowered", F.lower(text))
        .withColumn("query_types", types)
        .withColumn("query_types", F.when(nothing, F.array(F.lit("static"))).otherwise(F.col("query_types")))
        .drop("_lowered")
    )


def complete(extracted: DataFrame) -> DataFrame:
    """Missing entity lists become empty ones."""
    empty = F.array().cast("array<string>")
    have = set(extracted.columns)
    return extracted.withColumns(
        {t: F.coalesce(F.col(t), empty) if t in have else empty for t in ENTITY_TYPES}
    )


def merge_extractions(pattern: DataFrame, model: DataFrame, key: str = "qid", strategy: str = "llm_primary") -> DataFrame:
    """Combine two extraction tables of the same questions.

    ``llm_primary`` takes the model's lists, and the pattern's where the model has none; ``merge_results`` the union per
    list; anything else the pattern's.  A question of either table is a question of the result.
    """
    left, right = complete(pattern).select(key, *ENTITY_TYPES), complete(model).select(key, *ENTITY_TYPES)
    if strategy not in ("llm_primary", "merge_results"):
        return left
    right = right.withColumnsRenamed({t: f"_{t}" for t in ENTITY_TYPES})
    joined = left.join(right, key, "full")
    empty = F.array().cast("array<string>")
    if strategy == "llm_primary":
        return joined.select(key, *[F.coalesce(f"_{t}", t).alias(t) for t in ENTITY_TYPES])
    merged = [_as_set(F.array_union(F.coalesce(t, empty), F.coalesce(f"_{t}", empty))).alias(t) for t in ENTITY_TYPES]
    return joined.select(key, *merged)


def entity_rows(extracted: DataFrame, key: str = "qid") -> DataFrame:
    """Entity lists to rows ``key, entity_type, value``."""

    def tagged(entity_type: str) -> Column:
        tag = F.lit(entity_type).alias("entity_type")
        return F.transform(F.col(entity_type), lambda v: F.struct(tag, v.alias("value")))

    return extracted.select(key, F.inline(F.flatten(F.array(*[tagged(t) for t in ENTITY_TYPES]))))


def normalized_entity(entity_type: Column, value: Column) -> Column:
    """Comparable form of an entity; NULL when nothing is left of it."""
    address = F.substring_index(value, "/", 1)
    parts = F.size(F.split(address, r"\."))
    padding = (
        F.when(F.instr(address, ":") > 0, "")
        .when((parts == 3) & ~F.endswith(address, F.lit(".0")), ".0")
        .when(parts == 2, ".0.0")
        .when(parts == 1, ".0.0.0")
        .otherwise("")
    )
    padded = F.concat(address, padding, F.lit("/"), F.substr(value, F.instr(value, "/") + 1))
    words = F.split(F.trim(F.lower(value)), r"\s+")
    form = (
        F.when(entity_type == "asns", F.regexp_replace(value, "[^0-9]", ""))
        .when(entity_type == "prefixes", F.when(F.instr(value, "/") > 0, padded).otherwise(value))
        .when(entity_type == "time_references", F.array_join(F.transform(words, lambda w: F.translate(w, "aeiou", "")), " "))
        .when(entity_type == "keywords", F.trim(F.lower(value)))
        .otherwise(F.trim(value))
    )
    return F.when(value != "", F.nullif(form, F.lit("")))
