"""From questions to the text context of an answer: routes, validation, analysis, documents, history.

The text of a question is bounded by its own entities and its top documents.  The history of a prefix is not, and many
questions may ask about one prefix, so it is rendered once per update, as rows, and a question names the prefix whose
history belongs to it instead of carrying a copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import covering, discrepancy, entities, registry

# The headers and labels of the text, here and below.
NOTHING = "No context data available."


def entity_lines() -> Column:
    """Query types and entity lists as lines; empty lists give no line."""

    def line(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, ", ")))

    return F.concat_ws(
        "\n",
        line("Query Types: ", F.col("query_types")),
        line("IP Addresses: ", F.col("ip_addresses")),
        line("Prefixes: ", F.col("prefixes")),
        line("AS Numbers: ", F.transform("asns", lambda a: F.concat(F.lit("AS"), a))),
        line("Time References: ", F.col("time_references")),
    )


def question_routes(classified: DataFrame, state: DataFrame) -> DataFrame:
    """Routes of the entities of live questions: ``qid, kind, pos, asked, matching_prefix, origin_as, as_path``.

    Prefixes (kind 0) are looked up exactly, addresses (kind 1) by longest match; each distinct text once.
    """
    live = classified.where(F.array_contains("query_types", "live"))
    prefixes = live.select("qid", F.posexplode("prefixes").alias("pos", "asked"))
    addresses = live.select("qid", F.posexplode("ip_addresses").alias("pos", "asked"))
    exact = covering.exact_lookup(prefixes.select("asked").distinct(), state, "asked")
    best = covering.longest_match(addresses.select("asked").distinct(), state, "asked", how="inner")
    columns = ["qid", "kind", "pos", "asked", "matching_prefix", "origin_as", "as_path"]
    return (
        prefixes.join(exact, "asked").withColumn("kind", F.lit(0)).select(columns)
        .unionByName(addresses.join(best, "asked").withColumn("kind", F.lit(1)).select(columns))
    )


def first_routes(routes: DataFrame) -> DataFrame:
    """The first route of each question, prefixes before addresses; none when its origin is missing."""
    first = routes.groupBy("qid").agg(
        F.min_by(F.struct("kind", "asked", "matching_prefix", "origin_as"), F.struct("kind", "pos")).alias("r")
    )
    prefix = F.when(F.col("r.kind") == 0, F.col("r.asked")).otherwise(F.col("r.matching_prefix"))
    return first.select("qid", prefix.alias("prefix"), F.col("r.origin_as").alias("origin_as")).where("origin_as <> 0")


def history_prefix(classified: DataFrame) -> DataFrame:
    """The prefix whose update history belongs to a question: the first one named, of historical questions."""
    asked = F.when(F.array_contains("query_types", "historical"), F.try_element_at("prefixes", F.lit(1)))
    return classified.select("qid", asked.alias("history_prefix"))


def validated_questions(
    classified: DataFrame, routes: DataFrame, roas: DataFrame, irr: DataFrame, flaps: DataFrame
) -> DataFrame:
    """RPKI, IRR and discrepancy results of each question that found a route.

    Each distinct route with its history is scored once, however many questions ask about it.
    """
    asked = first_routes(routes).join(history_prefix(classified), "qid").withColumn("_h", F.coalesce("history_prefix", F.lit("-")))
    key = ["prefix", "origin_as", "_h"]
    scored = discrepancy.analyze_routes(asked.select(*key, "history_prefix").distinct(), roas, irr, flaps)
    origins = registry.irr_origins(irr).withColumnRenamed("status", "irr_status")
    none = F.array().cast("array<string>")
    results = scored.join(origins, "prefix", "left").withColumns(
        {
            "irr_status": F.coalesce("irr_status", F.lit("not-found")),
            "irr_origins": F.coalesce("irr_origins", none),
            "authorities": F.coalesce("authorities", none),
        }
    )
    return asked.select("qid", *key).join(results, key).drop("_h")


# -- text -----------------------------------------------------------------------------------------------------


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *parts)


def _text(value: str) -> Column:
    return F.col(value).cast("string")


def _joined_items(rows: DataFrame, header: str, order: Column, item: Column, out: str) -> DataFrame:
    """Items of a question under a header; their number is bounded by the question itself."""
    items = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("t")))).alias("i"))
    body = F.array_join(F.transform("i", lambda x: x["t"]), "\n")
    return items.select("qid", _lines(F.lit(header), body).alias(out))


def document_section(found: DataFrame) -> DataFrame:
    item = _lines(
        F.concat(F.lit("Source: "), F.coalesce("source", F.lit("Unknown RFC"))),
        F.concat(F.lit("Content: "), F.coalesce("content", F.lit(""))),
        F.lit(""),
    )
    return _joined_items(found, "=== RFC DOCUMENTATION ===", F.col("rank"), item, "documents_text")


def path_list(path: str) -> Column:
    return F.concat(F.lit("["), F.array_join(path, ", "), F.lit("]"))


def route_section(routes: DataFrame) -> DataFrame:
    head = F.when(F.col("kind") == 0, F.concat(F.lit("Exact Match for Prefix: "), "asked")).otherwise(
        F.concat(F.lit("Longest Prefix Match for IP: "), "asked", F.lit("\nMatching Prefix: "), "matching_prefix")
    )
    item = _lines(
        head,
        F.concat(F.lit("Origin AS: "), F.coalesce(_text("origin_as"), F.lit("Unknown"))),
        F.concat(F.lit("AS Path: "), F.coalesce(path_list("as_path"), F.lit("Unknown"))),
        F.lit(""),
    )
    return _joined_items(routes, "=== CURRENT BGP STATE ===", F.struct("kind", "pos"), item, "routes_text")


def validation_text() -> Column:
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    return _lines(
        F.lit("=== RPKI & IRR VALIDATION ==="),
        F.concat(F.lit("RPKI Status: "), "rpki_status"),
        F.concat(F.lit("Prefix: "), "prefix"),
        F.concat(F.lit("Origin AS: "), _text("origin_as")),
        F.when(F.col("covering_roas") > 0, F.concat(F.lit("Covering ROAs: "), _text("covering_roas"), F.lit(" found"))),
        F.concat(F.lit("IRR Status: "), "irr_status"),
        listed("IRR Origins: ", F.col("irr_origins")),
        listed("IRR Authorities: ", F.col("authorities")),
        F.lit(""),
    )


def analysis_text() -> Column:
    detected = F.col("flap_detected")
    return _lines(
        F.lit("=== HEURISTIC ANALYSIS ==="),
        F.concat(F.lit("Severity: "), "severity"),
        F.when(F.size("flags") > 0, F.concat(F.lit("Flags: "), F.array_join("flags", ", "))),
        F.when(
            F.size("recommendations") > 0,
            _lines(F.lit("Recommendations:"), F.array_join(F.transform("recommendations", lambda r: F.concat(F.lit("- "), r)), "\n")),
        ),
        F.when(detected.isNotNull(), F.concat(F.lit("Route Flapping Detected: "), F.when(detected, "True").otherwise("False"))),
        F.when(detected, F.concat(F.lit("Transition Count: "), _text("transition_count"))),
        F.when(detected, F.concat(F.lit("Pattern: "), "pattern_analysis")),
        F.lit(""),
    )


def context_report(
    classified: DataFrame, routes: DataFrame, validated: DataFrame, documents: DataFrame | None = None
) -> DataFrame:
    """``qid, entities, context, history_prefix``: the context without the history, which is ``history_entries``."""
    checked = validated.select("qid", _lines(validation_text(), analysis_text()).alias("checked_text"))
    rows = (
        classified.select("qid", entity_lines().alias("entities"))
        .join(history_prefix(classified), "qid")
        .join(route_section(routes), "qid", "left")
        .join(checked, "qid", "left")
    )
    parts = ["routes_text", "checked_text"]
    if documents is not None:
        static = classified.where(F.array_contains("query_types", "static")).select("qid")
        rows = rows.join(document_section(documents).join(static, "qid", "left_semi"), "qid", "left")
        parts.insert(0, "documents_text")
    text = F.nullif(F.concat_ws("\n", *parts), F.lit(""))
    return rows.select("qid", "entities", F.coalesce(text, F.lit(NOTHING)).alias("context"), "history_prefix")


# The sections of a context in their order.
SECTIONS = ["documents", "live", "history", "validation", "analysis"]
HISTORY_HEADER = "=== HISTORICAL BGP UPDATES ==="


def context_sections(
    classified: DataFrame, routes: DataFrame, validated: DataFrame, documents: DataFrame, updates: DataFrame, time: str = "ts"
) -> DataFrame:
    """The whole context as rows ``qid, prefix, section, pos, text``: joined by line feeds in order they are the text.

    Documents, live routes, validation and analysis belong to a question, of which they are one row each.  The history
    belongs to the prefix that ``history_prefix`` gives for a question, and is one row per update, newest first by
    ``pos``, after a header at the least ``pos``; so it may have any length.  Documents go to static questions only.
    """
    static = classified.where(F.array_contains("query_types", "static")).select("qid")
    shown = document_section(documents.join(static, "qid", "left_semi"))
    none = F.lit(None).cast("string").alias("prefix")
    zero = F.lit(0).cast("bigint").alias("pos")

    def of_question(rows: DataFrame, section: str, text: Column) -> DataFrame:
        return rows.select("qid", none, F.lit(section).alias("section"), zero, text.alias("text"))

    asked = history_prefix(classified).where("history_prefix IS NOT NULL").select(F.col("history_prefix").alias("prefix")).distinct()
    entries = history_entries(updates.join(asked, "prefix", "left_semi"), time)
    headers = entries.select("prefix").distinct()
    place = -F.unix_micros(F.col(time).cast("timestamp"))
    first = F.lit(-(2**63)).cast("bigint")
    qid = F.lit(None).cast(classified.schema["qid"].dataType).alias("qid")
    history = F.lit("history").alias("section")
    return (
        of_question(shown, "documents", F.col("documents_text"))
        .unionByName(of_question(route_section(routes), "live", F.col("routes_text")))
        .unionByName(of_question(validated, "validation", validation_text()))
        .unionByName(of_question(validated, "analysis", analysis_text()))
        .unionByName(headers.select(qid, "prefix", history, first.alias("pos"), F.lit(HISTORY_HEADER).alias("text")))
        .unionByName(entries.select(qid, "prefix", history, place.alias("pos"), "text"))
    )


def _or_none(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("None"))


def history_entries(updates: DataFrame, time: str = "ts") -> DataFrame:
    """The history section of each prefix, one row per update: ``prefix, <time>, seq, text``.

    The texts of a prefix in descending order of ``(time, seq)`` are its whole history.  They stay rows, since a prefix
    may have any number of updates; nothing is shuffled.
    """
    whole = F.date_format(time, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(time, "SSSSSS")
    stamp = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    text = _lines(
        F.concat(F.lit("Timestamp: "), stamp),
        F.concat(F.lit("Type: "), "update_type", F.lit(" (A=Announcement, W=Withdrawal)")),
        F.concat(F.lit("Prefix: "), "prefix"),
        F.concat(F.lit("Origin AS: "), _or_none("origin_as")),
        F.concat(F.lit("AS Path: "), _or_none("as_path")),
        F.lit(""),
    )
    return updates.select("prefix", time, "seq", text.alias("text"))


def answer_context(
    questions: DataFrame,
    state: DataFrame,
    roas: DataFrame,
    irr: DataFrame,
    flaps: DataFrame,
    documents: DataFrame | None = None,
    text: str = "question",
) -> DataFrame:
    """Questions ``qid, question`` to their context: extract, classify, look up, validate, analyze, render.

    ``state`` is read three times and should be a stored table.
    """
    classified = stored(entities.classify(entities.extract_entities(questions, text), text))
    routes = stored(question_routes(classified, state))
    validated = validated_questions(classified, routes, roas, irr, flaps)
    return context_report(classified, routes, validated, documents)
