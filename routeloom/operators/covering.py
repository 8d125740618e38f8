"""Which networks cover an address or a route: exact lookup, longest prefix match, origin validation.

Containment is turned into an equi-join: a probe row per prefix length that occurs in the network table, masked to
that length.  The distinct lengths number at most 33 + 129, whatever the data, so they are broadcast.

Short networks cover a large part of all probes (the default route covers every one), so their key would be hot.
They are few (an IPv4 table has at most 8,191 of up to 12 bits), so the network side is copied ``SALTS`` times and the
probes take one copy each.  A longer IPv4 network holds at most 2**19 distinct addresses, which bounds its group; what
is left, a long IPv6 network with a large share of all addresses, the adaptive skew join splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.netaddr import KEY, mask_hi, mask_lo, max_plen, with_address, with_network
from ..storage import stored

SALTS = 64


def _short(family: Column, plen: Column) -> Column:
    return F.when(family == 4, plen <= 12).otherwise(plen <= 32)


def salted_networks(networks: DataFrame, salts: int = SALTS) -> DataFrame:
    copies = F.when(_short(F.col("family"), F.col("plen")), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    return networks.withColumn("salt", F.explode(copies))


def network_probes(
    rows: DataFrame, networks: DataFrame, identity: list[str], salts: int = SALTS, carried: list[str] | None = None
) -> DataFrame:
    """Rows with ``family, hi, lo, max_len`` to one row per network length that may cover them, plus a salt.

    ``carried``: columns of ``networks`` that depend on its length only.
    """
    lengths = F.broadcast(networks.select("family", "plen", *(carried or [])).distinct())
    fam, plen = F.col("family"), F.col("plen")
    return (
        rows.join(lengths, "family")
        .where(plen <= F.col("max_len"))
        .withColumn("net_hi", F.expr(mask_hi("family", "hi", "plen")))
        .withColumn("net_lo", F.expr(mask_lo("family", "lo", "plen")))
        .withColumn("salt", F.when(_short(fam, plen), F.pmod(F.xxhash64(*identity), F.lit(salts)).cast("int")).otherwise(0))
        .drop("hi", "lo", "max_len")
    )


def exact_lookup(prefixes: DataFrame, state: DataFrame, text: str = "prefix") -> DataFrame:
    """Asked prefixes found in the state, host bits ignored; the asked text is kept, the route's is added."""
    asked = with_network(prefixes, text)
    routes = state.select(*KEY, F.col("prefix").alias("matching_prefix"), "origin_as", "as_path")
    return asked.join(routes, KEY).drop(*KEY)


def longest_match(addresses: DataFrame, state: DataFrame, text: str = "ip", how: str = "left") -> DataFrame:
    """Most specific route of each address.

    Each distinct address is looked up once.  ``how="left"`` keeps addresses without a route or that are no address.
    ``state`` is read twice (its lengths, its routes) and should be a stored table.
    """
    distinct = with_address(addresses.select(text).distinct(), text)
    probes = network_probes(distinct.withColumn("max_len", F.expr(max_plen("family"))), state, [text])
    routes = salted_networks(state.select(*KEY, F.col("prefix").alias("matching_prefix"), "origin_as", "as_path"))
    hits = probes.join(routes, [*KEY, "salt"])
    best = hits.groupBy(text).agg(
        F.max_by(F.struct("matching_prefix", "plen", "origin_as", "as_path"), "plen").alias("_best")
    )
    return addresses.join(best.select(text, "_best.*"), text, how)


def validate_origins(routes: DataFrame, vrps: DataFrame) -> DataFrame:
    """RFC 6811 state of each distinct ``(prefix, origin_as)``: valid, invalid or not-found.

    ``vrps``: ``prefix, max_length, asn``; without a maximum length, that of the prefix counts.  ``origin_as`` NULL, or
    ``origin_is_set`` true, matches no VRP.  VRPs are first combined per network and per (network, ASN), so a probe meets
    at most one row of each kind however many VRPs one network has.  Routes are looked up by network, each once: how many
    VRPs cover one depends only on its first bits, as many as the longest VRP that may cover it has, and an origin is looked
    up only at lengths of which some VRP allows the route's length.
    """
    networks = with_network(vrps.select("prefix", F.col("max_length").cast("int"), F.col("asn").cast("bigint")))
    networks = networks.withColumn("max_length", F.coalesce("max_length", "plen"))
    per_asn = stored(
        networks.groupingSets([KEY, [*KEY, "asn"]], *KEY, "asn")
        .agg(F.count("*").alias("n"), F.max("max_length").alias("max_length"), F.grouping("asn").alias("_all"))
        .where("_all = 1 OR asn > 0")
    )
    every, own = per_asn.where("_all = 1").select(*KEY, "n"), per_asn.where("_all = 0").select(*KEY, "asn", "max_length")
    # per length of a route, the longest VRP length that may cover it: at most 33 + 129 rows
    reached = every.select("family", F.explode(F.sequence("plen", F.expr(f"{max_plen('family')}"))).alias("plen"), F.col("plen").alias("first_len"))
    reached = F.broadcast(reached.distinct().groupBy("family", "plen").agg(F.max("first_len").alias("first_len")))

    origin = F.col("origin_as").cast("bigint")
    if "origin_is_set" in routes.columns:
        origin = F.when(~F.col("origin_is_set"), origin)
    asked = routes.select("prefix", F.col("origin_as").cast("bigint"), origin.alias("_origin")).distinct()
    keyed = with_network(asked, drop_invalid=False).join(reached, ["family", "plen"], "left")
    first = {"first_hi": F.expr(mask_hi("family", "net_hi", "first_len")), "first_lo": F.expr(mask_lo("family", "net_lo", "first_len"))}
    keyed = stored(keyed.withColumns(first))

    start = ["family", "first_hi", "first_lo", "first_len"]
    starts = keyed.where("first_len IS NOT NULL").select(start).distinct()
    probes = network_probes(starts.withColumns({"hi": F.col("first_hi"), "lo": F.col("first_lo"), "max_len": F.col("first_len")}), every, start)
    covering = probes.join(salted_networks(every), [*KEY, "salt"]).groupBy(start).agg(F.sum("n").alias("covering"))

    route = ["family", "hi", "lo", "max_len"]
    of = keyed.withColumnsRenamed({"net_hi": "hi", "net_lo": "lo", "plen": "max_len"})
    origins = of.where("first_len IS NOT NULL AND _origin > 0").select(*route, F.col("_origin").alias("asn")).distinct()
    origins = origins.withColumns({"_hi": F.col("hi"), "_lo": F.col("lo"), "_len": F.col("max_len")})
    allowed = own.groupBy("family", "plen").agg(F.max("max_length").alias("_longest"))
    probes = network_probes(origins, allowed, ["_hi", "_lo", "_len", "asn"], carried=["_longest"]).where("_len <= _longest")
    hits = probes.join(salted_networks(own), [*KEY, "asn", "salt"]).where("_len <= max_length")
    matched = hits.select("family", F.col("_hi").alias("net_hi"), F.col("_lo").alias("net_lo"), F.col("_len").alias("plen"), F.col("asn").alias("_origin")).distinct()

    found = keyed.join(covering, start, "left").join(matched.withColumn("_matched", F.lit(True)), [*KEY, "_origin"], "left")
    covered = F.coalesce("covering", F.lit(0).cast("bigint"))
    return found.select(
        "prefix",
        "origin_as",
        F.col("_origin").isNull().alias("origin_is_none"),
        covered.alias("covering_vrps"),
        F.when(F.col("_matched"), "valid").when(covered > 0, "invalid").otherwise("not-found").alias("rpki_status"),
    )
