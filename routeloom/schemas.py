"""Fixed schemas, as DDL text, of the tables the operators read and write.  Nothing is inferred."""

from __future__ import annotations

# The columns of the tables.
_COMMUNITY = "array<struct<asn:bigint,value:bigint>>"


# Decoded elements of a routing-table dump; one row per element, ``seq`` is the order of arrival.
RIB_ELEMENTS = (
    "seq bigint, status string, elem_type string, time bigint, collector string, peer_address string, "
    f"peer_asn bigint, prefix string, as_path string, next_hop string, communities {_COMMUNITY}, med bigint, "
    "local_pref bigint, atomic_aggregate string, aggregator string"
)

RIB_ENTRIES = (
    "dump_time timestamp, record_time timestamp, collector string, peer_address string, peer_asn bigint, "
    "prefix string, as_path string, origin_as bigint, next_hop string, communities string, med bigint, "
    "local_pref bigint, atomic_aggregate boolean, aggregator_as bigint, aggregator_address string, seq bigint"
)

UPDATES = (
    "timestamp timestamp, collector string, peer_address string, peer_asn bigint, prefix string, "
    "update_type string, as_path string, origin_as bigint, next_hop string, communities string, med bigint, "
    "local_pref bigint, atomic_aggregate boolean, aggregator string, seq bigint"
)

# Current route per network: canonical key, canonical text, origin and path.
RIB_STATE = (
    "family int, net_hi bigint, net_lo bigint, plen int, prefix string, origin_as bigint, as_path array<bigint>"
)

INCIDENTS_CSV = (
    "event_id string, prefix string, hijacker_asn string, victim_asn string, _5 string, _6 string, confidence string"
)

# Registry answers landed as JSON text, one per asked prefix.
ROA_ANSWER = (
    "data struct<validating_roas:array<struct<prefix:string,max_length:int,origin:string,validity:string>>>"
)
IRR_ANSWER = (
    "data struct<irr_records:array<array<struct<key:string,value:string>>>,"
    "records:array<array<struct<key:string,value:string>>>>"
)

ENTITY_TYPES = ["ip_addresses", "prefixes", "asns", "keywords", "time_references"]
