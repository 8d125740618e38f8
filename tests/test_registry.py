import json

from routeloom.operators import discrepancy, registry


def test_roa_status_cases(spark):
    roas = [
        ("a", 0, "AS1", "valid"), ("a", 1, "AS1", "invalid_length"), ("b", 0, "AS2", "valid"), ("c", 0, "2", "invalid_asn"),
        ("d", 0, "AS1", "invalid"), ("d", 1, "AS1", "valid"), ("d", 2, "AS1", "unknown"), ("e", 0, None, "unknown"),
    ]
    table = spark.createDataFrame([(p, i, o, 24, v) for p, i, o, v in roas], "prefix string, pos bigint, origin string, max_length int, validity string")
    asked = spark.createDataFrame([(p, "AS1") for p in "abcdef"] + [("a", "AS1")], "prefix string, origin_as string")
    got = {r.prefix: (r.rpki_status, r.covering_roas) for r in registry.roa_status(asked, table).collect()}
    assert got == {"a": ("invalid", 2), "b": ("invalid", 1), "c": ("not-found", 1), "d": ("valid", 3), "e": ("not-found", 1), "f": ("not-found", 0)}


ITEMS = "prefix string, section string, pos bigint, key string, value string"


def irr_table(spark):
    return spark.createDataFrame([
        ("a", "irr_records", 0, "origin", "AS5"), ("a", "irr_records", 1, "source", " RIPE "), ("a", "irr_records", 2, "origin", "3"),
        ("a", "irr_records", 3, "origin", "5"), ("a", "irr_records", 4, "source", ""), ("a", "records", 0, "OriginAS", "AS9"),
        ("a", "records", 1, "source", "ARIN"), ("b", "irr_records", 0, "origin", "ASX"), ("b", "irr_records", 1, "source", "RADB"),
        ("b", "records", 0, "OriginAS", "1AS2"), ("b", "records", 1, "origin", "7"), ("b", "records", 2, "source", "ARIN"),
        ("c", "irr_records", 0, "source", "RIPE"), ("c", "irr_records", 1, "OriginAS", "4"),
    ], ITEMS)


def test_irr_origins_in_order_with_fallback(spark):
    got = {r.prefix: (r.irr_origins, r.authorities, r.status) for r in registry.irr_origins(irr_table(spark)).collect()}
    assert got == {
        "a": (["5", "3"], ["RIPE"], "success"),
        "b": (["12", "7"], ["RADB", "ARIN"], "success"),
        "c": ([], ["RIPE"], "not-found"),
    }


def test_irr_match(spark):
    rows = spark.createDataFrame([("a", "AS5"), ("a", "9"), ("b", "7"), ("b", "8"), ("c", "1"), ("z", "1"), ("a", "X")], "prefix string, origin_as string")
    got = {(r.prefix, r.origin_as): (r.irr_origin_count, r.irr_mismatch) for r in registry.with_irr_match(rows, irr_table(spark)).collect()}
    assert got == {
        ("a", "AS5"): (2, False), ("a", "9"): (2, True), ("b", "7"): (2, False), ("b", "8"): (2, True), ("c", "1"): (0, False),
        ("z", "1"): (0, False), ("a", "X"): (2, False),
    }


def test_answers_as_json(spark):
    answer = {"data": {"validating_roas": [{"prefix": "p/8", "max_length": 8, "origin": "AS1", "validity": "valid"}, {"origin": "AS2"}],
                       "irr_records": [[{"key": "origin", "value": "1"}], [{"key": "source", "value": "R"}]], "records": []}}
    df = spark.createDataFrame([("p", json.dumps(answer)), ("q", "{}"), ("r", "broken")], "prefix string, answer string")
    assert [(r.prefix, r.pos, r.origin, r.validity) for r in registry.roa_rows(df).collect()] == [("p", 0, "AS1", "valid"), ("p", 1, "AS2", None)]
    items = {(r.prefix, r.section, r.pos, r.key) for r in registry.irr_items(df).collect()}
    assert items == {
        ("p", "irr_records", 0, "origin"), ("p", "irr_records", 1, "source"), ("p", "records", None, None),
        ("q", "irr_records", None, None), ("q", "records", None, None), ("r", "error", None, None),
    }
    found = {r.prefix: (r.irr_origins, r.status) for r in registry.irr_origins(registry.irr_items(df)).collect()}
    assert found == {"p": (["1"], "success"), "q": ([], "not-found"), "r": ([], "error")}


def literal(rpki, mismatch, n, flap, rapid):
    """The rules in their order, with both ways of raising a severity."""
    order = ["normal", "low", "medium", "high", "critical"]
    out = []
    for raise_to in (lambda s, x: max(s, x, key=order.index), max):
        flags, s = [], "normal"
        if flap != "none":
            flags.append("FREQUENT_ROUTE_FLAPPING" if flap == "high" else "ROUTE_FLAPPING")
            if rapid:
                flags.append("RAPID_STATE_CHANGES")
            s = flap
        if rpki == "invalid" and mismatch:
            flags.append("POTENTIAL_HIJACK")
            s = "critical"
        else:
            if rpki == "invalid":
                flags.append("RPKI_INVALID")
                s = raise_to(s, "high")
            if mismatch:
                flags.append("IRR_MISMATCH")
                s = raise_to(s, "medium")
            if n > 1:
                flags.append("MULTIPLE_IRR_ORIGINS")
                if s == "normal":
                    s = "low"
            if rpki == "valid" and mismatch:
                flags.append("RPKI_IRR_CONFLICT")
                s = raise_to(s, "medium")
        out.append(s)
    return flags, out[0], out[1]


def test_truth_table(spark):
    cases = [
        (rpki, mismatch, n, flap, rapid)
        for rpki in ("valid", "invalid", "not-found", None)
        for n in (0, 1, 2)
        for mismatch in ([False, True] if n else [False])
        for flap in ("none", "low", "medium", "high")
        for rapid in ([0, 2] if flap != "none" else [0])
    ]
    rows = [(i, c[0], c[1], c[2], c[3] != "none" if c[3] != "none" or i % 2 else None, None if c[3] == "none" else c[3], 5, c[4], "p", 2.5) for i, c in enumerate(cases)]
    df = spark.createDataFrame(
        rows, "i int, rpki_status string, irr_mismatch boolean, irr_origin_count bigint, flap_detected boolean, flap_severity string, "
        "transition_count bigint, rapid_transitions bigint, pattern_analysis string, window_minutes double"
    )
    for r in discrepancy.score_discrepancies(df).collect():
        assert (r.flags, r.severity, r.severity_lexical) == literal(*cases[r.i]), cases[r.i]
        assert len(r.recommendations) == len(r.flags)


def test_lone_invalid_differs_between_the_severities(spark):
    df = spark.createDataFrame(
        [("invalid", False, 0, None, None, None, None, None, None)],
        "rpki_status string, irr_mismatch boolean, irr_origin_count bigint, flap_detected boolean, flap_severity string, "
        "transition_count bigint, rapid_transitions bigint, pattern_analysis string, window_minutes double",
    )
    r = discrepancy.score_discrepancies(df).first()
    assert (r.severity, r.severity_lexical) == ("high", "normal")
    assert r.recommendations == ["Verify route authorization with ROA - RPKI status: invalid"]


def test_detection_rate_of_nothing_is_null(spark):
    r = discrepancy.detection_rate(spark.createDataFrame([], "detected boolean")).first()
    assert (r.detected, r.total, r.rate) == (0, 0, None)
