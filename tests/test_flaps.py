import datetime as dt
import random

import pytest

from routeloom.operators import flaps

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """rows: (prefix, seconds, seq, type)"""
    data = [(p, T0 + dt.timedelta(seconds=s), q, t, "1 2" if t == "A" else None) for p, s, q, t in rows]
    return spark.createDataFrame(data, "prefix string, ts timestamp, seq bigint, update_type string, as_path string")


def fold(events, minutes, least, rapid_seconds):
    """One prefix, event by event."""
    events = sorted(events)
    window = [e for e in events if e[0] >= events[-1][0] - minutes * 60]
    if len(window) < 3:
        return (False, 0, 0, "normal", None)
    changes = [(b[0], f"{a[2]}->{b[2]}") for a, b in zip(window, window[1:]) if a[2] != b[2]]
    rapid = sum(y[0] - x[0] <= rapid_seconds for x, y in zip(changes, changes[1:]))
    t, hit = len(changes), len(changes) >= least
    level = "high" if t > least + 4 or rapid > least // 2 else "medium" if t > least + 2 or rapid > 0 else "low"
    return (hit, t, rapid, level if hit else "normal", len(window))


@pytest.mark.parametrize("buckets", [1, 7, 256])
def test_summary_and_transitions_equal_a_fold(spark, monkeypatch, buckets):
    monkeypatch.setattr(flaps, "BUCKETS_PER_WINDOW", buckets)
    rng = random.Random(buckets)
    by_prefix = {}
    for p in range(25):
        n = rng.choice([1, 2, 3, 8, 60])
        by_prefix[f"10.{p}.0.0/16"] = [(rng.randint(0, 900), q, rng.choice("AW")) for q in range(n)]
    rows = [(p, s, q, t) for p, ev in by_prefix.items() for s, q, t in ev]
    got = flaps.flap_summary(log(spark, rows), minutes=5, least=4, rapid_seconds=20).collect()
    assert len(got) == len(by_prefix)
    for r in got:
        want = fold(by_prefix[r.prefix], 5, 4, 20)
        assert (r.flap_detected, r.transition_count, r.rapid_transitions, r.severity, r.total_updates) == want, r
    details = flaps.flap_transitions(log(spark, rows), minutes=5).collect()
    for p, ev in by_prefix.items():
        ev = sorted(ev)
        window = [e for e in ev if e[0] >= ev[-1][0] - 300]
        want = [(b[1], f"{a[2]}->{b[2]}") for a, b in zip(window, window[1:]) if a[2] != b[2]]
        assert sorted((d.seq, d.transition) for d in details if d.prefix == p) == sorted(want)


def one(spark, seconds, types, **kw):
    rows = [("p", s, i, t) for i, (s, t) in enumerate(zip(seconds, types))]
    return flaps.flap_summary(log(spark, rows), **kw).first()


def test_too_few_updates(spark):
    assert one(spark, [0, 1], "AW").pattern_analysis == flaps.TOO_FEW
    r = one(spark, [0, 1000, 1001], "AWA")
    assert (r.pattern_analysis, r.window_minutes, r.total_updates) == (flaps.TOO_FEW_IN_WINDOW, 5.0, None)


def test_window_start_is_inclusive(spark):
    assert one(spark, [0, 299, 300], "AWA").total_updates == 3
    assert one(spark, [0, 300, 301], "AWA").pattern_analysis == flaps.TOO_FEW_IN_WINDOW


def test_severity_steps(spark):
    spread = lambda n: [i * 1000 for i in range(n + 1)]
    levels = {n: one(spark, spread(n), ("AW" * 9)[: n + 1], minutes=600).severity for n in (3, 4, 6, 7, 8, 9)}
    assert levels == {3: "normal", 4: "low", 6: "low", 7: "medium", 8: "medium", 9: "high"}


def test_rapid_gap_is_inclusive(spark):
    assert one(spark, [0, 100, 160, 300], "AWAW", minutes=60).rapid_transitions == 1
    assert one(spark, [0, 100, 161, 300], "AWAW", minutes=60).rapid_transitions == 0


def test_pattern_texts(spark):
    balanced = one(spark, [0, 100, 200, 300, 400], "AWAWA", minutes=60).pattern_analysis
    assert balanced == "Route instability detected: 4 state transitions observed. Predominantly announcements (60.0% of changes)."
    r = one(spark, [0, 10, 20, 30, 40, 50], "AWAWAW", minutes=60)
    assert r.pattern_analysis == (
        "Route instability detected: 5 state transitions observed. 4 segments involved rapid changes (within 60s). "
        "Balanced mix of announcements and withdrawals."
    )
    assert one(spark, [0, 1, 2], "AAA").pattern_analysis == "No significant route flapping detected within the analyzed window."
