import datetime as dt
import random

from datetime import timedelta

from pyspark.sql import functions as F

from routeloom.operators import rib
from routeloom.schemas import RIB_STATE

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def updates(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, seq bigint, prefix string, update_type string, as_path string, origin_as string")


def state_of(df):
    return {r.prefix: (r.origin_as, list(r.as_path)) for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], RIB_STATE)


def test_snapshot_last_row_wins_over_peers_and_host_bits(spark):
    rows = [(1, "10.1.2.3/8", "1 2", 7), (2, "10.0.0.0/8", "1 3", 8), (3, "2001:db8::1/32", "4 {5,6}", 7), (4, "10.0.0.0/8", "abc", 7),
            (5, None, "1", 7), (6, "11.0.0.0/8", None, 7)]
    rib_rows = spark.createDataFrame(rows, "seq bigint, prefix string, as_path string, peer_asn bigint")
    assert state_of(rib.snapshot(rib_rows)) == {"10.0.0.0/8": (3, [1, 3]), "2001:db8::/32": (5, [4, 5])}
    assert rib.snapshot(rib_rows, per_peer=True).count() == 3


def test_replay_cases(spark):
    base = rib.snapshot(spark.createDataFrame([(1, "10.0.0.0/8", "1 2"), (2, "12.0.0.0/8", "1 9")], "seq bigint, prefix string, as_path string"))
    log = updates(spark, [
        (at(1), 1, "11.0.0.0/8", "W", None, None),           # absent: nothing happens
        (at(2), 2, "10.0.0.0/8", "W", None, None),
        (at(3), 3, "10.9.9.9/8", "A", "5 6", None),           # same network, set again
        (at(4), 5, "13.0.0.0/8", "W", None, None),            # equal time: seq decides
        (at(4), 4, "13.0.0.0/8", "A", "7 8", None),
        (at(5), 6, "12.0.0.0/8", "A", "", None),              # ignored: empty path
        (at(5), 7, "12.0.0.0/8", "A", "1 {2,3}", None),       # ignored: set
        (at(5), 8, "12.0.0.0/8", "S", "1 2", None),           # ignored: type
        (at(5), 9, " ", "W", None, None),                     # ignored: blank prefix
        (at(6), 10, "14.0.0.0/8", "A", "1 2", "77"),          # given origin
        (at(7), 11, "14.0.0.0/8", "A", "1 3", "x"),           # ignored: origin is no number
    ])
    assert state_of(rib.replay(base, log)) == {
        "10.0.0.0/8": (6, [5, 6]), "12.0.0.0/8": (9, [1, 9]), "14.0.0.0/8": (77, [1, 2]),
    }


def test_replay_equals_a_sequential_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(3000):
        prefix = f"10.{rng.randint(0, 3)}.0.0/16"
        kind = rng.choice("AAWS")
        path = rng.choice(["1 2", "3 4 5", "", "6 {7}", "8"])
        rows.append((at(i // 3), i, prefix, kind, path if kind == "A" else None, None))
        if kind == "W":
            want.pop(prefix, None)
        elif kind == "A" and path and "{" not in path:
            numbers = [int(x) for x in path.split()]
            want[prefix] = (numbers[-1], numbers)
    rng.shuffle(rows)
    assert state_of(rib.replay(empty(spark), updates(spark, rows))) == want


def test_cut_off_gives_the_state_at_a_time(spark):
    log = updates(spark, [(at(1), 1, "10.0.0.0/8", "A", "1", None), (at(9), 2, "10.0.0.0/8", "W", None, None)])
    assert state_of(rib.replay(empty(spark), log.where(F.col("ts") <= at(5)))) == {"10.0.0.0/8": (1, [1])}


def test_range_is_cut_to_an_hour_and_null_bounds_are_empty(spark):
    log = updates(spark, [(at(0), 1, "p", "A", "1 22", None), (at(3599), 2, "p", "A", "2", None), (at(3600), 3, "p", "A", "22", None)])
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(rib.updates_in_range(log, F.lit(at(0)), F.lit(at(90000)), longest=timedelta(hours=1))) == [1, 2]
    assert seqs(rib.updates_in_range(log, F.lit(at(0)), F.lit(at(90000)))) == [1, 2, 3]
    assert seqs(rib.updates_in_range(log, F.lit(None).cast("timestamp"), F.lit(at(9)))) == []
    assert seqs(rib.updates_in_range(log, F.lit(at(0)), F.lit(at(9000)), asn="2")) == [2]


def test_rejected_updates_by_reason(spark):
    log = updates(spark, [(at(0), 1, "10.0.0.0/8", "A", "1 22", None), (at(0), 2, "10.0.0.0/8", "A", "1 {2}", None), (at(0), 3, "10.0.0.0/99", "W", None, None), (at(0), 4, " ", "A", "1", None), (at(0), 5, "10.0.0.0/8", "S", "1", None), (at(0), 6, "10.0.0.0/8", "A", None, None)])
    assert {r.reason: r.n for r in rib.rejected_updates(log).collect()} == {"path": 2, "prefix": 1, "blank prefix": 1, "type": 1}


def test_summary_of_nothing(spark):
    row = rib.summarize_updates(updates(spark, [])).first()
    assert (row.total_updates, row.status, row.most_recent_state) == (0, "No updates found", None)


def test_summary_state_follows_time_then_seq(spark):
    log = updates(spark, [(at(1), 9, "p", "A", "1", None), (at(2), 1, "p", "A", "1", None), (at(2), 2, "p", "W", None, None)])
    row = rib.summarize_updates(log).first()
    assert (row.total_updates, row.announcements, row.withdrawals, row.unique_as_paths, row.most_recent_state) == (3, 2, 1, 1, "withdrawn")


def test_withdrawals_keep_six_fields(spark):
    log = spark.createDataFrame(
        [("rrc03", "p", "W", "1 2"), ("rrc03", "p", "A", "1 2"), ("rrc03", " ", "A", "1"), ("rrc03", "p", "S", "1")],
        "collector string, prefix string, update_type string, as_path string",
    )
    assert sorted((r.update_type, r.as_path) for r in rib.update_log(log).collect()) == [("A", "1 2"), ("W", None)]
