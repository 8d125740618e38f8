import datetime as dt
import os
import json
import tempfile

from pyspark.sql import functions as F

from routeloom.operators import flaps, rib
from routeloom.schemas import RIB_STATE, UPDATES
from routeloom.sources import scans, sinks
from routeloom.streaming import feeds

T0 = dt.datetime(2024, 1, 1)


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def updates(spark, rows):
    """rows: (seconds, seq, prefix, type, path)"""
    full = [(T0 + dt.timedelta(seconds=s), "rrc03", "192.0.2.1", 1, p, t, a, None, "192.0.2.9", "1:2", None, None, False, None, q) for s, q, p, t, a in rows]
    return spark.createDataFrame(full, UPDATES)


def routes(df):
    return {r.prefix: (r.origin_as, list(r.as_path)) for r in df.collect()}


def feed(n=240):
    kinds = ["A", "W", "A", "S", "A"]
    return [(i * 3, i, f"10.{i % 5}.0.0/16", kinds[i % 7 % 5], f"1 {i}" if i % 11 else "1 {2}") for i in range(n)]


def test_state_over_a_stream_equals_the_batch_with_late_rows(spark):
    src, log, changes, check = folder() + "/in", folder() + "/log", folder() + "/changes", folder()
    rows = feed()
    batch = routes(rib.replay(spark.createDataFrame([], RIB_STATE), updates(spark, rows), time="timestamp"))
    # later half first: the older rows arrive late
    for part in (rows[120:], rows[:120]):
        updates(spark, part).coalesce(1).write.mode("append").parquet(src)
        feeds.maintain_state(feeds.update_stream(spark, src), log, changes, check).awaitTermination()
    assert routes(feeds.state_of(feeds.changes_before(spark, changes))) == batch
    assert spark.read.parquet(log).count() == rib.update_log(updates(spark, rows)).count()


def test_a_batch_that_runs_again_changes_nothing(spark):
    log, changes = folder() + "/log", folder() + "/changes"
    body = feeds.log_and_apply(log, changes)
    one, two = updates(spark, feed()[:100]), updates(spark, feed()[100:])
    body(one, 0)
    body(two, 1)
    first = routes(feeds.state_of(feeds.changes_before(spark, changes)))
    body(two, 1)
    assert routes(feeds.state_of(feeds.changes_before(spark, changes))) == first
    assert spark.read.parquet(log).count() == rib.update_log(updates(spark, feed())).count()


def test_changes_of_a_snapshot_are_older_than_updates(spark):
    base = rib.snapshot(spark.createDataFrame([(1, "10.0.0.0/16", "9 8"), (2, "11.0.0.0/8", "9 7")], "seq bigint, prefix string, as_path string"))
    new = feeds.latest_changes(updates(spark, [(1, 1, "10.0.0.0/16", "W", None), (0, 0, "10.0.0.0/16", "A", "1 2")]))
    assert routes(feeds.state_of(feeds.merge_changes(feeds.changes_of(base), new))) == {"11.0.0.0/8": (7, [9, 7])}


def test_running_aggregate(spark):
    src = folder() + "/in"
    updates(spark, feed()[:100]).coalesce(1).write.mode("append").parquet(src)
    updates(spark, feed()[100:]).coalesce(1).write.mode("append").parquet(src)
    stream = feeds.latest_changes(feeds.update_stream(spark, src, files_per_slice=1))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = rib.replay(spark.createDataFrame([], RIB_STATE), updates(spark, feed()), time="timestamp")
    assert routes(feeds.state_of(spark.table("running"))) == routes(batch)


def run_append(spark, df, name):
    query = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_stream_summary(spark):
    src = folder() + "/in"
    rows = [*feed(), (4000, 999, "10.9.0.0/16", "A", "1")]  # the last row moves the watermark past the rest
    updates(spark, rows).coalesce(1).write.parquet(src)
    got = run_append(spark, feeds.stream_summary(feeds.update_stream(spark, src)), "summary")
    want = {}
    for s, q, _, t, a in feed():
        want.setdefault(s // 300, []).append((s, q, t))
    assert len(got) == len(want)
    for r in got:
        window = want[int((r.window.start - T0).total_seconds()) // 300]
        assert (r.total_updates, r.announcements) == (len(window), sum(t == "A" for *_, t in window))
        assert r.most_recent_state == ("withdrawn" if max(window)[2] == "W" else "announced")


def test_stream_flaps_equal_the_batch_rule_per_window(spark):
    src = folder() + "/in"
    kinds = "AWAAWWAWAWWA"
    rows = [(i * 7, i, f"10.{i % 3}.0.0/16", kinds[(i * i // 2) % 12], "1") for i in range(120)]
    updates(spark, [*rows, (9000, 999, "10.9.0.0/16", "A", "1"), (9999, 1000, "10.9.0.0/16", "A", "1")]).coalesce(1).write.parquet(src)
    stream = feeds.stream_flaps(feeds.update_stream(spark, src), slice="20 seconds", rapid_seconds=30)
    got = [r for r in run_append(spark, stream, "flaps") if r.prefix != "10.9.0.0/16"]
    assert got
    for r in got:
        at = int((r.window_start - T0).total_seconds())
        mine = sorted((s, t) for s, _, p, t, _ in rows if p == r.prefix and at <= s < at + 300)
        changes = [b[0] for a, b in zip(mine, mine[1:]) if a[1] != b[1]]
        rapid = sum(y - x <= 30 for x, y in zip(changes, changes[1:]))
        few = len(mine) < 3
        assert r.total_updates == len(mine)
        assert (r.transition_count, r.rapid_transitions) == ((0, 0) if few else (len(changes), rapid)), r
        assert r.flap_detected == (not few and len(changes) >= 4)
    # the same window in batch form, where it ends at the latest update
    whole = flaps.flap_summary(updates(spark, rows), minutes=100, rapid_seconds=30, time="timestamp").collect()
    assert {r.total_updates for r in whole} == {40}


def test_log_files(spark):
    path = folder() + "/log"
    sinks.append_updates(updates(spark, feed()), path)
    sinks.append_updates(updates(spark, [(86400 * 2, 500, "10.0.0.0/16", "A", "5 6")]), path)
    history = scans.prefix_history(spark, path, "10.0.0.0/16")
    rows = history.collect()
    assert rows[0].as_path == "5 6" and [r.timestamp for r in rows] == sorted((r.timestamp for r in rows), reverse=True)
    assert "EqualTo(prefix,10.0.0.0/16)" in history._jdf.queryExecution().executedPlan().toString()
    start, end = F.lit(T0), F.lit(T0 + dt.timedelta(days=3))
    assert scans.updates_between(spark, path, start, end).count() == rib.update_log(updates(spark, feed())).count() + 1
    assert scans.updates_between(spark, path, start, end, longest=dt.timedelta(hours=1)).count() == rib.update_log(updates(spark, feed())).count()
    assert scans.updates_between(spark, path, start, end, asn="6").count() == 1


def test_state_versions(spark):
    path = folder() + "/state"
    assert scans.stored_state(spark, path).count() == 0
    state = rib.snapshot(spark.createDataFrame([(1, "10.0.0.0/8", "1 2")], "seq bigint, prefix string, as_path string"))
    sinks.save_state(state, path, 1)
    sinks.save_state(state.limit(0), path, 0)
    sinks.save_state(state, path, 1)
    assert routes(scans.stored_state(spark, path)) == {"10.0.0.0/8": (2, [1, 2])}


def test_old_versions_go_and_one_is_read(spark):
    path = folder() + "/state"
    state = rib.snapshot(spark.createDataFrame([(1, "10.0.0.0/8", "1 2")], "seq bigint, prefix string, as_path string"))
    for version in range(5):
        sinks.save_state(state, path, version, keep=2)
    assert sorted(x for x in os.listdir(path) if x.startswith("version")) == ["version=3", "version=4"]
    assert all("version=4" in f for f in scans.stored_state(spark, path).inputFiles())
    assert all("version=3" in f for f in scans.stored_state(spark, path, before=4).inputFiles())


def test_late_rows_and_open_windows_come_from_the_log(spark):
    src = folder() + "/in"
    rows = feed()
    for part in (rows[120:], rows[:120]):  # the second half first: the first is too late for the watermark
        updates(spark, part).coalesce(1).write.mode("append").parquet(src)
    log = updates(spark, rows)
    summary = lambda df: feeds.stream_summary(df, "1 minute", late="1 second")
    counted = log.groupBy(F.window("timestamp", "1 minute")).agg(F.count("*").alias("total_updates"))
    counted = counted.withColumns({"lo": F.col("window.start"), "hi": F.col("window.end")})
    run_append(spark, summary(feeds.update_stream(spark, src, files_per_slice=1)), "late")
    emitted = spark.table("late")
    whole = feeds.completed(emitted, counted, summary, log, ["window"], "timestamp")
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert emitted.count() < whole.count() and plain(whole) == plain(summary(log).select(whole.columns))


def test_incident_csv(spark):
    path = folder() + "/i.csv"
    with open(path, "w", newline="") as f:
        f.write('1,23.32.8.0/24,9498,20940,,,8\r\n2,"2001:db8::/32",5,6,,,\r\nx,10.0.0.0/8,1,2,,,4\r\n3,10.0.0.0/8,1\r\n4,10.0.0.0/8,1,2,,,z\r\n')
    got = [tuple(r) for r in scans.incidents(spark, path).orderBy("event_id").collect()]
    assert got == [(1, "23.32.8.0/24", 9498, 20940, 8), (2, "2001:db8::/32", 5, 6, 0)]


def test_corpus_files(spark):
    raw, clean, vectors = folder(), folder() + "/clean", folder() + "/vectors"
    for name, data in {"rfc1.txt": b"Abstract\n  text of one \n", "rfc2.txt": b"plain\n", "bad.txt": b"\xff\xfe\xfa", "skip.md": b"x"}.items():
        with open(f"{raw}/{name}", "wb") as f:
            f.write(data)
    docs = scans.text_files(spark, raw)
    assert sorted(r.source for r in docs.collect()) == ["rfc1.txt", "rfc2.txt"]
    assert sinks.build_corpus(docs, clean, vectors)
    assert sorted((r.source, r.text) for r in spark.read.parquet(clean).collect()) == [("rfc1_clean.txt", "Abstract\ntext of one"), ("rfc2_clean.txt", "plain")]
    assert {len(r.embedding) for r in spark.read.parquet(vectors).collect()} == {1024}
    assert not sinks.build_corpus(docs.limit(0), clean, vectors)


def test_rib_entries_and_dump(spark):
    path, out = folder() + "/dump", folder() + "/rib"
    element = {"seq": 1, "status": "valid", "elem_type": "R", "time": 60, "prefix": "10.0.0.0/8", "as_path": "1 {2,3}", "communities": [{"asn": 1, "value": None}],
               "aggregator": "7:10.0.0.1", "atomic_aggregate": ""}
    spark.createDataFrame([(json.dumps(e),) for e in (element, {**element, "status": "corrupted"}, {**element, "elem_type": "A"})], "value string").write.text(path)
    sinks.append_rib(rib.rib_entries(scans.rib_dump(spark, path, "json"), "2025-05-04 08:00:00"), out)
    row = spark.read.parquet(out).first()
    assert (row.as_path, row.origin_as, row.communities, row.atomic_aggregate, row.aggregator_as, row.aggregator_address) == ("1 2", 2, "1:0", True, 7, "10.0.0.1")
    assert row.record_time == dt.datetime(1970, 1, 1, 0, 1)
    answers = folder() + "/answers"
    spark.createDataFrame([("p", "{}")], "prefix string, answer string").write.json(answers)
    assert scans.registry_answers(spark, answers).first().prefix == "p"
    sinks.write_report(scans.registry_answers(spark, answers), folder() + "/report")
