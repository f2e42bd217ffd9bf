"""Rows at, just under and just over the limits, and what SQL doesn't show."""

import json
import random
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sundew.functions import fields, net, summaries
from sundew.operators import campaigns, dashboards, dedup, filters, fingerprints, geo, intel, lateral, rates, rules, sessions
from sundew.plans import intervals, tables
from sundew.sources import delivery, feeds, geo_records, jsonl, lake, probes, siem
from sundew.streaming import detect, retries
from sundew.streaming.run import keyed_state, replayed, replayed_batches, replayed_by_clock

END = 1_800_000_000_000

EVENT = "seq long, ts_ms long, source_ip string, service string, sensor_host string, username string, password string, credential string, success boolean, dest_port int, user_agent string, path string, payload string"


def events(spark, *rows, **common):
    names = [x.split()[0] for x in EVENT.split(", ")]
    base = {"source_ip": "1.2.3.4", "service": "ssh", "sensor_host": "h", "success": False, "dest_port": 22} | common
    return spark.createDataFrame([tuple(({"seq": i} | base | r).get(n) for n in names) for i, r in enumerate(rows)], EVENT)


def times(spark, *ms, **common):
    return events(spark, *({"ts_ms": t} for t in ms), **common)


def test_dedup_gap_and_group_size(spark):
    got = [(r.is_alert, r.group_count) for r in dedup.dedup_alerts(times(spark, 0, 300_000, 600_001, 600_002, 600_003), 300_000, 3).orderBy("seq").collect()]
    assert got == [(True, 1), (False, 2), (True, 1), (False, 2), (True, 3)]


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_dedup_agrees_with_one_event_at_a_time(spark, size):
    ms = [0, 1, 2, 3, 5, 9, 400, 401, 402, 402, 403, 1000]
    got = [(r.is_alert, r.group_count) for r in dedup.dedup_alerts(times(spark, *ms), 100, size).orderBy("seq").collect()]
    want, last, n = [], None, 0
    for t in ms:
        if last is None or t - last > 100:
            n = 1
            want.append((True, 1))
        else:
            n += 1
            want.append((n >= size, n))
            n = 1 if n >= size else n
        last = t
    assert [a for a, _ in got] == [a for a, _ in want]
    if size > 1:
        assert got == want


def test_rule_matches_at_expiry_but_is_removed(spark):
    rule = dedup.Rule("r", expires_ms=10)
    assert dedup.live_rules([rule], 10) == []
    got = times(spark, 10, 11).select(dedup.suppression([rule], F.col("ts_ms")).alias("s")).collect()
    assert [r.s for r in got] == ["r", None]


def test_empty_username_never_matches_a_regex(spark):
    df = events(spark, {"ts_ms": 1, "username": ""}, {"ts_ms": 2, "username": "ROOT"})
    assert [r.s for r in df.select(dedup.suppression([dedup.Rule("r", username_regex=".*")], F.col("ts_ms")).alias("s")).collect()] == [None, "r"]


def test_session_gap_and_missing_times(spark):
    rows = sessions.session_index(times(spark, 0, 300_000, 600_001, None)).orderBy("seq").collect()
    assert [r.session_no for r in rows] == [0, 0, 1, 1]


def test_spray_needs_ten_users(spark):
    spray = events(spark, *({"ts_ms": i, "username": f"u{i}", "password": "p"} for i in range(10)))
    assert sessions.sessions(spray).first().phase == "CREDENTIAL_SPRAY"
    assert sessions.sessions(spray.where("seq < 9")).first().phase == "BRUTE_FORCE"


def test_rate_limit_counts_both_ends(spark):
    rows = rates.rate_limit(times(spark, 0, 60, 60, 100, 161), 2, 60).orderBy("seq").collect()
    assert [r.hits for r in rows] == [1, 2, 3, 3, 1]
    same = rates.over_limit(times(spark, 0, 60, 60, 100, 161), 2, 60).orderBy("seq").collect()
    assert [r.triggered for r in rows] == [r.triggered for r in same]


def test_distinct_in_window_touches_at_the_limit(spark):
    df = events(spark, {"ts_ms": 0, "sensor_host": "a"}, {"ts_ms": 10, "sensor_host": "b"}, {"ts_ms": 11, "sensor_host": "c"})
    assert [r.n for r in rates.distinct_in_window(df, ["source_ip"], "sensor_host", 10).orderBy("seq").collect()] == [1, 2, 2]


@pytest.mark.parametrize(("last", "fires"), [(1_800_000, True), (1_800_001, False)])
def test_latm002_window_is_closed(spark, last, fires):
    df = events(spark, *({"ts_ms": t, "sensor_host": h} for t, h in ((0, "a"), (1, "b"), (last, "c"))))
    assert (lateral.latm002(df).count() == 1) is fires


def test_latm003_counts_empty_names_not_nulls(spark):
    users = ["a", "b", "c", "d", "e", ""]
    assert lateral.latm003(events(spark, *({"ts_ms": i, "username": u} for i, u in enumerate(users)))).count() == 1
    assert lateral.latm003(events(spark, *({"ts_ms": i, "username": u or None} for i, u in enumerate(users)))).count() == 0


@pytest.mark.parametrize(("n", "fires"), [(10, False), (11, True)])
def test_latm007_needs_eleven(spark, n, fires):
    found = lateral.latm007(times(spark, *range(0, n * 10, 10))).collect()
    assert bool(found) is fires and (not fires or len(found[0].event_ids) == 11)


def test_latm006_is_strictly_later(spark):
    df = events(spark, {"ts_ms": 5, "success": True}, {"ts_ms": 5}, {"ts_ms": 6})
    assert lateral.latm006(df).first().event_ids == [0, 2]


def test_camp003_gap_is_open(spark):
    sweep = lambda last: events(spark, *({"ts_ms": t, "source_ip": f"9.9.9.{i}"} for i, t in ((1, 0), (5, 299_999), (9, last)))).withColumn("campaign", F.lit(0))
    assert campaigns.camp003(sweep(599_998)).count() == 1
    assert campaigns.camp003(sweep(599_999)).count() == 0


def test_camp005_end_of_data_and_silence(spark):
    burst = [{"ts_ms": i * 1000, "source_ip": f"9.9.9.{i % 3}"} for i in range(20)]
    on = lambda rows: campaigns.camp005(events(spark, *rows).withColumn("campaign", F.lit(0))).count()
    assert on(burst) == 1 and on(burst[:19]) == 0
    assert on([*burst, {"ts_ms": 19_000 + 1_800_000}]) == 1 and on([*burst, {"ts_ms": 19_000 + 1_799_999}]) == 0


def test_camp006_middle_row_is_late(spark):
    pw = lambda *p: campaigns.camp006(events(spark, *({"ts_ms": i, "password": x} for i, x in enumerate(p))).withColumn("campaign", F.lit(0))).count()
    assert pw("root", "a2024", "x1") == 1 and pw("x1", "root", "a2024") == 0 and pw("root") == 0


def test_camp007_falls_back_to_networks(spark):
    far = 172_800_001
    rows = [{"ts_ms": 0, "source_ip": "9.9.9.1"}, {"ts_ms": far, "source_ip": "9.9.9.2"}]
    on = lambda rows: [r.evidence for r in campaigns.camp007(events(spark, *rows).withColumn("campaign", F.lit(0))).collect()]
    assert on(rows) == ["/28 of 2 addresses"]
    assert on([*rows, {"ts_ms": far, "source_ip": "9.9.9.1"}]) == ["1 addresses"]
    assert on([rows[0], {"ts_ms": far - 1, "source_ip": "9.9.9.1"}]) == []


@pytest.mark.parametrize(("gap", "scanner"), [(499, "MASSCAN"), (500, "HUMAN"), (501, "CREDENTIAL_STUFFING_BOT"), (2000, "CUSTOM_SCRIPT"), (5000, "HUMAN")])
def test_fingerprint_times(spark, gap, scanner):
    df = times(spark, 1, 1 + gap, 1 + 2 * gap, dest_port=1)
    assert fingerprints.fingerprints(df).first().scanner == scanner


def test_geo_burst_and_substring_keywords(spark):
    rec = spark.createDataFrame([(i, "9.9.9.9", "XX", 7, "Cold Storage Ltd", False) for i in range(7)], "seq int, ip string, country_code string, asn int, asn_name string, is_tor boolean")
    got = geo.geo_signals(rec, ("YY",)).orderBy("seq").collect()
    assert [[s.id for s in r.signals] for r in got][4:6] == [["GEO-003"], ["GEO-003", "GEO-005"]]
    assert got[0].signals[0].match == "tor"


def test_intel_first_loaded_network_wins_and_stale_exact_falls_through(spark):
    feed = spark.createDataFrame(
        [("9.9.0.0/16", "wide", ["x"], 1, 1, 100), ("9.9.9.0/24", "long", ["x"], 1, 2, 100), ("9.9.9.9", "old", ["x"], 1, 0, 0)],
        "indicator string, source string, categories array<string>, confidence int, load_seq long, cached_ms long",
    )
    ips = spark.createDataFrame([("9.9.9.9",), ("9.9.9.1",), ("8.8.8.8",)], "ip string")
    got = {r.ip: (r.intel and r.intel.source, r.matched_cidr) for r in intel.lookup(ips, feed).collect()}
    assert got == {"9.9.9.9": ("old", None), "9.9.9.1": ("wide", "9.9.0.0/16"), "8.8.8.8": (None, None)}
    aged = {r.ip: r.intel and r.intel.source for r in intel.lookup(ips, intel.fresh(feed, 150, 50)).collect()}
    assert aged["9.9.9.9"] == "wide"


def test_addresses(spark):
    rows = spark.createDataFrame([("1.2.3.4",), ("01.2.3.4",), ("1.2.3",), ("::1",), ("fd00::2",), (None,), ("169.254.1.1",)], "ip string")
    got = rows.select(net.is_ip(F.col("ip"), True).alias("ok"), net.is_private(F.col("ip"), True).alias("p"), net.ipv6_hex(F.col("ip")).alias("h")).collect()
    assert [r.ok for r in got] == [True, False, False, True, True, False, True]
    assert [r.p for r in got] == [False, False, False, True, True, False, True]
    assert got[3].h == "0" * 31 + "1"


def test_correlation_window(spark):
    found = spark.createDataFrame([("upload", "a", 0), ("command", "a", 1_800_000), ("upload", "b", 0), ("command", "b", 1_800_001)], "rule string, source_ip string, ts_ms long")
    assert [r.source_ip for r in rules.correlations(found).collect()] == ["a"]


def test_lines_that_are_no_events(spark):
    lines = spark.createDataFrame([('{"seq": 1}',), ("",), ("   ",), ("[1]",), ("3",), ("{broken",), ('"x"',), ("nul",)], "value string")
    assert [r.seq for r in jsonl.events_of(lines).collect()] == [1]
    assert sorted(r.reason for r in jsonl.rejects_of(lines).collect()) == ["invalid JSON"] * 2 + ["non-object"] * 3


def test_missing_path_is_empty(spark, tmp_path):
    assert jsonl.read(spark, f"{tmp_path}/none").count() == 0


def test_write_rejects_other_modes(spark, tmp_path):
    with pytest.raises(ValueError):
        jsonl.write(times(spark, 1), f"{tmp_path}/x", "ignore")


def test_deliveries_are_independent(spark):
    def bad(values):
        raise ConnectionError("down")

    rows = spark.createDataFrame([(1, "x")], "seq long, value string")
    got = {r.target: (r.status, r.attempts) for r in delivery.deliver(rows, {"bad": bad, "good": len}, retries=2).collect()}
    assert got == {"bad": ("dropped", 3), "good": ("delivered", 1)}


def test_retry_queue_drops_the_oldest(spark):
    rows = spark.createDataFrame([(i, i, 0) for i in range(5)], "seq long, enqueued_ms long, attempts int")
    kept, dropped = delivery.retry_queue(rows.where("seq < 2"), rows.where("seq >= 2"), 3)
    assert sorted(r.seq for r in kept.collect()) == [2, 3, 4] and sorted(r.seq for r in dropped.collect()) == [0, 1]


def test_fan_out_writes_lake_and_status(spark, tmp_path):
    run = delivery.fan_out(f"{tmp_path}/lake", f"{tmp_path}/status", lambda b: b.select("seq", F.col("source_ip").alias("value")), {"t": len})
    run(times(spark, 1, 2), 0)
    run(times(spark, 1, 2), 0)  # a batch that runs again replaces itself
    assert spark.read.json(f"{tmp_path}/lake").count() == 2 and spark.read.parquet(f"{tmp_path}/status").count() == 2


def test_session_document(spark):
    rows = spark.createDataFrame([("s", 2, 1, "command", "ls"), ("s", 1, 0, "start", "")], "session_id string, ts_ms long, seq long, kind string, data string")
    assert [e["kind"] for e in json.loads(delivery.session_documents(rows).first().value)["events"]] == ["start", "command"]


def test_redis_and_mysql_edges(spark):
    rows = spark.createDataFrame([(bytearray(b"PING\r\nAUTH u p\r\n\r\nINFO"),), (bytearray(b"*x"),), (bytearray(b""),)], "data binary")
    assert [r.kind for r in probes.redis_commands(rows).collect()] == ["ping", "auth_attempt", "recon"]
    packet = b"\0" * 36 + "é".encode() + b"\0\x02\xab\xcd\xef"
    got = spark.createDataFrame([(bytearray(packet),), (bytearray(packet[:38]),)], "d binary").select(probes.mysql_login(F.col("d")).alias("m")).collect()
    assert (got[0].m.username, got[0].m.auth) == ("é", "abcd") and got[1].m.auth == ""


def test_masking_is_idempotent_and_skips_nothing_else(spark):
    rows = spark.createDataFrame([("secret",), ("",), (None,)], "c string")
    once = rows.select(fields.mask_credential(F.col("c")).alias("c"))
    assert once.collect() == once.select(fields.mask_credential(F.col("c")).alias("c")).collect()
    assert once.first().c.startswith("[masked:len=6,hash_prefix=")


def test_stream_state_goes_on_between_batches(spark, tmp_path):
    whole = events(spark, *({"ts_ms": 1_700_000_000_000 + t} for t in (0, 1000, 2000, 400_000, 401_000)))
    want = {r.seq: r.is_alert for r in dedup.dedup_alerts(whole, 300_000, 3).collect()}
    late = whole.where("seq = 0").withColumns({"seq": F.lit(-1).cast("long"), "ts_ms": F.lit(1_800_000_000_000).cast("long")})
    with keyed_state(spark):
        for part in (whole.where("seq < 2"), whole.where("seq >= 2"), late):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/in")
            out = detect.dedup_groups(detect.timed(stream), 300_000, 3)
            q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert {r.seq: r.is_alert for r in found.where("kind = 'event'").collect()} == want
    ends = found.where("kind = 'expired'").select("at_ms", "group_count", "first_seq").collect()
    assert {tuple(r) for r in ends} == {(1_700_000_002_000, 3, 2), (1_700_000_401_000, 2, 3)}
    # one key is left in the state: that of the late event, which waits
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_a_stream_of_one_hot_key(spark):
    """More events of one address than wait in its value, in any order, with ties and a gap."""
    rnd = random.Random(3)
    whole = times(spark, *(1_700_000_000_000 + rnd.choice((0, 900_000)) + rnd.randrange(400) * 1000 for _ in range(3000)))
    want = {r.seq: r.hits for r in rates.rate_limit(whole, 2, 60_000).collect()}
    got = replayed(spark, whole, lambda s: detect.rate_limit(detect.timed(s), 2, 60_000), END, runs=2).where("seq >= 0")
    assert {r.seq: r.hits for r in got.collect()} == want


def test_waiting_events_come_in_order_from_every_place():
    """The processor alone, against state kept in dictionaries."""
    rnd = random.Random(1)
    for held in (3, 10_000):
        calls, timers, waiting, value = [], set(), {}, [None]

        class Spy(detect.InOrder):
            columns = "last long"

            def arrive(self, key, ts, seqs, state):
                assert state is None or state[0] < ts
                calls.append((ts, seqs))
                return [], (ts,)

        spy = Spy()
        spy.nothing = (None,)
        spy.handle = SimpleNamespace(registerTimer=timers.add, deleteTimer=timers.discard)
        spy.held = SimpleNamespace(get=lambda: value[0], update=lambda v: value.__setitem__(0, v), clear=lambda: value.__setitem__(0, None))
        spy.waiting = SimpleNamespace(getValue=lambda k: waiting.get(k), updateValue=waiting.__setitem__, removeKey=waiting.pop)
        events_, before = [(rnd.randrange(1, 600) * 1000, i) for i in range(300)], detect.HELD_EVENTS
        detect.HELD_EVENTS = held
        try:
            mark = 0
            for stop in (100_000, 250_000, 251_000, 10_000_000):
                some = [e for e in events_ if mark < e[0] <= stop + 50_000 and e not in [(t, s) for t, ss in calls for s in ss]]
                fresh = [e for e in some if e[1] not in {s for v in list(waiting.values()) for s in v[1]} | set(value[0][2] if value[0] else [])]
                if fresh:
                    list(spy.handleInputRows(("k",), iter([SimpleNamespace(ts_ms=t, seq=s) for t, s in fresh]), None))
                for t in sorted(t for t in timers if t <= stop):
                    timers.discard(t)
                    list(spy.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: stop), SimpleNamespace(getExpiryTimeInMs=lambda: t)))
                mark = stop
        finally:
            detect.HELD_EVENTS = before
        want = {}
        for ts, seq in sorted(events_):
            want.setdefault(ts, []).append(seq)
        assert calls == sorted(want.items()) and not waiting


def test_stream_limits_agree_with_batch_over_unordered_rows(spark):
    ms = [1_700_000_000_000 + t for t in (50, 0, 60, 60, 100, 161, 400, 161, 90_000, 90_060)]
    whole = times(spark, *ms)
    want = {r.seq: r.hits for r in rates.rate_limit(whole, 2, 60).collect()}
    got = replayed(spark, whole, lambda s: detect.rate_limit(detect.timed(s), 2, 60), END).where("seq >= 0")
    assert {r.seq: r.hits for r in got.collect()} == want


def test_replay_of_no_events(spark):
    assert replayed(spark, times(spark, 1).where("false"), lambda s: detect.high_volume(detect.timed(s))).count() == 0


def test_time_parameters_are_strict():
    assert [filters.time_parameter(t) for t in (None, "1970-01-01T00:00:01Z", "1970-01-01T01:00:00+01:00", "1970-01-01")] == [None, 1000, 0, 0]
    with pytest.raises(ValueError, match="Invalid timestamp"):
        filters.time_parameter("yesterday")


def test_late_rows_are_counted(spark, tmp_path):
    base = 1_700_000_000_000
    for t in (base + 3_600_000, base):
        times(spark, t).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(times(spark, t).schema).parquet(f"{tmp_path}/in")
        q = detect.brute_force(detect.timed(stream, "1 minute"), 1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert detect.late_rows(q) == 1


def test_ranges_of_every_width(spark):
    rows = [(0x01020304, 0x01020304, "one"), (0x0102FFF8, 0x01030007, "over a border"), (0x02000000, 0x02FFFFFF, "wide"), (0x02030000, 0x020300FF, "inner"), (0x09000005, 0x09000001, "backwards")]
    ranges = spark.createDataFrame([(a, b, "XX", n, None, None, None, None, None) for a, b, n in rows], f"ip_from long, ip_to long, {geo.PLACE}")
    ips = spark.createDataFrame([(i,) for i in ("1.2.3.4", "1.2.3.5", "1.2.255.247", "1.2.255.248", "1.3.0.7", "1.3.0.8", "2.0.0.0", "2.255.255.255", "2.3.0.255", "9.0.0.3", "bad", None)], "ip string")
    got = {r.ip: r.country_name for r in geo.resolve(ips, geo.known_prefixes(spark), ranges).collect() if r.geo_source == "range"}
    assert got == {"1.2.3.4": "one", "1.2.255.248": "over a border", "1.3.0.7": "over a border", "2.0.0.0": "wide", "2.255.255.255": "wide", "2.3.0.255": "inner"}


def test_geo_records_fall_back(spark):
    full = '{"country": {"iso_code": "NZ", "names": {"en": ""}}, "autonomous_system_number": 7}'
    rows = [("9.9.9.9/24", full), ("9.9.8.8", "{}"), ("::/8", "{}"), ("9.9.7.0/24", "{broken"), ("9.9.6.0/24", None), ("9.9.5.0/40", "{}"), (None, "{}"), ("0.0.0.0/0", "{}")]
    got = {(r.ip_from, r.ip_to): (r.country_code, r.country_name, r.city, r.asn) for r in geo_records.ranges(spark.createDataFrame(rows, "network string, record string")).collect()}
    assert got == {(0x09090900, 0x090909FF): ("NZ", "Unknown", None, 7), (0x09090808, 0x09090808): ("??", "Unknown", None, None), (0, 0xFFFFFFFF): ("??", "Unknown", None, None)}


def test_feed_is_read_anew_and_ages(spark, tmp_path):
    def feed(*rows):
        return spark.createDataFrame(list(rows), "indicator string, source string, categories array<string>, confidence int, load_seq long, cached_ms long")

    held = {"feed": feed(("9.9.9.9", "old", ["x"], 1, 0, 100)), "now": 150}
    run = detect.intel_batches(lambda: held["feed"], f"{tmp_path}/rows", 50, lambda: held["now"])
    seen = lambda n: {r.source_ip: r.intel and r.intel.source for r in spark.read.parquet(f"{tmp_path}/rows/batch={n}").collect()}
    batch = events(spark, {"ts_ms": 1, "source_ip": "9.9.9.9"}, {"ts_ms": 2, "source_ip": "8.8.8.8"})
    run(batch, 0)
    held["now"] = 151
    run(batch, 1)
    held["feed"] = feed(("9.9.9.0/24", "new", ["x"], 1, 0, 151))
    run(batch, 2)
    run(batch, 2)
    assert [seen(n)["9.9.9.9"] for n in range(3)] == ["old", None, "new"] and seen(2)["8.8.8.8"] is None
    assert replayed_batches(spark, batch.where("false"), lambda path: detect.intel_batches(lambda: held["feed"], path, 50, lambda: 151)).count() == 0


def test_repeats_are_quiet_over_batches(spark):
    ms = [1_700_000_000_000 + t for t in (0, 1_800_000, 3_600_001, 3_600_002, 9_000_000)]
    whole = times(spark, *ms, payload="x")
    got = replayed(spark, whole, lambda s: detect.quiet_repeats(detect.timed(s), ["source_ip", "payload"]), END).where("seq >= 0")
    assert {r.seq for r in got.collect()} == {r.seq for r in rules.first_in_window(whole, ["source_ip", "payload"]).collect()} == {0, 2, 4}


def test_sessions_are_written_by_date(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0, "start", ""), ("b", 86_400_000, 1, "start", "")], "session_id string, ts_ms long, seq long, kind string, data string")
    delivery.write_sessions(delivery.session_documents(rows), f"{tmp_path}/s")
    back = spark.read.text(f"{tmp_path}/s")
    assert {str(r.date): json.loads(r.value)["session_id"] for r in back.collect()} == {"1970-01-01": "a", "1970-01-02": "b"}


def test_summary_lines(spark):
    found = fingerprints.fingerprints(times(spark, 1, 501, 1001, dest_port=1)).select(summaries.fingerprint().alias("s")).first().s
    assert found.startswith("[HUMAN] 1.2.3.4 | confidence=") and "| 3 events avg_gap=0.50s | signals=[" in found
    assert "timing=n/a" in fingerprints.fingerprints(times(spark, 1)).select(summaries.fingerprint().alias("s")).first().s
    token = spark.createDataFrame([("0123456789", "API_KEY", "x")], "token_id string, token_type string, label string")
    assert token.select(summaries.canary_token().alias("s")).first().s == "[01234567] API_KEY: x"
    profile = spark.createDataFrame([("ab", "LOW", 5, 3, 2, 9, "none")], "campaign_id string, tier string, risk_score int, total_events long, unique_ips long, span_s long, checks string")
    assert profile.select(summaries.campaign().alias("s")).first().s == "[ab] tier=LOW score=5 events=3 ips=2 span=9s checks=none"


def test_owned_tables_are_of_their_thread(spark):
    with ThreadPoolExecutor(1) as other, tables.owned_tables():
        with tables.owned_tables():
            theirs = other.submit(tables.materialize, times(spark, 1), "theirs").result()
            ours = tables.materialize(times(spark, 1), "ours")
        assert theirs.count() == 1
        with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
            ours.count()


def test_only_sent_files_are_uploads(spark):
    """A GET of an upload path neither escalates nor is detected."""
    base = {"service": "http", "path": "/upload", "payload": "x"}
    rows = events(spark, base | {"ts_ms": 0}, {"ts_ms": 1, "payload": "; id"}, base | {"ts_ms": 2_000_000}, {"ts_ms": 2_000_001, "payload": "; id"})
    rows = rows.withColumn("method", F.when(F.col("seq") == 0, "GET").when(F.col("seq") == 2, "put"))
    assert [r.seq for r in rules.escalations(rows).collect()] == [3]
    assert [r.ts_ms for r in rules.detections(rows).where("rule = 'upload'").collect()] == [2_000_000]


def test_patterns_with_either_quote_in_any_case(spark):
    patterns = ["[ipv4-addr:value = '1.2.3.4']", '[IPV4-ADDR:Value="1.2.3.5"]', "[ipv4-addr:value = '2.0.0.0/8' OR ipv4-addr:value=\"1.2.3.6\"]", "[domain-name:value = '1.2.3.7']", "[ipv4-addr:value = 'x']"]
    texts = spark.createDataFrame([(json.dumps({"objects": [{"type": "indicator", "id": "i", "pattern": p} for p in patterns]}),), ("{broken",)], "value string")
    assert sorted(r.indicator for r in feeds.stix2_json(texts, feeds.Feed("s")).collect()) == ["1.2.3.4", "1.2.3.5", "1.2.3.6", "2.0.0.0/8"]


def test_private_addresses_of_both_kinds(spark):
    want = {"::1": True, "0:0:0:0:0:0:0:1": True, "fc00::5": True, "FDab::": True, "fe00::1": False, "2001:db8::1": False, "10.1.1.1": True, "8.8.8.8": False, "bad": False}
    got = {r.ip: r for r in geo.resolve(spark.createDataFrame([(i,) for i in want], "ip string"), geo.known_prefixes(spark)).collect()}
    assert {i: r.is_private for i, r in got.items()} == want and {r.country_code for i, r in got.items() if want[i]} == {"--"}


def test_cef_has_the_source_port_or_none(spark):
    rows = events(spark, {"ts_ms": 5}, {"ts_ms": 6}).withColumn("port", F.when(F.col("seq") == 0, 4711))
    lines = [r.c for r in rows.select(siem.cef("v", "p", source_port=F.col("port")).alias("c")).collect()]
    assert "src=1.2.3.4 spt=4711 rt=5" in lines[0] and "src=1.2.3.4 rt=6" in lines[1]


def test_merged_ids_do_not_depend_on_order_or_partitions(spark):
    rows = times(spark, *range(200)).withColumn("campaign", F.col("seq") % 3)
    ids = lambda df: {r.campaign: r.campaign_id for r in campaigns.merged_ids(df).collect()}
    assert ids(rows) == ids(rows.orderBy(F.rand(3)).repartition(7)) and len(set(ids(rows).values())) == 3
    assert ids(rows.where("seq <> 5"))[2] != ids(rows)[2] and ids(rows.where("seq <> 5"))[0] == ids(rows)[0]
    assert campaigns.merged_ids(rows.where("false")).count() == 0


def test_profiles_come_once_over_restarts_and_repeated_batches(spark, tmp_path):
    hour = 3_600_000
    rows = times(spark, *(472_222 * hour + t for t in (0, 60_000, hour, hour + 5, 2 * hour, 3 * hour + 700_000)))
    run = detect.profile_batches(f"{tmp_path}/p")
    for number, part in enumerate(("seq < 3", "seq in (3, 4)", "seq = 5")):
        run(rows.where(part), number)
        run(rows.where(part), number)
    got = spark.read.parquet(f"{tmp_path}/p").orderBy("campaign").collect()
    assert [(r.campaign - 472_222 * hour, r.total_events, r.batch) for r in got] == [(0, 2, 1), (hour, 2, 2), (2 * hour, 1, 2)]


def test_a_hot_address_is_many_partitions(spark):
    """One address with most of the events: results as without buckets, and no partition with more than its share."""
    rnd = random.Random(9)
    rows = [{"ts_ms": rnd.choice((0, 7_000, 50_000)) * 10 + rnd.randrange(3000), "source_ip": "1.1.1.1" if i % 3 else f"2.2.2.{i % 50}", "sensor_host": f"h{rnd.randrange(9)}"} for i in range(1500)]
    df = events(spark, *rows)
    plain = sorted((r["source_ip"], r["ts_ms"], i, r["sensor_host"]) for i, r in enumerate(rows))
    hits, different = {}, {}
    for n, (ip, ts, seq, host) in enumerate(plain):
        inside = [e for e in plain[: n + 1] if e[0] == ip and e[1] >= ts - 20]
        hits[seq] = len(inside)
        if host not in {e[3] for e in inside[:-1]}:
            different[seq] = len({e[3] for e in inside})
    assert {r.seq: r.hits for r in rates.rate_limit(df, 3, 20).collect()} == hits
    assert {r.seq for r in rates.over_limit(df, 3, 20).where("triggered").collect()} == {s for s, n in hits.items() if n > 3}
    assert {r.seq: r.n for r in rates.distinct_in_window(df, ["source_ip"], "sensor_host", 20).collect()} == different
    sizes = rates.haloed(df, 20).groupBy("source_ip", "__bucket").count()
    assert sizes.agg(F.max("count")).first()[0] < 1000 / 10 and rates.haloed(df, 20).count() < 1.5 * len(rows)


def interval_rows(spark, rows):
    return spark.createDataFrame([(k, a, b, (n,)) for k, a, b, n in rows], "kind int, low string, high string, row struct<name:int>")


@pytest.mark.parametrize("seed", range(3))
def test_intervals_that_overlap_agree_with_brute_force(spark, seed):
    """Any overlaps, both ends of the space, equal starts, repeats, ones that end before they start; points on and beside every end, repeated, null and of a kind without intervals."""
    rng = random.Random(seed)
    top, known = {2: 255, 6: (1 << 24) - 1}, []
    for kind, last in top.items():
        ends = [sorted(rng.choices(range(last + 1), k=2)) for _ in range(40)] + [[0, last], [last, last], [0, 0], [9, 5], [7, 9], [7, 8], [7, 8]]
        known += [(kind, a, b, i % 45) for i, (a, b) in enumerate(ends)]
    width = {2: 2, 6: 6}
    asked = [(k, p) for k, a, b, _ in known for p in (a - 1, a, b, b + 1) if 0 <= p <= top[k]] * 2
    points = [(i, k, f"{p:0{width[k]}x}") for i, (k, p) in enumerate(asked)] + [(-1, None, "05"), (-2, 2, None), (-3, 3, "005"), (-4, 7, "0000000")]
    df = spark.createDataFrame(points, "id int, kind int, row_at string").withColumn("low", F.lit("clash")).repartition(3)
    got = {r.id: r.row and r.row.name for r in intervals.covering(df, interval_rows(spark, [(k, f"{a:0{width[k]}x}", f"{b:0{width[k]}x}", n) for k, a, b, n in known]), "row_at").collect()}
    want = {i: None for i in (-1, -2, -3, -4)}
    for i, (kind, p) in enumerate(asked):
        over = [(a, -b, n) for k, a, b, n in known if k == kind and a <= p <= b]
        want[i] = max(over)[2] if over else None
    assert got == want


def test_intervals_of_empty_tables(spark):
    points = spark.createDataFrame([(1, "0a")], "kind int, at string")
    assert [r.row for r in intervals.covering(points, interval_rows(spark, []), "at").collect()] == [None]
    assert intervals.covering(points.where("false"), interval_rows(spark, [(1, "00", "ff", 1)]), "at").count() == 0


def test_crowded_network_is_no_hot_key(spark):
    """A third of the points lie in one interval: they are spread over the ranges, and each asks once."""
    points = spark.range(30_000).select(F.lit(1).alias("kind"), F.lower(F.lpad(F.hex(F.when(F.col("id") % 3 == 0, F.lit(0xAB0000) + F.col("id")).otherwise(F.col("id") * 500)), 8, "0")).alias("at"))
    found = intervals.covering(points, interval_rows(spark, [(1, "00ab0000", "00abffff", 1), (1, "00000000", "ffffffff", 0)]), "at")
    assert found.where("row.name = 1").count() == points.where("at between '00ab0000' and '00abffff'").count() and found.count() == 30_000


def test_successor(spark):
    rows = spark.createDataFrame([("00",), ("0f",), ("9f",), ("ff",), ("19",), (None,)], "d string")
    assert [r.s for r in rows.select(intervals.successor(F.col("d")).alias("s")).collect()] == ["01", "10", "a0", None, "1a", None]


def test_geo_spans_of_both_kinds(spark):
    rows = [("9.9.9.9/24", "{}"), ("::/0", "{}"), ("2001:DB8::7", "{}"), ("2001:db8::/33", "{}"), ("9.9.7.0/24", "{broken"), ("9.9.6.0/24", None), ("x", "{}"), (None, "{}"), ("0.0.0.0/0", "{}"), ("128.0.0.0/3", "{}")]
    got = {(r.low, r.high) for r in geo_records.spans(spark.createDataFrame(rows, "network string, record string")).collect()}
    one = "20010db8" + "0" * 23 + "7"
    assert got == {("09090900", "090909ff"), ("0" * 32, "f" * 32), (one, one), ("20010db8" + "0" * 24, "20010db87" + "f" * 23), ("0" * 8, "f" * 8), ("80000000", "9fffffff")}


def test_lake_opens_only_the_dates_asked_for(spark, tmp_path):
    day, path = lake.DAY_MS, str(tmp_path / "lake")
    rows = times(spark, *(END + i * day for i in range(5)), None)
    lake.write_dates(rows, path)
    found = lake.read(spark, path, rows.schema, END + day, END + 2 * day)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.seq for r in found.collect()) == [1, 2, 5]
    assert sorted(r.seq for r in lake.read(spark, path, rows.schema, END + day, END + 2 * day, untimed=False).collect()) == [1, 2]
    read = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "date" in read(lake.retained(spark, path, rows.schema, END + 90 * day)).split("PartitionFilters: [")[1].split("]")[0]
    assert {r.f.split("date=")[1].split("/")[0] for r in found.select(F.input_file_name().alias("f")).distinct().collect()} == {str(lake.day(END + day)), str(lake.day(END + 2 * day)), "__HIVE_DEFAULT_PARTITION__"}


def test_late_rows_write_their_dates_only(spark, tmp_path):
    import glob
    import os

    day, path = lake.DAY_MS, str(tmp_path / "lake")
    assert lake.merge(times(spark), path) == 0
    assert lake.merge(times(spark, END, END + day, END + 2 * day, None), path) == 4
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/date=*/*.parquet")}
    late = events(spark, {"seq": 1, "ts_ms": END + day, "service": "ftp"}, {"seq": 1, "ts_ms": END + day, "service": "a"}, {"seq": 9, "ts_ms": END + day + 5}, {"seq": 3, "ts_ms": None, "service": "api"})
    for _ in range(2):
        assert lake.merge(late, path) == 2
        got = {(r.seq, r.service, r.ts_ms) for r in lake.read(spark, path, late.schema).collect()}
        assert got == {(0, "ssh", END), (1, "ftp", END + day), (9, "ssh", END + day + 5), (2, "ssh", END + 2 * day), (3, "api", None)}
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/date=*/*.parquet")}
    untouched = [str(lake.day(END)), str(lake.day(END + 2 * day))]
    assert all(after.get(f) == t for f, t in before.items() if any(d in f for d in untouched))


def test_lake_expires_whole_dates_and_the_edge(spark, tmp_path):
    day, path = lake.DAY_MS, str(tmp_path / "lake")
    start = END // day * day
    rows = times(spark, start, start + day, start + day + 10, start + day + 20, start + 2 * day, None)
    lake.write_dates(rows, path)
    assert lake.expire(spark, path, rows.schema, start + day + 10 + 90 * day) == [lake.day(start)]
    for _ in range(2):
        assert sorted(r.seq for r in lake.read(spark, path, rows.schema).collect()) == [2, 3, 4, 5]
        assert lake.expire(spark, path, rows.schema, start + day + 10 + 90 * day) == []
    assert lake.expire(spark, path, rows.schema, start + day + 21 + 90 * day) == [lake.day(start + day)]
    assert sorted(r.seq for r in lake.read(spark, path, rows.schema).collect()) == [4, 5]


def test_a_target_gets_no_row_twice(spark, tmp_path):
    path, sent = str(tmp_path / "ledger"), str(tmp_path / "sent")

    def keeper(name, refused=""):
        def send(values):
            import os
            import uuid

            if refused and any(v.startswith(refused) for v in values):
                raise ConnectionError(refused)
            os.makedirs(f"{sent}/{name}", exist_ok=True)
            with open(f"{sent}/{name}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(values))

        return send

    def got(name):
        import glob

        return sorted(v for p in glob.glob(f"{sent}/{name}/*") for v in open(p).read().split("\n"))

    rows = spark.createDataFrame([(i, f"{'bad' if i % 4 == 3 else 'good'}{i}") for i in range(8)], "seq long, value string").repartition(8, "seq").orderBy("seq")
    for _ in range(2):
        with pytest.raises(delivery.Undelivered, match="batch 5"):
            delivery.delivered_once(path, lambda b: b, {"a": keeper("a"), "b": keeper("b", "bad")})(rows, 5)
    delivery.delivered_once(path, lambda b: b, {"a": keeper("a"), "b": keeper("b")})(rows, 5)
    delivery.delivered_once(path, lambda b: b, {"a": keeper("a"), "b": keeper("b")})(rows, 5)
    want = sorted(r.value for r in rows.collect())
    assert got("a") == got("b") == want
    delivery.delivered_once(path, lambda b: b, {"a": keeper("a")})(rows, 6)  # another batch is no repeat
    assert got("a") == sorted(want * 2)
    assert delivery.ledger_rows(spark, f"{path}-none").count() == 0
    delivery.delivered_once(path, lambda b: b, {"a": keeper("a")})(rows.where("false"), 7)


def test_islands_agree_with_one_event_at_a_time(spark):
    """Over cells of any width, ties, null keys and events without a time."""
    rng = random.Random(5)
    rows = [{"ts_ms": rng.choice([None, rng.randrange(4000), rng.randrange(400) * 10]), "source_ip": rng.choice(["a", "b", None])} for _ in range(300)]
    df = events(spark, *rows)
    for gap in (0, 3, 40):
        got = {r.seq: (r["__island"], r["__p"]) for r in rates.islands(df, ["source_ip"], gap).collect()}
        assert len(got) == 300
        for key in ("a", "b", None):
            own = sorted((i for i, r in enumerate(rows) if r["source_ip"] == key), key=lambda i: (rows[i]["ts_ms"] is None, rows[i]["ts_ms"] or 0, i))
            island, place, last = 0, 0, None
            for i in own:
                ts = rows[i]["ts_ms"]
                new = ts is not None and last is not None and ts - last > gap
                island, place, last = island + new, 1 if new else place + 1, ts
                assert got[i] == (island, place), (gap, key, i)


def test_islands_of_a_hot_key_are_many_partitions(spark):
    """One address has a third of all events, in one island; no window partition has more than its cell."""
    gap = 1000
    df = times(spark, *range(0, 600_000, 100))
    sizes = rates.islands(df, ["source_ip"], gap).groupBy(F.floor(F.col("ts_ms") / (gap * rates.CELL_GAPS))).count()
    assert sizes.agg(F.max("count")).first()[0] == gap * rates.CELL_GAPS // 100
    assert rates.islands(df, ["source_ip"], gap).agg(F.max("__island"), F.max("__p")).first() == (0, 6000)


@pytest.mark.parametrize("least", [3, 6, 40])
def test_sketches_lose_no_window(spark, least):
    """The exact count over what the sketches leave is that over all events, wherever it reaches the bound."""
    rng = random.Random(least)
    rows = []
    for key in range(30):
        wide = key % 3 == 0  # of these alone a window can reach it
        rows += [{"ts_ms": rng.randrange(3000 if wide else 100_000), "source_ip": f"k{key}", "username": f"u{rng.randrange(2 * least if wide else least // 2)}"} for _ in range(4 * least)]
    df = events(spark, *rows)
    left = rates.reachable(df, ["source_ip"], "username", 2000, least)
    first = lambda d: {(r.source_ip, r.seq, r.n) for r in rates.distinct_in_window(d, ["source_ip"], "username", 2000).where(F.col("n") >= least).groupBy("source_ip").agg(F.min(F.struct("ts_ms", "seq", "n")).alias("f")).select("source_ip", "f.*").collect()}
    assert first(left) == first(df) and first(df)
    assert left.count() < df.count() / 2
    assert rates.reachable(df.where("false"), ["source_ip"], "username", 2000, least).count() == 0


@pytest.mark.parametrize("together", [10_000, 2])
def test_rules_as_rows_agree_with_rules_as_columns(spark, monkeypatch, together):
    """Few rules in one piece, many in parts; null services, names and addresses included."""
    monkeypatch.setattr(dedup, "RULES_TOGETHER", together)
    given = [dedup.Rule("a", service="ssh", username_regex="^ro"), dedup.Rule("b", ip_prefix="9."), dedup.Rule("c", service="ftp"), dedup.Rule("d", service="ssh", expires_ms=5), dedup.Rule("e", username_regex="x$", expires_ms=9), dedup.Rule("f", service="none")]
    table = spark.createDataFrame([(i, r.reason, r.ip_prefix, r.username_regex, r.service, r.expires_ms) for i, r in enumerate(given)], "rule_seq int, reason string, ip_prefix string, username_regex string, service string, expires_ms long")
    rows = [{"ts_ms": t, "service": s, "username": u, "source_ip": ip} for t in (5, 6, 9, 10, None) for s in ("ssh", "ftp", "api", None) for u in ("ROOT", "yX", "", None) for ip in ("9.1.1.1", "1.1.1.1", None)]
    df = events(spark, *rows)
    want = {r.seq: r.s for r in df.select("seq", dedup.suppression(given, F.col("ts_ms")).alias("s")).collect()}
    got = dedup.suppressed_by_table(df, table)
    assert {r.seq: r.suppressed_by for r in got.collect()} == want and got.count() == len(rows)
    assert {r.suppressed_by for r in dedup.suppressed_by_table(df, table.where("false")).collect()} == {None}


class FakeHandle:
    """State of one key in dicts."""

    def __init__(self):
        self.value, self.items, self.timers = None, {}, set()

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def getMapState(self, *_):
        return SimpleNamespace(getValue=self.items.get, updateValue=self.items.__setitem__, removeKey=self.items.pop)

    def registerTimer(self, at):
        self.timers.add(at)

    def tick(self, queue, now):
        at = min(self.timers)
        assert at <= now
        self.timers.remove(at)
        clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
        return [(r.event, r.seq, r.attempt, r.queue_depth) for r in queue.handleExpiredTimer(("t",), clock, SimpleNamespace(getExpiryTimeInMs=lambda: at))]


def failures(*rows):
    return iter([SimpleNamespace(seq=seq, value=str(seq), enqueued_ms=ms, error="down") for seq, ms in rows])


def test_queue_in_state_keeps_the_newest_and_makes_up_for_late_ticks():
    sent = []

    def resend(value, attempts):
        if value == "3" and attempts < 3:
            raise ConnectionError("down")
        sent.append((value, attempts))

    queue, handle = retries.Queue(resend, 3, 10), FakeHandle()
    queue.init(handle)
    at = lambda now: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
    got = [(r.event, r.seq, r.queue_depth) for r in queue.handleInputRows(("t",), failures((1, 5), (0, None), (2, 6), (3, 7)), at(100))]
    retry, dropped = retries.RETRY, retries.DROPPED
    assert sorted(got) == sorted([(retry, 1, 1), (retry, 0, 2), (retry, 2, 3), (retry, 3, 3), (dropped, 0, 3)])
    assert handle.timers == {110} and len(handle.items) == 3
    # two ticks are due, and the order is that of the queue
    assert handle.tick(queue, 120) == [("delivered", 1, 2, 2), ("delivered", 2, 2, 1)]
    # a new row is behind the one that waits; the timer stays
    assert [r.seq for r in queue.handleInputRows(("t",), failures((4, 8)), at(125))] == [4] and handle.timers == {130}
    assert handle.tick(queue, 130) == [(retry, 3, 2, 2)]
    # the oldest of the queue falls out, with its attempts
    got = [(r.event, r.seq, r.attempt) for r in queue.handleInputRows(("t",), failures((5, 9), (6, 9)), at(135))]
    assert got == [(retry, 5, 1), (retry, 6, 1), (dropped, 4, 1)]
    # however late, no row is taken twice in one batch
    assert handle.tick(queue, 10_000) == [(retry, 3, 3, 3), ("delivered", 5, 2, 2), ("delivered", 6, 2, 1)]
    assert handle.tick(queue, 10_010) == [("delivered", 3, 4, 0)]
    assert (handle.value, handle.items, handle.timers) == (None, {}, set())
    assert sent == [("1", 1), ("2", 1), ("5", 1), ("6", 1), ("3", 3)]


def test_retry_stream_of_no_failures_and_one_that_never_ends(spark):
    rows = spark.createDataFrame([("a", 1, "x", 1, "down"), (None, 2, None, None, None)], "target string, seq long, value string, enqueued_ms long, error string")
    run = lambda d, done, seconds=60: replayed_by_clock(spark, d, lambda s: retries.retried(s, len_of, 5, 10), done, seconds)
    assert run(rows.where("false"), lambda found: False).count() == 0
    got = run(rows, lambda found: found.where("event = 'delivered'").count() == 2)
    assert {(r.target, r.seq, r.attempt) for r in got.where("event = 'delivered'").collect()} == {("a", 1, 2), (None, 2, 2)}
    with pytest.raises(TimeoutError):
        run(rows, lambda found: False, 6)
    with pytest.raises(ValueError):
        retries.retried(rows, len_of, 0)


def len_of(value, attempts):
    pass


def test_counts_by_hand(spark):
    df = events(spark, {"ts_ms": 0, "username": "a"}, {"ts_ms": 3_600_000, "username": "b"}, {"ts_ms": 90_000_000, "username": "b", "source_ip": "x"}, {"ts_ms": None, "username": ""}, {"ts_ms": -1, "service": "ftp", "source_ip": None})
    assert [(r.value, r.n) for r in dashboards.top_of_service(df, "ssh", "username").collect()] == [("b", 2), ("a", 1)]
    assert [(r.value, r.n) for r in dashboards.top_of_service(df, "ftp", "username", missing="none").collect()] == [("none", 1)]
    assert {(r.service, r.n) for r in dashboards.unique_by_service(df).collect()} == {("ssh", 2), ("ftp", 0)}
    assert {(r.hour, r.n) for r in dashboards.hours_of_day(df).collect()} == {(0, 1), (1, 2), (None, 1), (23, 1)}
    assert {(r.value, r.n, r.per_hour) for r in dashboards.event_rates(df).collect()} == {("1.2.3.4", 3, 3.0), ("x", 1, 1.0), (None, 1, 1.0)}
    assert dashboards.top_of_service(df.where("false"), "ssh", "username").count() == 0


def test_pieces_of_a_session_are_bounded(spark):
    rng = random.Random(7)
    ms = [rng.choice([None, rng.randrange(100)]) for _ in range(50)]
    df = times(spark, *ms).select(F.lit("s").alias("session_id"), "ts_ms", "seq", F.col("service").alias("kind"), F.col("path").alias("data"))
    got = sorted(rates.pieces(df, ["session_id"], 7, 10).collect(), key=lambda r: (r.ts_ms is None, r.ts_ms or 0, r.seq))
    assert [r.piece for r in got] == [i // 7 for i in range(50)]
    docs = [json.loads(r.value) for r in delivery.session_documents(df, piece_events=7).orderBy("piece").collect()]
    assert [(d["piece"], len(d["events"])) for d in docs] == [(i, 7 if i < 7 else 1) for i in range(8)]
    assert [e["n"] for e in docs[0]["events"]] == list(range(1, 8))
    assert sessions.timeline(df, piece_events=20).agg(F.max(F.size("timeline")), F.count(F.lit(1))).first() == (20, 3)
    assert delivery.session_documents(df.where("false"), piece_events=7).count() == 0


def test_camp006_agrees_with_places_one_by_one(spark):
    words, rng = ["admin", "p@ss", "Summer2024", "xyz", "root", ""], random.Random(3)
    rows = [{"ts_ms": rng.randrange(20), "source_ip": rng.choice(["a", "b", "c", "d", None]), "password": rng.choice(words)} for _ in range(60)]
    df = events(spark, *rows).withColumn("campaign", F.lit(0))
    kinds = {r.password: (r.c, r.t) for r in df.select("password", fields.is_common_word(F.col("password")).alias("c"), fields.is_targeted(F.col("password")).alias("t")).distinct().collect()}
    want = set()
    for ip in ("a", "b", "c", "d", None):
        own = sorted(((r["ts_ms"], i, r["password"]) for i, r in enumerate(rows) if r["source_ip"] == ip and r["password"]))
        half = len(own) // 2
        if any(kinds[p][0] for *_, p in own[:half]) and any(kinds[p][1] for *_, p in own[half:]):
            want.add(ip)
    got = campaigns.camp006(df).collect()
    assert want and {r.evidence for r in got} == {f"{len(want)} addresses"}


def test_risk_gathers_no_ids(spark):
    found = lateral.findings(times(spark, 1, 2, source_ip="10.0.0.1"), {"LATM-004": lateral.latm004})
    assert lateral.risk(found).first().findings == 1
    assert "collect_" not in lateral.risk(found)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["n23_lateral_summary", "a15_lateral_risk", "a16_by_severity"])
def test_counts_of_findings_read_no_event_twice(spark, name):
    """A count needs the keys that fire; their events, met in an inner join, are for the lists. No window goes over a whole address."""
    from sundew.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan
    assert all("__bucket" in line for line in plan.splitlines() if " Window [" in line or line.lstrip(" :+-").startswith("Window ["))


def test_rated_has_a_row_for_each_finding(spark):
    """Also where addresses, names, outcomes or times are null; an event without an address is nobody's finding."""
    rnd = random.Random(7)
    pick = lambda *v: rnd.choice(v)
    rows = [{"ts_ms": pick(None, *(rnd.randrange(400_000) for _ in range(9))), "source_ip": pick("10.0.0.1", "b", "c", f"d{i % 60}", f"e{i % 90}", None), "sensor_host": pick("x", "y", "z", None), "username": pick(*"uvwstr", "", None), "password": pick("p", "q", None), "success": pick(True, False, False, None)} for i in range(600)]
    df = events(spark, *rows)
    found = lateral.findings(df)
    count = lambda d: {tuple(r) for r in d.groupBy("check_id", "weight", "severity").count().collect()}
    assert count(lateral.rated(df)) == count(found) and {c for c, *_ in count(found)} == set(lateral.CHECKS)
    assert found.where("subject is null").count() == 0
    assert lateral.risk(lateral.rated(df)).first() == lateral.risk(found).first()


def test_latm007_agrees_with_places_in_a_hot_key(spark):
    rnd = random.Random(11)
    rows = [{"ts_ms": rnd.randrange(900_000) + (rnd.randrange(4) * 60_000 if i % 2 else 0), "source_ip": rnd.choice("aaab")} for i in range(200)]
    found, want = {r.subject: r.event_ids for r in lateral.latm007(events(spark, *rows)).collect()}, {}
    for ip in "ab":
        at = sorted((r["ts_ms"], i) for i, r in enumerate(rows) if r["source_ip"] == ip)
        hit = next((n for n in range(10, len(at)) if at[n][0] - at[n - 10][0] <= 60_000), None)
        if hit is not None:
            want[ip] = [i for t, i in at[: hit + 1] if t >= at[hit][0] - 60_000]
    assert found == want and "a" in want


def test_latm005_agrees_with_pairs_and_looks_at_no_whole_key(spark):
    rnd, five = random.Random(5), 300_000
    for spread in (40, 3_000):
        ms = [1_200_000 + rnd.randrange(-spread, spread) * 1000 for _ in range(120)]
        rows = [{"ts_ms": t, "source_ip": rnd.choice("ab"), "sensor_host": rnd.choice("xyy"), "success": rnd.random() < 0.3} for t in ms] + [{"ts_ms": 0, "source_ip": "c", "sensor_host": "x", "success": True}, {"ts_ms": five, "source_ip": "c", "sensor_host": "y"}]
        found, want = lateral.latm005(events(spark, *rows)), {}
        at = sorted((r["ts_ms"], i, r) for i, r in enumerate(rows))
        for t, i, r in at:
            after = [(u, j) for u, j, o in at if (u, j) > (t, i) and u - t <= five and o["source_ip"] == r["source_ip"] and o["sensor_host"] != r["sensor_host"]]
            if r.get("success") and after:
                want.setdefault(r["source_ip"], [i, after[0][1]])
        assert {r.subject: r.event_ids for r in found.collect()} == want and "c" in want
        # a frame that ends with the key is gone through anew for every row
        assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_feeds_and_places_read_the_events_once(spark):
    """What is made of the addresses comes from a written table, not from the events once for each kind of row."""
    from sundew.queries import QUERIES
    from sundew.queries.joins import feed_of
    from sundew.plans.events import attack_events

    sf = "/root/testdata/sf0.001"
    for df in (feed_of(attack_events(spark, sf)), QUERIES["s20_geo_spans"](spark, sf)):
        assert df.inputFiles() and not [f for f in df.inputFiles() if f.endswith("/events.parquet")]


def test_rows_of_a_key_leave_in_pieces():
    """No more rows are made than the piece that leaves, and numbers beside nulls stay whole."""
    from sundew.streaming.pieces import PIECE_ROWS, InPieces

    sent, made = InPieces(retries.Queue(len_of, 3, 10), [c.split()[0] for c in retries.OUT.split(", ")], ["seq", "enqueued_ms"]), []
    sent.init(FakeHandle())

    def frames():
        for i in range(4):
            made.append(i)
            n = 2 * PIECE_ROWS
            yield pd.DataFrame({"target": ["t"] * n, "seq": [str((1 << 60) + i * n + j) for j in range(n - 1)] + [None], "value": ["v"] * n, "enqueued_ms": ["5"] * n, "error": [None] * n})

    pieces = sent.handleInputRows(("t",), frames(), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0))
    first = next(pieces)
    assert made == [0] and len(first) == PIECE_ROWS and first["seq"][0] == 1 << 60
    rest = list(pieces)
    assert max(map(len, rest)) <= PIECE_ROWS and len(first) + sum(map(len, rest)) == 16 * PIECE_ROWS - 3 and sum(f["seq"].isna().sum() for f in rest) >= 4


def test_campaign_events_are_not_broadcast(spark):
    """Written events look small to the planner; the keys they meet are the side that is built."""
    df = events(spark, {"ts_ms": 1, "password": "root"}).withColumn("campaign", F.lit(0))
    assert "ShuffledHashJoin" in campaigns.camp006(df)._jdf.queryExecution().executedPlan().toString()
