"""Queries that run as streams to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.operators import filters, geo
from sundew.plans.events import T0
from sundew.plans.tables import materialize
from sundew.queries.aggregates import _DO, _UP
from sundew.queries.joins import _FEED, _GEO, _HIT, feed_of
from sundew.queries.registry import SQL, over_events
from sundew.queries.sequences import _DEDUP, _SESSIONS, RULES
from sundew.streaming import detect, retries
from sundew.streaming.run import replayed, replayed_batches, replayed_by_clock

END = T0 + 10 * 86_400_000


@over_events("ws1_stream_dedup", _DEDUP + "SELECT seq, is_alert, group_count, first_seq FROM d WHERE suppressed_by IS NULL")
def _(hp: DataFrame) -> DataFrame:
    return replayed(hp.sparkSession, hp, lambda s: detect.dedup(detect.timed(s), 1_800_000, 3, RULES), END, runs=1).where("seq >= 0")


@over_events("ws1_stream_groups", _DEDUP + ", q AS (SELECT *, min_by(seq, p) OVER (PARTITION BY source_ip, service, key, island, (p - 1) // 2) AS first_seq FROM p) SELECT source_ip, service, count(*) AS events, arg_max(first_seq, p) AS first_seq, max(ts_ms) AS last_ms FROM q GROUP BY source_ip, service, key, island")
def _(hp: DataFrame) -> DataFrame:
    """The runs of events of every key, as their timers end them."""
    found = replayed(hp.sparkSession, hp, lambda s: detect.dedup_groups(detect.timed(s), 1_800_000, 3, RULES), END, runs=1)
    return found.where("kind = 'expired' and source_ip <> 'closing'").select("source_ip", "service", F.col("group_count").alias("events"), "first_seq", F.col("at_ms").alias("last_ms"))


@over_events("ws2_stream_rate_limit", "SELECT seq, (count(*) OVER (PARTITION BY source_ip ORDER BY ts_ms RANGE BETWEEN 120000 PRECEDING AND CURRENT ROW) - (count(*) OVER t - row_number() OVER (PARTITION BY source_ip, ts_ms ORDER BY seq)))::BIGINT AS hits FROM hp WINDOW t AS (PARTITION BY source_ip, ts_ms)")
def _(hp: DataFrame) -> DataFrame:
    return replayed(hp.sparkSession, hp.select("seq", "ts_ms", "source_ip"), lambda s: detect.rate_limit(detect.timed(s), 3, 120_000), END, runs=1).where("seq >= 0").select("seq", "hits")


@over_events("ws3_stream_bursts", "SELECT seq, row_number() OVER (PARTITION BY service, ts_ms // 600000 ORDER BY ts_ms, seq)::BIGINT AS n FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return replayed(hp.sparkSession, hp, lambda s: detect.running_count(detect.timed(s), "service", 600_000), END, runs=1).where("seq >= 0").select("seq", "n")


@over_events("ws4_stream_sessions", _SESSIONS + "SELECT source_ip, start_ms, end_ms, events, phase, score, severity FROM v")
def _(hp: DataFrame) -> DataFrame:
    found = replayed(hp.sparkSession, hp, lambda s: detect.sessions(detect.timed(s)), END, runs=2)
    return found.where("source_ip <> 'closing'").select("source_ip", "start_ms", "end_ms", "events", "phase", "score", "severity")


@over_events("ws5_stream_brute_force", "SELECT source_ip, service, ts_ms - ts_ms % 300000 AS window_ms, count(*) AS attempts FROM hp WHERE service IN ('ssh', 'ftp', 'api') AND NOT success GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def _(hp: DataFrame) -> DataFrame:
    return replayed(hp.sparkSession, hp, lambda s: detect.brute_force(detect.timed(s), 3), END, runs=2)


@over_events("ws5_stream_lateral", "SELECT source_ip, ts_ms - ts_ms % 600000 AS window_ms, count(DISTINCT service)::INTEGER AS services, count(DISTINCT dest_port)::INTEGER AS ports FROM hp GROUP BY 1, 2 HAVING count(DISTINCT service) >= 3 OR count(DISTINCT dest_port) >= 5")
def _(hp: DataFrame) -> DataFrame:
    return replayed(hp.sparkSession, hp, lambda s: detect.lateral_behaviour(detect.timed(s)), END, runs=2).select("source_ip", "window_ms", "services", "ports")


@over_events("ws5_stream_high_volume", "SELECT source_ip, ts_ms - ts_ms % 300000 AS window_ms, count(*) AS events FROM hp WHERE service = 'ssh' GROUP BY 1, 2 HAVING count(*) > 2")
def _(hp: DataFrame) -> DataFrame:
    return replayed(hp.sparkSession, hp, lambda s: detect.high_volume(detect.timed(s), most=2), END, runs=2)


@over_events("ws5_stream_escalations", f"WITH u AS (SELECT source_ip, ts_ms FROM hp WHERE {_UP}) SELECT seq, source_ip, ts_ms FROM hp c WHERE {_DO} AND EXISTS (SELECT 1 FROM u WHERE u.source_ip = c.source_ip AND abs(u.ts_ms - c.ts_ms) <= 900000)")
def _(hp: DataFrame) -> DataFrame:
    """Two streams joined within an interval."""
    return replayed(hp.sparkSession, hp, lambda s: detect.escalations(detect.timed(s)), END, runs=2, service="ftp", payload="STOR ;.exe").where("seq >= 0")


@over_events("ws5_stream_sliding", "SELECT source_ip, service, w AS window_ms, count(*) AS attempts FROM (SELECT *, unnest(range(ts_ms - ts_ms % 60000 - 240000, ts_ms - ts_ms % 60000 + 1, 60000)) AS w FROM hp WHERE service IN ('ssh', 'ftp', 'api') AND NOT success) GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def _(hp: DataFrame) -> DataFrame:
    return replayed(hp.sparkSession, hp, lambda s: detect.brute_force(detect.timed(s), 3, slide="1 minute"), END, runs=2)


@over_events("ws5_stream_profiles")
def _(hp: DataFrame) -> DataFrame:
    """Every window is profiled once, over four runs that go on from one checkpoint."""
    return replayed_batches(hp.sparkSession, hp, detect.profile_batches, closing_ms=END)


SQL["ws5_stream_profiles"] = SQL["a11_campaign_profiles"]


@over_events("ws8_first_of_repeats", "SELECT source_ip, service, 1::BIGINT AS n FROM hp GROUP BY source_ip, service")
def _(hp: DataFrame) -> DataFrame:
    """Equal pairs within the watermark's delay, which is longer than the table here, come once."""
    found = replayed(hp.sparkSession, hp, lambda s: detect.without_repeats(s.withColumn("ts", F.timestamp_millis("ts_ms")), ["source_ip", "service"], "20 days"))
    return found.groupBy("source_ip", "service").agg(F.count(F.lit(1)).alias("n"))


@over_events("ws6_stream_enriched", f"SELECT seq, cc AS country_code FROM (SELECT {_GEO} FROM hp)")
def _(hp: DataFrame) -> DataFrame:
    places = geo.resolve(hp.select(F.col("source_ip").alias("ip")), geo.known_prefixes(hp.sparkSession)).withColumnRenamed("ip", "source_ip")
    places = materialize(places, "stream-places")
    return replayed(hp.sparkSession, hp, lambda s: detect.enriched(s, places)).select("seq", "country_code")


@over_events("ws6_stream_intel", _FEED + f", young AS (SELECT * FROM feed WHERE {T0} + 3000 - cached_ms <= 2000)" + _HIT.format(feed="young") + "SELECT seq, m.source, m.matched_cidr FROM hp JOIN m ON m.ip = hp.source_ip")
def _(hp: DataFrame) -> DataFrame:
    feed = materialize(feed_of(hp), "stream-feed")  # read anew by every batch, made once
    found = replayed_batches(hp.sparkSession, hp.select("seq", "ts_ms", "source_ip"), lambda path: detect.intel_batches(lambda: feed, path, 2000, lambda: T0 + 3000))
    return found.select("seq", F.col("intel.source").alias("source"), "matched_cidr")


@over_events("ws7_stream_canary", "SELECT user_id::VARCHAR AS key, seq, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, seq)::BIGINT AS n, min(ts_ms) OVER (PARTITION BY user_id) AS first_ms FROM hp WHERE service = 'ftp'")
def _(hp: DataFrame) -> DataFrame:
    return replayed(hp.sparkSession, hp.where("service = 'ftp'"), lambda s: detect.running_count(detect.timed(s), "user_id"), END, runs=1).where("seq >= 0")


@over_events("ws9_stream_uploads", f"WITH u AS (SELECT * FROM hp WHERE ({_UP}) AND source_ip NOT LIKE '198.20.%'), g AS (SELECT seq, ts_ms - lag(ts_ms) OVER (PARTITION BY source_ip, payload ORDER BY ts_ms, seq) AS gap FROM u) SELECT seq FROM g WHERE gap IS NULL OR gap > 1800000")
def _(hp: DataFrame) -> DataFrame:
    shown = hp.where(filters.uploads(hp) & ~F.col("source_ip").startswith("198.20."))
    return replayed(hp.sparkSession, shown, lambda s: detect.quiet_repeats(detect.timed(s), ["source_ip", "payload"]), END, runs=1).where("seq >= 0")


def back_at_the_third(value: str, attempts: int) -> None:
    """A target that takes internal addresses at the third attempt, all others at the second."""
    if value.startswith("10.") and attempts < 2:
        raise ConnectionError("down")


@over_events("s12_retry_stream", """WITH f AS (SELECT *, service AS target, row_number() OVER (PARTITION BY service ORDER BY ts_ms DESC, seq DESC) AS r FROM hp)
  SELECT target, seq, CASE WHEN r > 100 THEN 'siem_delivery_dropped' ELSE 'delivered' END AS event, CASE WHEN r > 100 THEN 1 WHEN source_ip LIKE '10.%' THEN 3 ELSE 2 END AS attempt, 1 + (r <= 100 AND source_ip LIKE '10.%')::INTEGER AS failures FROM f""")
def _(hp: DataFrame) -> DataFrame:
    """All events as failures of a target for each service: the newest 100 of each stay in its queue and are retried until they are delivered."""
    spark = hp.sparkSession
    failed = materialize(hp.select(F.col("service").alias("target"), "seq", F.col("source_ip").alias("value"), F.col("ts_ms").alias("enqueued_ms"), F.lit("down").alias("error")), "failures")
    total = failed.count()
    ended = F.col("event") != retries.RETRY
    found = replayed_by_clock(spark, failed, lambda s: retries.retried(s, back_at_the_third, 100, 10), lambda rows: rows.where(ended).count() >= total)
    last = F.max(F.when(ended, F.struct("event", "attempt")))
    return found.groupBy("target", "seq").agg(last.alias("last"), F.count_if(~ended).cast("int").alias("failures")).select("target", "seq", "last.event", "last.attempt", "failures")
