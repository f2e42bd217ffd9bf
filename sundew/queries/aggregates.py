"""Queries of counts and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.operators import dashboards, filters, rules
from sundew.plans.events import T0
from sundew.queries.registry import over_events

_UP = r"(service = 'http' AND upper(coalesce(method, '')) IN ('POST', 'PUT') AND (regexp_matches(coalesce(path, ''), '(?i)(upload|import|file|attachment)') OR regexp_matches(payload, '(?i)\.(exe|dll|ps1|bat|vbs|js|jar|elf|php)'))) OR (service = 'ftp' AND regexp_matches(payload, '(?i)^STOR\s+.*\.exe$'))"
_DO = r"service <> 'rdp' AND (regexp_matches(payload, ';') OR regexp_matches(payload, '(?i)\b(whoami|cat\s+/etc/passwd)\b'))"
_TOP = "SELECT {c} AS value, count(*) AS n, min(seq) AS seen FROM hp WHERE coalesce({c}, '') <> '' GROUP BY {c} ORDER BY n DESC, seen LIMIT {k}"


@over_events("a1_export_stats", f"WITH t AS ({_TOP.format(c='source_ip', k=10)}) SELECT 'total' AS kind, '' AS value, count(*) AS n FROM hp UNION ALL SELECT 'service', service, count(*) FROM hp GROUP BY service UNION ALL SELECT 'source_ip', value, n FROM t")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.export_stats(hp)


@over_events("a2_summary", "SELECT count(*) AS total_events, count(DISTINCT source_ip) AS unique_source_ips FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.summary(hp)


@over_events("a3_credential_reuse", "SELECT count(*) AS credential_reuse FROM (SELECT credential FROM hp WHERE credential IS NOT NULL GROUP BY credential HAVING count(DISTINCT source_ip) >= 2)")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.credential_reuse(hp)


@over_events("a4_hourly", "SELECT strftime(make_timestamp((ts_ms - ts_ms % 3600000) * 1000), '%Y-%m-%dT%H:%M:%SZ') AS hour, count(*) AS n FROM hp GROUP BY 1")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.hourly(hp)


@over_events("a6_top_users", f"SELECT value, n FROM ({_TOP.format(c='username', k=5)})")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.top_values(hp, "username", 5)


@over_events("o2_top_agents", f"SELECT value, n FROM ({_TOP.format(c='user_agent', k=3)})")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.top_values(hp, "user_agent", 3)


def _list_sql(column: str) -> str:
    return f"(SELECT string_agg(value || '=' || n, ',' ORDER BY n DESC, seen) FROM ({_TOP.format(c=column, k=10)}))"


@over_events("a7_dashboard", f"""WITH h AS (SELECT strftime(make_timestamp((ts_ms - ts_ms % 3600000) * 1000), '%Y-%m-%dT%H:%M:%SZ') || '=' || count(*) AS e FROM hp GROUP BY ts_ms - ts_ms % 3600000), v AS (SELECT service || '=' || count(*) AS e FROM hp GROUP BY service)
SELECT '2024-01-01T03:00:00Z' AS generated_at, 'all_time' AS span, (SELECT count(*) FROM hp) AS total_events, (SELECT count(DISTINCT source_ip) FROM hp) AS unique_source_ips,
  (SELECT count(*) FROM (SELECT credential FROM hp WHERE credential IS NOT NULL GROUP BY credential HAVING count(DISTINCT source_ip) >= 2)) AS credential_reuse, (SELECT string_agg(e, ',' ORDER BY e) FROM v) AS services, (SELECT string_agg(e, ',' ORDER BY e) FROM h) AS hours,
  {_list_sql('source_ip')} AS ips, {_list_sql('username')} AS users, {_list_sql('user_agent')} AS agents""")
def _(hp: DataFrame) -> DataFrame:
    """The fields of the document, read back from its JSON."""
    document = dashboards.document(filters.recent(hp, "all_time", T0), "all_time", "2024-01-01T03:00:00Z")
    entry, counts = "array<struct<value:string,count:long>>", "map<string,long>"
    schema = f"generated_at string, window string, summary struct<total_events:long,unique_source_ips:long,credential_reuse:long,events_by_service:{counts}>, top_source_ips {entry}, top_usernames {entry}, top_user_agents {entry}, hourly_distribution {counts}"
    d = document.select(F.from_json("value", schema).alias("d")).select("d.*")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))), ",")
    mapped = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ",")
    return d.select(
        "generated_at", F.col("window").alias("span"), "summary.total_events", "summary.unique_source_ips", "summary.credential_reuse", mapped("summary.events_by_service").alias("services"),
        mapped("hourly_distribution").alias("hours"), listed("top_source_ips").alias("ips"), listed("top_usernames").alias("users"), listed("top_user_agents").alias("agents"),
    )


@over_events("a31_brute_force", "SELECT source_ip, service, ts_ms - ts_ms % 300000 AS window_ms, count(*) AS attempts, array_to_string(list_sort(list_distinct(list(username))), ',') AS usernames FROM hp WHERE service IN ('ssh', 'ftp', 'api') AND NOT success GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def _(hp: DataFrame) -> DataFrame:
    return rules.brute_force(hp, 3).withColumn("usernames", F.array_join("usernames", ","))


def _tier_sql(least: int, ms: int, name: str) -> str:
    return f"SELECT source_ip, service, ts_ms - ts_ms % {ms} AS window_ms, count(*) AS attempts, '{name}' AS severity FROM hp WHERE service IN ('ssh', 'ftp', 'api') AND NOT success GROUP BY 1, 2, 3 HAVING count(*) >= {least}"


@over_events("a31_tiers", _tier_sql(3, 300_000, "Medium") + " UNION ALL " + _tier_sql(4, 600_000, "High"))
def _(hp: DataFrame) -> DataFrame:
    return rules.brute_force_tiers(hp, 3, 4)


@over_events("a32_lateral_behaviour", "SELECT source_ip, ts_ms - ts_ms % 600000 AS window_ms, count(DISTINCT service) AS services, count(DISTINCT dest_port) AS ports, CASE WHEN count(DISTINCT service) >= 3 AND count(DISTINCT dest_port) >= 5 THEN 'Critical' ELSE 'High' END AS severity FROM hp GROUP BY 1, 2 HAVING count(DISTINCT service) >= 3 OR count(DISTINCT dest_port) >= 5")
def _(hp: DataFrame) -> DataFrame:
    return rules.lateral_behaviour(hp)


@over_events("a33_high_volume", "SELECT source_ip, ts_ms - ts_ms % 300000 AS window_ms, count(*) AS events FROM hp WHERE service = 'ssh' GROUP BY 1, 2 HAVING count(*) > 2")
def _(hp: DataFrame) -> DataFrame:
    return rules.high_volume(hp, most=2)


@over_events("a34_reused_hashes", "SELECT credential, count(DISTINCT source_ip) AS ips, count(*) AS events FROM hp WHERE credential IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_ip) > 5")
def _(hp: DataFrame) -> DataFrame:
    return rules.reused_hashes(hp)


@over_events("a35_ad_hoc", "SELECT service, coalesce(user_agent, 'none') AS agent, (ts_ms // 3600000 % 24)::INTEGER AS hour_of_day, count(*) AS n, count(DISTINCT source_ip) AS ips FROM hp GROUP BY 1, 2, 3")
def _(hp: DataFrame) -> DataFrame:
    hour = (F.floor(F.col("ts_ms") / 3_600_000) % 24).cast("int")
    return hp.groupBy("service", F.coalesce("user_agent", F.lit("none")).alias("agent"), hour.alias("hour_of_day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_ip").alias("ips"))


def _top_sql(value: str, where: str, n: int) -> str:
    return f"SELECT {value} AS value, count(*) AS n FROM hp WHERE {where} GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT {n}"


@over_events("a35_top_usernames", _top_sql("username", "service = 'ssh' AND username <> ''", 10))
def _(hp: DataFrame) -> DataFrame:
    return dashboards.top_of_service(hp, "ssh", "username", 10)


@over_events("a35_top_paths", _top_sql("path", "service = 'http' AND path <> ''", 20))
def _(hp: DataFrame) -> DataFrame:
    return dashboards.top_of_service(hp, "http", "path", 20)


@over_events("a35_top_agents", _top_sql("coalesce(user_agent, 'none')", "service = 'ftp'", 10))
def _(hp: DataFrame) -> DataFrame:
    """Of a service without agents, so that what is missing is counted."""
    return dashboards.top_of_service(hp, "ftp", "user_agent", 10, "none")


@over_events("a35_unique_by_service", "SELECT service, count(DISTINCT source_ip) AS n FROM hp GROUP BY 1")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.unique_by_service(hp)


@over_events("a35_hours_of_day", "SELECT service, (ts_ms // 3600000 % 24)::INTEGER AS hour, count(*) AS n FROM hp GROUP BY 1, 2")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.hours_of_day(hp, "service")


@over_events("a35_event_rates", "SELECT source_ip AS value, count(*) AS n, count(*) / greatest((max(ts_ms) - min(ts_ms)) / 3600000, 1.0::DOUBLE) AS per_hour FROM hp GROUP BY 1")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.event_rates(hp)


@over_events("a36_alert_payloads", "SELECT source_ip, service, 'r1' AS rule, 'High' AS severity, count(*) AS events, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, coalesce(array_to_string(list_sort(list_distinct(list(path)))[1:3], ','), '') AS sample_paths, array_to_string(list_sort(list_distinct(list('s' || k % 7)))[1:3], ',') AS session_ids FROM hp GROUP BY 1, 2")
def _(hp: DataFrame) -> DataFrame:
    return rules.alert_payloads(hp.withColumn("session_id", F.concat(F.lit("s"), (F.col("k") % 7).cast("string"))), "r1", "High")


@over_events("j12_escalations", f"WITH u AS (SELECT source_ip, ts_ms FROM hp WHERE {_UP}) SELECT c.seq, c.source_ip, c.ts_ms, min(abs(u.ts_ms - c.ts_ms)) AS upload_gap_ms FROM hp c JOIN u ON u.source_ip = c.source_ip AND abs(u.ts_ms - c.ts_ms) <= 900000 WHERE {_DO} GROUP BY 1, 2, 3".replace("regexp_matches(payload, ';')", "regexp_matches(c.payload, ';')").replace("service <> 'rdp'", "c.service <> 'rdp'"))
def _(hp: DataFrame) -> DataFrame:
    return rules.escalations(hp)


@over_events("j13_correlations", f"""WITH d AS (SELECT 'upload' AS rule, source_ip, ts_ms FROM hp WHERE {_UP} UNION ALL SELECT 'command', source_ip, ts_ms FROM hp WHERE {_DO}
  UNION ALL SELECT 'brute_force', source_ip, ts_ms - ts_ms % 300000 FROM hp WHERE service IN ('ssh', 'ftp', 'api') AND NOT success GROUP BY source_ip, service, ts_ms - ts_ms % 300000 HAVING count(*) >= 3
  UNION ALL SELECT 'lateral', source_ip, ts_ms - ts_ms % 600000 FROM hp GROUP BY source_ip, ts_ms - ts_ms % 600000 HAVING count(DISTINCT service) >= 3 OR count(DISTINCT dest_port) >= 5),
w AS (SELECT a.source_ip, a.ts_ms, array_to_string(list_sort(list_distinct(list(b.rule))), ',') AS rules, count(DISTINCT b.rule) AS n FROM d a JOIN d b ON b.source_ip = a.source_ip AND b.ts_ms BETWEEN a.ts_ms - 1800000 AND a.ts_ms GROUP BY a.source_ip, a.ts_ms),
r AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY ts_ms) AS k FROM w WHERE n >= 2) SELECT source_ip, ts_ms, rules FROM r WHERE k = 1""")
def _(hp: DataFrame) -> DataFrame:
    return rules.correlations(rules.detections(hp, 3))


@over_events("ws9_tuned_uploads", f"WITH u AS (SELECT * FROM hp WHERE ({_UP}) AND source_ip NOT LIKE '198.20.%'), g AS (SELECT seq, source_ip, payload, ts_ms - lag(ts_ms) OVER (PARTITION BY source_ip, payload ORDER BY ts_ms, seq) AS gap FROM u) SELECT seq, source_ip, payload FROM g WHERE gap IS NULL OR gap > 1800000")
def _(hp: DataFrame) -> DataFrame:
    shown = hp.where(filters.uploads(hp) & ~F.col("source_ip").startswith("198.20."))
    return rules.first_in_window(shown, ["source_ip", "payload"]).select("seq", "source_ip", "payload")
