"""Queries of windows and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.functions import summaries
from sundew.operators import campaigns, dedup, geo, lateral, rates, sessions
from sundew.plans.events import T0
from sundew.queries.registry import over_events

RULES = (dedup.Rule("scanner", ip_prefix="198.20."), dedup.Rule("guest api", username_regex="^GUE", service="api"), dedup.Rule("old", service="rdp", expires_ms=T0 + 3_600_000))
_REASON = f"CASE WHEN source_ip LIKE '198.20.%' THEN 'scanner' WHEN service = 'api' AND username = 'guest' THEN 'guest api' WHEN service = 'rdp' AND ts_ms <= {T0 + 3600000} THEN 'old' END"
_DEDUP = f"""WITH m AS (SELECT seq, ts_ms, source_ip, service, coalesce(credential, '') AS key, {_REASON} AS reason FROM hp),
g AS (SELECT *, coalesce((ts_ms - lag(ts_ms) OVER w > 1800000)::INT, 0) AS new FROM m WHERE reason IS NULL WINDOW w AS (PARTITION BY source_ip, service, key ORDER BY ts_ms, seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY source_ip, service, key ORDER BY ts_ms, seq) AS island FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY source_ip, service, key, island ORDER BY ts_ms, seq) AS p FROM i),
d AS (SELECT seq, NULL AS suppressed_by, p = 1 OR (p - 1) % 2 = 0 AS is_alert, (CASE WHEN p = 1 THEN 1 WHEN (p - 1) % 2 = 0 THEN 3 ELSE 2 END)::BIGINT AS group_count,
  min_by(seq, p) OVER (PARTITION BY source_ip, service, key, island, (p - 1) // 2) AS first_seq FROM p
  UNION ALL SELECT seq, reason, false, NULL, NULL FROM m WHERE reason IS NOT NULL)
"""
_SESSIONS = """WITH g AS (SELECT *, coalesce((ts_ms - lag(ts_ms) OVER (PARTITION BY source_ip ORDER BY ts_ms, seq) > 300000)::INT, 0) AS new FROM hp),
i AS (SELECT *, sum(new) OVER (PARTITION BY source_ip ORDER BY ts_ms, seq) AS no FROM g),
a AS (SELECT source_ip, no, count(*) AS events, count(DISTINCT username) AS users, count(DISTINCT password) AS pws, count(DISTINCT service) AS services, count(*) FILTER (success) AS ok, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms FROM i GROUP BY ALL),
f AS (SELECT *, CASE WHEN ok > 0 THEN 'EXPLOITATION' WHEN users >= 10 AND pws <= 3 THEN 'CREDENTIAL_SPRAY' WHEN users >= 5 AND pws >= 5 THEN 'CREDENTIAL_STUFFING' WHEN users > 0 THEN 'BRUTE_FORCE' ELSE 'RECONNAISSANCE' END AS phase FROM a),
s AS (SELECT *, least(100, CASE phase WHEN 'EXPLOITATION' THEN 60 WHEN 'BRUTE_FORCE' THEN 40 WHEN 'RECONNAISSANCE' THEN 15 ELSE 35 END + least(20, floor(log2(events) * 3)) + least(20, ok * 5) + CASE WHEN services > 1 THEN least(10, (services - 1) * 5) ELSE 0 END)::INTEGER AS score FROM f),
v AS (SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 20 THEN 'LOW' ELSE 'INFO' END AS severity, source_ip || '-' || no AS session_id FROM s)
"""


@over_events("w1_alert_dedup", _DEDUP + "SELECT * FROM d")
def _(hp: DataFrame) -> DataFrame:
    return dedup.dedup_alerts(hp, 1_800_000, 3, RULES).select("seq", "suppressed_by", "is_alert", "group_count", "first_seq")


@over_events("a29_dedup_counters", _DEDUP + "SELECT count(*) AS processed, count(suppressed_by) AS suppressed, count(*) FILTER (is_alert) AS alerted, count(*) FILTER (suppressed_by IS NULL AND NOT is_alert) AS deduplicated FROM d")
def _(hp: DataFrame) -> DataFrame:
    return dedup.dedup_counters(dedup.dedup_alerts(hp, 1_800_000, 3, RULES))


@over_events("f3_suppression_table", f"SELECT seq, {_REASON} AS suppressed_by FROM hp")
def _(hp: DataFrame) -> DataFrame:
    rows = [(i, r.reason, r.ip_prefix, r.username_regex, r.service, r.expires_ms) for i, r in enumerate(RULES)]
    rules = hp.sparkSession.createDataFrame(rows, "rule_seq int, reason string, ip_prefix string, username_regex string, service string, expires_ms long")
    return dedup.suppressed_by_table(hp, rules).select("seq", "suppressed_by")


@over_events("f4_live_rules", f"SELECT seq, CASE WHEN source_ip LIKE '198.20.%' THEN 'scanner' WHEN service = 'api' AND username = 'guest' THEN 'guest api' END AS suppressed_by FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", dedup.suppression(dedup.live_rules(RULES, T0 + 3_600_000), F.col("ts_ms")).alias("suppressed_by"))


@over_events("w2_rate_limit", """SELECT seq, (count(*) OVER (PARTITION BY source_ip ORDER BY ts_ms RANGE BETWEEN 120000 PRECEDING AND CURRENT ROW) - (count(*) OVER t - row_number() OVER (PARTITION BY source_ip, ts_ms ORDER BY seq)))::BIGINT AS hits,
  coalesce(ts_ms - lag(ts_ms, 3) OVER (PARTITION BY source_ip ORDER BY ts_ms, seq) <= 120000, false) AS triggered FROM hp WINDOW t AS (PARTITION BY source_ip, ts_ms)""")
def _(hp: DataFrame) -> DataFrame:
    return rates.over_limit(rates.rate_limit(hp, 3, 120_000).drop("triggered"), 3, 120_000).select("seq", "hits", "triggered")


@over_events("w3_sessions", _SESSIONS + "SELECT source_ip, session_id, events, start_ms, end_ms, users::INTEGER AS users, pws::INTEGER AS pws, services::INTEGER AS services, ok AS auths_ok FROM v")
def _(hp: DataFrame) -> DataFrame:
    s = sessions.sessions(hp)
    return s.select("source_ip", "session_id", "events", "start_ms", "end_ms", F.size("usernames").alias("users"), F.size("passwords").alias("pws"), F.size("services").alias("services"), "auths_ok")


@over_events("a17_success_types", _SESSIONS + "SELECT session_id, ok AS auths_ok, phase FROM v")
def _(hp: DataFrame) -> DataFrame:
    """A lake without the flag: the type of the event tells the success."""
    kind = F.when(F.col("success"), F.element_at(F.array(*map(F.lit, sessions.SUCCESS_TYPES)), (F.col("seq") % 3 + 1).cast("int"))).otherwise("auth_attempt")
    typed = hp.withColumn("event_type", kind).withColumn("success", F.lit(None).cast("boolean"))
    return sessions.sessions(typed).select("session_id", "auths_ok", "phase")


@over_events("a18_session_phase", _SESSIONS + """SELECT session_id, phase, CASE WHEN ok > 0 THEN ok || ' successful authentication(s) detected' WHEN phase = 'CREDENTIAL_STUFFING' THEN 'Stuffing pattern: ' || users || ' users × ' || pws || ' passwords'
  WHEN events >= 20 AND users + pws > 0 AND users <= 3 THEN 'Brute-force pattern: ' || events || ' attempts against ≤3 usernames' WHEN users > 0 THEN 'Low-volume auth attempt: ' || events || ' events, ' || users || ' username(s)'
  ELSE 'Probe activity: ' || events || ' events across ' || services || ' service(s) with no credentials' END AS indicator FROM v""")
def _(hp: DataFrame) -> DataFrame:
    return sessions.sessions(hp).select("session_id", "phase", "indicator")


@over_events("a19_session_score", _SESSIONS + "SELECT session_id, score, severity, (end_ms - start_ms) / 1000.0 AS duration_s FROM v")
def _(hp: DataFrame) -> DataFrame:
    return sessions.sessions(hp).select("session_id", "score", "severity", "duration_s")


@over_events("n23_session_summary", _SESSIONS + "SELECT '[' || severity || '] ' || session_id || ' | phase=' || phase || ' score=' || score || ' | ' || events || ' events | users=' || users || ' auths_ok=' || ok AS line FROM v")
def _(hp: DataFrame) -> DataFrame:
    return sessions.sessions(hp).select(summaries.session().alias("line"))


@over_events("a20_session_report", _SESSIONS + "SELECT count(*) AS sessions, sum(events)::BIGINT AS total_events, count(DISTINCT source_ip) AS source_ips, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high FROM v")
def _(hp: DataFrame) -> DataFrame:
    return sessions.session_report(sessions.sessions(hp))


@over_events("a20_severe_sessions", _SESSIONS + "SELECT session_id, severity, score FROM v WHERE severity IN ('CRITICAL', 'HIGH')")
def _(hp: DataFrame) -> DataFrame:
    return sessions.severe_sessions(sessions.sessions(hp)).select("session_id", "severity", "score")


@over_events("n23_report_summary", _SESSIONS + "SELECT 'SessionReport: ' || count(*) || ' sessions | ' || coalesce(sum(events), 0)::BIGINT || ' events | ' || count(DISTINCT source_ip) || ' source IPs | CRITICAL=' || count(*) FILTER (severity = 'CRITICAL') || ' HIGH=' || count(*) FILTER (severity = 'HIGH') AS line FROM v")
def _(hp: DataFrame) -> DataFrame:
    return sessions.session_report(sessions.sessions(hp)).select(summaries.session_report().alias("line"))


@over_events("o1_top_sessions", _SESSIONS + "SELECT session_id, score FROM v ORDER BY score DESC, start_ms, session_id LIMIT 20")
def _(hp: DataFrame) -> DataFrame:
    return sessions.top_sessions(sessions.sessions(hp), 20).select("session_id", "score")


@over_events("w16_timelines", """SELECT source_ip || '/' || service AS session_id, count(*)::INTEGER AS n, string_agg(seq::VARCHAR, ',' ORDER BY ts_ms, seq) AS seqs FROM hp GROUP BY source_ip, service""")
def _(hp: DataFrame) -> DataFrame:
    rows = hp.select(F.concat("source_ip", F.lit("/"), "service").alias("session_id"), "ts_ms", "seq", F.col("service").alias("kind"), F.col("payload").alias("data"))
    t = sessions.timeline(rows)
    return t.select("session_id", F.size("timeline").alias("n"), F.array_join(F.transform("timeline", lambda x: x["seq"].cast("string")), ",").alias("seqs"))


@over_events("w16_timeline_pieces", """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY service ORDER BY ts_ms, seq) - 1) // 500 AS piece FROM hp) SELECT service AS session_id, piece, count(*)::INTEGER AS n, string_agg(seq::VARCHAR, ',' ORDER BY ts_ms, seq) AS seqs FROM p GROUP BY service, piece""")
def _(hp: DataFrame) -> DataFrame:
    """Five sessions of any length, each a fifth of all events, in rows of bounded size."""
    t = sessions.timeline(hp.select(F.col("service").alias("session_id"), "ts_ms", "seq", F.col("service").alias("kind"), F.col("payload").alias("data")), piece_events=500)
    return t.select("session_id", "piece", F.size("timeline").alias("n"), F.array_join(F.transform("timeline", lambda x: x["seq"].cast("string")), ",").alias("seqs"))


@over_events("w19_gaps", "SELECT seq, ts_ms - lag(ts_ms) OVER (PARTITION BY source_ip ORDER BY ts_ms, seq) AS gap_ms FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return rates.gaps(hp).select("seq", "gap_ms")


@over_events("w20_first_burst", """WITH m AS (SELECT source_ip, ts_ms, seq, lag(ts_ms, 3) OVER (PARTITION BY source_ip ORDER BY ts_ms, seq) AS start_ms FROM hp), h AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY ts_ms, seq) AS r FROM m WHERE ts_ms - start_ms <= 120000)
SELECT source_ip, start_ms, ts_ms AS end_ms, seq AS end_seq FROM h WHERE r = 1""")
def _(hp: DataFrame) -> DataFrame:
    return rates.first_burst(hp, 4, 120_000)


@over_events("w17_asn_burst", "SELECT seq, CASE WHEN n > 5 THEN n END AS over_burst FROM (SELECT seq, row_number() OVER (PARTITION BY CASE WHEN source_ip LIKE '8.8.8.%' THEN 15169 WHEN source_ip LIKE '3.80.%' THEN 16509 ELSE 20473 END, ts_ms // 600000 ORDER BY seq) AS n FROM hp WHERE source_ip LIKE '8.8.8.%' OR source_ip LIKE '3.80.%' OR source_ip LIKE '198.20.99.%')")
def _(hp: DataFrame) -> DataFrame:
    rows = geo.enrich(hp, geo.known_prefixes(hp.sparkSession)).where("asn is not null").withColumn("win", F.floor(F.col("ts_ms") / 600_000))
    return geo.burst_number(rows, ["win"]).select("seq", F.when(F.col("asn_count") > 5, F.col("asn_count")).alias("over_burst"))


# Lateral movement. Findings are compared by their subject, addresses and ids.
def _finding(df: DataFrame) -> DataFrame:
    return df.select("check_id", "subject", F.array_join("source_ips", ",").alias("ips"), F.array_join(F.transform("event_ids", lambda x: x.cast("string")), ",").alias("ids"))


def _window_sql(check: str, subject: str, by: str, where: str, hit: str, ms: int) -> str:
    on = " AND ".join(f"e.{c.strip()} = x.{c.strip()}" for c in by.split(","))
    return f"""WITH e AS (SELECT * FROM hp WHERE {where}), h AS (SELECT *, {hit} AS hit FROM e WINDOW w AS (PARTITION BY {by} ORDER BY ts_ms, seq)),
x AS (SELECT {by}, min((ts_ms, seq)) AS f FROM h WHERE hit GROUP BY {by}),
r AS (SELECT {', '.join('x.' + c.strip() for c in by.split(','))}, e.source_ip AS ip, e.ts_ms, e.seq FROM x JOIN e ON {on} WHERE e.ts_ms >= x.f[1] - {ms} AND (e.ts_ms, e.seq) <= x.f)
SELECT '{check}' AS check_id, {subject} AS subject, array_to_string(list_sort(list_distinct(list(ip))), ',') AS ips, string_agg(seq::VARCHAR, ',' ORDER BY ts_ms, seq) AS ids FROM r GROUP BY {by}"""


def _distinct_sql(check: str, value: str, most: int, ms: int) -> str:
    hit = f"(SELECT count(DISTINCT p.{value}) FROM hp p WHERE p.source_ip = h0.source_ip AND p.ts_ms >= h0.ts_ms - {ms} AND (p.ts_ms, p.seq) <= (h0.ts_ms, h0.seq)) > {most}"
    return f"""WITH x AS (SELECT source_ip, min((ts_ms, seq)) AS f FROM hp h0 WHERE {value} IS NOT NULL AND {hit} GROUP BY source_ip)
SELECT '{check}' AS check_id, x.source_ip AS subject, x.source_ip AS ips, string_agg(e.seq::VARCHAR, ',' ORDER BY e.ts_ms, e.seq) AS ids FROM x JOIN hp e ON e.source_ip = x.source_ip AND e.{value} IS NOT NULL AND e.ts_ms >= x.f[1] - {ms} AND (e.ts_ms, e.seq) <= x.f GROUP BY x.source_ip"""


_LATM = {
    "w9_latm001": (lateral.latm001, _window_sql("LATM-001", "username || ':****:' || left(sha256(password), 8)", "username, password", "username IS NOT NULL AND password IS NOT NULL", "lag(source_ip) OVER w <> source_ip AND ts_ms - lag(ts_ms) OVER w <= 3600000", 3_600_000)),
    "w10_latm002": (lateral.latm002, _distinct_sql("LATM-002", "sensor_host", 2, 1_800_000)),
    "w11_latm003": (lateral.latm003, _distinct_sql("LATM-003", "username", 5, 600_000)),
    "a14_latm004": (lateral.latm004, "SELECT 'LATM-004' AS check_id, 'internal' AS subject, array_to_string(list_sort(list_distinct(list(source_ip))), ',') AS ips, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS ids FROM hp WHERE source_ip LIKE '10.%' HAVING count(*) > 0"),
    "w12_latm005": (lateral.latm005, """WITH o AS (SELECT s.source_ip, s.ts_ms, s.seq, min((n.ts_ms, n.seq)) AS f FROM hp s JOIN hp n ON n.source_ip = s.source_ip AND (n.ts_ms, n.seq) > (s.ts_ms, s.seq) AND n.ts_ms - s.ts_ms <= 300000 AND n.sensor_host <> s.sensor_host WHERE s.success GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY ts_ms, seq) AS k FROM o) SELECT 'LATM-005' AS check_id, source_ip AS subject, source_ip AS ips, seq || ',' || f[2] AS ids FROM r WHERE k = 1"""),
    "w13_latm006": (lateral.latm006, """WITH s AS (SELECT source_ip, min((ts_ms, seq)) AS ok FROM hp WHERE success GROUP BY source_ip)
SELECT 'LATM-006' AS check_id, s.source_ip AS subject, s.source_ip AS ips, any_value(s.ok[2]) || ',' || string_agg(e.seq::VARCHAR, ',' ORDER BY e.ts_ms, e.seq) AS ids FROM s JOIN hp e ON e.source_ip = s.source_ip AND NOT e.success AND e.ts_ms > s.ok[1] GROUP BY s.source_ip"""),
    "w14_latm007": (lambda hp: lateral.latm007(hp, 3, 120_000), _window_sql("LATM-007", "source_ip", "source_ip", "true", "ts_ms - lag(ts_ms, 3) OVER w <= 120000", 120_000)),
}
for _name, (_check, _sql) in _LATM.items():
    over_events(_name, _sql)(lambda hp, check=_check: _finding(check(hp)))


_FOUND = {name: sql for name, (_, sql) in _LATM.items() if name != "w14_latm007"}
_FOUND["w14"] = _window_sql("LATM-007", "source_ip", "source_ip", "true", "ts_ms - lag(ts_ms, 10) OVER w <= 60000", 60_000)
_FINDINGS = "WITH found AS (" + " UNION ALL ".join(f"SELECT check_id FROM ({sql})" for sql in _FOUND.values()) + "), rated AS (SELECT check_id, CASE check_id " + " ".join(f"WHEN '{k}' THEN {w}" for k, (w, _) in lateral.CHECKS.items()) + " END AS weight, CASE check_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, (_, v) in lateral.CHECKS.items()) + " END AS severity FROM found)"


@over_events("a15_lateral_risk", _FINDINGS + """, r AS (SELECT least(100, coalesce((SELECT sum(weight) FROM (SELECT DISTINCT check_id, weight FROM rated)), 0))::INTEGER AS risk_score, (SELECT count(*) FROM rated) AS findings)
SELECT risk_score, findings, CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 40 THEN 'HIGH' WHEN risk_score >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")
def _(hp: DataFrame) -> DataFrame:
    return lateral.risk(lateral.rated(hp))


@over_events("a14_latm004_events", "SELECT 'LATM-004' AS check_id, source_ip, seq FROM hp WHERE source_ip LIKE '10.%'")
def _(hp: DataFrame) -> DataFrame:
    return lateral.latm004_events(hp)


@over_events("n23_lateral_summary", _FINDINGS + """, r AS (SELECT least(100, coalesce((SELECT sum(weight) FROM (SELECT DISTINCT check_id, weight FROM rated)), 0))::INTEGER AS risk_score, (SELECT count(*) FROM rated) AS findings)
SELECT '[' || CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 40 THEN 'HIGH' WHEN risk_score >= 15 THEN 'MEDIUM' ELSE 'LOW' END || '] risk_score=' || risk_score || ' findings=' || findings AS line FROM r""")
def _(hp: DataFrame) -> DataFrame:
    return lateral.risk(lateral.rated(hp)).select(summaries.lateral().alias("line"))


@over_events("a16_by_severity", _FINDINGS + " SELECT severity, count(*) AS findings, array_to_string(list_sort(list_distinct(list(check_id))), ',') AS checks FROM rated GROUP BY severity")
def _(hp: DataFrame) -> DataFrame:
    return lateral.by_severity(lateral.rated(hp)).withColumn("checks", F.array_join("checks", ","))


@over_events("w15_count_batches", "SELECT batch, count(*) AS n, min(seq) AS first_seq FROM (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 500 AS batch FROM hp) GROUP BY batch")
def _(hp: DataFrame) -> DataFrame:
    return lateral.count_batches(hp, 500).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


# Campaigns: one for each hour.
_HOUR = "WITH c AS (SELECT *, ts_ms - ts_ms % 3600000 AS campaign FROM hp)"


def _check(df: DataFrame) -> DataFrame:
    return df.select("check_id", "campaign", "evidence", F.array_join("ips", ",").alias("ips"))


def _best_sql(check: str, by: str, where: str, evidence: str) -> str:
    return f"""{_HOUR}, g AS (SELECT campaign, {by}, count(DISTINCT source_ip) AS n, min(seq) AS seen, array_to_string(list_sort(list_distinct(list(source_ip)))[1:10], ',') AS ips FROM c WHERE {where} GROUP BY campaign, {by}),
r AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, seen) AS k FROM g WHERE n >= 3) SELECT '{check}' AS check_id, campaign, {evidence} AS evidence, ips FROM r WHERE k = 1"""


_CAMP = {
    "a8_camp001": (campaigns.camp001, _best_sql("CAMP-001", "username, password", "username <> '' AND password <> ''", "username || ' from ' || n || ' addresses'")),
    "w4_camp002": (campaigns.camp002, _HOUR + """, g AS (SELECT campaign, service, count(DISTINCT source_ip) AS n, min(seq) AS seen FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, seen) AS rk FROM g WHERE n >= 5)
SELECT 'CAMP-002' AS check_id, r.campaign, r.service || ' from ' || r.n || ' addresses' AS evidence, array_to_string(list_sort(list_distinct(list(source_ip)))[1:10], ',') AS ips FROM r JOIN c ON c.campaign = r.campaign AND c.service = r.service WHERE rk = 1 GROUP BY r.campaign, r.service, r.n"""),
    "w5_camp003": (campaigns.camp003, _HOUR + r""", o AS (SELECT campaign, regexp_extract(source_ip, '^(.*)\.[0-9]+$', 1) AS subnet, split_part(source_ip, '.', 4)::INT AS octet, min(ts_ms) AS t, min(seq) AS s FROM c GROUP BY ALL),
l AS (SELECT *, lead(octet) OVER w AS b, lead(octet, 2) OVER w AS d, lead(t) OVER w AS tb, lead(t, 2) OVER w AS tc, min(s) OVER (PARTITION BY campaign, subnet) AS seen FROM o WINDOW w AS (PARTITION BY campaign, subnet ORDER BY octet)),
r AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY seen, octet) AS k FROM l WHERE abs(tb - t) < 300000 AND abs(tc - tb) < 300000)
SELECT 'CAMP-003' AS check_id, campaign, subnet || '.' || octet || ' -> ' || subnet || '.' || b || ' -> ' || subnet || '.' || d AS evidence, array_to_string(list_sort([subnet || '.' || octet, subnet || '.' || b, subnet || '.' || d]), ',') AS ips FROM r WHERE k = 1"""),
    "a9_camp004": (campaigns.camp004, _best_sql("CAMP-004", "user_agent", "trim(user_agent) <> ''", "left(user_agent, 60)")),
    "w6_camp005": (lambda c: campaigns.camp005(c, least=5, silence_ms=600), _HOUR + """, w AS (SELECT *, lead(ts_ms) OVER (PARTITION BY campaign ORDER BY ts_ms, seq) - ts_ms AS wait FROM c), e AS (SELECT DISTINCT campaign, ts_ms AS end_ms FROM w WHERE wait IS NULL OR wait >= 600),
g AS (SELECT e.campaign, end_ms, count(*) AS events, count(DISTINCT source_ip) AS n, array_to_string(list_sort(list_distinct(list(source_ip)))[1:10], ',') AS ips FROM e JOIN c ON c.campaign = e.campaign AND ts_ms BETWEEN end_ms - 300000 AND end_ms GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT source_ip) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY end_ms) AS k FROM g) SELECT 'CAMP-005' AS check_id, campaign, events || ' events from ' || n || ' addresses, then silence' AS evidence, ips FROM r WHERE k = 1"""),
    "w7_camp006": (campaigns.camp006, _HOUR + """, p AS (SELECT *, row_number() OVER (PARTITION BY campaign, source_ip ORDER BY ts_ms, seq) AS rn, count(*) OVER (PARTITION BY campaign, source_ip) // 2 AS half FROM c WHERE password <> ''),
i AS (SELECT campaign, source_ip FROM p GROUP BY ALL HAVING bool_or(rn <= half AND regexp_full_match(password, '[a-z]{1,8}')) AND bool_or(rn > half AND regexp_matches(password, '20[0-9][0-9]|@')))
SELECT 'CAMP-006' AS check_id, campaign, count(*) || ' addresses' AS evidence, array_to_string(list_sort(list(source_ip))[1:10], ',') AS ips FROM i GROUP BY campaign"""),
    "a10_camp007": (lambda c: campaigns.camp007(c, "raw_ms", 36_000_000), _HOUR + """, i AS (SELECT campaign, source_ip FROM c GROUP BY ALL HAVING max(raw_ms) - min(raw_ms) > 36000000) SELECT 'CAMP-007' AS check_id, campaign, count(*) || ' addresses' AS evidence, array_to_string(list_sort(list(source_ip))[1:10], ',') AS ips FROM i GROUP BY campaign"""),
}
for _name, (_camp, _sql) in _CAMP.items():
    over_events(_name, _sql)(lambda hp, check=_camp: _check(check(campaigns.tumbling(hp, 3600))))


@over_events("w8_campaign_windows", "SELECT seq, ts_ms - ts_ms % 3600000 AS campaign FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return campaigns.tumbling(hp, 3600).select("seq", "campaign")


_CAMP_SQL = {name: sql for name, (_, sql) in _CAMP.items() if name != "a10_camp007"}
_CAMP_SQL["w6_camp005"] = _CAMP_SQL["w6_camp005"].replace("wait >= 600)", "wait >= 1800000)").replace("HAVING count(*) >= 5 ", "HAVING count(*) >= 20 ")


# CAMP-007 needs 48 hours, so it can't fire in campaigns of an hour
@over_events("w4_camp002_sliding", _HOUR + """, p AS (SELECT *, (SELECT count(DISTINCT b.source_ip) FROM c b WHERE b.campaign = a.campaign AND b.service = a.service AND b.ts_ms >= a.ts_ms - 300000 AND (b.ts_ms, b.seq) <= (a.ts_ms, a.seq)) AS n FROM c a),
k AS (SELECT campaign, service, min(seq) AS seen FROM c GROUP BY ALL), t AS (SELECT p.*, k.seen, row_number() OVER (PARTITION BY p.campaign ORDER BY n DESC, k.seen, ts_ms, seq) AS rk FROM p JOIN k USING (campaign, service) WHERE n >= 3)
SELECT 'CAMP-002' AS check_id, t.campaign, t.service || ' from ' || t.n || ' addresses' AS evidence, array_to_string(list_sort(list_distinct(list(c.source_ip)))[1:10], ',') AS ips FROM t JOIN c ON c.campaign = t.campaign AND c.service = t.service AND c.ts_ms >= t.ts_ms - 300000 AND (c.ts_ms, c.seq) <= (t.ts_ms, t.seq) WHERE rk = 1 GROUP BY t.campaign, t.service, t.n""")
def _(hp: DataFrame) -> DataFrame:
    return _check(campaigns.camp002(campaigns.tumbling(hp, 3600), 3, 300_000))


@over_events("a11_campaign_profiles", _HOUR + ", fired AS (" + " UNION ALL ".join(f"SELECT check_id, campaign FROM ({sql})" for sql in _CAMP_SQL.values()) + "), rated AS (SELECT campaign, least(100, sum(CASE check_id " + " ".join(f"WHEN '{k}' THEN {w}" for k, (w, _) in campaigns.CHECKS.items()) + """ END))::INTEGER AS score, string_agg(check_id, ', ' ORDER BY check_id) AS checks FROM fired GROUP BY campaign),
i AS (SELECT campaign, list_sort(list(seq::VARCHAR)) AS ids, count(*) AS total_events, count(DISTINCT source_ip) AS unique_ips, (max(ts_ms) - min(ts_ms)) // 1000 AS span_s FROM c GROUP BY campaign),
p AS (SELECT i.*, coalesce(score, 0) AS risk_score, coalesce(checks, 'none') AS checks FROM i LEFT JOIN rated USING (campaign))
SELECT campaign, left(sha256(array_to_string(ids, ',')), 12) AS campaign_id, risk_score, CASE WHEN risk_score >= 60 THEN 'COORDINATED' WHEN risk_score >= 35 THEN 'LIKELY_COORDINATED' WHEN risk_score >= 15 THEN 'SUSPICIOUS' ELSE 'ISOLATED' END AS tier, total_events, unique_ips, span_s, checks FROM p""")
def _(hp: DataFrame) -> DataFrame:
    events = campaigns.tumbling(hp, 3600)
    return campaigns.profiles(events, campaigns.campaign_checks(events))


@over_events("a12_chunked_ids", _HOUR + ", p AS (SELECT campaign, seq // 1000 AS part, sha256(string_agg(seq::VARCHAR, ',' ORDER BY seq::VARCHAR)) AS d FROM c GROUP BY 1, 2) SELECT campaign, left(sha256(string_agg(d, ',' ORDER BY part)), 12) AS campaign_id FROM p GROUP BY campaign")
def _(hp: DataFrame) -> DataFrame:
    """No row or task has more than a thousand ids."""
    c = campaigns.tumbling(hp, 3600)
    return campaigns.campaign_ids(c, chunked=True).select("campaign", "campaign_id")


@over_events("a12_merged_ids", _HOUR + ", s AS (SELECT campaign, " + ", ".join(f"sum(('0x' || substr(sha256(seq::VARCHAR), {1 + 6 * i}, 6))::BIGINT)::VARCHAR AS d{i}" for i in range(8)) + " FROM c GROUP BY campaign) SELECT campaign, left(sha256(concat_ws(',', " + ", ".join(f"d{i}" for i in range(8)) + ")), 12) AS campaign_id FROM s")
def _(hp: DataFrame) -> DataFrame:
    """No list of ids anywhere."""
    return campaigns.merged_ids(campaigns.tumbling(hp, 3600))


@over_events("a12_campaign_ids", _HOUR + ", i AS (SELECT campaign, list_sort(list(seq::VARCHAR)) AS ids FROM c GROUP BY campaign) SELECT campaign, left(sha256(array_to_string(ids, ',')), 12) AS campaign_id FROM i")
def _(hp: DataFrame) -> DataFrame:
    events = campaigns.tumbling(hp, 3600)
    return campaigns.profiles(events, campaigns.campaign_checks(events, {"CAMP-001": campaigns.camp001})).select("campaign", "campaign_id")


@over_events("a13_campaign_addresses", _HOUR + " SELECT campaign, array_to_string(list_sort(list_distinct(list(source_ip)))[1:10], ',') AS ips FROM c GROUP BY campaign")
def _(hp: DataFrame) -> DataFrame:
    events = campaigns.tumbling(hp, 3600)
    return campaigns.with_first_ips(events.select("campaign").distinct(), events, ["campaign"]).select("campaign", F.array_join("ips", ",").alias("ips"))
