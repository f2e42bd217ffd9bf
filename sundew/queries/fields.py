"""Queries of the column functions and filters."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.functions import fields as f
from sundew.functions import net
from sundew.operators import filters
from sundew.plans.events import T0
from sundew.queries.registry import over_events

NOW = T0 + 3 * 3_600_000
_LONG = "(split_part(source_ip, '.', 1)::BIGINT * 16777216 + split_part(source_ip, '.', 2)::BIGINT * 65536 + split_part(source_ip, '.', 3)::BIGINT * 256 + split_part(source_ip, '.', 4)::BIGINT)"


@over_events("n1_mask_credential", "SELECT seq, credential AS masked, credential AS again FROM hp")
def _(hp: DataFrame) -> DataFrame:
    once = f.mask_credential(F.col("password"))
    return hp.select("seq", once.alias("masked"), f.mask_credential(once).alias("again"))


@over_events("n2_alias_text", "SELECT seq, CASE WHEN seq % 5 = 0 THEN '' WHEN coalesce(username, '') <> '' THEN trim(username) WHEN coalesce(user_agent, '') <> '' THEN trim(user_agent) ELSE '' END AS v FROM hp")
def _(hp: DataFrame) -> DataFrame:
    blank = F.when(F.col("seq") % 5 == 0, "  ")
    return hp.select("seq", f.first_text(blank, F.col("username"), F.col("user_agent")).alias("v"))


@over_events("n3_alias_int", "SELECT seq, coalesce(try_cast(password AS INTEGER), dest_port) AS v FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", f.first_int(F.col("password"), F.col("dest_port")).alias("v"))


@over_events("n4_alias_time", "SELECT seq, CASE WHEN seq % 3 = 2 THEN NULL ELSE ts_ms // 1000 END AS at_s FROM hp")
def _(hp: DataFrame) -> DataFrame:
    iso = F.concat(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    first = F.when(F.col("seq") % 3 == 0, iso).when(F.col("seq") % 3 == 1, "no time").otherwise("0")
    second = F.when(F.col("seq") % 3 == 1, (F.floor(F.col("ts_ms") / 1000)).cast("string"))
    return hp.select("seq", F.unix_seconds(f.parsed_time(first, second)).alias("at_s"))


@over_events("n6_event_id", "SELECT seq, true AS valid, seq % 2 = 0 AS kept FROM hp")
def _(hp: DataFrame) -> DataFrame:
    own = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("0a0b0c0d-0000-4000-8000-"), F.lpad(F.col("seq").cast("string"), 12, "0")))
    made = f.event_id(own, F.col("seq").cast("string"), F.col("source_ip"))
    return hp.select("seq", made.rlike(f.UUID4).alias("valid"), F.coalesce(made == own, F.lit(False)).alias("kept"))


@over_events("n7_contract", """SELECT seq, CASE WHEN seq % 7 = 0 THEN 'missing:source_ip' WHEN seq % 7 = 1 THEN 'service' WHEN seq % 7 = 2 THEN 'port' WHEN seq % 7 = 3 AND password IS NOT NULL THEN 'credential' ELSE '' END AS broken FROM hp""")
def _(hp: DataFrame) -> DataFrame:
    seven = F.col("seq") % 7
    ip = F.when(seven != 0, F.col("source_ip"))
    service = F.when(seven == 1, "smtp").otherwise(F.col("service"))
    port = F.when(seven == 2, 70000).otherwise(F.col("dest_port"))
    secret = F.when(seven == 3, F.col("password")).otherwise(F.col("credential"))
    broken = f.violations([F.col("ts_ms"), service, ip, port], ["timestamp", "service", "source_ip", "source_port"], service, port, secret)
    return hp.select("seq", F.array_join(broken, ",").alias("broken"))


@over_events("n7_unknown_fields", "SELECT seq, CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN 'color' ELSE 'a_b,color' END AS unknown FROM hp")
def _(hp: DataFrame) -> DataFrame:
    three = F.col("seq") % 3
    row = F.to_json(F.struct("service", "source_ip", F.when(three > 0, "red").alias("color"), F.when(three == 2, 1).alias("a_b")))
    return hp.select("seq", F.array_join(f.unknown_fields(F.json_object_keys(row)), ",").alias("unknown"))


@over_events("n8_networks", f"""SELECT seq, true AS valid, false AS odd, {_LONG} AS number, split_part(source_ip, '.', 1) || '.' || split_part(source_ip, '.', 2) || '.' || split_part(source_ip, '.', 3) || '.' || (split_part(source_ip, '.', 4)::INT // 64 * 64) || '/26' AS net FROM hp""")
def _(hp: DataFrame) -> DataFrame:
    ip = F.col("source_ip")
    return hp.select("seq", net.is_ip_or_cidr(F.concat(ip, F.lit("/26"))).alias("valid"), net.is_ipv4(F.concat(F.lit("0"), ip)).alias("odd"), net.ipv4_long(ip).alias("number"), net.network_text(F.concat(ip, F.lit("/26"))).alias("net"))


@over_events("n9_subnets", f"SELECT seq, regexp_extract(source_ip, '^(.*)\\.[0-9]+$', 1) AS s24, {_LONG} // 16 * 16 AS s28 FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", net.slash24(F.col("source_ip")).alias("s24"), net.slash28(F.col("source_ip")).alias("s28"))


@over_events("n10_internal", "SELECT seq, source_ip LIKE '10.%' AS internal, false AS broken FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", net.is_internal(F.col("source_ip")).alias("internal"), net.is_internal(F.concat("source_ip", F.lit(".1"))).alias("broken"))


@over_events("n11_private", "SELECT seq, source_ip LIKE '10.%' AS private, true AS local FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", net.is_private(F.col("source_ip")).alias("private"), net.is_private(F.regexp_replace("source_ip", r"^\d+\.\d+", "169.254")).alias("local"))


@over_events("n12_credential_key", "SELECT seq, CASE WHEN password IS NULL THEN '__no_cred__' WHEN seq % 2 = 0 THEN left(sha256(password), 8) ELSE password END AS key FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", f.credential_key(F.when(F.col("seq") % 2 == 0, F.col("credential")).otherwise(F.col("password"))).alias("key"))


@over_events("n13_credential_hash", "SELECT seq, left(sha256(password), 8) AS key FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", f.credential_hash(F.col("credential")).alias("key"))


@over_events("n14_credential_paths", "SELECT seq, coalesce(path IN ('/login', '/admin', '/api/login'), false) AS flag FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", F.coalesce(F.col("path").isin(*f.CREDENTIAL_PATHS), F.lit(False)).alias("flag"))


@over_events("n15_api_request", """SELECT seq, username, CASE WHEN seq % 2 = 0 THEN credential ELSE left(credential, 11) || '...' END AS c, coalesce(path IN ('/oauth/token', '/login'), false) AS endpoint FROM hp WHERE service = 'api'""")
def _(hp: DataFrame) -> DataFrame:
    # the secret is in another field by turns
    secrets = [F.when(F.col("seq") % 4 == i, F.col("password")).alias(n) for i, n in enumerate(("password", "api_key", "client_secret", "credential_header"))]
    body = F.to_json(F.struct(F.lit("").alias("client_id"), "username", *secrets))
    parsed = F.from_json(body, "client_id string, username string, client_secret string, password string, api_key string, credential_header string")
    rows = hp.where("service = 'api'").withColumn("b", parsed)
    username, masked = f.api_request(F.col("b"))
    cut = F.when(F.col("seq") % 2 == 0, masked).otherwise(F.concat(F.substring(masked, 1, 11), F.lit("...")))
    return rows.select("seq", username.alias("username"), cut.alias("c"), F.coalesce(F.col("path").isin(*f.AUTH_ENDPOINTS), F.lit(False)).alias("endpoint"))


@over_events("n16_password_classes", "SELECT seq, regexp_full_match(password, '[a-z]{1,8}') AS common, regexp_matches(password, '20[0-9][0-9]|@') AS targeted FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", f.is_common_word(F.col("password")).alias("common"), f.is_targeted(F.col("password")).alias("targeted"))


@over_events("n22_levels", """SELECT seq, k AS score, CASE WHEN k >= 60 THEN 'COORDINATED' WHEN k >= 35 THEN 'LIKELY_COORDINATED' WHEN k >= 15 THEN 'SUSPICIOUS' ELSE 'ISOLATED' END AS campaign,
  CASE WHEN k >= 70 THEN 'CRITICAL' WHEN k >= 40 THEN 'HIGH' WHEN k >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS lateral_, CASE WHEN k >= 80 THEN 'CRITICAL' WHEN k >= 60 THEN 'HIGH' WHEN k >= 40 THEN 'MEDIUM' WHEN k >= 20 THEN 'LOW' ELSE 'INFO' END AS session_,
  CASE WHEN k >= 80 THEN 'CRITICAL' WHEN k >= 55 THEN 'HIGH' WHEN k >= 35 THEN 'MEDIUM' WHEN k >= 15 THEN 'LOW' ELSE 'INFO' END AS geo FROM hp""")
def _(hp: DataFrame) -> DataFrame:
    k = F.col("k")
    return hp.select("seq", k.alias("score"), f.campaign_tier(k).alias("campaign"), f.lateral_level(k).alias("lateral_"), f.session_severity(k).alias("session_"), f.geo_level(k).alias("geo"))


@over_events("n28_anonymised", f"SELECT seq, CASE WHEN ts_ms < {NOW - 5400000} THEN sha256('s' || source_ip) ELSE source_ip END AS ip FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", f.anonymised(F.col("source_ip"), F.col("ts_ms"), NOW - 5_400_000 + 90 * 86_400_000, 90, "s").alias("ip"))


@over_events("f1_export", f"SELECT seq, source_ip, service, ts_ms FROM hp WHERE service = 'ssh' AND ts_ms BETWEEN {T0} AND {NOW - 3600000} ORDER BY seq LIMIT 500")
def _(hp: DataFrame) -> DataFrame:
    return filters.export(hp, service="ssh", start_ms=T0, end_ms=NOW - 3_600_000, limit=500).select("seq", "source_ip", "service", "ts_ms")


@over_events("n5_time_parameters", f"SELECT seq, ts_ms FROM hp WHERE ts_ms >= {NOW - 7200000} AND ts_ms <= {NOW - 3600000}")
def _(hp: DataFrame) -> DataFrame:
    text = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
    start = filters.time_parameter(text(NOW - 7_200_000).isoformat().replace("+00:00", "Z"))
    end = filters.time_parameter(text(NOW - 3_600_000).replace(tzinfo=None).isoformat())
    return filters.in_time(hp, start, end).select("seq", "ts_ms")


@over_events("f2_recent", f"SELECT seq, ts_ms FROM hp WHERE ts_ms >= {NOW - 3600000}")
def _(hp: DataFrame) -> DataFrame:
    return filters.recent(hp, "last_hour", NOW).select("seq", "ts_ms")


@over_events("f7_uploads", r"""SELECT seq, service, path, payload FROM hp WHERE (service = 'http' AND k % 3 > 0 AND (regexp_matches(path, '(?i).*(upload|import|file|attachment).*') OR regexp_matches(payload, '(?i)\.(exe|dll|ps1|bat|vbs|js|jar|elf|php)')))
  OR (service = 'ftp' AND regexp_matches(payload, '(?i)^STOR\s+.*\.(exe|dll|ps1|bat|vbs|js|jar|elf|php)$'))""")
def _(hp: DataFrame) -> DataFrame:
    method = F.element_at(F.array(*map(F.lit, ("GET", "POST", "put"))), (F.col("k") % 3 + 1).cast("int"))
    return hp.where(filters.is_upload(method)).select("seq", "service", "path", "payload")


@over_events("f8_commands", r"""SELECT seq, service, payload FROM hp WHERE service IN ('http', 'api', 'ftp', 'ssh') AND (regexp_matches(payload, ';|&&|\|\||`|\$\(') OR regexp_matches(payload, '(?i)\b(whoami|id|uname|cat\s+/etc/passwd|wget|curl|nc)\b'))""")
def _(hp: DataFrame) -> DataFrame:
    return hp.where(filters.is_command()).select("seq", "service", "payload")


@over_events("f9_targeted_paths", "SELECT seq, path, payload FROM hp WHERE path IN ('/.env', '/.git/config') OR contains(payload, '/etc/passwd')")
def _(hp: DataFrame) -> DataFrame:
    return hp.where(filters.is_targeted_path()).select("seq", "path", "payload")


@over_events("f10_credential_requests", "SELECT path, count(*) AS n FROM hp WHERE path IN ('/login', '/admin', '/api/login') GROUP BY path")
def _(hp: DataFrame) -> DataFrame:
    return hp.where(F.col("path").isin(*f.CREDENTIAL_PATHS)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@over_events("f11_unknown_agents", "SELECT user_agent, min(ts_ms) AS first_seen_ms, count(*) AS events FROM hp WHERE user_agent LIKE 'Mozilla%' GROUP BY user_agent")
def _(hp: DataFrame) -> DataFrame:
    return filters.unknown_agents(hp)


@over_events("f12_retained", f"SELECT seq, ts_ms FROM hp WHERE ts_ms >= {NOW - 7200000}")
def _(hp: DataFrame) -> DataFrame:
    return filters.retained(hp, NOW - 7_200_000 + 90 * 86_400_000).select("seq", "ts_ms")
