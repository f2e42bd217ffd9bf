"""The canonical event table, projected from the ``events`` table.

Every event has ``seq``, the order of arrival; all orderings are ``(ts_ms, seq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.functions.fields import mask_credential

T0 = 1704067200000
USERS = ("root", "admin", "test", "ubuntu", "pi", "guest", "oracle", "svc")
PASSWORDS = ("root", "admin", "password", "123456", "dragon", "Summer2024", "raspberry", "p@ss", "toor", "letmein")
AGENTS = ("curl/8.7.1", "zgrab/0.x", "masscan/1.3", "shodan", "Mozilla/5.0", "python-requests/2")
METHODS = ("GET", "POST", "put")
PATHS = ("/login", "/.env", "/admin", "/oauth/token", "/upload", "/index", "/.git/config", "/api/login")
PAYLOADS = ("STOR a.exe", "; cat /etc/passwd", "whoami", "*2\r\n$4\r\nAUTH\r\n$1\r\nx\r\n", "PING", "GET /")


def epoch_ms(ts: Column, kind: str) -> Column:
    """Milliseconds since 1970, whatever the session's time zone is."""
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.unix_millis(ts)


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def attack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: seq, raw_ms, ts_ms, source_ip, service, sensor_host, username, password, credential, success, dest_port, user_agent, path, payload, user_id, k, method, source_port."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.col("user_id")
    k = F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("long")
    tail = (u % 250 + 1).cast("string")
    third = lambda x: F.floor(x).cast("string")
    ip = (
        F.when(u % 8 == 0, F.concat(F.lit("10.0."), third(F.floor(u / 8) % 4), F.lit("."), tail))
        .when(u % 8 == 1, F.concat(F.lit("8.8.8."), tail))
        .when(u % 8 == 2, F.concat(F.lit("198.20.99."), tail))
        .when(u % 8 == 3, F.concat(F.lit("3.80.1."), tail))
        .otherwise(F.concat(F.lit("203.0."), third(u % 3), F.lit("."), tail))
    )
    service = F.create_map(*(F.lit(x) for x in ("error", "ssh", "click", "http", "view", "api", "signup", "ftp", "purchase", "rdp")))[F.col("event_type")]
    port = F.when(F.col("service") == "ssh", 22).when(F.col("service") == "http", 80).when(F.col("service") == "api", 8443).when(F.col("service") == "ftp", 21).when(F.col("service") == "rdp", 3389)
    ms = epoch_ms(F.col("ts"), dict(raw.dtypes)["ts"])
    login, web = F.col("service").isin("ssh", "ftp", "api"), F.col("service").isin("http", "api")
    rows = raw.select(F.col("event_id").alias("seq"), ms.alias("raw_ms"), ip.alias("source_ip"), service.alias("service"), u.alias("u"), k.alias("k"), "value")
    rows = rows.withColumns({"ts_ms": F.lit(T0) + F.floor((F.col("raw_ms") - T0) / 240), "password": F.when(login, pick(PASSWORDS, F.col("k") % 10))})
    return rows.select(
        "seq", "raw_ms", "ts_ms", "source_ip", "service",
        F.concat(F.lit("hp-0"), (F.col("seq") % 4).cast("string")).alias("sensor_host"),
        F.when(login, pick(USERS, F.col("k") % 8)).alias("username"),
        "password", mask_credential(F.col("password")).alias("credential"),
        (F.col("value") > 120).alias("success"), port.alias("dest_port"),
        F.when(web, pick(AGENTS, F.col("u") % 6)).alias("user_agent"),
        F.when(web, pick(PATHS, F.col("k") % 8)).alias("path"),
        pick(PAYLOADS, F.col("k") % 6).alias("payload"), F.col("u").alias("user_id"), "k",
        F.when(web, pick(METHODS, F.floor(F.col("k") / 2) % 3)).alias("method"), F.when(F.col("u") % 5 > 0, F.col("u") * 7 % 60000 + 1024).cast("int").alias("source_port"),
    )


def _sql_list(values: tuple[str, ...], at: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({at}) + 1]"


#: The same projection in SQL, as a common table ``hp``.
HP_SQL = f"""hp0 AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS raw_ms, user_id AS u, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k, value,
    CASE user_id % 8 WHEN 0 THEN '10.0.' || ((user_id // 8) % 4) WHEN 1 THEN '8.8.8' WHEN 2 THEN '198.20.99' WHEN 3 THEN '3.80.1' ELSE '203.0.' || (user_id % 3) END || '.' || (user_id % 250 + 1) AS source_ip,
    CASE event_type WHEN 'error' THEN 'ssh' WHEN 'click' THEN 'http' WHEN 'view' THEN 'api' WHEN 'signup' THEN 'ftp' WHEN 'purchase' THEN 'rdp' END AS service
  FROM events),
hp1 AS (
  SELECT seq, raw_ms, {T0} + (raw_ms - {T0}) // 240 AS ts_ms, source_ip, service, 'hp-0' || (seq % 4) AS sensor_host,
    CASE WHEN service IN ('ssh', 'ftp', 'api') THEN {_sql_list(USERS, "k % 8")} END AS username,
    CASE WHEN service IN ('ssh', 'ftp', 'api') THEN {_sql_list(PASSWORDS, "k % 10")} END AS password,
    value > 120 AS success, CAST(CASE service WHEN 'ssh' THEN 22 WHEN 'http' THEN 80 WHEN 'api' THEN 8443 WHEN 'ftp' THEN 21 WHEN 'rdp' THEN 3389 END AS INTEGER) AS dest_port,
    CASE WHEN service IN ('http', 'api') THEN {_sql_list(AGENTS, "u % 6")} END AS user_agent,
    CASE WHEN service IN ('http', 'api') THEN {_sql_list(PATHS, "k % 8")} END AS path,
    replace({_sql_list(tuple(p.replace(chr(13) + chr(10), "~") for p in PAYLOADS), "k % 6")}, '~', chr(13) || chr(10)) AS payload, u AS user_id, k,
    CASE WHEN service IN ('http', 'api') THEN {_sql_list(METHODS, "k // 2 % 3")} END AS method, CASE WHEN u % 5 > 0 THEN (u * 7 % 60000 + 1024)::INTEGER END AS source_port
  FROM hp0),
hp AS (SELECT *, '[masked:len=' || length(password) || ',hash_prefix=' || left(sha256(password), 8) || ']' AS credential FROM hp1)"""
