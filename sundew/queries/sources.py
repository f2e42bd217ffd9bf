"""Queries of sources and sinks, over lines and bytes made of the tables."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.functions.fields import mask_credential
from sundew.operators import filters
from sundew.plans.events import T0
from sundew.plans.tables import materialize, shared_folder
from sundew.queries.registry import over_events
from sundew.sources import delivery, feeds, jsonl, lake, probes, siem
from sundew.sources.delivery import Sender


def event_lines(hp: DataFrame) -> DataFrame:
    """JSON lines of the events; of 20, one is blank, one an array and one cut off."""
    row = F.to_json(F.struct("seq", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "service", "source_ip", F.col("dest_port").alias("source_port"), "username", "credential", "path", "user_agent"))
    t = F.col("seq") % 20
    return hp.select("seq", F.when(t == 0, "  ").when(t == 1, "[1,2]").when(t == 2, F.substring(row, 1, 30)).otherwise(row).alias("value"))


@over_events("s1_lenient_lines", "SELECT seq, service, source_ip, username, path FROM hp WHERE seq % 20 > 2")
def _(hp: DataFrame) -> DataFrame:
    return jsonl.events_of(event_lines(hp).select("value")).select("seq", "service", "source_ip", "username", "path")


@over_events("s2_rejected_lines", "SELECT seq, CASE seq % 20 WHEN 1 THEN 'non-object' ELSE 'invalid JSON' END AS reason FROM hp WHERE seq % 20 IN (1, 2)")
def _(hp: DataFrame) -> DataFrame:
    return jsonl.rejects_of(event_lines(hp)).select("seq", "reason")


@over_events("s3_tailed_lines", "SELECT seq, service FROM hp WHERE seq % 20 > 2")
def _(hp: DataFrame) -> DataFrame:
    spark, base = hp.sparkSession, f"{shared_folder(hp.sparkSession)}/streams/{uuid.uuid4().hex}"
    event_lines(hp).select("value").write.text(f"{base}/lines")
    out = jsonl.tail(spark, f"{base}/lines").select("seq", "service")
    out.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


@over_events("s4_written_lines", "SELECT seq, source_ip, 'i1' AS instance_id FROM hp")
def _(hp: DataFrame) -> DataFrame:
    path = f"{shared_folder(hp.sparkSession)}/tables/{uuid.uuid4().hex}"
    jsonl.write(hp.select("seq", "source_ip"), path, "append", "i1")
    return hp.sparkSession.read.schema("seq bigint, source_ip string, instance_id string").json(path)


@over_events("s5_splunk_rows", "SELECT seq, ts_ms / 1000.0 AS time, 'sensors' AS index, 'lake' AS source, 'honeypot:' || service AS sourcetype, seq AS event_seq, ts_ms AS event_ms, service AS event_service, source_ip AS event_ip FROM hp")
def _(hp: DataFrame) -> DataFrame:
    rows = siem.splunk_rows(hp.select("seq", "ts_ms", "service", "source_ip"), "sensors", "lake")
    back = F.from_json("value", "time double, index string, source string, sourcetype string, event struct<seq:long,ts_ms:long,service:string,source_ip:string>")
    event = [F.col(f"j.event.{c}").alias(f"event_{n}") for c, n in (("seq", "seq"), ("ts_ms", "ms"), ("service", "service"), ("source_ip", "ip"))]
    return rows.withColumn("j", back).select("seq", "j.time", "j.index", "j.source", "j.sourcetype", *event)


@over_events("s6_elastic_rows", """SELECT seq, '{"index":{"_index":"sensors"}}' || chr(10) || '{"seq":' || seq || ',"source_ip":"' || source_ip || '"}' || chr(10) AS value FROM hp""")
def _(hp: DataFrame) -> DataFrame:
    return siem.elastic_rows(hp.select("seq", "source_ip"), "sensors")


@over_events("s7_cef", r"""SELECT seq, 'CEF:0|v\|1|p|1.0|' || CASE service WHEN 'ssh' THEN '1001' WHEN 'http' THEN '1002' WHEN 'api' THEN '1003' ELSE '1000' END || '|' || upper(service) || ' connection attempt observed|5|src=' || source_ip || coalesce(' spt=' || source_port, '') || ' rt=' || ts_ms
  || coalesce(' duser=' || username, '') || coalesce(' request=' || path, '') || coalesce(' cs1=' || user_agent || ' cs1Label=UserAgent', '') AS value FROM hp""")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", siem.cef("v|1", "p", source_port=F.col("source_port")).alias("value"))


@over_events("s8_cef_json", """SELECT seq, 'CEF:0|v|p|1.0|' || service || '|' || service || '|5|src=' || source_ip || ' msg={"seq":' || seq || ',"service":"' || service || '"}' AS value FROM hp""")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", siem.cef_json(F.struct("seq", "service"), F.col("service"), F.col("source_ip"), "v", "p").alias("value"))


@over_events("s9_syslog", "SELECT seq, '<134>' || strftime(make_timestamp(ts_ms * 1000), '%b %d %H:%M:%S') || ' h1 sundew: ' || source_ip AS value FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return hp.select("seq", siem.syslog(F.col("source_ip"), F.timestamp_millis("ts_ms"), "h1", "sundew").alias("value"))


def refuse_hot(values: list[str]) -> None:
    """A target that refuses batches with an internal address."""
    if any(v.startswith("10.") for v in values):
        raise ConnectionError("refused")


@over_events("s11_deliveries", """WITH t AS (SELECT unnest(['a', 'b']) AS target) SELECT seq, target, CASE WHEN target = 'b' AND source_ip LIKE '10.%' THEN 'dropped' ELSE 'delivered' END AS status,
  CASE WHEN target = 'b' AND source_ip LIKE '10.%' THEN 2 ELSE 1 END AS attempts, CASE WHEN target = 'b' AND source_ip LIKE '10.%' THEN 'ConnectionError: refused' END AS error FROM hp, t""")
def _(hp: DataFrame) -> DataFrame:
    # a batch is sent as one, so internal addresses are dealt to batches of their own
    rows = hp.select("seq", F.col("source_ip").alias("value"))
    inside = F.col("value").startswith("10.")
    senders = {"a": len, "b": refuse_hot}
    return delivery.deliver(rows.where(inside), senders, retries=1).unionByName(delivery.deliver(rows.where(~inside), senders, retries=1))


def refuse_all(values: list[str]) -> None:
    raise ConnectionError("down")


@over_events("s10_delivery_ledger", """SELECT seq, 'a' AS target, 0 AS attempt, 'delivered' AS status FROM hp UNION ALL SELECT seq, 'b', 0, CASE seq % 2 WHEN 0 THEN 'dropped' ELSE 'delivered' END FROM hp
  UNION ALL SELECT seq, 'b', 1, 'delivered' FROM hp WHERE seq % 2 = 0""")
def _(hp: DataFrame) -> DataFrame:
    """A target is down for the first batch; the stream ends, is started again when the target is back, and goes on with the second batch."""
    spark = hp.sparkSession
    out = f"{shared_folder(spark)}/delivery-{uuid.uuid4().hex}"
    rows = materialize(hp.select("seq", F.col("source_ip").alias("value")), "deliveries")

    def stream(second: Sender) -> None:
        sink = delivery.delivered_once(f"{out}/ledger", lambda batch: batch, {"a": len, "b": second})
        source = spark.readStream.schema(rows.schema).parquet(f"{out}/rows")
        source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()

    rows.where("seq % 2 = 0").write.mode("append").parquet(f"{out}/rows")
    try:
        stream(refuse_all)
    except StreamingQueryException as error:
        if "Undelivered" not in str(error):
            raise
    rows.where("seq % 2 = 1").write.mode("append").parquet(f"{out}/rows")
    stream(len)
    return delivery.ledger_rows(spark, f"{out}/ledger").select("seq", "target", "attempt", "status")


@over_events("s12_retry_queue", "SELECT seq, 2 AS attempts FROM hp WHERE service = 'rdp' ORDER BY ts_ms DESC, seq DESC LIMIT 100")
def _(hp: DataFrame) -> DataFrame:
    rows = hp.where("service = 'rdp'").select("seq", F.col("ts_ms").alias("enqueued_ms"), F.lit(1).alias("attempts"))
    kept, _ = delivery.retry_queue(rows.where("false"), rows, 100)
    return kept.select("seq", "attempts")


@over_events("s14_session_documents", "SELECT source_ip, count(*) AS n, string_agg(ts_ms || ':' || service, ',' ORDER BY ts_ms, seq) AS events FROM hp GROUP BY source_ip")
def _(hp: DataFrame) -> DataFrame:
    docs = delivery.session_documents(hp.select(F.col("source_ip").alias("session_id"), "ts_ms", "seq", F.col("service").alias("kind"), F.col("payload").alias("data")))
    events = F.from_json("value", "events array<struct<ts_ms:long,kind:string>>")["events"]
    each = F.transform("e", lambda x: F.concat(x["ts_ms"].cast("string"), F.lit(":"), x["kind"]))
    return docs.select("session_id", events.alias("e")).select(F.col("session_id").alias("source_ip"), F.size("e").cast("long").alias("n"), F.array_join(each, ",").alias("events"))


@over_events("s14_session_pieces", """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY service ORDER BY ts_ms, seq) - 1) // 500 AS piece FROM hp)
  SELECT service, piece, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms, string_agg(ts_ms || ':' || source_ip, ',' ORDER BY ts_ms, seq) AS events FROM p GROUP BY service, piece""")
def _(hp: DataFrame) -> DataFrame:
    rows = hp.select(F.col("service").alias("session_id"), "ts_ms", "seq", F.col("source_ip").alias("kind"), F.col("payload").alias("data"))
    docs = delivery.session_documents(rows, piece_events=500)
    read = F.from_json("value", "session_id string, piece long, started_ms long, ended_ms long, events array<struct<ts_ms:long,kind:string>>").alias("d")
    each = F.transform("d.events", lambda x: F.concat(x["ts_ms"].cast("string"), F.lit(":"), x["kind"]))
    return docs.select(read).select(F.col("d.session_id").alias("service"), "d.piece", "d.started_ms", "d.ended_ms", F.array_join(each, ",").alias("events"))


# The lake spans the month of the table's own times.
LAKE_NOW = T0 + 20 * 86_400_000 + 7_000_000


def written_lake(hp: DataFrame) -> tuple[str, DataFrame]:
    """A lake in three steps: most rows, then late ones of a few dates among which some correct rows that are there, and these again."""
    rows = hp.select("seq", F.when(F.col("seq") % 50 > 0, F.col("raw_ms")).alias("ts_ms"), "source_ip", "service")
    path = f"{shared_folder(hp.sparkSession)}/lake-{uuid.uuid4().hex}"
    late = (F.col("ts_ms") >= LAKE_NOW) & (F.col("ts_ms") < LAKE_NOW + 3 * 86_400_000) & (F.col("seq") % 7 == 0)
    there = F.coalesce(~late, F.lit(True)) | (F.col("seq") % 2 == 0)
    lake.write_dates(rows.where(there).withColumn("service", F.when(late, F.lit("to be corrected")).otherwise(F.col("service"))), path)
    for _ in range(2):
        lake.merge(rows.where(late), path)
    return path, rows


_LAKE = "WITH l AS (SELECT seq, CASE WHEN seq % 50 > 0 THEN raw_ms END AS ts_ms, source_ip, service FROM hp) "


@over_events("f1_lake_export", _LAKE + f"SELECT seq, source_ip, service, ts_ms FROM l WHERE service = 'ssh' AND (ts_ms IS NULL OR ts_ms BETWEEN {LAKE_NOW - 86_400_000} AND {LAKE_NOW + 86_400_000}) ORDER BY seq LIMIT 500")
def _(hp: DataFrame) -> DataFrame:
    path, rows = written_lake(hp)
    found = lake.read(hp.sparkSession, path, rows.schema, LAKE_NOW - lake.DAY_MS, LAKE_NOW + lake.DAY_MS)
    return filters.export(found, service="ssh", limit=500).select("seq", "source_ip", "service", "ts_ms")


@over_events("f12_lake_retained", _LAKE + f"SELECT seq, ts_ms, service FROM l WHERE ts_ms >= {LAKE_NOW}")
def _(hp: DataFrame) -> DataFrame:
    path, rows = written_lake(hp)
    return lake.retained(hp.sparkSession, path, rows.schema, LAKE_NOW + 90 * lake.DAY_MS).select("seq", "ts_ms", "service")


@over_events("f12_lake_expired", _LAKE + f"SELECT seq, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS date, service FROM l WHERE ts_ms IS NULL OR ts_ms >= {LAKE_NOW}")
def _(hp: DataFrame) -> DataFrame:
    path, rows = written_lake(hp)
    lake.expire(hp.sparkSession, path, rows.schema, LAKE_NOW + 90 * lake.DAY_MS)
    return lake.read(hp.sparkSession, path, rows.schema).select("seq", F.col("date").cast("string").alias("date"), "service")


_IPS = "WITH a AS (SELECT source_ip AS ip, min(seq) AS s FROM hp GROUP BY source_ip)"


def _ips(hp: DataFrame) -> DataFrame:
    return hp.groupBy(F.col("source_ip").alias("ip")).agg(F.min("seq").alias("s"))


def _shown(rows: DataFrame) -> DataFrame:
    entries = F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("indicator", "source", F.array_join("categories", ",").alias("categories"), "confidence", F.array_join(entries, ",").alias("tags"), "last_seen")


@over_events("s16_ip_list_feed", _IPS + " SELECT '2001:db8::' || s || '/64' AS indicator, 'l' AS source, 'scan' AS categories, 50 AS confidence, '' AS tags, NULL::VARCHAR AS last_seen FROM a WHERE s % 9999 < 5000 UNION ALL SELECT CASE s % 3 WHEN 1 THEN ip || '/24' ELSE ip END AS indicator, 'l' AS source, 'scan' AS categories, 50 AS confidence, CASE s % 3 WHEN 0 THEN 'comment=seen # once' ELSE '' END AS tags, NULL::VARCHAR AS last_seen FROM a WHERE s % 4 <> 3")
def _(hp: DataFrame) -> DataFrame:
    ip, s = F.col("ip"), F.col("s")
    line = F.when(s % 4 == 3, F.concat(F.lit("# "), ip)).when(s % 3 == 0, F.concat(F.lit("  "), ip, F.lit(" # seen # once"))).when(s % 3 == 1, F.concat(ip, F.lit("/24"))).otherwise(ip)
    bad = _ips(hp).select(F.concat(ip, F.lit(".5")).alias("value"))
    six = _ips(hp).where(s % 9999 < 5000).select(F.concat(F.lit("2001:db8::"), s.cast("string"), F.lit("/64")).alias("value"))
    bad = bad.unionByName(six).unionByName(_ips(hp).select(F.lit("2001:db8::1::2").alias("value")))
    return _shown(feeds.ip_list(_ips(hp).select(line.alias("value")).unionByName(bad), feeds.Feed("l", 50, ("scan",))))


@over_events("s17_csv_feed", _IPS + " SELECT CASE WHEN s % 11 = 0 THEN 'fe80::1' ELSE ip END AS indicator, 'c' AS source, CASE WHEN s % 2 = 0 THEN 'bot' ELSE 'x,y' END AS categories, CASE WHEN s % 3 = 0 THEN 100 WHEN s % 3 = 1 THEN 7 ELSE 33 END AS confidence, CASE WHEN s % 5 = 0 THEN '' ELSE 'note=n' || s END AS tags, NULL::VARCHAR AS last_seen FROM a")
def _(hp: DataFrame) -> DataFrame:
    s = F.col("s")
    rows = _ips(hp).select(F.when(s % 11 == 0, "fe80::1").otherwise(F.col("ip")).alias("ip"), F.when(s % 2 == 0, "bot").otherwise("").alias("category"), F.when(s % 3 == 0, "250").when(s % 3 == 1, "7").otherwise("high").alias("confidence"), F.when(s % 5 == 0, "").otherwise(F.concat(F.lit("n"), s.cast("string"))).alias("note"))
    return _shown(feeds.csv(rows, feeds.Feed("c", 33, ("x", "y"))))


@over_events("s18_abuse_feed", _IPS + " SELECT CASE WHEN s % 13 = 0 THEN '2001:db8::1' ELSE ip END AS indicator, 'ab' AS source, 'abuse' AS categories, least(100, s % 150)::INTEGER AS confidence, 'country=NL,total_reports=' || s AS tags, 't' || s AS last_seen FROM a")
def _(hp: DataFrame) -> DataFrame:
    entry = F.struct(F.when(F.col("s") % 13 == 0, "2001:db8::1").otherwise(F.col("ip")).alias("ipAddress"), (F.col("s") % 150).alias("abuseConfidenceScore"), F.lit("NL").alias("countryCode"), F.col("s").alias("totalReports"), F.concat(F.lit("t"), F.col("s").cast("string")).alias("lastSeen"))
    texts = _ips(hp).groupBy((F.col("s") % 7).alias("file")).agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("value"))
    return _shown(feeds.abuse_json(texts.select("value"), feeds.Feed("ab")))


@over_events("s19_stix_feed", _IPS + " SELECT ip AS indicator, 'st' AS source, CASE WHEN s % 2 = 0 THEN 'c2' ELSE 'd' END AS categories, 50 AS confidence, 'id=i' || s || ',name=n' AS tags, 'm' AS last_seen FROM a UNION ALL SELECT '1.2.3.4', 'st', CASE WHEN s % 2 = 0 THEN 'c2' ELSE 'd' END, 50, 'id=i' || s || ',name=n', 'm' FROM a")
def _(hp: DataFrame) -> DataFrame:
    pattern = F.concat(F.lit("[ipv4-addr:value = '"), F.col("ip"), F.lit("' OR IPV4-ADDR:Value=\"1.2.3.4\"]"))
    labels = F.when(F.col("s") % 2 == 0, F.array(F.lit("c2"))).otherwise(F.array().cast("array<string>"))
    entry = lambda kind: F.struct(F.lit(kind).alias("type"), F.concat(F.lit("i"), F.col("s").cast("string")).alias("id"), F.lit("n").alias("name"), pattern.alias("pattern"), labels.alias("labels"), F.lit("m").alias("modified"))
    texts = _ips(hp).groupBy((F.col("s") % 7).alias("file")).agg(F.to_json(F.struct(F.concat(F.collect_list(entry("indicator")), F.collect_list(entry("malware"))).alias("objects"))).alias("value"))
    return _shown(feeds.stix2_json(texts.select("value"), feeds.Feed("st", 50, ("d",))))


@over_events("s21_loaded_feeds", _IPS + " SELECT 'one' AS source, 0::BIGINT AS number, ip AS indicator, 50 AS confidence FROM a UNION ALL SELECT 'two', 1, ip, 50 FROM a WHERE ip LIKE '10.%'")
def _(hp: DataFrame) -> DataFrame:
    lines = _ips(hp).select(F.col("ip").alias("value"))
    table = feeds.load(None, lines, feeds.Feed("one"), "ip_list", 0, 0)
    table = feeds.load(table, lines.where(F.col("value").startswith("10.")), feeds.Feed("two"), "no such kind", 1, 0)
    return table.select("source", F.shiftright("load_seq", 40).alias("number"), "indicator", "confidence")


@over_events("n17_probe_previews", "SELECT seq, left(sha256(payload), 16) AS digest, lower(left(hex(encode(payload)), 16)) AS preview FROM hp")
def _(hp: DataFrame) -> DataFrame:
    data = F.col("payload").cast("binary")
    return hp.select("seq", probes.short_digest(data).alias("digest"), probes.preview(data, 8).alias("preview"))


@over_events("n18_rdp_protocols", "SELECT seq, CASE WHEN seq % 32 = 0 THEN '' WHEN seq % 32 >= 16 AND seq % 16 = 0 THEN 'unknown_mask:0x00000010' ELSE concat_ws(',', CASE WHEN seq % 2 = 1 THEN 'ssl' END, CASE WHEN seq // 2 % 2 = 1 THEN 'hybrid' END, CASE WHEN seq // 4 % 2 = 1 THEN 'rdstls' END, CASE WHEN seq // 8 % 2 = 1 THEN 'hybrid_ex' END) END AS names FROM hp")
def _(hp: DataFrame) -> DataFrame:
    mask = F.lpad(F.hex(F.col("seq") % 32), 2, "0")
    data = F.unhex(F.concat(F.lit("0300001301"), F.lit("01000800"), mask, F.lit("000000")))
    return hp.select("seq", F.array_join(probes.rdp_protocols(data), ",").alias("names"))


@over_events("n19_ftp_replies", """WITH s AS (SELECT source_ip, seq, CASE k % 5 WHEN 0 THEN 'USER' WHEN 1 THEN 'PASS' WHEN 2 THEN 'LIST' WHEN 3 THEN 'WHAT' ELSE '' END AS command, 'u' || k AS arg FROM hp WHERE service = 'ftp')
SELECT seq, command, CASE command WHEN 'USER' THEN 331 WHEN 'PASS' THEN 530 WHEN 'LIST' THEN 550 ELSE 500 END AS reply, coalesce(last_value(CASE WHEN command = 'USER' THEN arg END IGNORE NULLS) OVER (PARTITION BY source_ip ORDER BY seq), CASE WHEN command = 'PASS' THEN 'anonymous' END) AS username FROM s""")
def _(hp: DataFrame) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("user ", "Pass ", "list ", "what "))), (F.col("k") % 5 + 1).cast("int"))
    line = F.when(F.col("k") % 5 == 4, "  ").otherwise(F.concat(word, F.lit("u"), F.col("k").cast("string"), F.lit("\r\n")))
    rows = hp.where("service = 'ftp'").select(F.col("source_ip").alias("session"), "seq", F.when(F.col("k") % 5 < 4, line).otherwise("  ").alias("line"))
    return probes.ftp_commands(rows).select("seq", "command", "reply", "username")


@over_events("n20_redis_commands", """SELECT seq, k % 6 AS p, CASE k % 6 WHEN 3 THEN 'auth_attempt' WHEN 4 THEN 'ping' ELSE 'unauthenticated' END AS kind, CASE k % 6 WHEN 3 THEN 'x' END AS password FROM hp""")
def _(hp: DataFrame) -> DataFrame:
    rows = hp.select("seq", (F.col("k") % 6).alias("p"), F.col("payload").cast("binary").alias("data"))
    return probes.redis_commands(rows).select("seq", "p", "kind", "password")


@over_events("n21_mysql_logins", "SELECT seq, CASE WHEN seq % 9 = 0 THEN '' ELSE coalesce(username, '') END AS username, CASE WHEN seq % 9 = 0 THEN '' ELSE lower(hex(encode(source_ip))) END AS auth FROM hp")
def _(hp: DataFrame) -> DataFrame:
    size = F.lpad(F.hex(F.length("source_ip")), 2, "0")
    body = F.concat(F.lit("00" * 36), F.hex(F.coalesce("username", F.lit("")).cast("binary")), F.lit("00"), size, F.hex(F.col("source_ip").cast("binary")))
    data = F.when(F.col("seq") % 9 == 0, F.unhex(F.lit("00" * 20))).otherwise(F.unhex(body))
    login = probes.mysql_login(data)
    return hp.select("seq", login["username"].alias("username"), login["auth"].alias("auth"))


@over_events("n24_json_rows", """SELECT seq, '{"ip":"' || source_ip || '","ports":[' || dest_port || '],"masked":' || coalesce('"' || credential || '"', 'null') || '}' AS value FROM hp""")
def _(hp: DataFrame) -> DataFrame:
    row = F.struct(F.col("source_ip").alias("ip"), F.array("dest_port").alias("ports"), mask_credential(F.col("password")).alias("masked"))
    return hp.select("seq", F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))
