"""Queries of joins: geo, intelligence, canary tokens, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.functions.fields import callback_url, token_fingerprint
from sundew.functions import summaries
from sundew.functions.net import ipv4_long
from sundew.operators import blocklist, canary, dashboards, fingerprints, geo, intel
from sundew.plans.events import HP_SQL, T0, attack_events
from sundew.plans.tables import materialize
from sundew.queries.registry import over_events, over_tables
from sundew.sources import geo_records as geo_db

_GEO = "hp.*, CASE WHEN source_ip LIKE '10.%' THEN '--' WHEN source_ip LIKE '203.%' THEN '??' ELSE 'US' END AS cc, CASE WHEN source_ip LIKE '8.8.8.%' THEN 15169 WHEN source_ip LIKE '3.80.%' THEN 16509 WHEN source_ip LIKE '198.20.99.%' THEN 20473 END AS asn, CASE WHEN source_ip LIKE '8.8.8.%' THEN 'Google LLC' WHEN source_ip LIKE '3.80.%' THEN 'Amazon.com, Inc.' WHEN source_ip LIKE '198.20.99.%' THEN 'Shodan.io' END AS org"


@over_events("j3_known_prefixes", f"SELECT DISTINCT source_ip AS ip, cc AS country_code, asn::INTEGER AS asn, org FROM (SELECT {_GEO} FROM hp)")
def _(hp: DataFrame) -> DataFrame:
    return geo.resolve(hp.select(F.col("source_ip").alias("ip")), geo.known_prefixes(hp.sparkSession)).select("ip", "country_code", "asn", "org")


def geo_ranges(hp: DataFrame) -> DataFrame:
    """A range table made of the events: the lower half of every seen 203.0.x.0/24, numbered by network."""
    nets = hp.where(F.col("source_ip").startswith("203.")).select((F.floor(ipv4_long(F.col("source_ip")) / 256) * 256).alias("ip_from")).distinct()
    n = (F.col("ip_from") / 256 % 256).cast("int")
    return nets.select("ip_from", (F.col("ip_from") + 127).alias("ip_to"), F.lit("ZZ").alias("country_code"), F.lit("Testland").alias("country_name"), F.lit(None).cast("string").alias("city"),
                       F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), (n + 64500).alias("asn"), F.concat(F.lit("Net "), n.cast("string")).alias("org"))


@over_events("j4_geo_ranges", f"""SELECT DISTINCT source_ip AS ip, CASE WHEN low THEN 'ZZ' ELSE cc END AS country_code, CASE WHEN low THEN 64500 + split_part(source_ip, '.', 3)::INT ELSE asn END::INTEGER AS asn, CASE WHEN low THEN 'range' ELSE 'stub' END AS geo_source
  FROM (SELECT {_GEO}, source_ip LIKE '203.%' AND split_part(source_ip, '.', 4)::INT < 128 AS low FROM hp)""")
def _(hp: DataFrame) -> DataFrame:
    return geo.resolve(hp.select(F.col("source_ip").alias("ip")), geo.known_prefixes(hp.sparkSession), geo_ranges(hp)).select("ip", "country_code", "asn", "geo_source")


@over_events("s20_geo_records", f"""SELECT DISTINCT source_ip AS ip, CASE WHEN low THEN 'ZZ' WHEN high THEN '??' ELSE cc END AS country_code, CASE WHEN low THEN 'Testland' ELSE CASE WHEN source_ip LIKE '203.%' THEN 'Unknown' END END AS country_name, CASE WHEN low OR high THEN 'range' ELSE 'stub' END AS geo_source
  FROM (SELECT {_GEO}, source_ip LIKE '203.%' AND split_part(source_ip, '.', 4)::INT < 128 AS low, source_ip LIKE '203.%' AND split_part(source_ip, '.', 4)::INT >= 192 AS high FROM hp) WHERE source_ip LIKE '203.%'""")
def _(hp: DataFrame) -> DataFrame:
    """Records of the seen 203.0.x.0/24: a full one for the lower half, one without a country for the last quarter, a broken one between."""
    net = hp.where(F.col("source_ip").startswith("203.")).select(F.substring_index("source_ip", ".", 3).alias("net")).distinct()
    made = F.array(*(F.struct(F.lit(end).alias("end"), F.lit(text).alias("record")) for end, text in ((".0/25", '{"country": {"iso_code": "ZZ", "names": {"en": "Testland"}}}'), (".192/26", '{"city": null}'), (".128/26", "{broken"))))
    rows = net.select("net", F.explode(made).alias("m")).select(F.concat("net", "m.end").alias("network"), "m.record")
    ips = hp.where(F.col("source_ip").startswith("203.")).select(F.col("source_ip").alias("ip"))
    return geo.resolve(ips, geo.known_prefixes(hp.sparkSession), geo_db.ranges(rows)).select("ip", "country_code", "country_name", "geo_source")


# Networks of both kinds that lie in each other, and one without a country; both halves of a /24 are in it.
_NETS = """ FROM (SELECT DISTINCT source_ip AS ip, split_part(source_ip, '.', 4)::INT AS o FROM hp), (SELECT unnest([false, true]) AS six)"""


@over_events("s20_geo_spans", """SELECT DISTINCT CASE WHEN six THEN '2001:db8:0:' || lower(to_hex(o)) || '::' || lower(to_hex(o)) ELSE ip END AS ip,
  CASE WHEN six THEN CASE WHEN o % 3 = 0 THEN 'Z' || o % 10 WHEN o // 16 = 2 THEN '??' ELSE 'WW' END WHEN ip LIKE '10.%' THEN '--' WHEN ip LIKE '203.%' THEN CASE WHEN o < 128 THEN 'YY' ELSE 'ZZ' END ELSE 'US' END AS country_code,
  CASE WHEN six OR ip LIKE '203.%' THEN 'range' ELSE 'stub' END AS geo_source""" + _NETS)
def _(hp: DataFrame) -> DataFrame:
    octet = F.element_at(F.split("source_ip", r"\."), 4).cast("int")
    hexed = F.lower(F.hex("o"))
    # the records and the addresses read it a dozen times
    seen = materialize(hp.select(F.col("source_ip").alias("ip"), octet.alias("o")).distinct(), "seen-addresses")
    six = seen.select(F.concat(F.lit("2001:db8:0:"), hexed, F.lit("::"), hexed).alias("ip"), "o").distinct()
    record = lambda code: F.concat(F.lit('{"country": {"iso_code": "'), code, F.lit('"}}'))
    one = lambda df, network, text: df.select(network.alias("network"), text.alias("record"))
    nets = seen.where(F.col("ip").startswith("203.")).select(F.substring_index("ip", ".", 3).alias("net")).distinct()
    rows = one(nets, F.concat("net", F.lit(".0/24")), record(F.lit("ZZ"))).unionByName(one(nets, F.concat("net", F.lit(".5/25")), record(F.lit("YY"))))
    rows = rows.unionByName(one(six.where("o % 3 = 0"), F.concat(F.lit("2001:0DB8:0:"), hexed, F.lit("::/64")), record(F.concat(F.lit("Z"), (F.col("o") % 10).cast("string")))))
    # a wide one, one of sixteen networks without a country, a broken one, and one that no address lies in
    fixed = (("2001:db8::/32", record(F.lit("WW"))), ("2001:db8:0:20::/60", F.lit('{"city": null}')), ("2001:db8::/40", F.lit("{broken")), ("2001:db9::/32", record(F.lit("NO"))))
    for network, text in fixed:
        rows = rows.unionByName(one(six.limit(1), F.lit(network), text))
    return geo.resolve(seen.select("ip").unionByName(six.select("ip")), geo.known_prefixes(hp.sparkSession), geo_db.spans(rows)).select("ip", "country_code", "geo_source")


@over_events("j3_private_v6", "SELECT ip, ip IN ('::1', 'fc00::1', '0:0:0:0:0:0:0:1', 'FD12::2') OR starts_with(ip, '10.') AS is_private, CASE WHEN ip IN ('::1', 'fc00::1', '0:0:0:0:0:0:0:1', 'FD12::2') OR starts_with(ip, '10.') THEN '--' WHEN NOT contains(ip, ':') THEN cc ELSE '??' END AS country_code FROM (SELECT DISTINCT source_ip AS ip, cc FROM (SELECT *, " + _GEO + " FROM hp) UNION SELECT unnest(['::1', 'fc00::1', '0:0:0:0:0:0:0:1', 'FD12::2', 'fe80::1', '2001:db8::1']), NULL)")
def _(hp: DataFrame) -> DataFrame:
    spark = hp.sparkSession
    more = spark.createDataFrame([(i,) for i in ("::1", "fc00::1", "0:0:0:0:0:0:0:1", "FD12::2", "fe80::1", "2001:db8::1")], "ip string")
    return geo.resolve(hp.select(F.col("source_ip").alias("ip")).unionByName(more), geo.known_prefixes(spark)).select("ip", "is_private", "country_code")


@over_events("j5_enriched", f"SELECT seq, cc AS country_code, org FROM (SELECT {_GEO} FROM hp)")
def _(hp: DataFrame) -> DataFrame:
    return geo.enrich(hp, geo.known_prefixes(hp.sparkSession)).select("seq", "country_code", "org")


@over_events("a5_countries", f"SELECT cc AS country_code, CASE cc WHEN '--' THEN 'Private/Reserved' WHEN '??' THEN 'Unknown' ELSE 'United States' END AS country_name, count(*) AS n FROM (SELECT {_GEO} FROM hp) GROUP BY cc")
def _(hp: DataFrame) -> DataFrame:
    return dashboards.countries(geo.enrich(hp, geo.known_prefixes(hp.sparkSession)))


_SIGNALS = f"""WITH g AS (SELECT {_GEO}, seq % 11 = 0 AS tor0, source_ip LIKE '%.7' AS listed FROM hp),
n AS (SELECT *, CASE WHEN asn IS NOT NULL THEN row_number() OVER (PARTITION BY asn ORDER BY seq) END AS cnt FROM g),
s AS (SELECT seq, source_ip, (cc = '??')::INT * 35 + coalesce(lower(org) LIKE '%google%' OR lower(org) LIKE '%amazon%', false)::INT * 20 + (tor0 OR listed)::INT * 40 + coalesce(cnt > 5, false)::INT * 25 AS raw,
  concat_ws(',', CASE WHEN cc = '??' THEN 'GEO-001:??' END, CASE WHEN lower(org) LIKE '%amazon%' THEN 'GEO-002:amazon' WHEN lower(org) LIKE '%google%' THEN 'GEO-002:google' END, CASE WHEN tor0 OR listed THEN 'GEO-004:' || source_ip END, CASE WHEN cnt > 5 THEN 'GEO-005:' || cnt END) AS signals FROM n)
"""


def geo_records(hp: DataFrame) -> DataFrame:
    rows = geo.enrich(hp, geo.known_prefixes(hp.sparkSession))
    exits = hp.where(F.col("source_ip").endswith(".7")).select(F.col("source_ip").alias("ip")).distinct()
    records = rows.select("seq", F.col("source_ip").alias("ip"), "country_code", "asn", F.coalesce("org", F.lit("")).alias("asn_name"), (F.col("seq") % 11 == 0).alias("is_tor"))
    return geo.geo_signals(records, ("??",), exits)


@over_events("w18_geo_signals", _SIGNALS + "SELECT seq, signals FROM s")
def _(hp: DataFrame) -> DataFrame:
    return geo_records(hp).select("seq", F.array_join(F.transform("signals", lambda x: F.concat(x["id"], F.lit(":"), x["match"])), ",").alias("signals"))


@over_events("a30_geo_risk", _SIGNALS + "SELECT seq, least(100, raw)::INTEGER AS risk_score, CASE WHEN raw >= 80 THEN 'CRITICAL' WHEN raw >= 55 THEN 'HIGH' WHEN raw >= 35 THEN 'MEDIUM' WHEN raw >= 15 THEN 'LOW' ELSE 'INFO' END AS risk_level FROM s")
def _(hp: DataFrame) -> DataFrame:
    return geo_records(hp).select("seq", "risk_score", "risk_level")


@over_events("n23_geo_summary", _SIGNALS + "SELECT n.seq, n.source_ip || ' [' || n.cc || '] risk=' || least(100, raw) || ' (' || CASE WHEN raw >= 80 THEN 'CRITICAL' WHEN raw >= 55 THEN 'HIGH' WHEN raw >= 35 THEN 'MEDIUM' WHEN raw >= 15 THEN 'LOW' ELSE 'INFO' END || '): ' || CASE WHEN signals = '' THEN 0 ELSE len(string_split(signals, ',')) END || ' signal(s)' AS line FROM s JOIN n USING (seq)")
def _(hp: DataFrame) -> DataFrame:
    return geo_records(hp).select("seq", summaries.geo_alert().alias("line"))


@over_events("j8_tor", "SELECT seq, seq % 11 = 0 OR source_ip LIKE '%.7' AS is_tor FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return geo_records(hp).select("seq", "is_tor")


# A feed made of the events: single addresses that end in 1, networks of several lengths, repeats, and stale rows.
_FEED = f"""WITH a AS (SELECT source_ip AS ip, min(seq) AS s FROM hp GROUP BY source_ip),
feed AS (SELECT ip AS indicator, 'exact' AS source, 90 AS confidence, s AS load_seq, {T0} + (s % 3) * 1000 AS cached_ms FROM a WHERE ip LIKE '%1'
  UNION ALL SELECT ip, 'exact2', 95, s + 1000000000, {T0} + 2000 FROM a WHERE ip LIKE '%11'
  UNION ALL SELECT regexp_extract(ip, '^(.*)\\.[0-9]+$', 1) || '.0/24', 'wide', 40, min(s) + 5, {T0} + 1000 FROM a WHERE ip NOT LIKE '10.%' GROUP BY 1
  UNION ALL SELECT regexp_extract(ip, '^(.*)\\.[0-9]+$', 1) || '.64/26', 'narrow', 60, min(s) + 3, {T0} + 2000 FROM a GROUP BY 1)"""


def feed_of(hp: DataFrame) -> DataFrame:
    # four kinds of rows are made of the addresses
    a = materialize(hp.groupBy(F.col("source_ip").alias("ip")).agg(F.min("seq").alias("s")), "feed-addresses")
    row = lambda df, ind, source, conf, seq, cached: df.select(ind.alias("indicator"), F.lit(source).alias("source"), F.array(F.lit("scan")).alias("categories"), F.lit(conf).alias("confidence"), seq.alias("load_seq"), (F.lit(T0) + cached).alias("cached_ms"))
    net = a.withColumn("n", F.substring_index("ip", ".", 3))
    group = lambda df: df.groupBy("n").agg(F.min("s").alias("s"))
    s = F.col("s")
    return (
        row(a.where(F.col("ip").endswith("1")), F.col("ip"), "exact", 90, s, s % 3 * 1000)
        .unionByName(row(a.where(F.col("ip").endswith("11")), F.col("ip"), "exact2", 95, s + 1_000_000_000, F.lit(2000)))
        .unionByName(row(group(net.where(~F.col("ip").startswith("10."))), F.concat("n", F.lit(".0/24")), "wide", 40, s + 5, F.lit(1000)))
        .unionByName(row(group(net), F.concat("n", F.lit(".64/26")), "narrow", 60, s + 3, F.lit(2000)))
    )


_HIT = """, x AS (SELECT ip, arg_max(f.source, f.load_seq) AS src, max(f.load_seq) AS ls FROM a JOIN {feed} f ON f.indicator = a.ip GROUP BY ip),
c AS (SELECT a.ip, f.source AS src, f.indicator AS cidr, f.load_seq AS ls, row_number() OVER (PARTITION BY a.ip ORDER BY f.load_seq) AS k FROM a JOIN {feed} f ON contains(f.indicator, '/') AND regexp_extract(f.indicator, '^(.*)\\.[0-9]+/', 1) = regexp_extract(a.ip, '^(.*)\\.[0-9]+$', 1)
  AND (f.indicator LIKE '%/24' OR split_part(a.ip, '.', 4)::INT BETWEEN 64 AND 127)),
m AS (SELECT a.ip, coalesce(x.src, c.src) AS source, CASE WHEN x.src IS NULL THEN c.cidr END AS matched_cidr FROM a LEFT JOIN x ON x.ip = a.ip LEFT JOIN c ON c.ip = a.ip AND c.k = 1)
"""


@over_events("j2_intel_lookup", _FEED + _HIT.format(feed="feed") + "SELECT * FROM m")
def _(hp: DataFrame) -> DataFrame:
    return intel.lookup(hp.select(F.col("source_ip").alias("ip")), feed_of(hp)).select("ip", F.col("intel.source").alias("source"), "matched_cidr")


@over_events("j1_intel_exact", _FEED + _HIT.format(feed="feed") + "SELECT ip, src AS source FROM x")
def _(hp: DataFrame) -> DataFrame:
    return hp.select(F.col("source_ip").alias("ip")).distinct().join(intel.exact_table(feed_of(hp)), "ip").select("ip", F.col("exact.source").alias("source"))


@over_events("j6_intel_enriched", _FEED + _HIT.format(feed="feed") + "SELECT seq, m.source, m.matched_cidr FROM hp JOIN m ON m.ip = hp.source_ip")
def _(hp: DataFrame) -> DataFrame:
    return intel.enrich(hp, feed_of(hp)).select("seq", F.col("intel.source").alias("source"), "matched_cidr")


@over_events("j7_intel_fresh", _FEED + f", young AS (SELECT * FROM feed WHERE {T0} + 3000 - cached_ms <= 2000)" + _HIT.format(feed="young") + "SELECT * FROM m")
def _(hp: DataFrame) -> DataFrame:
    return intel.lookup(hp.select(F.col("source_ip").alias("ip")), intel.fresh(feed_of(hp), T0 + 3000, 2000)).select("ip", F.col("intel.source").alias("source"), "matched_cidr")


@over_events("a26_intel_stats", _FEED + " SELECT count(DISTINCT indicator) FILTER (NOT contains(indicator, '/')) AS exact, count(DISTINCT indicator) FILTER (contains(indicator, '/')) AS cidr, count(DISTINCT indicator) AS total, 3600::BIGINT AS ttl_seconds FROM feed")
def _(hp: DataFrame) -> DataFrame:
    return intel.table_stats(feed_of(hp))


# Fingerprints.
_PAIRS = " OR ".join(f"(u = '{u}' AND p = '{p}')" for u, p in fingerprints.BOT_PAIRS if u or p)
_FACTS = f"""WITH e AS (SELECT *, coalesce(username, '') AS u, coalesce(password, '') AS p FROM hp),
f AS (SELECT source_ip, count(*) AS n, count(DISTINCT username) AS users, (max(ts_ms) - min(ts_ms)) / 1000.0 / nullif(count(*) - 1, 0) AS gap,
  coalesce(bool_or(regexp_matches(user_agent, '(?i)shodan')), false) AS sh, coalesce(bool_or(regexp_matches(user_agent, '(?i)masscan')), false) AS ma, coalesce(bool_or(regexp_matches(user_agent, '(?i)zgrab')), false) AS zg,
  count(DISTINCT (u, p)) FILTER ({_PAIRS}) AS bots, bool_and(dest_port IN (21, 22, 80, 3389, 8443)) AS in_set FROM e GROUP BY source_ip),
s AS (SELECT *, sh::INT * 0.8::DOUBLE + in_set::INT * 0.2::DOUBLE AS s0, ma::INT * 0.8::DOUBLE + coalesce(gap < 0.5, false)::INT * 0.4::DOUBLE + (n >= 10 AND users = 0)::INT * 0.2::DOUBLE AS s1, zg::INT * 0.9::DOUBLE AS s2, 0.0::DOUBLE AS s3,
  least(0.7::DOUBLE, bots * 0.15::DOUBLE) + coalesce(gap > 0.5 AND gap < 2, false)::INT * 0.25::DOUBLE AS s4, coalesce(gap >= 2 AND gap < 5, false)::INT * 0.4::DOUBLE + (users BETWEEN 1 AND 3 AND n >= 5)::INT * 0.3::DOUBLE AS s5,
  coalesce(gap >= 5, false)::INT * 0.6::DOUBLE + (n <= 5)::INT * 0.2::DOUBLE AS s6 FROM f),
b AS (SELECT *, greatest(s0, s1, s2, s3, s4, s5, s6) AS best FROM s),
r AS (SELECT *, CASE WHEN n < 3 OR best < 0.1 THEN 'UNKNOWN' WHEN s0 = best THEN 'SHODAN' WHEN s1 = best THEN 'MASSCAN' WHEN s2 = best THEN 'ZGRAB' WHEN s3 = best THEN 'METASPLOIT' WHEN s4 = best THEN 'CREDENTIAL_STUFFING_BOT' WHEN s5 = best THEN 'CUSTOM_SCRIPT' ELSE 'HUMAN' END AS scanner,
  CASE WHEN n < 3 THEN 0.0 ELSE least(1.0, best) END AS score FROM b)
"""


@over_events("a21_fingerprint_facts", _FACTS + "SELECT source_ip, n AS events, users::INTEGER AS users, bots AS bot_pairs, sh AS shodan_ua, round(gap, 6) AS gap FROM f")
def _(hp: DataFrame) -> DataFrame:
    return fingerprints.facts(hp).select("source_ip", "events", F.col("users").cast("int").alias("users"), "bot_pairs", "shodan_ua", F.round("gap_s", 6).alias("gap"))


@over_events("a23_fingerprints", _FACTS + "SELECT source_ip, scanner, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM r")
def _(hp: DataFrame) -> DataFrame:
    return fingerprints.fingerprints(hp, 3).select("source_ip", "scanner", F.round("score", 6).alias("score"), "confidence")


_SECS = "CAST(round(CAST(gap AS DECIMAL(30, 9)), {n}) AS DECIMAL(30, {n}))::VARCHAR"


@over_events("a25_fingerprint_signals", _FACTS + f""", g AS (SELECT source_ip, array_to_string(list_sort(list_distinct(list(dest_port))), ', ') AS ports FROM hp GROUP BY 1),
q AS (SELECT source_ip, array_to_string(list_sort(list_distinct(list((u, p))))[1:3].list_transform(lambda x: '(' || chr(39) || x[1] || chr(39) || ', ' || chr(39) || x[2] || chr(39) || ')'), ', ') AS sample FROM e WHERE {_PAIRS} GROUP BY 1)
SELECT f.source_ip, concat_ws('; ', CASE WHEN sh THEN 'Shodan User-Agent detected' END, CASE WHEN in_set THEN 'Ports match Shodan probe set: [' || ports || ']' END, CASE WHEN ma THEN 'Masscan User-Agent detected' END,
  CASE WHEN gap < 0.5 THEN 'Ultra-fast timing (avg ' || {_SECS.format(n=3)} || 's) consistent with masscan' END, CASE WHEN n >= 10 AND users = 0 THEN 'High probe volume with no credentials — port scan pattern' END, CASE WHEN zg THEN 'ZGrab signature detected in UA or payload' END,
  CASE WHEN bots > 0 THEN bots || ' known bot credential pair(s): [' || sample || ']' END, CASE WHEN gap > 0.5 AND gap < 2 THEN 'Bot-speed timing (avg ' || {_SECS.format(n=2)} || 's)' END, CASE WHEN gap >= 2 AND gap < 5 THEN 'Script-speed timing (avg ' || {_SECS.format(n=2)} || 's)' END,
  CASE WHEN users BETWEEN 1 AND 3 AND n >= 5 THEN 'Low username diversity (' || users || ') with high volume' END, CASE WHEN gap >= 5 THEN 'Human-speed timing (avg ' || {_SECS.format(n=2)} || 's)' END, CASE WHEN n <= 5 THEN 'Low event count consistent with manual exploration' END) AS signals
FROM f JOIN g USING (source_ip) LEFT JOIN q USING (source_ip)""")
def _(hp: DataFrame) -> DataFrame:
    return fingerprints.fingerprints(hp).select("source_ip", F.array_join("signals", "; ").alias("signals"))


@over_events("j9_bot_pairs", _FACTS + "SELECT source_ip, bots AS bot_pairs FROM f WHERE bots > 0")
def _(hp: DataFrame) -> DataFrame:
    return fingerprints.facts(hp).where("bot_pairs > 0").select("source_ip", "bot_pairs")


@over_events("a24_one_fingerprint", _FACTS + "SELECT source_ip, scanner FROM r WHERE source_ip = '8.8.8.2'")
def _(hp: DataFrame) -> DataFrame:
    return fingerprints.fingerprint_of(hp, "8.8.8.2", 3).select("source_ip", "scanner")


# Canary tokens: a registry made of customers, triggered by ftp events of the user with the token's number.
_REG = f"""WITH {HP_SQL}, reg AS (SELECT c_custkey AS token_id, ['HTTP_URL', 'API_KEY', 'CRED_PAIR', 'ENV_VAR', 'DOC_EMBED'][c_custkey % 5 + 1] AS token_type, c_name AS label, c_mktsegment AS owner FROM customer),
trig AS (SELECT seq, ts_ms, user_id AS token_id, source_ip FROM hp WHERE service = 'ftp'), t AS (SELECT token_id, min(ts_ms) AS first_ms, count(*) AS n FROM trig GROUP BY token_id)
"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("token_id"), F.element_at(F.array(*map(F.lit, canary.TYPES)), (F.col("c_custkey") % 5 + 1).cast("int")).alias("token_type"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("owner"))


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attack_events(spark, sf_dir).where("service = 'ftp'").select("seq", "ts_ms", F.col("user_id").alias("token_id"), "source_ip")


@over_tables("j10_canary_alerts", _REG + "SELECT seq, trig.token_id, label, row_number() OVER (PARTITION BY trig.token_id ORDER BY ts_ms, seq)::INTEGER AS trigger_count FROM trig JOIN reg USING (token_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canary.alerts(triggers(spark, sf_dir), registry(spark, sf_dir)).select("seq", "token_id", "label", "trigger_count")


@over_tables("a28_canary_rollup", _REG + "SELECT token_id, first_ms AS first_trigger_ms, coalesce(n, 0) AS trigger_count, n IS NOT NULL AS triggered FROM reg LEFT JOIN t USING (token_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canary.rolled_up(triggers(spark, sf_dir), registry(spark, sf_dir)).select("token_id", "first_trigger_ms", "trigger_count", "triggered")


@over_tables("f6_triggered_tokens", _REG + "SELECT token_id, owner FROM reg SEMI JOIN t USING (token_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canary.rolled_up(triggers(spark, sf_dir), registry(spark, sf_dir)).where("triggered").select("token_id", "owner")


@over_tables("a27_canary_stats", _REG + "SELECT token_type, count(*) AS tokens, count(n) AS triggered FROM reg LEFT JOIN t USING (token_id) GROUP BY token_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canary.stats(canary.rolled_up(triggers(spark, sf_dir), registry(spark, sf_dir)))


@over_tables("w21_trigger_numbers", _REG + "SELECT token_id, max(k)::INTEGER AS last_number FROM (SELECT token_id, row_number() OVER (PARTITION BY token_id ORDER BY ts_ms, seq) AS k FROM trig JOIN reg USING (token_id)) GROUP BY token_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canary.alerts(triggers(spark, sf_dir), registry(spark, sf_dir)).groupBy("token_id").agg(F.max("trigger_count").alias("last_number"))


@over_tables("n26_token_fingerprints", "SELECT c_custkey AS token_id, left(sha256(c_custkey::VARCHAR || c_name), 16) AS fingerprint, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'https://c.example/alert/' || c_custkey END AS url FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("token_id").cast("string")
    return registry(spark, sf_dir).select("token_id", token_fingerprint(text, F.col("label")).alias("fingerprint"), callback_url(F.col("token_type"), F.col("label"), text, "https://c.example").alias("url"))


@over_tables("o8_registry", "SELECT c_custkey AS token_id, c_name AS label, c_mktsegment AS owner FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select("token_id", "label", "owner")


@over_events("j2_intel_v6", """WITH a AS (SELECT DISTINCT source_ip AS ip FROM hp), n AS (SELECT ip, split_part(ip, '.', 4)::INT AS o FROM a), v AS (SELECT '2001:db8:0:' || lower(to_hex(o)) || '::' || lower(to_hex(o)) AS ip, min(o) AS o FROM n GROUP BY 1)
SELECT ip, CASE WHEN o % 3 = 0 THEN 'exact' WHEN o // 16 = 2 THEN 'net' END AS source, CASE WHEN o % 3 <> 0 AND o // 16 = 2 THEN '2001:db8:0:20::/60' END AS matched_cidr FROM v""")
def _(hp: DataFrame) -> DataFrame:
    """Addresses of the other kind, written in two ways: each 2001:db8:0:x::x of a last octet x."""
    octet = F.element_at(F.split("source_ip", r"\."), 4).cast("int")
    digits = F.lower(F.hex(octet))
    seen = hp.select(octet.alias("o"), F.concat(F.lit("2001:db8:0:"), digits, F.lit("::"), digits).alias("ip"), F.concat(F.lit("2001:0DB8:0000:"), F.upper(digits), F.lit(":0:0:0:"), digits).alias("long")).distinct()
    row = lambda df, ind, source, seq: df.select(ind.alias("indicator"), F.lit(source).alias("source"), F.array(F.lit("scan")).alias("categories"), F.lit(50).alias("confidence"), seq.cast("long").alias("load_seq"), F.lit(T0).alias("cached_ms"))
    feed = row(seen.where("o % 3 = 0"), F.col("long"), "exact", F.col("o")).unionByName(row(seen.where("o between 32 and 47").limit(1), F.lit("2001:db8:0:20::/60"), "net", F.lit(1)))
    return intel.lookup(seen.select("ip"), feed).select("ip", F.col("intel.source").alias("source"), "matched_cidr")


# Blocks.
_DECIDE = "CASE WHEN seq % 13 = 0 THEN 'missing_source_ip' WHEN seq % 13 = 1 THEN 'invalid_source_ip' WHEN seq % 4 = 0 THEN 'severity_below_threshold:low' WHEN seq % 4 = 1 THEN 'severity_below_threshold:odd' ELSE service END"


def decided(hp: DataFrame) -> DataFrame:
    ip = F.when(F.col("seq") % 13 == 0, "").when(F.col("seq") % 13 == 1, F.concat("source_ip", F.lit(".9"))).when(F.col("seq") % 13 == 2, F.lit("2001:db8::7")).otherwise(F.col("source_ip"))
    severity = F.element_at(F.array(*map(F.lit, ("low", "odd", "high", "Critical"))), (F.col("seq") % 4 + 1).cast("int"))
    return blocklist.decisions(hp.select("seq", ip.alias("source_ip"), severity.alias("severity"), F.col("service").alias("event_type")))


@over_events("f5_block_decisions", f"SELECT seq, {_DECIDE} AS block_reason, seq % 13 > 1 AND seq % 4 > 1 AS should_block FROM hp")
def _(hp: DataFrame) -> DataFrame:
    return decided(hp).select("seq", "block_reason", "should_block")


@over_events("j11_new_blocks", "WITH d AS (SELECT CASE WHEN seq % 13 = 2 THEN '2001:db8::7' ELSE source_ip END AS source_ip, min((seq, service)) AS f FROM hp WHERE seq % 13 > 1 AND seq % 4 > 1 AND (seq % 13 = 2 OR NOT source_ip LIKE '10.%') GROUP BY 1) SELECT source_ip, f[2] AS reason, f[1] AS seq FROM d")
def _(hp: DataFrame) -> DataFrame:
    blocked = hp.where(F.col("source_ip").startswith("10.")).select("source_ip")
    return blocklist.new_blocks(decided(hp), blocked).select("source_ip", "reason", "seq")
