"""Places and networks of addresses, and geo signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.functions.fields import geo_level
from sundew.functions.net import address_hex, ipv4_long, is_private
from sundew.plans.intervals import covering
from sundew.plans.tables import lookup, materialize, ranked

# Known prefixes in order of precedence, and keywords in order.
KNOWN_PREFIXES = (
    ("1.1.1.", "AU", "Australia", "Research", -37.7, 145.1, 13335, "Cloudflare, Inc."),
    ("1.0.0.", "AU", "Australia", "Research", -37.7, 145.1, 13335, "Cloudflare, Inc."),
    ("8.8.8.", "US", "United States", "Mountain View", 37.4, -122.1, 15169, "Google LLC"),
    ("8.8.4.", "US", "United States", "Mountain View", 37.4, -122.1, 15169, "Google LLC"),
    ("3.80.", "US", "United States", "Ashburn", 39.0, -77.5, 16509, "Amazon.com, Inc."),
    ("52.0.", "US", "United States", "Ashburn", 39.0, -77.5, 16509, "Amazon.com, Inc."),
    ("20.0.", "US", "United States", "Des Moines", 41.6, -93.6, 8075, "Microsoft Corporation"),
    ("198.20.99.", "US", "United States", "Kansas City", 39.1, -94.6, 20473, "Shodan.io"),
    ("162.142.125.", "US", "United States", "Ann Arbor", 42.3, -83.7, 398324, "Censys, Inc."),
)
HOSTING = ("digitalocean", "linode", "vultr", "hetzner", "ovh", "aws", "amazon", "google", "microsoft", "cloudflare", "contabo", "hostinger", "namecheap", "leaseweb")
ANONYMISERS = ("vpn", "proxy", "tor", "anonymize", "hide", "private", "tunnel", "nordvpn", "expressvpn", "mullvad", "proton")
#: Widths, in bits, of the buckets in which ranges and addresses meet.
WIDTHS = (4, 8, 12, 16)
PLACE = "country_code string, country_name string, city string, latitude double, longitude double, asn int, org string"


def known_prefixes(spark: SparkSession) -> DataFrame:
    """Two- and three-octet prefixes as rows: ``prefix``, ``rule_seq`` and the place."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(KNOWN_PREFIXES)], f"rule_seq int, prefix string, {PLACE}")


def _place(row: str) -> list[Column]:
    return [F.col(f"{row}.{c.split()[0]}").alias(c.split()[0]) for c in PLACE.split(", ")]


def resolve(ips: DataFrame, prefixes: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """``ip`` with its place: private first, then the range table, then the first known prefix, else unknown.

    Prefixes are whole octets, so an address asks for two keys. Ranges (``ip_from, ip_to`` as numbers and the place) are met in
    buckets of the first of WIDTHS that is no narrower than the range, so it has two rows at most (one for each /16 if it is wider).
    An address asks for one bucket of each width, and a bucket has at most seventeen ranges that don't overlap. Of ranges that do,
    the one that starts last counts. A range that ends before it starts meets nothing.

    Ranges of both kinds of addresses have ``low`` and ``high`` in hex digits instead; they may overlap in any way, and are sorted together with the addresses.
    """
    names = [c.split()[0] for c in PLACE.split(", ")]
    distinct = ips.select("ip").distinct()
    if ranges is not None:  # three joins read it
        distinct = materialize(distinct, "geo-ips")
    keys = F.array(F.concat(F.substring_index("ip", ".", 2), F.lit(".")), F.concat(F.substring_index("ip", ".", 3), F.lit(".")))
    rows = prefixes.select("prefix", F.struct("rule_seq", *names).alias("rule"))
    stub = distinct.select("ip", F.explode(keys).alias("prefix")).join(rows, "prefix").groupBy("ip").agg(F.min("rule").alias("stub"))
    out = distinct.join(stub, "ip", "left")
    if ranges is not None and "low" in ranges.columns:
        kind = lambda c: F.length(c)
        points = materialize(distinct.select("ip", address_hex(F.col("ip")).alias("at")), "geo-addresses").withColumn("kind", kind("at"))
        known = ranges.select(kind("low").alias("kind"), "low", "high", F.struct(F.lit(None).cast("long").alias("ip_from"), *names).alias("row"))
        out = out.join(covering(points, known, "at").where("row is not null").select("ip", F.col("row").alias("range")), "ip", "left")
    elif ranges is not None:
        span = F.col("ip_to") - F.col("ip_from") + 1
        width = reduce(lambda wider, w: F.when(span <= 1 << w, w).otherwise(wider), WIDTHS[-2::-1], F.lit(WIDTHS[-1]))
        wide = ranges.where("ip_from <= ip_to").select("ip_from", "ip_to", F.struct("ip_from", *names).alias("range"), width.alias("width"))
        bucket = F.call_function("shiftright", F.col("ip_from"), F.col("width")), F.call_function("shiftright", F.col("ip_to"), F.col("width"))
        wide = wide.withColumn("bucket", F.explode(F.sequence(*bucket)))
        number = distinct.select("ip", ipv4_long(F.col("ip")).alias("number"), F.explode(F.array(*map(F.lit, WIDTHS))).alias("width"))
        number = number.withColumn("bucket", F.call_function("shiftright", F.col("number"), F.col("width")))
        hit = number.join(wide, ["width", "bucket"]).where("number between ip_from and ip_to").groupBy("ip").agg(F.max("range").alias("range"))
        out = out.join(hit, "ip", "left")
    else:
        out = out.withColumn("range", F.lit(None).cast(f"struct<ip_from:bigint,{','.join(f'{c.split()[0]}:{c.split()[1]}' for c in PLACE.split(', '))}>"))
    private = is_private(F.col("ip"), v6=True)
    found = {n: F.when(~private, F.coalesce(F.col(f"range.{n}"), F.when(F.col("range").isNull(), F.col(f"stub.{n}")))) for n in names}
    found["country_code"] = F.when(private, "--").otherwise(F.coalesce(found["country_code"], F.lit("??")))
    found["country_name"] = F.when(private, "Private/Reserved").otherwise(F.coalesce(found["country_name"], F.lit("Unknown")))
    source = F.when(~private & F.col("range").isNotNull(), "range").otherwise("stub")
    return out.select("ip", *(found[n].alias(n) for n in names), private.alias("is_private"), source.alias("geo_source"))


def enrich(events: DataFrame, prefixes: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Events with the place of their address; every address is resolved once, which also spares hot ones."""
    places = resolve(events.select(F.col("source_ip").alias("ip")), prefixes, ranges).withColumnRenamed("ip", "source_ip")
    return events.join(places, "source_ip", "left")


def first_keyword(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(w)), F.lit(w)) for w in words))


def burst_number(records: DataFrame, window: list[str] | None = None) -> DataFrame:
    """Add ``asn_count``: the running number of a known network's records, in each ``window`` if named.

    A cloud provider has a large share of all records, so no network is sorted in one task: records are ranked range by range, and
    the rank of a network's first one is taken off.
    """
    by = [*(window or []), "asn"]
    known = records.where(F.coalesce("asn", F.lit(0)) != 0)
    placed = materialize(ranked(known, [*(F.col(c) for c in by), F.col("seq")], "__rank", "asn-ranges"), "asn-ranks")
    first = placed.groupBy(*by).agg(F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("n"))
    counted = lookup(placed, first, by, placed.count(), F.col("__rank")).withColumn("asn_count", (F.col("__rank") - F.col("__first") + 1).cast("int"))
    rest = records.where(F.coalesce("asn", F.lit(0)) == 0).withColumn("asn_count", F.lit(None).cast("int"))
    return counted.select(*records.columns, "asn_count").unionByName(rest)


def geo_signals(records: DataFrame, countries: tuple[str, ...], tor_exits: DataFrame | None = None, burst: int = 5, window: list[str] | None = None) -> DataFrame:
    """Add ``is_tor``, ``signals`` (structs ``id, points, match``), ``risk_score`` and ``risk_level``.

    Records have seq, ip, country_code, asn, asn_name, is_tor. ``tor_exits`` has ``ip``.
    """
    rows = burst_number(records, window)
    if tor_exits is not None:
        listed = tor_exits.select("ip", F.lit(True).alias("__listed")).distinct()
        rows = rows.join(listed, "ip", "left").withColumn("is_tor", F.col("is_tor") | F.coalesce("__listed", F.lit(False))).drop("__listed")
    hosting, hidden = first_keyword(F.col("asn_name"), HOSTING), first_keyword(F.col("asn_name"), ANONYMISERS)
    signal = lambda test, name, points, match: F.when(test, F.struct(F.lit(name).alias("id"), F.lit(points).alias("points"), match.cast("string").alias("match")))
    signals = F.array(
        signal(F.col("country_code").isin(*countries), "GEO-001", 35, F.col("country_code")), signal(hosting.isNotNull(), "GEO-002", 20, hosting),
        signal(hidden.isNotNull(), "GEO-003", 30, hidden), signal(F.col("is_tor"), "GEO-004", 40, F.col("ip")), signal(F.col("asn_count") > burst, "GEO-005", 25, F.col("asn_count")),
    )
    rows = rows.withColumn("signals", F.filter(signals, lambda x: x.isNotNull()))
    score = F.least(F.lit(100), F.aggregate("signals", F.lit(0), lambda a, x: a + x["points"]))
    return rows.withColumn("risk_score", score).withColumn("risk_level", geo_level(F.col("risk_score")))
