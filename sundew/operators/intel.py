"""Threat intelligence: exact and network matches of addresses against feeds.

Feed rows: indicator, source, categories, confidence, tags, last_seen, load_seq, cached_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundew.functions.net import address_hex, hex_prefix, network_of
from sundew.plans.tables import materialize

FIELDS = ("source", "categories", "confidence", "load_seq")


def fresh(feed: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Rows that are still valid; an age of exactly ``ttl_ms`` is."""
    return feed.where(F.lit(now_ms) - F.col("cached_ms") <= ttl_ms)


def prepared(feed: DataFrame) -> DataFrame:
    """The feed's rows with ``base`` and ``len`` of their network and ``single``, whether it is one address. Written once: three joins read it."""
    rows = feed.select("indicator", *FIELDS, network_of(F.col("indicator")).alias("__net")).where(F.col("__net").isNotNull())
    rows = rows.select("indicator", *FIELDS, F.col("__net.base").alias("base"), F.col("__net.len").alias("len"))
    return materialize(rows.withColumn("single", F.col("len") == 4 * F.length("base")), "intel-feed")


def exact_table(feed: DataFrame) -> DataFrame:
    """Single addresses, the last loaded of each; an IPv6 address in its shortest form is written as the feed has it."""
    rows = feed.select("indicator", *FIELDS, network_of(F.col("indicator")).alias("__net"))
    own = rows.where(F.col("__net.len") == 4 * F.length("__net.base"))
    return own.groupBy("__net.base").agg(F.max_by(F.struct("indicator", *FIELDS), "load_seq").alias("e")).select(F.substring_index("e.indicator", "/", 1).alias("ip"), F.struct(*(F.col(f"e.{f}").alias(f) for f in FIELDS)).alias("exact"))


def lookup(ips: DataFrame, feed: DataFrame) -> DataFrame:
    """``ip`` with ``intel`` (source, categories, confidence, load_seq) and ``matched_cidr`` (as the feed writes it); null without a match.

    An exact row beats networks, and among networks the first loaded wins, not the longest. Addresses and networks are of either
    kind. A network join is an equality join on prefix length and prefix; the lengths that the feed has, at most 33 of
    IPv4 and 129 of IPv6, are the only rows broadcast.
    """
    rows = prepared(feed)
    distinct = ips.select("ip").distinct().withColumn("__hex", address_hex(F.col("ip")))
    distinct = materialize(distinct, "intel-ips")
    exact = rows.where("single").groupBy(F.col("base").alias("__hex")).agg(F.max_by(F.struct(*FIELDS), "load_seq").alias("exact"))
    nets = rows.where("not single").withColumn("digits", F.length("base"))
    lengths = F.broadcast(nets.select("digits", "len").distinct())
    keys = distinct.where(F.col("__hex").isNotNull()).withColumn("digits", F.length("__hex")).join(lengths, "digits")
    keys = keys.select("ip", "len", hex_prefix(F.col("__hex"), F.col("len")).alias("base"))
    # the first loaded of each network stands for it, so a feed that repeats networks doesn't multiply rows
    first = nets.groupBy("len", "base").agg(F.min_by(F.struct(F.col("indicator").alias("cidr"), *FIELDS), "load_seq").alias("net"))
    wide = keys.join(first, ["len", "base"]).groupBy("ip").agg(F.min_by("net", "net.load_seq").alias("net"))
    out = distinct.join(exact, "__hex", "left").join(wide, "ip", "left")
    net = F.struct(*(F.col(f"net.{f}").alias(f) for f in FIELDS))
    intel = F.coalesce("exact", F.when(F.col("net").isNotNull(), net))
    return out.select("ip", intel.alias("intel"), F.when(F.col("exact").isNull(), F.col("net.cidr")).alias("matched_cidr"))


def enrich(events: DataFrame, feed: DataFrame, ip: Column | None = None) -> DataFrame:
    """Events with ``intel`` and ``matched_cidr``; every address is looked up once."""
    keyed = events.withColumn("__ip", F.col("source_ip") if ip is None else ip)
    found = lookup(keyed.select(F.col("__ip").alias("ip")), feed).withColumnRenamed("ip", "__ip")
    return keyed.join(found, "__ip", "left").drop("__ip")


def table_stats(feed: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """Different addresses, different networks, their sum, and how long rows are valid."""
    net = feed.select(network_of(F.col("indicator")).alias("n")).where(F.col("n").isNotNull())
    single = F.col("n.len") == 4 * F.length("n.base")
    counted = net.agg(F.count_distinct(F.when(single, F.col("n.base"))).alias("exact"), F.count_distinct(F.when(~single, F.col("n"))).alias("cidr"))
    return counted.withColumn("total", F.col("exact") + F.col("cidr")).withColumn("ttl_seconds", F.lit(ttl_ms // 1000).cast("long"))
