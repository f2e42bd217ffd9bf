"""Threat-intelligence feeds of four formats as one table.

Parsers take rows of text and give indicator, source, categories, confidence, tags, last_seen; ``load`` numbers
feeds in load order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundew.functions.net import is_ip_or_cidr

#: Loading order leaves this many rows to a feed.
FEED_ROWS = 1 << 40
IPV4_IN_PATTERN = r"""(?i)ipv4-addr:value\s*=\s*['"]([0-9./]+)['"]"""


@dataclass(frozen=True)
class Feed:
    source: str
    confidence: int = 50
    categories: tuple[str, ...] = ()
    columns: tuple[str, str, str] = ("ip", "category", "confidence")


def _listed(feed: Feed, otherwise: tuple[str, ...] = ()) -> Column:
    return F.array(*map(F.lit, feed.categories or otherwise)).cast("array<string>")


def _tags(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs with a value."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))
    return F.map_from_entries(F.filter(entries, lambda x: F.coalesce(x["value"], F.lit("")) != ""))


def _rows(df: DataFrame, feed: Feed, indicator: Column, categories: Column, confidence: Column, tags: Column, seen: Column) -> DataFrame:
    bounded = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(confidence, F.lit(feed.confidence))))
    out = df.select(F.trim(indicator).alias("indicator"), F.lit(feed.source).alias("source"), categories.alias("categories"), bounded.cast("int").alias("confidence"), tags.alias("tags"), seen.cast("string").alias("last_seen"))
    return out.where(is_ip_or_cidr(F.col("indicator"), v6=True))


def ip_list(lines: DataFrame, feed: Feed) -> DataFrame:
    """A line is an address or a network; what follows ``#`` is a comment; other lines are skipped."""
    parts = F.split("value", "#", 2)
    comment = F.trim(F.get(parts, 1))
    return _rows(lines, feed, F.trim(F.get(parts, 0)), _listed(feed), F.lit(None).cast("int"), _tags(("comment", comment)), F.lit(None))


def csv(rows: DataFrame, feed: Feed) -> DataFrame:
    """Columns of a CSV file that is read with its header. A bad confidence is the default; other columns become tags."""
    ip, category, confidence = feed.columns
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    own = F.trim(has(category))
    categories = F.when(F.coalesce(own, F.lit("")) != "", F.array(own)).otherwise(_listed(feed))
    extra = _tags(*((c, F.col(c)) for c in rows.columns if c not in feed.columns)) if set(rows.columns) - set(feed.columns) else F.create_map().cast("map<string,string>")
    return _rows(rows, feed, has(ip), categories, has(confidence).try_cast("int"), extra, F.lit(None))


def abuse_json(texts: DataFrame, feed: Feed) -> DataFrame:
    """``{"data": [...]}``; a text that is no JSON has no rows."""
    entry = "ipAddress string, abuseConfidenceScore string, countryCode string, totalReports string, lastReportedAt string, lastSeen string"
    found = texts.select(F.explode(F.from_json("value", f"data array<struct<{', '.join(x.replace(' ', ':') for x in entry.split(', '))}>>")["data"]).alias("d"))
    return _rows(found, feed, F.col("d.ipAddress"), _listed(feed, ("abuse",)), F.col("d.abuseConfidenceScore").try_cast("int"), _tags(("country", F.col("d.countryCode")), ("total_reports", F.col("d.totalReports"))), F.coalesce("d.lastReportedAt", "d.lastSeen"))


def stix2_json(texts: DataFrame, feed: Feed) -> DataFrame:
    """A bundle's indicators, with every IPv4 value of their patterns."""
    schema = "objects array<struct<type:string,id:string,name:string,pattern:string,labels:array<string>,valid_until:string,modified:string>>"
    found = texts.select(F.explode(F.from_json("value", schema)["objects"]).alias("o")).where("o.type = 'indicator'")
    found = found.select("o", F.explode(F.regexp_extract_all("o.pattern", F.lit(IPV4_IN_PATTERN), F.lit(1))).alias("ip"))
    labels = F.when(F.size("o.labels") > 0, F.col("o.labels")).otherwise(_listed(feed))
    return _rows(found, feed, F.col("ip"), labels, F.lit(None).cast("int"), _tags(("name", F.col("o.name")), ("id", F.col("o.id"))), F.coalesce("o.valid_until", "o.modified"))


PARSERS: dict[str, Callable[[DataFrame, Feed], DataFrame]] = {"ip_list": ip_list, "csv": csv, "abuseipdb_json": abuse_json, "stix2_json": stix2_json}


def load(table: DataFrame | None, text: DataFrame, feed: Feed, kind: str, number: int, now_ms: int) -> DataFrame:
    """``table`` with one more feed, the ``number``-th. Unknown kinds are lists. Rows keep their order inside a feed."""
    rows = PARSERS.get(kind, ip_list)(text, feed).withColumns({"load_seq": F.lit(number * FEED_ROWS) + F.monotonically_increasing_id(), "cached_ms": F.lit(now_ms).cast("long")})
    return rows if table is None else table.unionByName(rows)
