"""Records of a geo database as ranges with a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundew.functions.net import hex_last, ipv4_long, network_of

RECORD = (
    "country struct<iso_code:string,names:struct<en:string>>, city struct<names:struct<en:string>>, location struct<latitude:double,longitude:double>, "
    "autonomous_system_number int, autonomous_system_organization string, broken string"
)


def ranges(rows: DataFrame) -> DataFrame:
    """``network`` and ``record`` (JSON) as ``ip_from, ip_to`` and the place, as ``resolve`` takes them.

    A record without a country has ``??`` and ``Unknown``; an empty name counts as none. Broken records, null ones, and networks
    that are no IPv4 give no row. Host bits of a network are ignored.
    """
    parts = F.split("network", "/")
    base, bits = ipv4_long(F.element_at(parts, 1)), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("32")).try_cast("int")
    read = F.from_json("record", RECORD, {"columnNameOfCorruptRecord": "broken"})
    rows = rows.select(base.alias("base"), bits.alias("bits"), read.alias("r")).where("base is not null and bits between 0 and 32 and r is not null and r.broken is null")
    size = F.expr("shiftleft(1L, 32 - bits)")
    start = F.col("base") - F.col("base") % size
    return rows.select(start.alias("ip_from"), (start + size - 1).alias("ip_to"), *_place())


def _place() -> list[Column]:
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    return [
        F.coalesce("r.country.iso_code", F.lit("??")).alias("country_code"), F.coalesce(text("r.country.names.en"), F.lit("Unknown")).alias("country_name"),
        F.col("r.city.names.en").alias("city"), F.col("r.location.latitude").alias("latitude"), F.col("r.location.longitude").alias("longitude"),
        F.col("r.autonomous_system_number").alias("asn"), F.col("r.autonomous_system_organization").alias("org"),
    ]


def spans(rows: DataFrame) -> DataFrame:
    """As ``ranges``, but with networks of both kinds, as ``low`` and ``high`` in hex digits (8 or 32). Only networks with a colon are parsed in Python."""
    read = F.from_json("record", RECORD, {"columnNameOfCorruptRecord": "broken"})
    rows = rows.select(network_of(F.col("network")).alias("net"), read.alias("r")).where("net is not null and r is not null and r.broken is null")
    return rows.select(F.col("net.base").alias("low"), hex_last(F.col("net.base"), F.col("net.len")).alias("high"), *_place())
