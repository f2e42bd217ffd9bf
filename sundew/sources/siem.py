"""Rows for SIEM systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SIGNATURES = {"ssh": "1001", "http": "1002", "api": "1003"}
SOURCETYPE, EVENT_NAME = "honeypot:", "honeypot_event"


def splunk_rows(events: DataFrame, index: str, source: str) -> DataFrame:
    body = F.struct(*events.columns)
    row = F.struct((F.col("ts_ms") / 1000.0).alias("time"), F.lit(index).alias("index"), F.lit(source).alias("source"), F.concat(F.lit(SOURCETYPE), "service").alias("sourcetype"), body.alias("event"))
    return events.select("seq", F.to_json(row).alias("value"))


def elastic_rows(events: DataFrame, index: str) -> DataFrame:
    """An action line and a document line; ``value`` ends with a line end."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index")).alias("index")))
    return events.select("seq", F.concat(action, F.lit("\n"), F.to_json(F.struct(*events.columns)), F.lit("\n")).alias("value"))


def _chain(text: Column, *marks: str) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for m in marks:
        out = F.replace(out, F.lit(m), F.lit({"\n": "\\n", "\r": "\\r"}.get(m, "\\" + m)))
    return out


def cef_header(text: Column) -> Column:
    return _chain(text, "|", "\n", "\r")


def cef_value(text: Column) -> Column:
    return _chain(text.cast("string"), "=", "\n", "\r")


def cef(vendor: str, product: str, method: Column | None = None, source_port: Column | None = None) -> Column:
    """A CEF line of the canonical columns; parts that are null or empty are left out."""
    pair = lambda k, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), cef_value(c)))
    agent = F.col("user_agent")
    parts = [F.concat(F.lit("src="), cef_value(F.col("source_ip"))), pair("spt", F.lit(None) if source_port is None else source_port), F.concat(F.lit("rt="), F.col("ts_ms").cast("string")), pair("duser", F.col("username")), pair("request", F.col("path"))]
    parts += [pair("requestMethod", method)] if method is not None else []
    parts += [pair("cs1", agent), F.when(F.coalesce(agent, F.lit("")) != "", F.lit("cs1Label=UserAgent"))]
    signature = F.coalesce(F.create_map(*(F.lit(x) for pair in SIGNATURES.items() for x in pair))[F.col("service")], F.lit("1000"))
    name = F.concat(F.upper("service"), F.lit(" connection attempt observed"))
    head = F.concat(F.lit("CEF:0|"), cef_header(F.lit(vendor)), F.lit("|"), cef_header(F.lit(product)), F.lit("|1.0|"), signature, F.lit("|"), cef_header(name), F.lit("|5|"))
    return F.concat(head, F.concat_ws(" ", *parts))


def cef_json(event: Column, kind: Column, source: Column, vendor: str, product: str) -> Column:
    """A CEF line with the whole event as JSON in ``msg``; the signature is the name too."""
    named = F.coalesce(kind, F.lit(EVENT_NAME))
    return F.concat(F.lit(f"CEF:0|{vendor}|{product}|1.0|"), named, F.lit("|"), named, F.lit("|5|src="), F.coalesce(source, F.lit("")), F.lit(" msg="), F.to_json(event))


def syslog(message: Column, ts: Column, host: str, app: str, facility: int = 16) -> Column:
    return F.concat(F.lit(f"<{facility * 8 + 6}>"), F.date_format(ts, "MMM dd HH:mm:ss"), F.lit(f" {host} {app}: "), message)
