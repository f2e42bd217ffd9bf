"""One-line summaries of results, as columns over the operators' output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session() -> Column:
    """Of a row of ``sessions``."""
    return F.format_string("[%s] %s | phase=%s score=%d | %d events | users=%d auths_ok=%d", "severity", "session_id", "phase", "score", "events", F.size("usernames"), "auths_ok")


def session_report() -> Column:
    """Of the row of ``session_report``."""
    return F.format_string("SessionReport: %d sessions | %d events | %d source IPs | CRITICAL=%d HIGH=%d", "sessions", F.coalesce("total_events", F.lit(0)), "source_ips", "critical", "high")


def campaign() -> Column:
    """Of a row of ``profiles``."""
    return F.format_string("[%s] tier=%s score=%d events=%d ips=%d span=%ds checks=%s", "campaign_id", "tier", "risk_score", "total_events", "unique_ips", "span_s", "checks")


def lateral() -> Column:
    """Of the row of ``risk``."""
    return F.format_string("[%s] risk_score=%d findings=%d", "level", "risk_score", "findings")


def fingerprint() -> Column:
    """Of a row of ``fingerprints``, with its first three signals."""
    timing = F.when(F.col("gap_s").isNull(), "timing=n/a").otherwise(F.format_string("avg_gap=%.2fs", "gap_s"))
    signals = F.array_join(F.slice("signals", 1, 3), "; ")
    return F.format_string("[%s] %s | confidence=%s score=%.2f | %d events %s | signals=[%s]", "scanner", "source_ip", "confidence", "score", "events", timing, signals)


def geo_alert() -> Column:
    """Of a row of ``geo_signals``."""
    return F.format_string("%s [%s] risk=%d (%s): %d signal(s)", "ip", "country_code", "risk_score", "risk_level", F.size("signals"))


def canary_token() -> Column:
    """Of a row of the registry."""
    return F.format_string("[%s] %s: %s", F.substring("token_id", 1, 8), "token_type", "label")
