"""Filters that reach the scan, and the small predicates of the rules."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
TARGETED = ("/etc/passwd", "/.env", "/.git/config")
TOOL_AGENTS = "(?i)curl|zgrab|masscan|shodan|python-requests|nmap|sqlmap|nikto|go-http-client"
UPLOAD_PATH, UPLOAD_NAME = "(?i).*(upload|import|file|attachment).*", r"(?i)\.(exe|dll|ps1|bat|vbs|js|jar|elf|php)"
UPLOAD_MIME, UPLOAD_STOR = "(?i)(application/x-msdownload|application/octet-stream|multipart/form-data)", r"(?i)^STOR\s+.*\.(exe|dll|ps1|bat|vbs|js|jar|elf|php)$"
SHELL_MARKS = r"(?i)(;|&&|\|\||`|\$\()"
SHELL_WORDS = r"(?i)\b(whoami|id|uname|ifconfig|ipconfig|cat\s+/etc/passwd|powershell|cmd\.exe|wget|curl|nc|bash\s+-i)\b"
SHELL_ENCODED = r"(?i)(base64|frombase64string|-enc\s+)"
WINDOWS_MS = {"last_hour": 3_600_000, "last_24h": 86_400_000, "last_7d": 604_800_000, "all_time": None}


def export(events: DataFrame, service: str | None = None, source_ip: str | None = None, start_ms: int | None = None, end_ms: int | None = None, limit: int = 100) -> DataFrame:
    """The first ``limit`` (1 to 5000) rows in order of arrival; both ends count, and rows without a time pass."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be between 1 and 5000")
    return in_time(matching(events, service, source_ip), start_ms, end_ms).orderBy("seq").limit(limit)


def time_parameter(text: str | None) -> int | None:
    """A request's ISO time in ms since 1970; without a zone it is UTC. Unlike times in rows, a broken one is an error."""
    if text is None:
        return None
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as error:
        raise ValueError(f"Invalid timestamp: {text}") from error
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return round(at.timestamp() * 1000)


def matching(events: DataFrame, service: str | None = None, source_ip: str | None = None) -> DataFrame:
    if service is not None:
        events = events.where(F.col("service") == service)
    return events if source_ip is None else events.where(F.col("source_ip") == source_ip)


def in_time(events: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    test = F.lit(True)
    if start_ms is not None:
        test = test & (F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        test = test & (F.col("ts_ms") <= end_ms)
    return events.where(F.col("ts_ms").isNull() | test)


def recent(events: DataFrame, window: str, now_ms: int) -> DataFrame:
    """Rows of a named window back from ``now_ms``; the cutoff itself counts."""
    span = WINDOWS_MS[window]
    return events if span is None else events.where(F.col("ts_ms") >= now_ms - span)


def retained(events: DataFrame, now_ms: int, days: int = 90) -> DataFrame:
    return events.where(F.col("ts_ms") >= now_ms - days * 86_400_000)


def is_upload(method: Column | None = None) -> Column:
    """A delivery of a program over HTTP or FTP. With ``method`` the HTTP request has to be a POST or PUT; events without the column can't be told."""
    sent = F.lit(True) if method is None else F.upper(method).isin("POST", "PUT")
    web = (F.col("service") == "http") & sent & (F.col("path").rlike(UPLOAD_PATH) | F.col("payload").rlike(UPLOAD_NAME) | F.col("payload").rlike(UPLOAD_MIME))
    return F.coalesce(web | ((F.col("service") == "ftp") & F.col("payload").rlike(UPLOAD_STOR)), F.lit(False))


def uploads(events: DataFrame) -> Column:
    """``is_upload`` by the events' column ``method``; events without one can't be told apart by it."""
    return is_upload(F.col("method") if "method" in events.columns else None)


def is_command() -> Column:
    """An attempt to run a command."""
    text = F.col("payload")
    hit = text.rlike(SHELL_MARKS) | text.rlike(SHELL_WORDS) | text.rlike(SHELL_ENCODED)
    return F.coalesce(F.col("service").isin("http", "api", "ftp", "ssh") & hit, F.lit(False))


def is_targeted_path() -> Column:
    hit = F.col("path").isin(*TARGETED)
    for p in TARGETED:
        hit = hit | F.contains("payload", F.lit(p))
    return F.coalesce(hit, F.lit(False))


def unknown_agents(events: DataFrame) -> DataFrame:
    """User agents of no known tool, with the time they were first seen."""
    agent = F.col("user_agent")
    return events.where((F.coalesce(agent, F.lit("")) != "") & ~agent.rlike(TOOL_AGENTS)).groupBy("user_agent").agg(F.min("ts_ms").alias("first_seen_ms"), F.count(F.lit(1)).alias("events"))
