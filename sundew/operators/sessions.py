"""Attack sessions: idle-gap split, phase, score and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sundew.functions.fields import session_seconds, session_severity
from sundew.operators.rates import islands, pieces

#: Types of events that are a success, and points of a phase.
SUCCESS_TYPES = ("login_success", "auth_success", "authenticated")
PHASE_POINTS = {"EXPLOITATION": 60, "BRUTE_FORCE": 40, "CREDENTIAL_SPRAY": 35, "CREDENTIAL_STUFFING": 35, "RECONNAISSANCE": 15, "UNKNOWN": 5}


def session_index(events: DataFrame, gap_ms: int = 300_000) -> DataFrame:
    """Add ``session_no`` (from 0 in each address) and ``session_id``; a gap over ``gap_ms`` splits.

    Events without a time come last and stay in the last session. A missing address is ``unknown``.
    """
    ip = F.coalesce(F.nullif("source_ip", F.lit("")), F.lit("unknown"))
    numbered = islands(events.withColumn("source_ip", ip), ["source_ip"], gap_ms).withColumnRenamed("__island", "session_no").drop("__p")
    return numbered.withColumn("session_id", F.concat("source_ip", F.lit("-"), F.col("session_no").cast("string")))


def phase_of(users: Column, passwords: Column, events: Column, services: Column, ok: Column) -> Column:
    return (
        F.when(ok > 0, "EXPLOITATION")
        .when((users >= 10) & (passwords <= 3), "CREDENTIAL_SPRAY")
        .when((users >= 5) & (passwords >= 5), "CREDENTIAL_STUFFING")
        .when((users + passwords > 0) & (events >= 20) & (users <= 3), "BRUTE_FORCE")
        .when(users > 0, "BRUTE_FORCE")
        .when(services >= 1, "RECONNAISSANCE")
        .otherwise("UNKNOWN")
    )


def indicator_of(users: Column, passwords: Column, events: Column, services: Column, ok: Column) -> Column:
    """The sentence that goes with the phase."""
    say = lambda text, *c: F.format_string(text, *(x.cast("long") for x in c))
    return (
        F.when(ok > 0, say("%d successful authentication(s) detected", ok))
        .when((users >= 10) & (passwords <= 3), say("Spray pattern: %d usernames with ≤3 passwords", users))
        .when((users >= 5) & (passwords >= 5), say("Stuffing pattern: %d users × %d passwords", users, passwords))
        .when((users + passwords > 0) & (events >= 20) & (users <= 3), say("Brute-force pattern: %d attempts against ≤3 usernames", events))
        .when(users > 0, say("Low-volume auth attempt: %d events, %d username(s)", events, users))
        .when(services >= 1, say("Probe activity: %d events across %d service(s) with no credentials", events, services))
    )


def session_score(phase: Column, events: Column, services: Column, ok: Column) -> Column:
    points = F.coalesce(F.create_map(*(F.lit(x) for pair in PHASE_POINTS.items() for x in pair))[phase], F.lit(5))
    volume = F.least(F.lit(20), F.floor(F.log2(F.greatest(events, F.lit(1)).cast("double")) * 3))
    spread = F.when(services > 1, F.least(F.lit(10), (services - 1) * 5)).otherwise(0)
    return F.least(F.lit(100), points + volume + F.least(F.lit(20), ok * 5) + spread).cast("int")


def succeeded(events: DataFrame) -> Column:
    """A success by its flag, or, where ``event_type`` is a column, by its type."""
    flag = F.coalesce(F.col("success"), F.lit(False))
    return flag | F.coalesce(F.col("event_type").isin(*SUCCESS_TYPES), F.lit(False)) if "event_type" in events.columns else flag


def sessions(events: DataFrame, gap_ms: int = 300_000) -> DataFrame:
    """One row per session with counts, phase, indicator, score and severity."""
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    grouped = session_index(events, gap_ms).groupBy("source_ip", "session_no", "session_id").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count(F.lit(1)).alias("events"),
        F.array_sort(F.collect_set(text("username"))).alias("usernames"), F.array_sort(F.collect_set(text("password"))).alias("passwords"),
        F.array_sort(F.collect_set(F.lower(text("service")))).alias("services"), F.count_if(succeeded(events)).alias("auths_ok"),
    )
    return scored(grouped)


def scored(grouped: DataFrame) -> DataFrame:
    users, passwords, services = F.size("usernames"), F.size("passwords"), F.size("services")
    facts = (users, passwords, F.col("events"), services, F.col("auths_ok"))
    out = grouped.withColumns({"phase": phase_of(*facts), "indicator": indicator_of(*facts)})
    out = out.withColumn("score", session_score(F.col("phase"), F.col("events"), services, F.col("auths_ok")))
    return out.withColumns({"severity": session_severity(F.col("score")), "duration_s": session_seconds(F.col("start_ms"), F.col("end_ms"))})


def session_report(found: DataFrame) -> DataFrame:
    """One row of counts."""
    return found.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("total_events"), F.count_distinct("source_ip").alias("source_ips"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"),
    )


def severe_sessions(found: DataFrame, severities: tuple[str, ...] = ("CRITICAL", "HIGH")) -> DataFrame:
    """The report's sessions of these severities as rows, any number of them."""
    return found.where(F.col("severity").isin(*severities))


def top_sessions(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("score"), "start_ms", "session_id").limit(n)


def timeline(events: DataFrame, session: str = "session_id", piece_events: int | None = None) -> DataFrame:
    """Ordered events of each session as one array of structs; with ``piece_events`` as rows of so many at most, numbered by ``piece``."""
    rows, by = (events, [session]) if piece_events is None else (pieces(events, [session], piece_events), [session, "piece"])
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ts_ms", "seq", "kind", "data"))).alias("timeline"))
