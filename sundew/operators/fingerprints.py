"""Scanner fingerprints of addresses: facts, scores, winner, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, credential pairs, ports, times in seconds, and the order in which equal scores win.
SHODAN, MASSCAN, ZGRAB = "(?i)shodan", "(?i)masscan", "(?i)zgrab"
METASPLOIT = r"(?i)metasploit|msfconsole|msf[0-9]*>|meterpreter|payload/|exploit/|auxiliary/scanner|\bmsf\b"
BOT_PAIRS = (
    ("admin", "admin"), ("admin", "password"), ("admin", "123456"), ("root", "root"), ("root", "toor"), ("root", "password"),
    ("root", "123456"), ("admin", ""), ("", ""), ("test", "test"), ("user", "user"), ("guest", "guest"), ("pi", "raspberry"),
    ("ubnt", "ubnt"), ("admin", "1234"), ("admin", "admin123"), ("support", "support"),
)
SHODAN_PORTS = (21, 22, 23, 25, 80, 443, 445, 3389, 8080, 8443)
FAST, BOT, HUMAN = 0.5, 2.0, 5.0
TYPES = ("SHODAN", "MASSCAN", "ZGRAB", "METASPLOIT", "CREDENTIAL_STUFFING_BOT", "CUSTOM_SCRIPT", "HUMAN")


def facts(events: DataFrame) -> DataFrame:
    """One row per address. The mean gap is the whole span over the number of gaps, so no window is needed."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    pair = F.struct(F.coalesce("username", F.lit("")).alias("u"), F.coalesce("password", F.lit("")).alias("p"))
    known = (has("username") | has("password")) & F.concat(pair["u"], F.lit("\x1f"), pair["p"]).isin(*(f"{u}\x1f{p}" for u, p in BOT_PAIRS))
    match = lambda c, p: F.coalesce(F.bool_or(F.col(c).rlike(p)), F.lit(False))
    timed = F.when(F.col("ts_ms") != 0, F.col("ts_ms"))
    return events.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct(F.when(has("username"), F.col("username"))).alias("users"),
        F.count_distinct(F.when(has("password"), F.col("password"))).alias("passwords"),
        F.array_sort(F.collect_set(F.when(F.col("dest_port") != 0, F.col("dest_port")))).alias("ports"),
        F.when(F.count(timed) > 1, (F.max(timed) - F.min(timed)) / 1000.0 / (F.count(timed) - 1)).alias("gap_s"),
        match("user_agent", SHODAN).alias("shodan_ua"), match("user_agent", MASSCAN).alias("masscan_ua"),
        (match("user_agent", ZGRAB) | match("payload", ZGRAB)).alias("zgrab"), (match("payload", METASPLOIT) | match("username", METASPLOIT)).alias("msf"),
        F.array_sort(F.collect_set(F.when(known, pair))).alias("pairs"),
    ).withColumn("bot_pairs", F.size("pairs").cast("long"))


def fingerprints(events: DataFrame, min_events: int = 1) -> DataFrame:
    """``source_ip``, the facts, ``scanner``, ``score``, ``confidence`` and ``signals`` (in a fixed order)."""
    f = facts(events)
    gap, n, users = F.col("gap_s"), F.col("events"), F.col("users")
    in_set = (F.size("ports") > 0) & (F.size(F.array_except("ports", F.array(*map(F.lit, SHODAN_PORTS)))) == 0)
    part = lambda test, points: F.when(F.coalesce(test, F.lit(False)), F.lit(points)).otherwise(0.0)
    tests = {
        "shodan_ua": F.col("shodan_ua"), "ports": in_set, "masscan_ua": F.col("masscan_ua"), "fast": gap < FAST, "probe": (n >= 10) & (users == 0),
        "zgrab": F.col("zgrab"), "msf": F.col("msf"), "pairs": F.col("bot_pairs") > 0, "bot_speed": (gap > FAST) & (gap < BOT),
        "script_speed": (gap >= BOT) & (gap < HUMAN), "few_users": (users >= 1) & (users <= 3) & (n >= 5), "human_speed": gap >= HUMAN, "few": n <= 5,
    }
    scores = [
        part(tests["shodan_ua"], 0.8) + part(tests["ports"], 0.2),
        part(tests["masscan_ua"], 0.8) + part(tests["fast"], 0.4) + part(tests["probe"], 0.2),
        part(tests["zgrab"], 0.9),
        part(tests["msf"], 0.85),
        F.least(F.lit(0.7), F.col("bot_pairs") * 0.15) + part(tests["bot_speed"], 0.25),
        part(tests["script_speed"], 0.4) + part(tests["few_users"], 0.3),
        part(tests["human_speed"], 0.6) + part(tests["few"], 0.2),
    ]
    best = F.array_max(F.array(*(F.struct(s.cast("double").alias("score"), F.lit(-i).alias("rank")) for i, s in enumerate(scores))))
    # Fixed texts of the contract.
    says: list[tuple[str, Column]] = [
        ("shodan_ua", F.lit("Shodan User-Agent detected")),
        ("ports", F.concat(F.lit("Ports match Shodan probe set: ["), F.array_join("ports", ", "), F.lit("]"))),
        ("masscan_ua", F.lit("Masscan User-Agent detected")),
        ("fast", F.format_string("Ultra-fast timing (avg %.3fs) consistent with masscan", gap)),
        ("probe", F.lit("High probe volume with no credentials — port scan pattern")),
        ("zgrab", F.lit("ZGrab signature detected in UA or payload")),
        ("msf", F.lit("Metasploit signature in payload or credentials")),
        ("pairs", F.format_string("%d known bot credential pair(s): [%s]", "bot_pairs", F.array_join(F.transform(F.slice("pairs", 1, 3), lambda x: F.format_string("('%s', '%s')", x["u"], x["p"])), ", "))),
        ("bot_speed", F.format_string("Bot-speed timing (avg %.2fs)", gap)),
        ("script_speed", F.format_string("Script-speed timing (avg %.2fs)", gap)),
        ("few_users", F.format_string("Low username diversity (%d) with high volume", users)),
        ("human_speed", F.format_string("Human-speed timing (avg %.2fs)", gap)),
        ("few", F.lit("Low event count consistent with manual exploration")),
    ]
    signals = F.filter(F.array(*(F.when(F.coalesce(tests[k], F.lit(False)), text) for k, text in says)), lambda x: x.isNotNull())
    known = n >= min_events
    named = F.when(known & (F.col("__b.score") >= 0.1), F.element_at(F.array(*map(F.lit, TYPES)), 1 - F.col("__b.rank"))).otherwise("UNKNOWN")
    score = F.when(known, F.least(F.lit(1.0), F.col("__b.score"))).otherwise(0.0)
    confidence = F.when(known & (F.col("__b.score") >= 0.75), "HIGH").when(known & (F.col("__b.score") >= 0.45), "MEDIUM").otherwise("LOW")
    out = f.withColumns({"__b": best, "signals": signals})
    return out.withColumns({"scanner": named, "score": score, "confidence": confidence}).drop("__b")


def fingerprint_of(events: DataFrame, ip: str, min_events: int = 1) -> DataFrame:
    """The same for one address; the filter reaches the scan."""
    return fingerprints(events.where(F.col("source_ip") == ip), min_events)
