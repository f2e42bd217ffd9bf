"""Alert rules over tumbling windows, and their correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sundew.operators.filters import is_command, uploads

MINUTE = 60_000


def bucket(ms: int) -> Column:
    return F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(ms))


def brute_force(events: DataFrame, least: int = 10, minutes: int = 5) -> DataFrame:
    """Failed logins of an address at a service in a window: ``least`` or more."""
    failed = events.where(F.col("service").isin("ssh", "ftp", "api") & ~F.col("success"))
    grouped = failed.groupBy("source_ip", "service", bucket(minutes * MINUTE).alias("window_ms"))
    return grouped.agg(F.count(F.lit(1)).alias("attempts"), F.array_sort(F.collect_set("username")).alias("usernames")).where(F.col("attempts") >= least)


def brute_force_tiers(events: DataFrame, medium: int = 10, high: int = 25, minutes: int = 5, longer: int = 10) -> DataFrame:
    """Both tiers: ``medium`` failures in ``minutes`` is Medium, ``high`` in ``longer`` minutes is High. A source can have both."""
    tier = lambda least, span, name: brute_force(events, least, span).select("source_ip", "service", "window_ms", "attempts", F.lit(name).alias("severity"))
    return tier(medium, minutes, "Medium").unionByName(tier(high, longer, "High"))


def lateral_behaviour(events: DataFrame, services: int = 3, ports: int = 5, minutes: int = 10) -> DataFrame:
    """Many services or ports of an address in a window; both is critical."""
    grouped = events.groupBy("source_ip", bucket(minutes * MINUTE).alias("window_ms")).agg(F.count_distinct("service").alias("services"), F.count_distinct("dest_port").alias("ports"))
    wide, deep = F.col("services") >= services, F.col("ports") >= ports
    return grouped.where(wide | deep).withColumn("severity", F.when(wide & deep, "Critical").otherwise("High"))


def high_volume(events: DataFrame, service: str = "ssh", most: int = 50, minutes: int = 5) -> DataFrame:
    rows = events.where(F.col("service") == service).groupBy("source_ip", bucket(minutes * MINUTE).alias("window_ms")).agg(F.count(F.lit(1)).alias("events"))
    return rows.where(F.col("events") > most)


def detections(events: DataFrame, least: int = 10) -> DataFrame:
    """``rule, source_ip, ts_ms`` of the four rules; a window counts at its start."""
    event = lambda test, name: events.where(test).select(F.lit(name).alias("rule"), "source_ip", "ts_ms")
    window = lambda df, name: df.select(F.lit(name).alias("rule"), "source_ip", F.col("window_ms").alias("ts_ms"))
    parts = [window(brute_force(events, least), "brute_force"), event(uploads(events), "upload"), event(is_command(), "command"), window(lateral_behaviour(events), "lateral")]
    return reduce(DataFrame.unionByName, parts)


def escalations(events: DataFrame, minutes: int = 15) -> DataFrame:
    """Commands with an upload of the same address within ``minutes``, before or after: the nearest upload on each side decides, so events aren't paired."""
    up = uploads(events)
    marked = events.where(up | is_command()).withColumns({"__up": up, "__do": is_command()})
    order = Window.partitionBy("source_ip").orderBy("ts_ms", "seq")
    up = F.when(F.col("__up"), F.col("ts_ms"))
    before = F.last(up, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(up, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("ts_ms") - before, after - F.col("ts_ms"))
    return marked.withColumn("upload_gap_ms", near).where(F.col("__do") & (F.col("upload_gap_ms") <= minutes * MINUTE)).select("seq", "source_ip", "ts_ms", "upload_gap_ms")


def correlations(found: DataFrame, least: int = 2, minutes: int = 30) -> DataFrame:
    """Addresses with ``least`` different rules within ``minutes``: the first time and the rules at that time.

    For each rule only the last time so far matters, four columns in all, so a frame needs no set.
    """
    names = ("brute_force", "upload", "command", "lateral")
    frame = Window.partitionBy("source_ip").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, 0)
    last = {f"__{n}": F.max(F.when(F.col("rule") == n, F.col("ts_ms"))).over(frame) for n in names}
    present = F.filter(F.array(*(F.when(F.col("ts_ms") - F.col(f"__{n}") <= minutes * MINUTE, F.lit(n)) for n in sorted(names))), lambda x: x.isNotNull())
    rows = found.withColumns(last).withColumn("rules", present).where(F.size("rules") >= least)
    return rows.groupBy("source_ip").agg(F.min(F.struct("ts_ms", "rules")).alias("f")).select("source_ip", F.col("f.ts_ms").alias("ts_ms"), F.array_join("f.rules", ",").alias("rules"))


def alert_payloads(events: DataFrame, rule: str, severity: str, paths: int = 3) -> DataFrame:
    """One alert for each address and service, with its first ``paths`` paths and, where events have ``session_id``, as many sessions.

    Values are cut to the first few of each alert before they are gathered.
    """
    by = ["source_ip", "service"]
    alerts = events.groupBy(*by).agg(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.count(F.lit(1)).alias("events"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
    )
    for column, name in (("path", "sample_paths"), ("session_id", "session_ids")):
        if column in events.columns:
            alerts = alerts.join(first_values(events, by, column, paths).withColumnRenamed("values", name), by, "left")
            alerts = alerts.withColumn(name, F.coalesce(F.array_join(name, ","), F.lit("")))
    return alerts


def first_values(events: DataFrame, by: list[str], column: str, n: int) -> DataFrame:
    """``by`` and ``values``: the ``n`` least different values of ``column``. Tasks keep ``n`` of a key before the shuffle, so no set grows with the data."""
    order = Window.partitionBy(*by).orderBy(column)
    few = events.where(F.col(column).isNotNull()).select(*by, column).distinct().withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= n)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list(column)).alias("values"))


def reused_hashes(events: DataFrame, most_ips: int = 5, most_events: int | None = None) -> DataFrame:
    """Credential hashes from more than ``most_ips`` addresses, or seen more than ``most_events`` times."""
    rows = events.where(F.col("credential").isNotNull()).groupBy("credential").agg(F.count_distinct("source_ip").alias("ips"), F.count(F.lit(1)).alias("events"))
    return rows.where(F.col("ips") > most_ips if most_events is None else F.col("events") > most_events)


def first_in_window(events: DataFrame, by: list[str], minutes: int = 30) -> DataFrame:
    """Without repeats of ``by`` within ``minutes`` of the one before."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy(*by).orderBy("ts_ms", "seq"))
    return events.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") > minutes * MINUTE)).drop("__gap")
