"""Counts for dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.functions.fields import credential_hash


def export_stats(events: DataFrame) -> DataFrame:
    """Rows ``kind, value, n``: the total, each service, and the ten most frequent addresses, in one shuffle."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    keys = F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")), F.when(has("service"), F.struct(F.lit("service").alias("kind"), F.col("service").alias("value"))))
    few = events.select(F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))
    return few.unionByName(top_values(events, "source_ip", 10).select(F.lit("source_ip").alias("kind"), "value", "n"))


def summary(events: DataFrame, approximate: bool = False) -> DataFrame:
    ips = F.approx_count_distinct("source_ip") if approximate else F.count_distinct("source_ip")
    return events.agg(F.count(F.lit(1)).alias("total_events"), ips.alias("unique_source_ips"))


def credential_reuse(events: DataFrame, least: int = 2) -> DataFrame:
    """How many credential hashes come from ``least`` addresses or more."""
    keyed = events.select(credential_hash(F.col("credential")).alias("key"), "source_ip").where("key is not null")
    return keyed.groupBy("key").agg(F.count_distinct("source_ip").alias("ips")).where(F.col("ips") >= least).agg(F.count(F.lit(1)).alias("credential_reuse"))


def hourly(events: DataFrame) -> DataFrame:
    hour = F.timestamp_millis(F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(3_600_000)))
    return events.groupBy(F.date_format(hour, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def countries(enriched: DataFrame, n: int = 20) -> DataFrame:
    rows = enriched.groupBy("country_code", "country_name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seen"))
    return rows.orderBy(F.desc("n"), "seen").limit(n).drop("seen")


def top_values(events: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-empty values, the first seen of equals."""
    rows = events.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").groupBy(F.col(column).cast("string").alias("value"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seen")).orderBy(F.desc("n"), "seen").limit(n).drop("seen")


def top_of_service(events: DataFrame, service: str, column: str, n: int = 10, missing: str = "") -> DataFrame:
    """``value, n``: the most frequent values of a service's events. Nulls count as ``missing``, and are left out where that is empty, as empty values are."""
    own = events.where(F.col("service") == service)
    return top_values(own.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(missing))), column, n)


def unique_by_service(events: DataFrame, column: str = "source_ip", approximate: bool = False) -> DataFrame:
    """``service, n``: how many different values each service has; nulls are none. Exact counts take a row for each value and service to the shuffle."""
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return events.groupBy("service").agg(count.alias("n"))


def hours_of_day(events: DataFrame, by: str | None = None) -> DataFrame:
    """``hour, n`` (for each ``by``): events by the UTC hour of the day, 24 rows at most; events without a time have a null hour."""
    hour = F.floor(F.pmod(F.col("ts_ms"), F.lit(86_400_000)) / 3_600_000).cast("int").alias("hour")
    return events.groupBy(*([by] if by else []), hour).agg(F.count(F.lit(1)).alias("n"))


def event_rates(events: DataFrame, by: str = "source_ip") -> DataFrame:
    """``value, n, per_hour`` of each ``by``: its events over the time from its first to its last, an hour at least."""
    each = events.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n"), (F.max("ts_ms") - F.min("ts_ms")).alias("span"))
    return each.select("value", "n", (F.col("n") / F.greatest(F.coalesce("span", F.lit(0)) / 3_600_000, F.lit(1.0))).alias("per_hour"))


def document(events: DataFrame, window: str, now_text: str, n: int = 10) -> DataFrame:
    """The whole dashboard as one row of JSON.

    One pass over the events counts every facet's values (a row for each facet and event goes to the partial sums, a row for each
    different value to the shuffle); the lists are cut before they meet.
    """
    facet = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.lit(name).alias("facet"), value.alias("value")))
    hour = F.date_format(F.timestamp_millis(F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(3_600_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    facets = F.array(facet("service", F.col("service")), facet("hour", hour), facet("ip", F.col("source_ip")), facet("user", F.col("username")), facet("agent", F.col("user_agent")))
    spread = events.select("seq", "source_ip", F.explode(F.filter(facets, lambda x: x.isNotNull())).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seen"))
    cut = spread.where(F.col("facet").isin("service", "hour"))
    for name in ("ip", "user", "agent"):
        cut = cut.unionByName(spread.where(F.col("facet") == name).orderBy(F.desc("n"), "seen").limit(n))
    ips = spread.where("facet = 'ip'").agg(F.count(F.lit(1)).alias("ips"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    entry = F.struct((-F.col("n")).alias("m"), "seen", "value", "n")
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("facet") == name, entry))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count")))
    mapped = lambda name: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("facet") == name, F.struct("value", "n")))))
    lists = cut.agg(listed("ip").alias("top_source_ips"), listed("user").alias("top_usernames"), listed("agent").alias("top_user_agents"), mapped("service").alias("services"), mapped("hour").alias("hourly_distribution"))
    key = F.lit(1)
    one = lists.withColumn("k", key).join(ips.withColumn("k", key), "k").join(credential_reuse(events).withColumn("k", key), "k")
    head = F.struct(F.col("total").alias("total_events"), F.col("ips").alias("unique_source_ips"), "credential_reuse", F.col("services").alias("events_by_service"))
    body = F.struct(F.lit(now_text).alias("generated_at"), F.lit(window).alias("window"), head.alias("summary"), "top_source_ips", "top_usernames", "top_user_agents", "hourly_distribution")
    return one.select(F.to_json(body, {"pretty": "true"}).alias("value"))
