"""Alert deduplication and suppression rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sundew.functions.fields import credential_key
from sundew.operators.rates import islands


@dataclass(frozen=True)
class Rule:
    """All given criteria have to hold; a rule without any matches everything."""

    reason: str
    ip_prefix: str | None = None
    username_regex: str | None = None
    service: str | None = None
    expires_ms: int | None = None

    def matches(self, now_ms: Column) -> Column:
        test = F.lit(True)
        if self.ip_prefix is not None:
            test = test & F.col("source_ip").startswith(self.ip_prefix)
        if self.username_regex is not None:
            test = test & (F.coalesce("username", F.lit("")) != "") & F.col("username").rlike(f"(?i){self.username_regex}")
        if self.service is not None:
            test = test & (F.col("service") == self.service)
        if self.expires_ms is not None:
            test = test & (now_ms <= self.expires_ms)
        return F.coalesce(test, F.lit(False))


def live_rules(rules: Sequence[Rule], now_ms: int) -> list[Rule]:
    """Without those that have expired; at the very moment of expiry a rule goes, though it still matches then."""
    return [r for r in rules if r.expires_ms is None or r.expires_ms > now_ms]


def suppression(rules: Sequence[Rule], now_ms: Column) -> Column:
    """The reason of the first rule that matches, or null."""
    return F.coalesce(*(F.when(r.matches(now_ms), F.lit(r.reason)) for r in rules), F.lit(None).cast("string"))


#: Rules that a task meets at once; more are dealt to parts of about so many.
RULES_TOGETHER = 10_000
#: Copies of a part's lists, so that the events of a service are dealt to as many tasks.
COPIES = 64


def _first_rule(rules: Column) -> Column:
    """The first of a sorted list of rules that matches the event."""

    def matches(r: Column) -> Column:
        ip = r["ip_prefix"].isNull() | F.col("source_ip").startswith(r["ip_prefix"])
        user = r["username_regex"].isNull() | ((F.coalesce("username", F.lit("")) != "") & F.rlike("username", F.concat(F.lit("(?i)"), r["username_regex"])))
        alive = r["expires_ms"].isNull() | (F.col("ts_ms") <= r["expires_ms"])
        return F.coalesce(ip & user & alive, F.lit(False))

    return F.get(F.filter(rules, matches), 0)


def suppressed_by_table(events: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with rules as rows: ``rule_seq, reason, ip_prefix, username_regex, service, expires_ms``.

    An event meets two sorted lists, that of its service and that of the rules without one, and keeps its first rule. Up to RULES_TOGETHER rules are broadcast and
    events stay where they are; more are counted first and dealt to parts, each of which meets the events of a service in COPIES tasks. ``seq`` tells events apart.
    """
    rule = F.struct("rule_seq", "reason", "ip_prefix", "username_regex", "expires_ms")
    listed = F.array_sort(F.collect_list(rule))
    if rules.limit(RULES_TOGETHER + 1).count() <= RULES_TOGETHER:
        named = rules.where("service is not null").groupBy(F.col("service").alias("__service")).agg(listed.alias("__named"))
        others = rules.where("service is null").agg(listed.alias("__others"))
        met = events.join(F.broadcast(named), F.col("service") == F.col("__service"), "left").join(F.broadcast(others), F.lit(True), "left")
        # nulls are no smaller, so the first of both is the smaller of those that are there
        return met.select(*events.columns, F.array_min(F.array(_first_rule(F.col("__named")), _first_rule(F.col("__others"))))["reason"].alias("suppressed_by"))
    parts = -(-rules.count() // RULES_TOGETHER)
    part = F.pmod(F.xxhash64("rule_seq", "reason"), F.lit(parts)).alias("part")
    lists = rules.groupBy(F.struct("service", part).alias("k")).agg(listed.alias("__rules"))
    lists = lists.select("k", "__rules", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy")).select(F.struct("k", "copy").alias("__k"), "__rules")
    copy = F.pmod(F.xxhash64("seq"), F.lit(COPIES)).cast("int").alias("copy")
    place = lambda service: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")), lambda p: F.struct(F.struct(service.alias("service"), p.alias("part")).alias("k"), copy))
    places = F.array_distinct(F.concat(place(F.col("service")), place(F.lit(None).cast("string"))))
    met = events.select("seq", "source_ip", "username", "ts_ms", F.explode(places).alias("__k")).join(lists, "__k")
    hits = met.select("seq", _first_rule(F.col("__rules")).alias("r")).groupBy("seq").agg(F.min("r")["reason"].alias("suppressed_by"))
    return events.join(hits, "seq", "left")


def dedup_alerts(events: DataFrame, window_ms: int = 300_000, max_group: int = 100, rules: Sequence[Rule] = ()) -> DataFrame:
    """Add ``suppressed_by``, ``is_alert``, ``group_count`` and ``first_seq`` to every event.

    Events of one address, service and credential form a group while no gap is over ``window_ms``. A group's first
    event alerts, and so does each that fills the group to ``max_group``, which then starts again at one. Suppressed events
    neither alert nor count. Closed form: no state, and a hot key is ordered in cells of time.
    """
    reason = suppression(rules, F.col("ts_ms"))
    marked = events.withColumns({"suppressed_by": reason, "__key": credential_key(F.col("credential"))}).withColumn("__passed", F.col("suppressed_by").isNull())
    by = ["source_ip", "service", "__key", "__passed"]
    marked, passed = islands(marked, by, window_ms), F.col("__passed")
    m, p = max_group, F.col("__p")
    # the first alerts as number 1; the group then runs 2..m, where m alerts and stands for the next group's first
    again = F.lit(True) if m <= 2 else (p - 1) % (m - 1) == 0
    alert = (p == 1) | again
    count = F.when(p == 1, 1).when(alert, F.lit(max(m, 1) if m > 2 else min(m, 2))).otherwise((p - 1) % max(m - 1, 1) + 1)
    first = F.first("seq").over(Window.partitionBy(*by, "__island", F.floor((p - 1) / max(m - 1, 1))).orderBy("ts_ms", "seq"))
    return marked.select(
        *events.columns, "suppressed_by", (passed & alert).alias("is_alert"), F.when(passed, count).cast("long").alias("group_count"), F.when(passed, first).alias("first_seq")
    )


def dedup_counters(decisions: DataFrame) -> DataFrame:
    """One row: processed, suppressed, alerted, deduplicated."""
    return decisions.agg(
        F.count(F.lit(1)).alias("processed"), F.count("suppressed_by").alias("suppressed"), F.count_if("is_alert").alias("alerted"),
        F.count_if(F.col("suppressed_by").isNull() & ~F.col("is_alert")).alias("deduplicated"),
    )
