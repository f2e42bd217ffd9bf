"""Lateral movement checks LATM-001 to 007, their roll-up, and count batches.

Each check is a function from events to findings: check_id, subject, source_ips, event_ids. Events have
seq, ts_ms, source_ip, sensor_host, username, password, success. What only counts findings (``rated``) takes the keys that fire,
and reads no event a second time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sundew.functions.fields import lateral_level
from sundew.functions.net import is_internal
from sundew.operators.rates import distinct_in_window, haloed, over_limit, reachable
from sundew.plans.tables import ranked

HOUR, MINUTE = 3_600_000, 60_000
#: Weight and severity of a check.
CHECKS = {
    "LATM-001": (45, "CRITICAL"), "LATM-002": (25, "HIGH"), "LATM-003": (20, "HIGH"), "LATM-004": (25, "HIGH"),
    "LATM-005": (25, "HIGH"), "LATM-006": (15, "MEDIUM"), "LATM-007": (20, "HIGH"),
}


def _order(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("ts_ms", "seq")


def _placed(events: DataFrame) -> DataFrame:
    """An event without an address is nobody's, and one without a time is in no window."""
    return events.where(F.col("source_ip").isNotNull() & F.col("ts_ms").isNotNull())


def _finding(df: DataFrame, check: str, subject: Column, ips: Column, ids: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_id"), subject.alias("subject"), ips.alias("source_ips"), ids.alias("event_ids"))


def _window_rows(events: DataFrame, fired: DataFrame, by: list[str], window_ms: int) -> DataFrame:
    """Events of the window that ends with the firing row: ``fired`` has ``by``, ``end_ms``, ``end_seq``. Only firing keys are read again."""
    inside = (F.col("ts_ms") >= F.col("end_ms") - window_ms) & (F.struct("ts_ms", "seq") <= F.struct(F.col("end_ms").alias("ts_ms"), F.col("end_seq").alias("seq")))
    # written events look small to the planner, which would broadcast them
    rows = events.join(fired.hint("shuffle_hash"), by).where(inside)
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set("source_ip")).alias("ips"), F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "seq"))), lambda x: x["seq"]).alias("ids"))


def _first(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(F.struct("ts_ms", "seq")).alias("f")).select(*by, F.col("f.ts_ms").alias("end_ms"), F.col("f.seq").alias("end_seq"))


def _known(events: DataFrame) -> DataFrame:
    return events.where(F.col("username").isNotNull() & F.col("password").isNotNull())


def _fired001(events: DataFrame) -> DataFrame:
    by = ["username", "password"]
    order = _order(*by, "__bucket")
    near = F.col("ts_ms") - F.lag("ts_ms").over(order) <= HOUR
    return _first(haloed(_known(events), HOUR).withColumn("hit", near & (F.lag("source_ip").over(order) != F.col("source_ip"))).where("hit and __own"), by)


def latm001(events: DataFrame) -> DataFrame:
    """A credential from two addresses within an hour: the event before, in the pair's order, has another address and is near enough."""
    rows = _window_rows(_known(events), _fired001(events), ["username", "password"], HOUR)
    return _finding(rows, "LATM-001", F.concat("username", F.lit(":****:"), F.substring(F.sha2("password", 256), 1, 8)), F.col("ips"), F.col("ids"))


def _distinct_fired(events: DataFrame, value: str, most: int, window_ms: int) -> DataFrame:
    """More than ``most`` different values of an address within the window, at the first event where it is so."""
    seen = reachable(_placed(events), ["source_ip"], value, window_ms, most + 1)
    return _first(distinct_in_window(seen, ["source_ip"], value, window_ms).where(F.col("n") > most), ["source_ip"])


def _distinct_check(events: DataFrame, check: str, value: str, fired: DataFrame, window_ms: int) -> DataFrame:
    rows = _window_rows(events.where(F.col(value).isNotNull()), fired, ["source_ip"], window_ms)
    return _finding(rows, check, F.col("source_ip"), F.array("source_ip"), F.col("ids"))


def _fired002(events: DataFrame) -> DataFrame:
    return _distinct_fired(events, "sensor_host", 2, 30 * MINUTE)


def latm002(events: DataFrame) -> DataFrame:
    """More than two hosts within 30 minutes."""
    return _distinct_check(events, "LATM-002", "sensor_host", _fired002(events), 30 * MINUTE)


def _fired003(events: DataFrame) -> DataFrame:
    return _distinct_fired(events, "username", 5, 10 * MINUTE)


def latm003(events: DataFrame) -> DataFrame:
    """More than five user names within 10 minutes; an empty name counts, a null does not."""
    return _distinct_check(events, "LATM-003", "username", _fired003(events), 10 * MINUTE)


def latm004(events: DataFrame) -> DataFrame:
    """Events from internal addresses: one finding over all. Ids come as one list, as the finding wants; who reads no lists, as the risk does, gathers none."""
    inside = events.where(is_internal(F.col("source_ip")))
    rows = inside.agg(F.array_sort(F.collect_set("source_ip")).alias("ips"), F.array_sort(F.collect_list("seq")).alias("ids"), F.count(F.lit(1)).alias("n")).where("n > 0")
    return _finding(rows, "LATM-004", F.lit("internal"), F.col("ips"), F.col("ids"))


def latm004_events(events: DataFrame) -> DataFrame:
    """The events of LATM-004 as rows ``check_id, source_ip, seq``: any number of them, none gathered."""
    return events.where(is_internal(F.col("source_ip"))).select(F.lit("LATM-004").alias("check_id"), "source_ip", "seq")


def latm005(events: DataFrame) -> DataFrame:
    """A success followed within five minutes by another host: the next host is the next run's, so there is no self-join.

    Time runs backwards here, so that what follows an event is a running value, and the halo of a bucket is the five minutes after it.
    """
    window_ms = 5 * MINUTE
    back = haloed(_placed(events).withColumns({"ts_ms": -F.col("ts_ms"), "seq": -F.col("seq")}), window_ms)
    order = _order("source_ip", "__bucket")
    # the bucket's earliest event has none before it here, and nothing that it could follow
    runs = back.withColumn("__new", F.when(F.lead("sensor_host").over(order) == F.col("sensor_host"), 0).otherwise(1))
    later = order.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct((-F.col("ts_ms")).alias("ts_ms"), (-F.col("seq")).alias("seq"))
    ahead = runs.withColumns({"at": at, "follow": F.last(F.when(F.col("__new") == 1, at), ignorenulls=True).over(later)})
    hits = ahead.where(F.col("__own") & F.col("success") & (F.col("follow.ts_ms") - F.col("at.ts_ms") <= window_ms))
    rows = hits.groupBy("source_ip").agg(F.min(F.struct("at", "follow")).alias("f"))
    return _finding(rows, "LATM-005", F.col("source_ip"), F.array("source_ip"), F.array("f.at.seq", "f.follow.seq"))


def _fired006(events: DataFrame) -> DataFrame:
    """Addresses whose last failure is after the first success: no failure meets a success."""
    edges = _placed(events).groupBy("source_ip").agg(F.min(F.when(F.col("success"), F.col("ts_ms"))).alias("ok_ms"), F.max(F.when(~F.col("success"), F.col("ts_ms"))).alias("failed_ms"))
    return edges.where("failed_ms > ok_ms")


def latm006(events: DataFrame) -> DataFrame:
    """Failures strictly after an address's first success."""
    first = _placed(events).where("success").groupBy("source_ip").agg(F.min(F.struct("ts_ms", "seq")).alias("ok"))
    failed = events.where(~F.col("success")).join(first.hint("shuffle_hash"), "source_ip").where(F.col("ts_ms") > F.col("ok.ts_ms"))
    rows = failed.groupBy("source_ip", "ok").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "seq"))), lambda x: x["seq"]).alias("ids"))
    return _finding(rows, "LATM-006", F.col("source_ip"), F.array("source_ip"), F.concat(F.array("ok.seq"), F.col("ids")))


def _fired007(events: DataFrame, most: int = 10, window_ms: int = MINUTE) -> DataFrame:
    return _first(over_limit(_placed(events), most, window_ms).where("triggered"), ["source_ip"])


def latm007(events: DataFrame, most: int = 10, window_ms: int = MINUTE) -> DataFrame:
    """More than ``most`` events within a minute."""
    rows = _window_rows(events, _fired007(events, most, window_ms), ["source_ip"], window_ms)
    return _finding(rows, "LATM-007", F.col("source_ip"), F.array("source_ip"), F.col("ids"))


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"LATM-001": latm001, "LATM-002": latm002, "LATM-003": latm003, "LATM-004": latm004, "LATM-005": latm005, "LATM-006": latm006, "LATM-007": latm007}


#: What has one row for each finding of a check.
FIRED: dict[str, Callable[[DataFrame], DataFrame]] = {"LATM-001": _fired001, "LATM-002": _fired002, "LATM-003": _fired003, "LATM-004": latm004, "LATM-005": latm005, "LATM-006": _fired006, "LATM-007": _fired007}


def findings(events: DataFrame, checks: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All findings with weight and severity."""
    return _weighed(reduce(DataFrame.unionByName, (check(events) for check in (checks or REGISTRY).values())))


def rated(events: DataFrame) -> DataFrame:
    """``check_id``, ``weight`` and ``severity`` of all findings, without what they consist of."""
    return _weighed(reduce(DataFrame.unionByName, (fired(events).select(F.lit(check).alias("check_id")) for check, fired in FIRED.items())))


def _weighed(every: DataFrame) -> DataFrame:
    fixed = lambda i: F.create_map(*(F.lit(x) for k, v in CHECKS.items() for x in (k, v[i])))[F.col("check_id")]
    return every.withColumns({"weight": fixed(0), "severity": fixed(1)})


def risk(found: DataFrame) -> DataFrame:
    """One row of ``findings`` or ``rated``: the weights of the different checks, 100 at most, level, and the number of findings."""
    each = found.groupBy("check_id", "weight").agg(F.count(F.lit(1)).alias("n"))
    total = each.agg(F.least(F.lit(100), F.coalesce(F.sum("weight"), F.lit(0))).cast("int").alias("risk_score"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))
    return total.withColumn("level", lateral_level(F.col("risk_score")))


def by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"), F.array_sort(F.collect_set("check_id")).alias("checks"))


def count_batches(events: DataFrame, size: int) -> DataFrame:
    """Add ``batch``: the number of the run of ``size`` events, in order of arrival. Ranked range by range, not in one task."""
    return ranked(events, [F.col("seq")], "__rank", "batches").withColumn("batch", F.floor(F.col("__rank") / size)).drop("__rank")
