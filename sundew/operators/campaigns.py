"""Campaign checks CAMP-001 to 007 for every campaign, and the profile.

A campaign is the column ``campaign``, for instance a tumbling window. Every check gives at most one row for each:
check_id, campaign, evidence, ips.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sundew.functions.fields import campaign_tier, is_common_word, is_targeted
from sundew.functions.net import slash24, slash28
from sundew.operators.rates import distinct_in_window, reachable
from sundew.operators.rules import first_values
from sundew.plans.tables import materialize

#: Weight and severity of a check.
CHECKS = {
    "CAMP-001": (45, "CRITICAL"), "CAMP-002": (30, "HIGH"), "CAMP-003": (25, "HIGH"), "CAMP-004": (25, "HIGH"),
    "CAMP-005": (20, "MEDIUM"), "CAMP-006": (20, "MEDIUM"), "CAMP-007": (15, "MEDIUM"),
}


def tumbling(events: DataFrame, seconds: int) -> DataFrame:
    """Add ``campaign``: the start, in ms, of the epoch-aligned window."""
    ms = seconds * 1000
    return events.withColumn("campaign", F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(ms)))


def with_first_ips(groups: DataFrame, events: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """``groups`` with ``ips``, the first ``n`` addresses of their events. Only ``n`` of a group are ever gathered."""
    return groups.join(first_values(events, by, "source_ip", n).withColumnRenamed("values", "ips"), by)


def address_groups(events: DataFrame, by: list[str], least: int) -> DataFrame:
    """``by`` with ``n`` addresses (``least`` or more), the first event ``seen``, and ``ips``."""
    each = events.groupBy(*by, "source_ip").agg(F.min("seq").alias("seen"))
    groups = each.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen")).where(F.col("n") >= least)
    return with_first_ips(groups, each, by)


def _best(groups: DataFrame, check: str) -> DataFrame:
    """The group with most addresses of each campaign, the first seen of equals; groups have campaign, evidence, n, seen, ips."""
    top = groups.groupBy("campaign").agg(F.max(F.struct("n", (-F.col("seen")).alias("__s"), "evidence", "ips")).alias("b"))
    return top.select(F.lit(check).alias("check_id"), "campaign", F.col("b.evidence").alias("evidence"), F.col("b.ips").alias("ips"))


def camp001(events: DataFrame) -> DataFrame:
    """A credential from three addresses or more."""
    known = events.where((F.coalesce("username", F.lit("")) != "") & (F.coalesce("password", F.lit("")) != ""))
    groups = address_groups(known, ["campaign", "username", "password"], 3)
    return _best(groups.withColumn("evidence", F.concat("username", F.lit(" from "), F.col("n").cast("string"), F.lit(" addresses"))), "CAMP-001")


def camp002(events: DataFrame, least: int = 5, window_ms: int = 3_600_000) -> DataFrame:
    """A service touched by ``least`` addresses within an hour, at the first event where they are most."""
    by = ["campaign", "service"]
    rises = distinct_in_window(reachable(events, by, "source_ip", window_ms, least), by, "source_ip", window_ms).where(F.col("n") >= least)
    peak = rises.groupBy(*by).agg(F.max(F.struct("n", (-F.col("ts_ms")).alias("__t"), (-F.col("seq")).alias("__s"))).alias("p"))
    seen = events.groupBy(*by).agg(F.min("seq").alias("seen"))
    best = peak.join(seen, by).groupBy("campaign").agg(F.max(F.struct("p.n", (-F.col("seen")).alias("__seen"), "service", "p.__t", "p.__s")).alias("b"))
    best = best.select("campaign", F.col("b.service").alias("service"), F.col("b.n").alias("n"), (-F.col("b.__t")).alias("end_ms"), (-F.col("b.__s")).alias("end_seq"))
    inside = (F.col("ts_ms") >= F.col("end_ms") - window_ms) & (F.struct("ts_ms", "seq") <= F.struct(F.col("end_ms").alias("ts_ms"), F.col("end_seq").alias("seq")))
    ips = first_values(events.join(best.hint("shuffle_hash"), by).where(inside), ["campaign", "service", "n"], "source_ip", 10).withColumnRenamed("values", "ips")
    return ips.select(F.lit("CAMP-002").alias("check_id"), "campaign", F.concat("service", F.lit(" from "), F.col("n").cast("string"), F.lit(" addresses")).alias("evidence"), "ips")


def camp003(events: DataFrame, gap_ms: int = 300_000) -> DataFrame:
    """Three neighbouring seen addresses of a /24, each two first seen within less than ``gap_ms``; the first subnet, the first three."""
    keyed = events.withColumns({"subnet": slash24(F.col("source_ip")), "octet": F.element_at(F.split("source_ip", r"\."), -1).try_cast("int")})
    keyed = keyed.where(F.col("subnet").isNotNull() & F.col("octet").isNotNull())
    octets = keyed.groupBy("campaign", "subnet", "octet").agg(F.min("ts_ms").alias("t"), F.min("seq").alias("s"))
    order = Window.partitionBy("campaign", "subnet").orderBy("octet")
    nxt = lambda c, i: F.lead(c, i).over(order)
    rows = octets.withColumns({"b": nxt("octet", 1), "c": nxt("octet", 2), "tb": nxt("t", 1), "tc": nxt("t", 2), "seen": F.min("s").over(Window.partitionBy("campaign", "subnet"))})
    hits = rows.where((F.abs(F.col("tb") - F.col("t")) < gap_ms) & (F.abs(F.col("tc") - F.col("tb")) < gap_ms))
    first = hits.groupBy("campaign").agg(F.min(F.struct("seen", "octet", "subnet", "b", "c")).alias("f"))
    ip = lambda o: F.concat("f.subnet", F.lit("."), F.col(o).cast("string"))
    three = F.array(ip("f.octet"), ip("f.b"), ip("f.c"))
    return first.select(F.lit("CAMP-003").alias("check_id"), "campaign", F.array_join(three, " -> ").alias("evidence"), F.array_sort(three).alias("ips"))


def camp004(events: DataFrame) -> DataFrame:
    """A user agent of three addresses or more."""
    known = events.where(F.trim(F.coalesce("user_agent", F.lit(""))) != "")
    groups = address_groups(known, ["campaign", "user_agent"], 3)
    return _best(groups.withColumn("evidence", F.substring("user_agent", 1, 60)), "CAMP-004")


def camp005(events: DataFrame, least: int = 20, least_ips: int = 3, burst_ms: int = 300_000, silence_ms: int = 1_800_000) -> DataFrame:
    """A burst followed by silence. Only the last event before a silence can fire, so only those look back.

    Silences are found among spans as long as a silence at most: their first and last events are a row each, and inside one only events
    of that span are ordered, so a campaign of any length is spread.
    """
    cell = events.select("campaign", "ts_ms").distinct().withColumn("cell", F.floor(F.col("ts_ms") / max(min(silence_ms, 60_000), 1)))
    edges = cell.groupBy("campaign", "cell").agg(F.min("ts_ms").alias("first"))
    nxt = edges.withColumn("next", F.lead("first").over(Window.partitionBy("campaign").orderBy("cell"))).select("campaign", "cell", "next")
    inside = F.lead("ts_ms").over(Window.partitionBy("campaign", "cell").orderBy("ts_ms"))
    ends = cell.withColumn("inside", inside).join(nxt.hint("shuffle_hash"), ["campaign", "cell"]).withColumn("wait", F.coalesce("inside", "next") - F.col("ts_ms"))
    ends = ends.where(F.col("wait").isNull() | (F.col("wait") >= silence_ms)).select("campaign", F.col("ts_ms").alias("end_ms"))
    # the burst may reach over one border of burst-long buckets
    bucket = F.floor(F.col("ts_ms") / burst_ms)
    near = ends.withColumn("bucket", F.explode(F.array(F.floor(F.col("end_ms") / burst_ms), F.floor(F.col("end_ms") / burst_ms) - 1))).distinct()
    back = events.withColumn("bucket", bucket).join(near.hint("shuffle_hash"), ["campaign", "bucket"]).where(F.col("ts_ms").between(F.col("end_ms") - burst_ms, F.col("end_ms")))
    by = ["campaign", "end_ms"]
    groups = back.groupBy(*by, "source_ip").agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(F.sum("k").alias("events"), F.count(F.lit(1)).alias("n")).where((F.col("events") >= least) & (F.col("n") >= least_ips))
    first = groups.groupBy("campaign").agg(F.min(F.struct("end_ms", "events", "n")).alias("f")).select("campaign", "f.*")
    first = with_first_ips(first, back.join(first.select(*by), by, "left_semi"), by).select("campaign", F.struct("end_ms", "events", "n", "ips").alias("f"))
    return first.select(F.lit("CAMP-005").alias("check_id"), "campaign", F.format_string("%d events from %d addresses, then silence", "f.events", "f.n").alias("evidence"), F.col("f.ips").alias("ips"))


def camp006(events: DataFrame) -> DataFrame:
    """Addresses that went from common words to targeted passwords: the first half of their passwords against the rest."""
    known = events.where(F.coalesce("password", F.lit("")) != "")
    key, at, password = F.struct("campaign", "source_ip").alias("k"), F.struct("ts_ms", "seq"), F.col("password")
    # only the first common word and the last targeted one can decide; their places are counted, so no address is ordered in one task
    ends = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(is_common_word(password), at)).alias("common"), F.max(F.when(is_targeted(password), at)).alias("targeted"))
    ends = ends.where("common < targeted")
    places = known.select(key, at.alias("at")).join(ends.hint("shuffle_hash"), "k").groupBy("k", "n").agg(F.count_if(F.col("at") <= F.col("common")).alias("early"), F.count_if(F.col("at") <= F.col("targeted")).alias("late"))
    half = F.floor(F.col("n") / 2)
    ips = places.where((F.col("early") <= half) & (F.col("late") > half)).select("k.campaign", "k.source_ip")
    counted = with_first_ips(ips.groupBy("campaign").agg(F.count(F.lit(1)).alias("n")), ips, ["campaign"])
    return counted.select(F.lit("CAMP-006").alias("check_id"), "campaign", F.concat(F.col("n").cast("string"), F.lit(" addresses")).alias("evidence"), "ips")


def camp007(events: DataFrame, time: str = "ts_ms", span_ms: int = 172_800_000) -> DataFrame:
    """Addresses seen more than 48 hours apart; only where there are none, the first /28 with two addresses."""
    each = events.groupBy("campaign", "source_ip").agg(F.min(time).alias("since"), F.max(time).alias("until"), F.min("seq").alias("seen"))
    long = each.where(F.col("until") - F.col("since") > span_ms)
    own = with_first_ips(long.groupBy("campaign").agg(F.count(F.lit(1)).alias("n")), long, ["campaign"])
    own = own.select("campaign", F.concat(F.col("n").cast("string"), F.lit(" addresses")).alias("evidence"), "ips")
    nets = each.withColumn("net", slash28(F.col("source_ip"))).where(F.col("net").isNotNull())
    wide = nets.groupBy("campaign", "net").agg((F.max("until") - F.min("since")).alias("span"), F.min("seen").alias("seen"), F.count(F.lit(1)).alias("n"))
    wide = wide.where((F.col("span") > span_ms) & (F.col("n") >= 2)).groupBy("campaign").agg(F.min(F.struct("seen", "net", "n")).alias("f")).select("campaign", "f.net", "f.n")
    # a /28 has sixteen addresses at most
    wide = with_first_ips(wide, nets, ["campaign", "net"]).select("campaign", F.struct("n", "ips").alias("f"))
    wide = wide.select("campaign", F.format_string("/28 of %d addresses", "f.n").alias("evidence"), F.col("f.ips").alias("ips")).join(own, "campaign", "left_anti")
    return own.unionByName(wide).select(F.lit("CAMP-007").alias("check_id"), "campaign", "evidence", "ips")


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"CAMP-001": camp001, "CAMP-002": camp002, "CAMP-003": camp003, "CAMP-004": camp004, "CAMP-005": camp005, "CAMP-006": camp006, "CAMP-007": camp007}


def campaign_checks(events: DataFrame, checks: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    # seven plans read the events: projected and written once, with the columns that checks use
    names = ["campaign", "seq", "ts_ms", "source_ip", "service", "username", "password", "user_agent"]
    events = materialize(events.select(*(c for c in names if c in events.columns)), "campaign-events")
    every = reduce(DataFrame.unionByName, (check(events) for check in (checks or REGISTRY).values()))
    fixed = lambda i: F.create_map(*(F.lit(x) for k, v in CHECKS.items() for x in (k, v[i])))[F.col("check_id")]
    return every.withColumns({"weight": fixed(0), "severity": fixed(1)})


def campaign_ids(events: DataFrame, event_id: str = "seq", chunked: bool = False) -> DataFrame:
    """``campaign, campaign_id``: 12 hex of the digest of the campaign's sorted ids.

    It needs all ids of a campaign in one row; ``chunked`` digests them by the thousand first, for campaigns that
    don't fit, and gives other ids.
    """
    ids = F.array_join(F.array_sort(F.collect_set(F.col(event_id).cast("string"))), ",")
    if chunked:
        part = events.withColumn("__part", F.floor(F.col(event_id) / 1000)).groupBy("campaign", "__part").agg(F.sha2(ids, 256).alias("d"))
        return part.groupBy("campaign").agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__part", "d"))), lambda x: x["d"]), ","), 256), 1, 12).alias("campaign_id"))
    return events.groupBy("campaign").agg(F.substring(F.sha2(ids, 256), 1, 12).alias("campaign_id"))


def merged_ids(events: DataFrame, event_id: str = "seq") -> DataFrame:
    """``campaign, campaign_id``: 12 hex of a digest that doesn't depend on the order, so that partial sums merge and no row or task has a list of ids.

    Every id's SHA-256 gives eight numbers of 24 bits; they are summed over the campaign, and the sums are hashed. An id that comes twice counts twice.
    """
    digest = F.sha2(F.col(event_id).cast("string"), 256)
    each = events.select("campaign", *(F.conv(F.substring(digest, 1 + 6 * i, 6), 16, 10).cast("long").alias(f"d{i}") for i in range(8)))
    sums = each.groupBy("campaign").agg(*(F.sum(f"d{i}").cast("string").alias(f"d{i}") for i in range(8)))
    return sums.select("campaign", F.substring(F.sha2(F.concat_ws(",", *(f"d{i}" for i in range(8))), 256), 1, 12).alias("campaign_id"))


def profiles(events: DataFrame, checked: DataFrame, event_id: str = "seq", chunked: bool = False) -> DataFrame:
    """One row for each campaign: id (see ``campaign_ids``), score, tier, totals, span, fired checks."""
    named = campaign_ids(events, event_id, chunked)
    totals = events.groupBy("campaign").agg(F.count(F.lit(1)).alias("total_events"), F.count_distinct("source_ip").alias("unique_ips"), F.floor((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("span_s"))
    fired = checked.groupBy("campaign").agg(F.least(F.lit(100), F.sum("weight")).cast("int").alias("risk_score"), F.array_join(F.array_sort(F.collect_list("check_id")), ", ").alias("checks"))
    score = F.coalesce("risk_score", F.lit(0))
    return totals.join(named, "campaign").join(fired, "campaign", "left").select(
        "campaign", "campaign_id", score.alias("risk_score"), campaign_tier(score).alias("tier"), "total_events", "unique_ips", "span_s", F.coalesce("checks", F.lit("none")).alias("checks")
    )
