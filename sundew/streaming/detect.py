"""Detections over streams, with event time, watermarks and state that expires."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from sundew.functions.fields import credential_key
from sundew.operators import campaigns, intel
from sundew.operators.dedup import Rule, suppression
from sundew.operators.filters import is_command, uploads
from sundew.operators.sessions import scored
from sundew.plans.tables import owned_tables
from sundew.streaming.pieces import stateful


def timed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events with ``ts`` and a watermark; rows later than ``delay`` are dropped by stateful operators, and counted in the progress."""
    return events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


#: Events of a key that wait in its value; more wait in a map, by buckets of so many milliseconds.
HELD_EVENTS, BUCKET_MS = 1024, 60_000
#: Events of a key that a task gathers from a batch before they go into its map: every time, each of their buckets is written anew.
GATHERED_EVENTS = 65_536


class InOrder(StatefulProcessor):
    """Events of a key in order of time, whatever order they come in; they are handled when the watermark has passed them.

    A key has one timer, at the earliest time at which it has something to do. When that fires, all that the watermark has
    passed is handled in order. Few waiting events are part of the key's value, which is read and written once for each batch; those of a
    key that has many wait in a map by buckets of time, so that a task never holds more than GATHERED_EVENTS and one bucket of them.

    Subclasses name their part of the value in ``columns`` and have ``arrive``; a value leaves at ``leaves_at``, and ``leave`` may give rows for it.
    """

    columns: str
    row: Callable[..., Row]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"timer long, times array<long>, seqs array<long>, buckets array<long>, known boolean, {self.columns}")
        self.waiting = handle.getMapState("waiting", "bucket long", "times array<long>, seqs array<long>")
        self.nothing = (None,) * len(self.columns.split(", "))

    def opened(self, stored: tuple) -> Any:
        """The value as ``arrive`` takes it, made once when a timer fires."""
        return stored

    def stored(self, value: Any) -> tuple:
        return value

    def arrive(self, key: tuple, ts: int, seqs: list[int], value: Any) -> tuple[list[Row], Any]:
        """Rows and the new value for the events of one time. ``value`` is None where there is none."""
        raise NotImplementedError

    def leaves_at(self, value: Any) -> int | None:
        return None

    def leave(self, key: tuple, value: Any) -> list[Row]:
        return []

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        timer, times, seqs, buckets, *value = self.held.get() or (None, [], [], [], False, *self.nothing)
        times, seqs, buckets, first = list(times), list(seqs), set(buckets), timer
        for row in rows:
            times.append(row.ts_ms)
            seqs.append(row.seq)
            first = row.ts_ms if first is None else min(first, row.ts_ms)
            if len(times) >= GATHERED_EVENTS:
                buckets |= self._put_away(times, seqs)
                times, seqs = [], []
        if len(times) >= HELD_EVENTS:
            buckets |= self._put_away(times, seqs)
            times, seqs = [], []
        self._keep(timer, first, times, seqs, buckets, value)
        return iter(())

    def _put_away(self, times: list[int], seqs: list[int]) -> set[int]:
        found: dict[int, tuple[list[int], list[int]]] = {}
        for ts, seq in zip(times, seqs, strict=True):
            both = found.setdefault(ts // BUCKET_MS, ([], []))
            both[0].append(ts)
            both[1].append(seq)
        for bucket, (some, own) in found.items():
            earlier = self.waiting.getValue((bucket,)) or ([], [])
            self.waiting.updateValue((bucket,), (list(earlier[0]) + some, list(earlier[1]) + own))
        return set(found)

    def _keep(self, timer: int | None, first: int | None, times: list[int], seqs: list[int], buckets: set[int], value: list) -> None:
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        self.held.update((first, times, seqs, sorted(buckets), *value))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held is None:
            return
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        _, times, seqs, buckets, known, *stored = held
        value = self.opened(tuple(stored)) if known else None
        early: dict[int, list[tuple[int, int]]] = {}
        later: list[tuple[int, int]] = []
        for ts, seq in zip(times, seqs, strict=True):
            (early.setdefault(ts // BUCKET_MS, []) if ts <= now else later).append((ts, seq))
        left = set(buckets)
        for bucket in sorted(early.keys() | {b for b in buckets if b <= now // BUCKET_MS}):
            events = early.get(bucket, [])
            if bucket in left:
                put = self.waiting.getValue((bucket,))
                events = events + [e for e in zip(*put, strict=True) if e[0] <= now]
                rest = [e for e in zip(*put, strict=True) if e[0] > now]
                if rest:
                    self.waiting.updateValue((bucket,), tuple(map(list, zip(*rest, strict=True))))
                else:
                    self.waiting.removeKey((bucket,))
                    left.discard(bucket)
            for ts, some in groupby(sorted(events), key=itemgetter(0)):
                value, rows = self._left(key, value, ts)
                yield from rows
                rows, value = self.arrive(key, ts, [seq for _, seq in some], value)
                yield from rows
        value, rows = self._left(key, value, now)
        yield from rows
        ends = [t for t in (value and self.leaves_at(value), *(ts for ts, _ in later), *(max(b * BUCKET_MS, now + 1) for b in left)) if t is not None]
        if value is None and not ends:
            self.held.clear()
            return
        kept = self.nothing if value is None else self.stored(value)
        self.held.update((min(ends, default=None), [ts for ts, _ in later], [seq for _, seq in later], sorted(left), value is not None, *kept))
        if ends:
            self.handle.registerTimer(min(ends))

    def _left(self, key: tuple, value: Any, now: int) -> tuple[Any, list[Row]]:
        end = None if value is None else self.leaves_at(value)
        return (value, []) if end is None or end > now else (None, self.leave(key, value))


def _keyed(events: DataFrame, keys: list[str], processor: InOrder, out: str) -> DataFrame:
    kind = StructType.fromDDL(out)
    processor.row = Row(*kind.names)
    return stateful(events.select(*keys, "seq", "ts_ms", "ts"), keys, processor, kind, "EventTime", ["seq", "ts_ms"])


class Groups(InOrder):
    """Alert groups: one row for each event, and one for each run of events when it has been idle for longer than the window."""

    columns = "last long, n long, first long, events long"

    def __init__(self, window_ms: int, max_group: int):
        self.window_ms, self.max_group = window_ms, max_group

    def arrive(self, key: tuple, ts: int, seqs: list[int], value: tuple | None) -> tuple[list[Row], tuple]:
        _, count, first, events = value or (None, 0, None, 0)
        out = []
        for seq in seqs:
            count, events = count + 1, events + 1
            first = seq if first is None else first
            filled = count > 1 and count >= self.max_group
            if filled:  # this event stands for the next group's first
                out.append(self.row(*key, "event", seq, True, max(self.max_group, 2), seq, ts))
                count, first = 1, seq
            else:
                out.append(self.row(*key, "event", seq, count == 1, count, first, ts))
        return out, (ts, count, first, events)

    def leaves_at(self, value: tuple) -> int:
        return value[0] + self.window_ms + 1

    def leave(self, key: tuple, value: tuple) -> list[Row]:
        return [self.row(*key, "expired", None, None, value[3], value[2], value[0])]


def dedup_groups(events: DataFrame, window_ms: int = 300_000, max_group: int = 100, rules: Sequence[Rule] = ()) -> DataFrame:
    """The batch operator's decisions for events that pass the rules (``kind`` event), and the end of every run of events of a key (expired).

    An expired row has the number of events of the run as ``group_count``, the first of its last group as ``first_seq`` and the time of its last event as ``at_ms``.
    """
    passed = events.withColumn("key", credential_key(F.col("credential"))).where(suppression(rules, F.col("ts_ms")).isNull())
    out = "source_ip string, service string, key string, kind string, seq long, is_alert boolean, group_count long, first_seq long, at_ms long"
    return _keyed(passed, ["source_ip", "service", "key"], Groups(window_ms, max_group), out)


def dedup(events: DataFrame, window_ms: int = 300_000, max_group: int = 100, rules: Sequence[Rule] = ()) -> DataFrame:
    """``seq, is_alert, group_count, first_seq`` of every event that passes the rules; keys that are idle for longer than the window leave the state."""
    return dedup_groups(events, window_ms, max_group, rules).where("kind = 'event'").select("seq", "is_alert", "group_count", "first_seq")


class Hits(InOrder):
    """Events of a key in the window that ends with each. The value holds how many each millisecond of the last window had."""

    columns = "at array<long>, n array<long>"

    def __init__(self, window_ms: int, threshold: int):
        self.window_ms, self.threshold = window_ms, threshold

    def opened(self, stored: tuple) -> tuple[deque, int]:
        return deque(zip(*stored, strict=True)), sum(stored[1])

    def stored(self, value: tuple[deque, int]) -> tuple:
        return tuple(map(list, zip(*value[0], strict=True)))

    def arrive(self, key: tuple, ts: int, seqs: list[int], value: tuple[deque, int] | None) -> tuple[list[Row], tuple]:
        inside, n = value or (deque(), 0)
        while inside and inside[0][0] < ts - self.window_ms:
            n -= inside.popleft()[1]
        inside.append((ts, len(seqs)))
        return [self.row(seq, n + i, n + i > self.threshold) for i, seq in enumerate(seqs, 1)], (inside, n + len(seqs))

    def leaves_at(self, value: tuple[deque, int]) -> int:
        return value[0][-1][0] + self.window_ms + 1


def rate_limit(events: DataFrame, threshold: int, window_ms: int) -> DataFrame:
    """``seq, hits, triggered`` by address; addresses that are idle for longer than the window leave the state."""
    return _keyed(events, ["source_ip"], Hits(window_ms, threshold), "seq long, hits long, triggered boolean")


class Numbers(InOrder):
    """The running number of a key's events and the time of the first; a key leaves when none has come for ``idle_ms``, or never."""

    columns = "n long, first long, last long"

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def arrive(self, key: tuple, ts: int, seqs: list[int], value: tuple | None) -> tuple[list[Row], tuple]:
        n, first, _ = value or (0, ts, ts)
        return [self.row(key[0], seq, n + i, first) for i, seq in enumerate(seqs, 1)], (n + len(seqs), first, ts)

    def leaves_at(self, value: tuple) -> int | None:
        return None if self.idle_ms is None else value[2] + self.idle_ms + 1


def running_count(events: DataFrame, key: str, window_ms: int | None = None) -> DataFrame:
    """``key, seq, n, first_ms``: the running number of a key's rows; it starts anew in each tumbling window if one is given.

    Serves network bursts (number over the threshold) and canary tokens (first trigger and count). Windows leave the state after they
    have passed; without a window a key stays.
    """
    bucket = F.lit(0).cast("long") if window_ms is None else F.floor(F.col("ts_ms") / window_ms)
    rows = events.withColumns({"__key": F.col(key).cast("string"), "__bucket": bucket})
    return _keyed(rows, ["__key", "__bucket"], Numbers(window_ms), "key string, seq long, n long, first_ms long")


def sessions(events: DataFrame, gap_ms: int = 300_000) -> DataFrame:
    """Sessions with phase and score when they close. Session windows join at a gap equal to the timeout, as the batch operator does."""
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    grouped = events.groupBy("source_ip", F.session_window("ts", f"{gap_ms} milliseconds").alias("w")).agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count(F.lit(1)).alias("events"),
        F.array_sort(F.collect_set(text("username"))).alias("usernames"), F.array_sort(F.collect_set(text("password"))).alias("passwords"),
        F.array_sort(F.collect_set(F.lower(text("service")))).alias("services"), F.count_if("success").alias("auths_ok"),
    )
    return scored(grouped.drop("w"))


def brute_force(events: DataFrame, least: int = 10, window: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Failed logins by address and service in tumbling (or, with ``slide``, sliding) windows."""
    failed = events.where(F.col("service").isin("ssh", "ftp", "api") & ~F.col("success"))
    grouped = failed.groupBy("source_ip", "service", F.window("ts", window, slide).alias("w") if slide else F.window("ts", window).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("attempts")).where(F.col("attempts") >= least).select("source_ip", "service", F.unix_millis("w.start").alias("window_ms"), "attempts")


def lateral_behaviour(events: DataFrame, services: int = 3, ports: int = 5, window: str = "10 minutes") -> DataFrame:
    """Many services or ports of an address in a window; both have few values, so sets are exact and small."""
    grouped = events.groupBy("source_ip", F.window("ts", window).alias("w")).agg(F.size(F.collect_set("service")).alias("services"), F.size(F.collect_set("dest_port")).alias("ports"))
    wide, deep = F.col("services") >= services, F.col("ports") >= ports
    return grouped.where(wide | deep).select("source_ip", F.unix_millis("w.start").alias("window_ms"), "services", "ports", F.when(wide & deep, "Critical").otherwise("High").alias("severity"))


def escalations(events: DataFrame, minutes: int = 15) -> DataFrame:
    """``seq, source_ip, ts_ms`` of commands with an upload of the same address within ``minutes``, before or after: a join of two streams.

    Uploads are summed up to the first and the last of an address and minute before they are joined, so that a command meets no more than one row for each
    minute, however many uploads there are. Both sides have a watermark and a bound of time, beyond which rows leave the state.
    """
    up = events.where(uploads(events)).groupBy(F.col("source_ip").alias("up_ip"), F.window("ts", "1 minute").alias("w")).agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    up = up.select("up_ip", F.window_time("w").alias("up_ts"), "first_ms", "last_ms")
    done = events.where(is_command()).select("seq", "source_ip", "ts_ms", "ts")
    span, near = F.expr(f"interval {minutes + 1} minutes"), minutes * 60_000
    within = F.col("up_ts").between(F.col("ts") - span, F.col("ts") + span) & (F.col("last_ms") >= F.col("ts_ms") - near) & (F.col("first_ms") <= F.col("ts_ms") + near)
    return done.join(up, (F.col("source_ip") == F.col("up_ip")) & within, "left_semi").select("seq", "source_ip", "ts_ms")


def high_volume(events: DataFrame, service: str = "ssh", most: int = 50, window: str = "5 minutes") -> DataFrame:
    """Addresses with more than ``most`` events of the service in a tumbling window."""
    grouped = events.where(F.col("service") == service).groupBy("source_ip", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.where(F.col("events") > most).select("source_ip", F.unix_millis("w.start").alias("window_ms"), "events")


def without_repeats(events: DataFrame, by: list[str], delay: str = "30 minutes") -> DataFrame:
    """The first of equal ``by`` within the watermark's delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(by)


class Quiet(InOrder):
    """Events before which none came for ``window_ms``."""

    columns = "last long"

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def arrive(self, key: tuple, ts: int, seqs: list[int], value: tuple | None) -> tuple[list[Row], tuple]:
        return [self.row(seqs[0])] if value is None else [], (ts,)

    def leaves_at(self, value: tuple) -> int:
        return value[0] + self.window_ms + 1


def quiet_repeats(events: DataFrame, by: list[str], window_ms: int = 1_800_000) -> DataFrame:
    """``seq`` of events whose ``by`` did not come within ``window_ms`` before; the state is the last time of each."""
    return _keyed(events, by, Quiet(window_ms), "seq long")


def intel_batches(read_feed: Callable[[], DataFrame], path: str, ttl_ms: int, now_ms: Callable[[], int] = lambda: int(time.time() * 1000)) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: events with their intelligence, as a table by batch.

    The feed is read anew for every batch, and rows older than ``ttl_ms`` are left out. A batch that runs again replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            with owned_tables():
                intel.enrich(kept, intel.fresh(read_feed(), now_ms(), ttl_ms)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            kept.unpersist()

    return run


def profile_batches(path: str, seconds: int = 3600, delay_ms: int = 600_000) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the profile of every campaign window, once, when no event of it can come any more.

    Events are kept by campaign in a table beside ``path``, written anew if a batch runs again. A window is closed when an event later than its end and
    ``delay_ms`` has come. The tables that earlier batches left in ``path`` are the ledger: their windows are done, and a batch that runs again
    replaces its own. Only the partitions of windows that close are read. Later events of a window that is done are kept and count nowhere.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = campaigns.tumbling(batch.select("seq", "ts_ms", "source_ip", "service", "username", "password", "user_agent"), seconds)
        rows.withColumn("part", F.lit(number)).write.mode("overwrite").partitionBy("campaign").parquet(f"{path}-events/batch={number}")
        rows.agg(F.max("ts_ms").alias("newest"), F.array_sort(F.collect_set("campaign")).alias("campaigns")).write.mode("overwrite").parquet(f"{path}-seen/batch={number}")
        seen = spark.read.parquet(f"{path}-seen").where(F.col("batch") <= number)
        newest = seen.agg(F.max("newest")).first()[0]
        windows = {r[0] for r in seen.select(F.explode("campaigns")).distinct().collect()}
        done = {r.campaign for r in spark.read.schema("campaign long, batch int").parquet(path).where(F.col("batch") < number).collect()} if number > 0 and _exists(spark, path) else set()
        closed = sorted(w for w in windows - done if w + seconds * 1000 + delay_ms <= newest) if newest is not None else []
        if not closed and number >= 0:
            return
        kinds = "seq long, ts_ms long, source_ip string, service string, username string, password string, user_agent string, batch int, campaign long"
        events = spark.read.schema(kinds).parquet(f"{path}-events").where(F.col("campaign").isin(closed) & (F.col("batch") <= number)).drop("batch") if closed else rows
        with owned_tables():
            campaigns.profiles(events, campaigns.campaign_checks(events)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.schema("campaign long").parquet(path).inputFiles())
    except AnalysisException:
        return False


def enriched(events: DataFrame, places: DataFrame) -> DataFrame:
    """A stream with the columns of a table by ``source_ip``; the table is read anew in every micro-batch."""
    return events.join(places, "source_ip", "left")


def late_rows(query) -> int:
    """Rows that the watermark has dropped in the query so far."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
