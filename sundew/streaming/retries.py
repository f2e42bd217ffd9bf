"""The queue of failed deliveries as keyed state, retried by the clock."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from sundew.streaming.pieces import stateful

#: Sends a value again; gets the number of attempts that have failed, and raises when this one fails as well.
Resend = Callable[[str, int], None]
OUT = "target string, event string, reason string, seq long, attempt int, queue_depth int, error string"
RETRY, DROPPED, DELIVERED = "siem_delivery_retry", "siem_delivery_dropped", "delivered"


class Queue(StatefulProcessor):
    """A target's queue of at most ``most`` rows: one is retried at each tick of the clock, a failure goes to the end, and the oldest falls out when it is full.

    Rows are a map by place with the places of both ends as the value, so a tick reads and writes one of them, and a task holds ``most`` new rows at the most.
    """

    row = Row(*(c.split()[0] for c in OUT.split(", ")))

    def __init__(self, resend: Resend, most: int, tick_ms: int):
        self.resend, self.most, self.tick_ms = resend, most, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "head long, tail long, timer long")
        self.items = handle.getMapState("items", "place long", "seq long, value string, attempts int, error string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        head, tail, timer = self.ends.get() or (0, 0, None)
        newest: list[tuple] = []
        for n, r in enumerate(rows, tail - head + 1):
            # the number keeps equal rows apart, and what can't be compared from being compared
            item = ((r.enqueued_ms is not None, r.enqueued_ms or 0, r.seq is not None, r.seq or 0, n), r.seq, r.value, r.error)
            yield self.row(*key, RETRY, "initial_failure", r.seq, 1, min(n, self.most), r.error)
            out = heapq.heappushpop(newest, item) if len(newest) == self.most else heapq.heappush(newest, item)
            if out:
                yield self.row(*key, DROPPED, "queue_full", out[1], 1, self.most, out[3])
        for _, seq, value, error in sorted(newest):
            if tail - head == self.most:
                yield self._dropped(key, head)
                head += 1
            self.items.updateValue((tail,), (seq, value, 1, error))
            tail += 1
        if timer is None and tail > head:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.tick_ms
            self.handle.registerTimer(timer)
        self.ends.update((head, tail, timer))

    def _dropped(self, key: tuple, place: int) -> Row:
        seq, _, attempts, error = self.items.getValue((place,))
        self.items.removeKey((place,))
        return self.row(*key, DROPPED, "queue_full", seq, attempts, self.most, error)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        head, tail, timer = self.ends.get() or (0, 0, None)
        due = expiredTimerInfo.getExpiryTimeInMs()
        if timer != due:
            return
        now = max(timerValues.getCurrentProcessingTimeInMs(), due)
        # a batch that comes late makes up for its ticks, but takes no row twice
        for _ in range(min(1 + (now - due) // self.tick_ms, tail - head)):
            seq, value, attempts, _ = self.items.getValue((head,))
            self.items.removeKey((head,))
            head += 1
            try:
                self.resend(value, attempts)
                yield self.row(*key, DELIVERED, None, seq, attempts + 1, tail - head, None)
            except Exception as e:  # a sender may raise anything
                error = f"{type(e).__name__}: {e}"
                self.items.updateValue((tail,), (seq, value, attempts + 1, error))
                tail += 1
                yield self.row(*key, RETRY, "retry_failure", seq, attempts + 1, tail - head, error)
        if tail > head:
            self.handle.registerTimer(now + self.tick_ms)
            self.ends.update((head, tail, now + self.tick_ms))
        else:
            self.ends.clear()


def retried(failures: DataFrame, resend: Resend, most: int = 1000, tick_ms: int = 5000) -> DataFrame:
    """What becomes of a stream of failed rows ``target, seq, value, enqueued_ms, error``: a row for each failure, retry, drop and delivery.

    Each target has a queue of its own. New rows go to its end in order of ``enqueued_ms`` and ``seq`` inside a micro-batch, nulls first, and the oldest fall out beyond
    ``most``. Timers run on the clock and go on from the checkpoint. A batch that runs again sends its rows again (at least once). ``attempt`` counts the first delivery.
    """
    if most < 1 or tick_ms < 1:
        raise ValueError("most and tick_ms must be 1 or more")
    rows = failures.select("target", "seq", "value", "enqueued_ms", "error")
    return stateful(rows, ["target"], Queue(resend, most, tick_ms), StructType.fromDDL(OUT), "ProcessingTime", ["seq", "enqueued_ms"])
