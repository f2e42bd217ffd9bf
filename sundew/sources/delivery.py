"""Deliveries: fan-out of micro-batches, bounded retries, and the queue of failed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sundew.operators.rates import pieces

Sender = Callable[[list[str]], None]
STATUS = "seq long, target string, status string, attempts int, error string"


def deliver(rows: DataFrame, senders: dict[str, Sender], retries: int = 0) -> DataFrame:
    """Send ``seq, value`` rows to every target, each Arrow batch by itself; a failing target stops no other.

    One status row for each row and target: ``delivered`` or ``dropped`` after ``retries`` more attempts (0 to 10).
    """
    if not 0 <= retries <= 10:
        raise ValueError("retries must be between 0 and 10")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column("seq"), batch.column("value").to_pylist()
            for target, send in senders.items():
                error, attempt = None, 0
                for attempt in range(1, retries + 2):
                    try:
                        send(values)
                        error = None
                        break
                    except Exception as e:  # a sender may raise anything
                        error = f"{type(e).__name__}: {e}"
                n = batch.num_rows
                columns = [ids, pa.array([target] * n), pa.array(["dropped" if error else "delivered"] * n), pa.array([attempt] * n, pa.int32()), pa.array([error] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["seq", "target", "status", "attempts", "error"])

    return rows.select("seq", "value").mapInArrow(run, STATUS)


def fan_out(lake: str, status: str, render: Callable[[DataFrame], DataFrame], senders: dict[str, Sender], retries: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: first the lake, then the targets; statuses are kept as a table by batch."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            kept.write.mode("overwrite").json(f"{lake}/batch={number}")
            deliver(render(kept), senders, retries).write.mode("overwrite").parquet(f"{status}/batch={number}")
        finally:
            kept.unpersist()

    return run


class Undelivered(Exception):
    """Some rows of a batch have not reached all targets."""


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of ``delivered_once``: a status row for each row, target, ``batch`` and ``attempt``; empty before the first batch."""
    schema = f"{STATUS}, batch long, attempt int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def delivered_once(ledger: str, render: Callable[[DataFrame], DataFrame], senders: dict[str, Sender], retries: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a row goes to every target, and a batch that runs again sends only what its ledger doesn't have as delivered.

    A batch that leaves a row undelivered raises ``Undelivered`` once all its statuses are written, so the stream ends and a restart takes it up again; a
    target that had its rows gets none of them twice. A crash between sending and writing the ledger sends the rows of that attempt again (at least once).
    Rows are told apart by ``seq`` inside a batch; null ones can't be and are sent at every attempt.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = render(batch).select("seq", "value").persist()
        try:
            before = ledger_rows(spark, ledger).where(F.col("batch") == number)
            attempt = (before.agg(F.max("attempt")).first()[0] + 1) if not before.isEmpty() else 0
            todo = None
            for target, send in senders.items():
                had = before.where((F.col("target") == target) & (F.col("status") == "delivered")).select("seq")
                sent = deliver(kept.join(had, "seq", "left_anti") if attempt else kept, {target: send}, retries)
                todo = sent if todo is None else todo.unionByName(sent)
            path = f"{ledger}/batch={number}/attempt={attempt}"
            todo.write.mode("overwrite").parquet(path)
            missed = spark.read.schema(STATUS).parquet(path).where("status <> 'delivered'").count()
        finally:
            kept.unpersist()
        if missed:
            raise Undelivered(f"batch {number}: {missed} rows are undelivered after attempt {attempt}")

    return run


def retry_queue(queue: DataFrame, failed: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The queue with new failures (attempts one more) and what falls out: the newest ``most`` rows stay, by ``enqueued_ms``.

    A cut to the newest is a top-k, taken in each task first.
    """
    both = queue.unionByName(failed.withColumn("attempts", F.col("attempts") + 1))
    kept = both.orderBy(F.desc("enqueued_ms"), F.desc("seq")).limit(most)
    dropped = both.join(kept.select("seq", "enqueued_ms"), ["seq", "enqueued_ms"], "left_anti").withColumn("event", F.lit("siem_delivery_dropped"))
    return kept.withColumn("event", F.lit("siem_delivery_retry")), dropped


def write_sessions(documents: DataFrame, path: str) -> None:
    """Append the documents of ended sessions, a line each, below the UTC date on which they started."""
    started = F.get_json_object("value", "$.started_ms").cast("long")
    documents.select("value", F.to_date(F.timestamp_millis(started)).alias("date")).write.mode("append").partitionBy("date").text(path)


def session_documents(events: DataFrame, session: str = "session_id", piece_events: int | None = None) -> DataFrame:
    """One JSON document per session with its ordered events, numbered from 1.

    With ``piece_events`` a document has so many at most, and a session one for each ``piece``: events are numbered in their piece, and
    ``started_ms`` and ``ended_ms`` are the piece's.
    """
    if piece_events is not None:
        return _documents(pieces(events, [session], piece_events), [session, "piece"])
    return _documents(events, [session])


def _documents(events: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("ts_ms", "seq")
    numbered = events.withColumn("n", F.row_number().over(order))
    line = F.struct("n", "ts_ms", "kind", "data")
    own = [F.first(by[0]).alias("session_id"), *(F.first(c).alias(c) for c in by[1:])]
    return numbered.groupBy(*by).agg(F.to_json(F.struct(*own, F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("ended_ms"), F.array_sort(F.collect_list(line)).alias("events"))).alias("value"))
