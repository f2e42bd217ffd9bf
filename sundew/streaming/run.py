"""Run a stream over a folder to its end."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew.plans.tables import materialize, shared_folder


def replayed_batches(spark: SparkSession, events: DataFrame, sink: Callable[[str], Callable[[DataFrame, int], None]], runs: int = 3, closing_ms: int | None = None) -> DataFrame:
    """``events`` in ``runs`` parts in order of time through the ``foreachBatch`` function that ``sink`` makes for a folder; the tables it writes there."""
    table = materialize(events, "stream-input")
    out = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    for part in _parts(table, runs) + ([_closing(table, closing_ms)] if closing_ms is not None else []):
        part.write.mode("append").parquet(f"{out}/events")
        stream = spark.readStream.schema(table.schema).parquet(f"{out}/events")
        stream.writeStream.foreachBatch(sink(f"{out}/rows")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    if table.isEmpty():  # no batch has run
        sink(f"{out}/rows")(table, -1)
    return spark.read.parquet(f"{out}/rows").drop("batch")


def _parts(table: DataFrame, runs: int) -> list[DataFrame]:
    if runs == 1:
        return [table]
    bounds = table.approxQuantile("ts_ms", [i / runs for i in range(1, runs)], 0.01) or [0.0] * (runs - 1)
    part = sum((F.when(F.col("ts_ms") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    return [table.where(part == run) for run in range(runs)]


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State on disk, which timers and maps by key need, for streams that are started inside."""
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _closing(events: DataFrame, closing_ms: int, **values: str) -> DataFrame:
    """One event far ahead, whose watermark closes what is open. Filters are applied before watermarks, so it has to pass them: ``values`` are its columns."""
    last = {"seq": F.lit(-1).cast("long"), "source_ip": F.lit("closing"), "ts_ms": F.lit(closing_ms).cast("long"), "service": F.lit("ssh"), "success": F.lit(False)} | {k: F.lit(v) for k, v in values.items()}
    return events.orderBy("seq").limit(1).withColumns({k: v for k, v in last.items() if k in events.columns})


def replayed(spark: SparkSession, events: DataFrame, transform: Callable[[DataFrame], DataFrame], closing_ms: int | None = None, runs: int = 3, **closing: str) -> DataFrame:
    """``events`` as a stream through ``transform``, in append mode, read to the end; the result as a table.

    The events arrive in ``runs`` parts in order of time, in any order inside one; after each part the stream ends, and the next run goes on
    from its checkpoint. ``closing_ms`` adds a run with one event far ahead, with the columns ``closing``, whose watermark closes what is open.
    """
    table = materialize(events, "stream-input")
    out = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    with keyed_state(spark):
        for part in _parts(table, runs) + ([_closing(table, closing_ms, **closing)] if closing_ms is not None else []):
            part.write.mode("append").parquet(f"{out}/events")
            result = transform(spark.readStream.schema(table.schema).parquet(f"{out}/events"))
            query = result.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/rows")


def replayed_by_clock(spark: SparkSession, rows: DataFrame, transform: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool], seconds: int = 300) -> DataFrame:
    """``rows`` as a stream through ``transform``, whose timers run on the clock, until ``done`` holds for the result; the result as a table.

    The stream is stopped when its first rows are there, and another one goes on from its checkpoint. It is an error if ``seconds``, and one more
    for every 10,000 rows, pass before the end.
    """
    table = materialize(rows, "clock-input")
    out = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    table.write.parquet(f"{out}/events")
    seconds += table.count() // 10_000
    end = time.monotonic() + seconds
    for enough in (lambda found: not found.isEmpty(), done):
        with keyed_state(spark):
            result = transform(spark.readStream.schema(table.schema).parquet(f"{out}/events"))
            query = result.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(processingTime="0 seconds").start()
        try:
            while not enough(_written(spark, f"{out}/rows", result)) and not table.isEmpty():
                if query.awaitTermination(1):
                    break  # only an error ends it, and is raised
                if time.monotonic() > end:
                    raise TimeoutError(f"the stream isn't done after {seconds} seconds")
        finally:
            query.stop()
    return _written(spark, f"{out}/rows", result)


def _written(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)
