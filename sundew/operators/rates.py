"""Rates: sliding limits, gaps, and the first window with enough events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Windows of time that a bucket is wide.
WIDE = 4


def haloed(events: DataFrame, window_ms: int) -> DataFrame:
    """Events in buckets of time, so that a hot key is many partitions of ``key, __bucket``: each with the events of WIDE windows, and, as a halo, of the one before.

    What an event needs of the last ``window_ms`` is in its own bucket. Rows with ``__own`` are the events, the others are copies: one in WIDE.
    """
    width = max(window_ms * WIDE, 1)
    bucket = F.floor(F.col("ts_ms") / width)
    place = lambda b, own: F.struct(b.alias("bucket"), F.lit(own).alias("own"))
    near = F.col("ts_ms") >= (bucket + 1) * width - window_ms
    places = F.when(near, F.array(place(bucket, True), place(bucket + 1, False))).otherwise(F.array(place(bucket, True)))
    spread = events.withColumn("__place", F.explode(places))
    return spread.select(*events.columns, F.col("__place.bucket").alias("__bucket"), F.col("__place.own").alias("__own"))


#: Gaps of time that a cell of ``islands`` is wide.
CELL_GAPS = 64


def islands(events: DataFrame, by: list[str], gap_ms: int, width_ms: int | None = None) -> DataFrame:
    """Add ``__island`` (from 0 in each key) and ``__p`` (from 1 in each island): a new one begins after a gap over ``gap_ms``.

    Events are ordered inside cells of a key and time; over a whole key only a row for each of its cells is, so that a hot key is many
    partitions. Cells are ``width_ms`` wide, or CELL_GAPS gaps. Events without a time come last and stay in the last island. Null keys are a key.
    """
    # equal structs may have nulls in them, so this is one key for the window, the sums and the join
    cell = F.struct(*by, F.floor(F.col("ts_ms") / (width_ms or max(gap_ms, 1) * CELL_GAPS)).alias("__cell")).alias("__k")
    order = Window.partitionBy("__k").orderBy(F.col("ts_ms").asc_nulls_last(), "seq")
    placed = events.select("*", cell).withColumns({"__at": F.row_number().over(order), "__new": F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(order) > gap_ms, F.lit(False))})
    placed = placed.withColumns({"__starts": F.count_if("__new").over(order), "__from": F.max(F.when(F.col("__new"), F.col("__at"))).over(order)})
    cells = placed.groupBy("__k").agg(
        F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.count(F.lit(1)).alias("n"), F.max("__starts").alias("starts"), F.max("__from").alias("from")
    )
    line = Window.partitionBy(*(F.col(f"__k.{c}") for c in by)).orderBy(F.col("__k.__cell").asc_nulls_last())
    earlier, upto = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("first") - F.lag("last").over(line) > gap_ms, F.lit(False))
    cells = cells.withColumns({"opens": opens, "before": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    # places count over the whole key: where the island begins that the cell goes on with, and the one that it ends with
    begun = F.when(F.col("opens"), F.col("before") + 1)
    cells = cells.withColumns({"begun": begun, "left": F.coalesce(F.col("before") + F.col("from"), begun)})
    cells = cells.select(
        "__k", F.col("before").alias("__before"), F.coalesce("begun", F.max("left").over(earlier), F.lit(1)).alias("__begun"),
        (F.count_if("opens").over(upto) + F.coalesce(F.sum("starts").over(earlier), F.lit(0))).alias("__number"),
    )
    place = F.col("__before") + F.col("__at") - F.coalesce(F.col("__before") + F.col("__from"), F.col("__begun")) + 1
    return placed.join(cells, "__k").select(*events.columns, (F.col("__number") + F.col("__starts")).alias("__island"), place.alias("__p"))


def pieces(events: DataFrame, by: list[str], size: int, width_ms: int = 3_600_000) -> DataFrame:
    """Add ``piece`` (from 0): runs of ``size`` events of a key in order of time, none of them gathered to be counted."""
    counted = islands(events, by, (1 << 63) - 1, width_ms)  # no gap is longer
    return counted.withColumn("piece", F.floor((F.col("__p") - 1) / size)).drop("__p", "__island")


def rate_limit(events: DataFrame, threshold: int, window_ms: int) -> DataFrame:
    """Add ``hits`` (of the address in the closed window up to the event, later ties not yet seen) and ``triggered``."""
    reach = Window.partitionBy("source_ip", "__bucket").orderBy("ts_ms").rangeBetween(-window_ms, 0)
    ties = Window.partitionBy("source_ip", "__bucket", "ts_ms")
    later = F.count(F.lit(1)).over(ties) - F.row_number().over(ties.orderBy("seq"))
    hits = F.count(F.lit(1)).over(reach) - later
    counted = haloed(events, window_ms).withColumn("hits", hits).where("__own").drop("__own", "__bucket")
    return counted.withColumn("triggered", F.col("hits") > threshold)


def over_limit(events: DataFrame, threshold: int, window_ms: int) -> DataFrame:
    """Only ``triggered``, by looking ``threshold`` events back: one sort and no frame."""
    order = Window.partitionBy("source_ip", "__bucket").orderBy("ts_ms", "seq")
    triggered = F.coalesce(F.col("ts_ms") - F.lag("ts_ms", threshold).over(order) <= window_ms, F.lit(False))
    return haloed(events, window_ms).withColumn("triggered", triggered).where("__own").drop("__own", "__bucket")


def gaps(events: DataFrame) -> DataFrame:
    """Add ``gap_ms`` to the address's event before."""
    return events.withColumn("gap_ms", F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("source_ip").orderBy("ts_ms", "seq")))


def first_burst(events: DataFrame, least: int, window_ms: int, by: str = "source_ip") -> DataFrame:
    """For each ``by`` the first event that closes a window of ``window_ms`` with ``least`` events: ``start_ms, end_ms, end_seq``."""
    order = Window.partitionBy(by, "__bucket").orderBy("ts_ms", "seq")
    marked = haloed(events, window_ms).withColumn("start_ms", F.lag("ts_ms", least - 1).over(order) if least > 1 else F.col("ts_ms"))
    hits = marked.where(F.col("__own") & (F.col("ts_ms") - F.col("start_ms") <= window_ms))
    return hits.groupBy(by).agg(F.min(F.struct("ts_ms", "seq", "start_ms")).alias("f")).select(by, "f.start_ms", F.col("f.ts_ms").alias("end_ms"), F.col("f.seq").alias("end_seq"))


#: Part of the number looked for at which a sketch lets a window go on: six standard errors of 1.6% below it.
SKETCH_SLACK = 0.9


def reachable(events: DataFrame, by: list[str], value: str, window_ms: int, least: int) -> DataFrame:
    """The events of ``by`` that may be in a window with ``least`` different ``value``, by sketches of each key and cell of time; the exact count needs no others.

    A window lies in two neighbouring cells of its width. Their HyperLogLog sketches are merged, and both cells go on where the estimate is at least SKETCH_SLACK of
    ``least``. Estimates of few values are exact but for collisions of 26-bit hashes, and up to ten that leaves one to spare. Counts of
    ``least`` or more in what is left are those in all events. Null values are left out, null keys are a key.
    """
    width = max(window_ms, 1)
    known = events.where(F.col(value).isNotNull())
    key = lambda cell: F.struct(*by, cell.alias("cell"))
    cells = known.groupBy(key(F.floor(F.col("ts_ms") / width)).alias("k")).agg(F.hll_sketch_agg(value).alias("sketch"))
    names = [F.col(f"k.{c}").alias(c) for c in by]
    # a pair of cells is named after the later one
    pairs = cells.select(*names, "sketch", F.explode(F.array(F.col("k.cell"), F.col("k.cell") + 1)).alias("pair"))
    pairs = pairs.groupBy(key(F.col("pair")).alias("k")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).where(F.col("n") >= int(least * SKETCH_SLACK))
    kept = pairs.select(*names, F.explode(F.array(F.col("k.cell") - 1, F.col("k.cell"))).alias("cell")).select(F.struct(*by, "cell").alias("__k")).distinct()
    return known.withColumn("__k", key(F.floor(F.col("ts_ms") / width))).join(kept, "__k", "left_semi").drop("__k")


def distinct_in_window(events: DataFrame, by: list[str], value: str, window_ms: int) -> DataFrame:
    """Events at which the number of different ``value`` within the closed window rises, with that number as ``n``.

    A value is present from an event until ``window_ms`` after it; touching times join. Counting the starts and
    ends of those times gives the number without a set for each event. It is counted anew in every bucket, whose halo has all values that are
    present when it begins. Null values are skipped.
    """
    seen = haloed(events.where(F.col(value).isNotNull()).select(*by, value, "ts_ms", "seq"), window_ms)
    own = Window.partitionBy(*by, "__bucket", value).orderBy("ts_ms", "seq")
    ends = seen.withColumns({"__back": F.col("ts_ms") - F.lag("ts_ms").over(own), "__on": F.lead("ts_ms").over(own) - F.col("ts_ms")})
    far = lambda c: F.col(c).isNull() | (F.col(c) > window_ms)
    # an end counts after every event of its time
    marks = F.array(
        F.when(far("__back"), F.struct("ts_ms", "seq", F.lit(1).alias("step"), "__own")),
        F.when(far("__on"), F.struct((F.col("ts_ms") + window_ms).alias("ts_ms"), F.lit((1 << 63) - 1).alias("seq"), F.lit(-1).alias("step"), F.lit(False).alias("__own"))),
    )
    steps = ends.select(*by, "__bucket", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("m")).select(*by, "__bucket", "m.*")
    upto = Window.partitionBy(*by, "__bucket").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("n", F.sum("step").over(upto)).where("step > 0 and __own").drop("step", "__own", "__bucket")
