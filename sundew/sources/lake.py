"""Events as a lake of Parquet by UTC date: late rows replace their dates only, and readers open no other dates than they ask for."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from sundew.operators import filters
from sundew.plans.tables import materialize, release

DAY_MS = 86_400_000


def utc_date(ms: Column) -> Column:
    """The UTC date of a time in ms, whatever the session's time zone is; null for null."""
    return F.date_add(F.lit(date(1970, 1, 1)), F.floor(ms / DAY_MS).cast("int"))


def day(ms: int) -> date:
    return date(1970, 1, 1) + timedelta(days=ms // DAY_MS)


def write_dates(events: DataFrame, path: str) -> None:
    """Write each date that ``events`` has in place of what the lake has of it; other dates stay. Events without a time have a date of their own, null.

    Rows are rebalanced by date, so that a small date is one file and a large one is split by size instead of filling one task. No events
    change nothing. A column ``date`` of the events is replaced.
    """
    rows = events.withColumn("date", utc_date(F.col("ts_ms"))).hint("rebalance", "date")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read(spark: SparkSession, path: str, schema: StructType, start_ms: int | None = None, end_ms: int | None = None, untimed: bool = True) -> DataFrame:
    """The lake's rows with ``date``; only dates between the two times are opened, both ends inside, and with ``untimed`` those without a time."""
    rows = spark.read.schema(_with_date(schema)).parquet(path)
    dates = F.lit(True)
    if start_ms is not None:
        dates = dates & (F.col("date") >= F.lit(day(start_ms)))
    if end_ms is not None:
        dates = dates & (F.col("date") <= F.lit(day(end_ms)))
    rows = rows.where(F.col("date").isNull() | dates if untimed else F.col("date").isNotNull() & dates)
    return filters.in_time(rows, start_ms, end_ms)


def _with_date(schema: StructType) -> StructType:
    return StructType([f for f in schema.fields if f.name != "date"]).add("date", DateType())


def merge(late: DataFrame, path: str, key: str = "seq") -> int:
    """Bring rows that come late into their dates; gives the number of dates that were written. The lake need not be there yet.

    A row replaces the one with its ``key`` on its date, so a batch that runs again changes nothing. Rows of ``late`` with one key and
    date are one row, the greatest by its columns in their order. Rows without a key come to those of their date each time. Only dates of ``late``
    are read and written; the merged ones are first written beside the lake, since Spark reads lazily what it would replace. No rows change nothing.
    """
    spark = late.sparkSession
    dated = late.drop("date").withColumn("date", utc_date(F.col("ts_ms")))
    known = dated.where(F.col(key).isNotNull())
    one = known.groupBy(F.col(key).alias("__key"), F.col("date").alias("__date")).agg(F.max(F.struct(*dated.columns)).alias("r")).select("r.*")
    new = materialize(one.unionByName(dated.where(F.col(key).isNull())), "lake-late")
    dates = [r.date for r in new.select("date").distinct().collect()]  # a row for each day
    if dates:
        same = F.col("date").isin([d for d in dates if d is not None])
        try:
            old = spark.read.schema(new.schema).parquet(path).where(same | F.col("date").isNull() if None in dates else same)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            old = new.limit(0)
        replaced = new.select(F.col(key).alias("__key"), F.col("date").alias("__date"))
        kept = old.join(replaced, (F.col(key) == F.col("__key")) & F.col("date").eqNullSafe(F.col("__date")), "left_anti")
        merged = materialize(kept.unionByName(new), "lake-merged")
        write_dates(merged, path)
        release(merged)
    release(new)
    return len(dates)


def retained(spark: SparkSession, path: str, schema: StructType, now_ms: int, days: int = 90) -> DataFrame:
    """The rows of the last ``days``; dates before are not opened, nor rows without a time."""
    return filters.retained(read(spark, path, schema, now_ms - days * DAY_MS, untimed=False), now_ms, days)


def expire(spark: SparkSession, path: str, schema: StructType, now_ms: int, days: int = 90) -> list[date]:
    """Delete dates that have passed as a whole, and earlier rows of the date on which the limit falls; gives the dates deleted.

    Rows without a time never pass. May run again after it was cut off.
    """
    limit = now_ms - days * DAY_MS
    edge = materialize(read(spark, path, schema).where((F.col("date") == F.lit(day(limit))) & (F.col("ts_ms") >= limit)), "lake-edge")
    lake = spark.read.schema(_with_date(schema)).parquet(path).where(F.col("date") <= F.lit(day(limit)))
    had = sorted(r.date for r in lake.select("date").distinct().collect())
    kept = day(limit) in had and not edge.isEmpty()
    if kept:
        write_dates(edge, path)
    gone = [d for d in had if d < day(limit) or not kept]
    jvm = spark.sparkContext._jvm
    for d in gone:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/date={d.isoformat()}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    release(edge)
    return gone
