"""JSON lines, read leniently, in batch and as a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

_NUMBERS = {"seq": LongType(), "source_port": IntegerType()}
EVENT = StructType(
    [StructField(n, _NUMBERS.get(n, StringType())) for n in ("seq", "timestamp", "service", "source_ip", "source_port", "username", "credential", "path", "method", "user_agent", "event_type")]
)
_BAD = "__bad"


def _parsed(line: Column, schema: StructType) -> Column:
    full = StructType([*schema.fields]).add(_BAD, "string")
    return F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})


def judged(lines: DataFrame, schema: StructType = EVENT) -> DataFrame:
    """``value`` with ``event`` and ``reason``: null, ``blank``, ``non-object`` or ``invalid JSON``.

    A top-level array is no event: its rows would not be lines.
    """
    text = F.trim(F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", ""))
    # another JSON value is well-formed exactly when its wrapping is
    whole = F.from_json(F.concat(F.lit('{"v":'), F.col("__text"), F.lit("}")), f"v string, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    rows = lines.select("*", text.alias("__text"))
    object_ = F.col("__text").startswith("{")
    # each line is parsed once, in the form that it has
    rows = rows.withColumns({"__event": F.when(object_, _parsed(F.col("__text"), schema)), "__whole": F.when(~object_ & (F.col("__text") != ""), whole)})
    reason = (
        F.when(F.col("__text") == "", "blank")
        .when(object_, F.when(F.col(f"__event.{_BAD}").isNotNull(), "invalid JSON"))
        .when(F.col(f"__whole.{_BAD}").isNotNull(), "invalid JSON")
        .otherwise("non-object")
    )
    fields = F.struct(*(F.col(f"__event.{f.name}").alias(f.name) for f in schema.fields))
    return rows.withColumn("reason", reason).withColumn("event", F.when(F.col("reason").isNull(), fields)).drop("__text", "__event", "__whole")


def events_of(lines: DataFrame, schema: StructType = EVENT) -> DataFrame:
    """The good rows."""
    return judged(lines, schema).where("reason is null").select("event.*")


def rejects_of(lines: DataFrame, schema: StructType = EVENT) -> DataFrame:
    """The bad rows (not the blank ones) with their reason, and whatever other columns tell where they are from."""
    return judged(lines, schema).where("reason <> 'blank'").drop("event")


def read(spark: SparkSession, path: str, schema: StructType = EVENT) -> DataFrame:
    """Events under ``path``; a missing path has none."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return events_of(lines, schema)


def read_with_rejects(spark: SparkSession, path: str, schema: StructType = EVENT, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events (the first ``limit`` of them) and rejects with ``file``, ``reason`` and the raw line."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    good = events_of(lines, schema)
    return (good if limit is None else good.limit(limit)), rejects_of(lines, schema)


def tail(spark: SparkSession, path: str, schema: StructType = EVENT, files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream over a growing folder; ``availableNow`` reads to the end, ``processingTime`` follows."""
    return events_of(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), schema)


def write(events: DataFrame, path: str, mode: str = "append", instance: str | None = None, rows_per_file: int = 1_000_000) -> None:
    """One compact JSON object per line; ``instance_id`` is filled where it is missing."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    with_instance(events, instance).write.mode(mode).option("maxRecordsPerFile", rows_per_file).json(path)


def with_instance(events: DataFrame, instance: str | None) -> DataFrame:
    if instance is None:
        return events
    own = F.col("instance_id") if "instance_id" in events.columns else F.lit(None).cast("string")
    return events.withColumn("instance_id", F.coalesce(own, F.lit(instance)))
