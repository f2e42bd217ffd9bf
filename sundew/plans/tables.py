"""Written tables that cut lineage, ranks without a single-task sort, and lookups that no hot key can crowd."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot when more than one row in so many has it; so there are fewer hot keys than this.
HOT_KEYS = 1000

_own_folder: dict[str, str] = {}
_of_thread = threading.local()


def _owners() -> list[list[DataFrame]]:
    """The open ``owned_tables`` of this thread; batches of other streams run in threads of their own."""
    return _of_thread.__dict__.setdefault("owners", [])


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, one of our own, but only in local mode, where all tasks see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_folder:
        _own_folder[key] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folder[key]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table survives lost executors and is column-pruned by later readers, which
    a cached or checkpointed row dump is not. It stays until ``release`` or the end of the innermost ``owned_tables``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    if _owners():
        _owners()[-1].append(table)
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again. Spark has no public call for this, so Hadoop's is used."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def owned_tables() -> Iterator[None]:
    """Delete at the end what ``materialize`` has written inside; results have to be read or written before."""
    _owners().append([])
    try:
        yield
    finally:
        release(*_owners().pop())


def tidy(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go now. Spark deletes them when the driver collects its garbage, which an idle one may not do for long.

    Called after shuffles of the size of the input, not after the small ones of a round.
    """
    spark.sparkContext._jvm.System.gc()


def lookup(left: DataFrame, right: DataFrame, keys: list[str], total: int, spread: Column, how: str = "inner") -> DataFrame:
    """``left`` with the columns of its row of ``right``, which has one row for each key and, as ``n``, how many rows of ``left`` have it.

    Rows of a key that more than one in HOT_KEYS of the ``total`` rows have would crowd one task. There are
    fewer than HOT_KEYS such keys, so their rows of ``right`` are broadcast, and those of ``left`` are dealt by ``spread`` (which
    differs between them) instead of the key. All others are joined by a shuffle. Null keys match nothing. ``how`` is inner or left.
    """
    values = [c for c in right.columns if c not in (*keys, "n")]
    hot = F.col("n") > max(total // HOT_KEYS, 1)
    row = F.struct(F.lit(True).alias("is"), *values)
    few = right.where(hot).select(*(F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)), row.alias("__hot"))
    many = right.where(~hot).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.lit(0).cast("long").alias("__s"), row.alias("__cold"))
    on = lambda mark: [F.col(k) == F.col(f"__{mark}{i}") for i, k in enumerate(keys)]
    met = left.join(F.broadcast(few), on("h"), "left")
    # a hot row has its own number here, so that it goes anywhere and meets nothing
    met = met.withColumn("__at", F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(spread.cast("long").bitwiseOR(F.lit(1))))
    own = [F.when(F.col("__at") == 0, F.col(k)).alias(f"__l{i}") for i, k in enumerate(keys)]
    met = met.select(*left.columns, "__hot", "__at", *own)
    on_cold = [F.col(f"__l{i}").eqNullSafe(F.col(f"__k{i}")) for i in range(len(keys))] + [F.col("__at") == F.col("__s")]
    met = met.join(many.where(" and ".join(f"__k{i} is not null" for i in range(len(keys)))).hint("merge"), on_cold, "left")
    found = F.coalesce("__hot", "__cold")
    met = met.select(*left.columns, found.alias("__found"))
    if how == "inner":
        met = met.where(F.col("__found").isNotNull())
    return met.select(*left.columns, *(F.col(f"__found.{v}").alias(v) for v in values))


def ranked(df: DataFrame, order: list[Column], name: str, label: str = "ranked") -> DataFrame:
    """Add a gapless global rank (from 0) in ``order`` without sorting all rows in one task.

    Rows are range-partitioned, ranked inside each range, and shifted by the number of rows in
    earlier ranges. Ties get adjacent ranks in no stated order. The ranges are written first, so
    that a recomputed task sees the same bounds. Only one count per range is broadcast.
    """
    part, local = f"__{name}_range", f"__{name}_local"
    laid = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), label)
    counts = laid.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = laid.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return (
        inside.join(F.broadcast(starts), part)
        .withColumn(name, (F.col("__start") + F.col(local)).cast("long"))
        .drop(part, local, "__start")
    )
