"""Points and the intervals they lie in, met by sorting both together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sundew.plans.tables import lookup, materialize

BLOCK = ArrayType(StructType([StructField("len", IntegerType()), StructField("base", StringType())]))


@F.pandas_udf(BLOCK)
def _blocks(low: pd.Series, high: pd.Series) -> pd.Series:
    """Aligned blocks of powers of two that make up an interval of hex digits, two for each bit at most."""

    def one(a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        width, out = 4 * len(a), []
        first, last = int(a, 16), int(b, 16)
        while first <= last:
            bits = (last - first + 1).bit_length() - 1
            if first:
                bits = min(bits, (first & -first).bit_length() - 1)
            out.append({"len": width - bits, "base": f"{first >> bits:x}"})
            first += 1 << bits
        return out

    return pd.Series([one(a, b) for a, b in zip(low, high, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def _bases(at: pd.Series, lengths: pd.Series) -> pd.Series:
    """The block of each length that a point lies in."""
    return pd.Series([[f"{int(a, 16) >> (4 * len(a) - int(n)):x}" for n in ns] for a, ns in zip(at, lengths, strict=True)])


def successor(digits: Column) -> Column:
    """The next number of as many hex digits; null after the last."""
    part = lambda i: F.regexp_extract(digits, "^(.*?)([0-9a-e])(f*)$", i)
    after = F.concat(part(1), F.translate(part(2), "0123456789abcde", "123456789abcdef"), F.repeat(F.lit("0"), F.length(part(3))))
    return F.when(part(2) != "", after)


def segments(intervals: DataFrame) -> DataFrame:
    """``kind, at, best``: from ``at`` on up to the next one, ``best`` is the interval that covers and starts last, null where none does.

    ``intervals`` has ``kind``, ``low`` and ``high`` (lower-case hex digits, as many for all of a kind, both ends inside) and ``row``, a struct. Of
    intervals with one start the one that ends first counts, then the greater row. Cover changes only where an interval starts or has ended. Which one covers such
    a place is asked by blocks: every interval is cut into aligned blocks, a block keeps its best interval, and a place asks for its block
    of each length that there is, 129 at most. So intervals may overlap in any way, and no two are compared.
    An interval that ends before it starts covers nothing.
    """
    real = intervals.where("low <= high")
    sooner = F.translate("high", "0123456789abcdef", "fedcba9876543210").alias("sooner")
    cut = real.select("kind", "low", F.explode(_blocks("low", "high")).alias("b"), F.struct("low", sooner, "row", "high").alias("best"))
    kept = materialize(cut.groupBy("kind", F.col("b.len").alias("len"), F.col("b.base").alias("base")).agg(F.max("best").alias("best")), "interval-blocks")
    lengths = kept.groupBy("kind").agg(F.array_sort(F.collect_set("len")).alias("lengths"))
    places = real.select("kind", F.explode(F.array("low", successor(F.col("high")))).alias("at")).where("at is not null").distinct()
    asked = places.join(F.broadcast(lengths), "kind").select("kind", "at", F.explode(F.arrays_zip("lengths", _bases("at", "lengths").alias("bases"))).alias("q"))
    asked = materialize(asked.select("kind", "at", F.col("q.lengths").alias("len"), F.col("q.bases").alias("base")), "interval-asked")
    keys = ["kind", "len", "base"]
    right = kept.join(asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    found = lookup(asked, right, keys, asked.count(), F.xxhash64("at"), how="left")
    return found.groupBy("kind", "at").agg(F.max("best").alias("best"))


def covering(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """``points`` (``kind``, the hex digits ``key``, and others) with ``row`` of the interval that covers and starts last; null where none does.

    Segments and points are sorted together in range partitions; a point takes the last segment before it, and a range that begins inside
    a segment gets it from the ranges before, one row for each range. A point is one row throughout, however many intervals cover it, so a crowded network is no hot
    key. Points without a kind or key get null; repeated points are kept. ``points`` may have columns of any name but those with two leading underscores.
    """
    row_type = intervals.schema["row"].dataType
    known = segments(intervals).select(F.col("kind").alias("__kind"), F.col("at").alias("__at"), F.lit(0).alias("__point"), F.struct("kind", "best").alias("__seg"), F.lit(None).cast(points.schema).alias("__own"))
    asked = points.where(F.col("kind").isNotNull() & F.col(key).isNotNull())
    own = asked.select(F.col("kind").cast(intervals.schema["kind"].dataType).alias("__kind"), F.col(key).alias("__at"), F.lit(1).alias("__point"), F.lit(None).cast(known.schema["__seg"].dataType).alias("__seg"), F.struct(*points.columns).alias("__own"))
    order = ["__kind", "__at", "__point"]
    # the hash deals repeats of one point over several ranges
    laid = materialize(known.unionByName(own).repartitionByRange(*order, F.xxhash64("__own")).withColumn("__range", F.spark_partition_id()), "intervals")
    last = laid.where("__point = 0").groupBy("__range").agg(F.max_by("__seg", F.struct("__kind", "__at")).alias("__last"))
    ranges = laid.select("__range").distinct().join(last, "__range", "left")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("__range", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = laid.withColumn("__here", F.last("__seg", ignorenulls=True).over(inside)).join(F.broadcast(carried), "__range").where("__point = 1")
    seg = F.coalesce("__here", "__carry")
    # the last segment before a kind's first may be of another kind, and the last of a kind may have no end
    hit = F.when((seg["kind"] == F.col("__kind")) & (F.col("__at") <= seg["best"]["high"]), seg["best"]["row"])
    out = met.select(*(F.col(f"__own.{c}").alias(c) for c in points.columns), hit.alias("row"))
    rest = points.where(F.col("kind").isNull() | F.col(key).isNull()).withColumn("row", F.lit(None).cast(row_type))
    return out.unionByName(rest)
