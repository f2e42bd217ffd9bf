"""Canary tokens: triggers against the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TYPES = ("HTTP_URL", "API_KEY", "CRED_PAIR", "ENV_VAR", "DOC_EMBED")


def alerts(triggers: DataFrame, registry: DataFrame) -> DataFrame:
    """Triggers of known tokens, with the token's row and the trigger's number; others give nothing."""
    order = Window.partitionBy("token_id").orderBy("ts_ms", "seq")
    return triggers.join(registry, "token_id").withColumn("trigger_count", F.row_number().over(order))


def rolled_up(triggers: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with ``triggered``, the first trigger and the number of triggers."""
    counts = triggers.groupBy("token_id").agg(F.min("ts_ms").alias("first_trigger_ms"), F.count(F.lit(1)).alias("trigger_count"))
    out = registry.join(counts, "token_id", "left")
    return out.withColumns({"trigger_count": F.coalesce("trigger_count", F.lit(0)), "triggered": F.col("first_trigger_ms").isNotNull()})


def stats(registry: DataFrame) -> DataFrame:
    """``token_type, tokens, triggered`` for every type, those without tokens too."""
    types = registry.sparkSession.createDataFrame([(t,) for t in TYPES], "token_type string")
    counts = registry.groupBy("token_type").agg(F.count(F.lit(1)).alias("tokens"), F.count_if("triggered").alias("triggered"))
    return types.join(counts, "token_type", "left").select("token_type", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "triggered")))
