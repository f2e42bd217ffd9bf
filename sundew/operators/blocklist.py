"""Decisions to block addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.functions.net import is_ip

# Fixed values.
RANKS = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def decisions(events: DataFrame, least: str = "high", default_reason: str = "suspicious activity") -> DataFrame:
    """Add ``should_block`` and ``block_reason`` to rows of ``source_ip, severity, event_type``. Unknown severities rank as medium.

    The address is the first that is not empty of ``source_ip``, ``src_ip`` and ``client_ip``, as far as these columns exist, of either kind.
    """
    ranks = F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair))
    rank = F.coalesce(ranks[F.lower("severity")], F.lit(2))
    ip = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("source_ip", "src_ip", "client_ip") if c in events.columns), F.lit(""))
    events = events.withColumn("__valid", is_ip(ip, v6=True))
    valid = F.col("__valid")
    reason = (
        F.when(ip == "", "missing_source_ip").when(~valid, "invalid_source_ip")
        .when(rank < RANKS[least], F.concat(F.lit("severity_below_threshold:"), F.lower("severity")))
        .otherwise(F.coalesce(F.nullif("event_type", F.lit("")), F.lit(default_reason)))
    )
    return events.withColumn("block_reason", reason).withColumn("should_block", (ip != "") & valid & (rank >= RANKS[least])).drop("__valid")


def new_blocks(decided: DataFrame, blocked: DataFrame) -> DataFrame:
    """Audit rows for addresses that are to be blocked and aren't yet: the first decision of each."""
    first = decided.where("should_block").groupBy("source_ip").agg(F.min(F.struct("seq", "block_reason")).alias("f"))
    new = first.join(blocked.select("source_ip").distinct(), "source_ip", "left_anti")
    return new.select("source_ip", F.lit("block").alias("action"), F.col("f.block_reason").alias("reason"), F.col("f.seq").alias("seq"))
