"""Sharding (7): balanced label propagation, in DataFrame functions only.

Documents start in shards of equal size. In every round each linked document asks which shard with room most of its
neighbours are in; of neighbours that both wish to move only the one with more to gain may, so every move takes
away cut links. As many move into a shard as its quota allows; who, is drawn by hash, so nothing is ranked. Rounds end when
nobody wishes to move. Documents without links neither vote nor count in the quotas: they are the ballast that
makes the counts exact at the end, when a shard with too many rows gives some to shards with too few, those without links first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.plans.tables import lookup, materialize, ranked, release

#: Shards, and how far over its size propagation may fill one; the counts are made exact afterwards.
SHARDS, SLACK = 40, 0.3


def quotas(flows: dict[tuple[int, int], int], free: list[int]) -> list[float]:
    """The share of the nodes going to each shard that may: its free places and those of the nodes that may leave it.

    ``flows`` counts the nodes going from one shard to another.
    """
    share = [1.0] * len(free)
    for _ in range(32):
        room, inflow = list(free), [0] * len(free)
        for (here, there), n in flows.items():
            room[here] += n * share[there]
            inflow[there] += n
        share = [min(s, max(0.0, r) / i) if i else s for s, r, i in zip(share, room, inflow, strict=True)]
    return share


def propagate(start: DataFrame, edges: DataFrame, shards: int, capacity: int, rounds: int | None = None) -> DataFrame:
    """``node, label`` after balanced label propagation from ``start`` (``node, label``), until nobody wishes to move or for ``rounds``.

    ``edges`` (``a, b``) are read in both directions, repeated edges weigh more, and loops are ignored. A shard takes as many
    as it has places under ``capacity`` or others leave in the same round; draws are by hash, so that it may hold a few more
    in the end. A node without edges keeps its label. A node with very many links is looked up without crowding one task. Counts
    for each shard, and for each two shards that exchange nodes, come to the driver.
    """
    links = edges.where("a <> b").select("a", "b")
    links = materialize(links.union(links.select("b", "a")), "shard-links")
    total = links.count()
    degrees = links.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    labels = materialize(start.select("node", F.col("label").cast("int").alias("label")).join(degrees, "node", "left"), "shard-labels-0")
    spread = F.xxhash64("a", "b")
    number, still, leaving = 0, 0, set(range(shards))
    while still < 2 and (rounds is None or number < rounds):
        number += 1
        counts = dict(labels.groupBy("label").count().collect())
        free = [capacity - counts.get(i, 0) for i in range(shards)]
        # a shard is asked for when it has room, or when others wished to leave it
        open_ = F.element_at(F.array(*(F.lit(free[i] > 0 or i in leaving) for i in range(shards))), F.col("there") + 1)
        seen = lookup(links, labels.select(F.col("node").alias("b"), "n", F.col("label").alias("there")), ["b"], total, spread)
        near = seen.groupBy(F.col("a").alias("node"), "there").agg(F.count(F.lit(1)).alias("votes")).join(labels, "node")
        here = F.col("there") == F.col("label")
        best = F.max(F.when(~here & open_, F.struct("votes", (-F.col("there")).alias("minus"))))
        asked = near.groupBy("node", "n", "label").agg(best.alias("best"), F.coalesce(F.max(F.when(here, F.col("votes"))), F.lit(0)).alias("stay"))
        rank = F.struct((F.col("best.votes") - F.col("stay")).alias("gain"), F.xxhash64("node", F.lit(number)).alias("draw"), "node")
        wish = asked.where(F.col("best.votes") > F.col("stay")).select("node", "n", "label", (-F.col("best.minus")).alias("target"), rank.alias("rank"))
        wish = materialize(wish, f"shard-wishes-{number}")
        # neighbours that both wish would pass each other: the one with more to gain goes, the other asks again
        rivals = lookup(links, wish.select(F.col("node").alias("b"), "n", "rank"), ["b"], total, spread).groupBy(F.col("a").alias("node")).agg(F.max("rank").alias("rival"))
        going = wish.join(rivals, "node", "left").where(F.col("rival").isNull() | (F.col("rank") > F.col("rival"))).select("node", "label", "target")
        going = materialize(going, f"shard-going-{number}")
        flows = {(r[0], r[1]): r[2] for r in going.groupBy("label", "target").count().collect()}
        if not flows:
            break
        leaving = {r[0] for r in wish.select("label").distinct().collect()}
        share = F.element_at(F.array(*map(F.lit, quotas(flows, free))), F.col("target") + 1)
        drawn = F.pmod(F.xxhash64("node", F.lit(-number)), F.lit(1 << 20)) / (1 << 20)
        moved = going.where(drawn < share).select("node", "target")
        before = labels
        labels = materialize(before.join(moved, "node", "left").select("node", F.coalesce("target", "label").alias("label"), "n", F.col("target").isNotNull().alias("moved")), f"shard-labels-{number}")
        still = still + 1 if labels.where("moved").isEmpty() else 0
        release(before, wish, going)
    release(links)
    return labels.select("node", "label")


def cut_links(labels: DataFrame, edges: DataFrame) -> int:
    """How many of ``edges`` have their ends in different shards. A measure for tests and reports."""
    ends = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    return ends.where("la <> lb").count()


def equal_text_links(nodes: DataFrame, total: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The nodes (``node, h1, h2``) that share their text as ``node, part, group_size``, and star edges ``a, b`` from each to one drawn node of its part: never all pairs.

    A text of more than ``most`` nodes can't be in one shard: each run of ``most`` of its nodes, in order of number, is a star of its own.
    """
    groups = materialize(nodes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-groups")
    linked = lookup(nodes.select("node", "h1", "h2"), groups, ["h1", "h2"], total, F.col("node"))
    linked = materialize(ranked(linked, [F.col("h1"), F.col("h2"), F.col("node")], "at", "shard-linked"), "shard-linked-at")
    first = materialize(linked.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "shard-first")
    part = F.col("at") - F.pmod(F.col("at") - F.col("first"), F.lit(most))
    parts = materialize(lookup(linked, first, ["h1", "h2"], total, F.col("node")).select("node", part.alias("part")), "shard-parts")
    hubs = parts.groupBy("part").agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("b"), F.count(F.lit(1)).alias("n"))
    hubs = materialize(hubs.withColumn("group_size", F.col("n")), "shard-hubs")
    stars = materialize(lookup(parts, hubs, ["part"], total, F.col("node")), "shard-stars")
    release(groups, linked, first, parts, hubs)
    return stars.select("node", "part", "group_size"), stars.where("node <> b").select(F.col("node").alias("a"), "b")


def even(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows of ``node, label, part, group_size``: counts at most one apart, moving only what a label has too many of.

    Rows of a label are ranked, large groups first and those without a group last; what is over the shard's count fills
    the open places in order of label and rank, so that a group that has to go goes together. A count for each shard comes to
    the driver, nothing else.
    """
    order = [F.col("label"), F.col("group_size").desc_nulls_last(), F.col("part"), F.col("node")]
    laid = materialize(ranked(placed, order, "rank", "shard-order"), "shard-placed")
    counts = {r[0]: r[1] for r in laid.groupBy("label").count().collect()}
    held = [counts.get(i, 0) for i in range(shards)]
    # the fullest shards have one more
    more = set(sorted(range(shards), key=lambda i: (-held[i], i))[: total % shards])
    want = [total // shards + (i in more) for i in range(shards)]
    kept = [min(h, w) for h, w in zip(held, want, strict=True)]
    sums = lambda values: [sum(values[:i]) for i in range(shards)]
    first, over, open_ = sums(held), sums([h - k for h, k in zip(held, kept, strict=True)]), sums([w - k for w, k in zip(want, kept, strict=True)])
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1).cast("long")
    inside = F.col("rank") - of(first, F.col("label"))
    number = of(over, F.col("label")) + inside - of(kept, F.col("label"))
    # the last shard whose open places start at or before the number and aren't none
    starts = F.array(*(F.lit(o) for o in open_))
    goal = F.array_max(F.filter(F.transform(starts, lambda o, i: F.when((o <= F.col("__number")) & (of([w - k for w, k in zip(want, kept, strict=True)], i) > 0), i)), lambda i: i.isNotNull()))
    laid = laid.withColumns({"__inside": inside, "__number": number})
    stays = F.col("__inside") < of(kept, F.col("label"))
    laid = laid.withColumn("shard", F.when(stays, F.col("label")).otherwise(goal).cast("int"))
    slot = F.when(stays, F.col("__inside")).otherwise(of(kept, F.col("shard")) + F.col("__number") - of(open_, F.col("shard")))
    return laid.withColumn("slot", slot.cast("long")).drop("__inside", "__number", "rank")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """``key``, ``size`` (UTF-8 bytes and 16), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` for every row.

    The law is ``rows``: counts of shards are at most one apart. Equal texts are linked, and propagation brings them together as far as
    the counts allow; a text with more rows than a shard is linked in parts of a shard's size. ``slot`` counts from 0 in
    each shard. Nulls count as empty texts; null and repeated keys are rows like others. Extra columns are
    left out. An empty table gives an empty result. ``rounds`` bounds the rounds, for tests.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("key"), (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(5), whole).alias("h2"),
    )
    rows = materialize(rows, "shard-rows")
    nodes = materialize(ranked(rows, [F.col("key").asc_nulls_first(), F.col("h1"), F.col("h2")], "node"), "shard-nodes")
    total = max(nodes.count(), 1)
    most = -(-total // shards)
    linked, edges = equal_text_links(nodes, total, most)
    first = F.floor(F.col("node") * shards / total).cast("int")
    labels = propagate(linked.select("node", first.alias("label")), edges, shards, int(most * (1 + SLACK)), rounds)
    placed = nodes.drop("h1", "h2").join(linked.join(labels, "node"), "node", "left").withColumn("label", F.coalesce("label", first))
    placed = even(placed, shards, total)
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
