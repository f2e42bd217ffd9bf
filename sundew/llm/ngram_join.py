"""N-gram Jaccard join (8): MinHash values compared in steps, pairs dropped by their posterior, the rest verified exactly.

Texts with equal sets of shingles are one class with one representative. Representatives that agree on a
band of their signature share a bucket; buckets only say which *blocks* of representatives have to be
compared, never list pairs of rows. A block holds a bounded number of bytes, a pair of blocks is compared in one
place, and every pair of representatives is looked at there once: first 32 MinHash values, then more, and when the
posterior probability that the similarity reaches the threshold falls below the tolerance the pair is dropped. Pairs
that survive all steps are verified on their whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.llm._arrow import small_batches, with_columns
from sundew.llm._hashing import finish, window_hashes, word_hashes
from sundew.plans.tables import lookup, materialize, release, tidy

#: Words in a shingle, least similarity, posterior below which a pair is dropped.
WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-8
#: MinHash values, values in a band (a pair at 0.8 shares no band with probability 5e-8), values compared in a step.
VALUES, BAND, STEP = 128, 4, 32
#: Representatives and bytes of shingles in a block, about, and representatives of two blocks that are compared at once.
BLOCK_ROWS, BLOCK_BYTES, TILE = 256, 2 << 20, 256


def shingles(raw: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``n`` words; a shorter text with words is one shingle."""
    words = word_hashes(raw)
    return np.unique(window_hashes(words, min(n, len(words)))) if len(words) else words


@lru_cache(maxsize=1)
def _minhash_parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(5))
    return rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    a, b = _minhash_parameters()
    low = np.full(VALUES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(s), 2048):
        part = ((s[at : at + 2048, None] * a + b) >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, part.min(axis=0), out=low)
    return low


@lru_cache(maxsize=16)
def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of ``compared`` at which P(similarity >= threshold) reaches ``tolerance``, under a uniform prior.

    The posterior after m matches is Beta(m + 1, compared - m + 1); its upper tail is a binomial sum.
    """
    n = compared + 1
    for m in range(compared + 1):
        tail = sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(m + 1))
        if tail >= tolerance:
            return m
    return compared


def links_of(left: list[tuple], right: list[tuple] | None, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """Index pairs of two blocks (of one, if ``right`` is None) with Jaccard similarity at the threshold or over it.

    A member is ``(signature, shingles)``.
    """
    a = np.stack([m[0] for m in left])
    b = a if right is None else np.stack([m[0] for m in right])
    members = left if right is None else right
    i, j = np.triu_indices(len(a), 1) if right is None else (x.reshape(-1) for x in np.indices((len(a), len(b))))
    sizes_a, sizes_b = np.array([len(m[1]) for m in left]), np.array([len(m[1]) for m in members])
    small, large = np.minimum(sizes_a[i], sizes_b[j]), np.maximum(sizes_a[i], sizes_b[j])
    fit = small >= threshold * large - 1e-9
    i, j = i[fit], j[fit]
    same = np.zeros(len(i), np.int64)
    for at in range(0, VALUES, STEP):
        same += (a[i, at : at + STEP] == b[j, at : at + STEP]).sum(axis=1)
        likely = same >= least_matches(at + STEP, threshold, tolerance)
        i, j, same = i[likely], j[likely], same[likely]
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        s, t = left[x][1], members[y][1]
        both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
        if both >= threshold * (len(s) + len(t) - both) - 1e-9:
            out.append((x, y))
    return out


def tiled_links(left: list[tuple], right: list[tuple] | None, threshold: float, tolerance: float) -> Iterator[tuple[int, int]]:
    """The pairs of ``links_of``, a tile of both blocks at a time, so that blocks can be long and travel seldom."""
    other = left if right is None else right
    for i in range(0, len(left), TILE):
        for j in range(i if right is None else 0, len(other), TILE):
            one = right is None and i == j
            for x, y in links_of(left[i : i + TILE], None if one else other[j : j + TILE], threshold, tolerance):
                yield i + x, j + y


def signed(df: DataFrame) -> DataFrame:
    """Add ``set_id`` (digest of the shingle set), ``n_shingles`` and the packed ``signature`` of ``__text``; null without a word."""

    def compute():
        def call(texts: list[bytes | None]) -> dict[str, pa.Array]:
            sets = [shingles(t) if t else None for t in texts]
            sets = [s if s is not None and len(s) else None for s in sets]
            return {
                "set_id": pa.array([s if s is None else digest(s) for s in sets], pa.binary()),
                "n_shingles": pa.array([0 if s is None else len(s) for s in sets], pa.int64()),
                "signature": pa.array([s if s is None else signature(s).astype("<u4").tobytes() for s in sets], pa.binary()),
            }

        return call

    return with_columns(df, "__text", "set_id binary, n_shingles long, signature binary", compute, keep=["__key", "__hash"])


def digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def with_sets(df: DataFrame) -> DataFrame:
    """Add ``shingles`` and ``signature`` of ``__text``, and its ``set_now``."""

    def compute():
        def call(texts: list[bytes | None]) -> dict[str, pa.Array]:
            sets = [shingles(t or b"") for t in texts]
            return {
                "set_now": pa.array([digest(s) for s in sets], pa.binary()),
                "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                "signature": pa.array([signature(s).astype("<u4").tobytes() for s in sets], pa.binary()),
            }

        return call

    return with_columns(df, "__text", "set_now binary, shingles binary, signature binary", compute, keep=[c for c in df.columns if c != "__text"])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rep, component``: the smallest node that each node of ``nodes`` reaches over ``edges`` (``a, b``).

    Every round takes the smallest label among neighbours and then the label of that label, so that chains
    halve; rounds end when no label has changed. Only a count comes to the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "components-edges")
    total = both.count()
    degrees = both.groupBy(F.col("b").alias("rep")).agg(F.count(F.lit(1)).alias("n"))
    labels = materialize(nodes.select("rep", F.col("rep").alias("component")).join(degrees, "rep", "left"), "components-0")
    n_nodes = labels.count()
    number, spread = 0, F.xxhash64("a", "b")
    while True:
        number += 1
        # many have one neighbour, and many one label: both are looked up
        near = lookup(both, labels.select(F.col("rep").alias("b"), "component", "n"), ["b"], total, spread).groupBy(F.col("a").alias("rep")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "rep", "left").select("rep", "n", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        lower = materialize(lower, f"components-lower-{number}")
        asked = lower.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
        jump = labels.select(F.col("rep").alias("mid"), F.col("component").alias("far")).join(asked, "mid")
        after = lookup(lower.withColumnRenamed("n", "degree"), jump, ["mid"], n_nodes, F.xxhash64("rep"))
        after = materialize(after.select("rep", "old", F.least("mid", "far").alias("component"), F.col("degree").alias("n")), f"components-{number}")
        release(labels, lower)
        labels = after
        if after.where(F.col("old") != F.col("component")).isEmpty():
            return labels.select("rep", "component")


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``df``: ``key``, ``class_id``, ``n_links``.

    Two texts link when the Jaccard similarity of their sets of five-word shingles is ``threshold`` or more;
    a text of one to four words is one shingle. ``class_id`` is the smallest key among all that are linked,
    directly or over others; ``n_links`` counts the other rows that a row is linked with, rows with an equal
    shingle set included. Nulls, and texts without a word, have no links and their own key as class. Rows with
    one key keep their own links. An empty table gives an empty result. Keys are numbers; a null key stays
    null, and is counted as a row.
    """
    source = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))
    rows = materialize(signed(source), "ngram-rows")
    worded = rows.where(F.col("set_id").isNotNull())
    rid = F.xxhash64("set_id").alias("rid")
    band = worded.select(rid, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(VALUES // BAND - 1)), lambda i: F.substring("signature", i * 4 * BAND + 1, F.lit(4 * BAND)))))
    band = band.select("rid", F.xxhash64("pos", "col").alias("bucket"))
    # equal sets have one rid, so a bucket of copies alone has one
    n_rows = worded.count()
    shared = band.groupBy("bucket").agg(F.min("rid").alias("hub"), F.max("rid").alias("top"), F.count(F.lit(1)).alias("n")).where("hub < top").drop("top")
    member = lookup(band, shared, ["bucket"], n_rows * (VALUES // BAND), F.xxhash64("rid", "bucket")).distinct()
    member = materialize(member, "ngram-members")
    tidy(df.sparkSession)
    # one representative for each shingle set that shares a bucket, and the text it is read from again: rows of one key are told apart by the text's hash
    first = F.min(F.struct(F.col("__key"), F.col("__hash")))
    sets = worded.groupBy("set_id").agg(F.min("__key").alias("first_key"), first.alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"))
    sets = materialize(sets, "ngram-sets")
    hubs = member.groupBy("rid").agg(F.min("hub").alias("hub"))
    reps = sets.withColumn("rid", F.xxhash64("set_id")).join(hubs, "rid")
    # a hub's representatives are dealt to blocks of bounded size
    parts = reps.groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).alias("parts"))
    block = F.xxhash64("hub", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("parts")))
    reps = materialize(reps.join(parts, "hub").select("rid", "set_id", "first", "copies", block.alias("block")), "ngram-reps")
    at = member.select("bucket", "rid").join(reps.select("rid", "block"), "rid").select("bucket", "block").distinct()
    pairs = at.join(at.withColumnRenamed("block", "other"), "bucket").where("block <= other").select("block", "other").distinct()
    sides = pairs.select("block", "other", F.explode(F.array_distinct(F.array("block", "other"))).alias("side"))
    # the texts of candidates grow with the input, so this join is planned alike at every size
    same = F.col("first.__key").eqNullSafe(F.col("__key")) & (F.col("first.__hash") == F.col("__hash"))
    held = reps.hint("merge").join(source, same).select("set_id", "copies", F.col("block").alias("side"), "__text")
    placed = materialize(with_sets(held).where("set_id = set_now").drop("set_now"), "ngram-placed")
    work = sides.join(placed, "side").select("block", "other", "side", "set_id", "copies", "signature", "shingles")
    work = work.repartition("block", "other").sortWithinPartitions("block", "other", "side")
    found = materialize(small_batches(work).mapInArrow(_compare(threshold, tolerance), "set_id binary, links long, near binary"), "ngram-links")
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("set_id").alias("a"), F.col("near").alias("b")), links.select(F.col("set_id").alias("rep")))
    linked = materialize(labels.withColumnRenamed("rep", "set_id").join(sets.select("set_id", "first_key"), "set_id").join(links, "set_id"), "ngram-linked")
    least = linked.groupBy("component").agg(F.min("first_key").alias("least"), F.count(F.lit(1)).alias("n"))
    known = lookup(linked, least, ["component"], n_rows, F.xxhash64("set_id")).select("set_id", "links", "least")
    per_set = sets.join(known, "set_id", "left").select(
        "set_id", F.col("copies").alias("n"), F.coalesce("least", "first_key").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    per_set = materialize(per_set, "ngram-classes")
    release(member, reps, placed, found, linked)
    tidy(df.sparkSession)
    named = lambda d: d.select(F.col("__key").alias(key), "class_id", "n_links")
    alone = rows.where(F.col("set_id").isNull()).withColumns({"class_id": F.col("__key"), "n_links": F.lit(0).cast("long")})
    return named(lookup(worded.select("__key", "__hash", "set_id"), per_set, ["set_id"], n_rows, F.xxhash64("__key", "__hash"))).unionByName(named(alone))


def _compare(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for (block, other), own in groupby(rows(), key=lambda r: r[:2]):
            sides: dict[int, dict] = {block: {}, other: {}}
            for _, _, side, set_id, copies, sig, packed in own:
                # rows that share a key and a text come twice
                sides[side].setdefault(set_id, (np.frombuffer(sig, "<u4"), np.frombuffer(packed, np.uint64), set_id, copies))
            left, right = list(sides[block].values()), None if block == other else list(sides[other].values())
            if not left or right == []:
                continue
            members = left + (right or [])
            shift = 0 if right is None else len(left)
            links, near = [0] * len(members), list(range(len(members)))
            for x, y in tiled_links(left, right, threshold, tolerance):
                y += shift
                links[x] += members[y][3]
                links[y] += members[x][3]
                p, q = root(near, x), root(near, y)
                near[max(p, q)] = min(p, q)
            hit = [k for k in range(len(members)) if links[k]]
            if hit:
                columns = ([members[k][2] for k in hit], [links[k] for k in hit], [members[root(near, k)][2] for k in hit])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["set_id", "links", "near"])

    return run


def root(near: list[int], x: int) -> int:
    while near[x] != x:
        near[x] = near[near[x]]
        x = near[x]
    return x
