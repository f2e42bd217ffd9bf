"""Mixing sources to target weights (6) by the cube method.

Every document has an inclusion probability. The flight phase moves the probabilities of a few
documents at a time along a vector of the constraints' null space until one of them is 0 or 1, so that
the token total and the document total of a source stay exactly as they are. It runs in blocks of
bounded size, all in parallel; at most two documents of a block stay undecided and go to the next,
far smaller round. The last block of a source ends with the landing: its at most two documents are
rounded so that the token total changes least.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sundew.llm.chat_format import running
from sundew.plans.tables import lookup, materialize, ranked

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a block of the flight phase, about.
BLOCK = 512


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """One row per source: ``sid``, ``source``, ``source_size``, ``n`` (its rows), ``target``.

    Sources by code point, null last, take ``weights`` in turn. Shares above ``most`` times the
    source's size stop there, and the excess is shared again by weight, until none is above. A source stops before every other that has
    more size for its weight, so running sums over the sources in that order give the level at each of them, and the first that
    stays under it has the final one. The sources themselves stay distributed.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = [F.col("source").asc_nulls_last()]
    shares = ranked(totals, order, "sid", "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    shares = materialize(shares.withColumn("weight", weight), "mix-weights")
    cap = F.col("source_size") * F.lit(float(most))
    total = shares.agg(F.sum("source_size"), F.sum("weight")).first()
    placed = shares.select("sid", "weight", cap.alias("cap"), (cap / F.col("weight")).alias("ratio"))
    placed = running(running(placed, [], ["ratio", "sid"], "cap", "cap_before"), [], ["ratio", "sid"], "weight", "weight_before")
    level = (F.lit(float(total[0] or 0)) - F.col("cap_before")) / (F.lit(float(total[1] or 1)) - F.col("weight_before"))
    found = placed.withColumn("level", level).where("ratio > level").agg(F.min(F.struct("ratio", "sid", "level"))).first()[0]
    # without one, all sources stop at their greatest share
    target = cap if found is None else F.least(cap, F.col("weight") * F.lit(found.level))
    return shares.select("sid", "source", "source_size", "n", target.alias("target"))


def flight(units: list[list], stream: Iterator[list], rng: random.Random) -> Iterator[list]:
    """Yield decided units of ``stream``; what stays undecided is left in ``units``, two at most.

    A unit is ``[row, size, probability]``. The null space of (1, 1, 1) and the three sizes is one vector.
    """
    for unit in stream:
        units.append(unit)
        if len(units) < 3:
            continue
        a, b, c = (u[1] for u in units)
        move = (b - c, c - a, a - b) if (a, b) != (c, c) else (1, -1, 0)
        up = min(((1 - u[2]) / m if m > 0 else u[2] / -m) for u, m in zip(units, move, strict=True) if m)
        down = min((u[2] / m if m > 0 else (1 - u[2]) / -m) for u, m in zip(units, move, strict=True) if m)
        step = up if rng.random() * (up + down) < down else -down
        left = []
        for u, m in zip(units, move, strict=True):
            u[2] += step * m
            if u[2] < 1e-9 or u[2] > 1 - 1e-9:
                u[2] = float(round(u[2]))
                yield u
            else:
                left.append(u)
        units[:] = left


def land(units: list[list]) -> list[list]:
    """Round what is left so that the token total, then the document total, changes least."""
    options = [[]]
    for _ in units:
        options = [o + [x] for o in options for x in (0.0, 1.0)]

    def change(option: list[float]) -> tuple:
        return abs(sum((x - u[2]) * u[1] for u, x in zip(units, option, strict=True))), abs(sum(x - u[2] for u, x in zip(units, option, strict=True))), option

    for u, x in zip(units, min(options, key=change), strict=True):
        u[2] = x
    return units


def cube_round(units: DataFrame, number: int, seed: int, total: int) -> DataFrame:
    """One round over ``sid, size, pi, ...``; a source's only block also lands.

    A block is met as a run of sorted rows, so a task holds three of them at a time, however many
    rows share a source or even an id. Blocks depend on the data alone, not on the partitions.
    """
    counts = units.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).withColumn("__blocks", F.ceil(F.col("n") / BLOCK))
    block = F.pmod(F.xxhash64(F.lit(seed + number), "__order", "size"), F.col("__blocks"))
    laid = lookup(units, counts, ["sid"], total, F.xxhash64("__order", "size")).withColumn("__block", block)
    laid = laid.repartition("sid", "__block").sortWithinPartitions("sid", "__block", "__order", "size", "pi")
    out, names = units.schema, laid.columns
    sid, block, blocks, size, pi = (names.index(n) for n in ("sid", "__block", "__blocks", "size", "pi"))
    kept = [(n, names.index(n)) for n in out.names if n != "pi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kinds.update(zip(batch.schema.names, batch.schema.types, strict=True))
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def table(done: list[list]) -> pa.RecordBatch:
            columns = {n: pa.array([row[i] for row, _, _ in done], kinds[n]) for n, i in kept} | {"pi": pa.array([u[2] for u in done], pa.float64())}
            return pa.RecordBatch.from_arrays([columns[n] for n in out.names], names=out.names)

        done: list[list] = []
        for key, own in groupby(rows(), key=lambda r: (r[sid], r[block], r[blocks])):
            left: list[list] = []
            for unit in flight(left, ([r, r[size], r[pi]] for r in own), random.Random(f"{seed}/{number}/{key[0]}/{key[1]}")):
                done.append(unit)
                if len(done) >= 4096:
                    yield table(done)
                    done = []
            done += land(left) if key[2] == 1 else left
        if done:
            yield table(done)

    return laid.mapInArrow(run, out)


def mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17) -> DataFrame:
    """Decide how often each row of ``doc_id, source, size`` is taken: adds source_size, target, copies and taken.

    A source whose share is r times its size takes every document floor(r) times, and once more with
    the probability that is left, by the cube method. Null sources are one source, the last; null
    sizes count as 0, null ids are ids. Repeated rows are decided one by one. An empty table gives an
    empty result. Equal input gives an equal result on any number of partitions.
    """
    sized = materialize(sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "mix-sizes")
    # null is a source too
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    targets = materialize(source_targets(sized, weights, most).withColumn("__source", named).drop("source"), "mix-targets")
    total = sized.count()
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    units = (
        lookup(sized.withColumn("__source", named), targets, ["__source"], total, F.xxhash64("doc_id", "size"))
        .drop("__source")
        .withColumns({"__rate": rate, "__order": F.xxhash64("doc_id")})
        .withColumns({"whole": F.floor("__rate"), "pi": F.col("__rate") - F.floor("__rate")})
        .drop("__rate")
    )
    still = (F.col("pi") > 0) & (F.col("pi") < 1)
    decided, number = [units.where(~still)], 0
    left = units.where(still)
    while True:
        number += 1
        after = materialize(cube_round(left, number, seed, total), f"mix-round-{number}")
        decided.append(after.where(~still))
        left = after.where(still)
        if left.isEmpty():
            break
    copies = (F.col("whole") + F.col("pi")).cast("long")
    every = reduce(DataFrame.unionByName, decided)
    return every.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
