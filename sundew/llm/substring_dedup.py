"""Substring dedup (5): windows repeated at one length alone are extended to twice that length.

A window of the full length repeats only if every shorter window inside it repeats. The levels are a
quarter of the full length, half of it and the whole, rounded up: 4, 7 and 13 words for 13. At each of the first
two a full window is judged by one sub-window, the one of smallest hash inside it, which equal windows
choose alike, so that few sub-windows are shuffled, 8 bytes each. Only full windows whose chosen sub-window starts in two
documents go on to the next length. Sub-windows are compared by a hash: one that is taken for another lets a window go on, no more.
At the full length the windows that are left are decided by their words: by 128 bits of BLAKE2b over the words, joined by one blank.

Of equal texts only that of the smallest document is searched: every window of the others starts in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundew.llm._arrow import small_batches, text_slices, with_columns
from sundew.llm._hashing import finish, joined_words, window_hashes
from sundew.plans.tables import lookup, materialize, release, tidy

#: Words of a window, and bytes of its digest.
WINDOW, DIGEST_BYTES = 13, 16


def window_digests(raw: bytes, places: Iterable[int], window: int) -> Iterator[bytes]:
    """Digests of the words of the windows that start at these words, whatever stands between the words."""
    words = raw.split()
    text = memoryview(b" ".join(words))
    sizes = np.array([len(w) + 1 for w in words])
    stops = np.cumsum(sizes) - 1
    starts = (stops + 1 - sizes).tolist()
    stops = stops.tolist()
    digest = hashlib.blake2b
    return (digest(text[starts[i] : stops[i + window - 1]], digest_size=DIGEST_BYTES).digest() for i in places)


def levels(window: int) -> tuple[int, int, int]:
    """The lengths, each at most twice the one before."""
    return -(-window // 4), -(-window // 2), window


def chosen(hashes: np.ndarray, inside: int) -> np.ndarray:
    """For every run of ``inside`` sub-windows the place of the smallest hash, the leftmost of equals."""
    n = len(hashes) - inside + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, inside)
    return np.arange(n) + view.argmin(axis=1)


def windows(raws: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, the text of each, and the places at which a full window of one text starts."""
    words, owner = joined_words(raws)
    n = max(len(words) - window + 1, 0)
    return words, owner, np.flatnonzero(owner[:n] == owner[window - 1 :])


def first_keys(window: int, length: int):
    """Distinct keys of the sub-windows that judge a text's full windows at the shortest length."""

    def compute():
        def call(texts: list[bytes | None]) -> dict[str, pa.Array]:
            words, owner, starts = windows([t or b"" for t in texts], window)
            hashes = window_hashes(words, length)
            at = np.unique(chosen(hashes, window - length + 1)[starts]) if len(starts) else starts
            keys, own = hashes[at], owner[at]
            order = np.lexsort((keys, own))
            keys, own = keys[order], own[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
            bounds = np.searchsorted(own[new], np.arange(len(texts) + 1)).astype(np.int32)
            return {"keys": pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[new].view(np.int64)))}

        return call

    return compute


def listed(docs: pa.Array, own: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """``doc, keys``: the different keys of each of ``docs`` that has some; ``own`` is the place of each key's document."""
    order = np.lexsort((keys, own))
    keys, own = keys[order], own[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    keys, own = keys[new], own[new]
    with_keys, first = np.unique(own, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), pa.array(keys.view(np.int64)))
    return pa.RecordBatch.from_arrays([docs.take(pa.array(with_keys)), lists], names=["doc", "keys"])


def extend(df: DataFrame, window: int, length: int, following: int) -> DataFrame:
    """From texts with the ``keys`` of ``length`` words that two documents share: what the windows that go on are judged by next.

    One row for each text: ``doc`` and ``keys``, its sub-windows of ``following`` words, or, where that is the whole window, one row
    for each different window: ``doc`` and ``key``, the digest of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch, "__text"):
                part = batch.slice(start, stop - start)
                raws = [t or b"" for t in part.column("__text").cast(pa.binary()).to_pylist()]
                words, owner, starts = windows(raws, window)
                if not len(starts):
                    continue
                known = part.column("keys")
                sizes = pc.list_value_length(known).to_numpy(zero_copy_only=False)
                tagged = known.flatten().to_numpy().view(np.uint64) ^ finish(np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes))
                short = window_hashes(words, length)
                judge = chosen(short, window - length + 1)[starts]
                alive = starts[np.isin(short[judge] ^ finish(owner[starts].astype(np.uint64)), tagged)]
                if not len(alive):
                    continue
                if following < window:
                    longer = window_hashes(words, following)
                    yield listed(part.column("doc"), owner[alive], longer[chosen(longer, window - following + 1)[alive]])
                    continue
                first = np.searchsorted(owner, np.arange(len(raws)))  # the first word of each text
                cuts = np.searchsorted(owner[alive], np.arange(len(raws) + 1))
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    found = list(set(window_digests(raws[i], (alive[cuts[i] : cuts[i + 1]] - first[i]).tolist(), window)))
                    yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array([i] * len(found))), pa.array(found, pa.binary())], names=["doc", "key"])

    return small_batches(df).mapInArrow(run, "doc long, key binary" if following == window else "doc long, keys array<bigint>")


def text_digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 2 * DIGEST_BYTES))


def ends_of(df: DataFrame) -> DataFrame:
    """The smallest document of every key that two documents have, and the key's rows. Summed up before the shuffle, so a key that very many have is a row from each task."""
    ends = df.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n"))
    return ends.where("low < high").drop("high")


def shared_keys(table: DataFrame, label: str) -> DataFrame:
    """``doc, keys``: of the keys of each document those that another document has too."""
    rows = table.select("doc", F.explode("keys").alias("key"))
    total = table.agg(F.sum(F.size("keys"))).first()[0] or 0
    ends = materialize(ends_of(rows).drop("low"), f"{label}-ends")
    tidy(table.sparkSession)
    shared = lookup(rows, ends, ["key"], total, F.xxhash64("doc", "key")).groupBy("doc").agg(F.collect_set("key").alias("keys"))
    out = materialize(shared, label)
    release(ends)
    tidy(table.sparkSession)
    return out


def repeated_windows(df: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """``doc``, ``hashes`` and ``copies``: digests of its windows that also start in a document with a smaller key, and digests of its texts that equal a smaller document's."""
    source = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("__text"))
    quarter, half, _ = levels(window)
    hashed = source.withColumn("whole", text_digest(F.col("__text")))
    keyed = materialize(with_columns(hashed, "__text", "keys array<bigint>", first_keys(window, quarter), keep=["doc", "whole"]).where(F.size("keys") > 0), f"substring-keys-{quarter}")
    equal = keyed.groupBy("whole").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = materialize(lookup(keyed, equal, ["whole"], keyed.count(), F.col("doc"), "left"), "substring-marked")
    release(keyed)
    copies = marked.where("doc > first").select("doc", F.lit(None).cast("binary").alias("key"), "whole")
    own = marked.where("first is null or doc <= first").select("doc", "keys")
    alive = shared_keys(own, f"substring-{quarter}")
    longer = materialize(extend(source.join(alive.hint("merge"), "doc"), window, quarter, half), f"substring-keys-{half}")
    release(alive)
    tidy(df.sparkSession)
    alive = shared_keys(longer, f"substring-{half}")
    release(longer)
    full = materialize(extend(source.join(alive.hint("merge"), "doc"), window, half, window), f"substring-{window}")
    release(alive)
    tidy(df.sparkSession)
    # one shuffle of the windows at a time: each one's files go before the next
    ends = materialize(ends_of(full), "substring-ends")
    tidy(df.sparkSession)
    later = lookup(full, ends, ["key"], full.count(), F.xxhash64("doc", "key")).where("low < doc").select("doc", "key", F.lit(None).cast("binary").alias("whole"))
    later = materialize(later.unionByName(copies), "substring-later")
    release(full, marked, ends)
    tidy(df.sparkSession)
    found = materialize(later.groupBy("doc").agg(F.collect_set("key").alias("hashes"), F.collect_set("whole").alias("copies")), "substring-found")
    release(later)
    tidy(df.sparkSession)
    return found


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text`` to every row.

    Words are runs of anything but 0x20 and 0x09-0x0D. A word goes when it lies in a window of ``window``
    words that also starts in a document with a smaller key; all is judged on the input. The words that
    stay are joined by one blank. Nulls are texts without words. A row with a null key has no smaller
    documents and is smaller than none, so it stays whole. Rows with one key are one document, and
    each is judged by its own text. An empty table gives an empty result; a column with the name of a computed one
    is replaced. Windows are compared by 128 bits of a cryptographic digest of their words, and so are whole texts.
    """
    found = repeated_windows(df, key, text, window)
    given = df.drop("n_words", "n_removed", "kept_text")
    both = given.join(found.hint("merge").withColumnsRenamed({"doc": "__doc", "hashes": "__hashes", "copies": "__copies"}), F.col(key).cast("long") == F.col("__doc"), "left")
    copied = F.coalesce(F.array_contains("__copies", text_digest(F.col(text))), F.lit(False))
    both = both.withColumn("__copied", copied).drop("__doc", "__copies")
    out = given.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema
    columns = given.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch, text):
                part = batch.slice(start, stop - start)
                counts, gone, texts = [], [], []
                for raw, hashes, copied in zip(part.column(text).cast(pa.binary()).to_pylist(), part.column("__hashes"), part.column("__copied").to_pylist(), strict=True):
                    words = (raw or b"").split()
                    removed = 0
                    if copied:  # all of its windows start in a smaller document
                        removed, stays = len(words), np.zeros(len(words), bool)
                    elif raw and hashes.is_valid and len(hashes):
                        known = set(hashes.as_py())
                        at = np.array([i for i, d in enumerate(window_digests(raw, range(len(words) - window + 1), window)) if d in known], np.int64)
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        stays = np.cumsum(cover)[: len(words)] == 0
                        removed = len(words) - int(stays.sum())
                    counts.append(len(words))
                    gone.append(removed)
                    texts.append(b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s] if removed else words))
                kept = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), kept], names=out.names)

    return small_batches(both).mapInArrow(run, out)
