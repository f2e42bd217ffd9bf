"""Cross-tokenizer alignment (11): where two tokenizers' tokens end together, found by galloping intersection.

For every text both tokenizers give a rising list of the bytes at which tokens end. The shorter list drives: each of its
ends is looked for in the longer one from where an earlier one was found, in steps that double until they are past it, and then by binary
search. All ends of a slice of texts take a step at the same time. The common ends cut both lists into groups, and the
differences of their ranks say how many tokens of each a group has: each token of the one is linked to each of the other.

Both tokenizers start anew at a blank between two visible characters, so tokens are made for such chunks and remembered.

How many texts link two ids is counted over all texts. Tasks send sums. The counts of frequent pairs, fewer than HOT_PAIRS by their
share of all, are sent to the tasks; the other pairs of every text meet their counts in a shuffle, in which none of them is frequent.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sundew.llm._arrow import small_batches, text_slices
from sundew.plans.tables import materialize, tidy

#: A pair is hot when more than one in so many pairs of texts and ids are of it; so there are fewer hot pairs than this.
HOT_PAIRS = 1 << 20
#: Chunks that a task remembers, links that it expands at once, links of a group from which equal ids are counted first, and pairs it holds.
CACHE_CHUNKS, EXPANDED, LARGE_GROUP, HELD = 300_000, 1 << 22, 1 << 16, 2_000_000
#: Ends between two that are looked for first.
ANCHOR = 8
#: Where both tokenizers start anew, and a text in which not every blank is such a place.
_CUT, _ODD = re.compile(r"(?<=[^ ])(?= [!-~\w])"), re.compile(r"(?:^| )(?![!-~\w])")


class ByteRanks:
    """A byte-level BPE tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> tuple[object, list[bytes]]:
        """The encoder of a list of chunks, each after a blank, and the bytes of every id. No special tokens, and their strings are plain text."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        with open(self.path, encoding="utf-8") as f:
            words = json.load(f)["model"]["vocab"]
        value = byte_letters()
        spelled = [b""] * (max(words.values()) + 1)
        for word, number in words.items():
            spelled[number] = bytes(value[c] for c in word) if all(c in value for c in word) else b""

        def encode(chunks: list[str]) -> list[list[int]]:
            return [e.ids for e in found.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]

        return encode, spelled


class Pieces:
    """A sentencepiece model that changes nothing but blanks and puts one before a text."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> tuple[object, list[bytes]]:
        from sentencepiece import SentencePieceProcessor

        from sundew.llm.token_counts import read_model

        scores, prefix = read_model(self.path)
        if not prefix or any("▁" in p.lstrip("▁") for p in scores):
            raise ValueError("a model that puts a blank before a text, and none inside a piece, is needed")
        found = SentencePieceProcessor(model_file=self.path)
        spelled = []
        for i in range(found.get_piece_size()):
            piece = found.id_to_piece(i)
            spelled.append(bytes([int(piece[3:-1], 16)]) if found.is_byte(i) else piece.replace("▁", " ").encode())

        def encode(chunks: list[str]) -> list[list[int]]:
            return found.encode(chunks, num_threads=1)

        return encode, spelled


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones of Latin-1 for themselves, the others from 256 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Rows:
    """Number arrays one after the other, with room to grow."""

    def __init__(self):
        self.flat, self.used, self.lengths, self.count = np.empty(1 << 16, np.int32), 0, np.empty(1 << 12, np.int64), 0

    def add(self, lists: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        more = int(lengths.sum())
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.count + len(lists) > len(self.lengths):
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.flat[self.used : self.used + more] = np.fromiter((x for one in lists for x in one), np.int32, more)
        self.lengths[self.count : self.count + len(lists)] = lengths
        self.used, self.count = self.used + more, self.count + len(lists)
        self.starts = np.cumsum(self.lengths[: self.count]) - self.lengths[: self.count]

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers one after the other, and their lengths."""
        lengths = self.lengths[numbers]
        return self.flat[ranges(self.starts[numbers], lengths)], lengths


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each start, as many as its length says."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


class Chunks:
    """Tokens of both tokenizers for chunks of text, remembered."""

    def __init__(self, a: ByteRanks, b: Pieces):
        (self.encode_a, self.spelled_a), (self.encode_b, self.spelled_b) = a.load(), b.load()
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in s], np.int64) for s in (self.spelled_a, self.spelled_b))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.a, self.b, self.exact = Rows(), Rows(), []

    def learn(self, chunks: list[str]) -> None:
        ids_a, ids_b = self.encode_a(chunks), self.encode_b(chunks)
        for chunk, x, y in zip(chunks, ids_a, ids_b, strict=True):
            raw = b" " + chunk.encode()
            self.exact.append(b"".join([self.spelled_a[i] for i in x]) == raw and b"".join([self.spelled_b[i] for i in y]) == raw)
            self.number[chunk] = len(self.number)
        self.a.add(ids_a)
        self.b.add(ids_b)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts, and how many each text has."""
        cut = [t.split(" ") if not _ODD.search(t) else [c[1:] for c in _CUT.split(" " + t)] for t in texts]
        every = [c for one in cut for c in one]
        new = set(every).difference(self.number)
        if len(new) + len(self.number) > CACHE_CHUNKS:
            self.forget()
            new = set(every)
        if new:
            self.learn(sorted(new))
        return np.fromiter(map(self.number.__getitem__, every), np.int64, len(every)), np.fromiter(map(len, cut), np.int64, len(cut))


@lru_cache(maxsize=2)
def _chunks(a_kind: type, a_path: str, b_kind: type, b_path: str) -> Chunks:
    return Chunks(a_kind(a_path), b_kind(b_path))


def gallop(wanted: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of the rising ``wanted`` the first place in the rising ``ends`` that is not below it. The last of ``ends`` is not below any."""
    if len(wanted) > ANCHOR:
        low = np.repeat(gallop(wanted[::ANCHOR], ends), ANCHOR)[: len(wanted)]
    else:
        low = np.zeros(len(wanted), np.int64)
    high, step, last = low.copy(), 1, len(ends) - 1
    open_ = np.flatnonzero(ends[high] < wanted)
    while len(open_):  # steps that double until they are past what is wanted
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, last)
        open_ = open_[ends[high[open_]] < wanted[open_]]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):  # and binary search inside the last step
        middle = (low[open_] + high[open_]) >> 1
        below = ends[middle] < wanted[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def common(ends_a: np.ndarray, ends_b: np.ndarray, driven_by_a: np.ndarray, driven_by_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of the ends that they share. ``driven_by_*``: places of the ends that are looked for in the other list."""
    found_b, found_a = gallop(ends_a[driven_by_a], ends_b), gallop(ends_b[driven_by_b], ends_a)
    hit_a, hit_b = ends_b[found_b] == ends_a[driven_by_a], ends_a[found_a] == ends_b[driven_by_b]
    at_a, at_b = np.concatenate([driven_by_a[hit_a], found_a[hit_b]]), np.concatenate([found_b[hit_a], driven_by_b[hit_b]])
    order = np.argsort(at_a, kind="stable")
    return at_a[order], at_b[order]


class Aligned:
    """Tokens and groups of some texts that both tokenizers spell exactly."""

    def __init__(self, chunks: Chunks, numbers: np.ndarray, per_text: np.ndarray):
        self.chunks = chunks
        self.a, in_a = chunks.a.take(numbers)
        self.b, in_b = chunks.b.take(numbers)
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        self.n_a, self.n_b = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (in_a, in_b))
        ends_a, ends_b = np.cumsum(chunks.sizes_a[self.a]), np.cumsum(chunks.sizes_b[self.b])  # texts one after the other, alike in both
        a_drives = self.n_a <= self.n_b
        self.last_a, self.last_b = common(ends_a, ends_b, np.flatnonzero(np.repeat(a_drives, self.n_a)), np.flatnonzero(~np.repeat(a_drives, self.n_b)))
        self.in_a, self.in_b = (np.diff(x, prepend=-1) for x in (self.last_a, self.last_b))  # rank differences: tokens of each group
        self.text = np.searchsorted(np.cumsum(self.n_a), self.last_a, side="right")  # of each group
        self.n_groups = np.bincount(self.text, minlength=len(per_text))
        self.n_links = np.diff(np.concatenate([[0], np.cumsum(self.in_a * self.in_b)])[np.concatenate([[0], np.cumsum(self.n_groups)])])

    def spelled_groups(self) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text: the ids of all groups in order."""
        wide_a, wide_b = len(self.chunks.sizes_a), len(self.chunks.sizes_b)
        merged = np.empty(len(self.a) + len(self.b), np.int64)
        ends_a, ends_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends_a[self.last_a], ends_b[self.last_b] = wide_a, wide_b
        # a group's tokens of the one come before those of the other
        merged[np.arange(len(self.a)) + np.repeat(self.last_b - self.in_b + 1, self.in_a)] = self.a + ends_a
        merged[np.arange(len(self.b)) + np.repeat(self.last_a + 1, self.in_b)] = 2 * wide_a + self.b + ends_b
        table, at = separated(wide_a, wide_b), 0
        for size in (self.n_a + self.n_b).tolist():
            yield b"".join([table[x] for x in merged[at : at + size].tolist()])[:-1]
            at += size

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair (first id times the ids of the other tokenizer, plus the second) and links of every pair of a text, sorted."""
        wide = len(self.chunks.sizes_b)
        bits = (len(self.chunks.sizes_a) * wide).bit_length()
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def found(key: np.ndarray, n: np.ndarray | None = None) -> None:
            one, where = (key, None) if n is None else np.unique(key, return_inverse=True)
            if n is None:
                one, n = np.unique(key, return_counts=True)
            else:
                n = np.bincount(where, n, len(one)).astype(np.int64)
            keys.append(one)
            times.append(n)

        large = self.in_a * self.in_b > LARGE_GROUP
        first_b = self.last_b - self.in_b + 1
        small = np.flatnonzero(~np.repeat(large, self.in_a))  # tokens of groups whose links are expanded
        group = np.repeat(np.arange(len(large)), self.in_a)[small]
        links, base = self.in_b[group], self.a[small].astype(np.int64) * wide + (self.text[group].astype(np.int64) << bits)
        cuts = np.searchsorted(np.cumsum(links), np.arange(EXPANDED, int(links.sum()) + EXPANDED, EXPANDED), side="left") + 1 if len(links) else []
        at = 0
        for cut in cuts:
            some = slice(at, cut)
            if len(links[some]):
                found(np.repeat(base[some], links[some]) + self.b[ranges(first_b[group[some]], links[some])])
            at = cut
        for g in np.flatnonzero(large).tolist():  # equal ids of a large group are counted before they meet
            x, nx = np.unique(self.a[self.last_a[g] - self.in_a[g] + 1 : self.last_a[g] + 1].astype(np.int64), return_counts=True)
            y, ny = np.unique(self.b[first_b[g] : self.last_b[g] + 1].astype(np.int64), return_counts=True)
            step = max(EXPANDED // len(y), 1)
            for i in range(0, len(x), step):
                keys.append(((int(self.text[g]) << bits) + x[i : i + step, None] * wide + y).reshape(-1))
                times.append((nx[i : i + step, None] * ny).reshape(-1))
        if len(keys) > 1:
            key, n = np.concatenate(keys), np.concatenate(times)
            keys, times = [], []
            found(key, n)
        key, n = (keys[0], times[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return key >> bits, key & ((1 << bits) - 1), n


@lru_cache(maxsize=1)
def separated(wide_a: int, wide_b: int) -> list[bytes]:
    """Every id in decimals and what follows it: inside and at the end of a group's first part, inside and at the end of its second."""
    return [b"%d%s" % (i, mark) for wide, marks in ((wide_a, (b",", b"|")), (wide_b, (b",", b";"))) for mark in marks for i in range(wide)]


_OUTPUTS = {
    "a_ids": "binary", "b_ids": "binary", "a_per_group": "binary", "b_per_group": "binary", "groups": "string", "groups_sha256": "string", "pairs": "binary", "times": "binary",
}


def spans(df: DataFrame, a: ByteRanks, b: Pieces, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("a_ids", "b_ids", "a_per_group", "b_per_group")) -> DataFrame:
    """Add ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``outputs`` to the columns ``keep``, all by default.

    Outputs: ``a_ids`` and ``b_ids`` (packed little-endian unsigned 32-bit), ``a_per_group`` and ``b_per_group`` (how many tokens of each a
    group has, packed likewise), ``groups`` (``a1,a2|b1;a3|b2,b3``), its ``groups_sha256``, ``pairs`` (the different pairs of linked ids as
    ``a * ids of b + b``, sorted and then differences, packed as 64-bit) and ``times`` (links of each, 32-bit).

    Null and empty texts, and texts that one of the tokenizers doesn't spell byte for byte, have no tokens: zeros and empty outputs. Rows are
    independent, so ties and repeated rows need no care. Extra columns pass through; one named as a computed one is replaced. A slice of about a MB of
    texts, or one longer text, is held at a time. An empty table gives an empty result. One Arrow pass, no shuffle.
    """
    added = StructType.fromDDL(", ".join(["n_a long, n_b long, n_groups long, n_links long", *(f"{o} {_OUTPUTS[o]}" for o in outputs)]))
    keep = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    kept = df.select(*dict.fromkeys([*keep, text])).schema
    out = StructType([*(kept[c] for c in keep), *added.fields])
    kinds = (type(a), a.path, type(b), b.path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(*kinds)
        for batch in batches:
            for start, stop in text_slices(batch, text):
                part = batch.slice(start, stop - start)
                texts = [(t or b"").decode("utf-8", "replace") for t in part.column(text).cast(pa.binary()).to_pylist()]
                good = [i for i, t in enumerate(texts) if t]
                numbers, per_text = chunks.numbers([texts[i] for i in good])
                exact = np.array(chunks.exact, bool)[numbers]
                fails = np.bincount(np.repeat(np.arange(len(good)), per_text)[~exact], minlength=len(good)) > 0
                numbers, per_text = numbers[~np.repeat(fails, per_text)], per_text[~fails]
                rows = np.array(good, np.int64)[~fails]
                columns = columns_of(Aligned(chunks, numbers, per_text), rows, part.num_rows, outputs) if len(rows) else empty_columns(part.num_rows, outputs)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=out.names)

    return small_batches(df.select(*dict.fromkeys([*keep, text]))).mapInArrow(run, out)


def empty_columns(n: int, outputs: tuple[str, ...]) -> list[pa.Array]:
    return [pa.array([0] * n, pa.int64()) for _ in range(4)] + [pa.array(["" if _OUTPUTS[o] == "string" else b""] * n, pa.string() if _OUTPUTS[o] == "string" else pa.binary()) for o in outputs]


def columns_of(found: Aligned, rows: np.ndarray, n: int, outputs: tuple[str, ...]) -> list[pa.Array]:
    """Columns of ``n`` rows, of which ``rows`` have tokens."""
    out = []
    for counts in (found.n_a, found.n_b, found.n_groups, found.n_links):
        whole = np.zeros(n, np.int64)
        whole[rows] = counts
        out.append(pa.array(whole))

    def packed(values: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
        lengths = np.zeros(n, np.int64)
        lengths[rows] = counts
        values = values.astype(kind)
        ends = np.concatenate([[0], np.cumsum(lengths)]) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

    made: dict[str, pa.Array] = {}
    if "groups" in outputs or "groups_sha256" in outputs:
        spelled, digests = [b""] * n, [""] * n
        for row, groups in zip(rows.tolist(), found.spelled_groups(), strict=True):
            digests[row] = hashlib.sha256(groups).hexdigest()
            if "groups" in outputs:
                spelled[row] = groups
        made["groups"], made["groups_sha256"] = pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())
    if "pairs" in outputs or "times" in outputs:
        of, pair, times = found.pairs()
        counts = np.bincount(of, minlength=len(rows))
        step = np.diff(pair, prepend=0)
        first = np.cumsum(counts) - counts
        step[first[counts > 0]] = pair[first[counts > 0]]
        made["pairs"], made["times"] = packed(step, counts, "<u8"), packed(times, counts, "<u4")
    for name, values, counts in (("a_ids", found.a, found.n_a), ("b_ids", found.b, found.n_b), ("a_per_group", found.in_a, found.n_groups), ("b_per_group", found.in_b, found.n_groups)):
        if name in outputs:
            made[name] = packed(values, counts, "<u4")
    return out + [made[o] for o in outputs]


def unpacked(pairs: pa.Array, times: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and links of everything that the packed columns of a batch hold."""
    counts = [np.frombuffer(x.as_py() or b"", "<u8").astype(np.int64) for x in pairs]
    rows = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    links = np.frombuffer(b"".join([x.as_py() or b"" for x in times]), "<u4").astype(np.int64)
    return rows, np.concatenate([np.cumsum(c) for c in counts]) if counts else np.zeros(0, np.int64), links


def pair_counts(table: DataFrame) -> DataFrame:
    """``pair, n``: in how many rows of ``spans`` each pair is linked. Tasks send sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sums() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate(x) for x in zip(*held, strict=True))
            found, where = np.unique(pairs, return_inverse=True)
            return found, np.bincount(where, n, len(found)).astype(np.int64)

        def sent(found: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], names=["pair", "n"])

        for batch in batches:
            _, pair, _ = unpacked(batch.column("pairs"), batch.column("times"))
            held.append(np.unique(pair, return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                found, n = sums()
                if len(found) > HELD // 2:
                    yield from sent(found, n)
                    held, size = [], 0
                else:
                    held, size = [(found, n)], len(found)
        if held:
            yield from sent(*sums())

    return small_batches(table.select("pairs", "times")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(df: DataFrame, a: ByteRanks, b: Pieces, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` to the columns ``keep``, all by default.

    A pair's count is the number of rows that link its two ids. ``n_best`` is the number of links whose count is the highest of all
    pairs with their first id, ties included, and ``count_sum`` the sum of the counts of all links. Equal rows count each. What ``spans`` says
    of nulls, empty texts and tables, long texts and extra columns holds here too; rows without tokens have zeros.
    """
    spark = df.sparkSession
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]
    numbered = df.select(*dict.fromkeys([*keep, text])).withColumn("__row", F.monotonically_increasing_id())
    table = materialize(spans(numbered, a, b, text, [*keep, "__row"], ("groups_sha256", "pairs", "times")), "alignment-rows")
    wide = len(b.load()[1])
    counts = materialize(pair_counts(table), "alignment-counts")
    first = F.floor(F.col("pair") / wide)  # exact: pairs are far below 2**53
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("best"))  # at most one row for each id of the first tokenizer
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total // HOT_PAIRS
    judged = counts.join(F.broadcast(best), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("best")).alias("best"))
    few = judged.where(hot).toArrow()
    order = np.argsort(few.column("pair").to_numpy())
    known, n, top = (few.column(c).to_numpy()[order] for c in ("pair", "n", "best"))

    def looked_up(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, pair, links = unpacked(part.column("pairs"), part.column("times"))
        at = np.searchsorted(known, pair).clip(max=max(len(known) - 1, 0))
        return rows, pair, links, at, known[at] == pair if len(known) else np.zeros(len(pair), bool)

    out = StructType([table.schema[c] for c in [*keep, "__row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]] + StructType.fromDDL("__best long, __sum long").fields)

    def with_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, _, links, at, hit = looked_up(part)
            sums = [np.zeros(part.num_rows, np.int64) for _ in range(2)]
            if len(known):
                np.add.at(sums[0], rows[hit], links[hit] * top[at[hit]])
                np.add.at(sums[1], rows[hit], links[hit] * n[at[hit]])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out.names[:-2]), *map(pa.array, sums)], names=out.names)

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, pair, links, _, hit = looked_up(part)
            yield pa.RecordBatch.from_arrays([part.column("__row").take(pa.array(rows[~hit])), pa.array(pair[~hit]), pa.array(links[~hit])], names=["__row", "pair", "links"])

    rest = small_batches(table.select("__row", "pairs", "times")).mapInArrow(cold, "__row long, pair long, links long")
    met = rest.join(judged.where(~hot), "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("__best2"), F.sum(F.col("links") * F.col("n")).alias("__sum2"))
    met = materialize(met, "alignment-cold")
    tidy(spark)
    both = small_batches(table).mapInArrow(with_hot, out).join(met, "__row", "left")
    added = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return both.select(*keep, "n_a", "n_b", "n_groups", "n_links", added("__best", "__best2").alias("n_best"), added("__sum", "__sum2").alias("count_sum"), "groups_sha256")
