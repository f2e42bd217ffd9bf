"""Byte-level BPE encoding and decoding (4).

Texts become arrays of code-point classes. A small automaton reads the classes; its transition
functions are composed blockwise (composition is associative), so that every block of a batch is
scanned at the same time, and a position is a boundary when the automaton says so. No regular
expression runs. The slices between boundaries go through a cache to pair merging by rank. Ids and
byte offsets are packed as little-endian unsigned 32-bit integers, and offsets allow to cut the text by token.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundew.llm._arrow import with_columns

#: Most slices that a worker remembers; beyond it the cache starts anew.
CACHE_SLICES = 150_000
#: Stands for no rank.
NONE = 1 << 40

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, END = range(7)
# Symbols that the automaton reads: a class, with what follows it where that matters.
(Y_LETTER, Y_NUMBER, Y_OTHER, Y_INNER, Y_JOIN, Y_LAST, Y_SHORT, Y_LONG, Y_END) = range(9)
# States: what the slice that is open at a position may still take.
(S_START, S_LETTERS, S_NUMBERS, S_OTHERS, S_WHITE, S_JOINED, S_SHORT, S_LONG, S_LONG2, S_CLOSED) = range(10)
N_STATES = 10


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a slice starts, by symbol and state."""
    goto = np.zeros((9, N_STATES), np.uint8)
    cut = np.ones((9, N_STATES), bool)
    goto[Y_LETTER], goto[Y_NUMBER], goto[Y_OTHER] = S_LETTERS, S_NUMBERS, S_OTHERS
    cut[Y_LETTER, [S_LETTERS, S_JOINED]] = cut[Y_NUMBER, [S_NUMBERS, S_JOINED]] = cut[Y_OTHER, [S_OTHERS, S_JOINED]] = False
    # white space: all but the last of a run stay together; a last blank joins what follows, another last one stands alone
    goto[Y_INNER], goto[Y_JOIN], goto[Y_LAST] = S_WHITE, S_JOINED, S_CLOSED
    cut[Y_INNER, S_WHITE] = False
    # an apostrophe opens a contraction of one or two letters unless a blank or its own run has taken it
    goto[Y_SHORT], goto[Y_LONG] = S_SHORT, S_LONG
    for y in (Y_SHORT, Y_LONG):
        goto[y, [S_OTHERS, S_JOINED]] = S_OTHERS
        cut[y, [S_OTHERS, S_JOINED]] = False
    goto[Y_LETTER, S_SHORT], goto[Y_LETTER, S_LONG], goto[Y_LETTER, S_LONG2] = S_CLOSED, S_LONG2, S_CLOSED
    cut[Y_LETTER, [S_SHORT, S_LONG, S_LONG2]] = False
    goto[Y_END] = S_START
    return goto, cut


GOTO, CUT = _tables()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    white = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = WHITE
    out[0x20], out[0x27] = SPACE, QUOTE
    return out


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of ``codes``, in which every text is followed by one filler; ``ends`` are the fillers' places."""
    kind = classes()[codes]
    kind[ends] = END
    after = np.append(kind[1:], np.uint8(END))
    out = kind.copy()
    out[kind == QUOTE] = Y_OTHER
    white = (kind == SPACE) | (kind == WHITE)
    # inside a run, or at the text's end, white space stays in the run
    inner = (after == SPACE) | (after == WHITE) | (after == END)
    out[white] = Y_LAST
    out[kind == SPACE] = Y_JOIN
    out[white & inner] = Y_INNER
    out[kind == END] = Y_END
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        padded = np.append(codes, np.zeros(2, codes.dtype))
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"]) & (kind[np.minimum(quotes + 1, len(kind) - 1)] == LETTER)
        long = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b)) & (kind[np.minimum(quotes + 2, len(kind) - 1)] == LETTER)
        out[quotes[short]] = Y_SHORT
        out[quotes[long]] = Y_LONG
    return out


def scan(syms: np.ndarray, width: int = 512) -> np.ndarray:
    """Where slices start: compose each block's transition function, chain the blocks, replay all blocks at once."""
    n = len(syms)
    blocks = -(-n // width)
    grid = np.full(blocks * width, Y_END, np.uint8)
    grid[:n] = syms
    grid = grid.reshape(blocks, width)
    columns = np.ascontiguousarray(grid.T)
    goto = GOTO.reshape(-1)
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (blocks, N_STATES)).copy()
    for column in columns:  # function composition, one column of all blocks at a time
        maps = goto[column[:, None].astype(np.intp) * N_STATES + maps]
    span = 1
    while span < blocks:  # prefix scan: every map is composed with the one that ends where it begins, over doubling distances
        maps[span:] = np.take_along_axis(maps[span:], maps[:-span].astype(np.intp), axis=1)
        span *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = maps[:-1, S_START]
    cut = CUT.reshape(-1)
    out = np.empty((width, blocks), bool)
    for j, column in enumerate(columns):
        at = column.astype(np.intp) * N_STATES + state
        out[j] = cut[at]
        state = goto[at]
    return out.T.reshape(-1)[:n]


def slices(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which slices start in the joined texts (each followed by one filler byte), and the fillers' offsets."""
    joined = b"\0".join(raws) + b"\0"
    data = np.frombuffer(joined, np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # bytes at which a character starts
    codes = np.frombuffer(joined.decode("utf-8", "strict").encode("utf-32-le"), np.uint32)
    fill = np.cumsum([len(r) + 1 for r in raws]) - 1
    ends = np.searchsorted(lead, fill)
    starts = scan(symbols(codes, ends))
    starts[ends] = True
    return lead[starts], fill


class Merger:
    """Pair merging by rank, with a cache from slice to packed ids and token lengths."""

    #: Longest slice that is merged together with others.
    SHORT = 40

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}
        self.sizes = np.zeros(max(ranks.values()) + 1, "<u4")
        self.byte = np.zeros(256, np.int64)
        pairs = []
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
            if len(token) == 1:
                self.byte[token[0]] = rank
            pairs += [(a << 32 | b, rank) for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        keys, values = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        # an open hash table from pair to rank, a power of two of places, at most a quarter full
        self.bits = int(np.ceil(np.log2(len(keys) * 4)))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = left[self.keys[at[left]] == -1]
            _, first = np.unique(at[free], return_index=True)
            chosen = free[first]
            self.keys[at[chosen]], self.values[at[chosen]] = keys[chosen], values[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of joined pairs, NONE where there is none or a side is missing."""
        keys = a << 32 | b
        at = self.place(keys)
        out = np.full(len(keys), NONE, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            here = self.keys[at[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def learn(self, pieces: set[bytes]) -> None:
        """Put slices into the cache."""
        if len(self.cache) + len(pieces) > CACHE_SLICES:
            self.cache.clear()
        by_length: dict[int, list[bytes]] = {}
        for p in pieces:
            if (rank := self.ranks.get(p)) is not None:
                self.cache[p] = (rank.to_bytes(4, "little"), len(p).to_bytes(4, "little"))
            elif len(p) <= self.SHORT:
                by_length.setdefault(len(p), []).append(p)
            else:
                ids = np.array([self.ranks[t] for t in self.merge_long(p)])
                self.cache[p] = (ids.astype("<u4").tobytes(), self.sizes[ids].tobytes())
        for size, group in by_length.items():
            self.merge_together(size, group)

    def merge_together(self, size: int, group: list[bytes]) -> None:
        """Merge slices of one length: in each round every slice joins its leftmost pair of lowest rank."""
        ids = self.byte[np.frombuffer(b"".join(group), np.uint8).reshape(-1, size)]
        rank = self.rank_of(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(-1, size - 1)
        row, used = np.arange(len(group)), np.full(len(group), size)
        columns = np.arange(size)
        while True:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(rank)), at]
            going = low != NONE
            for i in np.flatnonzero(~going).tolist():
                done = ids[i, : used[i]]
                self.cache[group[row[i]]] = (done.astype("<u4").tobytes(), self.sizes[done].tobytes())
            if not going.any():
                return
            ids, rank, row, used, at, low = ids[going], rank[going], row[going], used[going] - 1, at[going], low[going]
            here = np.arange(len(ids))
            shift = columns[None, :] > at[:, None]
            ids = np.where(shift, np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1)], axis=1), ids)
            ids[here, at] = low
            rank = np.where(shift[:, 1:], np.concatenate([rank[:, 1:], np.full((len(ids), 1), NONE)], axis=1), rank) if size > 1 else rank
            # pairs to the left and right of the joined token
            before, after = at > 0, at + 1 < used
            rank[here[before], at[before] - 1] = self.rank_of(ids[here[before], at[before] - 1], low[before])
            right = here[after]
            rank[right, at[after]] = self.rank_of(low[after], ids[right, at[after] + 1])
            end = here[~after]
            fits = at[~after] < size - 1
            rank[end[fits], at[~after][fits]] = NONE

    def merge_long(self, piece: bytes) -> list[bytes]:
        """The same on a linked list with a heap: n log n for a slice of any length."""
        import heapq

        n = len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := self.ranks.get(piece[a : end[after[a]]])) is not None:
                    heapq.heappush(heap, (r, a, end[after[a]]))
        return [piece[i : end[i]] for i in range(n) if alive[i]]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(load_ranks(path))


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, verify: bool = False) -> DataFrame:
    """Add ``ids`` and ``offsets`` (packed little-endian unsigned 32-bit: ids, and the byte at which each token starts) and ``n_tokens``.

    Nulls count as empty texts and get no tokens. Each text is a row of its own, so repeated rows
    and extra columns need no care; a column named as a computed one is replaced. ``path`` is a rank
    file that every executor can read. With ``verify`` the ids are decoded again at once, and ``exact`` tells
    whether that gives the text. One Arrow pass, no shuffle.
    """

    def compute():
        merge = merger(path)
        spelled = vocabulary(path) if verify else []

        def call(texts: list[bytes | None]) -> dict[str, pa.Array]:
            raws = [t or b"" for t in texts]
            starts, fill = slices(raws)
            at = np.searchsorted(starts, fill)
            places = starts.tolist()
            joined = b"\0".join(raws)
            cache, ids, offsets = merge.cache, [], []
            pieces = [joined[a:b] for a, b in zip(places, places[1:], strict=False)]  # a filler's piece stands between two texts
            if new := set(pieces).difference(cache):
                merge.learn(new.union(pieces) if len(cache) + len(new) > CACHE_SLICES else new)
            first = 0
            for stop in at.tolist():
                pairs = [cache[p] for p in pieces[first:stop]]
                ids.append(b"".join([x[0] for x in pairs]))
                sizes = np.frombuffer(b"".join([x[1] for x in pairs]), "<u4")
                offsets.append((np.cumsum(sizes, dtype=np.uint32) - sizes).astype("<u4").tobytes())
                first = stop + 1
            out = {"ids": pa.array(ids, pa.binary()), "offsets": pa.array(offsets, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
            if verify:
                out["exact"] = pa.array([b"".join([spelled[i] for i in np.frombuffer(x, "<u4").tolist()]) == raw for x, raw in zip(ids, raws, strict=True)], pa.bool_())
            return out

        return call

    return with_columns(df, text, "ids binary, offsets binary, n_tokens long" + ", exact boolean" * verify, compute, keep)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded``, the bytes of the packed ``ids``; nulls count as no tokens."""

    def compute():
        words = vocabulary(path)

        def call(packed: list[bytes | None]) -> dict[str, pa.Array]:
            return {"decoded": pa.array([b"".join([words[i] for i in np.frombuffer(x or b"", "<u4").tolist()]) for x in packed], pa.binary())}

        return call

    return with_columns(df, ids, "decoded binary", compute, keep)


def unpacked(column: Column) -> Column:
    """A packed column as an array of longs, for SQL users."""
    count = (F.length(column) / 4).cast("int")
    byte = lambda i, k: F.conv(F.hex(F.substring(column, i * 4 + 1 + k, F.lit(1))), 16, 10).cast("long")
    each = lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), each)).otherwise(F.array().cast("array<bigint>"))
