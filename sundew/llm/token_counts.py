"""Token counts (9): the tokenizer as a deterministic transducer that emits counts.

A piece sequence is the tokenizer's output exactly when each two neighbours are what the
tokenizer makes of their joined text. So the last piece of every prefix is determined by the last
pieces of shorter prefixes, and what matters at a position is finite: the pieces that are still being
spelled, each with the last piece before it and its count. Those sets are the states; each transition
is annotated with the change of the count. States are compiled when first reached and kept per worker.

A blank resets the transducer: no piece continues across one. A text is therefore cut at blanks first. A short
chunk between two blanks has a constant state map (any state before, the reset state after) and a count, which is remembered. A long
one is cut again at fixed widths. Each of those has a real map, from the states that can stand before it to the state after it and
the tokens in between: that of the few characters before the cut, and the reset state. The maps of all pieces of a batch are composed by a
parallel prefix scan, over doubling distances. Where the state that arrives is not among those a map was made
for, the maps of its chunk get the states that arrive, each in turn, and the scan runs once more, so the count never rests on a guess
and the work grows with the chunk's length.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sundew.llm._arrow import with_columns

BLANK = "▁"
#: Most chunks whose maps a worker keeps, and most states; beyond it they are compiled anew.
CACHE_CHUNKS, CACHE_STATES = 300_000, 300_000
#: Longest chunk that has one constant map; characters of a piece of a longer one, and characters before a cut that suggest a state.
SHORT, WIDTH, LOOK = 64, 64, 24


def merge_symbols(text: str, scores: dict[str, float]) -> list[str]:
    """Join the neighbours whose joined piece scores best, leftmost first. A helper for compiling, not for texts."""
    n = len(text)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(-s, i, i + 2) for i in range(n - 1) if (s := scores.get(text[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (s := scores.get(text[a : end[after[a]]])) is not None:
                heapq.heappush(heap, (-s, a, end[after[a]]))
    return [text[i : end[i]] for i in range(n) if alive[i]]


class Transducer:
    """States are numbers; ``delta[state, char]`` is (next state, change of the count).

    ``scores``: the pieces that merging may form. Runs of blanks merge after everything else and
    all with one score, so they are counted apart by ``run``.
    """

    def __init__(self, scores: dict[str, float]):
        self.blanks = {p: s for p, s in scores.items() if set(p) == {BLANK}}
        self.scores = {p: s for p, s in scores.items() if p not in self.blanks or p == BLANK}
        self.alphabet = {c for p in self.scores for c in p}
        lone = [c for c in self.alphabet if c not in self.scores]
        inside = [p for p in self.scores if BLANK in p[1:]]
        if lone or inside:
            raise ValueError(f"a piece spells what is no piece ({lone[:3]}) or crosses a blank ({inside[:3]})")
        self.nodes: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.scores:
            at = 0
            for c in p:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.piece.append(None)
                at = self.nodes[at][c]
            self.piece[at] = p
        self.sound: dict[str, bool] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.chunks: dict[str, int] = {}
        self.runs: dict[int, int] = {}
        self.forget()

    def forget(self) -> None:
        start = ((0, None, 0),)
        self.known, self.states = {start: 0}, [start]
        self.last: list[str | None] = [None]
        self.delta: dict[tuple[int, str], tuple[int, int]] = {}

    def fits(self, left: str | None, piece: str) -> bool:
        """Whether merging leaves ``piece`` whole at a text's start, or after ``left``."""
        got = self.pairs.get((left, piece))
        if got is None:
            want = [piece] if left is None else [left, piece]
            got = merge_symbols("".join(want), self.scores) == want
            if len(self.pairs) >= 4_000_000:
                self.pairs.clear()
            self.pairs[left, piece] = got
        return got

    def step(self, state: int, char: str) -> tuple[int, int]:
        """Compile one transition."""
        spelled, found = [], None
        for node, left, count in self.states[state]:
            child = self.nodes[node].get(char)
            if child is None:
                continue
            spelled.append((child, left, count))
            piece = self.piece[child]
            if found is None and piece is not None and self.fits(None, piece) and (left is None or self.fits(left, piece)):
                found = (piece, count + 1)
        if found is None:
            raise ValueError(f"no piece ends at {char!r}")
        last, gain = found
        entries = tuple(sorted(((n, p, c - gain) for n, p, c in spelled if self.nodes[n]), key=lambda x: x[0])) + ((0, last, 0),)
        number = self.known.get(entries)
        if number is None:
            number = self.known[entries] = len(self.states)
            self.states.append(entries)
            self.last.append(last)
        self.delta[state, char] = (number, gain)
        return number, gain

    def move(self, state: int, char: str) -> tuple[int, int]:
        move = self.delta.get((state, char))
        if move is None:
            if char not in self.alphabet:  # spelled in bytes, and nothing joins across them
                return 0, len(char.encode())
            move = self.step(state, char)
        return move

    def walk(self, state: int, text: str) -> tuple[int, int]:
        """The state after ``text``, and the tokens on the way."""
        count, get = 0, self.delta.get
        for char in text:
            state, more = get((state, char)) or self.move(state, char)
            count += more
        return state, count

    def chunk(self, word: str) -> int:
        """The count of one short chunk, a blank and what follows up to the next, whatever the state before."""
        if len(self.states) > CACHE_STATES:
            self.forget()
        count = self.walk(0, BLANK + word)[1]
        if len(self.chunks) >= CACHE_CHUNKS:
            self.chunks.clear()
        self.chunks[word] = count
        return count

    def piece_map(self, text: str, before: list[int]) -> dict[int, tuple[int, int]]:
        """The map of one piece: for each state ``before`` it the state after and the tokens. Paths that meet are walked once."""
        out: dict[int, tuple[int, int]] = {}
        seen: list[dict[int, int]] = [{} for _ in text]  # states at each place, with the tokens still to come on their paths
        last: list[dict[int, int]] = [{} for _ in text]
        for first in before:
            state, path = first, []
            for i, char in enumerate(text):
                if state in seen[i]:
                    end, rest = last[i][state], seen[i][state]
                    break
                after, more = self.move(state, char)
                path.append((state, more))
                state = after
            else:
                end, rest = state, 0
            for i in range(len(path) - 1, -1, -1):
                rest += path[i][1]
                seen[i][path[i][0]], last[i][path[i][0]] = rest, end
            out[first] = (end, rest)
        return out

    def long_counts(self, words: list[str]) -> list[int]:
        """Counts of long chunks: pieces of fixed width, their maps, and a prefix scan over all of them together."""
        texts, first = [], []
        for word in words:
            whole = BLANK + word
            first.append(len(texts))
            texts += [(whole, at) for at in range(0, len(whole), WIDTH)]
        if len(self.states) > CACHE_STATES:
            self.forget()
        # a chunk's first piece follows a blank, so its map is constant
        opens = np.zeros(len(texts), bool)
        opens[first] = True
        maps = []
        for (whole, at), opening in zip(texts, opens.tolist(), strict=True):
            before = [0] if opening else list(dict.fromkeys([self.walk(0, whole[max(at - LOOK, 0) : at])[0], 0]))
            maps.append(self.piece_map(whole[at : at + WIDTH], before))
        ends = [*first[1:], len(texts)]
        states, counts = scan(maps, opens)
        lost = [(a, b) for a, b in zip(first, ends, strict=True) if (states[a:b] < 0).any()]
        if lost:
            for a, b in lost:
                state = 0
                for j in range(a, b):
                    if state not in maps[j]:
                        whole, at = texts[j]
                        maps[j] |= self.piece_map(whole[at : at + WIDTH], [state])
                    state = maps[j][state][0]
            states, counts = scan(maps, opens)
        return [int(counts[b - 1]) - (int(counts[a - 1]) if a else 0) for a, b in zip(first, ends, strict=True)]

    def joins(self, word: str) -> bool:
        """Whether the blank before ``word`` joins its first characters: walk the last pieces of prefixes back to the start."""
        state, last_at = 0, []
        for char in BLANK + word:
            if char not in self.alphabet:
                break
            state = (self.delta.get((state, char)) or self.step(state, char))[0]
            last_at.append(self.last[state])
        at, piece = len(last_at), BLANK
        while at > 0:
            piece = last_at[at - 1]
            at -= len(piece)
        return piece != BLANK

    def run(self, n: int) -> int:
        """Tokens of ``n`` blanks in a row that nothing else has joined."""
        if n < 1:
            return 0
        got = self.runs.get(n)
        if got is None:
            got = len(merge_symbols(BLANK * n, self.blanks))
            if n <= 4096:
                self.runs[n] = got
        return got

    def maps(self, text: str) -> list[int]:
        """Counts of the text's chunk maps. ``text`` has its blanks written as BLANK and starts with one."""
        words = text.split(BLANK)[1:]
        long = [w for w in words if len(w) > SHORT]
        counted = dict(zip(long, self.long_counts(long), strict=True)) if long else {}
        known = self.chunks

        def chunk(w: str) -> int:
            return counted[w] if len(w) > SHORT else self.chunk(w)

        if "" not in words:
            return [known.get(w) or chunk(w) for w in words]
        out, blanks = [], 0
        for w in words:
            if not w:
                blanks += 1
                continue
            count = known.get(w) or chunk(w)
            if blanks:
                count += self.run(blanks) if self.joins(w) else self.run(blanks + 1) - 1
            out.append(count)
            blanks = 0
        if blanks:
            out.append(self.run(blanks))
        return out


def scan(maps: list[dict[int, tuple[int, int]]], opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the state after it and the tokens up to it, by composing all maps up to there; -1 where a map lacks the state that arrives.

    Maps are arrays of (state before, state after, tokens). ``opens`` marks maps that hold for any state before.
    """
    n, width = len(maps), max(map(len, maps))
    before, after, tokens = np.full((n, width), -2, np.int64), np.full((n, width), -1, np.int64), np.zeros((n, width), np.int64)
    for i, m in enumerate(maps):
        for j, (state, (end, count)) in enumerate(m.items()):
            before[i, j], after[i, j], tokens[i, j] = state, end, count
    constant = opens.copy()
    span = 1
    while span < n:
        # the map of the pieces up to i: first the one that ends span places earlier, then the one so far
        arrives = after[:-span, :, None]
        hit = (before[span:, None, :] == arrives) | constant[span:, None, None] & (np.arange(width) == 0)
        place, met = hit.argmax(axis=2), hit.any(axis=2)
        goes = np.where(met, np.take_along_axis(after[span:], place, axis=1), -1)
        more = np.where(met, np.take_along_axis(tokens[span:], place, axis=1), 0)
        spent = tokens[:-span] + more
        after[span:], tokens[span:] = goes, spent
        before[span:] = before[:-span].copy()
        constant[span:] = constant[:-span].copy()
        span *= 2
    return after[:, 0], tokens[:, 0]


def read_model(path: str) -> tuple[dict[str, float], bool]:
    """Pieces with scores, and whether a blank is put before a text. Only what the transducer can express is accepted."""
    from sentencepiece import sentencepiece_model_pb2 as pb2

    model = pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    kind = pb2.ModelProto.SentencePiece
    if model.trainer_spec.model_type != pb2.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or kinds - {kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE}:
        raise ValueError("a BPE model with byte fallback and without user-defined pieces is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("a model that changes nothing but blanks is needed")
    return {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}, norm.add_dummy_prefix


@lru_cache(maxsize=2)
def transducer(path: str) -> tuple[Transducer, bool]:
    scores, prefix = read_model(path)
    if not prefix:
        raise ValueError("a model that puts a blank before a text is needed")
    return Transducer(scores), prefix


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to the columns ``keep``, all by default.

    Nulls count as empty texts, which have no tokens. Rows are independent, so repeated rows and
    extra columns need no care; a column named as a computed one is replaced. ``path`` is a model file
    that every executor can read. One Arrow pass, no shuffle.
    """

    def compute():
        machine, _ = transducer(path)

        def call(texts: list[bytes | None]) -> dict[str, pa.Array]:
            counts, bounds = [], [0]
            for raw in texts:
                if raw:
                    counts += machine.maps(BLANK + raw.decode().replace(" ", BLANK))
                bounds.append(len(counts))
            scanned = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])  # the maps' composition up to each chunk
            tokens = np.diff(scanned[bounds])
            return {"n_bytes": pa.array([len(raw or b"") for raw in texts], pa.int64()), "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)}

        return call

    return with_columns(df, text, "n_bytes long, n_tokens long, over_limit boolean", compute, keep)
