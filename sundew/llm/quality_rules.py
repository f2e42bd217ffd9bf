"""Quality rules (10): zstandard compression bands over whole documents and fixed chunks.

Very repetitive text compresses far below the usual ratio for its length, and random text (keys,
encoded blobs) hardly at all. The usual ratio falls with length, so the limits depend on it. A
document is rejected when its whole text leaves the band of its length, or when any full chunk
leaves the band for chunks, which finds a bad passage that an otherwise good text would hide. The last
chunk ends with the text, so every byte of a text of at least one chunk is judged in a chunk, and a shorter
text is one chunk, judged by the band of its length.

Random text over few characters (digits, hex digits) compresses as its alphabet allows, so no ratio tells it from prose. What
does, at any length and for any alphabet, is that in prose a byte tells something of the next one and in noise it doesn't. How much it seems to
tell in the same bytes shuffled, which is chance alone, is taken off.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sundew.llm._arrow import with_columns

#: Longest length in bytes, least and greatest accepted ratio. Longer texts take the last.
BANDS = (
    (128, 0.60, 2.00),
    (256, 0.45, 1.10),
    (512, 0.48, 0.88),
    (1024, 0.455, 0.80),
    (2048, 0.425, 0.72),
    (4096, 0.415, 0.66),
    (8192, 0.395, 0.60),
    (16384, 0.38, 0.57),
    (65536, 0.365, 0.55),
    (1 << 62, 0.33, 0.55),
)
#: The band of one full chunk of CHUNK_BYTES bytes.
CHUNK_BYTES, CHUNK_BAND = 4096, (0.36, 0.64)
#: Fixed value: least accepted share of a byte's entropy that the byte before tells, for texts and chunks alike. Of texts labelled good it is
#: 0.13 and more, of random letters, digits, hex or base64 in words of two and more characters 0.09 at most.
LEAST_ORDER = 0.09
#: Bytes whose pairs are counted at once.
PAIR_BYTES = 1 << 20

MIN_WORDS, REPEAT_PERCENT, LEVEL = 50, 50, 3
_SYMBOLS = re.compile(rb"[#*$%&|<>]")

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, worst_low double, worst_high double, pair_order double, worst_order double, kept boolean, reason string"
)


def base_features(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text.

    ``bytes.split()`` cuts at exactly 0x20 and 0x09-0x0D.
    """
    words = raw.split()
    n = len(words)
    chars = sum(len(w) - sum(0x80 <= b < 0xC0 for b in w) for w in words) if not raw.isascii() else sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.split()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(upto, i)
                upto = i + 3
    return n, chars, len(_SYMBOLS.findall(raw)), len(lines) - len(set(lines)), repeated


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for longest, low, high in BANDS if n_bytes <= longest)


def entropy(counts: np.ndarray) -> float:
    share = counts[counts > 0] / counts.sum()
    return float(-(share * np.log2(share)).sum())


def pair_order(raw: bytes) -> float:
    """The share of a byte's entropy that the byte before it tells, less what it seems to tell in the same bytes shuffled (with a fixed seed). 1 for one repeated byte."""
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    used = np.flatnonzero(counts)
    wide = len(used)
    if wide < 2:
        return 1.0
    number = np.zeros(256, np.int64)
    number[used] = np.arange(wide)
    chance = np.random.Generator(np.random.PCG64(5))
    both = []
    for mixed in (False, True):
        pairs = np.zeros(wide * wide, np.int64)
        for at in range(0, len(data), PAIR_BYTES):
            block = number[data[at : at + PAIR_BYTES + 1]]
            block = chance.permutation(block) if mixed else block
            pairs += np.bincount(block[:-1] * wide + block[1:], minlength=wide * wide)
        table = pairs.reshape(wide, wide)
        both.append(entropy(table.sum(axis=0)) + entropy(table.sum(axis=1)) - entropy(pairs))
    return (both[0] - both[1]) / entropy(counts)


def chunk_starts(n_bytes: int) -> list[int]:
    """Where full chunks start; the last one ends with the text and may overlap the one before it."""
    starts = list(range(0, n_bytes - CHUNK_BYTES + 1, CHUNK_BYTES))
    return starts + [n_bytes - CHUNK_BYTES] if starts and n_bytes % CHUNK_BYTES else starts


def quality_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the base features, the compression ratios and the verdict to every row.

    Nulls and empty texts count as texts without words: they fail the base rule. ``pair_order`` and ``worst_order`` are what a byte tells of the next one,
    in the text and in its chunk of least order. Repeated rows get equal verdicts. Extra columns pass through; one with the name of a computed column is replaced.
    An empty table gives an empty result.
    One Arrow pass, no shuffle; a task holds one slice of texts at a time.
    """

    def compute():
        import zstandard

        def shrink(raw: bytes) -> float:
            # a compressor for each call would cost more than the work on short texts
            return len(packer.compress(raw)) / len(raw)

        packer = zstandard.ZstdCompressor(level=LEVEL)

        def call(texts: list[bytes | None]) -> dict[str, pa.Array]:
            rows = []
            for raw in texts:
                raw = raw or b""
                n, chars, symbols, lines, repeated = base_features(raw)
                failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
                ratio = shrink(raw) if raw else None
                order = pair_order(raw) if raw else None
                parts = [raw[i : i + CHUNK_BYTES] for i in chunk_starts(len(raw))]
                chunks = [shrink(part) for part in parts]
                low, high = band(len(raw))
                worst_low, worst_high = min(chunks, default=None), max(chunks, default=None)
                worst_order = min(map(pair_order, parts), default=None)
                reason = (
                    "too few words" if n < MIN_WORDS
                    else "repeated words" if failed
                    else "repetitive text" if ratio < low
                    else "incompressible text" if ratio > high
                    else "repetitive chunk" if chunks and worst_low < CHUNK_BAND[0]
                    else "incompressible chunk" if chunks and worst_high > CHUNK_BAND[1]
                    else "noise" if order < LEAST_ORDER
                    else "noise in a chunk" if chunks and worst_order < LEAST_ORDER
                    else None
                )
                rows.append((n, chars, symbols, lines, repeated, failed, ratio, worst_low, worst_high, order, worst_order, reason is None, reason))
            columns = zip(*rows, strict=True)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 5 + [pa.bool_(), pa.string()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return {k: pa.array(list(c), t) for k, c, t in zip(names, columns, kinds, strict=True)}

        return call

    return with_columns(df, text, SCHEMA, compute, keep)
