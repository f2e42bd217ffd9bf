"""Fill-in-middle transformation (12): a pyarrow.compute pipeline over batches.

A text is split into units (runs of ASCII letters, and every other character alone), all texts of a batch as one
list array. The lists are flattened with their parents' indices, each unit gets its ordinal inside its text, and a
unit's role (prefix, middle or suffix) follows from its ordinal and the text's two cuts. For each role the units are
filtered, built into lists again and joined; the pieces are joined with the marks in the order of the text's form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sundew.llm._arrow import small_batches, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have the suffix first.
PERCENT, SPM_PERCENT = 90, 20
_BYTES = pa.large_binary()
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_DRAWS = ["__h1", "__h2", "__h3", "__h4"]
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(key: Column) -> list[Column]:
    """Four numbers below 2**32 for every row, alike in every run: the first digits of a hash of the key. A null key is hashed as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(_DRAWS)]


def units(texts: pa.Array) -> pa.Array:
    """The units of every text as a list array over the texts' own bytes; an empty text has none."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, np.uint8)
    bounds = ends - ends[0]
    letter = _LETTER[data]
    opens = (data & 0xC0) != 0x80  # a byte that continues a character opens nothing
    opens[1:] &= ~(letter[1:] & letter[:-1])
    opens[bounds[:-1][bounds[:-1] < len(data)]] = True  # a run of letters ends with its text
    starts = np.flatnonzero(opens)
    offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64).tobytes())
    values = pa.Array.from_buffers(_BYTES, len(starts), [None, offsets, pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds).astype(np.int32)), values)


def pieces(listed: pa.Array, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of every list of units: cut after ``first`` and after ``second`` units."""
    values, parents = pc.list_flatten(listed), pc.list_parent_indices(listed)
    sizes = pc.list_value_length(listed).to_numpy().astype(np.int64)
    ordinals = pc.subtract(pa.array(np.arange(len(values))), pc.take(pa.array(np.cumsum(sizes) - sizes), parents))
    after = [pc.cast(pc.greater_equal(ordinals, pc.take(pa.array(cut), parents)), pa.int8()) for cut in (first, second)]
    roles = pc.add(*after)
    out = []
    for role, counts in enumerate((first, second - first, sizes - second)):
        mine = pc.filter(values, pc.equal(roles, pa.scalar(role, pa.int8())))
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), mine), pa.scalar(b"", _BYTES)))
    return out


def joined(*parts: pa.Array | bytes) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p, _BYTES) if isinstance(p, bytes) else p for p in parts), pa.scalar(b"", _BYTES))


def transformed(texts: pa.Array, h: list[np.ndarray], percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns of SCHEMA for texts without nulls."""
    listed = units(texts)
    n = pc.list_value_length(listed).to_numpy().astype(np.int64)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    prefix, middle, suffix = pieces(listed, np.minimum(one, two), np.maximum(one, two))
    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
    plain = pc.or_(pc.or_(marked, pa.array(n == 0)), pa.array(h[2] % 100 >= percent))
    spm = pa.array(h[3] % 100 < spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    psm_text, spm_text = joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(pc.cast(p, pa.large_string())), pa.int64())) for p in (prefix, middle)]
    return [pa.array(n), form, *chars, pc.cast(pc.cast(output, pa.binary()), pa.string())]


def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts again. No mark begins with what another ends with, so the first of each is the one that was put there."""
    both = []
    for name, marks in (("psm", (PREFIX, SUFFIX, MIDDLE)), ("spm", (SUFFIX, PREFIX, MIDDLE))):
        rest = pc.if_else(pc.equal(form, name), output, pa.scalar(b"".join(marks), _BYTES))  # rows of another form take no part
        ends = []
        for mark in marks:
            halves = pc.split_pattern(rest, mark, max_splits=1)
            ends.append(pc.list_element(halves, 0))
            rest = pc.list_element(halves, 1)
        before, after = ends[1:] if name == "psm" else ends[:0:-1]
        both.append(joined(before, rest, after))
    return pc.if_else(pc.equal(form, "plain"), output, pc.if_else(pc.equal(form, "psm"), *both))


def _sliced(df: DataFrame, text: str, helpers: list[str], added: StructType, compute: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """One Arrow pass over ``df``: its columns without ``helpers``, and those of ``added`` for slices of about a MB of text."""
    kept = [c for c in df.columns if c not in helpers and c not in added.names]
    out = StructType([*(df.schema[c] for c in kept), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch, text):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *compute(part)], names=out.names)

    return small_batches(df).mapInArrow(run, out)


def _filled(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.binary()).cast(_BYTES), pa.scalar(b"", _BYTES))


def fill_middle(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Add ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    The cuts and the form follow from the key alone, so reruns agree and rows with one key and text get one result. A null key
    is drawn for like an empty one. Null texts are empty. Empty texts and those that contain a mark stay plain, so that every output can be
    restored. Very long texts are slices of their own. Extra columns pass through; one named as a computed column is
    replaced, and so is one named like a draw (``__h1`` to ``__h4``). An empty table gives an empty result. No shuffle.
    """
    drawn = df.drop(*_DRAWS).select("*", *draws(F.col(key)))

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        return transformed(_filled(part.column(text)), [part.column(c).to_numpy() for c in _DRAWS], percent, spm_percent)

    return _sliced(drawn, text, _DRAWS, StructType.fromDDL(SCHEMA), compute)


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Add ``restored``, the exact text that ``output`` was made of. A null output is an empty text; a row without a form is taken as plain."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        texts = restored(_filled(part.column(output)), pc.fill_null(part.column(form), "plain"))
        return [pc.cast(pc.cast(texts, pa.binary()), pa.string())]

    return _sliced(df, output, [], StructType.fromDDL("restored string"), compute)
