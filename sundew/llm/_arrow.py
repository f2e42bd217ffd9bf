"""Small helpers shared by the operators that run Arrow batches through Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of text handled at once inside a task; a longer single text is handled alone.
SLICE_BYTES = 1 << 20


#: Most rows of an Arrow batch. Rows hold whole texts or their hashes, so the usual 10,000 can be hundreds of MB.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """Let the session send no more than BATCH_ROWS rows to Python at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose texts hold about SLICE_BYTES together."""
    texts = batch.column(column)
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + (size or 0) > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield start, batch.num_rows


def with_columns(
    df: DataFrame, text: str, schema: str, compute: Callable[[], Callable[[list], dict[str, pa.Array]]], keep: list[str] | None = None
) -> DataFrame:
    """Append columns computed from ``df[text]``, slice by slice, in one Arrow pass without a shuffle.

    ``compute()`` is called once per task and returns a function from a list of texts (``bytes``
    or None) to arrays. ``keep`` names the input columns that go along; all by default. A computed
    column replaces an input column of the same name.
    """
    added = StructType.fromDDL(schema)
    keep = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    kept = df.select(*dict.fromkeys([*keep, text])).schema
    out = StructType([*(kept[c] for c in keep), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = compute()
        for batch in batches:
            for start, stop in text_slices(batch, text):
                part = batch.slice(start, stop - start)
                raw = part.column(text)
                if not pa.types.is_binary(raw.type):
                    raw = raw.cast(pa.binary())
                got = call(raw.to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(got[f.name] for f in added.fields)], names=out.names)

    return small_batches(df).select(*dict.fromkeys([*keep, text])).mapInArrow(run, out)
