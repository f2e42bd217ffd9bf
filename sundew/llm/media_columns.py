"""Media columns (2): a data source for archives of media files.

``spark.read.format("media_archive")`` plans byte ranges over the archives of a folder: the driver
sees only names and sizes, and each task takes the members whose offset lies in its range, found
in the archive's own directory. Payloads stream through Arrow in batches of bounded size. A member
that can't be read is tried again by its offset, on a newly opened file, without touching the
others; after the last try its row carries the error instead of the payload.

Archives are ZIP files with deflated members, media are 8-bit mono WAV files, so any tool opens both.
"""

from __future__ import annotations

import io
import json
import time
import uuid
import wave
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sundew.llm._arrow import with_columns

SCHEMA = "member string, meta string, archive string, offset long, media binary, attempts int, error string"
_ARROW = pa.schema([("member", pa.string()), ("meta", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])
#: Bytes of an archive that one task reads, of a batch, and of an archive at which the writer starts another.
SPLIT_BYTES, BATCH_BYTES, ARCHIVE_BYTES = 16 << 20, 4 << 20, 64 << 20
TRIES = 3
#: Each write leaves one list of its archives; the reader takes all lists together.
LIST_NAME = "_archives"


def store(path: str):
    """File system and plain path of a URI. Any file system that the cluster shares will do."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if ":/" in path else f"file://{path}")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tries = int(options.get("tries", TRIES))
        self.wait = float(options.get("wait_seconds", 0.2))

    def partitions(self) -> list[ByteRange]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = store(self.path)
        found = {f.base_name: f for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File}
        lists = [name for name in found if name.startswith(LIST_NAME)]
        if lists:  # what writers committed; files of failed attempts stay unread
            named = []
            for name in lists:
                with fs.open_input_stream(f"{root}/{name}") as f:
                    named += json.loads(f.read())
            found = {name: found[name] for name in named}
        archives = sorted((f for name, f in found.items() if name.endswith(".zip")), key=lambda f: f.base_name)
        return [ByteRange(f.base_name, at, min(at + self.split, f.size)) for f in archives for at in range(0, f.size, self.split)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = store(self.path)
        where = f"{root}/{partition.archive}"
        opened: list = []

        def archive() -> zipfile.ZipFile:
            if not opened:
                opened.append(zipfile.ZipFile(fs.open_input_file(where)))
            return opened[0]

        def again(call):
            for attempt in range(1, self.tries + 1):
                try:
                    return call(), attempt, None
                except (OSError, zipfile.BadZipFile, EOFError, ValueError, RuntimeError, NotImplementedError) as e:
                    failed = f"{type(e).__name__}: {e}"
                except Exception as e:  # zlib.error has no common base with the others
                    failed = f"{type(e).__name__}: {e}"
                opened.clear()
                if attempt < self.tries:
                    time.sleep(self.wait * attempt)
            return None, self.tries, failed

        directory, _, error = again(lambda: archive().infolist())
        if error:
            raise OSError(f"{where}: {error}")
        mine = sorted((m for m in directory if partition.start <= m.header_offset < partition.stop), key=lambda m: m.header_offset)
        rows, held = [], 0
        for m in mine:
            media, attempts, error = again(lambda m=m: archive().read(m))
            rows.append((m.filename, m.comment.decode() or None, partition.archive, m.header_offset, media, attempts, error))
            held += len(media or b"")
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class MediaWriter(DataSourceArrowWriter):
    """Takes columns ``member``, ``meta`` and ``media``; each task writes archives of its own."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.limit = int(options.get("archive_bytes", ARCHIVE_BYTES))
        fs, root = store(self.path)
        fs.create_dir(root)
        if overwrite:
            fs.delete_dir_contents(root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = store(self.path)
        names: list[str] = []
        out = archive = None
        for batch in iterator:
            for member, meta, media in zip(*(batch.column(c) for c in ("member", "meta", "media")), strict=True):
                if archive is None:
                    names.append(f"media-{uuid.uuid4().hex}.zip")
                    out = fs.open_output_stream(f"{root}/{names[-1]}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(member.as_py())
                info.comment = (meta.as_py() or "").encode()
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, media.as_buffer().to_pybytes(), compresslevel=1)
                if out.tell() >= self.limit:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.path)
        with fs.open_output_stream(f"{root}/{LIST_NAME}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.archives)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = store(self.path)
        for name in (n for m in messages if m for n in m.archives):
            fs.delete_file(f"{root}/{name}")


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(dict(self.options), overwrite)


def wav(payload: bytes, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are needed")
        return w.readframes(w.getnframes())


def padded(raw: bytes) -> bytes:
    """``raw`` with zeros up to a positive multiple of 64 bytes."""
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def signal_features(data: bytes) -> str:
    """Level, spread, crossings of the middle and entropy of 8-bit samples."""
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return ""
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"mean={x.mean():.3f};std={x.std():.3f};peak={int(x.max())};crossings={crossings};entropy={-(p * np.log2(p)).sum():.4f}"


def write_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", mode: str = "append") -> None:
    """Store every whole text as a media file in archives under ``path``; ``mode`` is append or overwrite.

    Nulls count as empty texts. Each row makes one member; repeated keys make members of one name,
    told apart by their offset. Only the key and the text are stored. One Arrow pass, no shuffle.
    """

    def compute():
        def call(texts: list[bytes | None]) -> dict[str, pa.Array]:
            return {"media": pa.array([wav(padded(t or b"")) for t in texts], pa.binary()), "n_bytes": pa.array([len(t or b"") for t in texts], pa.int64())}

        return call

    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    media = with_columns(rows, "__text", "media binary, n_bytes long", compute, keep=["__key"])
    meta = F.to_json(F.struct(F.col("__key").alias("key"), "n_bytes"))
    named = media.select(F.concat(F.coalesce(F.col("__key").cast("string"), F.lit("null")), F.lit(".wav")).alias("member"), meta.alias("meta"), "media")
    named.sparkSession.dataSource.register(MediaArchive)
    named.write.format("media_archive").mode(mode).save(path)


def whole(df: DataFrame) -> DataFrame:
    """Rows of ``read_media``, of which every one has to have its payload: a member that stayed unreadable fails the job."""
    failed = F.concat(F.lit("unreadable member "), F.coalesce("member", F.lit("")), F.lit(" of "), F.col("archive"), F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), F.coalesce("error", F.lit("")))
    return df.withColumn("media", F.when(F.col("media").isNull(), F.raise_error(failed).cast("binary")).otherwise(F.col("media")))


def read_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The archives under ``path`` as SCHEMA, one row per member. An empty folder gives no rows."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Add payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes, media_sha256 and feature; null media give nulls."""

    def compute():
        import hashlib
        import zlib

        def one(raw: bytes | None) -> tuple:
            if raw is None:
                return (None,) * 6
            data = samples(raw)
            return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), signal_features(data)

        def call(files: list[bytes | None]) -> dict[str, pa.Array]:
            columns = list(zip(*map(one, files), strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return {n: pa.array(list(c), t) for n, c, t in zip(names, columns, kinds, strict=True)}

        return call

    keep = [c for c in df.columns if c != media]
    return with_columns(df, media, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", compute, keep)
