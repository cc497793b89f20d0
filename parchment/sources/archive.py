"""A Spark data source over an archive: a folder, or a ZIP that is never unpacked.

Files are hashed first, in one pass that holds a chunk at a time. Text is then taken once from each distinct content, so an
archive of copies costs one extraction for each group of them.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from parchment.functions import fixed
from parchment.sources.extract import Isolated
from parchment.sources.formats import detect

#: ``place`` is the name as the archive has it, and ``oversized`` marks what was not read to its end.
ENTRIES = "path string, place string, format string, byte_sha256 string, size_bytes long, oversized boolean"
#: What stands for the middle of a long text.
GAP = b"\n[...]\n"
TEXTS = "byte_sha256 string, text_sha256 string, source_text string, content_source string, reason string"


class Entries(InputPartition):
    def __init__(self, items: list[tuple[str, str, int]]) -> None:
        super().__init__(None)
        self.items = items


def listed(root: str) -> list[tuple[str, str, int]]:
    """(name, place, size) of every entry, sorted; names are relative, with slashes, composed."""
    compose = lambda x: unicodedata.normalize("NFC", x)
    if os.path.isdir(root):
        found = sorted(p for p in Path(root).rglob("*") if p.is_file())
        return [(compose(p.relative_to(root).as_posix()), str(p), p.stat().st_size) for p in found]
    if zipfile.is_zipfile(root):
        with zipfile.ZipFile(root) as z:
            found = sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename)
            return [(compose(i.filename.replace("\\", "/")), i.filename, i.file_size) for i in found]
    raise ValueError("the input must be a directory or a zip archive")


class Opened:
    """The files of an archive by their places; a ZIP is opened once."""

    def __init__(self, root: str) -> None:
        self.archive = None if os.path.isdir(root) else zipfile.ZipFile(root)

    def __call__(self, place: str) -> object:
        return self.archive.open(place) if self.archive else open(place, "rb")


def hashed(opened: Opened, name: str, place: str, size: int, ceiling: int) -> tuple:
    """A row of ENTRIES; a file over the ceiling, as declared or as read, or one that can't be read has no hash."""
    failed = (name, place, "unknown", None, size, True)
    if size > ceiling:
        return failed
    try:
        with opened(place) as f:
            head = f.read(fixed.HEAD_BYTES)
            sha, total = hashlib.sha256(head), len(head)
            while total <= ceiling and (chunk := f.read(fixed.HASH_CHUNK)):
                sha.update(chunk)
                total += len(chunk)
    except (OSError, zipfile.BadZipFile, RuntimeError, NotImplementedError):
        return failed
    if total > ceiling:
        return name, place, "unknown", None, total, True
    return name, place, detect(head), sha.hexdigest(), total, False


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.parts = options["path"], int(options.get("partitions", 8))
        self.ceiling = int(options.get("ceiling", fixed.MAX_ENTRY_BYTES))

    def partitions(self) -> list[InputPartition]:
        items = listed(self.root)
        n = max(1, min(self.parts, len(items)))
        return [Entries(items[k::n]) for k in range(n)]

    def read(self, partition: Entries) -> Iterator[tuple]:
        opened = Opened(self.root)
        for name, place, size in partition.items:
            yield hashed(opened, name, place, size, self.ceiling)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> ArchiveReader:  # noqa: ANN001
        return ArchiveReader(dict(self.options))


def entries(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def read(f: BinaryIO, kind: str, size: int, tail: bool) -> bytes:
    """A file's bytes; of a text over TEXT_CAP its first bytes, or with ``tail`` half as many and as many of its end, between
    which a line of dots stands for what isn't read."""
    if kind not in ("txt", "html"):
        return f.read()
    if not tail or size <= fixed.TEXT_CAP:
        return f.read(fixed.TEXT_CAP)
    head = f.read(fixed.TEXT_CAP // 2)
    f.seek(size - fixed.TEXT_CAP // 2 + len(GAP))
    return head + GAP + f.read()


def texts(found: DataFrame, root: str, seconds: float = fixed.EXTRACT_SECONDS, partitions: int = 8, tail: bool = False) -> DataFrame:
    """Text, and the hash of its normal form, of each distinct content in ``found``, read at the first path that has it.

    Of text formats only the first bytes are read, or with ``tail`` the first and the last. A file that is gone by now is a
    corrupt one.
    """
    first = found.where(~F.col("oversized")).groupBy("byte_sha256").agg(F.min_by(F.struct("place", "format", "size_bytes"), "path").alias("f"))
    dealt = first.select("byte_sha256", "f.*").repartition(partitions, "byte_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None
        with Isolated() as isolated:
            for batch in batches:
                for row in batch.to_pylist():
                    kind, data = row["format"], b""
                    try:
                        if kind != "unknown":
                            opened = opened or Opened(root)
                            with opened(row["place"]) as f:
                                data = read(f, kind, row["size_bytes"], tail)
                        got = isolated(kind, data, seconds)
                    except (OSError, zipfile.BadZipFile, RuntimeError, NotImplementedError):
                        got = {"source_text": None, "normal": None, "content_source": "own", "reason": "corrupt_file"}
                    sha = hashlib.sha256(got["normal"].encode()).hexdigest() if got["normal"] else None
                    own = {"byte_sha256": row["byte_sha256"], "text_sha256": sha}
                    own |= {k: got[k] for k in ("source_text", "content_source", "reason")}
                    yield pa.RecordBatch.from_pylist([own], schema)

    schema = pa.schema([(name, pa.string()) for name in (x.split()[0] for x in TEXTS.split(", "))])
    return dealt.mapInArrow(run, TEXTS)


def inventory(found: DataFrame, taken: DataFrame) -> DataFrame:
    """Entries with their identity: of the normal form, or of the bytes where there is no text, or of the path where
    the bytes weren't read. ``taken`` is what ``texts`` gives for them; the texts themselves stay there."""
    outcomes = taken.select("byte_sha256", "text_sha256", "content_source", F.coalesce("reason", F.lit("")).alias("_reason"))
    rows = found.join(outcomes, "byte_sha256", "left")
    reason = F.when(F.col("oversized"), "corrupt_file").otherwise(F.nullif("_reason", F.lit("")))
    failed = reason.isNotNull()
    identity = F.when(F.col("oversized"), F.sha2("path", 256)).when(failed, F.col("byte_sha256")).otherwise(F.col("text_sha256"))
    return rows.select(
        identity.alias("document_id"), "path", "format", F.coalesce("byte_sha256", F.sha2("path", 256)).alias("byte_sha256"),
        "size_bytes", F.coalesce("content_source", F.lit("own")).alias("content_source"),
        F.when(failed, "bytes").otherwise("text").alias("identity_kind"), reason.alias("reason"),
    )
