"""Files that keep arriving in a folder, as a stream into the state.

The stream's source tells paths and lengths only; contents are pruned from its scan and read by the same tasks as in a run.
Its checkpoint remembers which files were taken, and a batch's name is its number, so one that is replayed after a failure
adds nothing twice. Content identity is global, so there is no watermark: what is known is asked of the state. Spark's file
sources pass over files of zero bytes; the scan that every run begins with adds those.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from parchment.functions import fixed
from parchment.operators import runs
from parchment.sources import archive

FILES = "path string, modificationTime timestamp, length long, content binary"


def hashed(arrived: DataFrame, root: str, ceiling: int = fixed.MAX_ENTRY_BYTES) -> DataFrame:
    """The entries of files given as ``(path, length)``, with paths relative to ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = archive.Opened(root)
        for batch in batches:
            for row in batch.to_pylist():
                place = unquote(urlparse(row["path"]).path)
                name = unicodedata.normalize("NFC", Path(place).relative_to(root).as_posix())
                own = archive.hashed(opened, name, place, row["length"], ceiling)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, kinds, strict=True)], names=names)

    names = [x.split()[0] for x in archive.ENTRIES.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    return arrived.select("path", "length").mapInArrow(run, archive.ENTRIES)


def ingest(state: runs.State, folder: str, checkpoint: str, files_a_batch: int = 10_000, **trigger: object) -> StreamingQuery:
    """Add the files of ``folder`` to the inventory as they come; by default those that are there now."""
    stream = state.spark.readStream.format("binaryFile").schema(FILES)
    stream = stream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)

    def take(batch: DataFrame, number: int) -> None:
        runs.add_files(state, hashed(batch, folder), folder, f"stream-{number:012d}")

    writer = stream.select("path", "length").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
