"""Web archives packed in ZIP files: written part by part, read by ranges without extraction.

Each part of the pages becomes one ZIP with two stored members: ``archive/data.warc.gz``, a gzip member per WARC record, and
``indexes/index.cdxj``, a line per record with its place. The reader finds the members with records and the indexes of any such
archive through its central directory (ZIP64 included), plans ranges of records from the indexes, and deals the ranges over
tasks, each of which reads its bytes of the archive itself.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.store import new_path, open_fs

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of one read of the archive at most, unless a record is longer, and of the records that a task is given at a time.
READ_BYTES, TASK_BYTES = 4 << 20, 64 << 20
#: Parts that the rows of one repeated payload are dealt over.
SALTS = 32

MANIFEST = "path string, bytes long, records long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, sha: str, length: int, refers_to: int | None
) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to`` given) has no block but names digest and length."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}:{sha}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {length}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page: {refers_to}")
        payload = b""
    head.append("Content-Type: text/html; charset=utf-8")
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("truncated WARC record")
    return fields, rest[:n]


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """The entity of a block that is an HTTP message, or the whole block."""
    if head.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


# ---- ZIP


class Range:
    """Byte ranges of a file in any file system."""

    def __init__(self, path: str) -> None:
        fs, at = open_fs(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ValueError("range outside the archive")
        return self.file.read_at(n, at)


def directory(source: Range) -> dict[str, tuple[int, int, int, int]]:
    """Members by name: (method, place of the local header, stored bytes, full bytes), from the central directory.

    Raises ValueError for what isn't a ZIP, is cut short, or spans several disks.
    """
    tail_at = max(0, source.size - (1 << 16) - 22)
    tail = source.read(tail_at, source.size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    disk, _, _, count, size, begin = struct.unpack_from("<HHHHII", tail, at + 4)
    here = tail_at + at
    if here >= 20 and (locator := source.read(here - 20, 20))[:4] == b"PK\x06\x07":
        end64 = struct.unpack_from("<Q", locator, 8)[0]
        record = source.read(end64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end of central directory")
        disk = struct.unpack_from("<I", record, 16)[0]
        count, size, begin = struct.unpack_from("<QQQ", record, 32)
    if disk:
        raise ValueError("archive over several disks")
    table, p, out = source.read(begin, size), 0, {}
    for _ in range(count):
        if table[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        flags, method = struct.unpack_from("<HH", table, p + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", table, p + 20)
        local = struct.unpack_from("<I", table, p + 42)[0]
        name = table[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = table[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # ZIP64: 8 bytes for each field that is all ones, in this order
                at64 = q + 4
                if full == 0xFFFFFFFF:
                    full, at64 = struct.unpack_from("<Q", extra, at64)[0], at64 + 8
                if packed == 0xFFFFFFFF:
                    packed, at64 = struct.unpack_from("<Q", extra, at64)[0], at64 + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", extra, at64)[0]
            q += 4 + n
        out[name] = (method, local, packed, full)
        p += 46 + n_name + n_extra + n_note
    return out


def member_range(source: Range, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes lie in the archive."""
    method, local, packed, full = entry
    if method != 0 or packed != full:
        raise ValueError("member isn't stored")
    head = source.read(local, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return local + 30 + n_name + n_extra, full


def inflated(data: bytes) -> bytes:
    """All gzip members of ``data``, or ``data`` itself if it isn't gzip."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        one = zlib.decompressobj(31)
        parts.append(one.decompress(data) + one.flush())
        data = one.unused_data.lstrip(b"\0")
    return b"".join(parts)


def index_places(data: bytes) -> Iterator[tuple[str, int, int]]:
    """``(file, offset, length)`` of each line of an index: JSON after a key and a time, or fields named by a first line."""
    letters: list[str] = []
    for line in inflated(data).decode("utf-8").splitlines():
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]
        elif "{" in line and not letters:
            own = json.loads(line[line.index("{") :])
            if "offset" in own:  # other lines describe the index
                yield own.get("filename", ""), int(own["offset"]), int(own["length"])
        elif line.strip():
            own = dict(zip(letters, line.split(), strict=False))
            if not {"V", "S"} <= set(own):
                raise ValueError("index without offsets and lengths")
            yield own.get("g", ""), int(own["V"]), int(own["S"])


def places(source: Range) -> list[tuple[int, int]]:
    """Where the records of an archive lie, ``(offset, length)`` in the archive, in this order. Every member that holds records
    must be in an index, except an empty one; the members are found by their names' ends, an index's file by its last part."""
    found = directory(source)
    ends = lambda *kinds: [n for n in found if n.lower().endswith(kinds)]
    members = {n: member_range(source, found[n]) for n in ends(".warc", ".warc.gz")}
    by_last = {n.rpartition("/")[2]: n for n in members}
    if len(by_last) < len(members):
        raise ValueError("two members with records have one name")
    out, seen = [], set()
    for name in ends(".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"):
        for file, offset, length in index_places(source.read(*member_range(source, found[name]))):
            member = by_last.get(file.rpartition("/")[2]) if file else next(iter(members), None) if len(members) == 1 else None
            if member is None:
                raise ValueError(f"index names a file that isn't there: {file!r}")
            base, total = members[member]
            if offset < 0 or length < 1 or offset + length > total:
                raise ValueError("index points outside its archive")
            seen.add(member)
            out.append((base + offset, length))
    bare = [n for n, (_, total) in members.items() if total and n not in seen]
    if bare:
        raise ValueError(f"no index for {', '.join(bare)}")
    return sorted(set(out))


def ranges(found: list[tuple[int, int]], most: int = TASK_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Runs of places whose records add up to ``most`` bytes, or one record."""
    own: list[tuple[int, int]] = []
    size = 0
    for at, n in found:
        if own and size + n > most:
            yield own
            own, size = [], 0
        own.append((at, n))
        size += n
    if own:
        yield own


def records_at(source: Range, found: list[tuple[int, int]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records at these places, by reads of READ_BYTES or one record at least."""
    k = 0
    while k < len(found):
        begin, end, j = found[k][0], sum(found[k]), k + 1
        while j < len(found) and found[j][0] <= end and sum(found[j]) - begin <= READ_BYTES:
            end, j = max(end, sum(found[j])), j + 1
        block = memoryview(source.read(begin, end - begin))
        for at, n in found[k:j]:
            yield parse_record(inflated(bytes(block[at - begin : at - begin + n])))
        k = j


class ArchiveWriter:
    """One ZIP of records; it appears under its name only when whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, at = open_fs(folder)
        self.fs.create_dir(at, recursive=True)
        self.path, self.own, self.temp = f"{folder}/{name}", f"{at}/{name}", f"{at}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.lines, self.at = [], 0

    def add(self, data: bytes, key: int | None, url: str | None) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.member.write(packed)
        own = {"url": url, "page": key, "filename": RECORDS.rpartition("/")[2], "offset": self.at, "length": len(packed)}
        self.lines.append(f"{'-' if key is None else key} 19700101000000 {json.dumps(own)}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.out.close()
        self.fs.move(self.temp, self.own)
        return self.path, self.at, len(self.lines)


# ---- Spark


def with_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``(page_id, url, payload, sha, refers_to)``: refers_to is the largest page_id with an equal payload, where
    that isn't the row's own.

    Payloads are grouped by SHA-1 (partial aggregates, one row a digest). Only digests that repeat are joined back,
    and the pages, which are the large side, are dealt by digest and salt, so a page that is a third of the table
    still spreads over SALTS tasks. Rows with a null page_id, and payloads under ``min_payload``, neither are
    referred to nor refer.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    able = rows.where(f"page_id is not null and octet_length(payload) >= {int(min_payload)}")
    last = able.groupBy("sha").agg(F.max("page_id").alias("last"), F.min("page_id").alias("least"))
    last = last.where("last <> least").select("sha", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(last, ["sha", "salt"], "left")
    refers = F.when(
        (F.col("last") != F.col("page_id")) & (F.octet_length("payload") >= min_payload), F.col("last")
    )
    return joined.select("page_id", "url", "payload", "sha", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as ZIP archives in a folder that the cluster shares.

    Returns the manifest ``(path, bytes, records)``, already written beside the archives. A task writes under a
    name of its own and moves the whole file into place, so a task that runs again replaces its file by an equal one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = None
        for batch in batches:
            for page_id, url, payload, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or ArchiveWriter(folder, f"part-{TaskContext.get().partitionId():06d}.zip")
                name = base64.b32encode(sha).decode()
                out.add(record_bytes(page_id, url, payload, name, len(payload), refers_to), page_id, url)
        if out:
            path, n, count = out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([n], pa.int64()), pa.array([count], pa.int64())],
                names=["path", "bytes", "records"],
            )

    spark = pages.sparkSession
    with_revisits(pages, min_payload).mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def planned(manifest: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``(path, at, n)``: ranges of the records in the archives that ``manifest(path, bytes)`` names, dealt over as many tasks
    as there are archives at least, and more where archives are larger than ``task_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for part in ranges(places(Range(path)), task_bytes):
                    at, n = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], names=["path", "at", "n"])

    size = F.ceil(F.coalesce(F.col("bytes"), F.lit(0)) / task_bytes)
    tasks, archives = manifest.agg(F.sum(F.greatest(size, F.lit(1))), F.count("*")).first()
    paths = manifest.select("path").repartition(max(1, archives), "path")
    found = paths.mapInArrow(run, "path string, at array<long>, n array<long>")
    return found.repartition(max(1, int(tasks or 0)), "path", F.element_at("at", 1))


def read_archives(manifest: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows of every record in the archives that ``manifest.path`` names; responses and revisits, other records apart.

    A response's length and digest come from its payload as read, and are checked against its header if that gives them; a
    revisit's are those its header gives. page_id and refers_to are null in archives that weren't written here. Raises
    ValueError for what isn't such an archive and for records without an index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
            + [("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
        )
        whole = lambda x: None if x is None else int(x)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for path, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for head, block in records_at(Range(path), list(zip(at, n, strict=True))):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    size, sha = whole(head.get("x-payload-length")), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response":
                        payload = payload_of(head, block)
                        if size not in (None, len(payload)) or sha not in (None, digest(payload)):
                            raise ValueError(f"a payload in {path} isn't what its header says")
                        size, sha = len(payload), digest(payload)
                    rows.append((whole(head.get("x-page-id")), size, sha, kind, whole(head.get("x-refers-to-page")), head.get("warc-target-uri")))
                    if len(rows) >= 4096:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    return planned(manifest, task_bytes).mapInArrow(run, ROWS)


def archived(spark: SparkSession, pages: DataFrame, min_payload: int = 0, folder: str | None = None) -> DataFrame:
    """Write the pages and read the archives back.

    One row per page. Null html is an empty payload; equal payloads of at least ``min_payload`` bytes become
    revisits of the one with the largest page_id. Rows with a null page_id are plain responses. Rows that repeat a
    page_id are each kept; those of the largest page_id are all responses. Other columns are not read. An empty
    table gives no archive and no row.
    """
    return read_archives(write_archives(pages, folder or new_path(spark, "archives"), min_payload))
