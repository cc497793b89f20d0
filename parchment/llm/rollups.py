"""Token counts as delta-maintained rollups.

A state folder holds, for each batch, the document counts that it changed and the signed changes of totals by source,
language and tokenizer version. Totals are sums of committed changes; they are never recounted. A batch appears at once, by a
rename: one that failed leaves no trace, one that is committed is left alone when it is applied again.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
ROWS = "bucket int, doc_id long, source string, lang string, version string, tokens long, live boolean, batch long"
#: Ranges of documents; a batch reads the counts of those that it touches.
BUCKETS = 4096
DELTAS = "source string, lang string, version string, d_docs long, d_tokens long"


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


def default_ranks_path(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.tiktoken"))


@lru_cache(2)
def _encoder(ranks: bytes):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def counted(docs: DataFrame, version: str, ranks_path: str | None = None) -> DataFrame:
    """Inserts ``(doc_id, op, source, lang, version, tokens)`` with each whole text's byte-level BPE tokens; 0 for null."""
    with open(ranks_path or default_ranks_path(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value).encode_to_numpy
        for batch in batches:
            n = [len(encode(x.as_py())) if x.is_valid else 0 for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    out = rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return out.select("doc_id", F.lit("upsert").alias("op"), "source", "lang", F.lit(version).alias("version"), "tokens")


class Rollup:
    """Totals of token counts under changes, in a folder that the cluster shares.

    ``log/<slot>/batch-<id>`` holds a batch's rows and signed deltas. A batch is prepared aside and committed by one rename
    to the next free slot; a writer that finds the slot taken works its deltas out again from what was committed meanwhile.
    Slots say in which order deltas were worked out, batch ids say which of several counts of a document holds: the one of
    the greatest batch, whatever the order of commits.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(self.root).getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), conf)
        self.plainly = spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        self.fs.mkdirs(self.hadoop.Path(f"{self.root}/log"))

    def slots(self) -> list[tuple[int, int, str]]:
        """(slot, batch, path) of what is committed; the batch of a compaction is -1."""
        found = self.fs.globStatus(self.hadoop.Path(f"{self.root}/log/*/*")) or []
        paths = [x.getPath() for x in found]
        out = [(int(x.getParent().getName()), x.getName(), x.toString()) for x in paths]
        return sorted((slot, -1 if name == "compacted" else int(name.removeprefix("batch-")), path) for slot, name, path in out)

    def committed(self) -> list[int]:
        return sorted(batch for _, batch, _ in self.slots() if batch >= 0)

    def _table(self, kind: str, schema: str, slots: list[tuple[int, int, str]]) -> DataFrame:
        """What the slots hold, from the last compaction on."""
        since = max((slot for slot, batch, _ in slots if batch < 0), default=-1)
        paths = [f"{path}/{kind}" for slot, _, path in slots if slot >= since]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _latest(self, slots: list[tuple[int, int, str]], touched: list[int] | None = None) -> DataFrame:
        """``(bucket, doc_id, version, v)``: the count, or its absence, that holds for each document and version ever named."""
        rows = self._table("rows", ROWS, slots)
        if touched is not None:
            rows = rows.where(F.col("bucket").isin(touched))  # files are sorted by bucket, so most of them are passed over
        value = F.struct("batch", "source", "lang", "tokens", "live")
        return rows.groupBy("bucket", "doc_id", "version").agg(F.max_by(value, "batch").alias("v"))

    def current(self) -> DataFrame:
        """The live count of each document and version."""
        return self._latest(self.slots()).where("v.live").select("doc_id", "version", "v.source", "v.lang", "v.tokens")

    def totals(self) -> DataFrame:
        """``(source, lang, version, n_docs, n_tokens)``: sums of the committed changes; groups without documents go."""
        sums = self._table("deltas", DELTAS, self.slots()).groupBy(*KEYS)
        sums = sums.agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit ``changes(doc_id, op, source, lang, version, tokens[, seq])``; False if the batch was committed before.

        op "upsert" inserts a count or revises the one there, moving it if its source or language differ; "delete" takes
        it away, or does nothing if there is none. Of several changes to a document and version, that with the greatest
        seq counts; without seq, or at a tie, the one with most tokens, a delete before any upsert. Null sources and
        languages are groups of their own. Changes with a null doc_id or version are skipped. Null tokens count 0. A batch
        without changes is committed like any other. Batches have ids from 0 on; one that comes late changes only documents
        that no greater batch names, so totals don't depend on the order of commits. Two writers of one batch commit it once.
        """
        if batch < 0:
            raise ValueError("batch ids start at 0")
        if batch in self.committed():
            return False
        aside = f"{self.root}/aside/{batch}-{uuid.uuid4().hex}"
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        rank = F.struct(seq.cast("long").alias("s"), (F.col("op") == "delete").alias("d"), F.coalesce("tokens", F.lit(0)).cast("long").alias("t"), "source", "lang")
        news = (
            changes.where("doc_id is not null and version is not null")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version")
            .agg(F.max(rank).alias("n"))
            .select(bucket(F.col("doc_id")).alias("bucket"), "doc_id", "n.source", "n.lang", "version", F.col("n.t").alias("tokens"), (~F.col("n.d")).alias("live"), F.lit(batch).cast("long").alias("batch"))
        )
        # a delete of what isn't there is kept too: an earlier batch may come later
        news.repartition("bucket").sortWithinPartitions("bucket").write.parquet(f"{aside}/rows")
        news = self.spark.read.schema(ROWS).parquet(f"{aside}/rows")
        touched = [r[0] for r in news.select("bucket").distinct().collect()]  # BUCKETS at most
        while True:
            slots = self.slots()
            if any(b == batch for _, b, _ in slots):
                self.fs.delete(self.hadoop.Path(aside), True)
                return False
            self._deltas(news, slots, touched).write.mode("overwrite").parquet(f"{aside}/deltas")
            if self._commit(aside, max((slot for slot, _, _ in slots), default=-1) + 1, f"batch-{batch}"):
                return True

    def _deltas(self, news: DataFrame, slots: list[tuple[int, int, str]], touched: list[int]) -> DataFrame:
        if slots:
            olds = self._latest(slots, touched if len(touched) < BUCKETS else None)
            both = news.join(olds.select("bucket", "doc_id", "version", F.col("v").alias("old")), ["bucket", "doc_id", "version"], "left")
            both = both.where("old is null or old.batch < batch")
        else:
            both = news.withColumn("old", F.lit(None).cast("struct<batch:bigint,source:string,lang:string,tokens:bigint,live:boolean>"))
        part = lambda sign, row: F.struct(row("source").alias("source"), row("lang").alias("lang"), F.lit(sign).cast("long").alias("d"), (sign * row("tokens")).alias("n"))
        parts = F.array(F.when(F.col("old.live"), part(-1, lambda c: F.col(f"old.{c}"))), F.when(F.col("live"), part(1, F.col)))
        signed = both.select("version", F.explode(F.array_compact(parts)).alias("p"))
        return signed.groupBy("p.source", "p.lang", "version").agg(F.sum("p.d").alias("d_docs"), F.sum("p.n").alias("d_tokens"))

    def _commit(self, aside: str, slot: int, name: str) -> bool:
        """Move what was prepared to a slot; False if the slot is taken."""
        staged = f"{aside}-{slot}"
        self.fs.mkdirs(self.hadoop.Path(staged))
        self.fs.rename(self.hadoop.Path(aside), self.hadoop.Path(f"{staged}/{name}"))
        try:
            self.context.rename(self.hadoop.Path(staged), self.hadoop.Path(f"{self.root}/log/{slot:012d}"), self.plainly)
        except Py4JJavaError:
            if not self.fs.exists(self.hadoop.Path(f"{self.root}/log/{slot:012d}")):
                raise
            self.fs.rename(self.hadoop.Path(f"{staged}/{name}"), self.hadoop.Path(aside))
            self.fs.delete(self.hadoop.Path(staged), True)
            return False
        return True

    def compact(self) -> bool:
        """Put what holds now into one slot, so that readers need nothing before it; False if another commit came between."""
        slots, aside = self.slots(), f"{self.root}/aside/compacted-{uuid.uuid4().hex}"
        rows = self._latest(slots).select("bucket", "doc_id", "v.source", "v.lang", "version", "v.tokens", "v.live", "v.batch")
        rows.repartition("bucket").sortWithinPartitions("bucket").write.parquet(f"{aside}/rows")
        sums = self._table("deltas", DELTAS, slots).groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.write.parquet(f"{aside}/deltas")
        done = self._commit(aside, max((slot for slot, _, _ in slots), default=-1) + 1, "compacted")
        if not done:
            self.fs.delete(self.hadoop.Path(aside), True)
        return done


def copies(docs: DataFrame, *versions: str) -> DataFrame:
    """Deletes, in each version, for documents whose whole text an earlier document has (null texts apart).

    A row goes unless its id is the least of its text. That is asked by id and text, never by text alone, so a group of
    copies, however large, is spread over all tasks.
    """
    sha = F.unhex(F.sha2("text", 256))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha")).where("doc_id is not null and sha is not null")
    first = keyed.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    none = F.lit(None).cast("string")
    gone = keyed.join(first, ["doc_id", "sha"], "left_anti").select("doc_id").distinct()
    each = F.explode(F.array(*[F.lit(v) for v in versions]))
    return gone.select("doc_id", F.lit("delete").alias("op"), none.alias("source"), none.alias("lang"), each.alias("version"), F.lit(0).cast("long").alias("tokens"))


def revised(rollup: Rollup, version: str) -> DataFrame:
    """Revisions of all live counts of one version: an end-of-text token more for each document with any, and documents without
    any move to the source "empty"."""
    live = rollup.current().where(F.col("version") == version)
    some = F.col("tokens") > 0
    return live.select("doc_id", F.lit("upsert").alias("op"), F.when(some, F.col("source")).otherwise("empty").alias("source"), "lang", "version", (F.col("tokens") + some.cast("long")).alias("tokens"))
