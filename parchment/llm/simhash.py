"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint emits every variant within half the radius. Two fingerprints within the radius have a common
variant half way, so one shuffle on variants brings every such pair together; a variant can meet no more
fingerprints than its ball has members (65 at radius 2), whatever the data. Equal fingerprints are collapsed
first, so groups of copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.components import components
from parchment.llm.store import fresh, written

SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit majority of the XXH64 of each shingle; zero for a text without words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` for each row; a null or wordless text has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def ball(fp: Column, radius: int) -> Column:
    """All values that differ from ``fp`` in at most ``radius`` bits (0, 1 or 2)."""
    bits = F.array(*[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    own = F.array(fp)
    one = F.transform(bits, lambda x: fp.bitwiseXOR(x))
    if radius == 0:
        return own
    if radius == 1:
        return F.concat(own, one)
    later = lambda i: F.slice(bits, i + 2, F.lit(64))
    two = F.flatten(
        F.transform(bits, lambda x, i: F.transform(later(i), lambda y: fp.bitwiseXOR(x).bitwiseXOR(y)))
    )
    return F.concat(own, one, two)


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` between the least ids of different fingerprints; they join all within ``radius`` bits.

    When the radius is even all that meet in a variant are within the radius of each other, so a chain through
    them keeps their component; an odd radius takes the next larger ball and verifies against every member.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    nodes = fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    met = nodes.select("rep", "fp", F.explode(ball(F.col("fp"), (radius + 1) // 2)).alias("variant"))
    if radius % 2 == 0:
        order = Window.partitionBy("variant").orderBy("rep", "fp")
        pairs = met.select("rep", "fp", F.lag("rep").over(order).alias("rep2"), F.lag("fp").over(order).alias("fp2"))
    else:
        other = met.select(F.col("rep").alias("rep2"), F.col("fp").alias("fp2"), "variant")
        pairs = met.join(other, "variant").where("rep2 < rep")
    pairs = pairs.where("rep2 is not null").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    return pairs.select(F.col("rep2").alias("a"), F.col("rep").alias("b")).distinct()


def grouped(fps: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``fps(id, fp)``, joined by equal values and by links between ids."""
    nodes = fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    again = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    same = fps.join(again.select("id"), "id").join(nodes, "fp").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    found = components(pairs.unionByName(same))
    of_fp = nodes.join(found, nodes["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    own = F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    return fps.join(of_fp, "fp", "left").select("id", "fp", own)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for each row of ``docs``.

    component_id is the smallest id reachable over links of at most ``radius`` differing bits, the row's own
    included. Null or wordless texts have fingerprint zero and link like any other. Rows with a null id keep
    their fingerprint, link with nothing and have a null component. Rows that repeat an id are that document
    again: each comes back, and the document's links are those of all its texts. Other columns are not read. An
    empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return grouped(fps, links(fps, radius)).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the least id of their component, one row for an id; rows with a null id stay."""
    return firsts(docs, near_duplicates(docs, id_col, text_col), id_col)


def firsts(docs: DataFrame, near: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` that have the least id of their component in ``near``, one row for an id, and those with a null id."""
    n, own_id = fresh(docs, "_n"), fresh(docs, "_kept")
    kept = near.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(own_id)).distinct()
    own = docs.join(kept, F.col(id_col) == F.col(own_id)).drop(own_id)
    sortable = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    order = Window.partitionBy(id_col).orderBy(*[sortable(f) for f in docs.schema.fields if f.name != id_col])
    first = own.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)
    return first.unionByName(docs.where(F.col(id_col).isNull()))
