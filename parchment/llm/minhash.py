"""Near copies by the Jaccard similarity of their sets of word shingles.

Minimum hashes find candidates: texts that agree in all rows of a band meet in its bucket, and two texts of
similarity s miss each other in every band with probability (1 - s^ROWS)^BANDS, 3e-5 at 0.8. All pairs of a bucket
are then verified by their whole sets, so no link is below the threshold. Texts of one set are collapsed first. A
bucket larger than a block is first verified within its blocks; then what is outside its largest component is
verified against the whole bucket, so a crowd of near copies costs in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm import simhash
from parchment.llm.components import components
from parchment.llm.store import written
from parchment.llm.text import buffers, mix, pieces, whitespace_classes, words

#: Members of a bucket that are compared in one piece.
BLOCK = 512
#: Words of a shingle, and the similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
_KEYS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
_XOR, _ODD = _KEYS[: BANDS * ROWS], _KEYS[BANDS * ROWS :] | np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each text's distinct shingles, end to end, and where each text's begin.

    Words are parted by the six ASCII spaces, A-Z folded; a text of fewer words is one shingle, without words none.
    """
    found = words(*buffers(texts), whitespace_classes(), lower=True)
    n, row = len(found.hashes), found.row
    last = found.first[1:][row]
    at = np.arange(n)
    begins = np.flatnonzero((at + shingle <= last) | (at == found.first[:-1][row]))
    grams = np.zeros(len(begins), np.uint64)
    for k in range(shingle):
        inside = begins + k < last[begins]
        grams = grams * _MULT + np.where(inside, found.hashes[np.minimum(begins + k, max(n - 1, 0))], np.uint64(0))
    grams, row = mix(grams), row[begins]
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(found.first)))


def band_keys(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` bucket keys for each set; those of empty sets are zero."""
    out = np.zeros((len(first) - 1, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        for band in range(BANDS):
            key = np.full(len(some), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = mix(key ^ np.minimum.reduceat((grams ^ _XOR[k]) * _ODD[k], first[some]))
            out[some, band] = key
    return out


def alike(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join all of ``sets`` whose similarity is ``least`` or more; two empty sets are alike."""
    sizes = np.array([len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column, owner = (np.cumsum(shared) - 1)[code], np.repeat(np.arange(len(sets)), sizes)
    column, owner = column[shared[code]], owner[shared[code]]
    both = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        has = np.zeros((len(sets), min(4096, int(shared.sum()) - low)), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        both += has @ has.T
    found, parent = [], list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    # the least exact in floats: of whole numbers below 2^24, and a margin far below the step between two ratios
    for a, b in np.argwhere(np.triu(both >= least * (sizes[:, None] + sizes - both) - 1e-6, 1)).tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((a, b))
    return found


def digests(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set; zero for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ _XOR[0]))])
    return np.where(np.diff(first) > 0, mix(total[first[1:]] - total[first[:-1]]), np.uint64(0)).view(np.int64)


def shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp, keys)`` for each row of ``docs``: a hash of its set of shingles, and the buckets of the set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                grams, first = shingle_sets(part.column(1))
                ends = pa.array(np.arange(len(first), dtype=np.int32) * BANDS)
                keys = pa.ListArray.from_arrays(ends, pa.array(band_keys(grams, first).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests(grams, first)), keys], names=["id", "fp", "keys"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, fp long, keys array<long>")


def _sets(wanted: DataFrame) -> DataFrame:
    """``(fp, grams)``: the sorted hashes of the texts of ``wanted(fp, text)`` whose set has the hash ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                grams, first = shingle_sets(part.column(1))
                sets = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(grams)])
                own = pa.array(digests(grams, first) == part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["fp", "grams"]).filter(own)

    return wanted.select("fp", "text").mapInArrow(run, "fp long, grams binary")


def _verified(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(fp, fp2)`` between the members of each group ``(key, i, j)`` of ``met``."""

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        fps, at = np.unique(table["fp"].to_numpy(), return_index=True)
        grams = table["grams"].combine_chunks()
        pairs = alike([np.frombuffer(grams[int(k)].as_py(), np.uint64) for k in at]) if len(at) > 1 else []
        ends = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fps[ends[:, 0]]), pa.array(fps[ends[:, 1]])], names=["fp", "fp2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(group[a])
                if held and now != last:
                    yield links(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield links(held)

    rows = met.select("key", F.col("i").cast("long"), F.col("j").cast("long"), "fp").join(sets, "fp")
    rows = rows.select("key", "i", "j", "fp", "grams").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(run, "fp long, fp2 long").distinct()


def simhash_buckets(docs: DataFrame, shingles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(fp, key)``: a bucket for every variant within one bit of the SimHash of a set's text, over the same shingles.

    Sets whose fingerprints differ in two bits at most meet in one. Rows that repeat an id share their buckets.
    """
    prints = simhash.fingerprints(docs, id_col, text_col, SHINGLE).where("id is not null").select("id", F.col("fp").alias("bits")).distinct()
    of_set = shingles.where("id is not null and fp <> 0").select("id", "fp").join(prints, "id").select("fp", "bits").distinct()
    variants = of_set.select("fp", F.explode(simhash.ball(F.col("bits"), 1)).alias("variant"))
    return variants.select("fp", F.xxhash64(F.lit("simhash"), "variant").alias("key"))


def links(shingles: DataFrame, texts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Links ``(fp, fp2)`` that join all sets of ``shingles`` that meet in a bucket, also one of ``more(fp, key)``, and are alike.

    Only the ``texts(id, text)`` that share a bucket are turned into sets.
    """
    known = shingles.where("id is not null")
    nodes = known.groupBy("fp").agg(F.min("id").alias("id"))
    keys = known.where("fp <> 0").select("fp", F.explode(F.array_distinct("keys")).alias("key"))
    keys = (keys if more is None else keys.unionByName(more)).distinct()
    same = [F.bit_xor(F.xxhash64("fp", F.lit(k))) for k in (0, 1)]
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), same[0].alias("x"), same[1].alias("y")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key"))  # those of the same members once
    place = F.row_number().over(Window.partitionBy("key").orderBy("fp")) - 1
    met = written(keys.join(buckets.select("key", "n"), "key").withColumn("i", F.floor(place / BLOCK)), "buckets")
    wanted = nodes.join(met.select("fp").distinct(), "fp")
    sets = written(_sets(texts.join(wanted, "id")), "sets")
    found = written(_verified(met.withColumn("j", F.lit(-1)), sets), "alike")
    large = met.where(F.col("n") > BLOCK).drop("i")
    if large.isEmpty():
        return found
    of = components(found.select(F.col("fp").alias("a"), F.col("fp2").alias("b")))
    large = large.join(of, large["fp"] == of["node"], "left").select("key", "fp", F.coalesce("component", "fp").alias("component"))
    sizes = large.groupBy("key", "component").count()
    most = sizes.groupBy("key").agg(F.max(F.struct("count", "component"))["component"].alias("most"), F.count("*").alias("parts"))
    large = written(large.join(most.where("parts > 1").drop("parts"), "key"), "large")
    order = F.row_number().over(Window.partitionBy("key").orderBy("fp")) - 1
    rest = large.where("component <> most").select("key", "fp", F.floor(order / BLOCK).alias("i"))
    every = large.select("key", "fp", F.floor(order / BLOCK).alias("j"))
    blocks = rest.select("key", "i").distinct().join(every.select("key", "j").distinct(), "key")
    pairs = rest.join(blocks, ["key", "i"]).select("key", "i", "j", "fp").unionByName(every.join(blocks, ["key", "j"]).select("key", "i", "j", "fp"))
    return found.unionByName(written(_verified(pairs, sets), "alike"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_simhash: bool = False) -> DataFrame:
    """The rows of ``docs`` with the least id of each group of near copies, one row for an id; rows with a null id stay.

    With ``by_simhash`` sets that meet in a SimHash variant are candidates too.
    """
    shingles = written(shingled(docs, id_col, text_col), "shingles")
    nodes = shingles.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    other = nodes.select(F.col("fp").alias("fp2"), F.col("rep").alias("b"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = written(simhash_buckets(docs, shingles, id_col, text_col), "simhash-buckets") if by_simhash else None
    pairs = links(shingles, texts, more).join(nodes, "fp").join(other, "fp2").select(F.col("rep").alias("a"), "b")
    near = simhash.grouped(shingles.select("id", "fp"), pairs)
    return simhash.firsts(docs, near.select(F.col("id").alias(id_col), "component_id"), id_col)
