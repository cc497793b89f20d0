"""Labelled rows for the classifiers, and the split that keeps held-out labels unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


#: Bytes of the longest text that is fitted; with the bound on rows it bounds what reaches the driver.
LONGEST = 1 << 16


def training_rows(
    docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, most: int, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``(id, text, *carry, label)`` of at most ``most`` labelled rows outside the held-out fold.

    The bound is for fitting alone. Rows are taken in the order of a hash of their id, half of ``most`` from each
    label where there are so many, so the choice depends neither on partitions nor on the order of rows. Null labels, ids
    and texts are passed over; of an id that is labelled twice the larger label counts. Rows
    whose text is longer than LONGEST bytes are not fitted (they are scored like any other).
    """
    usable = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).where(
        fold(F.col("doc_id"), folds) != held_out
    )
    usable = usable.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(target).cast("int")).alias("label"))
    key = F.xxhash64("id")
    parts = [usable.where(F.col("label") == v).orderBy(key, "id").limit(most // 2) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.where(F.octet_length("text") <= LONGEST).select(F.col("doc_id").alias("id"), "text", *carry)
    return texts.join(F.broadcast(chosen), "id")  # most rows of 12 bytes
