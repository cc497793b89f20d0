"""Content identity and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def groups(rows: DataFrame, identity: Column, order_col: str) -> DataFrame:
    """``(identity, representative, copies)``: the first row of each content by ``order_col``, and how many have it."""
    return rows.groupBy(identity.alias("identity")).agg(F.min(order_col).alias("representative"), F.count("*").alias("copies"))


#: Parts over which the rows of one content are dealt when its representative is brought to them.
SALTS = 32


def members(rows: DataFrame, identity: Column, order_col: str) -> DataFrame:
    """``rows`` with ``identity``, ``representative`` and ``copies``: which rows belong together, as rows and not as sets, which
    would put all copies of one content into one cell. Only contents with copies are joined back, and the rows of a content, which may
    be a third of all, are dealt over SALTS tasks."""
    keyed = rows.withColumn("identity", identity)
    several = groups(keyed, F.col("identity"), order_col).where("copies > 1")
    several = several.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(order_col), F.lit(SALTS)).cast("int"))
    out = salted.join(several, ["identity", "_salt"], "left").drop("_salt")
    return out.withColumns({"representative": F.coalesce("representative", order_col), "copies": F.coalesce("copies", F.lit(1).cast("long"))})


def balance(rows: DataFrame, identity: Column) -> DataFrame:
    """Files, different contents and duplicates, in one pass over the groups."""
    per = rows.groupBy(identity.alias("identity")).agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_files"), F.count("*").alias("unique_documents"))
    return out.withColumn("duplicate_files", F.col("input_files") - F.col("unique_documents"))


def absent(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet, one for each key (insert or ignore)."""
    return new.join(known.select(key), key, "left_anti").dropDuplicates([key])
