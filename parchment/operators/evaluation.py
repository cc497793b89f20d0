"""Field accuracy against golden records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import fixed, text

GOLDEN = (
    "files array<string>, doc_type string, counterparty_name string, counterparty_tax_id string, issue_date string, "
    "due_date string, gross_amount string, currency string, summary string"
)


def key_of(field: str, value: Column, exact: bool = True) -> Column:
    """A field's value as it is compared: null equals null."""
    value = value.cast("string")
    if field == "counterparty_name":
        return text.folded_name(value) if exact else F.nullif(F.lower(F.regexp_replace(F.trim(value), r"\s+", " ")), F.lit(""))
    if field == "counterparty_tax_id":
        return text.tax_key(value)
    if field == "gross_amount":
        return text.amount_even(value).cast("string")
    return text.currency_key(value) if field == "currency" else text.plain(value)


def matched(expected: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """Each golden record with the document that its files lead to (the least id if there are several) in ``doc``."""
    numbered = expected.withColumn("_k", F.xxhash64(F.to_json(F.struct(*expected.columns)))).withColumn("_paths", F.transform("files", lambda x: x))
    paths = numbered.select("_k", F.explode("_paths").alias("path")).withColumn("path", text.composed(F.col("path")))
    ids = paths.join(files.select("path", "document_id"), "path").groupBy("_k")
    ids = ids.agg(F.min("document_id").alias("_id"), F.count_distinct("document_id").alias("n_ids"))
    own = documents.select(F.col("id").alias("_id"), F.struct(*fixed.FIELDS, "summary").alias("doc"))
    return numbered.join(ids, "_k", "left").join(own, "_id", "left").drop("_k", "_paths")


def scored(pairs: DataFrame, exact: bool = True) -> DataFrame:
    """``(field, correct, total, accuracy)``: a record without document matches nowhere but counts."""
    flags = [
        F.struct(
            F.lit(f).alias("field"),
            (F.col("doc").isNotNull() & key_of(f, F.col(f), exact).eqNullSafe(key_of(f, F.col(f"doc.{f}"), exact))).alias("ok"),
        )
        for f in fixed.FIELDS
    ]
    each = pairs.select(F.explode(F.array(*flags)).alias("x")).select("x.*")
    out = each.groupBy("field").agg(F.count_if("ok").alias("correct"), F.count("*").alias("total"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total"))


def summary(pairs: DataFrame) -> DataFrame:
    """Records, those without document, those whose files disagree, and hits of the loose summary measure."""
    typed = F.col("doc_type").isNotNull()
    hit = F.col("doc").isNotNull() & text.summary_loose(F.col("doc.summary"), F.col("doc_type"), F.col("counterparty_name"))
    return pairs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("doc").isNull()).alias("not_found"),
        F.count_if(F.coalesce("n_ids", F.lit(0)) > 1).alias("dedup_mismatches"),
        F.count_if(typed & hit).alias("summary_ok"),
        F.count_if(typed).alias("summary_total"),
    )


def text_table(scores: list, head: object) -> str:
    """The evaluation as lines of text."""
    lines = [f"{k}: {head[k]}" for k in ("total", "not_found", "dedup_mismatches")]
    rows = {r["field"]: r for r in scores}
    for f in fixed.FIELDS:
        correct, total = (rows[f]["correct"], rows[f]["total"]) if f in rows else (0, 0)
        lines.append(f"{f:<22} {correct:>6} / {total:<6} {correct / total if total else 1.0:.1%}")
    return "\n".join([*lines, f"summary (loose): {head['summary_ok']} / {head['summary_total']}"])
