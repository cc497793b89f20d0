"""Limits and budgets over ordered documents, and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def limited(pending: DataFrame, limit: int | None, attempted: int, id_col: str = "id") -> DataFrame:
    """The first documents by id that a limit over all runs still allows."""
    if limit is None:
        return pending
    return pending.orderBy(id_col).limit(max(limit - attempted, 0))


def running_sum(rows: DataFrame, cost_col: str, id_col: str = "id", ranges: int = 64) -> DataFrame:
    """``rows`` with ``running``, the sum of costs by id, without a task that holds all rows.

    Bounds between ranges of ids are taken from 16 ids a range, those with the least hashes; they depend on the ids alone, so a
    row is in one range wherever the plan works it out. Sums of the ranges (one row each) give every range its offset, and the
    sum within a range is local. Columns of the input keep their names and values.
    """
    sample = [r[0] for r in rows.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(16 * ranges).collect()]
    bounds = sorted(sample)[16::16]
    span, total, before = (fresh(rows, x) for x in ("_range", "_sum", "_before"))
    number = F.array(*[F.lit(x) for x in bounds]).cast(f"array<{rows.schema[id_col].dataType.simpleString()}>")
    ranged = rows.withColumn(span, F.size(F.filter(number, lambda x: x <= F.col(id_col))))
    sums = ranged.groupBy(span).agg(F.sum(cost_col).alias(total))
    earlier = Window.orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(span, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    own = Window.partitionBy(span).orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), span)
    return out.withColumn("running", (F.col(before) + F.sum(cost_col).over(own)).cast("long")).drop(span, before)


def budget_prefix(rows: DataFrame, cost_col: str, budget: int | None, reserved: int, id_col: str = "id", ranges: int = 64) -> DataFrame:
    """Rows up to the first whose running cost by id passes what is left of the budget, with ``running``. Costs must be positive."""
    if budget is None:
        return rows.withColumn("running", F.lit(None).cast("long"))
    return running_sum(rows, cost_col, id_col, ranges).where(F.col("running") <= budget - reserved)


def fresh(rows: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns of ``rows``."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def status_counts(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Report counts in two passes; files = documents + duplicates, documents = done + quarantined + open."""
    n = F.count("*")
    docs = documents.agg(
        n.alias("unique_documents"),
        F.count_if(F.col("status") == "done").alias("processed_ok"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
        F.count_if(F.col("status").isin("pending", "in_progress")).alias("not_started"),
    )
    both = files.agg(F.count("*").alias("input_files")).join(docs)
    return both.withColumn("duplicate_files", F.col("input_files") - F.col("unique_documents"))


def quarantine_by_reason(documents: DataFrame) -> DataFrame:
    return documents.where("quarantine_reason is not null").groupBy("quarantine_reason").agg(F.count("*").alias("n"))


def token_totals(ledger: DataFrame) -> DataFrame:
    """Tokens of all completed calls."""
    done = ledger.where("completed_at is not null")
    return done.agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))


def invoice_totals(lines: DataFrame, by: str, quantity: str, price: str, rate: str) -> DataFrame:
    """``(by, net, vat, gross)``: each line's net and tax rounded half up to cents, then summed; gross is the sum of both."""
    cents = lambda x: F.round(x, 2).cast("decimal(30,2)")
    own = lines.select(by, cents(F.col(quantity).cast("decimal(18,2)") * F.col(price).cast("decimal(18,2)")).alias("net"), F.col(rate).cast("decimal(6,2)").alias("rate"))
    own = own.withColumn("vat", cents(F.col("net").cast("decimal(26,2)") * F.col("rate")))
    sums = own.groupBy(by).agg(F.sum("net").cast("decimal(32,2)").alias("net"), F.sum("vat").cast("decimal(32,2)").alias("vat"))
    return sums.withColumn("gross", (F.col("net") + F.col("vat")).cast("decimal(34,2)"))


def run_costs(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(id, tokens_in, tokens_out, cost)`` of each run from its completed calls, at the prices frozen with it."""
    done = ledger.where("completed_at is not null").groupBy("run_id").agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
    joined = runs.join(done, runs["id"] == done["run_id"], "left")
    tokens_in, tokens_out = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    cost = (tokens_in * F.col("price_input_per_million") + tokens_out * F.col("price_output_per_million")) / 1_000_000
    return joined.select("id", tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"), cost.alias("cost"))


def wall_times(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(id, seconds)``: until a run ended, or its latest ledger time; runs with neither are left out."""
    last = ledger.groupBy("run_id").agg(F.max(F.greatest("completed_at", "reserved_at")).alias("last"))
    ended = runs.join(last, runs["id"] == last["run_id"], "left").withColumn("until", F.coalesce("ended_at", "last"))
    seconds = F.greatest(F.unix_timestamp("until") - F.unix_timestamp("started_at"), F.lit(0))
    return ended.where("until is not null").select("id", seconds.alias("seconds"))


def latest_run(runs: DataFrame) -> DataFrame:
    """Backend, model and stop reason of the latest run; one that never ended was interrupted. No row without runs."""
    reason = F.when(F.col("ended_at").isNull(), "interrupted").otherwise(F.col("stop_reason"))
    last = runs.agg(F.max_by(F.struct("backend", "model", reason.alias("stop_reason")), "id").alias("r"))
    return last.where("r is not null").select("r.*")


def report(files: DataFrame, documents: DataFrame, runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """The whole report as one row, its keys in order."""
    reasons = quarantine_by_reason(documents).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("quarantine_reason", "n")))).alias("quarantine_by_reason")
    )
    tokens = token_totals(ledger)
    cost = run_costs(runs, ledger).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("estimated_cost"))
    wall = wall_times(runs, ledger).agg(F.coalesce(F.sum("seconds"), F.lit(0)).cast("double").alias("wall_time_s"))
    one = documents.sparkSession.range(1)
    last = one.join(latest_run(runs), F.lit(True), "left").select("backend", "model", "stop_reason")
    out = status_counts(documents, files)
    for part in (reasons, tokens, cost, wall, last):  # one row each
        out = out.join(part)
    return out.select(
        "input_files", "duplicate_files", "unique_documents", "processed_ok", "quarantined", "quarantine_by_reason",
        "not_started", "tokens_in", "tokens_out", "estimated_cost", "wall_time_s", "backend", "model", "stop_reason",
    )
