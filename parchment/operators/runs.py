"""Runs over an append-only state: inventory, budgeted inference, validation, and their restart."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import fixed, text
from parchment.operators import inference, ledger, tokens, windowing
from parchment.operators.identity import absent
from parchment.operators.validation import validated
from parchment.sources import archive
from parchment.sources.config import Config

TABLES = {
    "files": "path string, format string, byte_sha256 string, size_bytes long, document_id string, content_source string, discovered_at timestamp",
    "inventory": "id string, identity_kind string, quarantine_reason string, source_text string, created_at timestamp",
    "reservations": "run_id long, document_id string, attempt int, reserved_at timestamp, reserved_tokens long",
    "usages": "run_id long, document_id string, attempt int, tokens_in long, tokens_out long, completed_at timestamp, raw string, error_kind string",
    "outcomes": "document_id string, run_id long, attempt int, status string, doc_type string, counterparty_name string, counterparty_tax_id string, "
    "issue_date date, due_date date, gross_amount decimal(20,2), currency string, summary string, backend string, model string, created_at timestamp",
    "runs_started": "id long, started_at timestamp, workers int, limit_docs long, budget_tokens long, backend string, model string, config_path string, "
    "input_path string, price_input_per_million double, price_output_per_million double",
    "runs_finished": "id long, ended_at timestamp, stop_reason string",
}


class State:
    """Tables of Parquet batches; a batch is a folder that appears at once, so a table never shows half of one."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.path = hadoop.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(conf)
        self.context = hadoop.FileContext.getFileContext(self.fs.getUri(), conf)
        self.plainly = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)

    def read(self, table: str) -> DataFrame:
        at = self.path(f"{self.root}/{table}")
        found = [x.getPath().toString() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []
        if not found:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*found)

    def append(self, table: str, rows: DataFrame, batch: str, taken: bool = True) -> DataFrame:
        """Add a batch under a name of its own; a batch that is there already stays, or is an error unless it may be ``taken``.

        The rename to the name is refused if another writer has it by then, so of two writers one wins.
        """
        final, temp = f"{self.root}/{table}/{batch}", f"{self.root}/_writing/{table}-{batch}-{uuid.uuid4().hex}"
        if not self.fs.exists(self.path(final)):
            names = [x.strip().split()[0] for x in TABLES[table].replace("(20,2)", "").split(", ")]
            rows.select(*names).write.parquet(temp)
            self.fs.mkdirs(self.path(f"{self.root}/{table}"))
            try:
                self.context.rename(self.path(temp), self.path(final), self.plainly)
                taken = True
            except Py4JJavaError:
                if not self.fs.exists(self.path(final)):
                    raise
        if not taken:
            raise FileExistsError(final)
        return self.spark.read.schema(TABLES[table]).parquet(final)

    def documents(self) -> DataFrame:
        """The last outcome of each document; without one it is pending, or quarantined by its inventory."""
        last = self.read("outcomes").groupBy("document_id").agg(
            F.max_by(F.struct("status", *fixed.FIELDS, "summary", "backend", "model"), F.struct("run_id", "attempt")).alias("o")
        )
        joined = self.read("inventory").join(last, F.col("id") == F.col("document_id"), "left")
        status = F.when(F.col("quarantine_reason").isNotNull(), "quarantined").otherwise(F.coalesce("o.status", F.lit("pending")))
        reason = F.coalesce("quarantine_reason", F.when(F.col("o.status") == "quarantined", "llm_invalid_output"))
        return joined.select(
            "id", "identity_kind", status.alias("status"), reason.alias("quarantine_reason"), "source_text",
            *[F.col(f"o.{c}").alias(c) for c in (*fixed.FIELDS, "summary", "backend", "model")],
        )

    def runs(self) -> DataFrame:
        return self.read("runs_started").join(self.read("runs_finished"), "id", "left")

    def ledger(self) -> DataFrame:
        key = ["run_id", "document_id", "attempt"]
        return self.read("reservations").join(self.read("usages").drop("raw", "error_kind"), key, "left")


def take_inventory(state: State, input_path: str, **options: object) -> None:
    """Add the files and documents of an archive that aren't known; the first mapping of a path stays."""
    seconds = float(options.pop("timeout", fixed.EXTRACT_SECONDS))
    found = archive.entries(state.spark, input_path, **options)
    add_files(state, found, input_path, f"{time.time_ns():020d}", seconds, int(options.get("partitions", 8)))


def add_files(state: State, found: DataFrame, root: str, batch: str, seconds: float = fixed.EXTRACT_SECONDS, partitions: int = 8) -> None:
    """Add hashed files as one batch. Known paths are left alone, and known bytes are not read again.

    Documents are written before the files that name them: a batch that broke off between is completed by the next.
    """
    now = F.current_timestamp()
    known = state.read("files")
    fresh = state_table(state, absent(found, known, "path"), f"scan-{batch}")
    by_bytes = known.groupBy("byte_sha256").agg(F.min(F.struct("document_id", "content_source")).alias("k")).select("byte_sha256", "k.*")
    unread = fresh.join(by_bytes.select("byte_sha256"), "byte_sha256", "left_anti")
    taken = state_table(state, archive.texts(unread, root, seconds, partitions), f"texts-{batch}")
    rows = archive.inventory(unread, taken)
    first = rows.groupBy("document_id").agg(F.min_by(F.struct("identity_kind", "reason", "byte_sha256"), "path").alias("f"))
    docs = first.select(F.col("document_id").alias("id"), "f.identity_kind", F.col("f.reason").alias("quarantine_reason"), "f.byte_sha256")
    docs = docs.join(taken.select("byte_sha256", "source_text"), "byte_sha256", "left").withColumn("created_at", now)
    state.append("inventory", absent(docs, state.read("inventory"), "id"), batch)
    again = fresh.join(by_bytes, "byte_sha256")
    names = ["path", "format", "byte_sha256", "size_bytes", "document_id", "content_source"]
    state.append("files", rows.select(names).unionByName(again.select(names)).withColumn("discovered_at", now), batch)
    for name in ("scan", "texts"):
        state.fs.delete(state.path(f"{state.root}/_writing/{name}-{batch}"), True)


def open_run(state: State, config: Config, config_path: str, input_path: str) -> int:
    """Write the row of a new run; its id is the next that no other run has taken."""
    price_in, price_out = config.prices
    run_id = int(state.read("runs_started").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    while True:
        run_id += 1
        row = (run_id, datetime.now(UTC), config.workers, config.limit, config.budget, config.backend, config.model, config_path, input_path, price_in, price_out)
        try:
            state.append("runs_started", state.spark.createDataFrame([row], TABLES["runs_started"]), f"run-{run_id}", taken=False)
        except FileExistsError:
            continue
        return run_id


def judged_outcomes(judged: DataFrame, config: Config) -> DataFrame:
    """Outcomes of checked answers ``(document_id, run_id, attempt, ...)``: the first attempt's if it can be used, the second's in any case."""
    final = judged.where(~F.col("needs_repair") | (F.col("attempt") == 2))
    status = F.when(F.col("needs_repair"), "quarantined").otherwise("done")
    return final.select("document_id", "run_id", "attempt", status.alias("status"), *fixed.FIELDS, "summary", F.lit(config.backend).alias("backend"), F.lit(config.model).alias("model"), F.current_timestamp().alias("created_at"))


def settle(state: State, config: Config, run_id: int) -> None:
    """Take up answers that an earlier run wrote down but didn't live to use, so that they aren't asked for again."""
    pending = state.documents().where("status = 'pending'").select(F.col("id").alias("document_id"), "source_text")
    said = state.read("usages").where("error_kind is null and raw is not null")
    last = said.groupBy("document_id").agg(F.max_by(F.struct("run_id", "attempt", "raw"), F.struct("run_id", "attempt")).alias("a"))
    rows = pending.join(last, "document_id").select("document_id", "source_text", "a.*")
    rows = state_table(state, rows, f"unsettled-{run_id}")
    if rows.limit(1).count():
        state.append("outcomes", judged_outcomes(validated(rows, "raw", "source_text"), config), f"settled-{run_id}")


def asked_batches(state: State, targets: DataFrame, config: Config, counter: tokens.Counter, run_id: int, n: int) -> tuple[DataFrame, int]:
    """The prompts of all targets, ``(document_id, source_text, context, prompt, batch)``, and the number of batches. Batches follow
    the ids and hold ``config.batch`` documents, or more where there would be over a thousand of them."""
    size = max(config.batch, config.workers, -(-n // 1000))
    repair = inference.prompt_text("") + inference.REPAIR + inference.TAIL
    clean = targets.withColumn("_clean", text.context_clean(text.composed(F.col("source_text"))))
    room = windowing.context_tokens(config.section.get("context_tokens"), counter.of(inference.prompt_text("")), counter.of(repair), config.max_output)
    sample = F.substring("_clean", 1, fixed.SAMPLE_CHARS)
    clean = clean.withColumn("_budget", windowing.char_budget(F.lit(room), F.length(sample), counter.column(sample)))
    asked = windowing.with_context(clean, "_clean", "_budget").withColumn("prompt", inference.prompt(F.col("context")))
    asked = state_table(state, asked.select("document_id", "source_text", "context", "prompt"), f"prompts-{run_id}")
    place = ledger.running_sum(asked.select("document_id", F.lit(1).alias("one")), "one", "document_id")
    place = place.select("document_id", F.floor((F.col("running") - 1) / size).cast("int").alias("batch"))
    return state_table(state, asked.join(place, "document_id"), f"asked-{run_id}", "batch"), -(-n // size)


def run(
    state: State, input_path: str, config: Config, config_path: str = "", make: Callable[[], object] | None = None,
    counter: tokens.Source = None, **options: object,
) -> tuple[int, str]:
    """One run; returns its id and why it stopped. What an earlier run left open is taken up.

    Documents are taken in the order of their ids, batch by batch. Of each batch the reservations are written before the calls,
    the answers before they are used, and the outcomes before the next batch is begun. So a run that is killed loses the
    answers of one batch at most; only those are asked for again. Calls that fail for the backend's sake leave their document
    pending; a batch in which calls were refused, or none was answered, ends the run. ``counter`` counts tokens (the
    configuration's tokenizer, or else the estimate of four characters a token).
    """
    spark = state.spark
    take_inventory(state, input_path, partitions=config.workers * 2, **options)
    run_id = open_run(state, config, config_path, input_path)
    counter = tokens.Counter(spark, counter or config.tokenizer)
    make = make or (lambda b=config.backend, s=config.section: inference.client_of(b, s))
    settle(state, config, run_id)
    documents = state.documents()
    attempted = documents.where("status = 'done' or quarantine_reason = 'llm_invalid_output'").count()
    pending = documents.where("status = 'pending'").select(F.col("id").alias("document_id"), "source_text")
    n_pending = pending.count()
    targets = ledger.limited(pending, config.limit, attempted, "document_id")
    reserved = int(state.read("reservations").agg(F.coalesce(F.sum("reserved_tokens"), F.lit(0))).first()[0])
    n_targets = n_pending if config.limit is None else min(n_pending, max(config.limit - attempted, 0))
    stop, failed = ("limit_reached" if n_targets < n_pending else "completed"), False
    every, n_batches = asked_batches(state, targets, config, counter, run_id, n_targets)
    for number in range(n_batches):
        asked, ended = every.where(F.col("batch") == number).drop("batch"), None
        for attempt in (1, 2):
            key, own = f"run-{run_id}-{number:06d}-{attempt}", [F.lit(run_id).cast("long").alias("run_id"), "document_id", F.lit(attempt).alias("attempt")]
            wanted = state_table(state, asked.withColumn("reserved_tokens", counter.column(F.col("prompt")) + config.max_output), f"wanted-{key}")
            n_wanted = wanted.count()
            if not n_wanted:
                break
            allowed = ledger.budget_prefix(wanted.select("document_id", "reserved_tokens"), "reserved_tokens", config.budget, reserved, "document_id").drop("running")
            kept = state.append("reservations", allowed.select(*own, F.current_timestamp().alias("reserved_at"), "reserved_tokens"), key)
            n_kept, cost = kept.agg(F.count("*"), F.coalesce(F.sum("reserved_tokens"), F.lit(0))).first()
            reserved += int(cost)
            if n_kept < n_wanted:
                ended = "budget_exhausted"
            if not n_kept:
                break
            calls = wanted.join(kept.select("document_id"), "document_id").repartition(config.workers, "document_id")
            answers = inference.inferred(calls, make, config.max_output)
            used = state.append("usages", answers.select(*own, "tokens_in", "tokens_out", F.when(F.col("error_kind").isNull(), F.current_timestamp()).alias("completed_at"), "raw", "error_kind"), key)
            n_failed, refused = used.agg(F.count("error_kind"), F.count_if(F.col("error_kind") == "unavailable")).first()
            failed = failed or bool(n_failed)
            answered = used.where("error_kind is null").select("run_id", "attempt", "document_id", "raw").join(wanted.select("document_id", "source_text", "context"), "document_id")
            judged = state_table(state, validated(answered, "raw", "source_text"), f"judged-{key}")
            state.append("outcomes", judged_outcomes(judged, config), key)
            if refused or n_failed == n_kept:
                ended = "backend_unavailable"
                break
            asked = judged.where("needs_repair").select("document_id", "source_text", "context", inference.repair_prompt(F.col("context"), F.coalesce("raw", F.lit("")), F.coalesce("error", F.lit(""))).alias("prompt"))
        if ended:
            stop = ended
            break
    else:
        stop = "backend_unavailable" if failed else stop
    state.append("runs_finished", spark.createDataFrame([(run_id, datetime.now(UTC), stop)], TABLES["runs_finished"]), f"run-{run_id}")
    state.fs.delete(state.path(f"{state.root}/_writing"), True)
    return run_id, stop


def state_table(state: State, rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``rows`` written under the state folder, so that they are computed once; in a folder for each value of ``by``."""
    path = f"{state.root}/_writing/{name}"
    dealt = rows.repartition(by).write.partitionBy(by) if by else rows.write
    dealt.mode("overwrite").parquet(path)
    return state.spark.read.schema(rows.schema).parquet(path)
