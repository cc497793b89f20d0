"""Queries over business tables: numbers, currencies and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.catalog import query
from parchment.functions import fixed, text
from parchment.operators import identity, inventory, ledger
from parchment.plans.documents import table


@query(
    """SELECT c_custkey, n AS tax_id, list_sum(list_transform(range(1, 10), lambda i: CAST(n[i] AS INTEGER) * [6, 5, 7, 2, 3, 4, 5, 6, 7][i])) % 11 = CAST(n[10] AS INTEGER) AS valid
    FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS n FROM customer)"""
)
def tax_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad((F.col("c_custkey") * 7919 % 10_000_000_000).cast("string"), 10, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", n.alias("tax_id"), text.tax_id_valid(n).alias("valid"))


_RAW = "CAST(l_linenumber * l_orderkey AS VARCHAR) || '.' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN l_suppkey % 2 = 0 THEN '5' ELSE '' END"


@query(f"SELECT DISTINCT l_orderkey, l_linenumber, {_RAW} AS raw, CAST(CAST(round(CAST({_RAW} AS DECIMAL(30,6)), 2) AS DECIMAL(20,2)) AS VARCHAR) AS amount FROM lineitem")
def amount_round_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_RAW.replace("VARCHAR", "STRING"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw")).distinct()
    return rows.withColumn("amount", text.amount(F.col("raw")).cast("string"))


@query(
    f"""SELECT DISTINCT l_orderkey, l_linenumber, {_RAW} AS raw, CAST(CAST(CASE WHEN r * 100 - floor(r * 100) = 0.5 THEN floor(r * 100 / 2 + 0.5) * 2 / 100
    ELSE round(r, 2) END AS DECIMAL(20,2)) AS VARCHAR) AS amount FROM (SELECT *, CAST({_RAW} AS DECIMAL(24,6)) AS r FROM lineitem)"""
)
def amount_round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_RAW.replace("VARCHAR", "STRING"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw")).distinct()
    return rows.withColumn("amount", text.amount_even(F.col("raw")).cast("string"))


_CODES = ", ".join(f"'{c}'" for c in fixed.ISO_4217)
_PICK = "CASE n_nationkey % 5 WHEN 0 THEN 'zł' WHEN 1 THEN ' eur ' WHEN 2 THEN '$' WHEN 3 THEN substr(n_name, 1, 3) ELSE '£' END"


@query(
    f"""SELECT n_nationkey, raw, CASE trim(raw) WHEN 'zł' THEN 'PLN' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' ELSE CASE WHEN upper(trim(raw)) IN ({_CODES}) THEN upper(trim(raw)) END END AS currency
    FROM (SELECT n_nationkey, {_PICK} AS raw FROM nation)"""
)
def currency_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.expr(_PICK).alias("raw")).withColumn("currency", text.currency(F.col("raw")))


def _map(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


_SUPPLY = """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'JPY' END AS code, CASE s_suppkey % 5 WHEN 0 THEN '$' WHEN 1 THEN '€' END AS symbol,
    CASE s_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'PL' WHEN 2 THEN 'GR' END AS country, s_suppkey % 3 = 0 AS has_address, CASE s_suppkey % 2 WHEN 0 THEN 'XI' ELSE 'SE' END AS prefix FROM supplier"""


@query(
    f"""SELECT s_suppkey, coalesce(a, b, c, d, e) AS currency, CASE WHEN a IS NOT NULL THEN 'explicit' WHEN b IS NOT NULL THEN 'symbol_unambiguous' WHEN c IS NOT NULL THEN 'symbol_ambiguous'
    WHEN d IS NOT NULL THEN 'address' WHEN e IS NOT NULL THEN 'vat_prefix' ELSE 'none' END AS level FROM (SELECT s_suppkey, code AS a, CASE symbol WHEN '€' THEN 'EUR' END AS b,
    CASE WHEN symbol = '$' AND country = 'US' THEN 'USD' END AS c, CASE WHEN has_address THEN {_map(fixed.COUNTRY_CURRENCY)}[country] END AS d, CASE WHEN NOT has_address THEN {_map(fixed.VAT_CURRENCY)}[prefix] END AS e FROM ({_SUPPLY}))"""
)
def currency_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    rows = spark.sql(_SUPPLY)
    r = text.resolved_currency(*[F.col(c) for c in ("code", "symbol", "country", "has_address", "prefix")])
    return rows.select("s_suppkey", r.alias("r")).select("s_suppkey", "r.*")


# ---- the report, over orders as runs and events as ledger

_RUNS = """SELECT o_orderkey AS id, o_orderdate AS started_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 90 SECOND END AS ended_at, 'completed' AS stop_reason, o_orderpriority AS backend,
    o_orderstatus AS model, CAST(o_custkey % 7 AS DOUBLE) AS price_input_per_million, CAST(o_custkey % 11 AS DOUBLE) AS price_output_per_million FROM orders"""
_LEDGER = """SELECT user_id AS run_id, ts AS reserved_at, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 5 SECOND END AS completed_at, event_id % 400 AS tokens_in, event_id % 90 AS tokens_out FROM events"""
_DOCS = """SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'quarantined' WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'done' END AS status,
    CASE WHEN doc_id % 20 = 0 THEN 'empty_text' WHEN doc_id % 10 = 0 THEN 'corrupt_file' END AS quarantine_reason FROM documents"""


def _view(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", _RUNS)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", _LEDGER)


@query(
    f"""SELECT CAST((SELECT count(*) FROM pages) + count(*) AS BIGINT) AS input_files, CAST(count(*) AS BIGINT) AS unique_documents, CAST((SELECT count(*) FROM pages) AS BIGINT) AS duplicate_files,
    CAST(count(*) FILTER (status = 'done') AS BIGINT) AS processed_ok, CAST(count(*) FILTER (status = 'quarantined') AS BIGINT) AS quarantined, CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS not_started FROM ({_DOCS})"""
)
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _view(spark, sf_dir, "documents", _DOCS)
    files = table(spark, sf_dir, "pages").select("page_id").unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id")))
    return ledger.status_counts(docs, files)


@query(f"SELECT quarantine_reason, CAST(count(*) AS BIGINT) AS n FROM ({_DOCS}) WHERE quarantine_reason IS NOT NULL GROUP BY 1")
def quarantine_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.quarantine_by_reason(_view(spark, sf_dir, "documents", _DOCS))


@query(
    f"""SELECT r.id, CAST(coalesce(i, 0) AS BIGINT) AS tokens_in, CAST(coalesce(o, 0) AS BIGINT) AS tokens_out, (coalesce(i, 0) * price_input_per_million + coalesce(o, 0) * price_output_per_million) / 1000000 AS cost
    FROM ({_RUNS}) r LEFT JOIN (SELECT run_id, sum(tokens_in) AS i, sum(tokens_out) AS o FROM ({_LEDGER}) WHERE completed_at IS NOT NULL GROUP BY 1) l ON r.id = l.run_id"""
)
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.run_costs(_runs(spark, sf_dir), _ledger(spark, sf_dir))


@query(
    f"""SELECT r.id, CAST(greatest(epoch(date_trunc('second', coalesce(ended_at, last))) - epoch(date_trunc('second', started_at)), 0) AS BIGINT) AS seconds FROM ({_RUNS}) r
    LEFT JOIN (SELECT run_id, max(greatest(completed_at, reserved_at)) AS last FROM ({_LEDGER}) GROUP BY 1) l ON r.id = l.run_id WHERE coalesce(ended_at, last) IS NOT NULL"""
)
def wall_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.wall_times(_runs(spark, sf_dir), _ledger(spark, sf_dir))


@query(f"SELECT backend, model, CASE WHEN ended_at IS NULL THEN 'interrupted' ELSE stop_reason END AS stop_reason FROM ({_RUNS}) ORDER BY id DESC LIMIT 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_run(_runs(spark, sf_dir))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_orderkey"))
    return identity.absent(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), known, "o_orderkey")


_NET = "CAST(CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)), 2) AS DECIMAL(30,2)) AS DECIMAL(30,2))"
_RATE = "CAST(l_tax AS DECIMAL(6,2))"


@query(
    f"""SELECT l_orderkey, CAST(sum(net) AS VARCHAR) AS net, CAST(sum(vat) AS VARCHAR) AS vat, CAST(sum(net) + sum(vat) AS VARCHAR) AS gross FROM
    (SELECT l_orderkey, net, CAST(round(net * rate, 2) AS DECIMAL(30,2)) AS vat FROM (SELECT l_orderkey, {_NET} AS net, {_RATE} AS rate FROM lineitem)) GROUP BY 1"""
)
def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net, tax and gross of each order as of an invoice: rounded half up line by line, then added up."""
    return ledger.invoice_totals(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice", "l_tax").select(
        "l_orderkey", *[F.col(c).cast("string").alias(c) for c in ("net", "vat", "gross")]
    )


_FILES = """SELECT 'a/' || o_orderkey AS path, CAST(o_custkey AS VARCHAR) AS document_id FROM orders"""
_CUSTOMERS = """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS status FROM customer WHERE c_custkey % 10 <> 0"""


def _files_and_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as files of customers, of whom every tenth is missing."""
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("a/"), "o_orderkey").alias("path"), F.col("o_custkey").cast("string").alias("document_id"))
    docs = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("status"))
    return files, docs


@query(f"SELECT path, document_id, status FROM ({_FILES}) f JOIN ({_CUSTOMERS}) d ON f.document_id = d.id")
def files_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.files_with_documents(*_files_and_documents(spark, sf_dir)).select("path", "document_id", "status")


@query(f"SELECT path, document_id FROM ({_FILES}) WHERE document_id NOT IN (SELECT id FROM ({_CUSTOMERS}))")
def files_without_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.files_without_document(*_files_and_documents(spark, sf_dir)).select("path", "document_id")


@query(f"SELECT id, status FROM ({_CUSTOMERS}) WHERE id NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')")
def documents_without_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents to whom no urgent order leads."""
    _, docs = _files_and_documents(spark, sf_dir)
    files = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("document_id"))
    return inventory.documents_without_file(files, docs).select("id", "status")


@query(f"SELECT CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out FROM ({_LEDGER}) WHERE completed_at IS NOT NULL")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.token_totals(_ledger(spark, sf_dir))
