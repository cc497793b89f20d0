"""Queries over texts: identity, formats, candidates, contexts, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.catalog import query
from parchment.functions import candidates, fixed, text
from parchment.operators import evaluation, identity, inference, ledger, tokens, validation, windowing
from parchment.sources import extract, formats

#: The tokenizer of queries that count tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: SQL for what several queries share.
NORMAL = r"""replace(lower(trim(regexp_replace(array_to_string(list_filter(
    string_split_regex(nfc_normalize(text), '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'),
    lambda l: NOT regexp_matches(trim(l), '^[=\-_*~#]{3,}$')), chr(10)), '[\s\x0b\x1c-\x1f]+', ' ', 'g'))), 'ß', 'ss')"""
#: Documents have few dates and amounts of their own; these are put after each text.
MARKED = """text || ' NIP 526-000-' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '-46, ' || CAST(1 + doc_id % 28 AS VARCHAR)
    || ' WRZEŚNIA 2024, due March 5, 2025, total ' || CAST(n_chars AS VARCHAR) || ',50 zł'"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text, spread over all cores where they lie in fewer files than there are: a file of one row group is read
    by one task, whatever its size, and what is done to texts here costs far more than moving them. Many files stay where they are."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(4 * cores) if len(docs.inputFiles()) < cores else docs


def marked() -> Column:
    return F.expr(MARKED.replace("CAST(doc_id % 100 AS VARCHAR)", "CAST(doc_id % 100 AS STRING)").replace("AS VARCHAR", "AS STRING"))


def sql_re(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("'", "''")


@query(f"SELECT doc_id, sha256({NORMAL}) AS identity FROM documents WHERE text IS NOT NULL")
def doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", text.sha(text.normalized(F.col("text"))).alias("identity"))


@query(
    f"""SELECT sha256({NORMAL}) AS identity, CAST(min(doc_id) AS BIGINT) AS representative, CAST(count(*) AS BIGINT) AS copies
    FROM documents WHERE text IS NOT NULL GROUP BY 1"""
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return identity.groups(docs, text.sha(text.normalized(F.col("text"))), "doc_id")


@query(
    f"""SELECT doc_id, identity, min(doc_id) OVER (PARTITION BY identity) AS representative, CAST(count(*) OVER (PARTITION BY identity) AS BIGINT) AS copies
    FROM (SELECT doc_id, sha256({NORMAL}) AS identity FROM documents WHERE text IS NOT NULL)"""
)
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents say the same, and which of them stands for the rest."""
    docs = texts(spark, sf_dir)
    return identity.members(docs, text.sha(text.normalized(F.col("text"))), "doc_id").select("doc_id", "identity", "representative", "copies")


@query(
    f"""SELECT CAST(count(*) AS BIGINT) AS input_files, CAST(count(DISTINCT {NORMAL}) AS BIGINT) AS unique_documents,
    CAST(count(*) - count(DISTINCT {NORMAL}) AS BIGINT) AS duplicate_files FROM documents WHERE text IS NOT NULL"""
)
def dedup_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return identity.balance(docs, text.sha(text.normalized_native(text.composed(F.col("text")))))


@query(
    """SELECT 'documents/' || doc_id AS path, sha256(text) AS byte_sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes
    FROM documents WHERE text IS NOT NULL UNION ALL
    SELECT 'pages/' || page_id, sha256(html), CAST(octet_length(encode(html)) AS BIGINT) FROM pages WHERE html IS NOT NULL"""
)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(name: str, key: str, body: str) -> DataFrame:
        path = F.concat(F.lit(f"{name}/"), F.col(key))
        own = table(spark, sf_dir, name).where(F.col(body).isNotNull())
        return own.select(path.alias("path"), text.sha(F.col(body)).alias("byte_sha256"), F.octet_length(body).cast("long").alias("size_bytes"))

    return rows("documents", "doc_id", "text").unionByName(rows("pages", "page_id", "html"))


_FORMAT = rf"""CASE WHEN h[1:5] = '%PDF-' THEN 'pdf' WHEN h[1:4] = 'PK' || chr(3) || chr(4) THEN 'docx'
    WHEN regexp_matches(string_split(h, chr(10))[1], '(?i){fixed.MAIL_HEADER}') AND len(regexp_extract_all(h[1:2048], '(?im){fixed.MAIL_HEADER}')) > 1 THEN 'eml'
    WHEN regexp_matches(h[1:1024], '(?i){fixed.HTML_MARKER}') THEN 'html'
    WHEN h = '' OR len(regexp_extract_all(h, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) <= 0.05 * length(h) THEN 'txt' ELSE 'unknown' END"""
_HEADS = "(SELECT page_id AS id, 'pages' AS origin, html[1:8192] AS h FROM pages WHERE html IS NOT NULL UNION ALL SELECT doc_id, 'documents', text[1:8192] FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT origin, id, {_FORMAT} AS format FROM {_HEADS}")
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("html is not null").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), formats.detect_text(F.col("html")).alias("format"))
    docs = texts(spark, sf_dir).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), formats.detect_text(F.col("text")).alias("format"))
    return pages.unionByName(docs)


@query(f"SELECT origin, {_FORMAT} AS format, CAST(count(*) AS BIGINT) AS n FROM {_HEADS} GROUP BY 1, 2")
def format_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_detect(spark, sf_dir).groupBy("origin", "format").agg(F.count("*").alias("n"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages; entities and broken tags need a parser, so there is no SQL for it."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text._mapped("string", extract.visible_text)(F.col("html")).alias("text"))


def _found(kind: str, pattern: str, more: str = "") -> str:
    return f"SELECT doc_id, '{kind}' AS kind, unnest(list_filter(regexp_extract_all({MARKED}, '{sql_re(pattern)}', 0), lambda m: {more or 'true'})) AS match FROM documents WHERE text IS NOT NULL"


_TEN = r"length(regexp_replace(m, '\D', '', 'g')) = 10"


@query(" UNION ALL ".join([_found("nip", candidates.TAX_ID, _TEN), _found("date", candidates.DATE), _found("amount", candidates.AMOUNT_PLAIN)]))
def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", marked().alias("t"))
    return docs.select("doc_id", F.explode(candidates.all_spans(F.col("t"))).alias("m")).select("doc_id", "m.kind", F.col("m.text").alias("match"))


def _starts(kind: str, pattern: str, more: str = "true") -> str:
    p = sql_re(pattern)
    return f"""SELECT doc_id, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(ms) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0), 'm': ms[i]}}), lambda q: {more.replace('(m,', '(q.m,')})) AS u
        FROM (SELECT doc_id, string_split_regex(t, '{p}') AS parts, regexp_extract_all(t, '{p}', 0) AS ms FROM (SELECT doc_id, {MARKED} AS t FROM documents WHERE text IS NOT NULL))"""


@query(
    "SELECT doc_id, kind, CAST(u.s AS INTEGER) AS start, u.m AS match FROM ("
    + " UNION ALL ".join([_starts("nip", candidates.TAX_ID, _TEN), _starts("date", candidates.DATE), _starts("amount", candidates.AMOUNT_PLAIN), _starts("keyword", candidates.KEYWORD)])
    + ")"
)
def candidate_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select("doc_id", marked().alias("t"))
    every = F.concat(candidates.all_spans(F.col("t")), candidates.spans(F.col("t"), candidates.KEYWORD_TREE, "keyword"))
    return docs.select("doc_id", F.explode(every).alias("m")).select("doc_id", "m.kind", "m.start", F.col("m.text").alias("match"))


_CLEAN = r"trim(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT doc_id, {_CLEAN} AS clean FROM documents WHERE text IS NOT NULL")
def context_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", text.context_clean(text.composed(F.col("text"))).alias("clean"))


@query(
    f"""SELECT doc_id, CAST(CASE WHEN length(c) = 0 THEN 6000 ELSE floor(380 * (CAST(least(length(c), 4000) AS DOUBLE) / ceil(least(length(c), 4000) / 4.0))) END AS INTEGER) AS char_budget
    FROM (SELECT doc_id, {_CLEAN} AS c FROM documents WHERE text IS NOT NULL)"""
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = F.substring("clean", 1, fixed.SAMPLE_CHARS)
    budget = windowing.char_budget(F.lit(380), F.length(sample), windowing.estimated_tokens(sample))
    return context_clean(spark, sf_dir).select("doc_id", budget.alias("char_budget"))


@query()
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of 1500 characters; the greedy windows are a fold, held against a Python specification in tests."""
    docs = texts(spark, sf_dir).select("doc_id", text.context_clean(text.composed(marked())).alias("clean"), F.lit(1500).alias("b"))
    return windowing.with_context(docs, "clean", "b").select("doc_id", "context", F.size("windows").alias("n_windows"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", windowing.estimated_tokens(F.col("text")).alias("tokens"))


_PROMPT_CHARS = len(f"<|im_start|>system\n{inference.SYSTEM}<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n")


@query()
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by a tokenizer's file; SQL has no BPE, so tests hold it against the tokenizer itself."""
    counter = tokens.Counter(spark, TOKENIZER)
    return texts(spark, sf_dir).select("doc_id", counter.column(F.col("text")).alias("tokens"))


@query(f"SELECT conv_id, turn, CAST(ceil((length(text) + {_PROMPT_CHARS}) / 4.0) + 300 AS BIGINT) AS reserved_tokens FROM conversations WHERE text IS NOT NULL")
def prompt_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", (windowing.estimated_tokens(inference.prompt(F.col("text"))) + 300).alias("reserved_tokens"))


@query("SELECT sha256(text) AS id FROM documents WHERE text IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 93")
def limit_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 100 documents over all runs, 7 of which earlier runs have used."""
    ids = texts(spark, sf_dir).select(text.sha(F.col("text")).alias("id")).distinct()
    return ledger.limited(ids, 100, 7)


@query(
    """SELECT id, cost, running FROM (SELECT id, cost, CAST(sum(cost) OVER (ORDER BY id) AS BIGINT) AS running FROM
    (SELECT sha256(text) AS id, CAST(ceil(min(length(text)) / 4.0) + 300 AS BIGINT) AS cost FROM documents WHERE text IS NOT NULL GROUP BY 1)) WHERE running <= 200000 - 1234"""
)
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    rows = docs.groupBy(text.sha(F.col("text")).alias("id")).agg((windowing.estimated_tokens(F.min(F.struct(F.length("text"), "text"))["text"]) + 300).alias("cost"))
    return ledger.budget_prefix(rows, "cost", 200_000, 1234)


#: Bytes of benchmark text that are sent to every task at once; a larger benchmark is taken in as many passes as it needs.
ITEM_BYTES = 1 << 24


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of every item that is a part of a document, both by their normal forms."""
    # by Python throughout: generated code of the join would work out a native normal form again for every pair
    form = text._mapped("string", text.normal_form)
    n = docs.where("text is not null").select("doc_id", F.coalesce(form(F.col("text")), F.lit("")).alias("n"))
    v = items.where("text is not null").select("item_id", form(F.col("text")).alias("v")).where("v <> ''")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 + size // ITEM_BYTES
    part = lambda k: F.broadcast(v.where(F.pmod(F.xxhash64("v"), F.lit(passes)) == k))
    out = n.join(part(0), F.contains("n", "v"))
    for k in range(1, passes):
        out = out.unionByName(n.join(part(k), F.contains("n", "v")))
    return out.select("doc_id", "item_id")


@query(
    rf"""WITH d AS (SELECT doc_id, {NORMAL} AS n FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, {NORMAL} AS v FROM benchmark WHERE text IS NOT NULL),
    t AS (SELECT doc_id, text, {NORMAL} AS n FROM (SELECT doc_id, {MARKED} AS text FROM documents WHERE text IS NOT NULL)),
    x AS (SELECT doc_id, n, list_transform(list_filter(regexp_extract_all(text, '{sql_re(candidates.TAX_ID)}', 0), lambda m: {_TEN}), lambda m: regexp_replace(m, '\D', '', 'g')) AS ids,
      unnest(['526000' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '46', 'PL 526 000 ' || lpad(CAST((doc_id + 1) % 100 AS VARCHAR), 2, '0') || ' 46']) AS v FROM t)
    SELECT doc_id, 'benchmark' AS kind, CAST(item_id AS VARCHAR) AS value FROM d JOIN b ON v <> '' AND contains(n, v)
    UNION ALL SELECT doc_id, 'tax_id' AS kind, v AS value FROM x WHERE contains(n, lower(v)) OR list_contains(ids, regexp_replace(v, '\D', '', 'g'))"""
)
def values_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that occurs in a document, of all pairs; and of two tax ids a document, its own and its neighbour's, those found in it."""
    docs = texts(spark, sf_dir)
    items = contained(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.lit("benchmark").alias("kind"), F.col("item_id").cast("string").alias("value"))
    two = lambda d: F.lpad((d % 100).cast("string"), 2, "0")
    values = F.array(F.concat(F.lit("526000"), two(F.col("doc_id")), F.lit("46")), F.concat(F.lit("PL 526 000 "), two(F.col("doc_id") + 1), F.lit(" 46")))
    ids = docs.select("doc_id", marked().alias("t")).select("doc_id", "t", text._mapped("string", text.normal_form)(F.col("t")).alias("n"))
    ids = ids.withColumn("value", F.explode(values)).where(candidates.occurs_in(F.col("value"), F.col("t"), F.lower("value"), F.col("n")))
    return items.unionByName(ids.select("doc_id", F.lit("tax_id").alias("kind"), "value"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a fake backend might give: every kind of right and wrong field occurs."""
    d = F.col("doc_id")
    docs = texts(spark, sf_dir).select("doc_id", marked().alias("source"), "n_chars", "lang")
    answer = F.to_json(
        F.struct(
            F.when(d % 11 == 0, "memo").otherwise("invoice").alias("doc_type"),
            F.when(d % 3 == 0, "Nobody Anywhere Ltd").otherwise(F.lit("due march 5")).alias("counterparty_name"),
            F.concat(F.lit("PL 526-000-"), F.lpad((d % 100).cast("string"), 2, "0"), F.when(d % 5 == 0, "-47").otherwise("-46")).alias("counterparty_tax_id"),
            F.lit("2024-09-01").alias("issue_date"),
            F.when(d % 7 == 0, "5 March").alias("due_date"),
            F.concat("n_chars", F.lit(".505")).alias("gross_amount"),
            F.when(d % 4 == 0, "zł").when(d % 4 == 1, "pln").when(d % 4 == 2, "$").alias("currency"),
            F.when(d % 13 == 0, " ").otherwise("An invoice.").alias("summary"),
        )
    )
    return docs.withColumn("raw", answer)


@query(
    """SELECT doc_id, CASE WHEN bad THEN NULL ELSE 'invoice' END AS doc_type,
    CASE WHEN NOT bad AND doc_id % 3 <> 0 THEN 'due march 5' END AS counterparty_name,
    CASE WHEN NOT bad AND doc_id % 5 <> 0 THEN '526000' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '46' END AS counterparty_tax_id,
    CASE WHEN NOT bad THEN '2024-09-01' END AS issue_date,
    CASE WHEN NOT bad AND doc_id % 4 < 2 THEN CAST(n_chars AS VARCHAR) || '.51' END AS gross_amount,
    CASE WHEN NOT bad AND doc_id % 4 < 2 THEN 'PLN' END AS currency, bad AS needs_repair,
    CASE WHEN bad THEN '' ELSE array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'counterparty_name' END, CASE WHEN doc_id % 5 = 0 THEN 'counterparty_tax_id' END,
      CASE WHEN doc_id % 4 = 2 THEN 'currency' END, CASE WHEN doc_id % 4 >= 2 THEN 'gross_amount' END], lambda x: x IS NOT NULL), ',') END AS nulled
    FROM (SELECT *, doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 13 = 0 AS bad FROM documents WHERE text IS NOT NULL)"""
)
def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validation.validated(_answers(spark, sf_dir), "raw", "source")
    return out.select(
        "doc_id", "doc_type", "counterparty_name", "counterparty_tax_id", F.col("issue_date").cast("string").alias("issue_date"),
        F.col("gross_amount").cast("string").alias("gross_amount"), "currency", "needs_repair", F.array_join("nulled_fields", ",").alias("nulled"),
    )


_OWN = "text[20:44]"
_ANSWERED = f"""SELECT doc_id, text, n_chars, {NORMAL} AS n, CASE WHEN doc_id % 3 = 0 THEN lang || ' ' || source ELSE {_OWN} END AS name, lpad(CAST(n_chars AS VARCHAR), 10, '0') AS tax,
    CASE doc_id % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN '£' WHEN 2 THEN 'dollars' END AS mark FROM documents WHERE text IS NOT NULL"""


@query(
    rf"""WITH a AS (SELECT *, {NORMAL.replace("text", "name")} AS v, regexp_matches(text, '{sql_re(candidates.DATE)}') AS dated, regexp_matches(text, '{sql_re(candidates.AMOUNT_PLAIN)}') AS priced,
      list_contains(list_transform(list_filter(regexp_extract_all(text, '{sql_re(candidates.TAX_ID)}', 0), lambda m: {_TEN}), lambda m: regexp_replace(m, '\D', '', 'g')), tax) AS listed,
      CASE mark WHEN '£' THEN 'GBP' WHEN 'EUR' THEN 'EUR' END AS code FROM ({_ANSWERED})),
    b AS (SELECT *, (v <> '' AND contains(n, v)) OR (length(regexp_replace(name, '\D', '', 'g')) = 10 AND regexp_replace(name, '\D', '', 'g') = tax AND listed) AS named, contains(n, tax) OR listed AS taxed FROM a)
    SELECT doc_id, CASE WHEN named THEN name END AS counterparty_name, CASE WHEN taxed THEN tax END AS counterparty_tax_id, CASE WHEN dated THEN '2024-09-01' END AS issue_date,
      CASE WHEN priced AND code IS NOT NULL THEN CAST(n_chars AS VARCHAR) || '.25' END AS gross_amount, code AS currency,
      array_to_string(list_filter([CASE WHEN name IS NOT NULL AND NOT named THEN 'counterparty_name' END, CASE WHEN NOT taxed THEN 'counterparty_tax_id' END, CASE WHEN NOT dated THEN 'issue_date' END,
        CASE WHEN NOT priced THEN 'gross_amount' END, CASE WHEN mark IS NOT NULL AND code IS NULL THEN 'currency' END, CASE WHEN priced AND code IS NULL THEN 'gross_amount' END], lambda x: x IS NOT NULL), ',') AS nulled FROM b"""
)
def validate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers checked against texts as they are: what a text holds decides, not how the answer was made."""
    d = F.col("doc_id")
    docs = texts(spark, sf_dir).withColumns({
        "name": F.when(d % 3 == 0, F.concat("lang", F.lit(" "), "source")).otherwise(F.substring("text", 20, 25)),
        "mark": F.when(d % 4 == 0, "EUR").when(d % 4 == 1, "£").when(d % 4 == 2, "dollars"),
    })
    answer = F.struct(
        F.lit("invoice").alias("doc_type"), F.col("name").alias("counterparty_name"), F.lpad(F.col("n_chars").cast("string"), 10, "0").alias("counterparty_tax_id"),
        F.lit("2024-09-01").alias("issue_date"), F.concat("n_chars", F.lit(".25")).alias("gross_amount"), F.col("mark").alias("currency"), F.lit("Said.").alias("summary"),
    )
    out = validation.validated(docs.select("doc_id", "text", F.to_json(answer).alias("raw")), "raw", "text")
    return out.select(
        "doc_id", "counterparty_name", "counterparty_tax_id", F.col("issue_date").cast("string").alias("issue_date"), F.col("gross_amount").cast("string").alias("gross_amount"),
        "currency", F.array_join("nulled_fields", ",").alias("nulled"),
    )


@query(
    """SELECT CAST(count(*) FILTER (doc_id % 11 = 0 OR doc_id % 7 = 0) AS BIGINT) AS unusable,
    CAST(count(*) FILTER (doc_id % 13 = 0 AND doc_id % 11 <> 0 AND doc_id % 7 <> 0) AS BIGINT) AS blank_summary FROM documents WHERE text IS NOT NULL"""
)
def needs_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validation.validated(_answers(spark, sf_dir), "raw", "source").where("needs_repair")
    blank = F.col("error") == "summary is empty"
    return out.agg(F.count_if(~blank).alias("unusable"), F.count_if(blank).alias("blank_summary"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as golden records against what an imperfect run might have stored."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    d = F.col("doc_id")
    j = labels.join(docs, "doc_id", "left")
    expected = {
        "doc_type": F.when(d % 6 != 0, "offer"), "counterparty_name": F.concat(F.lit("The "), F.col("source"), F.lit(" Vendor Ltd")),
        "counterparty_tax_id": F.concat(F.lit("PL-"), d), "issue_date": F.lit("2024-01-05"), "due_date": F.lit(None).cast("string"),
        "gross_amount": F.concat("n_chars", F.lit(".125")), "currency": F.lit(" eur "), "summary": F.lit(""),
    }
    doc = F.struct(
        F.when(d % 6 != 0, "offer").otherwise("other").alias("doc_type"),
        F.concat(F.lit("the  "), F.col("source"), F.lit(" VENDOR ltd")).alias("counterparty_name"),
        F.when(F.col("quality") == 1, F.concat(F.lit("pl"), d)).otherwise(F.col("doc_id").cast("string")).alias("counterparty_tax_id"),
        F.lit("2024-01-05").try_cast("date").alias("issue_date"),
        F.when(F.col("toxic") == 1, "2024-02-01").try_cast("date").alias("due_date"),
        F.concat("n_chars", F.when(d % 2 == 0, ".12").otherwise(".13")).try_cast("decimal(20,2)").alias("gross_amount"),
        F.lit("EUR").alias("currency"),
        F.when(d % 3 == 0, "One. Two is here.").when(d % 3 == 1, "An offer by the vendor.").otherwise("Nothing said.").alias("summary"),
    )
    return j.withColumns({**expected, "doc": F.when(d % 10 != 0, doc), "n_ids": F.when(d % 17 == 0, 2).otherwise(1)})


@query(
    """WITH p AS (SELECT doc_id, quality, toxic, doc_id % 10 <> 0 AS found FROM labels JOIN documents USING (doc_id))
    SELECT field, CAST(count(*) FILTER (ok) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total, count(*) FILTER (ok) / CAST(count(*) AS DOUBLE) AS accuracy FROM (
    SELECT 'doc_type' AS field, found AND doc_id % 6 <> 0 AS ok FROM p UNION ALL SELECT 'counterparty_name', found FROM p
    UNION ALL SELECT 'counterparty_tax_id', found AND quality = 1 FROM p UNION ALL SELECT 'issue_date', found FROM p
    UNION ALL SELECT 'due_date', found AND toxic <> 1 FROM p UNION ALL SELECT 'gross_amount', found AND doc_id % 2 = 0 FROM p
    UNION ALL SELECT 'currency', found FROM p) GROUP BY field"""
)
def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scored(_pairs(spark, sf_dir))


@query(
    """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (doc_id % 10 = 0) AS BIGINT) AS not_found,
    CAST(count(*) FILTER (doc_id % 17 = 0) AS BIGINT) AS dedup_mismatches,
    CAST(count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 6 <> 0 AND doc_id % 3 = 1) AS BIGINT) AS summary_ok,
    CAST(count(*) FILTER (doc_id % 6 <> 0) AS BIGINT) AS summary_total FROM labels JOIN documents USING (doc_id)"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_pairs(spark, sf_dir))
