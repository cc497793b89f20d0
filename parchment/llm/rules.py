"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule;
versioned policies are masks over those bits, so a new policy, or the effect of leaving a rule out, needs no
second look at the texts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
NOT_SPACE = "[^ \\t\\n\\x0B\\f\\r]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Rules in bit order; a rule fails where its condition holds. Conditions read the measurements alone.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policy versions: the rules that each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "many_symbols", "duplicate_lines"),
    "v3": tuple(RULES),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...] | list[str], known: Mapping[str, str] = RULES) -> int:
    """The bits of ``rules``."""
    order = list(known)
    return sum(1 << order.index(r) for r in rules)


def _repeat_words(order: Column) -> Column:
    """Words covered by windows that occur twice: of sorted (key, key, place), keep equal neighbours, add up gaps."""
    size = F.size(order)
    same = lambda i, j: (F.get(order, i)["a"] == F.get(order, j)["a"]) & (F.get(order, i)["b"] == F.get(order, j)["b"])
    places = F.array_sort(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), size - 1),
                lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
            ),
            lambda i: F.get(order, i)["at"],
        )
    )
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
        ),
        lambda acc: acc["n"],
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)`` for each row.

    Words are runs of anything but the six ASCII spaces. A null or empty text has no words and all zeros. Windows
    are compared by two hashes of their words (64 and 32 bits). One pass over each text; no shuffle.
    """
    nothing = F.array().cast("array<string>")
    split = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.array_remove(F.split(text_col, SPACE_RUN), ""), nothing).alias("words"),
        F.coalesce(F.regexp_count(text_col, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.filter(F.split(text_col, "\n"), lambda x: x.rlike(NOT_SPACE)), nothing).alias("lines"),
    )
    hashed = split.select(
        "id",
        "words",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") > WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW))
            ),
        ).alias("windows"),
    )
    keys = F.transform(
        "windows",
        lambda h, i: F.struct(h.alias("a"), F.hash(F.slice("words", i + 1, WINDOW)).alias("b"), i.alias("at")),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    keyed = hashed.select(
        "id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(repeats, F.array_sort(keys)).alias("keys")
    )
    n = F.when(F.col("keys").isNotNull(), _repeat_words(F.col("keys"))).otherwise(0).cast("long")
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    # a generator of one row: a filter on the measurements would else be pushed below, and evaluate them again and again
    row = F.struct(*names, n.alias("n_repeat_words"))
    return keyed.select("id", F.explode(F.array(row)).alias("m")).select("id", "m.*")


def ledger(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Mapping[str, str] = RULES
) -> DataFrame:
    """Measurements of each row, and ``failed``: a long with bit k set where rule k fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << k)).otherwise(0).cast("long") for k, cond in enumerate(rules.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs, id_col, text_col).withColumn("failed", failed)


def judged(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Apply a policy version to a ledger: ``base_failed``, ``kept`` and ``policy``."""
    hit = lambda m: F.col("failed").bitwiseAND(F.lit(m).cast("long")) != 0
    enforced = mask(list(dict.fromkeys((*BASE, *POLICIES[version]))))
    return rows.withColumns({"base_failed": hit(mask(BASE)), "kept": ~hit(enforced), "policy": F.lit(version)})


def ablations(rows: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each policy and rule: documents that the rule fails, and those that only it rejects.

    One aggregation over distinct masks (at most two to the number of rules), counted before they are expanded.
    """
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    parts = [
        F.struct(
            F.lit(v).alias("policy"),
            F.lit(r).alias("rule"),
            F.lit(mask([r])).cast("long").alias("bit"),
            F.lit(mask(list(rs))).cast("long").alias("all"),
        )
        for v, rs in policies.items()
        for r in rs
    ]
    each = counts.select("failed", "n", F.explode(F.array(*parts)).alias("p")).select("failed", "n", "p.*")
    both = F.col("failed").bitwiseAND(F.col("all"))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(both == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def accepted(docs: DataFrame, version: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the policy keeps, with the columns of ``docs``, decided row by row (no join)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    kept = judged(ledger(packed, "row", "text"), version).where("kept")
    return kept.select("id.*")
