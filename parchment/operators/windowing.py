"""Contexts of a bounded size: the head, the tail, and windows around hits between them, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import candidates, fixed


def estimated_tokens(text: Column) -> Column:
    """Four characters a token: the estimate that needs no tokenizer (see ``tokens`` for counts)."""
    return F.ceil(F.length(text) / 4).cast("long")


def char_budget(token_budget: Column, sample_chars: Column, sample_tokens: Column) -> Column:
    """Characters that a token budget buys at the sample's rate; the default if the sample counts no tokens."""
    rate = sample_chars.cast("double") / sample_tokens
    return F.when(sample_tokens > 0, F.floor(token_budget * rate).cast("int")).otherwise(fixed.CHAR_BUDGET)


def context_tokens(context: int | None, prompt_tokens: int, repair_tokens: int, max_output: int) -> int:
    """Tokens left for the document when the longer prompt and two answers are taken off the model's context."""
    room = (context or fixed.DEFAULT_CONTEXT) - max(prompt_tokens, repair_tokens) - 2 * max_output - fixed.CONTEXT_MARGIN
    return max(room, fixed.LEAST_CONTEXT)


def selected(hits: Column, low: Column, high: Column, budget: Column) -> Column:
    """Windows around sorted hits, left to right, without overlap, the last cut to what is left of the budget."""
    kind = "struct<used:int,cursor:int,w:array<struct<a:int,b:int>>>"
    start = lambda acc, p: F.greatest(p - fixed.RADIUS, low, acc["cursor"])
    stop = lambda acc, p: F.least(p + fixed.RADIUS, high)

    def step(acc: Column, p: Column) -> Column:
        a, b = start(acc, p), stop(acc, p)
        n = F.least(b - a, budget - acc["used"])
        taken = F.struct(
            (acc["used"] + n).alias("used"), (a + n).alias("cursor"), F.array_append(acc["w"], F.struct(a.alias("a"), (a + n).alias("b"))).alias("w")
        ).cast(kind)
        return F.when((acc["used"] >= budget) | (a >= b), acc).otherwise(taken)

    nothing = F.struct(F.lit(0).alias("used"), low.alias("cursor"), F.array().cast("array<struct<a:int,b:int>>").alias("w")).cast(kind)
    return F.aggregate(hits, nothing, step, lambda acc: acc["w"])


def with_context(rows: DataFrame, clean: str, budget: str, out: str = "context") -> DataFrame:
    """``rows`` with the context of the cleaned text in ``clean`` within ``budget`` characters, and its windows.

    Steps are columns of their own, so that nothing is evaluated twice. Null texts have null contexts.
    """
    names = rows.columns
    n = F.length(clean)
    b = F.col(budget)
    parts = rows.withColumns({"_n": n, "_head": F.floor(b * fixed.HEAD_SHARE).cast("int"), "_tail_n": F.floor(b * fixed.TAIL_SHARE).cast("int")})
    parts = parts.withColumn("_tail", F.greatest(F.col("_head"), F.col("_n") - F.col("_tail_n")))
    parts = parts.withColumns({
        "_middle": b - F.col("_head") - (F.col("_n") - F.col("_tail")),
        "_region": F.when(F.col("_n") > b, F.expr(f"substring({clean}, _head + 1, _tail - _head)")).otherwise(""),
    })
    starts = lambda x: F.transform(x, lambda m: m["start"])
    found = F.concat(starts(candidates.spans(F.col("_region"), candidates.KEYWORD_TREE, "keyword")), starts(candidates.all_spans(F.col("_region"))))
    parts = parts.withColumn("_hits", F.array_sort(F.array_distinct(F.transform(found, lambda x: x + F.col("_head")))))
    parts = parts.withColumn("windows", F.when(F.col("_n") > b, selected(F.col("_hits"), F.col("_head"), F.col("_tail"), F.col("_middle"))))
    text = F.col(clean)
    pieces = F.concat(
        F.array(F.substring(text, F.lit(1), F.col("_head"))),
        F.transform("windows", lambda w: F.substring(text, w["a"] + 1, w["b"] - w["a"])),
        F.array(F.substring(text, F.col("_tail") + 1, F.col("_n"))),
    )
    kept = F.filter(pieces, lambda p: p.rlike(r"(?U)[^\s\u001c-\u001f]"))
    built = F.when(F.col("_n") <= b, text).otherwise(F.array_join(kept, fixed.OMITTED))
    return parts.withColumn(out, built).select(*[c for c in names if c != out], "windows", out)
