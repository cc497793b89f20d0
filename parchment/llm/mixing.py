"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of source, language and topic. The cells' expected sampled tokens are raked until their sums over
each dimension meet its target shares, and no cell is asked for more than the tokens it has: a cell's tokens are its own times
a factor of each of its groups, at most all of them. A round takes each dimension in turn and gives each of its groups the factor with
which the bounded sum meets the group's goal. A cell's documents are then kept with the share of its tokens that is
wanted, so that the sample meets the targets by expectation.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.rules import NOT_SPACE
from parchment.llm.store import fresh, removed, written

DIMENSIONS = ("source", "lang", "topic")
#: Cells up to which the rounds are worked out on the driver; beyond, the same rounds run as Spark jobs.
DRIVER_CELLS = 50_000
#: Most rounds, and the gap to a group's share below which they end; most steps to a factor within a round.
ROUNDS, CLOSE, STEPS = 200, 1e-9, 60
#: The name under which ``targets`` give the share of all groups that they don't name.
OTHERS = "*"
#: Factors of groups of which all is wanted, and the least of others.
ALL, LEAST = 1e12, 1e-12

log = logging.getLogger(__name__)


def topic(text: Column) -> Column:
    """A topic by form: the first that fits of code, markup, tabular, numeric and prose; empty for null or wordless."""
    return (
        F.when(text.isNull() | ~text.rlike(NOT_SPACE), "empty")
        .when(text.rlike(r"(?m)^\s*(def |class |import |#include|public |function )"), "code")
        .when(text.rlike(r"</?[a-zA-Z][^>]*>"), "markup")
        .when(text.rlike(r"\S \| \S"), "tabular")
        .when(text.rlike(r"\d{4,}"), "numeric")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``docs`` with tokens (words), topic, and source and lang in which null is a value of its own, under ``names``."""
    text = F.col("text")
    return docs.withColumns({
        names["tokens"]: F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long"),
        names["source"]: F.coalesce(F.col("source").cast("string"), F.lit("\u0000")),
        names["lang"]: F.coalesce(F.col("lang").cast("string"), F.lit("\u0000")),
        names["topic"]: topic(text),
    })


def cells_of(docs: DataFrame) -> DataFrame:
    """``(source, lang, topic, tokens)`` of each cell."""
    keys = [*DIMENSIONS, "tokens"]
    rows = with_cells(docs.select("text", "source", "lang"), {k: f"_{k}" for k in keys})
    return rows.groupBy(*[F.col(f"_{k}").alias(k) for k in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens"))


def shares(own: dict[str, float], power: float, given: Mapping[str, float] | None) -> dict[str, float]:
    """Target shares of the groups with tokens. Without ``given`` their own shares to ``power``, which raises small groups;
    with it the shares given, those of OTHERS dealt over the groups not named by the same rule."""
    raised = {k: v**power for k, v in own.items() if v > 0}
    if given is None:
        out = raised
    else:
        rest = sum(v for k, v in raised.items() if k not in given)
        out = {k: given[k] if k in given else given.get(OTHERS, 0.0) * v / rest for k, v in raised.items()}
    total = sum(out.values())
    return {k: v / total for k, v in out.items()} if total else dict.fromkeys(raised, 1 / max(len(raised), 1))


def goals_of(own: dict[str, float], target: dict[str, float], wanted: float) -> dict[str, float]:
    """Tokens wanted of each group: its share of ``wanted``, but no more than it has; the rest goes to the others in
    proportion to their shares."""
    out, left, room = {}, dict(target), wanted
    while left:
        total = sum(left.values())
        full = {k for k, v in left.items() if total == 0 or v * room >= own[k] * total}
        if not full or total == 0:
            return out | {k: (room * v / total if total else 0.0) for k, v in left.items()}
        for k in full:
            out[k] = own[k] if left[k] > 0 else 0.0
            room -= out[k]
            del left[k]
    return out


def wanted_tokens(owns: list[dict[str, float]], targets: list[dict[str, float]], asked: float) -> float:
    """``asked``, or what the groups with a target have in the dimension where that is least."""
    return min([asked] + [sum(v for k, v in own.items() if target.get(k, 0) > 0) for own, target in zip(owns, targets, strict=True)])


def warned(gap: float, rounds: int, asked: list[dict[str, float]], goals: list[dict[str, float]], wanted: float) -> None:
    """Log what can't be met: groups with too few tokens, and a gap that the rounds left."""
    for dim, target, goal in zip(DIMENSIONS, asked, goals, strict=True):
        short = {k: v for k, v in target.items() if goal[k] < (v - 1e-6) * wanted}
        if short:
            log.warning("%s: %d groups have too few tokens for their share, so all of them are taken", dim, len(short))
    if gap >= CLOSE:
        log.warning("raking stopped short after %d rounds: a group was %g from its share", rounds, gap)


def rake(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], rounds: int | None = None) -> tuple[np.ndarray, float]:
    """Expected tokens of each cell, from 0 to ``tokens``, whose sums over each dimension's groups are its ``goals``; and
    the gap that is left, as a share of all wanted."""
    factors = [np.ones(len(g)) for g in goals]
    total, gap = max(float(goals[0].sum()), 1e-300), 0.0
    for _ in range(rounds or ROUNDS):
        for d, (code, goal) in enumerate(zip(codes, goals, strict=True)):
            others = np.prod([f[c] for k, (f, c) in enumerate(zip(factors, codes, strict=True)) if k != d], axis=0)
            plain, all_of = tokens * others, np.bincount(code, tokens, minlength=len(goal))
            sums = np.bincount(code, plain, minlength=len(goal))
            f = np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)
            for _ in range(STEPS):  # from below, so each step stays below
                capped = others * f[code] >= 1
                taken = np.bincount(code, np.where(capped, tokens, 0.0), minlength=len(goal))
                loose = np.bincount(code, np.where(capped, 0.0, plain), minlength=len(goal))
                new = np.where(loose > 0, np.divide(goal - taken, loose, out=np.zeros_like(goal), where=loose > 0), f)
                new = np.where(goal >= all_of * (1 - 1e-12), ALL, np.clip(new, f, ALL))
                new = np.where(goal > 0, new, 0.0)
                if np.allclose(new, f, rtol=1e-13, atol=0):
                    break
                f = new
            factors[d] = np.where(goal > 0, np.maximum(f, LEAST), 0.0)
        fit = tokens * np.minimum(1.0, np.prod([f[c] for f, c in zip(factors, codes, strict=True)], axis=0))
        gap = max(float(np.abs(np.bincount(c, fit, minlength=len(g)) - g).max()) for c, g in zip(codes, goals, strict=True)) / total
        if gap < CLOSE:
            break
    return fit, gap


def reached(targets: Mapping[str, Mapping[str, float]] | None) -> Column:
    """Whether a cell is in no group whose target is zero."""
    out = F.lit(True)
    for dim, given in (targets or {}).items():
        some = [k for k, v in given.items() if v > 0 and k != OTHERS]
        named = [k for k in given if k != OTHERS]
        out = out & (F.col(dim).isin(some) | (~F.col(dim).isin(named) if given.get(OTHERS, 0.0) > 0 else F.lit(False)))
    return out


def probabilities(
    cells: DataFrame, share: float, power: float, targets: Mapping[str, Mapping[str, float]] | None, most: int = DRIVER_CELLS
) -> DataFrame:
    """``(source, lang, topic, weight, probability)`` of each cell of ``cells(source, lang, topic, tokens)``.

    Up to ``most`` cells come to the driver; more are raked by jobs over the cells. Both do the same rounds. Cells in a
    group whose target is zero are left out first, and count neither for the other groups' shares nor for what is wanted.
    """
    spark = cells.sparkSession
    schema = "source string, lang string, topic string, weight double, probability double"
    gone = cells.where(~reached(targets))
    gone = gone.select(*DIMENSIONS, F.lit(0.0).alias("weight"), F.when(F.col("tokens") > 0, 0.0).otherwise(1.0).alias("probability"))
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    cells = cells.where(reached(targets))
    if cells.count() > most:
        return _distributed(cells, whole * share, power, targets).unionByName(gone)
    rows = cells.orderBy(*DIMENSIONS).collect()
    tokens = np.array([r["tokens"] for r in rows], np.float64)
    if not tokens.sum():
        return spark.createDataFrame([(*r[:3], 0.0, 1.0) for r in rows], schema).unionByName(gone)
    owns, asked, codes = [], [], []
    for dim in DIMENSIONS:
        own: dict[str, float] = {}
        for r in rows:
            own[r[dim]] = own.get(r[dim], 0.0) + r["tokens"]
        place = {k: i for i, k in enumerate(own)}
        owns.append(own)
        asked.append(dict.fromkeys(own, 0.0) | shares(own, power, (targets or {}).get(dim)))
        codes.append(np.array([place[r[dim]] for r in rows]))
    wanted = wanted_tokens(owns, asked, whole * share)
    goals = [dict.fromkeys(own, 0.0) | goals_of(own, target, wanted) for own, target in zip(owns, asked, strict=True)]
    fit, gap = rake(tokens, codes, [np.array([goal[k] for k in own]) for own, goal in zip(owns, goals, strict=True)])
    warned(gap, ROUNDS, asked, goals, wanted)
    p = np.where(tokens > 0, fit / np.maximum(tokens, 1), 1.0)  # documents without words weigh nothing
    weight = fit / max(fit.sum(), 1e-300)
    return spark.createDataFrame([(*r[:3], float(w), float(x)) for r, w, x in zip(rows, weight, p, strict=True)], schema).unionByName(gone)


def _distributed(cells: DataFrame, asked: float, power: float, targets: Mapping[str, Mapping[str, float]] | None) -> DataFrame:
    """The same rounds by joins of cells with their groups' factors; every table is written to the shared folder."""
    spark, tables = cells.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        tables.append(os.path.dirname(out.inputFiles()[0]) if out.inputFiles() else None)
        return out

    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.select(*DIMENSIONS, F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    groups, room = {}, [asked]
    for dim in DIMENSIONS:
        own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("own")).withColumn("raised", F.when(F.col("own") > 0, F.pow("own", F.lit(power))).otherwise(0.0))
        given = (targets or {}).get(dim)
        if given is None:
            own = own.withColumn("target", F.col("raised"))
        else:
            named = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{dim} string, g double")
            own = kept(own.join(named, dim, "left"), "groups")
            rest = float(own.where("g is null").agg(F.sum("raised")).first()[0] or 0)
            part = F.lit(given.get(OTHERS, 0.0) / rest if rest else 0.0) * F.col("raised")
            own = own.withColumn("target", F.when(F.col("own") > 0, F.coalesce("g", part)).otherwise(0.0)).drop("g")
        own = kept(own, "groups")
        whole, n = own.agg(F.sum("target"), F.count_if(F.col("own") > 0)).first()
        even = F.when(F.col("own") > 0, F.lit(1 / max(n, 1))).otherwise(0.0)
        groups[dim] = own.withColumn("target", F.col("target") / F.lit(whole) if whole else even)
        room.append(float(groups[dim].where("target > 0").agg(F.sum("own")).first()[0] or 0))
    wanted, goals = min(room), {}
    for dim, own in groups.items():
        now = own.select(dim, "own", "target", F.lit(None).cast("double").alias("goal"))
        while True:  # each step takes all of some groups; few steps take all of any
            taken, left = now.agg(F.sum("goal"), F.sum(F.when(F.col("goal").isNull(), F.col("target")))).first()
            rate = (wanted - (taken or 0.0)) / left if left else 0.0
            full = F.col("goal").isNull() & (F.col("target") * rate >= F.col("own"))
            more = now.where(full & (F.col("target") > 0)).limit(1).count()
            now = now.withColumn("goal", F.when(full, F.when(F.col("target") > 0, F.col("own")).otherwise(0.0)).otherwise(F.col("goal")))
            if not more:
                now = now.withColumn("goal", F.coalesce("goal", F.col("target") * F.lit(rate)))
            now = kept(now, "goals")
            if not more:
                break
        goals[dim] = now
        if now.where(F.col("goal") < (F.col("target") - 1e-6) * wanted).limit(1).count():
            log.warning("%s: groups have too few tokens for their share, so all of them are taken", dim)
    factors = {dim: now.select(dim, F.lit(1.0).alias(f"f_{dim}")) for dim, now in goals.items()}
    gap, rounds = 0.0, 0
    for rounds in range(1, ROUNDS + 1):
        for dim, goal in goals.items():
            rows = cells
            for other in DIMENSIONS:
                rows = rows.join(factors[other], other) if other != dim else rows
            others = [F.col(f"f_{k}") for k in DIMENSIONS if k != dim]
            rows = kept(rows.select(dim, "tokens", (others[0] * others[1]).alias("o")), "rows")
            sums = rows.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("o")).alias("plain"))
            f = kept(goal.join(sums, dim).select(dim, "own", "goal", F.when(F.col("plain") > 0, F.col("goal") / F.col("plain")).otherwise(0.0).alias("f")), "factors")
            for _ in range(STEPS):
                capped = F.col("o") * F.col("f") >= 1
                step = rows.join(f, dim).groupBy(dim).agg(
                    F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("taken"), F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("o"))).alias("loose")
                )
                new = F.when(F.col("goal") <= 0, 0.0).when(F.col("goal") >= F.col("own") * (1 - 1e-12), ALL).when(F.col("loose") > 0, F.greatest(F.col("f"), F.least((F.col("goal") - F.col("taken")) / F.col("loose"), F.lit(ALL)))).otherwise(F.col("f"))
                f = kept(f.join(step, dim).select(dim, "own", "goal", new.alias("f"), (F.abs(new - F.col("f")) > 1e-13 * F.col("f")).alias("moved")), "factors")
                if not f.where("moved").limit(1).count():
                    break
            factors[dim] = kept(f.select(dim, F.when(F.col("goal") > 0, F.greatest("f", F.lit(LEAST))).otherwise(0.0).alias(f"f_{dim}")), "factors")
        rows = cells
        for dim in DIMENSIONS:
            rows = rows.join(factors[dim], dim)
        fit = F.col("tokens") * F.least(F.lit(1.0), F.col("f_source") * F.col("f_lang") * F.col("f_topic"))
        fitted = kept(rows.select(*DIMENSIONS, "tokens", fit.alias("fit")), "fitted")
        gap = max(float(fitted.groupBy(dim).agg(F.sum("fit").alias("s")).join(goals[dim], dim).agg(F.max(F.abs(F.col("s") - F.col("goal")))).first()[0] or 0) for dim in DIMENSIONS) / max(wanted, 1e-300)
        if gap < CLOSE:
            break
    if gap >= CLOSE:
        log.warning("raking stopped short after %d rounds: a group was %g from its share", rounds, gap)
    whole = float(fitted.agg(F.sum("fit")).first()[0] or 0)
    p = F.when(F.col("tokens") > 0, F.col("fit") / F.col("tokens")).otherwise(1.0)
    out = written(fitted.select(*DIMENSIONS, (F.col("fit") / F.lit(max(whole, 1e-300))).alias("weight"), p.alias("probability")), "probabilities")
    for path in filter(None, tables):
        removed(spark, path)
    return out


def mixed(
    docs: DataFrame,
    share: float = 0.5,
    power: float = 0.7,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = 42,
    out: str | None = None,
) -> DataFrame:
    """``docs`` with a struct of tokens, topic, weight (fitted share of its cell), probability and sampled.

    ``targets`` gives shares to groups of source, lang or topic (OTHERS: all groups not named together; groups without a
    share are left out); a dimension without targets has its own shares to ``power``. ``share`` is the expected
    share of all tokens. Groups that have too few tokens are taken whole and their rest goes to the others; what can't be
    met is logged. A document is sampled if a number drawn from its id and the seed is below its probability: rows that
    repeat an id are taken or left together within a cell. Null sources and languages are groups of their own. Documents
    without words weigh nothing and are always taken. All columns of the input stay; the struct is named ``out``, or
    ``mix`` with as many underscores before it as keep it apart from them. An empty table gives an empty result.
    """
    out = out or fresh(docs, "mix")
    names = {k: fresh(docs, f"_{k}") for k in (*DIMENSIONS, "tokens")}
    weight, probability = fresh(docs, "_weight"), fresh(docs, "_probability")
    chances = probabilities(written(cells_of(docs), "cells"), share, power, targets)
    keys = {k: f"{names[k]}_" for k in DIMENSIONS}
    chances = chances.withColumnsRenamed(keys | {"weight": weight, "probability": probability})
    rows = with_cells(docs, names)
    same = [F.col(names[k]) == F.col(v) for k, v in keys.items()]
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) * F.lit(2.0**-53)
    mix = F.struct(
        F.col(names["tokens"]).alias("tokens"), F.col(names["topic"]).alias("topic"), F.col(weight).alias("weight"),
        F.col(probability).alias("probability"), (draw < F.col(probability)).alias("sampled"),
    )
    return rows.join(chances, same).select(*[F.col(f"`{c}`") for c in docs.columns], mix.alias(out))


def sampled(docs: DataFrame, **options: object) -> DataFrame:
    """The documents that ``mixed`` samples, with the columns of the input."""
    out = fresh(docs, "mix")
    return mixed(docs, out=out, **options).where(f"`{out}`.sampled").select(*[F.col(f"`{c}`") for c in docs.columns])
