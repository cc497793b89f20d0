"""Validation of extracted fields against their source."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions import candidates, fixed, text
from parchment.functions.text import sound

PARSED = (
    "doc_type string, counterparty_name string, counterparty_tax_id string, issue_date string, due_date string, "
    "gross_amount string, currency string, summary string"
)
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


class Number(str):
    """A JSON number as its digits, however many."""


def parsed(raw: str | None) -> tuple[dict | None, str | None]:
    """Fields of an answer, or what is wrong with it. Keys that aren't fields are passed over; of a repeated key the
    last counts. Never raises, and gives nothing that can't be encoded."""
    try:
        data = json.loads(raw or "", parse_float=Number, parse_int=Number, parse_constant=Number)
    except (ValueError, RecursionError) as e:
        return None, sound(f"not JSON: {e}"[:500])
    if not isinstance(data, dict):
        return None, "not an object"
    data = {k: sound(v) if type(v) is str else v for k, v in data.items()}
    is_text = lambda name: type(data.get(name)) is str
    if not is_text("doc_type") or data["doc_type"] not in fixed.DOC_TYPES:
        return None, "doc_type is missing or unknown"
    if not is_text("summary"):
        return None, "summary is missing or not text"
    out = {"doc_type": data["doc_type"], "summary": data["summary"]}
    for name in ("counterparty_name", "counterparty_tax_id", "currency"):
        if data.get(name) is not None and not is_text(name):
            return None, f"{name} isn't text"
        out[name] = data.get(name)
    for name in ("issue_date", "due_date"):
        value = data.get(name)
        if value is not None:
            try:
                if not is_text(name) or not _DAY.fullmatch(value):
                    raise ValueError
                pd.Timestamp(value)
            except ValueError:
                return None, f"{name} isn't a date"
        out[name] = value
    value = data.get("gross_amount")
    if not (value is None or isinstance(value, Number) or is_text("gross_amount") and _NUMBER.fullmatch(value.strip())):
        return None, "gross_amount isn't a number"
    out["gross_amount"] = None if value is None else str(value).strip()
    return out, None


#: What a worker returns of an answer; the normal form of the name comes along, which saves a pass through Python.
_ANSWER = pa.struct([
    ("parsed", pa.struct([(x.split()[0], pa.string()) for x in PARSED.split(", ")])), ("parse_error", pa.string()), ("name_form", pa.string()),
])


def _answers(raw: Column | str) -> Column:
    """The struct of _ANSWER of each answer."""

    def answer(x: str | None) -> dict:
        found, error = parsed(x)
        name = (found or {}).get("counterparty_name")
        return {"parsed": found or {}, "parse_error": error, "name_form": None if name is None else text.normal_form(name)}

    @F.arrow_udf(f"parsed struct<{PARSED.replace(' string', ':string')}>, parse_error string, name_form string")
    def run(raw: pa.Array) -> pa.Array:
        parts = (raw.slice(i, text.SLICE).to_pylist() for i in range(0, len(raw), text.SLICE))
        out = [pa.array([answer(x) for x in part], _ANSWER) for part in parts]
        return pa.concat_arrays(out) if out else pa.array([], _ANSWER)

    return run(raw)


def _unpacked(rows: DataFrame) -> DataFrame:
    """``rows`` with the struct ``parsed`` (null if the answer can't be used) and ``parse_error`` out of ``_p``."""
    return rows.withColumns({"parsed": F.when(F.col("_p.parse_error").isNull(), F.col("_p.parsed")), "parse_error": F.col("_p.parse_error")})


def with_parsed(rows: DataFrame, raw_col: str) -> DataFrame:
    """``rows`` with the struct ``parsed`` (null if the answer can't be used) and ``parse_error``."""
    return _unpacked(rows.withColumn("_p", _answers(raw_col))).drop("_p")


def checked(
    rows: DataFrame, source: str, normal_source: str, normal_name: str, parsed_col: str = "parsed", error_col: str = "parse_error"
) -> DataFrame:
    """Check each field of ``parsed`` against its source; native expressions throughout.

    Adds the eight fields, ``nulled_fields`` in the order of the checks, ``needs_repair`` and ``error``. Names and tax
    ids must occur in the source; dates and amounts need a source with any date or amount in it; a currency must be
    known, and an amount without one goes too. A blank summary needs repair, which is decided last.
    """
    p, near = F.col(parsed_col), F.col("_near")
    rows = rows.withColumns({
        "_tax": F.nullif(text.digits(p["counterparty_tax_id"]), F.lit("")),
        "_near": candidates.near_digits(F.col(source)),
        "_currency": text.currency(p["currency"]),
    })
    rows = rows.withColumns({
        "_dates": near.rlike(candidates.DATE),
        "_amounts": near.rlike(candidates.AMOUNT),
        "_name_ok": candidates.occurs_in(p["counterparty_name"], near, F.col(normal_name), F.col(normal_source)),
        "_tax_ok": candidates.occurs_in(F.col("_tax"), near, F.col("_tax"), F.col(normal_source)),
    })
    name_ok, tax_ok = F.col("_name_ok"), F.col("_tax_ok")
    has = lambda c: p[c].isNotNull()
    number = F.when(F.col("_amounts"), text.amount(p["gross_amount"]))
    orphan = F.col("_currency").isNull() & number.isNotNull()
    nulled = F.array_compact(F.array(
        F.when(has("counterparty_name") & ~name_ok, "counterparty_name"),
        F.when(has("counterparty_tax_id") & ~tax_ok, "counterparty_tax_id"),
        F.when(has("issue_date") & ~F.col("_dates"), "issue_date"),
        F.when(has("due_date") & ~F.col("_dates"), "due_date"),
        F.when(has("gross_amount") & ~F.col("_amounts"), "gross_amount"),
        F.when(has("currency") & F.col("_currency").isNull(), "currency"),
        F.when(orphan, "gross_amount"),
    ))
    blank = F.trim(p["summary"]) == ""
    repair = p.isNull() | F.coalesce(blank, F.lit(True))
    day = lambda c: F.when(F.col("_dates"), p[c].try_cast("date"))
    good = lambda c: F.when(~repair, c)
    return rows.withColumns({
        "doc_type": good(p["doc_type"]),
        "counterparty_name": good(F.when(name_ok, p["counterparty_name"])),
        "counterparty_tax_id": good(F.when(tax_ok, F.col("_tax"))),
        "issue_date": good(day("issue_date")),
        "due_date": good(day("due_date")),
        "gross_amount": good(F.when(F.col("_currency").isNotNull(), number)),
        "currency": good(F.col("_currency")),
        "summary": good(p["summary"]),
        "nulled_fields": F.when(repair, F.array().cast("array<string>")).otherwise(nulled),
        "needs_repair": repair,
        "error": F.when(p.isNull(), F.coalesce(F.col(error_col), F.lit("no answer"))).when(blank, "summary is empty"),
    }).drop("_tax", "_near", "_dates", "_amounts", "_name_ok", "_tax_ok", "_currency")


def validated(rows: DataFrame, raw_col: str, source_col: str) -> DataFrame:
    """Parse and check answers; normal forms are exact. Both go through one pass of Python, and so one worker a task."""
    out = _unpacked(rows.withColumns({"_p": _answers(raw_col), "_source": text.normalized(F.col(source_col))})).withColumn("_name", F.col("_p.name_form"))
    return checked(out, source_col, "_source", "_name").drop("_source", "_name", "parsed", "parse_error", "_p")
