"""Run configuration and golden records."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from parchment.operators.evaluation import GOLDEN


@dataclass(frozen=True)
class Config:
    workers: int = 4
    limit: int | None = None
    budget: int | None = None
    max_output: int = 300
    backend: str = "fake"
    batch: int = 256
    tokenizer: str | None = None
    raw: dict = field(default_factory=dict)

    @property
    def section(self) -> dict:
        return self.raw.get("backend", {}).get(self.backend, {})

    @property
    def prices(self) -> tuple[float, float]:
        own = self.raw.get("pricing", {}).get(self.backend, {})
        return float(own.get("input_per_million", 0.0)), float(own.get("output_per_million", 0.0))

    @property
    def model(self) -> str:
        key = {"llama_server": "model_file", "ollama": "model_tag"}.get(self.backend)
        return str(self.section.get(key, self.backend)) if key else self.backend


def load(path: str | None) -> Config:
    """A TOML file; zero limits and budgets mean none."""
    raw = tomllib.loads(Path(path).read_text("utf-8")) if path else {}
    run, backend = raw.get("run", {}), raw.get("backend", {})
    return Config(
        workers=int(run.get("workers", 4)), limit=run.get("limit_docs", run.get("limit")) or None,
        budget=run.get("budget_tokens", run.get("budget")) or None, max_output=int(run.get("max_output_tokens", 300)),
        backend=backend.get("name", "fake"), batch=int(run.get("batch_docs", 256)), tokenizer=run.get("tokenizer"), raw=raw,
    )


def write_golden(rows: DataFrame, path: str) -> int:
    """Write golden records as JSON lines with sorted keys, in the order of their first file; returns how many. They are few: each
    is written by hand or by a fixture, and all go to one file, so they come to the driver."""
    out = [r.asDict(recursive=True) for r in rows.collect()]
    for r in out:
        r["files"] = sorted(r["files"] or [])
    out.sort(key=lambda r: r["files"][:1])
    text = "".join(json.dumps(r, ensure_ascii=False, sort_keys=True, default=str) + "\n" for r in out)
    Path(path).write_text(text, "utf-8")
    return len(out)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Expected records, a JSON object a line; blank lines are skipped."""
    return spark.read.schema(GOLDEN).json(path).where("files is not null")
