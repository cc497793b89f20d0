"""Token counts: by a tokenizer's file, loaded once a worker, by any function, or by the estimate of four characters a token."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A function of a text, a path of a tokenizer's file (tokenizers' JSON or a sentencepiece model), or None for the estimate.
Source = Callable[[str], int] | str | None


@lru_cache(2)
def _loaded(data: bytes, kind: str) -> Callable[[str], int]:
    if kind == ".model":
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda text: len(own.encode(text))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_buffer(data)
    return lambda text: len(whole.encode(text).ids)


class Counter:
    """Counts tokens of texts on the driver (``of``) and of columns (``column``), by one and the same tokenizer."""

    def __init__(self, spark: SparkSession, source: Source = None) -> None:
        self.source = source
        if isinstance(source, str):
            path = Path(source)
            if path.suffix not in (".json", ".model"):
                raise ValueError(f"unknown kind of tokenizer: {path.name}")
            self.kind, self.data = path.suffix, path.read_bytes()
            self.sent = spark.sparkContext.broadcast(self.data)

    def of(self, text: str) -> int:
        if self.source is None:
            return -(-len(text) // 4)
        return self.source(text) if callable(self.source) else _loaded(self.data, self.kind)(text)

    def column(self, text: Column) -> Column:
        """Tokens of each text; null for null."""
        if self.source is None:
            return F.ceil(F.length(text) / 4).cast("long")
        if callable(self.source):
            count = self.source
            make = lambda: count
        else:
            sent, kind = self.sent, self.kind
            make = lambda: _loaded(sent.value, kind)

        @F.pandas_udf("long")
        def run(texts: pd.Series) -> pd.Series:
            count = make()
            return pd.Series([None if x is None else count(x) for x in texts], dtype="Int64")

        return run(text)
