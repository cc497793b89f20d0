"""Joins of files with their documents, and what must not be left over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files_without_document(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files whose document isn't there; none, or the state is broken."""
    return files.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def documents_without_file(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that no file leads to, as a file leaves them whose content changed under a known path."""
    return documents.join(files.select(F.col("document_id").alias("id")), "id", "left_anti")


def files_with_documents(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Each file with the state of its document."""
    return files.join(documents.withColumnRenamed("id", "document_id").drop("source_text"), "document_id")
