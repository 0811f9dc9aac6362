"""A bounded sample of labelled documents, for operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import fold

#: Labelled documents that a classifier is fitted on at most. They are those whose id hashes lowest.
FIT_ROWS = 20_000


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, text, label) of at most ``fit_rows`` labelled documents outside the held-out fold.

    The sampled ids and labels are at most ``fit_rows`` rows of 12 bytes, hence the broadcast. A
    document that is labelled twice takes part twice; null labels and null ids don't.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
    some = rows.select(F.col("doc_id").alias("fit_id"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("fit_id"), "fit_id", "label").limit(fit_rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("fit_id")).select("doc_id", "text", "label")
