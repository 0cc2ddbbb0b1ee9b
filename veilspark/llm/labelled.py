"""Bounded samples of labelled documents, for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import held_out

#: Rows that a classifier is fitted on at most.
SAMPLE = 12_000


def sample(docs: DataFrame, labels: DataFrame, names: list[str], text: str = "text", doc_id: str = "doc_id", most: int = SAMPLE, folds: int = 3, fold: int = 1) -> DataFrame:
    """``doc_id, text, <names>`` of at most ``most`` labelled documents that aren't held out.

    The ids of the least hashes are drawn, so the sample is the same each time; of rows
    with one id the largest labels count, and rows without one of the labels or without an
    id don't. The drawn labels are few, so they are broadcast to the documents.
    """
    drawn = F.pmod(F.xxhash64(F.lit(11), F.col(doc_id).cast("string")), F.lit(1 << 30))
    usable = labels.where(~held_out(doc_id, folds, fold)).groupBy(doc_id).agg(*(F.max(n).cast("double").alias(n) for n in names)).dropna()
    few = usable.where(F.col(doc_id).isNotNull()).orderBy(drawn, doc_id).limit(most)
    once = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return once.join(F.broadcast(few.select(F.col(doc_id).alias("doc_id"), *names)), "doc_id")
