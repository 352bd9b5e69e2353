"""Documents to packed training sequences: toxicity, exact copies, near copies, repeated
passages, packing. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import exact, jaccard, packing, repeats, toxicity
from veilspark.llm.queries import TOXIC_FROM, VOCABULARY, held_out
from veilspark.llm.tables import private, read, staged


def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from labels of ``docs``."""
    labels = read(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    score, hits = private(docs, "score"), private(docs, "hits")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), score_col=score, hits_col=hits)
    return scored.where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents with equal texts the one with the least id stays."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarity of 0.8 or more one stays."""
    return jaccard.one_of_each(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out."""
    cut = repeats.remove_repeats(docs, layout=True, words_col=private(docs, "words"), removed_col=private(docs, "removed"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("substring dedup", passages_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # scores, MinHash and a tokenizer are beyond SQL; tested against brute force


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read back."""
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
