"""The corpus pipeline: toxicity, near copies, benchmark passages, personal data, tokens.

Each stage gets what its predecessor has written and works on all of it. The first three drop
documents, the fourth rewrites texts, the last turns them into tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import bpe, containment, copies, pii, toxicity
from laneflow.llm.shared import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learnt from the labels of those that are here."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word Jaccard of 0.8): that with the least id."""
    return copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return containment.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return pii.redacted(docs, pii.trained(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents and what they decode to."""
    return bpe.encode_decode(docs, bpe.Vocabulary.read(bpe.public_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("tokens", tokenize),
]

#: Trained models and fingerprints have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what its predecessor has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
