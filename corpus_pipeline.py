"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; a runner may write it as Parquet and read it again before
the next stage. All but the last give the columns of documents. ORACLE_SQL is None: the classifier, the forest and the
models of secrets aren't expressible in SQL; tests/llm compares run() with a plain version on a small fixture.

Defined cases, of every stage: null ids, texts, languages and sources are values like others (a null text has no words,
is kept and takes no part in the mix); rows that repeat id and text become one in the n-gram stage; ties are broken by
id, then by the hash of the text; texts are read whole, however long; without labels, benchmark items or documents a
stage changes nothing; columns beyond those of documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltwork.llm import decontaminate, lshforest, mixing, quality, secrets
from siltwork.session import cut_lineage, read_table

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return lshforest.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages shared with benchmark items are cut out; documents made of them for the most part go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secrets.redact(docs, secrets.train(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the words to take from each."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
