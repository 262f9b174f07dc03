"""A training corpus from raw documents: five stages, each on all that the one before kept.

1. toxicity: documents predicted toxic go.
2. near_dedup: of each class of near duplicates the document with the least id stays.
3. decontamination: documents that hold too much of a benchmark item go.
4. personal_data: personal data in the texts is replaced by its kind.
5. source_mix: every source's target and how many words of each document the mix takes.

All but the last return the columns of ``documents``; the last adds four. A NULL or
empty text passes every stage (only equal empty texts are duplicates) and takes no words;
an empty table gives an empty one; other columns ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyflow.llm import decontamination, mixing, order_minhash, personal_data, toxicity
from tallyflow.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.redact(docs, personal_data.train_selector(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, keep=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
]

#: Trained models, sketches and seeded choices have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
