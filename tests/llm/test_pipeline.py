"""The stages together, and the registered queries."""

import __spark_entry__ as contract
import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.brute import SCHEMA, odd_frame


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    assert corpus_pipeline.run(spark, SMALL).filter("taken > 3 * size").count() == 0


def test_stages_take_odd_and_empty_tables(spark):
    odd, empty = odd_frame(spark), spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name
        assert stage(spark, odd, SMALL).count() > 0, name


def test_every_operator_is_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
