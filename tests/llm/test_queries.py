"""The registered queries against DuckDB, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from compare import compare
from recordlake.llm import near_duplicates
from recordlake.llm.common import cut_lineage, table
from recordlake.llm.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, name) == ""


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut_lineage(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        if name == "near_duplicates":
            assert near_duplicates.near_duplicates(out).where("NOT kept").count() == 0
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.where("start = 0").count() == docs.count()
