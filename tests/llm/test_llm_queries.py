"""The registered queries over whole small tables, the SQL they have, and the pipeline's stages."""

import pytest
from oracle import difference

import corpus_pipeline
from cordage.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    if name in Q.SQL:
        assert difference(df, SF, Q.SQL[name]) is None
    else:
        assert df.count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < out.count() <= kept.count(), name
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert sorted(r.doc_id for r in packed.collect()) == sorted(r.doc_id for r in kept.collect())
