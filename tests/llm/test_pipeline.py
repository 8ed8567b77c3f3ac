"""The pipeline and the registered queries on the smallest driver tables."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.compare import compare, connect
from tests.llm.data import documents
from wellspark.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLE[name]) == ""


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_covers_the_table(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    if name.startswith("op10"):
        assert df.count() == 10 * df.select("query_id").distinct().count() > 0
    else:
        docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
        assert df.select("doc_id").distinct().count() == docs.count()


def test_stages_on_awkward_documents(spark):
    docs = documents(spark)
    for name, step in corpus_pipeline.STAGES[:-1]:
        result = step(spark, docs, SF_DIR)
        assert result.columns == docs.columns, name
        docs = corpus_pipeline.stage(result, name)
        assert 0 < docs.count() <= 200
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() > 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and all(r["n_tokens"] <= 2048 and len(r["doc_ids"]) == r["pieces"] for r in rows)
