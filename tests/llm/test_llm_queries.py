import pytest

import __spark_entry__ as entry
import corpus_pipeline
from keyloom.llm import exact_dedup, language_id, simhash
from keyloom.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and len(QUERIES) == 10


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "mixing", "sentencepiece"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    a = stages[0](spark, docs, sf_dir)
    assert a.columns == docs.columns
    und = language_id.language_id(docs).where("lang_pred = 'und'").count()
    assert a.count() == docs.count() - und
    b = stages[1](spark, docs, sf_dir)
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in exact_dedup.exact_dedup(docs, keep="largest").where("kept").collect()}
    c = stages[2](spark, b, sf_dir)
    assert {r.doc_id for r in c.collect()} == {r.component_id for r in simhash.simhash(b).collect()}
    d = stages[3](spark, c, sf_dir)
    assert d.columns == docs.columns and {r.doc_id for r in d.collect()} <= {r.doc_id for r in c.collect()}
    assert stages[4](spark, d, sf_dir).where("NOT round_trip").count() == 0
