import sys
from pathlib import Path

import pytest

from weftline.llm import queries

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import rows_of, same  # noqa: E402


def n_documents(sf_dir):
    return rows_of("select count(*) from documents", sf_dir)[1][0][0]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    n = same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)
    assert n > 0 if name == "op13_ranked_search" else n == n_documents(sf_dir)  # that one has rows for items


def test_pipeline_equals_sql(spark, sf_dir):
    import corpus_pipeline

    n = same(corpus_pipeline.run(spark, sf_dir), corpus_pipeline.ORACLE_SQL, sf_dir)
    assert 0.5 * n_documents(sf_dir) < n < 3 * n_documents(sf_dir)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing", "sharding"]


def test_pipeline_edges(spark, edge_docs, no_docs, sf_dir):
    import corpus_pipeline

    for docs in (edge_docs, no_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            out.collect()
            assert out.columns[: len(columns)] == columns, name
            stage(spark, edge_docs, sf_dir).collect()


def test_sql_needs_nothing_but_tables(sf_dir):
    assert rows_of("select 1 as x", sf_dir) == (["x"], [(1,)])
