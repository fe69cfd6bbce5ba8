"""The driver contract: names, and a part of the queries against DuckDB on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from codexmill.plans import queries as engine

DATA = "/root/testdata/sf0.001"
SOME = ["node_ids", "chunk_small", "upsert_nodes", "remap_edges", "bm25_nodes", "knn_l2", "rrf_pools", "follow_link", "health_stats", "cascade_bfs", "tfidf_keywords", "best_match", "doc_library", "queue_position", "exact_match", "match_score", "read_node", "query_by_id", "successor", "merged_reports", "citations", "described", "edge_scan", "edges_one_way", "items_by_id", "source_lookup", "vector_lookup", "delete_items", "set_vectors", "set_meta", "sidebar", "keyword_edges", "communities_by_size", "library_order", "bm25_phrases", "cluster_signature", "link_notes", "markdown_segments", "evidence_items", "note_titles"]


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(engine.QUERIES) > 60


def shown(value):
    return repr(round(float(value), 5)) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    cursor = con.execute(engine.SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(shown(v) for v in row) for row in cursor.fetchall())
    df = engine.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(shown(v) for v in row) for row in df.select(*names).collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_flagship(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(1 <= r["rank"] <= 20 and r["n_evidence"] <= 3 for r in rows)


def test_deleting_items_cuts_texts_once(spark):
    from codexmill.plans import queries

    plan = queries.QUERIES["delete_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "posexplode" not in plan
