"""Registered engine queries against their SQL, and the driver's entry points."""

import os

import pytest

from chronograft.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SOME = [
    "agg_cand_summary", "agg_counters", "agg_nlf", "agg_vertex_duration", "bfs_child_filter", "bfs_match", "cand_expand", "dec_score_temporal",
    "ds_bucket", "ds_count_durable", "ds_history", "fn_interval_intersect", "fn_union_duration", "match_active_string", "match_count_only",
    "match_hops", "match_reciprocal", "match_reduced", "match_selfloop", "match_triangle", "mini_total_duration_match", "pre_compact",
    "pre_consecutive_filter", "pre_labels", "src_native_graph", "dec_tree_temporal", "ds_filter_counts", "static_max_results", "static_multilabel", "trim_top_down",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
