"""Queries of the library beside their SQL, on a few rows of each table; all of them with ALL_QUERIES=1."""

import os

import duckdb
import pytest

from quire import queries_formats, queries_nodes, queries_resources  # noqa: F401  they add their queries
from quire.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
FEW = {
    "documents": "doc_id < 9", "pages": "page_id < 8", "part": "p_partkey % 17 = 1", "customer": "c_custkey < 6", "conversations": "conv_id < 5", "nation": "true", "supplier": "s_suppkey % 5 = 0",
    "orders": "o_custkey < 9", "lineitem": "l_orderkey in (select o_orderkey from '{}/orders.parquet' where o_custkey < 9)", "region": "true"}


#: Run unless all are asked for: those that between them touch every module.
SOME = (
    "heading_outline section_blocks header_inheritance grid_offsets hyperlinks comment_threads replace_count relationship_targets diagnostic_summary style_hidden_text small_caps_text empty_documents label_edge_cases "
    "link_roundtrip link_markup link_segments layered_paragraphs cell_fonts painted_cell_fonts border_conflict column_widths subtree_counts table_descendants comment_faults unreached_marks crossed_ranges "
    "comment_date_forms edited_paragraphs split_runs replaced_ranges refused_removals added_links json_faults page_marks link_targets picture_headers shape_places").split()
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    out = tmp_path_factory.mktemp("small")
    con = duckdb.connect()
    for t, where in FEW.items():
        con.sql(f"copy (select * from '{DIR}/{t}.parquet' where {where.format(DIR)}) to '{out}/{t}.parquet'")
        con.sql(f"create view {t} as select * from '{out}/{t}.parquet'")
    return str(out), con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, name):
    folder, con = small
    rel = con.sql(ORACLES[name])
    cols = sorted(rel.columns)
    want = sorted(repr(r) for r in con.sql(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({ORACLES[name]})").fetchall())
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want
