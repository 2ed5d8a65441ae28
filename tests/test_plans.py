"""Registered queries against their SQL on the smallest tables, where these are there."""

from pathlib import Path

import pytest

from vellumix.plans import catalog, registry

DATA = Path("/root/testdata/sf0.001")
SOME = (
    "scan_extension referenced_files json_sidecar repair_rules common_prefix compare_member_sets nearest_ancestor set_operations ordered_union bibliography_numbers shredded_tree mapped_documents list_moves run_format_delta "
    "coalesce_adjacent articles_mapped article_assembled books_assembled constructs_assembled documents_disassembled forms_disassembled mapping_warnings no_formatting office_metadata office_tables office_lists office_named_lists "
    "office_books office_problems merged_after_proofreading merged_translation members_compared repair_damage xinclude sidecar_chain grammar_faults relative_paths"
).split()


def test_all_sql_belongs_to_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES) == set(registry.OPERATORS)
    assert all(registry.OPERATORS.values()) and len(catalog.QUERIES) > 100


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = catalog.QUERIES[name](spark, str(DATA))
    found = con.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(str, ([str(v) for v in row] for row in found.fetchall())))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, ([str(v) for v in row] for row in df.select(*columns).collect()))) == want
