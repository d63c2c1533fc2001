"""The package's queries: shape of the results, and checking SQL where there is some."""

import pytest

from harness import compare, connect
from loomline.llm import entry

COLUMNS = {
    "p1_found": ["doc_id", "found_language"], "p2_found": ["doc_id", "markup"], "p3_found": ["doc_id_a", "doc_id_b"], "p4_found": ["doc_id"],
    "p6_found": ["tbl", "rec_key"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in COLUMNS:
        assert len(set(rows)) == len(rows) > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, sf, name):
    assert compare(spark, name, sf, connect(sf)) == ""
