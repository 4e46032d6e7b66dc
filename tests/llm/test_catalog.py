import pytest

from loomwork.llm import catalog

COLUMNS = {
    "p1_found": ["session_id", "turn_no", "entry_id"], "p3_found": ["row_table", "row_id", "part_no", "kind", "found_text"], "p4_found": ["place", "row_id", "part_no", "found_text"],
    "p5_found": ["rule_a", "rule_b"], "p8_found": ["doc_id", "para_no", "lang"],
}


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.count() > 0
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    assert df.count() == df.distinct().count() if name.endswith("_found") else True


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = c.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, sf).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
