import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() == 193


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["error_rate", "key_steps", "hamming_pairs_d1", "contains_edit", "dissect_adjacency", "dedup_output_directional", "trie_shape", "positional_zip"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "nation"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.select(*columns).fetchall())
