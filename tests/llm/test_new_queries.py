"""The registered queries of operators 11 to 13 against their SQL."""

import os

import duckdb
import pytest

from loomframe.llm import queries

AT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(AT), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_warc", "op12_merkle_manifest", "op13_fill_in_middle"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    df = queries.QUERIES[name](spark, AT)
    found = con.execute(queries.oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str(list(r)) for r in found.fetchall())
