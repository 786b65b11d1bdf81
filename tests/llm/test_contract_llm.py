"""The queries of this subpackage that have SQL, on the smallest data, where it is present."""

import os

import pytest

from lumenloom.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.isdir("/opt/tokenizers"), reason="no test data here")
@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    got = REGISTRY.queries[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(REGISTRY.sql[name])
    assert columns == sorted(want.columns)
    ours = sorted(str([r[c] for c in columns]) for r in got.collect())
    theirs = sorted(str(list(row)) for row in want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert ours == theirs


def test_every_problem_has_its_queries():
    assert {"p2_found", "p3_found", "p5_ids", "p6_packed", "p7_found"} <= set(REGISTRY.queries)
