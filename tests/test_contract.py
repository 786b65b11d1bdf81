"""The driver's contract on the smallest data, where it is present."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "p4_found", "eval_summary"} <= set(queries)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if entry.queries()[n].__module__.startswith("lumenloom.plans.")))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    # The engines round a tie in the sixth place differently, so numbers are compared to within one there.
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    plain = lambda v: "null" if v is None else float(v) if number(v) or type(v).__name__ == "Decimal" else str(v)
    order = lambda row: [(f"{v:.3f}" if isinstance(v, float) else v) for v in row]
    ours = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=order)
    theirs = sorted(([plain(v) for v in row] for row in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=order)
    assert len(ours) == len(theirs)
    for mine, other in zip(ours, theirs):
        assert [v if isinstance(v, str) else pytest.approx(v, abs=1.5e-6, nan_ok=True) for v in other] == mine
