"""Text statistics of all documents, against brute force and, where the SQL has rows, against the SQL."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def brute_force(text):
    words = (text or "").split()
    return (None if text is None else len(text), len(words), len(set(words)), math.ceil(len(words) / 0.75))


def result(spark, folder):
    rows = entry.queries()["text_statistics"](spark, folder).collect()
    got = {r.doc_id: (r.n_chars, r.n_words, r.n_unique, r.token_estimate) for r in rows}
    assert len(got) == len(rows)
    return got


def test_texts_of_every_script(spark, tmp_path):
    spaces = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    texts = [None, "", " \t\n", "plain text", "caf\u00e9 caf\u00e9 \u2013 na\u00efve", "\u6587\u5b57\u3000\u6587\u5b57", "\u0441\u043b\u043e\u0432\u043e\u00a0\u0434\u0432\u0430", "x".join(spaces), spaces, "a\u200bb \U0001f600", "a\x00b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert result(spark, str(tmp_path)) == {i: brute_force(t) for i, t in enumerate(texts)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_all_documents_and_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    got = result(spark, SF)
    assert got == {r.doc_id: brute_force(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    every = con.sql(f"SELECT doc_id, n_chars, n_words, n_unique, token_estimate FROM ({entry.oracle_sql()['text_statistics']})").fetchall()
    assert {r[0]: r[1:] for r in every} == got
