"""Queries against their SQL on the smallest tables, and the pipeline's stages."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import queries, token_counts

BASE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{BASE}/{t}.parquet')")
    got = queries.QUERIES[name](spark, BASE).toPandas()
    want = con.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(x):
        """pandas gives whole numbers with nulls as floats with NaN or as integers with NA."""
        if x is pd.NA or x is None or x != x:
            return "null"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(round(x, 6)) if isinstance(x, float) else str(x)

    def rows(df):
        return sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False))

    assert rows(got) == rows(want)


def test_archive_sql_and_query_agree_on_repeated_payloads(spark, tmp_path):
    pages = [(7, "u", "<p>a</p>"), (3, "v", "<p>a</p>"), (9, None, "<p>a</p>"), (4, "w", None), (5, "w", ""), (6, "x", "\u00e4\r\n\r\n"), (8, "x", "b")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"SELECT {names} FROM ({queries.SQL['op4_warc']})").fetchall()
    got = [tuple(r) for r in queries.op4_warc(spark, str(tmp_path)).select(*names.split(", ")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[0]: r[4] for r in got} == {7: 3, 9: 3, 3: None, 4: None, 5: 4, 6: None, 8: None}


def test_archive_sql_and_query_agree_on_null_and_repeated_ids(spark, tmp_path):
    pages = [(None, "u", "a"), (None, "v", "a"), (None, "v", "b"), (2, "v", "b"), (2, "w", "b"), (2, "w", "c")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"SELECT {names} FROM ({queries.SQL['op4_warc']})").fetchall()
    got = [tuple(r) for r in queries.op4_warc(spark, str(tmp_path)).select(*names.split(", ")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_token_query_inserts_revises_and_deletes_every_document(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    rollup = token_counts.TokenRollup(spark, queries.shared_folder(spark))
    queries.token_history(rollup, docs)
    versions = ["words", "byte_bpe_50k"]
    n, counts = docs.count(), queries.staged(token_counts.counted(docs, versions))
    ledger = rollup.ledger().groupBy("batch").agg(F.sum(F.greatest("sign", F.lit(0))).alias("put"), F.sum(F.least("sign", F.lit(0))).alias("back"))
    got = {r.batch: (r.put, r.back) for r in ledger.collect()}
    assert got["load"] == got["again"] == (2 * n, 0) and got["gone"] == (0, -2 * n)
    chars = {r.doc_id: -(-len(r.text or "") // 4) for r in docs.collect()}
    changed = sum(r.tokens != chars[r.doc_id] for r in counts.collect())
    assert got["recount"] == (changed, -changed) and changed > n

    def rows(df):
        return sorted(map(str, df.select("source", "lang", "tokenizer", "docs", "tokens").collect()))

    want = counts.groupBy("source", "lang", "tokenizer").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    assert rows(rollup.totals()) == rows(want) == rows(queries.op6_token_counts(spark, BASE))


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.staged(stage(spark, docs, BASE))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < docs.count() <= before
        before = docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, BASE).toPandas()
    assert sorted(mixed["doc_id"]) == sorted(r.doc_id for r in docs.select("doc_id").collect())
