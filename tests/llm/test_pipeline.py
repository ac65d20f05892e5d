import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:4] == ["doc_id", "piece", "start", "length"]
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert 0.7 * docs.count() < len(kept) <= docs.count()
    # brute force of what must go: all but one of the exact copies, contaminated documents
    first = docs.groupBy("text").agg(F.min("doc_id").alias("d"))
    assert kept <= {r.d for r in first.collect()}
    contaminated = {r.doc_id for r in queries.op7_decontamination(spark, SF).filter("contaminated").collect()}
    assert not kept & contaminated
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "secret_scans", "best_fit_packing"]


def test_stages_take_odd_rows(spark):
    rows = [(1, "the and of " * 8, "en", "s", 3), (1, "the and of " * 8, "en", "s", 3), (None, "of the and that " * 6, None, None, None), (2, None, "en", "s", None), (3, "", "de", "s", 0), (4, "der die das und " * 9, "de", "s", 3), (5, 'und der token = "0123456789abcdef0123" das und die der', "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"fp": F.lit(1), "__hash": F.lit("x"), "score": F.lit(2)})
    for d in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.columns == d.columns and out.count() <= d.count()
        assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() == d.count()
    kept = corpus_pipeline.language(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {1, None, 4, 5}
    assert corpus_pipeline.near_duplicates(spark, kept, SF).count() == 4
    hidden = corpus_pipeline.secret_scans(spark, kept, SF).filter("doc_id = 5").first()
    assert not re.search("[0-9a-f]{16}", hidden.text) and hidden.n_chars == len(hidden.text)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    df = queries.queries()[name](spark, SF)
    n = df.count()
    assert n > 0 if name.startswith(("op2", "op4")) else n == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    other = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in other.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, other.fetchall()))
