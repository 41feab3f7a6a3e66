"""The queries that SQL can express, against it, on the driver's smallest tables; and the pipeline against its operators."""

import os

import pytest

import corpus_pipeline
from tracewell.llm import bpe, lines, minhash, mixing, quality, queries

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(d[sorted(d.columns)].astype(str).agg("|".join, axis=1)) if len(d) else []
    assert rows(got) == rows(want)


@here
def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = quality.keep(docs)
    full = quality.mask_of("v1") | quality.mask_of("base")
    assert {r.doc_id for r in kept.collect()} == {k for k, t in texts.items() if not quality.failed_bits(quality.measure(t)) & full}
    for make in (lambda d: lines.dedup(d), lambda d: minhash.dedup(d), lambda d: mixing.mixed(d)):
        before, kept = kept, make(kept).cache()
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in before.collect()}
    want = {tuple(r) for r in bpe.digests(bpe.encode_decode(kept)).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode"]
