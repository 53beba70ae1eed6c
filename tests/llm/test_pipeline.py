import inspect

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept <= ids
        ids = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == ids


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert set(entry.oracle_sql()) <= set(names)
    assert "except ImportError" not in inspect.getsource(corpus_pipeline)


@pytest.mark.parametrize("name", ["op1_warc_transactions", "op6_suffix_repeats", "op7_recompression_repeats", "op8_exact_dedup"])
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("pages", "documents"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
