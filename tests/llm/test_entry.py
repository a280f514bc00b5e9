import os

import duckdb
import pytest

import corpus_pipeline
from pagewright.llm import entry

DATA = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(names) == 11 and "pipeline" in names and set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "bpe"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages_against_each_other(spark):
    """Each stage's decisions, taken again by its operator on the stage's own input."""
    from pagewright.llm.decontaminate import decontaminate
    from pagewright.llm.near_dedup import near_duplicates

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    clean = corpus_pipeline.toxicity(spark, docs, DATA).cache()
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    one = corpus_pipeline.near_dedup(spark, clean, DATA).cache()
    want = {r.doc_id for r in near_duplicates(clean, 80).collect() if r.doc_id == r.component}
    assert {r.doc_id for r in one.select("doc_id").collect()} == want
    cut = corpus_pipeline.suffix_dedup(spark, one, DATA).cache()
    assert cut.columns == columns and cut.count() == one.count()
    kept = corpus_pipeline.decontamination(spark, cut, DATA)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in decontaminate(cut, bench).collect() if not r["items"]}
    ids = corpus_pipeline.bpe(spark, kept, DATA)
    assert ids.count() == kept.count() and set(ids.columns) >= {"doc_id", "n_tokens"}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == {r.doc_id for r in ids.collect()}
