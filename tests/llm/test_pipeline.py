"""The pipeline against a version without Spark's operators, and stage by stage on odd documents."""

import public_tokenizers

from blockwave.llm import bpe, decontam, pii, toxicity

from . import cases
from .test_nearcopies import plain_kept


def test_run_against_brute_force(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.01"

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in docs.collect() if not chain.rejects(r["text"])]
    low = plain_kept([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if r["doc_id"] in low]
    index = decontam.Benchmark([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    rows = [r for r in rows if not index.matches(r["text"])]
    enc, m = bpe.encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()), pii.model()
    want = sorted((r["doc_id"], *enc.digests(m.redact(r["text"]))) for r in rows)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert 0 < len(want) < docs.count()


def test_stages_on_odd_documents(spark, sf_dir):
    import corpus_pipeline

    docs = cases.frame(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for d in (docs, cases.empty(spark)):
            out = stage(spark, d, sf_dir)
            assert out.count() <= d.count(), name
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == d.columns, name


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(e)
    try:
        assert again.queries() and not [k for k in again.queries() if k.startswith("op") or k == "pipeline"]
    finally:
        monkeypatch.undo()
        importlib.reload(e)
