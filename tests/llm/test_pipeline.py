import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_one_by_one(spark, small_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, small_dir).cache()
        assert made.columns == columns
        ids = {x["doc_id"] for x in made.select("doc_id").collect()}
        known = {x["doc_id"] for x in docs.select("doc_id").collect()}
        assert ids <= known
        if name == "quality":
            good = {i for i in known if labels.get(i) == 1}
            bad = {i for i in known if labels.get(i) == 0}
            assert len(good - ids) <= 0.02 * len(good) and len(bad & ids) <= 0.2 * len(bad)
        if name == "exact_dedup":
            assert made.selectExpr("lower(text)").distinct().count() == made.count()
        if name == "mix":
            assert ids == known and made.count() >= docs.count()
        docs = made
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).collect()
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(out) == docs.count() and before > 0
    for row in out[::20]:
        assert np.frombuffer(row["ids"], "<u4").tolist() == library.encode(texts[row["doc_id"]], add_special_tokens=False).ids


def test_run_is_registered():
    entry = pytest.importorskip("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
