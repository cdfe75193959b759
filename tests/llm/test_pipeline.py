"""The pipeline over a small corpus with planted rows, and over odd and empty tables."""

import gc
from pathlib import Path

import corpus_pipeline
import pytest
from fathomline.llm.common import give_back
from fathomline.llm.quality_model import QualityModel
from fathomline.llm.toxicity import ToxicityModel
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    base = docs.where("text IS NOT NULL").orderBy(F.desc("n_chars")).limit(1).first()
    copy = base.text.replace(base.text.split()[5], "changed", 1)
    more = spark.createDataFrame([(90_001, base.text, base.lang, base.source, base.n_chars), (90_002, copy, base.lang, base.source, base.n_chars), (90_003, None, None, None, None), (90_004, "", "en", "x", 0)], docs.schema)
    docs.union(more).withColumn("score", F.lit(1)).withColumn("_predicted", F.lit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), base.doc_id


def test_stages_decide(spark, folder):
    path, original = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen, columns = [], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            out = corpus_pipeline.durable(out, "test")
            left = {r.doc_id for r in out.select("doc_id").collect()}
            assert left <= {r.doc_id for r in docs.select("doc_id").collect()}
            if name.endswith("dedup") and original in seen[-1]:
                assert original in left and not {90_001, 90_002} & left
            seen.append(left)
            docs = out
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == seen[-1]
    assert len(seen[0]) < 204 and len(seen[-1]) > 100


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    empty = tmp_path / "none"
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_freed_memory_is_given_back():
    pages = lambda: int(Path("/proc/self/statm").read_text().split()[1])
    held = [bytes(50_000) for _ in range(4000)]
    last, full = held[-1], pages()
    held = None
    give_back()
    assert len(last) == 50_000 and full - pages() > 30_000  # 120 of 200 MB


@pytest.mark.parametrize(("stage", "model"), [("quality", QualityModel), ("toxic", ToxicityModel)])
def test_driver_keeps_no_model(spark, monkeypatch, stage, model):
    """A fitted model is freed before its stage's rows are scored, and its pages are given back."""
    left = []
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda: (give_back(), left.extend([len([x for x in gc.get_objects() if isinstance(x, model)])])))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    getattr(corpus_pipeline, stage)(spark, docs, DATA)
    assert left == [0]
