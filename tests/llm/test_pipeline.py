"""Stages of the pipeline against what their operators say of each row."""

from pyspark.sql import functions as F

import corpus_pipeline
from normweave.llm import bpe, secrets, simhash
from tests.llm.test_operators import labelled


def test_stages(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    texts = [(r.doc_id, r.text, "en", f"s{r.doc_id % 3}" if r.doc_id % 7 else None, len(r.text)) for r in docs.collect()]
    texts += [(1000, texts[0][1], "en", "s1", len(texts[0][1])), (1001, texts[2][1] + " password=hunter2x9", "en", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(texts, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "secret_scan", "mix_sources", "byte_bpe"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "byte_bpe" or now.columns == columns
    good = {r.doc_id: r for r in seen["quality_classifier"].collect()}
    assert all(i % 4 != 1 for i in good if i < 1000) and len(good) > 200
    unique = {r.doc_id for r in seen["simhash_near_dedup"].collect()}
    assert unique == {r.first for r in simhash.similar(seen["quality_classifier"]).groupBy("root").agg(F.min("doc_id").alias("first")).collect()} and 1000 not in unique
    safe = {r.doc_id: r.text for r in seen["secret_scan"].collect()}
    assert set(safe) == unique and not any(secrets.scan(seen["secret_scan"], ["spans"]).where("size(spans) > 0").collect())
    assert {r.doc_id for r in seen["mix_sources"].collect()} == unique
    codec = bpe.TextCodec(bpe.read_ranks(open(bpe.vocabulary()[0], "rb").read()), bpe.vocabulary()[1])
    assert {r.doc_id: list(r.ids) for r in seen["byte_bpe"].collect()} == {i: codec.encode(t) for i, t in safe.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(unique)
