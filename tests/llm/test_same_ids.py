"""Decontamination of documents that share a doc_id or have none."""

import numpy as np

import corpus_pipeline


def test_clean_texts_of_a_leaking_doc_id_stay(spark, tmp_path):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    item = say(25) + ". " + say(8) + "."
    clean = [say(80) for _ in range(6)]
    rows = [(None, clean[0]), (None, f"{say(30)} {item}"), (7, clean[1]), (7, f"{say(20)} {item}"), (8, clean[2]), (9, None), (None, clean[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.no_benchmark(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(0, clean[0]), (0, clean[3]), (7, clean[1]), (8, clean[2]), (9, "")])
