"""The pipeline on a small folder: each stage's decision takes effect and the columns stay."""

from collections import Counter

import numpy as np

import corpus_pipeline


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{''.join(rng.choice(list('bdfgklmnprst'), 2))}{rng.choice(list('aeiou'))}x" for _ in range(n))


def test_stages(spark, tmp_path):
    item = prose(999, 25) + ". " + prose(998, 8) + "."
    texts = [prose(k, 120) for k in range(60)] + [prose(0, 120), f"{prose(500, 50)} {item}", "123 456", None, ""]
    near = prose(1, 120).split()
    near[50] = "changed"
    texts.append(" ".join(near))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    known, single, clean, mixed = ids
    assert set(known) == set(range(62)) | {65}
    assert set(single) == set(range(60)) | {61}
    assert set(clean) == set(range(60))
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 2 and abs(sum(mixed.values()) - 90) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    sizes = Counter(r.shard for r in last)
    assert len(last) == sum(mixed.values()) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h long, copies int, component long, shard int, size long, at long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *([k] * 6)) for k, (i, t, s) in enumerate(rows)], COLUMNS)


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    item = prose(999, 25) + ". " + prose(998, 8) + "."
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, prose(1, 80), "a"), (None, prose(2, 80), None), (None, f"{prose(3, 40)} {item}", "a"), (5, prose(4, 80), "b"), (5, prose(5, 80), "b"), (5, f"{prose(6, 40)} {item}", "b"), (6, None, None), (7, "", "a"), (8, prose(1, 80), "a")]
    docs = table(spark, rows)
    key = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    told = stage("language")(spark, docs, str(tmp_path))
    assert told.columns == docs.columns and key(told) == Counter(x for x in rows if x[1])
    single = stage("near_duplicates")(spark, docs, str(tmp_path))
    assert single.columns == docs.columns and key(single) == Counter(x for x in rows if x[0] not in (7, 8))
    clean = stage("decontamination")(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and key(clean) == Counter(x for x in rows if not (x[1] or "").endswith(item))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_every_row_has_its_own_copies(spark, tmp_path):
    from tidelog.llm import mixing

    rows = [(k % 3 if k % 2 else None, prose(k % 7, 20 + k % 5), "ab"[k % 2]) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sum(r.copies for r in mixing.mix(docs).collect())
    out = stage("mixing")(spark, docs, str(tmp_path))
    assert out.count() == want and out.columns == docs.columns
