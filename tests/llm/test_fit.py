"""The latent space of decontamination comes from every passage of every document."""

import numpy as np

from tidelog.llm import decontaminate as D


def made(spark, seed=5):
    """40 documents, one of 6,000 words whose parts use different words, and 30 items."""
    rng = np.random.default_rng(seed)
    say = lambda n, lo, hi: " ".join(f"w{x}" for x in rng.integers(lo, hi, n))
    items = [say(20, 0, 300) + ". " + say(5, 0, 300) + "." for _ in range(30)]
    texts = [say(int(rng.integers(1, 200)), 0, 600) for _ in range(37)] + [None, "", " ".join(say(300, 30 * k, 30 * k + 60) for k in range(20))]
    return texts, items, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def passages(texts, index):
    """Weights (passage x term) of all passages that have a term."""
    out = []
    for t in texts:
        terms = index.terms_of(D.words_of(t))
        for s in range(0, max(1, len(terms) - D.WINDOW + D.STRIDE) if len(terms) else 0, D.STRIDE):
            k, x = index.row(terms[s : s + D.WINDOW])
            if len(k):
                out.append(np.zeros(len(index.terms)))
                out[-1][k] = x
    return np.array(out)


def test_the_space_is_that_of_all_passages(spark):
    texts, items, docs, bench = made(spark)
    seen = []

    def space(table, index, rank):
        seen.append((index, D.singular_space(table, index, rank)))
        return seen[-1][1]

    D.leaks(docs, bench, rank=40, space=space).count()
    (index, got), = seen
    a = passages(texts, index)
    assert len(a) > 300
    b = np.zeros((len(items), a.shape[1]))
    for r, w in zip(b, index.words):
        k, x = index.row(np.array(w))
        r[k] = x
    g = a.T @ a + D.FACTOR * len(a) / len(items) * b.T @ b
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((a.shape[1], 40 + D.SPARE)))[0]
    for _ in range(D.POWER):
        q = np.linalg.qr(g @ q)[0]
    want = (q @ np.linalg.eigh(q.T @ g @ q)[1][:, ::-1])[:, :40]
    assert got.shape == want.shape
    assert abs(got[:, :30] @ got[:, :30].T - want[:, :30] @ want[:, :30].T).max() < 1e-3


def test_stripes_give_the_same_sums(spark, monkeypatch):
    texts, items, docs, bench = made(spark, 6)
    index = D.Index(list(enumerate(items)))
    words = sorted(index.terms)
    vocabulary = {w: k for k, w in enumerate(words)}
    terms = D.termed(docs, vocabulary, ())
    index.number(vocabulary)
    index.weigh(len(texts), D.frequencies(terms, words))
    sums = []
    for cells in (1 << 24, 5000):
        monkeypatch.setattr(D, "CELLS", cells)
        sums.append({r.i: bytes(r.row) for r in D.products(terms, index).collect()})
    assert sums[0] == sums[1] and set(sums[0]) == {-1, *range(len(words))}
    a = passages(texts, index)
    assert np.frombuffer(sums[0][-1], np.float64)[0] == len(a)
    g = a.T @ a
    assert all(abs(np.frombuffer(sums[0][i], np.float64) - g[i, i:]).max() < 1e-6 for i in range(len(words)))


def test_the_pipelines_stage_fits_on_all_passages(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    texts, items, docs, bench = made(spark, 7)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, products = [], D.products

    def counted(terms, index):
        out = products(terms, index)
        seen.append((index, np.frombuffer(out.filter("i = -1").first().row, np.float64)[0]))
        return out

    monkeypatch.setattr(D, "products", counted)
    corpus_pipeline.no_benchmark(spark, docs, str(tmp_path)).count()
    (index, n), = seen
    assert n == len(passages(texts, index)) > 300


def test_the_driver_gets_one_product_in_small_pieces(spark, monkeypatch):
    """Of each multiplication by A^T A the driver collects one matrix, however many tasks multiply, in rows of a few terms."""
    from pyspark.sql.classic.dataframe import DataFrame

    texts, items, docs, bench = made(spark, 8)
    collected, shapes, collect = [], [], DataFrame.collect

    def sizes(self):
        rows = collect(self)
        collected.append([len(r.part) for r in rows if "part" in r])
        return rows

    def space(table, index, rank):
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "collect", sizes)
            out = D.singular_space(table, index, rank)
        shapes.append((len(index.terms), min(rank + D.SPARE, len(index.terms))))
        return out

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # so that several tasks multiply
    try:
        D.leaks(docs, bench, rank=40, space=space).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (n, width), = shapes
    products = [x for x in collected if x]
    assert len(products) == D.POWER + 1
    for x in products:
        assert sum(x) == 4 * n * width and max(x) <= 4 * 16 * width
