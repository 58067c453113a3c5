"""Decontamination against a brute-force longest common subsequence, with more items than a latent space holds."""

import numpy as np

from tidelog.llm import decontaminate as D


def unfitted(sample, index, rank):
    """Random directions instead of singular vectors."""
    return np.linalg.qr(np.random.default_rng(1).standard_normal((len(index.terms), rank)))[0]


def test_recall_of_a_thousand_items(spark):
    rng = np.random.default_rng(7)
    say = lambda n, most: [f"w{int(most * x**3)}" for x in rng.random(n)]  # noqa: E731 - some words are far more common
    items = [" ".join(say(int(rng.integers(12, 45)), 9000)) + ". " + " ".join(say(6, 9000)) + "." for _ in range(1000)]
    texts = []
    for k in range(1200):
        words = items[k % 1000].replace(".", "").split()
        for at in rng.choice(len(words), int(0.28 * len(words)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(say(30, 30_000) + words + say(30, 30_000)) if k < 500 else " ".join(say(60, 30_000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    index = D.Index(list(enumerate(items)))
    for d, t in enumerate(texts):
        terms = index.terms_of(D.words_of(t)).tolist()
        for i in range(1000):
            m, a = len(index.words[i]), len(index.answers[i])
            if len(set(terms) & set(index.words[i])) >= D.LCS * len(set(index.words[i])) - 3 and D.lcs(index.masks[i], m, terms) / m >= D.LCS and D.lcs(index.answer_masks[i], a, terms) / a >= D.ANSWER:
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    print("recall", len(want & got), len(want))
    assert len(want) > 300 and got <= want and len(want & got) >= 0.99 * len(want)
    # without the singular vectors the candidate search finds next to nothing
    assert D.leaks(docs, bench, space=unfitted).count() <= 0.05 * len(want)


def test_candidates_are_all_passages_of_cosine():
    rng = np.random.default_rng(3)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 60, 20)) for _ in range(12)]
    index = D.Index(list(enumerate(items)))
    index.weigh(50, {w: 1 + k % 40 for k, w in enumerate(index.terms)})
    index.fit(np.linalg.qr(rng.standard_normal((len(index.terms), 12)))[0])
    docs = [rng.integers(0, len(index.terms) + 1, n).astype(np.int32) for n in (1, 15, 16, 47, 48, 49, 64, 200, 30_000, 5)]
    for least in (0.0, 0.2):
        want = {}
        for d, terms in enumerate(docs):
            blocks = max(3, -(-len(terms) // 16))
            for at in range(0, 16 * (blocks - 2), 16):
                w = terms[at : at + 48]
                v = np.append(index.space, np.zeros((1, 12)), axis=0)[w].sum(0)
                for i, x in enumerate(index.latent @ v / np.sqrt((index.idf[w] ** 2).sum())):
                    want[d, at, i] = x
        got = {(d, at, i): x for d, at, i, x in index.candidates(docs, least)}
        assert all(abs(want[k] - x) < 1e-4 for k, x in got.items())
        assert all(k in got for k, x in want.items() if x > least + 1e-4)
