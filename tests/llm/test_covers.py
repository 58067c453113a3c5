"""Many covers of one place: texts whose windows leave out most starts, and groups that adaptive execution might split."""

from collections import Counter
from hashlib import sha256

import numpy as np

from pyspark.sql import functions as F

from tidelog.llm import substrings as S


def letters(rng, n: int) -> str:
    return "".join(map(chr, rng.integers(97, 123, n)))


def removal(texts: list[str], length: int = S.LENGTH) -> Counter:
    """n_bytes, n_removed, n_spans, hash of what is left: by a count of all windows."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        left = "".join(c for c, g in zip(t, gone[1:]) if not g)
        out[len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), sha256(left.encode()).hexdigest()] += 1
    return out


def found(spark, texts: list[str], **more) -> Counter:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    return Counter(map(tuple, S.remove(docs, **more).select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()))


def test_starts_at_which_no_cover_has_a_window():
    n, reach = 4000, S.LENGTH - S.DIGIT
    rng = np.random.default_rng(4)
    m = np.zeros((n, 2 * reach + S.DIGIT), np.uint8)
    m[:, reach:] = rng.integers(97, 123, (n, S.LENGTH))  # all texts begin at the place
    m[n // 2 : n // 2 + 5] = m[:5]
    lo, hi = S.repeated_windows(m, np.full(n, reach), np.full(n, reach), S.LENGTH, 0, reach)
    twins = [*range(5), *range(n // 2, n // 2 + 5)]
    assert np.flatnonzero(hi >= lo).tolist() == twins and set(lo[twins]) == set(hi[twins]) == {reach}


def test_thousands_of_texts_that_begin_alike(spark):
    rng = np.random.default_rng(5)
    lines = [letters(rng, 60) for _ in range(4000)]
    least = [S.hashes(np.frombuffer(x.encode(), np.uint8), S.DIGIT).min() for x in lines]
    line = lines[int(np.argmin(least))]  # nearly every text names its place in this line
    texts = [line + letters(rng, 150) for _ in range(4000)]
    texts += [texts[7], texts[8][:205] + "-" * 5, letters(rng, 30) + texts[9]]
    assert found(spark, texts) == removal(texts)


def test_groups_stay_whole_where_hot_ones_are_broadcast(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    rng = np.random.default_rng(6)
    common = [letters(rng, 400) for _ in range(4)]
    rare = [letters(rng, 400) for _ in range(60)]
    texts = [letters(rng, 200) + c + letters(rng, 200) for c in common for _ in range(40)] + [letters(rng, 200) + c + letters(rng, 200) for c in rare for _ in range(2)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert found(spark, texts, block=20) == removal(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
