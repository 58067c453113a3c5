"""Quality of documents by histogram gradient-boosted trees over statistics of the text.

Features are counts and ratios of bytes, words, lines and repeats of the whole text. Trees are grown level by level on
quantile bins of at most `bins` values; the grown forest is flattened into arrays, which numpy walks for a whole batch at
once. The forest is fitted on `sample_rows` labelled rows at most, chosen by a hash of doc_id; documents
that share a doc_id are one of them.

Nulls and edge cases: a null text counts as empty and gets a score like any other; null labels and labels without a
document teach nothing; with no labels or only one kind, every score is that kind's share (0.5 without any). Repeated
rows get equal scores; further columns are kept, one named score is replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUNCTUATION = b"!?.,;:'\"()[]{}<>/\\|@#$%^&*_-+=~`"
NAMES = [
    "log_bytes", "log_words", "mean_word", "sd_word", "longest_word", "distinct_words", "commonest_word", "adjacent_repeats", "distinct_pairs", "short_words", "upper_words",
    "words_with_symbol", "lines", "distinct_lines", "words_a_line", "short_lines", "sentences", "words_a_sentence", "upper", "lower", "digits", "spaces", "controls", "beyond_ascii",
    *(f"byte_{c:02x}" for c in PUNCTUATION),
]


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    n = max(1, len(raw))
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    stops = int(count[0x2E] + count[0x21] + count[0x3F])
    last = [w[-1] for w in words]
    symbol = sum(1 for c in last if c < 128 and not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c in b".,;:"))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()), len(kinds) / m, max(kinds.values(), default=0) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m, len(set(zip(words, words[1:]))) / m, (sizes <= 3).mean(), sum(map(bytes.isupper, words)) / m,
        symbol / m, np.log1p(len(lines)), len(set(lines)) / k, np.log1p(len(words) / k), sum(len(x) < 40 for x in lines) / k, stops / m, np.log1p(len(words) / (stops + 1)),
        count[65:91].sum() / n, count[97:123].sum() / n, count[48:58].sum() / n, (count[32] + count[9:14].sum()) / n, (count[:9].sum() + count[14:32].sum()) / n, count[128:].sum() / n,
        *(count[c] / n for c in PUNCTUATION),
    ]


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold (left if <=), left child (right is the next), value."""

    def __init__(self, base: float):
        self.base, self.depth = base, 0
        self.roots: list[int] = []
        self.feature = np.empty(0, np.int32)
        self.threshold = np.empty(0)
        self.left = np.empty(0, np.int32)
        self.value = np.empty(0)

    def add(self, feature: list[int], threshold: list[float], left: list[int], value: list[float], depth: int) -> None:
        at = len(self.feature)
        self.roots.append(at)
        self.feature = np.r_[self.feature, np.array(feature, np.int32)]
        self.threshold = np.r_[self.threshold, threshold]
        self.left = np.r_[self.left, np.array([x + at for x in left], np.int32)]
        self.value = np.r_[self.value, value]
        self.depth = max(self.depth, depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        f, out, rows = self.feature, np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                inner = f[at] >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f[at], 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 48, least: int = 10, ridge: float = 1.0) -> Forest:
    """A forest for the labels y (0 or 1) by Newton boosting of the logistic loss on histograms."""
    share = y.mean() if len(y) else 0.5
    if not len(y) or share in (0, 1):
        return Forest(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    forest = Forest(float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    width = max(map(len, cuts)) + 1
    codes = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    n, d = codes.shape
    flat = (codes + np.arange(d) * width).astype(np.int64)
    raw = np.full(n, forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold, left, value = [-1], [0.0], [0], [0.0]
        node, grown = np.zeros(n, np.int64), [0]
        for level in range(depth + 1):
            slot = np.full(len(feature), -1)
            slot[grown] = np.arange(len(grown))
            s = slot[node]
            live = s >= 0
            at = (flat[live] + (s[live] * d * width)[:, None]).ravel()
            shape = (len(grown), d, width)
            gs, hs, cs = (np.bincount(at, None if w is None else np.repeat(w[live], d), minlength=len(grown) * d * width).reshape(shape) for w in (g, h, None))
            tg, th, tc = gs[:, 0].sum(1), hs[:, 0].sum(1), cs[:, 0].sum(1)
            for i, k in enumerate(grown):
                value[k] = float(-rate * tg[i] / (th[i] + ridge))
            if level == depth:
                break
            lg, lh, lc = gs.cumsum(2), hs.cumsum(2), cs.cumsum(2)
            rg, rh, rc = tg[:, None, None] - lg, th[:, None, None] - lh, tc[:, None, None] - lc
            gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (tg**2 / (th + ridge))[:, None, None]
            gain[(lc < least) | (rc < least)] = 0
            best = gain.reshape(len(grown), -1).argmax(1)
            nxt = []
            for i, k in enumerate(grown):
                if gain.reshape(len(grown), -1)[i, best[i]] <= 1e-6:
                    continue
                j, b = divmod(int(best[i]), width)
                feature[k], threshold[k], left[k] = j, float(cuts[j][b]), len(feature)
                here = node == k
                node[here] = len(feature) + (codes[here, j] > b)
                nxt += [len(feature), len(feature) + 1]
                feature += [-1, -1]
                threshold += [0.0, 0.0]
                left += [0, 0]
                value += [0.0, 0.0]
            if not (grown := nxt):
                break
        raw += np.array(value)[node]
        forest.add(feature, threshold, left, value, depth + 1)
    return forest


def sample(docs: DataFrame, labels: DataFrame, taught: Column, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most sample_rows labelled documents. The picked labels are few: they are broadcast."""
    picked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & taught).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    told = rows.select("doc_id", F.xxhash64("text").alias("h"), F.col("quality").cast("double").alias("y"), stats("text").alias("x"))
    # rows that share a doc_id teach once: one text of them, so that no more than sample_rows come here
    one = told.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("x", "h").alias("x"))
    got = one.withColumn("k", F.xxhash64("doc_id")).toPandas().sort_values(["k", "doc_id"], kind="stable")
    if not len(got):
        return np.empty((0, len(NAMES))), np.empty(0)
    return np.stack(got["x"]), (got["y"].to_numpy() > 0).astype(float)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """docs with score."""
    model = docs.sparkSession.sparkContext.broadcast(forest)  # trees * 2^(depth + 1) nodes at most

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))))

    return docs.withColumn("score", predict("text"))


def learn_and_score(docs: DataFrame, labels: DataFrame, taught: Column, sample_rows: int = 20_000) -> DataFrame:
    return score(docs, fit(*sample(docs, labels, taught, sample_rows)))
