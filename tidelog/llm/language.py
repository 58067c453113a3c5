"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its character n-grams and, for frequent words of the training sample, the word
itself; transitions between the languages of neighbouring words are learned. Training sequences are runs of words from
documents of one or more languages, so that switches occur. Forward-backward gives each word the marginal probability of
each language; a document's language has the largest sum, its score is the mean. Long texts are cut into blocks of words
so that numpy steps through many at once; the blocks' transfer matrices carry the chain over the cuts, so that marginals
are those of the whole sequence.

The model is fitted on a bounded sample: `per_lang` documents of each language at most (and about `sample_docs` in all, one
of each language at least), of each at most `sample_chars` characters in a row from a place that a hash chooses. Texts of
any length teach. Prediction reads nothing but the text, all of it.

Nulls and edge cases: a null text, or one without letters, is `und` with score 0; so is any text where no language
could be learned. Documents of null lang teach nothing. Ties go to the first language by name. Repeated rows get equal
results; further columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_broadcast, written

WORDS = re.compile(r"[^\W\d_]+")
BUCKETS, LEXICON, CACHE, CHARS_AT_ONCE = 1 << 15, 2000, 150_000, 1_500_000
NONE = BUCKETS + LEXICON  # the row of weights that stays zero
BLOCK = 512  # words that one block of a long text has


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; other numbers than decimal digits (fractions, Roman numerals) are no letters."""
    words = WORDS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ("".join(c if c.isalpha() else " " for c in w).split())]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, starts): for each character of each ^word$ the hashed 2-, 3- and 4-grams from it, and where words begin.

    Grams with a boundary mark are the affixes. A gram that would leave its word is NONE, a row of zeros.
    """
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters from here to the word's end
    padded = np.r_[codes, np.zeros(3, np.uint64)]
    h = padded[: len(codes)] * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((len(codes), 3), np.int64)
    for n in (2, 3, 4):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + padded[n - 1 : n - 1 + len(codes)] * np.uint64(0x94D049BB133111EB)
        mixed = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[:, n - 2] = np.where(left >= n, (mixed >> np.uint64(49)).astype(np.int64), NONE)
    return out, starts


def sums(weights: np.ndarray, rows: np.ndarray, starts: np.ndarray, lexical: np.ndarray) -> np.ndarray:
    """Each word's score for each label."""
    return np.add.reduceat(weights[rows[:, 0]] + weights[rows[:, 1]] + weights[rows[:, 2]], starts, axis=0) + weights[lexical]


def forward_backward(em: np.ndarray, trans: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """Marginals of every word; em: positive emission factors of all words; the sequences come longest first.

    first and last: what the words before and after a sequence say of its first and last word (nothing, if None).
    """
    n_labels, longest = em.shape[1], int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    alpha, out = np.empty_like(em), np.empty_like(em)
    a = np.ones((len(starts), n_labels)) if first is None else first
    last = np.full((len(starts), n_labels), 1.0 / n_labels) if last is None else last
    for t in range(longest):
        k = active[t]
        at = starts[:k] + t
        a = a * em[at] if t == 0 else (a[:k] @ trans) * em[at]
        a = a / a.sum(1, keepdims=True)
        alpha[at] = a
    b = np.empty((0, n_labels))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        if len(b):
            b = (b * em[starts[: len(b)] + t + 1]) @ trans.T
            b /= b.sum(1, keepdims=True)
        if len(b) < k:
            b = np.concatenate([b, last[len(b) : k]])
        at = starts[:k] + t
        p = alpha[at] * b
        out[at] = p / p.sum(1, keepdims=True)
    return out


def transfers(em: np.ndarray, trans: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """D(em_1) T D(em_2) ... T D(em_m) of each block, up to a factor; blocks come longest first."""
    out = np.eye(em.shape[1]) * em[starts][:, None, :]
    for t in range(1, int(lengths[0])):
        k = int(np.searchsorted(-lengths, -t, side="left"))
        step = (out[:k] @ trans) * em[starts[:k] + t][:, None, :]
        out[:k] = step / step.sum((1, 2), keepdims=True)
    return out / out.sum((1, 2), keepdims=True)


class Crf:
    """labels, lexicon, weights (feature x label) and transition scores (from x to)."""

    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.lexicon, self.weights, self.trans = labels, lexicon, weights, trans
        self.cache: dict[str, int] = {}
        self.known = np.empty((0, len(labels)))

    def __getstate__(self):
        return self.labels, self.lexicon, self.weights.astype(np.float32), self.trans

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if len(cache) + len(new) > CACHE:
            cache.clear()
            self.known = self.known[:0]
            new = list(dict.fromkeys(words))
        if new:
            lexical = np.array([self.lexicon.get(w, NONE - BUCKETS) for w in new]) + BUCKETS
            cache.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.known = np.concatenate([self.known, sums(self.weights, *features(new), lexical).astype(np.float64)])
        e = self.known[list(map(cache.__getitem__, words))]
        return np.exp(np.clip(e - e.max(1, keepdims=True), -30, 0))

    def marginals(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Marginals of each word of each sequence; no sequence is empty."""
        blocks = [(min(BLOCK, len(words) - at), i, at) for i, words in enumerate(sequences) for at in range(0, len(words), BLOCK)]
        blocks.sort(key=lambda x: (-x[0], x[1], x[2]))
        lengths = np.array([b[0] for b in blocks])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        em, trans, n = self.emissions([w for size, i, lo in blocks for w in sequences[i][lo : lo + size]]), np.exp(self.trans), len(self.labels)
        first, last = np.ones((len(blocks), n)), np.full((len(blocks), n), 1.0 / n)
        place = {(i, lo): k for k, (_, i, lo) in enumerate(blocks)}
        cut = np.array([k for k, (_, i, _) in enumerate(blocks) if len(sequences[i]) > BLOCK], np.int64)
        if len(cut):
            moved = dict(zip(cut.tolist(), transfers(em, trans, starts[cut], lengths[cut])))
            for i, words in enumerate(sequences):
                ks = [place[i, lo] for lo in range(0, len(words), BLOCK)]
                for k, nxt in zip(ks, ks[1:]):
                    a = first[k] @ moved[k] @ trans
                    first[nxt] = a / a.sum()
                for k, before in zip(ks[:0:-1], ks[-2::-1]):
                    b = trans @ (moved[k] @ last[k])
                    last[before] = b / b.sum()
        p = forward_backward(em, trans, starts, lengths, first, last)
        parts = [[place[i, lo] for lo in range(0, len(words), BLOCK)] for i, words in enumerate(sequences)]
        return [np.concatenate([p[starts[k] : starts[k] + lengths[k]] for k in ks]) for ks in parts]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return langs, scores
        order, at = sorted(range(len(texts)), key=lambda i: len(texts[i] or "")), 0
        while at < len(order):
            part, chars = [], 0
            while at < len(order) and (not part or chars < CHARS_AT_ONCE):
                if words := words_of(texts[order[at]]):
                    part.append((order[at], words))
                    chars += len(texts[order[at]])
                at += 1
            if part:
                for (i, _), p in zip(part, self.marginals([w for _, w in part])):
                    mean = p.mean(0)
                    k = int(mean.argmax())
                    langs[i], scores[i] = self.labels[k], float(min(1.0, mean[k]))
        return langs, scores


def sequences_of(docs: list[tuple[str, list[str]]], count: int, length: int, rng: np.random.Generator) -> list[tuple[list[str], list[str]]]:
    """Training sequences (words, labels): each splices runs of documents, half of the time of another language."""
    by_lang: dict[str, list[list[str]]] = {}
    for lang, words in docs:
        by_lang.setdefault(lang, []).append(words)
    langs, out = sorted(by_lang), []
    for _ in range(count):
        words: list[str] = []
        labels: list[str] = []
        lang = langs[rng.integers(len(langs))]
        while len(words) < length:
            doc = by_lang[lang][rng.integers(len(by_lang[lang]))]
            n = min(int(rng.geometric(1 / 20)), length - len(words))
            at = int(rng.integers(max(1, len(doc) - n + 1)))
            run = doc[at : at + n]
            words += run
            labels += [lang] * len(run)
            if rng.random() < 0.5:
                lang = langs[rng.integers(len(langs))]
        out.append((words, labels))
    return out


def fit(docs: list[tuple[str, str]], count: int = 3000, length: int = 40, epochs: int = 4, seed: int = 5) -> Crf:
    """A model from (text, lang) pairs, by stochastic gradient steps on the conditional likelihood."""
    pairs = [(lang, words) for text, lang in docs if (words := words_of(text))]
    labels = sorted({lang for lang, _ in pairs})
    counts = Counter(w for _, words in pairs for w in words)
    lexicon = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])}
    n = len(labels)
    crf = Crf(labels, lexicon, np.zeros((NONE + 1, n)), np.zeros((n, n)))
    if not pairs:
        return crf
    rng = np.random.default_rng(seed)
    data = sequences_of(pairs, count, length, rng)
    index = {x: i for i, x in enumerate(labels)}
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in data for w in words))}
    rows, first = features(list(vocabulary))
    ptr = np.r_[first, len(rows)]
    lexical = np.array([lexicon.get(w, NONE - BUCKETS) for w in vocabulary]) + BUCKETS
    ids = np.array([[vocabulary[w] for w in words] for words, _ in data])
    gold = np.array([[index[x] for x in ls] for _, ls in data])
    w_sq, t_sq, size = np.full(crf.weights.shape, 1e-2), np.full((n, n), 1e-1), 100
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // size)):
            seq, y = ids[part], gold[part]
            used, inv = np.unique(seq, return_inverse=True)
            inv = inv.reshape(seq.shape)
            chars = np.concatenate([np.arange(ptr[u], ptr[u + 1]) for u in used])
            reps = ptr[used + 1] - ptr[used]
            e_used = sums(crf.weights, rows[chars], np.r_[0, np.cumsum(reps)[:-1]], lexical[used])
            e = e_used[inv]
            em = np.exp(e - e.max(2, keepdims=True))
            trans = np.exp(crf.trans)
            b, length_, _ = em.shape
            alpha, beta = np.empty_like(em), np.empty_like(em)
            alpha[:, 0] = em[:, 0] / em[:, 0].sum(1, keepdims=True)
            for t in range(1, length_):
                a = (alpha[:, t - 1] @ trans) * em[:, t]
                alpha[:, t] = a / a.sum(1, keepdims=True)
            beta[:, -1] = 1
            for t in range(length_ - 2, -1, -1):
                x = (beta[:, t + 1] * em[:, t + 1]) @ trans.T
                beta[:, t] = x / x.sum(1, keepdims=True)
            post = alpha * beta
            post /= post.sum(2, keepdims=True)
            pair = alpha[:, :-1, :, None] * trans * (em * beta)[:, 1:, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            truth = np.eye(n)[y]
            g_used = np.zeros((len(used), n))
            np.add.at(g_used, inv.ravel(), (post - truth).reshape(-1, n) / b)
            g = np.zeros_like(crf.weights)
            for k in range(3):
                np.add.at(g, rows[chars, k], np.repeat(g_used, reps, axis=0))
            np.add.at(g, lexical[used], g_used)
            g[NONE] = 0
            hit = np.flatnonzero(g.any(1))
            g = g[hit] + 1e-5 * crf.weights[hit]
            w_sq[hit] += g * g
            crf.weights[hit] -= 0.1 * g / np.sqrt(w_sq[hit])
            seen = np.zeros((n, n))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            gt = (pair.sum((0, 1)) - seen) / b
            t_sq += gt * gt
            crf.trans -= 0.1 * gt / np.sqrt(t_sq)
    return crf


def sample(docs: DataFrame, taught: Column, per_lang: int, sample_docs: int, sample_chars: int) -> list[tuple[str, str]]:
    """At most per_lang (piece of text, lang) pairs of each language among the taught rows."""
    rows = docs.filter(taught & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a hash first picks about three times as many of each language, so that few rows move at any size
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang")))
    most = min(per_lang, max(1, sample_docs // max(1, sizes.count())))
    order = F.xxhash64("doc_id", "text")
    few = rows.join(bounded_broadcast(sizes), "lang").filter(F.pmod(order, F.lit(1_000_003)) * F.col("of_lang") < 1_000_003 * 3 * most)
    at = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.char_length("text") - sample_chars + 1)).cast("int") + 1
    few = few.select("lang", order.alias("order"), F.substring("text", at, F.lit(sample_chars)).alias("text"))
    first = W.partitionBy("lang").orderBy("order", "text")
    picked = few.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= most)
    return sorted((r.text, r.lang) for r in picked.select("text", "lang").collect())  # its size is bounded


def identify(docs: DataFrame, model: Crf, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score; columns of these names are replaced."""
    crf = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS, LEXICON and the languages

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = crf.value.predict(list(texts))
        return pd.DataFrame({"lang": langs, "score": scores})

    kept = [c for c in docs.columns if c not in names]
    return docs.withColumn("_told", predict("text")).select(*kept, F.col("_told.lang").alias(names[0]), F.col("_told.score").alias(names[1]))


def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def learn_and_identify(docs: DataFrame, taught: Column, per_lang: int = 300, sample_docs: int = 6000, sample_chars: int = 4000, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    return identify(docs, fit(sample(docs, taught, per_lang, sample_docs, sample_chars)), names)
