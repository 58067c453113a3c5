"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words; their document frequencies are counted over all documents. TF-IDF vectors of passages
(windows of three blocks of `STRIDE` words, a window at every block) are projected on the right singular vectors of a
passage matrix, found by a distributed randomised SVD with power steps. Every passage of every document is compared with
every item by cosine in that space; words outside the vocabulary count towards a passage's length, each at most as the
vocabulary's mean word, so that cosines do not fall as the corpus grows. What reaches `cosine` is a candidate, nothing else
is looked at. Candidates are verified on the words around the passage: a longest common subsequence of at least `lcs` of
the item's words, and of `answer` of its last sentence.

The SVD is fitted on the items and on all passages of all documents: one pass sums the products of the weights of each
two terms over all passages, and the iterations multiply by that matrix, whose size depends on the benchmark alone. Its
rank is `rank`, or a block's items if they are more. The benchmark is the query set: it is read in blocks of `items`
rows, `AT_ONCE` blocks in one search, so what tasks and the driver hold has a fixed bound, but for the benchmark's
vocabulary. Texts are read once, as numbers of terms; those are read once to count frequencies, once a block to fit (more
often if the sums of a block exceed `CELLS`) and once a search.

Nulls and edge cases: null and empty texts, and items of no words, match nothing; repeated items are reported each;
documents of one doc_id are reported once; a null doc_id is reported as null; empty tables give an empty result; equal
cosines are all candidates; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, written

STRIDE, BLOCKS, RANK, SPARE, POWER, COSINE, LCS, ANSWER = 16, 3, 192, 12, 2, 0.20, 0.7, 0.5
ITEMS, AT_ONCE, FACTOR, SLAB, WORDS_AT_ONCE, ROWS_AT_ONCE, PASSAGES_AT_ONCE, CELLS, UNIT = 256, 4, 4.0, 512, 1 << 16, 100, 1 << 12, 1 << 24, 1 << 30
TERMS_AT_ONCE, PIECE = 16, 1 << 18
WINDOW = STRIDE * BLOCKS
# White space and ASCII punctuation part words; bytes beyond ASCII stay.
PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(PARTS).split()


def last_sentence(text: str) -> list[bytes]:
    """The words after the last sentence end but one; the last third of the words where there is one sentence only."""
    parts = [w for s in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if (w := words_of(s))]
    words = words_of(text)
    return parts[-1] if len(parts) > 1 else words[-max(1, len(words) // 3) :]


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(masks: dict[int, int], length: int, other: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of the first sequence."""
    full = (1 << length) - 1
    v = full
    for w in other:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


class Index:
    """Vocabulary, weights and items of one block of the benchmark and, once fitted, its latent space."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, t in items if words_of(t)]
        texts = [t for _, t in items if words_of(t)]
        self.terms = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in words_of(t)))}
        self.words = [[self.terms[w] for w in words_of(t)] for t in texts]
        self.answers = [[self.terms[w] for w in last_sentence(t)] for t in texts]
        self.masks = [masks_of(w) for w in self.words]
        self.answer_masks = [masks_of(w) for w in self.answers]
        self.idf = np.ones(len(self.terms) + 1)  # the last is that of any word outside the vocabulary
        self.space = self.latent = self.lookup = None

    def number(self, vocabulary: dict[bytes, int]) -> None:
        """lookup: the term of each word of the whole benchmark's vocabulary; the last is that of any other word."""
        self.lookup = np.full(len(vocabulary) + 1, len(self.terms), np.int32)
        self.lookup[[vocabulary[w] for w in self.terms]] = np.arange(len(self.terms))

    def weigh(self, docs: int, frequency: dict[bytes, int]) -> None:
        df = np.array([frequency.get(w, 0) for w in self.terms] + [0])
        self.idf = np.log((1 + docs) / (1 + df)) + 0.05
        self.idf[-1] = min(self.idf[-1], self.idf[:-1].mean())

    def terms_of(self, words: list[bytes]) -> np.ndarray:
        get, none = self.terms.get, len(self.terms)
        return np.fromiter(map(get, words, repeat(none)), np.int32, len(words))

    def row(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A passage's terms and weights, of unit length with the words outside the vocabulary."""
        k, n = np.unique(terms, return_counts=True)
        x = n * self.idf[k]
        x /= np.linalg.norm(x)
        inside = k < len(self.terms)
        return k[inside], x[inside]

    def fit(self, space: np.ndarray) -> None:
        # the last row is that of any word outside the vocabulary, and of none
        self.space = np.append(space * self.idf[:-1, None], np.zeros((1, space.shape[1])), axis=0).astype(np.float32)
        self.latent = np.stack([x @ space[k] for k, x in map(self.row, map(np.array, self.words))]).astype(np.float32)

    def candidates(self, docs: list[np.ndarray], cosine: float) -> Iterator[tuple[int, int, int, float]]:
        """(document, first word, item, cosine) of each passage and item that near each other; docs: terms, none empty."""
        flat, first, whole = laid(docs)  # -1 has no weight
        weight = np.append(self.idf**2, 0.0)[flat].reshape(-1, STRIDE).sum(1)
        doc_of = np.repeat(np.arange(len(docs)), np.diff(first))
        for lo in range(0, int(first[-1]), SLAB):
            hi = min(lo + SLAB, int(first[-1]))
            words = flat[lo * STRIDE : (hi + BLOCKS - 1) * STRIDE].reshape(-1, STRIDE)
            sums = self.space[words[:, 0]]
            for k in range(1, STRIDE):
                sums += self.space[words[:, k]]
            v, w = sums[: hi - lo].copy(), weight[lo:hi].copy()
            for k in range(1, BLOCKS):
                v += sums[k : hi - lo + k]
                w += weight[lo + k : hi + k]
            at = np.flatnonzero(whole[lo:hi] & (w > 0))
            sims = (v[at] / np.sqrt(w[at]).astype(np.float32)[:, None]) @ self.latent.T
            for p, i in zip(*(x.tolist() for x in np.nonzero(sims >= cosine))):
                block = int(at[p]) + lo
                d = int(doc_of[block])
                yield d, (block - int(first[d])) * STRIDE, i, float(sims[p, i])

    def matches(self, docs: list[np.ndarray], cosine: float, least: float, answer: float) -> list[tuple[int, int, float, float, float]]:
        """(document, item, cosine, share of the item's words in order, of its answer's) of each item found."""
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for d, start, i, near_by in self.candidates(docs, cosine):
            m, best = len(self.words[i]), found.get((d, i))
            if best and best[1] == 1.0:
                continue
            near = docs[d][max(0, start - m) : start + WINDOW + m].tolist()
            share = lcs(self.masks[i], m, near) / m
            if share < least or (best and share <= best[1]):
                continue
            a = len(self.answers[i])
            if (said := lcs(self.answer_masks[i], a, near) / a) >= answer:
                found[d, i] = (near_by, share, said)
        return [(d, self.ids[i], *x) for (d, i), x in found.items()]


def termed(docs: DataFrame, vocabulary: dict[bytes, int], keep: tuple[str, ...]) -> DataFrame:
    """doc_id, columns of keep and terms of every document, written: the numbers of its words in the vocabulary, as int32."""
    names = ["doc_id", *keep, "terms"]
    model = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, none = model.value.get, len(model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(lo, ROWS_AT_ONCE)
                lists = (words_of(t.as_py()) for t in part.column("text"))
                terms = [np.fromiter(map(get, w, repeat(none)), np.int32, len(w)).tobytes() for w in lists]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), pa.array(terms, pa.binary())], names)

    schema = ", ".join(f"{n} {'binary' if n == 'terms' else 'long'}" for n in names)
    out = written(docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *keep).mapInArrow(number, schema))
    model.destroy()
    return out


def terms_at(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), np.int32)


def frequencies(terms: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the benchmark is."""
    size = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                n[np.unique(terms_at(batch.column(0), k))] += 1
        there = np.flatnonzero(n[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(n[there], pa.int64())], ["word", "n"])

    counts = terms.select("terms").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {words[r.word]: r.n for r in counts.collect()}  # one row a word of the benchmark


def laid(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, block at which each document begins, whether a window begins at each block): documents begin at blocks; -1 is no word."""
    blocks = np.array([max(BLOCKS, -(-len(d) // STRIDE)) for d in docs])
    first = np.r_[0, np.cumsum(blocks)]
    flat = np.full((int(first[-1]) + BLOCKS) * STRIDE, -1, np.int32)
    for d, at in zip(docs, first):
        flat[at * STRIDE : at * STRIDE + len(d)] = d
    ends = np.repeat(first[1:], blocks)
    return flat, first, ends - np.arange(int(first[-1])) >= BLOCKS  # windows that begin here end in their document


def passages_of(docs: list[np.ndarray], index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(passage, term, weight) of the terms in the vocabulary of all passages, by passage and term: Index.row of many at once."""
    flat, _, whole = laid(docs)
    for lo in range(0, len(whole), PASSAGES_AT_ONCE):
        at = lo + np.flatnonzero(whole[lo : lo + PASSAGES_AT_ONCE])
        words = flat.reshape(-1, STRIDE)[at[:, None] + np.arange(BLOCKS)].reshape(-1, WINDOW)
        words.sort(axis=1)
        new = np.ones(words.shape, bool)
        new[:, 1:] = words[:, 1:] != words[:, :-1]
        starts = np.flatnonzero(new)
        count, term, of = np.diff(np.r_[starts, words.size]), words.ravel()[starts], starts // WINDOW
        x = np.where(term >= 0, count * index.idf[term], 0.0)
        length = np.sqrt(np.bincount(of, x * x))
        inside = np.flatnonzero((term >= 0) & (term < len(index.terms)))
        yield of[inside], term[inside], x[inside] / length[of[inside]]


def pairs_of(of: np.ndarray, term: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(term, term, product of their weights) of each two terms of a passage, each with itself too, the lesser term first."""
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size, term = np.diff(np.r_[starts, len(of)]), term.astype(np.int64)
    order, cuts = np.argsort(size, kind="stable"), np.r_[0, np.cumsum(np.bincount(size))]
    for k in np.unique(size).tolist():  # passages of equally many terms side by side
        at = starts[order[cuts[k] : cuts[k + 1]]] + np.arange(k)[:, None]
        a, b = np.triu_indices(k)
        t, y = term[at], x[at]
        yield t[a].ravel(), t[b].ravel(), (y[a] * y[b]).ravel()


def products(terms: DataFrame, index: Index) -> DataFrame:
    """The upper triangle of A^T A, A being the weights (passage x term) of all passages of all documents, written.

    i and row: row i from column i on, as float64; row -1 has the number of passages with a term. Products are summed as
    multiples of 1 / UNIT, so that the sums are the same in whatever order. A task holds CELLS sums at most: beyond,
    the rows of the triangle come in stripes, a pass over the terms for each.
    """
    spark, n = terms.sparkSession, len(index.terms)
    base = np.arange(n) * n - np.arange(n) * (np.arange(n) + 1) // 2  # cell of row i and column j: base[i] + j
    starts = base + np.arange(n)
    model = spark.sparkContext.broadcast(index)

    def summed(lo: int, hi: int):
        first, cells = int(starts[lo]), int(starts[hi - 1]) + n - hi + 1 - int(starts[lo])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix, sums, passages = model.value, np.zeros(cells, np.int64), 0
            for batch in batches:
                for docs, _ in together(batch):
                    for of, term, x in passages_of([ix.lookup[d] for d in docs], ix):
                        if not len(of):
                            continue
                        passages += 1 + int(np.count_nonzero(of[1:] != of[:-1]))
                        for i, j, v in pairs_of(of, term, x):
                            cell = base[i] + j
                            if hi - lo < n:
                                cell, v = cell[kept := (i >= lo) & (i < hi)], v[kept]
                            np.add.at(sums, cell - first if first else cell, np.rint(v * UNIT).astype(np.int64))
            for at in range(lo, hi, 64):
                rows = range(at, min(at + 64, hi))
                # bytes of one place lie together: most of the high ones are zero and cost nothing in the shuffle
                out = [sums[starts[i] - first : starts[i] - first + n - i].view(np.uint8).reshape(-1, 8).T.tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(out, pa.binary())], ["i", "row"])
            if lo == 0:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array([passages], np.int64).tobytes()], pa.binary())], ["i", "row"])

        return run

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def row() -> pa.RecordBatch:
            values = total / (1 if at == -1 else UNIT)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["i", "row"])

        for batch in batches:
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = np.ascontiguousarray(np.frombuffer(cell.as_buffer(), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
                if i == at:
                    total += v
                    continue
                if at is not None:
                    yield row()
                at, total = i, v.copy()
        if at is not None:
            yield row()

    tasks = terms.select("terms").coalesce(max(4, spark.sparkContext.defaultParallelism))  # each sends a triangle: not more of them for more input
    parts, lo = [], 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CELLS, "right")) - 1)
        hi = n if int(starts[n - 1]) + 1 - int(starts[lo]) <= CELLS else hi
        parts.append(tasks.mapInArrow(summed(lo, hi), "i int, row binary"))
        lo = hi
    out = written(reduce(DataFrame.union, parts).repartition("i").sortWithinPartitions("i").mapInArrow(added, "i int, row binary"))
    model.destroy()
    return out


def singular_space(terms: DataFrame, index: Index, rank: int) -> np.ndarray:
    """Right singular vectors (term x rank) of all passages and the items, by randomised subspace iteration."""
    spark, n_terms = terms.sparkSession, len(index.terms)
    triangle = products(terms, index)
    passages = np.frombuffer(triangle.filter("i = -1").first().row, np.float64)[0]
    items = [index.row(np.array(w)) for w in index.words]
    weight = FACTOR * max(1.0, passages) / len(items)
    width = min(rank + SPARE, n_terms)

    def gram(m: np.ndarray) -> np.ndarray:
        """A^T A m: the documents' part is multiplied in tasks, at most four, and summed in tasks; the items weigh FACTOR times their number.

        The driver gets one matrix, not one a task, and in pieces of PIECE bytes at most: of larger ones the JVM holds many
        copies at once, for which its heap grows and stays large.
        """
        sent = spark.sparkContext.broadcast(m.astype(np.float32))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value.astype(np.float64)
            out = np.zeros_like(m)
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    part = batch.slice(lo, 64)
                    i = part.column(0).to_numpy()
                    upper = np.zeros((len(i), len(m)))
                    for k in range(len(i)):
                        upper[k, i[k] :] = np.frombuffer(part.column(1)[k].as_buffer(), np.float64)
                    out[i] += upper @ m
                    upper[np.arange(len(i)), i] = 0.0
                    out += upper.T @ m[i]
            at, of = range(0, len(out), TERMS_AT_ONCE), TaskContext.get().partitionId()
            parts = [out[k : k + TERMS_AT_ONCE].astype(np.float32).tobytes() for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([of] * len(at), pa.int32()), pa.array(parts, pa.binary())], ["at", "of", "part"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:  # sorted, so that sums are the same in each run
                for at, part in zip(batch.column(0).to_pylist(), batch.column(2)):
                    total[at] = total.get(at, 0.0) + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
            parts = [v.astype(np.float32).tobytes() for v in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], ["at", "part"])

        out = np.zeros_like(m)
        parts = triangle.filter("i >= 0").coalesce(4).mapInArrow(product, "at int, of int, part binary")
        parts = parts.repartition(max(8, -(-2 * 4 * m.size // PIECE)), "at").sortWithinPartitions("at", "of")
        for r in parts.mapInArrow(added, "at int, part binary").collect():  # a matrix of a block's terms
            out[r.at : r.at + TERMS_AT_ONCE] = np.frombuffer(r.part, np.float32).reshape(-1, m.shape[1])
        for k, x in items:
            out[k] += weight * np.outer(x, x @ m[k])
        sent.destroy()
        return out

    q = np.linalg.qr(np.random.default_rng(3).standard_normal((n_terms, width)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(gram(q))[0]
    values, vectors = np.linalg.eigh(q.T @ gram(q))
    discard(triangle)
    return (q @ vectors[:, ::-1])[:, :rank]


def together(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """(terms, row) of the documents of a batch that have words, so many at once that they have about WORDS_AT_ONCE."""
    column, docs, of, n = batch.column("terms"), [], [], 0
    for at in range(batch.num_rows):
        if len(terms := terms_at(column, at)):
            docs.append(terms)
            of.append(at)
            n += len(terms)
        if n >= WORDS_AT_ONCE:
            yield docs, of
            docs, of, n = [], [], 0
    if docs:
        yield docs, of


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, least: float = LCS, answer: float = ANSWER, rank: int = RANK, items: int = ITEMS, keep: tuple[str, ...] = (), space=singular_space) -> DataFrame:
    """doc_id, columns of keep (of type long), item_id, cosine, lcs, answer of every pair found."""
    spark = docs.sparkSession
    names = ["doc_id", *keep, "item_id", "cosine", "lcs", "answer"]
    schema = ", ".join(f"{n} {'double' if n in names[-3:] else 'long'}" for n in names)
    numbered = benchmark.filter("text is not null").select("item_id", "text")
    blocks = max(1, -(-numbered.count() // items))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    words = sorted({w for r in numbered.select("text").toLocalIterator() for w in words_of(r.text)})
    if not words:
        return spark.createDataFrame([], schema)
    vocabulary = {w: k for k, w in enumerate(words)}
    terms = termed(docs, vocabulary, keep)
    docs_n, frequency = terms.count(), frequencies(terms, words)
    found = []
    for lo in range(0, blocks, AT_ONCE):
        indexes = []
        for b in range(lo, min(lo + AT_ONCE, blocks)):
            index = Index([(r.item_id, r.text) for r in numbered.filter(block == b).orderBy("item_id", "text").collect()])
            if index.ids:
                index.number(vocabulary)
                index.weigh(docs_n, frequency)
                index.fit(space(terms, index, max(rank, len(index.ids))))
                indexes.append(index)
        if not indexes:
            continue
        model = spark.sparkContext.broadcast(indexes)

        def search(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64()] * (2 + len(keep)) + [pa.float64()] * 3
            for batch in batches:
                ids, out = batch.select(names[: 1 + len(keep)]).to_pylist(), []
                for docs_, of in together(batch):
                    for index in model.value:
                        out += [(*ids[of[d]].values(), *x) for d, *x in index.matches([index.lookup[d] for d in docs_], cosine, least, answer)]
                cols = list(zip(*out)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        found.append(terms.mapInArrow(search, schema))
    out = reduce(DataFrame.union, found)
    return out.groupBy("doc_id", *keep, "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))
