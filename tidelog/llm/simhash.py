"""SimHash near-duplicates: fingerprints of word shingles, linked by a BK-tree search.

Fingerprints within `radius` bits agree on at least two of radius + 2 blocks of their bits, so every pair of blocks is a
shard key and linked fingerprints share a shard. Each shard's distinct fingerprints form a BK-tree (children keyed by
their Hamming distance to the parent); a search follows only edges within the radius. Shards of over `block` fingerprints are
cut into blocks; each pair of blocks is a tree of its own, in which its fingerprints look for each other. Trees are built
where the rows of a pair are shuffled to, not broadcast by the driver, because all trees together hold all fingerprints.

Nulls and edge cases: a null or empty text, or one of white space only, has fingerprint zero and links like any other;
repeated rows share a fingerprint and so a component; a null doc_id never becomes a component_id unless its component
has no other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Forest, components, groups, in_blocks, spread_join, written

SEED = 42
BLOCK = 4096


def shingle_hashes(text: str | None, size: int) -> list[int]:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [h(joined, SEED)]
    lengths = [len(w) + 1 for w in words]
    starts = [0, *accumulate(lengths)]
    return [h(joined[s : e - 1], SEED) for s, e in zip(starts, starts[size:])]


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is 1 if more than half of the shingle hashes set it; the value as a signed 64-bit integer."""
    hashes = np.array(shingle_hashes(text, size), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text") -> DataFrame:
    """docs with a column fp."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return docs.withColumn("fp", fp(F.col(text)))


class BKTree:
    """Distinct fingerprints; each child's key is its Hamming distance to the parent."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while (nxt := self.children[at].get(d := (v ^ values[at]).bit_count())) is not None:
                at = nxt
            self.children[at][d] = i

    def search(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            for key, child in self.children[at].items():
                if d - radius <= key <= d + radius:
                    stack.append(child)
        return found

    def search_all(self, ask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index in ask, node) pairs within the radius of the nodes ask; all go down the tree level by level."""
        if not hasattr(self, "flat"):
            width = max(1, (max(self.values).bit_length() + 63) // 64)
            v = np.frombuffer(b"".join(x.to_bytes(8 * width, "little") for x in self.values), "<u8").reshape(-1, width)
            n = np.array([len(c) for c in self.children])
            key = np.array([k for c in self.children for k in c], np.int64)
            child = np.array([x for c in self.children for x in c.values()], np.int64)
            self.flat = v, n, np.concatenate([[0], np.cumsum(n)]), key, child
        v, n, start, key, child = self.flat
        qi, node = np.arange(len(ask)), np.zeros(len(ask), np.int64)
        out_q, out_n = [], []
        while len(qi):
            d = np.bitwise_count(v[ask[qi]] ^ v[node]).sum(1, dtype=np.int64)
            hit = d <= radius
            out_q.append(qi[hit])
            out_n.append(node[hit])
            reps = n[node]
            ends = np.cumsum(reps)
            at = np.repeat(start[node] - ends + reps, reps) + np.arange(ends[-1])
            qi, d = np.repeat(qi, reps), np.repeat(d, reps)
            keep = np.abs(key[at] - d) <= radius
            qi, node = qi[keep], child[at[keep]]
        return np.concatenate(out_q), np.concatenate(out_n)


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each the least index of its component) with the links a-b joined."""
    while (labels[a] != labels[b]).any():
        x, y = labels[a], labels[b]
        np.minimum.at(labels, x, y)
        np.minimum.at(labels, y, x)
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def links_of(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (index, least index of its component) of the links between distinct values."""
    tree = BKTree(values)
    if len(values) <= 48:
        forest = Forest(len(values))
        for i, v in enumerate(values):
            forest.join((i, n) for n in tree.search(v, radius))
        return forest.links()
    labels, root = np.arange(len(values)), None
    for lo in range(0, len(values), 256):
        ask = np.arange(lo, min(lo + 256, len(values)))
        if root is not None:
            # what is in one component with `root` needs no search: the others find their links to it
            ask = ask[labels[ask] != labels[root]]
        if len(ask):
            q, n = tree.search_all(ask, radius)
            labels = merged(labels, ask[q], n)
        if root is None:
            root = int(np.bincount(labels).argmax())
        if (labels == labels[root]).all():
            break
    return [(int(i), int(labels[i])) for i in np.flatnonzero(labels != np.arange(len(labels)))]


def shard_keys(radius: int) -> list[int]:
    """Masks of the pairs of radius + 2 blocks of 64 bits."""
    n = radius + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def searched(dealt: DataFrame, keys: list[str], lanes: list[str], node: str, radius: int) -> DataFrame:
    """Edges (u, v) between the nodes of each group of dealt rows: a spanning forest of its links."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for g in groups(batches, keys):
            nodes = g.column(node).to_numpy()
            parts = [g.column(c).to_numpy().view(np.uint64).tolist() for c in lanes]
            values = [sum(x << 64 * k for k, x in enumerate(xs)) for xs in zip(*parts)] if len(parts) > 1 else parts[0]
            out += [(int(nodes[a]), int(nodes[b])) for a, b in links_of(values, radius)]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "u long, v long")


def link(values: DataFrame, total: int, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints fp of values, which has total rows."""
    shards = shard_keys(radius)
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(shards)])
    rows = values.select("fp", F.explode(masks).alias("k")).select("fp", "k.t", "k.part")
    return searched(in_blocks(rows, ["t", "part"], "fp", block, total * len(shards)), ["t", "part", "i", "j"], ["fp"], "fp", radius)


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, fp (signed), fingerprint (hex), component_id of every row of docs."""
    fps = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size).select("doc_id", "fp"))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")))
    total = nodes.count()
    comp = components(link(nodes.select("fp"), total, radius, block))
    named = nodes.join(comp, nodes.fp == comp.id, "left").select("fp", "first_id", "rows", F.coalesce("component", "fp").alias("c"))
    named = written(named)
    least = named.groupBy("c").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_fp = spread_join(named, least, ["c"], "n", total).select("fp", "component_id", "rows")
    out = spread_join(fps, by_fp, ["fp"], "rows", fps.count())
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similarity of 0.8 needs more bits than 64: shingles sharing 0.8 differ in about 0.15 of the bits, unlike texts in half.
LANES, TABLES, MINIMA, WITHIN, SIMILAR_BLOCK = 8, 10, 3, 94, 16_384


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each hash."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * salt % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def long_fingerprint(hashes: np.ndarray, lanes: int = LANES) -> list[int]:
    """As fingerprint(), of 64 * lanes bits: each lane has its own mix of the shingle hashes."""
    out = []
    for k in range(lanes):
        h = mixed(hashes, k) if k else hashes
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            part = h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
    return out


def shards_of(hashes: np.ndarray, tables: int = TABLES, minima: int = MINIMA) -> list[int]:
    """A key a table: the least of `minima` mixes of the shingle hashes, together."""
    if not len(hashes):
        return []
    low = [int(mixed(hashes, 1000 + k).min()) for k in range(tables * minima)]
    return [xxhash.xxh3_64_intdigest(np.array(low[t * minima : (t + 1) * minima], np.uint64).tobytes(), t) - (1 << 63) for t in range(tables)]


def similar_documents(docs: DataFrame, size: int = 5, lanes: int = LANES, tables: int = TABLES, minima: int = MINIMA, within: int = WITHIN, block: int = SIMILAR_BLOCK) -> DataFrame:
    """doc_id, h (xxhash64 of the text), component of every row; links join texts whose word shingles share about 0.8.

    Fingerprints of 64 * lanes bits link at `within` differing bits or fewer. A shard is what agrees on `minima` least
    hashes of its shingles; there are `tables` draws. Texts that share 0.8 of their shingles meet in a shard with
    probability 0.999, unlike texts hardly ever, so the shards grow with the copies only. The search of a shard's
    BK-tree is exact.
    """
    names = [f"f{k}" for k in range(lanes)]

    @F.pandas_udf("f array<long>, keys array<long>")
    def fp(texts: pd.Series) -> pd.DataFrame:
        hashes = [np.array(shingle_hashes(t, size), dtype=np.uint64) for t in texts]
        return pd.DataFrame({"f": [long_fingerprint(h, lanes) for h in hashes], "keys": [shards_of(h, tables, minima) for h in hashes]})

    fps = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), fp("text").alias("p"))
    fps = written(fps.select("doc_id", "h", F.xxhash64("p.f").alias("node"), *[F.element_at("p.f", k + 1).alias(n) for k, n in enumerate(names)], "p.keys"))
    nodes = written(fps.groupBy("node").agg(*[F.first(n).alias(n) for n in names], F.count(F.lit(1)).alias("rows")))
    total = nodes.count()
    rows = fps.select("node", F.explode("keys").alias("key")).distinct()
    dealt = in_blocks(rows, ["key"], "node", block, total * tables).join(nodes.drop("rows"), "node")
    comp = components(searched(dealt, ["key", "i", "j"], names, "node", within))
    named = nodes.join(comp, nodes.node == comp.id, "left").select("node", "rows", F.coalesce("component", "node").alias("component"))
    return spread_join(fps.select("doc_id", "h", "node"), written(named), ["node"], "rows", fps.count()).select("doc_id", "h", "component")
