"""Near-duplicates of embeddings by Euclidean p-stable hashing with exact cosine checks.

A normalised vector v falls, in each of `tables` tables, into the bucket of its `width`-quantised projections
floor((a.v + b) / w) on `functions` random Gaussian directions. Vectors of one bucket and label are compared by cosine
in double precision. Equal vectors are one node with a multiplicity; buckets over `block` nodes are met block by block;
tasks give counts and a spanning forest, never pairs.

At cosine 0.98 the distance is 0.2, one projection agrees with probability 0.90 and a pair meets in some table with
probability 0.994; nearer pairs meet more surely.

Nulls and edge cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, and
so does one whose label or vec_id is null; such a row is its own component (null vec_id: component null, kept false).
Repeated rows are vectors of their own and link. Vectors of other lengths never link. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Forest, components, groups, in_blocks, spread_join, written

TABLES, FUNCTIONS, WIDTH, BLOCK, SEED = 12, 10, 1.6, 2048, 20240607


def projections(dim: int, tables: int, functions: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * functions)), rng.uniform(0, width, tables * functions)


def signatures(nodes: DataFrame, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH) -> DataFrame:
    """node, sig (array of one long for each table) of nodes (node, label, embedding)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            emb, labels = batch.column("embedding"), batch.column("label").to_pylist()
            lengths = np.diff(emb.offsets.to_numpy())
            flat, starts = emb.values.to_numpy(zero_copy_only=False).astype(np.float64), emb.offsets.to_numpy()[:-1]
            sigs: list[list[int] | None] = [None] * batch.num_rows
            for dim in np.unique(lengths):
                dim = int(dim)
                a, b = cache.setdefault(dim, projections(dim, tables, functions, width))
                at = np.flatnonzero(lengths == dim)
                v = flat[starts[at][:, None] + np.arange(dim)]
                v /= np.abs(v).max(1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                q = np.floor((v @ a + b) / width).astype(np.int16).reshape(len(at), tables, functions)
                for r, i in enumerate(at):
                    tag = f"{dim},{labels[i]}".encode()
                    sigs[i] = [xxhash.xxh3_64_intdigest(tag + q[r, t].tobytes(), t) - (1 << 63) for t in range(tables)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sigs, pa.list_(pa.int64()))], ["node", "sig"])

    return nodes.select("node", "label", "embedding").mapInArrow(sign, "node long, sig array<long>")


def near_vectors(rows: DataFrame, threshold: float = 0.98, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    # floats stay floats on their way, and are doubles where they are multiplied
    kind = rows.schema["embedding"].dataType.simpleString()
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    big = F.lit(float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    nodes = written(rows.filter("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    # one vec_id on different vectors gives them one smallest id: nodes need ids of their own
    clash = nodes.groupBy("node").count().filter("count > 1").limit(1).count()
    if clash:
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()).join(rows.filter("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id")), ["label", "embedding"]))
    else:
        nodes = nodes.withColumn("first_id", F.col("node"))
    sigs = written(signatures(nodes, tables, functions, width))
    keyed = sigs.select("node", F.posexplode("sig").alias("t", "h"))
    nodes_n, rows_n = nodes.count(), rows.count()
    dealt = in_blocks(keyed, ["t", "h"], "node", block, nodes_n * tables)
    full = dealt.join(sigs, "node").join(nodes.select("node", "copies", "embedding"), "node")
    full = full.repartition("t", "h", "i", "j").sortWithinPartitions("t", "h", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["u", "v", "n"])

        out: list[tuple[int, int | None, int]] = []
        for g in groups(batches, ["t", "h", "i", "j"]):
            n, t = g.num_rows, g.column("t")[0].as_py()
            node, copies, blk = (g.column(c).to_numpy() for c in ("node", "copies", "blk"))
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            v = np.concatenate([c.flatten().to_numpy() for c in g.column("embedding").chunks]).astype(np.float64).reshape(n, -1)
            sig = np.concatenate([c.flatten().to_numpy() for c in g.column("sig").chunks]).reshape(n, -1)
            v = v / np.abs(v).max(1, keepdims=True)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
            if not len(left) or not len(right):
                continue
            forest, count = Forest(n), np.zeros(n, np.int64)
            for lo in range(0, len(left), 512):
                part = left[lo : lo + 512]
                a, b = np.nonzero(v[part] @ v[right].T >= threshold)
                a, b = part[a], right[b]
                if i == j:
                    a, b = a[a < b], b[a < b]
                forest.join(zip(a.tolist(), b.tolist()))
                new = np.ones(len(a), bool)  # each pair counts in the first table where it meets
                for s in range(t):
                    new &= sig[a, s] != sig[b, s]
                np.add.at(count, a[new], copies[b[new]])
                np.add.at(count, b[new], copies[a[new]])
            out += [(int(node[x]), None, int(count[x])) for x in np.flatnonzero(count)]
            out += [(int(node[x]), int(node[r]), 0) for x, r in forest.links()]
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    found = written(full.mapInArrow(compare, "u long, v long, n long"))
    counts = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("others"))
    comp = components(found.filter("v is not null").select("u", "v"))
    named = nodes.join(counts, nodes.node == counts.u, "left").join(comp, nodes.node == comp.id, "left")
    named = written(named.select("label", "embedding", "first_id", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "node").alias("c")))
    least = named.groupBy("c").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_vector = spread_join(named, least, ["c"], "n", nodes_n).select("label", "embedding", (F.col("others") + F.col("copies") - 1).alias("n_links"), "component_id", "copies")
    # vectors are wide: few of them are broadcast
    linked = spread_join(rows.filter("usable"), written(by_vector), ["label", "embedding"], "copies", rows_n, 10_000).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
