"""Helpers that the operators share: written tables, bounded groups, components, gapless ranks."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.session import on_workers

#: Words are runs of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Broadcasts hold this many rows at most; beyond, the same join shuffles.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir; a local one only where that is unset and all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = at.get() if at.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        named = f"file://{own}"
    return named


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, unless the session asks for fewer: texts are long, and both sides hold a batch."""
    on_workers(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tidelog-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing lazy reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._tidelog_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has so few rows; as it is otherwise, for a shuffled join."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df


def spread_join(rows: DataFrame, named: DataFrame, keys: list[str], of: str, total: int, most: int = BROADCAST_ROWS, without: bool = False) -> DataFrame:
    """rows joined on keys (never null) with named, which has a row for each key and in `of` how many rows the key has.

    Keys of over 2 * total / most rows are broadcast, so that no task gets all rows of one: there are at most most / 2, as
    their sum is total at most. The others are shuffled. total: the number of rows, or more. without: the rows that have
    no match instead.
    """
    least = max(1000, 2 * total // most)
    hot, cold = F.broadcast(named.filter(F.col(of) > least).drop(of)), named.filter(F.col(of) <= least).drop(of)
    if without:
        return rows.join(hot.select(*keys), keys, "left_anti").join(cold.select(*keys), keys, "left_anti")
    out = rows.join(hot, keys)
    return out.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys).select(*out.columns))


def chunks(rows: int, least: int) -> int:
    """Into how many chunks so many rows are dealt: chunks of `least` rows, or of the square root of the rows if that is more."""
    return max(1, -(-rows // max(least, math.isqrt(rows))))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by keys; it holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, keys: list[str], member: str, block: int, total: int) -> DataFrame:
    """Rows (total of them, or fewer) of buckets with two members or more, dealt so that no task needs more than two blocks of a bucket.

    Adds blk (the member's own block) and i <= j: the rows of one (keys, i, j) meet in one task. A bucket of n members
    has ceil(n / block) blocks, and each pair of its blocks is met once.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_bucket")).filter("in_bucket > 1")
    m = F.ceil(F.col("in_bucket") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), member), F.col("m")).cast("int")
    dealt = spread_join(rows, counts.withColumn("m", m), keys, "in_bucket", total).withColumn("blk", own)
    return dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select(
        *rows.columns, "blk", F.least("blk", "x").alias("i"), F.greatest("blk", "x").alias("j")
    )


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, pairs) -> None:
        for a, b in pairs:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in range(len(self.up)) if (r := self.root(x)) != x]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in edges (u, v): component is the smallest id reachable.

    Alternates large-star and small-star rounds: each keeps connectivity, edges never grow in number beyond twice the
    input, and O(log^2 n) rounds end in stars. Every round is a written table. The hub of a
    star is one key of many rows, of two numbers each; adaptive execution splits its partition where it is large.
    """
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        small = large.join(low, "a").select(F.explode(F.array(pair("a", "m"), pair("b", "m"))).alias("s")).select("s.a", "s.b").filter("a <> b").distinct()
        new = written(small)
        discard(e)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def ranked(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, name: str = "rank", weigh: dict[str, str] | None = None) -> DataFrame:
    """df with a gapless 0-based rank within keys, in the order of (chunk, order); no task holds more than a chunk of a key.

    chunk is an integer column that says which part of the key a row is in. Sizes of the parts are summed first; a
    running sum over parts (few rows) and one over the rows of each part give the rank. weigh: further columns by name, each
    the sum of a column of integers over the rows before.
    """
    sums = {name: F.lit(1), **{n: F.col(c) for n, c in (weigh or {}).items()}}
    d = df.withColumn("_chunk", chunk)
    sizes = d.groupBy(*keys, "_chunk").agg(*[F.sum(x).alias(f"_n_{n}") for n, x in sums.items()])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    names = [*keys, "_chunk"]
    starts = sizes.select(*[F.col(k).alias(f"_at_{k}") for k in names], *[F.coalesce(F.sum(f"_n_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums])
    cond = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in names]
    both = d.join(starts, cond).drop(*[f"_at_{k}" for k in names])
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = both.withColumns({n: (F.col(f"_start_{n}") + F.coalesce(F.sum(x).over(inner), F.lit(0))).cast("long") for n, x in sums.items()})
    return out.drop("_chunk", *[f"_start_{n}" for n in sums])
