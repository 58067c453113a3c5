"""Sharding by balanced label propagation: linked documents move towards neighbours' shards under capacity quotas.

Links join documents of equal text. Only the counts of each (group, shard) cell move, so a group of any size is at most
`shards` rows. A round lets every cell vote for the shard where most of its group is; the demand between each pair of
shards is summed; the smaller of the two demands of a pair is exchanged, and free room takes more. A running sum over
bounded chunks admits cells up to the quota; the last one admitted may move in part. Documents without links fill what
room is left, which makes the counts of any two shards differ by one at most (law `rows`).

Nulls and edge cases: a null text has 8 bytes, CRC 0, and is of the group of empty texts; repeated rows are documents of
their own; with fewer rows than shards, the first shards get one each; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, discard, ranked, written

CHUNK = 2000
GROUP = ["h", "text_crc32", "size"]


def quotas(want: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How much may move from shard to shard: what both want of each other is exchanged, and free room takes more."""
    taken, out = [0] * len(free), {}
    for (at, to), n in sorted(want.items()):
        swap = min(n, want.get((to, at), 0))
        if quota := swap + max(0, min(n - swap, free[to] - taken[to])):
            out[at, to] = quota
        taken[to] += n - swap
    return out


def propagate(cells: DataFrame, room: list[int], parts: int, rounds: int) -> tuple[DataFrame, list[int]]:
    """cells (GROUP, shard, n) after the rounds, and what room of each shard they leave.

    The driver sees one number a shard and one a pair of shards in a round, however many cells there are.
    """
    spark, cells = cells.sparkSession, written(cells)
    free = list(room)
    for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
        free[r.shard] -= r.n
    for k in range(rounds):
        here = F.struct("n", F.xxhash64("h", "shard").alias("tie"), "shard")
        # in every second round only shards with free room are voted for, so that a large group goes on where room is
        may = F.when(F.get(F.array(*map(F.lit, free)), "shard") > 0, here) if k % 2 else here
        best = F.max(may).over(W.partitionBy(*GROUP))
        asks = cells.withColumn("best", best).filter(F.col("best").isNotNull() & (F.col("best") > here))
        asks = written(asks.select(*GROUP, "shard", F.col("best.shard").alias("to"), "n"))
        want = {(r.shard, r.to): r.want for r in asks.groupBy("shard", "to").agg(F.sum("n").alias("want")).collect()}  # one row a pair of shards
        moves = quotas(want, free)
        if not moves:
            discard(asks)
            break
        for (at, to), n in moves.items():
            free[at] += n
            free[to] -= n
        columns = zip(*[(at, to, n) for (at, to), n in moves.items()])
        pairs = pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], ["shard", "to", "quota"])
        pairs = F.broadcast(spark.createDataFrame(pairs))
        line = ranked(asks, ["shard", "to"], [F.col(c) for c in GROUP], F.pmod("h", F.lit(parts)), "place", {"ahead": "n"}).join(pairs, ["shard", "to"])
        move = F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("ahead"))).cast("long")
        both = F.array(F.struct("shard", (-F.col("n")).alias("n")), F.struct(F.col("to").alias("shard"), "n"))
        moved = line.select(*GROUP, "shard", "to", move.alias("n")).filter("n > 0").select(*GROUP, F.explode(both).alias("m")).select(*GROUP, "m.shard", "m.n")
        new = written(cells.union(moved).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
        discard(cells, asks)
        cells = new
    return cells, free


def shard(docs: DataFrame, shards: int = 24, rounds: int = 6, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    d = written(d)
    rows = d.count()
    parts = chunks(rows, chunk)
    linked = written(d.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    mine = F.pmod(F.xxhash64(F.lit(3), "doc_id", "h"), F.lit(parts))
    by_id = [F.xxhash64("doc_id"), F.col("doc_id"), *[F.col(c) for c in GROUP]]
    many = written(ranked(d.join(linked, GROUP, "left_semi"), [], by_id, mine, "seat"))
    many = many.withColumn("shard", (F.col("seat") % shards).cast("int"))
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    cells, left = propagate(many.groupBy(*GROUP, "shard").agg(F.count(F.lit(1)).alias("n")), room, parts, rounds)

    # the members of a group take its cells' places in the order of their rank in the group
    ends = F.sum("n").over(W.partitionBy(*GROUP).orderBy("shard"))
    places = cells.withColumn("end", ends).groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("places"))
    seated = ranked(many.select("doc_id", *GROUP), GROUP, by_id, mine, "seat").join(places, GROUP)
    first = lambda places: F.filter(places, lambda p: F.col("seat") < p["end"])[0]["shard"]
    seated = seated.select("doc_id", *GROUP, first("places").alias("shard"))

    ends = [F.struct(F.lit(end).cast("long").alias("end"), F.lit(s).alias("shard")) for s, end in enumerate(accumulate(left))]
    lone = ranked(d.join(linked, GROUP, "left_anti"), [], by_id, mine, "seat")
    lone = lone.select("doc_id", *GROUP, first(F.array(*ends)).alias("shard"))

    placed = ranked(written(seated.union(lone)), ["shard"], by_id, mine, "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
