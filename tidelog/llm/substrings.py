"""Exact substring deduplication: a radix sort of the suffixes, only as deep as the threshold, most significant digit first.

A suffix matters only through its first `length` bytes, its window; a byte goes if some window over it starts anywhere
else too. The passes over a window's digits:

1. Every window names one of its `digit`-byte strings, the one of least hash (all of them, where several are equal), so
   equal windows name equal strings at equal places. Each document yields one row for each place so named, about one in
   (length - digit) / 2 bytes. Rows whose hash is alone are dropped: their windows are alone.
2. Rows are counted by the digest of all bytes that their windows cover. Windows of equal covers repeat as a whole.
3. The different covers of one place meet in a task, which sorts their windows by two digits of `length` / 2 bytes, most
   significant first, dropping what is alone after each pass and comparing bytes at the end. Equal groups are exactly
   the repeated windows. A place with more than `block` different covers is split first: its windows are halved by
   their start and dealt by the digest of the bytes that all windows of a half hold, again and again where need be. At
   the last a half is one window, and equal digests are its equal group.

Nulls and edge cases: a null text is empty; texts under `length` bytes lose nothing; repeated rows are documents of
their own and so repeat each other; matches never cross documents; an empty table gives an empty result; a null doc_id
is kept, and texts of one doc_id or of none are told apart by 64 and 128 bits of hash; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, groups, spread_join, written
from tidelog.operators.stateful import in_streams

LENGTH, DIGIT, BLOCK, AT_ONCE = 200, 32, 32_768, 1 << 16
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)
TABLE = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What a row goes by: doc_id and a hash of the text, and two hashes of the text where doc_id is null. Rows of one text and
#: doc_id are alike in all that is found.
REF = ["d", "h"]


class Powers:
    """Powers of BASE and its inverse modulo 2^64, as many as asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n, UNBASE, np.uint64)])
        return cls.up, cls.down


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size`-byte string along the last axis."""
    n = data.shape[-1]
    up, down = Powers.of(n + 1)
    sums = np.zeros((*data.shape[:-1], n + 1), np.uint64)
    np.cumsum(TABLE[data] * up[:n], axis=-1, out=sums[..., 1:])
    h = (sums[..., size:] - sums[..., : n + 1 - size]) * down[: n + 1 - size]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each `width` neighbours."""
    s = 1
    while 2 * s <= width:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[: len(x) - (width - s)], x[width - s :]) if width > s else x


def named(texts: list[bytes], length: int, digit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, places, hashes) of the digit strings that the windows of each text name; texts of length bytes or more."""
    width, at = length - digit + 1, 0
    while at < len(texts):
        part, total = [], 0
        while at < len(texts) and (not part or total < AT_ONCE):
            part.append(at)
            total += len(texts[at])
            at += 1
        data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
        h = hashes(data, digit)
        least = sliding(h, width, np.minimum)
        sizes = np.array([len(texts[i]) for i in part])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        own = np.zeros(len(data) + 1, np.int64)  # windows within one text
        np.add.at(own, starts, 1)
        np.add.at(own, starts + sizes - length + 1, -1)
        least = np.where(np.cumsum(own)[: len(least)] > 0, least, np.uint64(0))
        most = sliding(np.r_[np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)], width, np.maximum)
        places = np.flatnonzero((most == h) & (most > 0))
        text = np.searchsorted(starts, places, side="right") - 1
        for k in np.unique(text):
            mine = places[text == k] if len(part) > 1 else places
            yield part[k], mine - starts[k], h[mine]


def cover(text: bytes, at: int, length: int, digit: int) -> tuple[int, bytes]:
    """How many bytes left of a place its windows reach, and all bytes that they cover."""
    reach = length - digit
    left = min(reach, at)
    return left, text[at - left : at + digit + reach]


def anchors(docs: DataFrame, length: int, digit: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long = [i for i, t in enumerate(batch.column("text")) if t.as_buffer().size >= length]
            texts = [batch.column("text")[i].as_buffer().to_pybytes() for i in long]
            for lo in range(0, len(texts), 256):
                some = texts[lo : lo + 256]
                keys, covers, rows, places = [], [], [], []
                for k, at, h in named(some, length, digit):
                    t = some[k]
                    for p in at.tolist():
                        left, c = cover(t, p, length, digit)
                        covers.append(xxhash.xxh3_64_intdigest(c, left) - (1 << 63))
                    keys.append(h.view(np.int64))
                    places.append(at)
                    rows.append(np.full(len(at), long[lo + k]))
                if not keys:
                    continue
                at = pa.array(np.concatenate(rows))
                ref = [batch.column(c).take(at) for c in REF]  # not the texts
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(covers, pa.int64()), *ref, pa.array(np.concatenate(places).astype(np.int32))], ["key", "cover", "d", "h", "pos"])

    return docs.select("text", *REF).mapInArrow(find, "key long, cover long, d long, h long, pos int")


def repeated_windows(m: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of m, the first and last start in lo..hi whose window another row has at the same start (hi < lo: none).

    first..last are the starts at which a row has a whole window. Windows are sorted by two digits of length / 2 bytes,
    the first half first; what is alone is dropped after each pass.
    """
    n = len(m)
    found_lo, found_hi = np.full(n, m.shape[1]), np.full(n, -1)
    twin_lo, twin_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)  # a row that has the same window there
    digit = length // 2
    code = hashes(m, digit)
    step = max(1, 400_000 // n)
    mix = np.uint64(0xD6E8FEB86659FD93)
    for a in range(lo, hi + 1, step):
        starts = np.arange(a, min(a + step, hi + 1))
        row, start = np.nonzero((first[:, None] <= starts) & (starts <= last[:, None]))
        if not len(row):  # near the ends of texts no row has a window at these starts
            continue
        start = starts[start]
        group = start.astype(np.uint64)
        for k in (0, length - digit):
            c = code[row, start + k] ^ (group + np.uint64(1)) * mix
            order = np.argsort(c)
            c = c[order]
            new = np.r_[True, c[1:] != c[:-1]]
            ids = np.cumsum(new) - 1
            keep = np.bincount(ids)[ids] > 1
            order, group = order[keep], ids[keep].astype(np.uint64)
            row, start = row[order], start[order]
            if not len(row):
                break
        if not len(row):
            continue
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        twin = np.repeat(row[head], np.diff(np.r_[head, len(row)]))
        twin[head] = row[head + 1]
        for at, found, twins, better in ((np.lexsort((-start, row)), found_lo, twin_lo, np.less), (np.lexsort((start, row)), found_hi, twin_hi, np.greater)):
            r, s, t = row[at], start[at], twin[at]
            end = np.r_[r[1:] != r[:-1], True]  # the least start of each row comes last, or the greatest
            r, s, t = r[end], s[end], t[end]
            now = better(s, found[r])
            found[r[now]], twins[r[now]] = s[now], t[now]
    # the bytes of the windows that decide are compared
    hit = np.flatnonzero(found_hi >= found_lo)
    for found, twins in ((found_lo, twin_lo), (found_hi, twin_hi)):
        for b in range(0, len(hit), 10_000):
            r = hit[b : b + 10_000]
            cols = found[r][:, None] + np.arange(length)
            if (m[r[:, None], cols] != m[twins[r][:, None], cols]).any():
                raise RuntimeError("two windows of one hash differ")  # its probability is about 2^-60 for each pair
    return found_lo, found_hi


def pairwise(ctx: list[bytes], left: list[int], reach: int, digit: int, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """As repeated_windows, for a few covers: by how far each pair agrees to the left and to the right of the place."""
    n = len(ctx)
    found_lo, found_hi = [1 << 30] * n, [-1] * n
    back = [c[:x][::-1] for c, x in zip(ctx, left)]
    fore = [c[x + digit :] for c, x in zip(ctx, left)]
    core = [c[x : x + digit] for c, x in zip(ctx, left)]

    def common(a: bytes, b: bytes) -> int:
        k = min(len(a), len(b))
        if a[:k] == b[:k]:
            return k
        low, high = 0, k  # agree through low, not through high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
        return low

    for i in range(n):
        for j in range(i):
            if core[i] != core[j]:
                continue
            first, last = reach - common(back[i], back[j]), common(fore[i], fore[j])
            first, last = max(first, lo), min(last, hi)
            if first <= last:
                for x in (i, j):
                    found_lo[x], found_hi[x] = min(found_lo[x], first), max(found_hi[x], last)
    return found_lo, found_hi


def solve(rows: DataFrame, length: int, digit: int) -> DataFrame:
    """d, h, start, end of what the covers of each (key, lo, hi, core) repeat; groups are bounded."""
    reach = length - digit
    keys = ["key", "lo", "hi", "core"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, keys):
            n = g.num_rows
            if n < 2:
                continue
            lo, hi = g.column("lo")[0].as_py(), g.column("hi")[0].as_py()
            ctx, left = g.column("ctx").to_pylist(), g.column("left").to_pylist()
            if n <= 8:
                first, last = map(np.array, pairwise(ctx, left, reach, digit, lo, hi))
            else:
                m = np.zeros((n, 2 * reach + digit), np.uint8)
                for i, (c, x) in enumerate(zip(ctx, left)):
                    m[i, reach - x : reach - x + len(c)] = np.frombuffer(c, np.uint8)
                x = np.array(left)
                right = np.array([len(c) for c in ctx]) - x - digit
                first, last = repeated_windows(m, reach - x, right, length, lo, hi)
            hit = np.flatnonzero((last >= first) & ~g.column("done").to_numpy(zero_copy_only=False).astype(bool))
            if len(hit):
                pos = g.column("pos").to_numpy()[hit] - reach
                at = pa.array(hit)
                d, h = (g.column(c).take(at).combine_chunks() for c in REF)
                yield pa.RecordBatch.from_arrays([d, h, pa.array((pos + first[hit]).astype(np.int32)), pa.array((pos + last[hit] + length).astype(np.int32))], ["d", "h", "start", "end"])

    return in_streams(rows, keys).mapInArrow(run, "d long, h long, start int, end int")


HALF = "key long, lo int, hi int, core binary, cover binary, d long, h long, pos int, done boolean, left int, ctx binary"


def halves(rows: DataFrame, length: int, digit: int) -> DataFrame:
    """Each cover twice, for the lower and the upper half of its window starts, as far as it has windows there."""
    reach = length - digit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in HALF.split(", ")]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                off, mid = reach - r["left"], (r["lo"] + r["hi"]) // 2
                right = len(r["ctx"]) - r["left"] - digit
                for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                    first, last = max(lo, off), min(hi, right)
                    if lo <= hi and first <= last:
                        core = xxhash.xxh3_128_digest(r["ctx"][hi - off : lo + length - off])
                        held = xxhash.xxh3_128_digest(r["ctx"][first - off : last + length - off] + bytes((first - lo, hi - last)))
                        out.append({**r, "lo": lo, "hi": hi, "core": core, "cover": held})
            if out:
                kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kinds[t]) for c, t in (x.split() for x in HALF.split(", "))], names)

    return rows.mapInArrow(run, HALF)


def refine(rows: DataFrame, length: int, digit: int, block: int) -> list[DataFrame]:
    """solve() for groups of any size: those over block are halved first."""
    found, keys, reach = [], ["key", "lo", "hi", "core"], length - digit
    while True:
        hot = rows.groupBy(*keys).count().filter(F.col("count") > block).drop("count")
        if not hot.limit(1).count():
            return [*found, solve(rows, length, digit)]
        found.append(written(solve(rows.join(hot, keys, "left_anti"), length, digit)))
        split = written(halves(rows.join(hot, keys, "left_semi").select(*[x.split()[0] for x in HALF.split(", ")]), length, digit))
        me = F.struct("d", "h", "pos")
        sums = written(split.groupBy(*keys, "cover").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("one")))
        both = split.join(sums, [*keys, "cover"])
        first = F.greatest(F.col("lo"), F.lit(reach) - F.col("left"))
        last = F.least(F.col("hi"), F.octet_length("ctx") - F.col("left") - digit)
        start = F.col("pos") - reach
        found.append(both.filter("n > 1 and not done").select("d", "h", (start + first).cast("int").alias("start"), (start + last + length).cast("int").alias("end")))
        rows = written(both.filter(me == F.col("one")).withColumn("done", F.col("done") | (F.col("n") > 1)).drop("n", "one"))


def repeats(docs: DataFrame, length: int, digit: int, block: int) -> DataFrame:
    """d, h, start, end of stretches all of whose bytes go; docs: text, d, h."""
    reach = length - digit
    all_anchors = written(anchors(docs, length, digit))
    places = all_anchors.count()
    twice = written(all_anchors.groupBy("key").count().filter("count > 1"))
    some = written(spread_join(all_anchors, twice, ["key"], "count", places))
    discard(all_anchors, twice)
    covers = written(some.groupBy("key", "cover").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*REF, "pos")).alias("one")))
    whole = spread_join(some, covers.filter("n > 1").select("key", "cover", "n"), ["key", "cover"], "n", places)
    whole = whole.select(*REF, (F.col("pos") - reach).cast("int").alias("start"), (F.col("pos") + digit + reach).cast("int").alias("end"))
    mixed = covers.groupBy("key").count().filter("count > 1")
    ones = spread_join(covers, mixed, ["key"], "count", places).select("key", (F.col("n") > 1).alias("done"), "one.*")
    by_doc = ones.groupBy(*REF).agg(F.collect_list(F.struct("key", "pos", "done")).alias("places"))  # fewer than the text has bytes

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_buffer().to_pybytes()
                places = batch.column("places")[i].as_py()
                found = [cover(text, p["pos"], length, digit) for p in places]
                n = len(places)
                ref = [pa.array([batch.column(c)[i].as_py()] * n, pa.int64()) for c in REF]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["key"] for p in places], pa.int64()), *ref, pa.array([p["pos"] for p in places], pa.int32()), pa.array([p["done"] for p in places], pa.bool_()), pa.array([x for x, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())],
                    ["key", *REF, "pos", "done", "left", "ctx"],
                )

    one_text = docs.join(by_doc, REF)
    rows = one_text.select("text", *REF, "places").mapInArrow(contexts, "key long, d long, h long, pos int, done boolean, left int, ctx binary")
    # rows that repeat a doc_id and its text give the same places; only where there are any are they dropped
    again = docs.groupBy(*REF).count().filter("count > 1").limit(1).count()
    rows = rows.dropDuplicates([*REF, "pos"]) if again else rows
    rows = written(rows.withColumns({"lo": F.lit(0), "hi": F.lit(reach), "core": F.lit(b""), "cover": F.lit(b"")}))
    return reduce(DataFrame.unionByName, refine(rows, length, digit, block), whole)


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        a, b = max(a, 0), min(b, n)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start and end bytes) and kept (binary) of every row of docs."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(9), text)).alias("d"), F.xxhash64(text).alias("h"))
    found = repeats(base, length, digit, block)
    spans = found.groupBy(*REF).agg(F.collect_set(F.struct("start", "end")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_buffer().to_pybytes()
                runs = merged([(s["start"], s["end"]) for s in batch.column("found")[i].as_py() or ()], len(data))
                at, kept = 0, []
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                rows.append((len(data), sum(b - a for a, b in runs), len(runs), runs, b"".join([*kept, data[at:]])))
            n, gone, k, runs, kept = zip(*rows) if rows else ((),) * 5
            pairs = pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, gone, k)], pairs, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = base.join(spans, REF, "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "found")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: int, end: int>>, kept binary")
