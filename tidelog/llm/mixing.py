"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

The word is the unit: with a rate r_d <= cap for each document, relative entropy sum of size_d * (r_d log r_d - r_d) is
minimised under one token constraint a source, sum of size_d * r_d = target, and one that all sources share: the mix keeps
the corpus's mean length of a word's document, sum of size_d * r_d * x_d = 0 with x_d the standardised log of the size. That
one is soft (`ridge` times the words is its penalty), since sources at their caps may leave no exact solution. Documents
have the exponentially tilted rate min(cap, exp(l_s + m * x_d)).

The dual is convex in (l, m). Each Newton step reduces its gradient and Hessian in Spark over the counts of (source, size),
which the documents are summed to once: sources meet only in m, so the Hessian is an arrow, and its Schur complement is
one number. Steps are at most 1 long in each l; they end when every source is within 1e-9 of its target.

Rates become copies (0, 1 or 2) by systematic rounding of their running sum along the documents ordered by size, in whole
millionths, so that reruns agree and the error of a source stays below its largest documents; a last greedy step adds or
takes single copies of a few documents of graded sizes until the error is below the smallest that helps. Running sums are
over bounded chunks: a hot source is never in one task.

Nulls and edge cases: a null text has size 0; null is a source of its own, the last; repeated rows are documents of
their own; an empty table gives an empty result; sources of no words get target 0. Equal rows may swap their copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import BROADCAST_ROWS, WORD, bounded_broadcast, chunks, discard, ranked, written

NEWTON_STEPS, RIDGE, CHUNK, UNIT = 60, 0.05, 2000, 1_000_000


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sources (source, source_size) with target: weights by code point order, null last, filled up to cap * source_size.

    Water filling in closed form: in order of cap / weight, the level is what remains over the weights that remain; the
    final level is the largest that its own source can hold.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    s = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    line = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(line.rowsBetween(0, W.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (total - before) / rest)
    s = s.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.partitionBy()))
    return s.withColumn("target", F.least("most", F.coalesce(F.col("weight") * F.col("water"), F.col("most")))).select("source", "source_size", "target")


def rates(cells: DataFrame, sources: DataFrame, cap: float, ridge: float = RIDGE, steps: int = NEWTON_STEPS) -> tuple[DataFrame, float, tuple[float, float]]:
    """(sources with l, m, (mean, sd) of the log sizes) at the dual's optimum; cells: source, size, n; sources of targets()."""
    log = F.log2(F.greatest("size", F.lit(1)).cast("double"))
    words = (F.col("size") * F.col("n")).cast("double")
    total = cells.agg(F.sum(words).alias("w"), F.sum(words * log).alias("wx"), F.sum(words * log * log).alias("wxx")).first()
    w = total.w or 0.0
    mean = total.wx / w if w else 0.0
    sd = max(1e-9, max(0.0, total.wxx / w - mean**2) ** 0.5) if w else 1.0
    # a source at its cap has every document there, one of no words or target has none
    kind = F.when((F.col("source_size") <= 0) | (F.col("target") <= 0), "none").when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), "full").otherwise("free")
    start = F.when(kind == "free", F.log(F.col("target") / F.col("source_size"))).otherwise(F.when(kind == "full", F.lit(1e3)).otherwise(F.lit(-1e3)))
    hint = F.broadcast if sources.count() <= BROADCAST_ROWS else lambda x: x
    first = written(sources.select("source", "source_size", "target", kind.alias("kind"), start.alias("l"), F.lit(0.0).alias("m")))
    state, ridged, last = first, F.lit(ridge * w), None
    c = cells.filter("size > 0").select(F.col("source").alias("at"), words.alias("w"), ((log - mean) / sd).alias("x"))
    tilt = F.exp(F.col("l") + F.col("m") * F.col("x"))
    r = F.col("w") * F.least(tilt, F.lit(float(cap)))
    inner = F.when(tilt < cap, r).otherwise(0.0)
    free = (F.col("kind") == "free") & (F.col("a") > 0)
    of = lambda x: F.coalesce(F.sum(F.when(free, x)), F.lit(0.0))
    # m and the step stay in the tables: numbers in the plan would be compiled anew in each round
    for _ in range(steps):
        both = c.join(hint(state), F.col("at").eqNullSafe(F.col("source")))
        sums = both.groupBy("source", "source_size", "target", "kind", "l", "m").agg(F.sum(r).alias("r"), F.sum(r * F.col("x")).alias("g"), F.sum(inner).alias("a"), F.sum(inner * F.col("x")).alias("b"), F.sum(inner * F.col("x") ** 2).alias("c"))
        sums = written(sums.withColumn("f", F.when(F.col("kind") == "free", F.col("target") - F.col("r")).otherwise(0.0)).coalesce(8))
        got = sums.agg((-F.sum("g") - ridged * F.max("m")).alias("gradient"), of(F.col("c")).alias("cc"), of(F.col("b") * F.col("f") / F.col("a")).alias("bf"), of(F.col("b") ** 2 / F.col("a")).alias("bb"), F.max(F.abs("f") / F.col("target")).alias("miss"), F.max("m").alias("at_m"))
        now = got.first()
        if last is not None:
            discard(last)
        last = sums
        if now.at_m is None or (now.miss <= 1e-9 and abs(now.gradient) <= 1e-7 * max(1.0, w)):
            break
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("gradient") - F.col("bf")) / (ridged + F.greatest(F.lit(0.0), F.col("cc") - F.col("bb")))))
        # without a document below the cap a source has no curvature: it goes down, or up, by the longest step
        move = F.when(F.col("kind") != "free", 0.0).when(F.col("a") > 0, (F.col("f") - F.col("b") * F.col("step")) / F.col("a")).otherwise(F.signum("f"))
        one = F.broadcast(got.select(step.alias("step")))  # one row
        state = sums.crossJoin(one).select("source", "source_size", "target", "kind", (F.col("l") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), move))).alias("l"), (F.col("m") + F.col("step")).alias("m"))
    else:
        raise RuntimeError(f"the dual did not settle in {steps} steps")
    done = last.select("source", "source_size", "target", "kind", "l")
    wordless = first.filter("source_size <= 0 or source_size is null").drop("m")
    return done.unionByName(wordless), float(now.at_m or 0.0), (mean, sd)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, keep: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """doc_id, the columns keep, size, source_size, target, rate, copies and taken of every row of docs."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    d = written(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(11), "doc_id", "text").alias("_order"), *keep))
    cells = written(d.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sums = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    state, m, (mean, sd) = rates(cells, targets(sums, weights, share, cap), cap)
    parts = chunks(d.count(), chunk)
    at = state.select(F.col("source").alias("_at"), "source_size", "target", "l")
    tilt = F.exp(F.col("l") + m * (F.log2(F.greatest("size", F.lit(1)).cast("double")) - mean) / sd)
    r = d.join(bounded_broadcast(at), F.col("source").eqNullSafe(F.col("_at"))).withColumn("rate", F.least(tilt, F.lit(float(cap)))).drop("_at", "l")
    r = r.withColumn("_units", F.round(F.col("rate") * UNIT).cast("long"))
    grade = F.floor(4 * F.log2(F.greatest("size", F.lit(1)).cast("double"))).cast("long")
    order = [F.col("size"), F.col("_order"), F.col("doc_id")]
    r = ranked(r, ["source"], order, grade * parts + F.pmod(F.col("_order"), F.lit(parts)), "nth", {"_ahead": "_units"})
    half = UNIT // 2
    whole = lambda x: F.floor((x + half) / F.lit(UNIT))
    r = r.withColumn("copies", (whole(F.col("_ahead") + F.col("_units")) - whole(F.col("_ahead"))).cast("int"))
    first = written(r.drop("_units", "_ahead", "_order"))

    # what a source misses or has too much is made up by one document of each grade of sizes and direction at most
    miss = first.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("sum"))
    turn = F.explode(F.array(F.lit(1), F.lit(-1)))
    able = first.filter("size > 0").select("source", "nth", "size", "copies", turn.alias("turn")).filter(F.col("copies") + F.col("turn") >= 0).filter(F.col("copies") + F.col("turn") <= cap)
    graded = able.groupBy("source", "turn", grade.alias("grade")).agg(F.min_by(F.struct("size", "nth"), F.xxhash64("nth", "size")).alias("c"))
    line = graded.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("c.size").alias("size"), F.col("c.nth").alias("nth"), "turn")), asc=False).alias("line"))
    line = line.withColumnRenamed("source", "at")
    m = miss.join(line, F.col("source").eqNullSafe(F.col("at"))).select("source", "line", F.round(F.col("target") - F.col("sum")).cast("long").alias("miss"))
    none = F.expr("cast(array() as array<struct<nth: bigint, turn: int>>)")
    pick = F.aggregate(
        "line",
        F.struct(F.col("miss").alias("left"), none.alias("picked")),
        lambda acc, x: F.when(
            (x["size"] * x["turn"] * F.signum(acc["left"]) > 0) & (x["size"] <= F.abs(acc["left"])) & ~F.exists(acc["picked"], lambda p: p["nth"] == x["nth"]),
            F.struct((acc["left"] - x["size"] * x["turn"]).alias("left"), F.concat(acc["picked"], F.array(F.struct(x["nth"].alias("nth"), x["turn"].alias("turn")))).alias("picked")),
        ).otherwise(acc),
    )
    picks = m.select("source", F.explode(pick["picked"]).alias("p")).select(F.col("source").alias("at"), F.col("p.nth").alias("at_nth"), "p.turn")
    picks = bounded_broadcast(written(picks))
    out = first.join(picks, F.col("source").eqNullSafe(F.col("at")) & (F.col("nth") == F.col("at_nth")), "left")
    copies = (F.col("copies") + F.coalesce("turn", F.lit(0))).cast("int")
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", "rate", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))
