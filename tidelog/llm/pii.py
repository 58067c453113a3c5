"""Personal data by base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base spans come from four regular expressions, each written so that Java's engine reads any text in linear time: a match
can begin only where a run of its characters does, and runs are possessive. Their positions follow from the lengths of
matches and of the pieces between them, in code points.

Bootstrapping: base spans are seeds, and other tokens with a digit or an at-sign are unlabelled instances. The words around
an instance, other tokens and spans among them, are its lexical patterns. Rounds of joins score the bipartite graph of patterns and instances: a pattern's
confidence in a kind is the sum of its distinct instances' scores for the kind over those for all kinds, to which one
is added to shrink it, and `unknown` for each instance without a score; an instance's score is its best pattern's confidence. Patterns of high confidence and support then label instances that no base
pattern knows. Counts are pre-aggregated and hold for the whole corpus.

Nulls and edge cases: a null text is empty; repeated rows give repeated results (and one distinct instance); a null
doc_id is kept; an empty table gives an empty result; further columns are ignored. Added spans never overlap base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_broadcast, written

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    # a run before an at-sign matches from its start, or from where the last match ended
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole chain of digits with single spaces or hyphens between, of 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
ROUNDS, SUPPORT, CONFIDENCE, UNKNOWN = 3, 5, 0.9, 0.1


def digits_in(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x, at most 20, pass."""
    d = F.lpad(digits_in(x), 20, "0")
    total = F.lit(0)
    for p in range(1, 21):
        n = F.substring(d, p, 1).cast("int")
        total = total + (n if p % 2 == 0 else F.when(n > 4, 2 * n - 9).otherwise(2 * n))
    return total % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(IP.replace("0*+", "0*"))
    if kind == "card":
        return luhn(x)
    if kind == "phone":
        return F.length(digits_in(x)).between(9, 15)
    return F.lit(True)


SPAN = "struct<start: int, kind: int, end: int, token: string, before: string, after: string>"
#: How many items a fold appends to one array: longer arrays are built in pieces, as each append copies what there is.
PIECE = 128


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def scanned(items: Column, start: Column, nxt, emit, kind: str) -> Column:
    """All that emit(state, item) (arrays of kind) gives while nxt(state, item) leads from start over the items.

    Items are folded in pieces: a first pass finds the state at which each piece begins, a second one what it gives, so
    that no array grows long while it is built and time is linear in the items.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    part = lambda xs, k: F.slice(xs, k * PIECE + 1, PIECE)
    one = lambda acc, x: F.struct(nxt(acc["s"], x).alias("s"), F.concat(acc["out"], emit(acc["s"], x)).alias("out"))

    def run(xs: Column) -> Column:
        ks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / PIECE).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        ahead = lambda acc, k: F.struct(F.aggregate(part(xs, k), acc["s"], nxt).alias("s"), F.concat(acc["all"], F.array(acc["s"])).alias("all"))
        states = F.aggregate(ks, F.struct(start.alias("s"), F.slice(F.array(start), 1, 0).alias("all")), ahead)["all"]
        return let(states, lambda ss: F.flatten(F.transform(ss, lambda s, k: F.aggregate(part(xs, k), F.struct(s.alias("s"), none.alias("out")), one)["out"])))

    return let(items, run)


def located(text: Column, pattern: str, kind: int, keep) -> Column:
    """The pattern's matches that keep() holds for, with places in code points and the 60 characters on either side."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def items(found: Column, pieces: Column) -> Column:
        def after(i: Column) -> Column:
            near = [F.element_at(pieces, i + 2), F.try_element_at(found, i + 2), F.try_element_at(pieces, i + 3), F.try_element_at(found, i + 3), F.try_element_at(pieces, i + 4)]
            return F.left(F.concat(*[F.left(F.coalesce(x, F.lit("")), F.lit(60)) for x in near]), F.lit(60))

        gap = lambda i: F.element_at(pieces, i + 1)
        return F.transform(found, lambda m, i: F.struct(m.alias("m"), F.char_length(m).alias("n"), F.char_length(gap(i)).alias("gap"), F.right(gap(i), F.lit(60)).alias("left"), after(i).alias("after"), keep(m).alias("keep")))

    before = lambda s, x: F.right(F.concat(s["tail"], x["left"]), F.lit(60))

    def nxt(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.right(F.concat(before(s, x), x["m"]), F.lit(60)).alias("tail"))

    def emit(s: Column, x: Column) -> Column:
        at = s["at"] + x["gap"]
        return F.when(x["keep"], F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["n"]).alias("end"), x["m"].alias("token"), before(s, x).alias("before"), x["after"].alias("after")))).otherwise(none)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return let(both, lambda b: scanned(items(b["found"], b["pieces"]), start, nxt, emit, SPAN))


def clear_of(tokens: Column, base: Column) -> Column:
    """The tokens (disjoint, in order) that no base span overlaps: one pass over both by their starts."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    item = lambda x, is_base: F.struct(x["start"].alias("start"), F.lit(is_base).alias("rank"), x.alias("x"))
    last = F.array(F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit(1).alias("rank"), F.lit(None).cast(SPAN).alias("x")))
    line = F.concat(F.sort_array(F.concat(F.transform(base, lambda x: item(x, 0)), F.transform(tokens, lambda x: item(x, 1)))), last)
    is_base = lambda i: i["rank"] == 0

    def nxt(s: Column, i: Column) -> Column:
        x = i["x"]
        reach = F.when(is_base(i), F.greatest(s["reach"], x["end"])).otherwise(s["reach"])
        # a base span clears the token before it if they overlap; the next token tells that the one before it stays
        held = F.when(is_base(i), F.filter(s["held"], lambda t: t["end"] <= x["start"])).when(s["reach"] > i["start"], none).otherwise(F.array(x))
        return F.struct(reach.alias("reach"), held.alias("held"))

    return scanned(line, F.struct(F.lit(0).alias("reach"), none.alias("held")), nxt, lambda s, i: F.when(is_base(i), none).otherwise(s["held"]), SPAN)


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, h, h2 (two hashes of the text), base and other (spans) of every row."""
    text = F.coalesce("text", F.lit(""))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    d = docs.select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(5), "text"))
    number = F.col("text").rlike("[0-9]")
    for k, kind in enumerate(KINDS):
        may = F.col("text").contains(NEEDS[kind]) if kind == "email" else number & F.col("text").contains(NEEDS[kind]) if NEEDS[kind] else number
        d = d.withColumn(kind, F.when(may, located(F.col("text"), PATTERNS[kind], k, lambda m, kind=kind: valid(kind, m))).otherwise(none))
    d = d.withColumn("tokens", F.when(number | F.col("text").contains("@"), located(F.col("text"), TOKEN, -1, lambda _: F.lit(True))).otherwise(none))
    d = d.select("doc_id", "h", "h2", F.sort_array(F.concat(*KINDS)).alias("base"), "tokens")
    clear = F.when((F.size("tokens") > 0) & (F.size("base") > 0), clear_of(F.col("tokens"), F.col("base"))).otherwise(F.col("tokens"))
    return d.select("doc_id", "h", "h2", "base", clear.alias("other"))


def edges_of(units: DataFrame) -> DataFrame:
    """doc_id, h, h2, start, end, kind, instance and pattern of each unit: the words before, and before and after it."""
    words = lambda x: F.filter(F.split(F.lower(F.regexp_replace(x, "[0-9]", "0")), r"\s+"), lambda w: w != "")
    u = units.withColumn("b", words(F.col("u.before"))).withColumn("a", words(F.col("u.after")))
    one, two, nxt = F.try_element_at("b", F.lit(-1)), F.try_element_at("b", F.lit(-2)), F.try_element_at("a", F.lit(1))
    patterns = F.filter(F.array(F.concat(one, F.lit(" _")), F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _ "), nxt)), lambda p: p.isNotNull())
    return u.select("doc_id", "h", "h2", F.col("u.start").alias("start"), F.col("u.end").alias("end"), F.col("u.kind").alias("kind"), F.lower("u.token").alias("instance"), F.explode(patterns).alias("pattern"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, unknown: float = UNKNOWN) -> DataFrame:
    """pattern, kind, confidence of the patterns of high confidence after the rounds."""
    graph = written(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")))
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    seeds = graph.filter("seed >= 0").select("pattern", "instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    open_ = graph.filter("seed < 0").select("pattern", "instance")
    scored = seeds
    for k in range(rounds):
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("known"))
        every = sums.groupBy("pattern").agg(F.sum("sum").alias("all"), F.sum("known").alias("labelled"))
        # an instance of two kinds counts in both, so there may be more labels than instances
        of = F.col("all") + 1 + unknown * F.greatest(F.lit(0), F.col("n") - F.col("labelled"))
        best = sums.filter(F.col("known") >= support).join(sizes, "pattern").join(every, "pattern").select("pattern", "kind", (F.col("sum") / of).alias("confidence")).filter(F.col("confidence") >= confidence)
        best = written(best)
        if k < rounds - 1:
            # an instance's score is its best pattern's; it counts in each of its patterns in the next round
            told = open_.join(bounded_broadcast(best), "pattern").groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
            scored = seeds.union(open_.join(bounded_broadcast(told), "instance").select("pattern", "instance", "kind", "score"))
    return best


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, base and added spans (arrays of start, kind, end) and discovered patterns' spans of every row of docs."""
    d = written(spans_of(docs))
    units = d.select("doc_id", "h", "h2", F.explode(F.concat("base", "other")).alias("u"))
    edges = written(edges_of(units))
    best = bootstrap(edges, rounds, support, confidence)
    told = edges.filter("kind < 0").drop("kind").join(bounded_broadcast(best), "pattern")
    told = told.groupBy("h", "h2", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    # what is in a text does not depend on its row: the spans found go by the text's hashes
    added = told.groupBy("h", "h2").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = d.join(bounded_broadcast(added), ["h", "h2"], "left")
    return out.select("doc_id", short("base").alias("base"), F.coalesce("added", F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
