"""Discovery of personal data by context, at the values that op3 runs with."""

import random
import re
import time

from pyspark.sql import functions as F

from tidelog.llm import pii


def test_few_seeds_tell_the_unseen_ids(spark):
    ids = ["4999-77-XY1", "4888-66-XY2", "4777-55-XY3", "4666-44-XY4"]
    seeds = [f"mail of person{k} is u{k}@example.org today" for k in range(20)]
    other = [f"room {k}{k} is free" for k in range(20)]
    texts = seeds + [f"mail of person7 is {x} today" for x in ids] + other
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for k, x in enumerate(ids):
        at = texts[20 + k].index(x)
        assert (at, 0, at + len(x)) in [tuple(s) for s in got[20 + k].added]
    assert not any(got[24 + k].added for k in range(20))


def test_context_reaches_over_other_tokens(spark):
    docs = spark.createDataFrame([(0, "id 77 card: a1 b2")], "doc_id long, text string")
    units = {u.token: u for u in pii.spans_of(docs).collect()[0].other}
    assert units["b2"].before == "id 77 card: a1 " and units["77"].after.startswith(" card: a1")


def test_contradicting_kinds_are_no_pattern(spark):
    texts = [f"reach me at u{k}@example.org now" for k in range(12)] + [f"reach me at 10.0.0.{k} now" for k in range(12)] + ["reach me at A77 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any(r.added for r in pii.find(docs).collect())


def test_a_table_of_numbers_takes_linear_time(spark):
    numbers, hosts = " ".join(str(10**6 + 7 * k) for k in range(130_000)), " ".join(f"1.2.{k % 250}.3" for k in range(100_000))
    docs = spark.createDataFrame([(1, numbers), (2, hosts)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert time.time() - began < 120 and len(got[1].base) == 0 and len(got[2].base) == 100_000
    assert [tuple(s)[::2] for s in got[2].base[:3]] == [(0, 7), (8, 15), (16, 23)]


def test_spans_over_the_pieces_of_a_fold(spark):
    texts = [" ".join(f"a{k}@b.c x{k} 1.1.{k % 256}.1,é" for k in range(n)) for n in (1, 127, 128, 129, 300)] + [None, "", "+1 555 123 4567890 12"]
    docs = spark.createDataFrame([(None if i % 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.h: r for r in pii.spans_of(docs.withColumn("k", F.lit(1))).join(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("t")).distinct(), "h").select("h", "t", "base", "other").collect()}
    assert len(rows) == 7
    for r in rows.values():
        assert all(r.t[s.start : s.end] == s.token and s.before == r.t[max(0, s.start - 60) : s.start] for s in [*r.base, *r.other])
        assert all(r.t[s.end :].startswith(s.after) for s in [*r.base, *r.other])
        tokens = [m for m in re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*", r.t) if not any(b.start < m.end() and m.start() < b.end for b in r.base)]
        assert [(s.start, s.end) for s in r.other] == [m.span() for m in tokens]


def slow_bootstrap(edges, rounds, support, confidence, unknown):
    seed = {}
    for p, i, k in edges:
        seed[p, i] = max(k, seed.get((p, i), -1))
    scores, best = {}, {}
    for _ in range(rounds):
        sums, known = {}, {}
        for (p, i), k in seed.items():
            for kind, x in [(k, 1.0)] if k >= 0 else scores.get(i, {}).items():
                sums[p, kind] = sums.get((p, kind), 0) + x
                known[p, kind] = known.get((p, kind), 0) + 1
        best = {}
        for (p, kind), x in sums.items():
            n = sum(q == p for q, _ in seed)
            of = sum(v for (q, _), v in sums.items() if q == p) + 1 + unknown * max(0, n - sum(v for (q, _), v in known.items() if q == p))
            if n >= support and known[p, kind] >= support and x / of >= confidence:
                best[p, kind] = x / of
        scores = {}
        for (p, i), k in seed.items():
            for (q, kind), c in best.items():
                if k < 0 and q == p:
                    scores.setdefault(i, {})[kind] = max(c, scores.get(i, {}).get(kind, 0))
    return best


def test_bootstrap_against_brute_force(spark):
    rng = random.Random(5)
    edges = [(f"p{rng.randrange(12)}", f"i{rng.randrange(90)}", rng.choice([0, 0, 0, 1, -1, -1])) for _ in range(700)]
    edges += [("good", f"s{k}", 2) for k in range(30)] + [("good", f"u{k}", -1) for k in range(25)] + [("next", f"u{k}", -1) for k in range(24)] + [("next", "v", -1)]
    want = slow_bootstrap(edges, 3, 5, 0.5, 0.1)
    df = spark.createDataFrame(edges, "pattern string, instance string, kind int")
    got = {(r.pattern, r.kind): r.confidence for r in pii.bootstrap(df, 3, 5, 0.5, 0.1).collect()}
    assert got.keys() == want.keys() and ("next", 2) in got and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_precision_of_planted_identifiers(spark):
    """Identifiers of a form that no base pattern knows, in a corpus with as many other tokens of that form."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    code = lambda: f"{rng.randrange(1000, 9999)}-{rng.choice('ABC')}{rng.randrange(100, 999)}"
    rows, planted = [], {}
    for k in range(600):
        lead = f"{word()} {word()}"
        if k % 3 == 0:
            rows.append(f"{lead} write to {word()}@{word()}.org {word()}")
        elif k % 3 == 1 and k % 2:
            planted[k] = code()
            rows.append(f"{lead} write to {planted[k]} {word()}")
        else:
            rows.append(f"{lead} part {code()} {word()}")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {(r.doc_id, rows[r.doc_id][s.start : s.end]) for r in pii.find(docs).collect() for s in r.added}
    assert found == set(planted.items())
