"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import common, decontaminate, embeddings, language, mixing, pages, pii, quality, sharding, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, node string, component string, key string, size string, rank int, shard int, score string, h string, d string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def documents(spark, texts, langs=None, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else "s", 0) + (None,) * 10 for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    base = prose(1, 90)
    near = base.split()
    near[40] = "other"
    return [base, base, " ".join(near), None, "", " \n\t", "One", "one", "Two words", prose(2, 60), "ÀÉ " * 20, base.upper(), prose(3, 12000), base + " tail", "a" * 30_000]


def components_of(n, linked):
    up = list(range(n))
    for a, b in linked:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    out = []
    for x in range(n):
        while up[x] != x:
            x = up[x]
        out.append(x)
    return out


def slow_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("block", [2, 4096])
def test_simhash(spark, block):
    texts = odd_texts()
    fps = [slow_fingerprint(t) for t in texts]
    want = components_of(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts), block=block).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_of_null_ids(spark):
    texts, ids = [prose(1, 40), prose(1, 40), prose(2, 40), prose(2, 40), None, ""], [None, 9, None, None, None, 4]
    rows = simhash.near_duplicates(documents(spark, texts, ids=ids)).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter([(None, 9), (9, 9), (None, None), (None, None), (None, 4), (4, 4)])


def test_embeddings_of_null_and_repeated_ids(spark):
    v, w = [1.0, 0.5, 0.0], [0.0, 0.1, 1.0]
    rows = [(None, v, 1), (3, v, 1), (3, v, 1), (3, w, 1), (8, w, 1)]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == Counter({(None, 0, None, False): 1, (3, 1, 3, True): 3, (8, 1, 3, False): 1})


def test_bk_tree_finds_all_links():
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    values = list({centre ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for _ in range(600)} | {int(x) for x in rng.integers(0, 2**63, 200)})
    linked = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    found = dict(simhash.links_of(values, 2))
    got = components_of(len(values), found.items())
    assert got == components_of(len(values), linked)


def test_similar_documents(spark):
    texts, base = [], prose(7, 300, 5000).split()
    texts.append(" ".join(base))
    for k in range(1, 6):  # one word in a hundred: shingles share about 0.9
        t = base.copy()
        for at in (30 * k, 150 + 11 * k):
            t[at] = f"new{k}"
        texts.append(" ".join(t))
    texts += [prose(20 + k, 300, 5000) for k in range(10)] + [None, "", "  "]
    got = {r.doc_id: r.component for r in simhash.similar_documents(documents(spark, texts)).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(16)}) == 11 and got[16] == got[17] == got[18]


def test_components_of_a_long_path(spark):
    n = 300
    got = dict(common.components(spark.createDataFrame([(i + 1, i) for i in range(n)] + [(n + 10, n + 11)], "u long, v long")).collect())
    assert set(got.values()) == {0, n + 10} and len(got) == n + 3


def test_ranked_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    got = common.ranked(df, ["k"], [F.col("v")], F.floor(F.col("v") / 50), "r").collect()
    for k in range(3):
        assert [r.r for r in sorted((r for r in got if r.k == k), key=lambda r: r.v)] == list(range(len([r for r in got if r.k == k])))


@pytest.mark.parametrize("block", [3, 2048])
def test_embeddings(spark, block):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(6):
        centre = rng.standard_normal(16)
        for _ in range(8):
            rows.append(((centre + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.06])).astype(np.float32).tolist(), c % 2))
    rows += [(rows[0][0], 0), (rows[0][0], 1), ([2 * x for x in rows[0][0]], 0), (None, 0), ([0.0] * 16, 0), ([1.0, None] + [0.0] * 14, 0), ([float("nan")] * 16, 0), ([float("inf")] * 16, 0), ([], 0), (rows[0][0], None), ([1.0, 2.0], 0), ([1.0, 2.0], 0)]
    df = spark.createDataFrame([(i, v, y, "x") for i, (v, y) in enumerate(rows)], "vec_id long, embedding array<float>, label int, node string")
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, np.float32)).all() and any(v) for v, _ in rows]

    def linked(i, j):
        a, b = rows[i], rows[j]
        if not (ok[i] and ok[j] and a[1] == b[1] is not None and a[1] is not None and len(a[0]) == len(b[0])):
            return False
        x, y = np.array(a[0], np.float32).astype(float), np.array(b[0], np.float32).astype(float)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if linked(i, j)]
    want = components_of(len(rows), pairs)
    n = Counter(x for p in pairs for x in p)
    got = {r.vec_id: r for r in embeddings.near_vectors(df, block=block).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(pairs)
    assert all(got[i].n_links <= n[i] for i in range(len(rows)))
    assert sum(got[i].component_id == want[i] for i in range(len(rows))) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def slow_removal(texts, n=200):
    counts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if counts[t[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        kept = bytes(c for c, h in zip(t, hit) if not h)
        yield len(t), sum(hit), len([x for x in bytes(hit).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("block", [2, 32_768])
def test_substrings(spark, block):
    passage = prose(5, 70)
    texts = odd_texts() + [f"{prose(30 + k, 20 + k)} {passage} {prose(60 + k, 15)}" for k in range(12)] + [passage[k * 7 :] + prose(90 + k, 40) for k in range(6)]
    texts += [prose(5, 200)[:199], "é" * 150 + prose(99, 30), "é" * 150 + prose(98, 30), prose(77, 25) * 6, passage[:260], passage[:150] + "x" + passage[151:]]
    ids = [*range(len(texts) - 1), 3]
    docs = documents(spark, texts + [texts[0]], ids=[*ids, 0])
    want = Counter(slow_removal([(t or "").encode() for t in texts + [texts[0]]]))
    out = substrings.remove(docs, block=block).select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, out)) == want
    assert substrings.remove(documents(spark, [])).count() == 0


def test_substrings_of_clashing_ids(spark):
    """Texts of one doc_id or none, of one CRC-32: what one loses the other keeps."""
    rng = np.random.default_rng(6)
    seen: dict[int, str] = {}
    while True:  # two texts of one CRC-32 by birthday
        t = "".join(map(chr, rng.integers(97, 123, 12)))
        if zlib.crc32(t.encode()) in seen and seen[zlib.crc32(t.encode())] != t:
            one, other = seen[zlib.crc32(t.encode())], t
            break
        seen[zlib.crc32(t.encode())] = t
    tail = prose(41, 150)
    a, b = one + tail, other + tail  # equal tails keep the CRC-32 equal
    b_only = other + tail
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode()) and a != b
    for i in (None, 5):
        texts = [a, b_only, prose(42, 100), prose(42, 100), prose(43, 100)]
        docs = documents(spark, texts, ids=[i, i, i, 7, i] if i else [None] * 5)
        want = Counter(slow_removal([t.encode() for t in texts]))
        got = Counter(map(tuple, substrings.remove(docs).select("n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()))
        assert got == want


def test_pii_base_spans(spark):
    texts = ["a@b.c_d@e.f and x.y%z@q-r.s.t.", "1.2.3.4.5.6.7.8 999.1.1.1 256.0.0.1 001.02.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112 4699858775519183x 12 34  5", "+1 (555) 555-1234. +12 +1-2-3 +49..30..123456)", None, "", "😀 é a@b.cd 😀 1.1.1.1", "a" * 20_000 + "@x.y", "1-" * 9000, "1." * 5000, "0" * 25 + " +" + "1" * 16]
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "phone": 9 <= len(digits) <= 15}[kind]

    for r in pii.find(documents(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(pats.items()) for m in re.finditer(p, t) if good(kind, m.group()))
        assert [tuple(s) for s in r.base] == want, t[:80]
    assert pii.find(documents(spark, [])).count() == 0


def test_pii_discovers_by_context(spark):
    seeds = [f"{prose(k, 8)} card number: 4{k:03d}00000000{k:04d} {prose(k + 50, 5)}" for k in range(1, 200)]

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    seeds = [s for s in seeds if luhn(re.search(r"4\d{15}", s)[0])]
    assert len(seeds) > 10
    texts = seeds + ["see card number: 4999-77-XY1 thanks", "room 4999-77-XY1 is free", "the card number: 12 is no"]
    got = {r.doc_id: r for r in pii.find(documents(spark, texts), confidence=0.7).collect()}
    n = len(seeds)
    assert [tuple(s) for s in got[n].added] == [(17, 2, 28)] and not got[n + 1].added


def test_language(spark):
    a, b = [f"{x}{y}ung" for x in "bdg" for y in "aeo"], [f"{x}{y}tion" for x in "prl" for y in "iuy"]
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(a if i % 2 else b, 30)) for i in range(80)] + [None, "", "12 34 !!", " ".join(b) + " " + " ".join(a * 9), "Bagung " * 900]
    langs = ["aa" if i % 2 else "bb" for i in range(80)] + [None, "aa", "bb", None, "aa"]
    out = {r.doc_id: r for r in language.learn_and_identify(documents(spark, texts, langs), ~language.held_out(4, 2)).collect()}
    assert all(out[i].lang_pred == langs[i] for i in range(80)) and out[84].lang_pred == "aa" and out[83].lang_pred == "aa"
    assert [(out[i].lang_pred, out[i].score) for i in (80, 81, 82)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in language.learn_and_identify(documents(spark, ["abc"], [None]), F.lit(True)).collect()} == {"und"}
    words = language.fit([(t, y) for t, y in zip(texts, langs) if t and y])
    marks = words.marginals([[*b, *a]])[0].argmax(1)  # code-switched: the words' labels follow the switch
    assert [words.labels[k] for k in marks] == ["bb"] * 9 + ["aa"] * 9


def test_blocks_give_the_marginals_of_the_whole_sequence(monkeypatch):
    rng = np.random.default_rng(0)
    a, b = [f"{x}{y}ung" for x in "bdg" for y in "aeo"], [f"{x}{y}tion" for x in "prl" for y in "iuy"]
    crf = language.fit([(" ".join(rng.choice(a if i % 2 else b, 30)), "ab"[i % 2]) for i in range(40)])
    crf.weights *= 0.05  # so that neighbours matter
    seqs = [list(rng.choice([*a, *b, "zzz"], n)) for n in (3, 40, 129, 64, 65)]
    monkeypatch.setattr(language, "BLOCK", 10**9)
    want = crf.marginals(seqs)
    monkeypatch.setattr(language, "BLOCK", 16)
    assert max(np.abs(x - y).max() for x, y in zip(want, crf.marginals(seqs))) < 1e-12


def test_language_edges(spark):
    text = " ".join(["bagung dedung"] * 9000)  # longer than any piece that teaches
    texts, langs = ["patiyn rytion " * 20, text, "½² Ⅷ ① 12", "Ⅷ bagung", None], ["bb", "aa", None, None, "aa"]
    out = {r.doc_id: r for r in language.learn_and_identify(documents(spark, texts, langs), F.lit(True)).collect()}
    assert [out[i].lang_pred for i in range(5)] == ["bb", "aa", "und", "aa", "und"]
    assert language.words_of("x½y Ⅷz_1") == ["x", "y", "z"]
    assert language.learn_and_identify(documents(spark, []), F.lit(True)).count() == 0
    twice = language.learn_and_identify(documents(spark, texts[:2] * 2, langs[:2] * 2, ids=[None] * 4), F.lit(True)).collect()
    assert len(twice) == 4 and len({(r.lang_pred, r.score) for r in twice}) == 2


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    em, trans = rng.random((7, 3)) + 0.1, rng.random((3, 3)) + 0.1
    got = language.forward_backward(em, trans, np.array([0, 4]), np.array([4, 3]))
    for s, n in ((0, 4), (4, 3)):
        total = np.zeros((n, 3))
        for ys in product(range(3), repeat=n):
            w = np.prod([em[s + t, y] for t, y in enumerate(ys)]) * np.prod([trans[x, y] for x, y in zip(ys, ys[1:])])
            for t, y in enumerate(ys):
                total[t, y] += w
        assert np.allclose(got[s : s + n], total / total.sum(1, keepdims=True))


def test_quality(spark):
    texts = [prose(i, 80) if i % 3 else f"BUY!! {i} " * 40 for i in range(300)] + [None, "", "x" * 100_000]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x") for i in range(280)] + [(300, None, 0, ""), (9999, 1, 0, ""), (None, 0, 0, "")], "doc_id long, quality int, toxic int, text string")
    out = {r.doc_id: r.score for r in quality.learn_and_score(documents(spark, texts), labels, ~language.held_out(5, 0)).collect()}
    assert len(out) == 303 and all(0 <= s <= 1 for s in out.values()) and all((out[i] >= 0.3) == (i % 3 > 0) for i in range(300))
    assert [r.score for r in quality.learn_and_score(documents(spark, ["a"]), labels.limit(0), F.lit(True)).collect()] == [0.5]


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0, "") for i in range(40)] * 2, "doc_id long, quality int, toxic int, text string")
    texts = [f"BUY!! {i} " * 30 if i % 2 else prose(i, 60) for i in range(40)]
    out = quality.learn_and_score(documents(spark, texts * 2, ids=[*range(40)] * 2), labels, F.lit(True)).collect()
    assert len(out) == 80 and len({(r.doc_id, r.score) for r in out}) == 40
    assert quality.learn_and_score(documents(spark, []), labels, F.lit(True)).count() == 0
    assert len(quality.learn_and_score(documents(spark, ["a", None], ids=[None, None]), labels, F.lit(True)).collect()) == 2


def test_forest_arrays_equal_node_walk():
    rng = np.random.default_rng(0)
    x = rng.random((400, 5))
    y = (x[:, 0] + (x[:, 1] > 0.5) > 0.9).astype(float)
    f = quality.fit(x, y, trees=20)

    def walk(row):
        s = f.base
        for at in f.roots:
            while f.feature[at] >= 0:
                at = f.left[at] + int(row[f.feature[at]] > f.threshold[at])
            s += f.value[at]
        return 1 / (1 + np.exp(-s))

    assert np.allclose(f.scores(x), [walk(r) for r in x]) and ((f.scores(x) > 0.5) == y).mean() > 0.97


def test_pages(spark):
    html = [
        "<html><head><title>T</title><style>p{}</style><script>var x='<p>no</p>'</script></head><body><nav><a href=a>Home</a></nav><div class='ad'>Buy now</div><article><h1>Title</h1><p><b>First &amp; best<br>part<p>Second  \n para&#233;.</article><div id=comments><p>Nice</div><footer>f</footer>",
        "<body><header>Site</header><div class=page><div class=content><p>Long enough text here, with words.</p><p>And <i>more</i> of it.</p></div><div class='sidebar widget'><p>Side</p></div></div><form><p>Name</p><input></form><div class='cookie-notice'>We use cookies</div></body>",
        None, "", "just text", "<p>un<b>closed", "<div>" * 3000 + "deep" + "</div>" * 3000, "<body><ul><li><a>x</a><li><a>y</a></ul></body>", "<article><p>a</p><aside>b</aside><p hidden>c</p><p style='display:none'>d</p>e</article>",
    ]
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in pages.extract(df).collect()}
    assert [out[i].text for i in range(9)] == ["Title First & best part Second paraé.", "Long enough text here, with words. And more of it.", "", "", "just text", "unclosed", "deep", "", "a e"]
    assert all(r.n_chars == len(r.text) and r.url == f"u{i}" for i, r in out.items())


def test_mixing(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(["w"] * int(n)) for n in rng.geometric(0.02, 600)] + [None, "", "\x0b \x85x"]
    sources = [["a", "b", "c", "d", None][min(4, int(x))] for x in rng.geometric(0.4, 603) - 1]
    out = mixing.mix(documents(spark, texts, sources=sources), chunk=50).collect()
    again = mixing.mix(documents(spark, texts, sources=sources), chunk=50).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == 603
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in out)
    total, names = Counter(), ["a", "b", "c", "d", None]
    for i, s in enumerate(sources):
        total[s] += size[i]
    left, weight = 1.5 * sum(size.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, open_ = {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not full:
            want |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            want[s] = 2 * total[s]
            left -= want[s]
        open_ -= full
    for s in names:
        mine = [r for r in out if sources[r.doc_id] == s]
        assert all(r.source_size == total[s] and abs(r.target - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(10, 0.01 * want[s])
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mixing_solves_the_dual(spark):
    """The conditions of the optimum, which is unique: token constraints, one tilt for all sources, the shared moment."""
    rng = np.random.default_rng(9)
    sources = ["a"] * 700 + ["b"] * 200 + [None] * 100 + ["z"] * 3
    texts = [" ".join(["w"] * int(n)) for n in [*rng.geometric(0.01, 700), *rng.geometric(0.05, 200), *rng.geometric(0.002, 100)]] + [None, "", " "]
    rows = [r for r in mixing.mix(documents(spark, texts, sources=sources)).collect() if r["size"]]
    size, rate = np.array([r["size"] for r in rows], float), np.array([r.rate for r in rows])
    x = np.log2(size)
    mean = (size * x).sum() / size.sum()
    x = (x - mean) / np.sqrt((size * (x - mean) ** 2).sum() / size.sum())
    src, slopes = np.array([str(r.source) for r in rows]), []
    for s in set(src):
        at = src == s
        target = next(r.target for r in rows if str(r.source) == s)
        assert abs((size[at] * rate[at]).sum() - target) <= 1e-6 * target
        low = at & (rate < 2)
        if len(set(size[low])) > 1:
            slope, l = np.polyfit(x[low], np.log(rate[low]), 1)
            assert np.allclose(np.log(rate[low]), slope * x[low] + l, atol=1e-6) and (slope * x[at & ~low] + l >= np.log(2) - 1e-6).all()
            slopes.append(slope)
    assert len(slopes) >= 2 and np.ptp(slopes) < 1e-6 and abs(slopes[0]) > 1e-3
    assert abs(-(size * rate * x).sum() - mixing.RIDGE * size.sum() * slopes[0]) <= 1e-5 * size.sum()


def test_mixing_edges(spark):
    assert [(r.taken, r.target) for r in mixing.mix(documents(spark, [None, "", " "], sources=["a", None, "a"])).collect()] == [(0, 0.0)] * 3
    same = mixing.mix(documents(spark, ["a b c"] * 50, sources=["x"] * 50, ids=[None] * 50)).collect()
    assert sum(r.taken for r in same) == 225
    long = mixing.mix(documents(spark, ["w " * 300_000, "v"], sources=["x", "y"])).collect()
    assert sorted(r["size"] for r in long) == [1, 300_000] and all(r.taken <= 2 * r["size"] for r in long)


def test_sharding_edges(spark):
    texts = ["same"] * 500 + ["x" * 2_000_000, None]
    out = sharding.shard(documents(spark, texts, ids=[None] * 400 + list(range(102)))).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == 502 and max(counts.values()) - min(counts.values()) <= 1 and all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in counts.items())


@pytest.mark.parametrize("least", [0, 10**9])
def test_spread_join_deals_hot_keys(spark, least, monkeypatch):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i % 40}", i) for i in range(400)] + [("none", 1)], "k string, v int")
    named = rows.filter("k <> 'none'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = common.spread_join(rows, named, ["k"], "n", max(least, 3401))
    assert sorted(map(tuple, got.select("k", "v", "top").collect())) == sorted(map(tuple, rows.join(named, "k").select("k", "v", "top").collect()))
    assert [r.k for r in common.spread_join(rows, named, ["k"], "n", max(least, 3401), without=True).collect()] == ["none"]


def test_sharding(spark):
    texts = [prose(k, 5) for k in range(150)] + [prose(k % 40, 5) for k in range(200)] + ["hot"] * 300 + [None, "", None]
    out = sharding.shard(documents(spark, texts), shards=24, chunk=37).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "rows" and r.grown_shard is None for r in out)
    small = {}
    for r in out:
        if texts[r.doc_id] not in ("hot", None, ""):
            small.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(x) > 1 for x in small.values()) <= 0.3 * len(small)
    assert len({r.shard for r in out if texts[r.doc_id] == "hot"}) < 24
    assert len({r.shard for r in sharding.shard(documents(spark, ["a", "b"])).collect()}) == 2 and sharding.shard(documents(spark, [])).count() == 0


def test_decontamination(spark):
    items = [prose(200 + k, 25, 3000) + ". " + prose(300 + k, 8, 3000) + "." for k in range(20)]
    changed = items[3].split()
    changed[4], changed[11] = "swapped", "words"
    texts = [prose(k, 400, 3000) for k in range(40)] + [f"{prose(50, 90, 3000)} {items[1].upper()} {prose(51, 40, 3000)}", f"{prose(52, 30, 3000)} {' '.join(changed)} {prose(53, 900, 3000)}", items[2], None, "", prose(60, 10) * 2000]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(90, None, ""), (91, "", "")], "item_id long, text string, cosine string")
    out = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    assert set(out) == {(40, 1), (41, 3), (42, 2)} and out[40, 1].lcs == 1.0 and 0.8 < out[41, 3].lcs < 1
    assert decontaminate.leaks(documents(spark, texts), bench.limit(0)).count() == 0 and decontaminate.leaks(documents(spark, []), bench).count() == 0


def test_decontamination_of_ties_and_repeats(spark):
    item = prose(401, 25, 3000) + ". " + prose(402, 8, 3000) + "."
    bench = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    texts = [f"{prose(50, 60, 3000)} {item}", f"{prose(50, 60, 3000)} {item}", f"{item} {prose(51, 90, 3000)} {item}", f"{prose(52, 300_000, 3000)} {item}"]
    out = decontaminate.leaks(documents(spark, texts, ids=[7, 7, None, 8]), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in out) == Counter((d, i) for d in (7, None, 8) for i in (1, 2)) and all(r.lcs == 1.0 for r in out)


def test_lcs_against_table():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 20).tolist()
        t = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(decontaminate.masks_of(a), 12, b) == t[12, 20]
