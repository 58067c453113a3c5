"""Main text of pages that no article tag decides, by hand."""

import math
import time

from tidelog.llm import pages


def long(mark: str, n: int = 5) -> str:
    return "".join(f"<p>{mark}{k} " + "words of a long paragraph " * 8 + "</p>" for k in range(n))


def marks(html: str) -> list[str]:
    return [w for w in pages.main_text(html).split() if w[0].isupper()]


def test_article_tags_decide_nothing():
    story = [f"S{k}" for k in range(5)]
    teaser = "<article><p>Read also</p></article>"
    assert marks(f"<body><div>{long('S')}</div>{teaser}</body>") == story
    assert marks(f"<body>{teaser}<div>{long('S')}</div></body>") == story
    assert marks(f"<body><section>{long('S')}</section></body>") == story


def test_all_that_reaches_the_threshold():
    both = [f"{m}{k}" for m in "AB" for k in range(5)]
    for tag in ("div", "article", "section"):
        assert marks(f"<body><{tag}>{long('A')}</{tag}><{tag}>{long('B')}</{tag}><p>By J. Doe</p></body>") == both
    low = "<ul>" + "<li>x</li>" * 40 + "</ul>"
    assert marks(f"<body><div>{long('A')}</div><div>{low}<div>{long('B')}</div></div></body>") == both
    loose = "L0 <i>loose</i> " + "text of the body " * 90
    assert marks(f"<body><div>{long('A')}</div>{loose}</body>") == both[:5] + ["L0"]


def test_links_inside_the_content_stay():
    sources = "<ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li></ul>"
    cell = "<table><tr><td><a href=a>Cell</a> <a href=b>Other</a></td></tr></table>"
    links = ["Source", "Source", "Cell", "Other"]
    a = [f"A{k}" for k in range(5)]
    assert marks(f"<body><div>{sources}</div><div>{long('A')}{sources}{cell}</div></body>") == a + links
    assert marks(f"<body><article><div>{long('A')}</div>{sources}{cell}</article></body>") == a + links
    assert marks(f"<body><div>{long('A')}{sources.replace('<ul', '<ul class=menu')}<nav>{sources}</nav></div></body>") == a
    assert marks(f"<body>{sources}{long('A')}</body>") == a


def test_end_tags_take_constant_time():
    k = 100_000
    for html in ("<b>" * k + "x</i>" * k, "<i><div>" + "<b>" * k + "x</i>" * k, "<div>" * k + "x" + "</div>" * k, "<ul><li>" * k + "x"):
        began = time.time()
        assert pages.main_text(html)
        assert time.time() - began < 30


def brute_density(n: pages.Node, share: float) -> float:
    chars, tags, link_chars, link_tags = 0, 0, 0, 0

    def walk(x, in_link):
        nonlocal chars, tags, link_chars, link_tags
        for y in x.parts:
            if isinstance(y, str):
                size = sum(not c.isspace() for c in y)
                chars += size
                link_chars += size if in_link else 0
            elif y.keep:
                tags += 1
                link_tags += y.tag == "a"
                walk(y, in_link or y.tag == "a")

    walk(n, n.tag == "a")
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    # the logarithm's base is a logarithm itself
    return chars / t * math.log(max(math.e, chars / lc * t / lt)) / math.log(max(math.e, base))


def test_density_against_brute_force():
    html = f"<body><div id=x>{long('A', 3)}<p>see <a href=a>here <b>now</b></a></p></div><ul><li><a href=b>One</a></li></ul><section><div>{long('B', 2)}</div>tail</section></body>"
    tree = pages.Tree()
    tree.feed(html)
    order = pages.measure(tree.root)
    pages.densities(order, tree.root)
    share = tree.root.lc / tree.root.c
    for n in order:
        assert abs(n.density - brute_density(n, share)) < 1e-9
        assert abs(n.total - sum(brute_density(x, share) for x in n.parts if isinstance(x, pages.Node) and x.keep)) < 1e-9


def test_density_decides_without_names_or_landmarks(monkeypatch):
    links = "".join(f"<li><a href=/{k}>Link{k}</a> go</li>" for k in range(12))
    html = f"<body><div class=a><ul>{links}</ul><p>Tiny</p></div><div class=b>{long('S')}</div><div class=c><i>Note</i><i>Other</i><b>More</b></div></body>"
    story = [f"S{k}" for k in range(5)]
    assert marks(html) == story
    monkeypatch.setattr(pages, "density_of", lambda *_: 1.0)
    assert marks(html) != story


def test_empty_and_repeated_pages(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{long('A')}</p>"), (1, "u", f"<p>{long('A')}</p>"), (None, None, "<p>x")], "page_id long, url string, html string")
    out = pages.extract(df).collect()
    assert len(out) == 3 and out[0] == out[1] and out[2].text == "x"
    assert pages.extract(df.limit(0)).count() == 0
