"""Main text of pages: parsing, alignment and differencing."""

from __future__ import annotations

import os
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ovenplan.llm import pages

SCHEMA = "page_id long, url string, html string, text int, _host int"


def texts(html):
    return [t for t, _ in pages.blocks(html)]


def test_blocks():
    html = (
        "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><!-- <p>no</p> -->"
        "<script>var a='</p><p>no';</script><article><h1>T &amp; U</h1><p>one\n  <b>two<br>three</b> &#233;&nbsp;x<p>four</article>"
        "<div class='ad'>buy <div>now</div></div><footer>&copy;</footer></body></html>"
    )
    kept = [t for t, zone in pages.blocks(html) if zone == pages.ARTICLE]
    assert kept == ["T & U", "one two three é x", "four"]
    assert all(zone == pages.OUT for t, zone in pages.blocks(html) if t in ("menu", "buy", "now", "©"))
    assert "no" not in texts(html)


def test_broken_markup():
    assert texts(None) == texts("") == texts("   ") == []
    assert texts("a < b <p>c") == ["a < b", "c"]
    assert texts('<p title="x > y">z</p') == ["z"] or texts('<p title="x > y">z</p')[0].startswith("z")
    assert texts("<script>never closed <p>x") == []
    assert texts("<p class=comment>no<p>yes") == ["no", "yes"]
    assert [t for t, z in pages.blocks("<article><p>a<aside><p>b</aside><p>c</article>") if z == pages.ARTICLE] == ["a", "c"]


def longest(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14), st.sampled_from([4, 1 << 28]))
def test_alignment_is_longest(a, b, cells):
    before, pages.CELLS = pages.CELLS, cells
    try:
        found = pages.shared_places(a, b)
    finally:
        pages.CELLS = before
    assert len(found) == longest(a, b) and found == sorted(set(found))
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in (a[i] for i in found))


def test_long_alignment():
    rng = random.Random(1)
    a = [rng.randrange(50) for _ in range(3000)]
    b = [x for x in a if rng.random() < 0.9]
    assert len(pages.shared_places(a, b)) == len(b)


def page(host, path, own, shared=("Home", "Imprint of the site")):
    body = "".join(f"<div>{x}</div>" for x in (shared[0], *own, shared[1]))
    return f"http://{host}{path}", f"<body>{body}</body>"


def test_unmarked_pages_lose_what_their_neighbour_repeats(spark):
    found = [page("a.example.org", f"/en/{k}", [f"story {k} {j}" for j in range(6)]) for k in range(5)]
    found += [page("A.example.org", "/en/1?x=2", [f"story 1 {j}" for j in range(6)])]  # the same article at another address
    found += [page("b.example.org", "/1", ["alone"]), (None, "<p>no address</p>"), ("http://c.example.org/", None), ("c:", "")]
    rows = [(i, u, h, 1, 2) for i, (u, h) in enumerate(found)] + [(0, *found[0], 1, 2)]
    got = pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in got}
    for k in range(5):
        assert by_id[k] == "\n".join(f"story {k} {j}" for j in range(6))
    assert by_id[5] == by_id[1]
    assert by_id[6] == "Home\nalone\nImprint of the site"  # no neighbour to compare with
    assert (by_id[7], by_id[8], by_id[9]) == ("no address", "", "")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert got[0].asDict().keys() == {"page_id", "url", "_host", "text", "n_chars", "n_shared", "n_marked", "n_kept"}


def test_articles_keep_lines_that_neighbours_share(spark):
    marked = "<body><nav>menu</nav><article><p>a passage that both quote</p><p>own {}</p></article></body>"
    rows = [(k, f"http://a.example.org/{k}", marked.format(k), 0, 0) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: f"a passage that both quote\nown {k}" for k in range(3)}
    assert pages.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def found_texts(spark, pages_):
    rows = [(k, u, h, 0, 0) for k, (u, h) in enumerate(pages_)]
    return {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_differencing_decides_beside_article_marks(spark):
    html = "<body><div>Site</div><div>the story of {0} in a div</div><article>teaser {0}</article><article><p>we use all your data</p></article></body>"
    got = found_texts(spark, [(f"http://a.example.org/{k}", html.format(f"page {k}")) for k in range(6)])
    assert got == {k: f"the story of page {k} in a div\nteaser page {k}" for k in range(6)}
    alone = "<body><div>Site</div><article>a long enough story</article></body>"
    assert found_texts(spark, [("http://b.example.org/1", alone)]) == {0: "a long enough story"}


def test_copies_in_a_row_and_long_menus(spark):
    menu = "".join(f"<li>entry {k}</li>" for k in range(40))
    html = "<body><nav>" + menu + "</nav><div>Site line</div><p>{} one</p><p>two {}</p></body>"
    pages_ = [(f"http://a.example.org/{k}", html.format(k, k)) for k in "abc"]
    assert found_texts(spark, pages_) == {k: f"{x} one\ntwo {x}" for k, x in enumerate("abc")}
    story = "<body><div>Site line</div><p>the only story {0} that all of these repeat at length</p><p>seen {1}</p></body>"
    equal = [(f"http://b.example.org/x{k}", story.format("x", 1)) for k in range(3)]
    close = [(f"http://b.example.org/y{k}", story.format("y", k + 5)) for k in range(4)]
    got = found_texts(spark, [*equal, *close])
    assert {got[k] for k in range(3)} == {"the only story x that all of these repeat at length\nseen 1"}
    assert [got[k] for k in range(3, 7)] == [f"the only story y that all of these repeat at length\nseen {k + 5}" for k in range(4)]


def plain_text(pages_):
    """The method without Spark: pages of a host in order of address, nearest different page, blocks of a host counted."""
    addresses = [re.match(r"http://([^/]*)(.*)", u).groups() for u, _ in pages_]
    parsed = [pages.blocks(h) for _, h in pages_]
    texts_ = {}
    for host in {h for h, _ in addresses}:
        first = {}
        for at in sorted((k for k, (h, _) in enumerate(addresses) if h == host), key=lambda k: (addresses[k][1], str(k))):
            first.setdefault(tuple(parsed[at]), (at, addresses[at][1]))
        order = sorted(first.values(), key=lambda x: (x[1], str(x[0])))
        lines = [[t for t, _ in parsed[at]] for at, _ in order]
        for n, (at, path) in enumerate(order):
            found = parsed[at]
            open_ = [i for i, (_, zone) in enumerate(found) if zone != pages.OUT]
            whole = sum(len(found[i][0]) for i in open_)
            gone = None
            for m in sorted((m for m in (n - 1, n + 1) if 0 <= m < len(order)), key=lambda m: -len(os.path.commonprefix([path, order[m][1]]))):
                covered = set(pages.shared_places(lines[n], lines[m]))
                if sum(len(found[i][0]) for i in open_ if i in covered) < 0.8 * whole:
                    gone = covered
                    break
            assert gone is not None, "pages of this test have a neighbour that is no copy"

            def notice(text):
                count = sum(text in x for x in lines)
                return count >= 5 and 2 * count > len(lines)

            kept = [t for i, (t, zone) in enumerate(found) if zone != pages.OUT and (i not in gone or zone == pages.ARTICLE and not notice(t))]
            texts_[tuple(found), host] = "\n".join(kept)
    return {k: texts_[tuple(parsed[k]), addresses[k][0]] for k in range(len(pages_))}


def test_main_text_matches_brute_force(spark, monkeypatch):
    """A host with most of the pages, short stretches, notices inside articles, passages that two articles quote."""
    monkeypatch.setattr(pages, "STRETCH", 4)
    monkeypatch.setattr(pages, "GROUP", 3)
    rng = random.Random(5)
    found = []
    for k in range(160):
        host = "big.example.org" if rng.random() < 0.7 else f"h{rng.randrange(3)}.example.org"
        own = [" ".join(rng.choices("abcdefgh", k=30)) + f" {k} {j}" for j in range(4)]
        notice = "<p>we use your data</p>" if rng.random() < 0.8 else ""
        quote = f"<p>quoted {rng.randrange(6)}</p>"
        side = f"<div>side {rng.randrange(3)}</div><div>own side {k}</div>"
        body = f"<nav>menu {host}</nav>{side}<article>{notice}" + "".join(f"<p>{x}</p>" for x in own) + f"{quote}</article><footer>f</footer>"
        found.append((f"http://{host}/{rng.choice('xyz')}/{rng.randrange(1000)}", f"<body>{body}</body>"))
    found += [(u + "/again", h) for u, h in found[:9]]
    rows = [(k, u, h, 0, 0) for k, (u, h) in enumerate(found)]
    got = pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["page_id"]: r["text"] for r in got} == plain_text(found)
    parsed = [pages.blocks(h) for _, h in found]
    assert all(r["n_shared"] + r["n_marked"] + r["n_kept"] == len(parsed[r["page_id"]]) for r in got)
    # Menus and footers that the neighbour has too go by the alignment, not by their tags.
    assert sum(r["n_marked"] for r in got) < sum(r["n_shared"] for r in got) / 10


def test_class_words_never_drop_the_article():
    def kept(html):
        return [t for t, zone in pages.blocks(html) if zone != pages.OUT]

    for word in ("content has-sidebar", "search-page", "social-science", "no-comments", "notice-board", "search", "site sidebar"):
        assert kept(f'<div class="{word}"><article><p>the story</article></div>') == ["the story"], word
        assert kept(f'<div class="{word}"><p>the whole of the story</div><p>more') == ["the whole of the story", "more"], word
    assert kept('<div id="comments"><article class="comment">first!</article></div><main>the story</main>') == ["the story"]
    assert kept('<p>the story as it is<div class="ad-box">buy</div><div class="top sidebar">menu</div>') == ["the story as it is"]
    assert kept('<div class="search"><div class="menu">entries of the menu</div><main>the story</main></div>') == ["the story"]
