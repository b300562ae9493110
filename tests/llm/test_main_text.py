"""Main text: the cut against all labellings, pages of known content, and the given pages against their own articles."""

import html
import itertools
import random
import re

from pyspark.sql import functions as F

from tidymesh.llm.main_text import CELLS, CLASSIFIED, blocks_of, content_side, extract_main, fit_costs, main_text
from tidymesh.llm.queries import op12_main_text

LONG = "This sentence has quite a few words in it, as those of an article have."
NEUTRAL = [0] * CELLS


def test_cut_is_the_least_of_all_labellings():
    rng = random.Random(7)
    for _ in range(1500):
        n = rng.randint(0, 8)
        odds = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 5)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(o if o > 0 and not s else -o if o < 0 and s else 0 for o, s in zip(odds, side)) + sum(c for i, j, c in edges if side[i] != side[j])

        every = list(itertools.product([False, True], repeat=n))
        least = min(map(cost, every))
        # of several, the one with the fewest nodes in the content: what all of them have in it
        fewest = [all(x) for x in zip(*(s for s in every if cost(s) == least))] if n else []
        assert content_side(odds, edges) == fewest


def test_cut_of_long_pages():
    assert sum(content_side([5] * 30_000 + [-5] * 30_000, [(i, i + 1, 3) for i in range(59_999)])) == 30_000
    assert sum(content_side([9 if i % 2 else -5 for i in range(20_000)], [(i, i + 1, 3) for i in range(19_999)])) == 19_999  # a gap costs 6 to leave out, the first node 3


def test_pages_that_say_what_is_what():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
    <div id="cookieBanner"><p>We use cookies on this site, as all the others do, and you may agree.</p></div>
    <header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
    <main><article><header><h1>Head &amp; line</h1></header><p>{LONG}<p>One<br>two &#x41; <b>bold</b>&nbsp;end<script>var x="<p>no</p>"</script>.
    <aside><p>{LONG} Aside.</p></aside><div class="ad-slot">{LONG} Buy.</div><ul><li>First <li>Second</ul>
    <form><label>Mail</label><input><select><option>x</select></form><table><tr><td>c1<td>c2</table></article>
    <section class="comments"><h3>Comments</h3><article class="comment"><p>{LONG} I think.</p></article></section></main>
    <div class="related-posts"><p>{LONG} More.</p></div><footer>&copy; us</footer></body></html>"""
    want = ["Head & line", LONG, "One two A bold end.", "First", "Second", "c1", "c2"]
    assert main_text(page, NEUTRAL).split("\n\n") == want


def test_pages_with_names_only():
    page = f"""<body><div class="topbar">Hello there</div><div id="main-content"><h1>Title</h1><div>{LONG}</div><p>Short.</p>
    <div class="share-buttons"><a href=x>Tell</a></div></div><div class="sidebar"><p>{LONG} Side.</p></div><div id="footer"><p>{LONG}</p></div>"""
    assert main_text(page, NEUTRAL) == f"Title\n\n{LONG}\n\nShort."


def test_pages_that_say_nothing_go_by_what_others_teach(spark, sf_dir):
    costs = fit_costs(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert len(costs) == CELLS and max(map(abs, costs)) <= CLASSIFIED
    items = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8))
    page = f"<body><ul>{items}</ul><div><p>{LONG}</p><p>Yes.</p><p>{LONG} {LONG}</p></div><ul>{items}</ul></body>"
    # between two long paragraphs a short one stays with them
    assert main_text(page, costs) == f"{LONG}\n\nYes.\n\n{LONG} {LONG}"


def test_broken_pages():
    assert main_text(None, NEUTRAL) == main_text("", NEUTRAL) == main_text("<p", NEUTRAL) == main_text("<!-- <article>x</article>", NEUTRAL) == ""
    assert main_text("<article><p>a < b &am &amp c", NEUTRAL) == "a < b &am & c"
    assert main_text("</div></p><article>x</span></article></article>y<script>z", NEUTRAL) == "x"
    assert [b.text for b in blocks_of("a<!-- b -->c<td>d")] == ["ac", "d"]
    assert main_text("<article>" + "<div>" * 20_000 + "deep" + "</div>" * 20_000, NEUTRAL) == "deep"
    assert main_text("<article>" + "<p>word" * 20_000, NEUTRAL).count("\n\n") == 19_999
    for s in ("<" * 100_000, '<a "' * 50_001, "<!--" * 50_000, "&" * 100_000, "</div>" * 50_000):
        main_text(s, NEUTRAL)


def test_tables(spark):
    rows = [(1, "u", "<article><p>é😀 x</p></article>", 7), (1, "u", "<article><p>é😀 x</p></article>", 7), (2, None, None, None), (None, "v", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").withColumn("text", F.lit("clash")).withColumn("__main", F.lit(1))
    costs = fit_costs(pages)
    got = extract_main(pages, costs)
    assert sorted(got.columns) == sorted(["page_id", "url", "html", "__main", "text", "n_chars"])
    told = sorted(((r.page_id, r.text, r.n_chars) for r in got.collect()), key=str)
    assert told == sorted([(1, "é😀 x", 4), (1, "é😀 x", 4), (2, "", 0), (None, "", 0)], key=str)
    assert extract_main(pages.limit(0), fit_costs(pages.limit(0))).count() == 0


def test_query(spark, sf_dir):
    """All pages of the table hold one article, whose blocks a few patterns tell."""
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        want[r.page_id] = (r.url, "\n\n".join(p for p in parts if p))
    got = op12_main_text(spark, sf_dir).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)
