import random

import pytest
from pyspark.sql import functions as F

from innkeep.llm.html_lines import Line, between_surge_and_dive, extract, main_text

SENTENCE = "This long sentence stands for a paragraph of the article with a good number of words."

CASES = {
    "template": ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li>"
                 "<a href='/x'>x</a></ul></nav><!-- ad --><div class=ad>Buy.</div><article><h1>Head</h1><p><b>Be.<br><p>A &amp; B&nbsp; c\n d"
                 "</article><footer>&copy; me</footer></body></html>", "Head\nBe.\nA & B c d"),
    "cut off": ("<article><p>One.</p><p>Two<span cla", "One.\nTwo"),
    "sidebar and comments": (f"<header><h1>Site</h1></header><main><p>{SENTENCE}</p><aside>More</aside><form>Mail <input></form><p>Short.</p>"
                             f"<section id='comments'><article><p>{SENTENCE} A reader.</p></article></section></main><footer>f</footer>", f"{SENTENCE}\nShort."),
    "notice inside": ("<article><header><h1>Kept head</h1></header><div class='cookie-notice'>We use cookies</div><p>Text</p>"
                      "<p class='sponsored'>Ad<p>Last</article>", "Kept head\nText\nLast"),
    "wrapper with a bad name": ("<div class='with-sidebar'><div class='has-menu'><article class='post has-comments'><p>In</p></article></div></div>", "In"),
    "dropped wrapper around": ("<div class='widget'><article><p>In</p></article></div>", "In"),
    "not marked": (f"<div><a href=/a>Home</a> <a href=/b>News</a></div><div>{SENTENCE}</div><div>Short.</div><div>{SENTENCE}</div>"
                   "<ul><li><a href=/a>One link</a></li><li><a href=/b>Two link</a></li></ul><div>Tiny.</div>", f"{SENTENCE}\nShort.\n{SENTENCE}\nTiny."),
    "far tail": (f"<p>{SENTENCE}</p>" + "<p><a href=/>l</a></p>" * 4 + "<p>Tail.</p>", SENTENCE),
    "attributes": ("<article><p title=\"a > b\">x</p><p data-a='\">'>y</p><p hidden>h</p><p style='display: none'>n</p></article>", "x\ny"),
    "references": ("<article><p>&lt;b&gt; &#65;&#x42; &eacute; &amp;lt; &unknown;</p></article>", "<b> AB é &lt; &unknown;"),
    "table": ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></article>", "a b\nc"),
    "nothing": ("<html><nav>x</nav></html>", ""),
    "no markup": ("only a few words", ""),
    "unclosed script": ("<article><p>x</p><script>var a", "x"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_rows(spark):
    rows = [(1, "u", CASES["template"][0]), (2, None, None), (3, "u", ""), (None, "u", "<article>" + "<p>word</p>" * 50_000),
            (1, "u", CASES["template"][0]), (5, "u", "<div " * 50_000 + "</span>" * 50_000 + "<" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = {r.page_id: r for r in extract(pages).collect()}
    assert extract(pages).count() == len(rows) and extract(pages.limit(0)).count() == 0
    assert got[1].text == CASES["template"][1] and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[2].url) == ("", 0, None) and got[3].text == ""
    assert got[None].n_chars == 5 * 50_000 - 1


def test_all_pages_keep_their_article(spark):
    import html
    import re
    for r in extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(
            spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", inner.replace("<br>", " "))]
        assert r.text == "\n".join(p for p in parts if p)


def test_windows_decide_on_pages_with_an_article():
    teaser = "<article><h2><a href=/t>Teaser</a></h2><p>Short teaser.</p></article>"
    body = f"<div class=content><p>{SENTENCE}</p><p>Short.</p><p>{SENTENCE} More.</p></div>"
    far = "<div><a href=/>l</a></div>" * 4
    assert main_text(teaser + far + body) == f"Teaser\nShort teaser.\n{SENTENCE}\nShort.\n{SENTENCE} More."
    assert main_text(teaser + far + "<div>Tiny.</div>") == "Teaser\nShort teaser."          # no surge outside
    links = "<ul><li><a href=/a>One link</a></li><li><a href=/b>Two link</a></li></ul>"
    assert main_text(f"<article><p>{SENTENCE}</p>{links}<p>Short.</p></article>") == f"{SENTENCE}\nShort."


def test_every_line_between_surge_and_dive():
    page = f"<div>{SENTENCE}</div><h2><a href=/h>A linked head</a></h2><div>{SENTENCE}</div><div><a href=/n>next</a></div>"
    assert main_text(page) == f"{SENTENCE}\nA linked head\n{SENTENCE}"


def test_page_in_a_form():
    controls = "<label>Your name</label><input><select><option>One</select><button>Send</button>"
    for name in ("form", "fieldset", "object", "map", "div role=form"):
        end = f"</{name.split()[0]}>"
        assert main_text(f"<{name}>{controls}<article><h1>Head</h1><p>{SENTENCE}</p></article>{controls}{end}") == f"Head\n{SENTENCE}"
        assert main_text(f"<{name}><div>{SENTENCE}</div>{controls}<div>Short.</div>{end}") == f"{SENTENCE}\nShort."
        assert main_text(f"<main><{name}><p>{SENTENCE}</p>{controls}{end}</main>") == SENTENCE
        assert main_text(f"<article><p>{SENTENCE}</p><{name}>Mail {controls}{end}<p>Last</p></article>") == f"{SENTENCE}\nLast"
    assert main_text(f"<article><p>T</p></article><form><article><p>{SENTENCE}</p></article></form>") == f"T\n{SENTENCE}"
    assert main_text(f"<form class=login><p>{SENTENCE}</p></form>") == ""


def test_unmarked_lines_beside_an_article():
    before, after = "<div>Site Name Weekly</div><div>Your daily source</div>", "<div>Copyright 2024 Site Name Weekly, all rights reserved</div><div>Contact us by mail</div>"
    assert main_text(f"{before}<article><p>{SENTENCE}</p><p>Short.</p></article>{after}") == f"{SENTENCE}\nShort."
    assert main_text(f"{before}<main><p>Short.</p></main>{after}") == "Short."
    assert main_text(f"<article><p>Teaser.</p></article><div>Tiny</div><div>{SENTENCE}</div><div>Short.</div><div>{SENTENCE}</div><div>Tiny</div>") \
        == f"Teaser.\n{SENTENCE}\nShort.\n{SENTENCE}"
    assert main_text(f"<div>{SENTENCE}</div>{after}").startswith(SENTENCE)


def test_words_in_compound_classes():
    body = f"<p>{SENTENCE}</p>"
    for name in ("discussion-paper", "social-science-body", "commentary", "alertness", "shared-memory", "menuhin", "replyto-study", "ad-hoc-networks", "sponsored-research-story"):
        assert main_text(f"<div class='{name}'>{body}</div>") == SENTENCE, name
        assert main_text(f"<article><div class='{name}'><p>One.</p></div></article>") == "One.", name
        assert main_text(f"<div id='{name}'><article>{body}</article></div>") == SENTENCE, name
    for name in ("comments", "comment-list", "post-comments", "commentList", "sidebar-left", "ad-slot-300x250", "cookieBanner", "site-footer", "related-articles", "share-buttons", "newsletter-signup-form"):
        assert main_text(f"<article>{body}<div class='x {name}'><p>One.</p></div></article>") == SENTENCE, name


def plain_rule(lines, window=3, surge=60):
    """The rule of the module, read line by line."""
    lines = [x for x in lines if x.text]
    n = len(lines)
    listed = [not x.weight and any(0 <= j < n and not lines[j].weight for j in (i - 1, i + 1)) for i, x in enumerate(lines)]
    weight = [0 if listed[i] else (surge + (x.weight or len(x.text)) if x.marked else x.weight) for i, x in enumerate(lines)]
    together = lambda i, j: all(lines[k].marked == lines[i].marked for k in range(i, j + 1))
    total = [sum(weight[j] for j in range(max(0, i - window + 1), i + 1) if together(j, i)) for i in range(n)]

    def block(i):
        """The lines around i whose windows are not empty, in its stretch."""
        a = b = i
        while a > 0 and total[a - 1] and together(a - 1, i):
            a -= 1
        while b + 1 < n and total[b + 1] and together(i, b + 1):
            b += 1
        return range(a, b + 1)

    surges = [bool(total[i]) and max(total[j] for j in block(i)) >= surge for i in range(n)]
    beside = any(surges[i] and lines[i].marked for i in range(n))
    out = []
    for i, x in enumerate(lines):
        least = surge if beside and not x.marked else 1
        if surges[i] and not listed[i] and any(weight[j] >= least for j in block(i) if j <= i) and any(weight[j] >= least for j in block(i) if j >= i):
            out.append(x.text)
    return out


def test_blocks_against_the_plain_rule():
    rng = random.Random(8)
    for _ in range(3000):
        marked, lines = False, []
        for i in range(rng.randint(0, 14)):
            marked ^= rng.random() < 0.2
            lines.append(Line(rng.choice(["", f"t{i}", f"text{i}"]), rng.choice([0, 0, 0, 5, 20, 59, 60, 100]), marked))
        assert between_surge_and_dive(lines) == plain_rule(lines), lines


def test_all_pages_of_the_table_are_as_by_the_plain_rule(spark):
    from innkeep.llm import queries
    from innkeep.llm.html_lines import page_lines
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.QUERIES["op1_line_blocks"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: "\n".join(plain_rule(page_lines(h))) for i, h in pages.items()}
