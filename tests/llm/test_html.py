import html
import random
import re

import llm_cases as C
import pyarrow as pa
import pytest
from dhvani.llm import dom, html_main

SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("text", pa.string()), ("n_chars", pa.string())])


def article(page: str) -> str:
    """Blocks between the tags of the article of a generated page."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


def test_driver_pages(spark):
    pages = {r["page_id"]: r["html"] for r in C.read("pages", "/root/testdata/sf0.01")}
    got = html_main.op5_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: article(h) for k, h in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.fixture(scope="module")
def forest(spark):
    return html_main.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_other_dresses(forest):
    """Pages of other names and with other parts, none of them seen in training."""
    r, blocks, missed, extra = random.Random(11), 0, 0, 0
    for row in C.read("pages", "/root/testdata/sf0.1")[1500:1700]:
        source = html_main.rewritten(row["html"], r)
        page = dom.Page(source)
        want = page.text(html_main.labels(page) == 1).split("\n\n")
        got = html_main.extract([re.sub(r" data-y=\w", "", source)], forest)[0].split("\n\n")
        blocks, missed, extra = blocks + len(want), missed + len(set(want) - set(got)), extra + len(set(got) - set(want))
    assert missed <= 0.02 * blocks and extra <= 0.02 * blocks


def test_no_contradictions(forest):
    for row in C.read("pages")[:20]:
        page = dom.Page(row["html"])
        kept = html_main.decode(page, forest.log_odds(dom.matrix([page])))
        for i in range(1, len(kept)):
            up = page.parent[i]
            if kept[i] and not kept[up]:  # above the first kept node nothing is kept
                while up >= 0:
                    assert not kept[up]
                    up = page.parent[up]


def test_reader():
    p = dom.Page("<body><p>One &amp; <b>two<br>three<p>four<ul><li>a<li>b</ul><!-- no --><script>if (a<b) '</p>'</script>"
                 "<style>x</style><table><tr><td>c<td>d</table>e &lt;f&gt; <i>g")
    assert p.text([True] * len(p.parent)).split("\n\n") == ["One & two three", "four", "a", "b", "c", "d", "e <f> g"]
    for broken in ("", "<", "<p", "</p></div>", "<p><div></p>x", "<!--", "<script>", "a<b c='", "<a href=\"x>y", "<p>" * 3000, "&#xD800; &bogus;"):
        p = dom.Page(broken)
        assert len(p.end) == len(p.parent) == len(dom.matrix([p]))
        p.text(html_main.decode(p, html_main.lexicon_odds(p)))


def test_cases(spark, tmp_path):
    long = "<article>" + "".join(f"<p>paragraph {k} of a long page, with some words.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>x"), (3, "w", long), (3, "w", long), (4, "t", "  \n "), (5, "s", "plain")]
    d = C.write(str(tmp_path), pages=([{"page_id": i, "url": u, "html": h} for i, u, h in rows], SCHEMA))
    got = html_main.op5_html_extraction(spark, d).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "") for r in got) == sorted((i or 0, u or "") for i, u, _ in rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == text[4] == "" and text[3].count("\n\n") == 19_999
    assert html_main.op5_html_extraction(spark, C.write(str(tmp_path), pages=([], SCHEMA))).count() == 0


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>t</title><meta charset=x><body><p>a</p>", ["a"]),
    ("<head><title>t</title><link rel=x><script>if (a<b) x</script><p>a<p>b", ["a", "b"]),
    ("<head><title>t</title><style>s</style><noscript><p>no</noscript></head><p>a", ["a"]),
    ("<head><title>t<body><p>a", ["a"]),
    ("<header>h</header><head><div>d</div><title>t</title></head><p>a", ["h", "d", "a"]),
    ("<p>a<svg width=1 /> b</p><p>c <math/> d</p><svg><text>no</text></svg><p>e", ["a b", "c d", "e"]),
    ("<svg><path d=x><p>a</p><svg><circle></svg><p>b", ["a", "b"]),
    ("<svg><foreignObject><p>no</p></foreignObject></svg><p>b", ["b"]),
    ("<object data=x><p>a</p><p>b", ["a", "b"]), ("<select><option>o<p>a", ["o", "a"]), ("<p>a</p><noscript><p>b", ["a", "b"]),
    ("<p>a</p><template><p>b", ["a", "b"]), ("<p>a</p><math><mi>x</mi>", ["a", "x"]),
    ("<p>a</p><script>b", ["a"]), ("<p>a</p><style>b<p>c", ["a"]), ("<p>a</p><textarea>b<p>c", ["a"]), ("<p>a</p><iframe>b<p>c", ["a"]),
    ("<object><p>no</p></object><select><option>no</select><p>a", ["a"]),
])
def test_elements_without_an_end(source, want):
    p = dom.Page(source)
    assert p.text([True] * len(p.parent)).split("\n\n") == want


def test_elements_without_an_end_are_read_in_linear_time():
    import time

    for source in ("<select>a" * 40_000, "<svg>a" * 40_000, "<svg><text>" * 40_000 + "</svg>", "<svg/><math/>" * 40_000):
        start = time.process_time()
        dom.Page(source)
        assert time.process_time() - start < 10


WORDS = "The committee met on Tuesday to discuss the new bridge, which has been closed since spring. Members heard from engineers and residents."
PARA = f"<p>{WORDS}</p>"
#: What stands between two paragraphs of an article, and its blocks.
SHAPES = [
    ("", []),
    ('<p>See <a href="/r">the full report</a> of the committee.</p>', ["See the full report of the committee."]),
    ('<p><a href="/r">Read the full report of the committee here</a></p>', ["Read the full report of the committee here"]),
    ("<ul><li>closed since spring</li><li>engineers were heard</li></ul>", ["closed since spring", "engineers were heard"]),
    ("<ol><li>Mix the flour with water.</li><li>Bake for an hour.</li></ol>", ["Mix the flour with water.", "Bake for an hour."]),
    ('<ul><li>by <a href="#">the engineers</a> in May</li><li>by residents</li></ul>', ["by the engineers in May", "by residents"]),
    ("<blockquote>We can not wait for another year, the mayor said.</blockquote>", ["We can not wait for another year, the mayor said."]),
    ("<blockquote><p>We can not wait for another year.</p></blockquote>", ["We can not wait for another year."]),
    ("<table><tr><th>Year</th><th>Cost</th></tr><tr><td>2019</td><td>two million</td></tr></table>", ["Year", "Cost", "2019", "two million"]),
    ("<table><tbody><tr><td>steel</td><td>40 tons</td></tr></tbody></table>", ["steel", "40 tons"]),
    ("<pre>for x in rows: print(x)</pre>", ["for x in rows: print(x)"]),
    ("<pre><code>select a from b</code></pre>", ["select a from b"]),
    ('<figure><img src="b.png"><figcaption>The bridge in spring</figcaption></figure>', ["The bridge in spring"]),
    ("<h2>What comes next</h2>", ["What comes next"]),
    ("<section><h3>Costs</h3><p>The work costs two million a year.</p></section>", ["Costs", "The work costs two million a year."]),
    ("<div>A line that stands in no paragraph, but in a division.</div>", ["A line that stands in no paragraph, but in a division."]),
    ("<dl><dt>span</dt><dd>the part between two piers</dd></dl>", ["span", "the part between two piers"]),
    ("<p>Yes.</p>", ["Yes."]),
]
LAYOUTS = [
    '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article>{}</article><footer><p>All rights reserved</p></footer></body>',
    '<body><div class="navbar"><a href="/">Home</a> <a href="/n">News</a></div><div class="content">{}</div>'
    '<div class="sidebar"><h3>Popular</h3><ul><li><a href="/a">Ten facts</a></li><li><a href="/b">The weather</a></li></ul></div>'
    '<div class="footer"><p>All rights reserved</p></div></body>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("part, blocks", SHAPES)
def test_whole_articles(forest, part, blocks, layout):
    """Written by hand: whatever stands in an article is kept, and nothing else."""
    body = "<h1>The bridge stays closed</h1>" + PARA * 3 + part + PARA * 3
    got = html_main.extract([layout.format(body)], forest)[0].split("\n\n")
    assert got == ["The bridge stays closed"] + [WORDS] * 3 + blocks + [WORDS] * 3


def test_best_assignment_of_small_trees():
    """``decode`` against all assignments that don't contradict themselves."""
    import itertools

    import numpy as np

    r = random.Random(3)
    for _ in range(60):
        source, depth = "", []
        for _ in range(r.randint(1, 6)):
            if depth and r.random() < 0.4:
                source += depth.pop()
            source += "<div>" + "word " * r.randint(0, 9)
            depth.append("</div>")
        page = dom.Page(source)
        n = len(page.parent)
        odds = np.array([r.gauss(0, 3) for _ in range(n)])
        weight = 0.3 + np.sqrt(np.array(page.chars, float))
        cost = {0: -np.logaddexp(0, odds) * weight, 1: -np.logaddexp(0, -odds) * weight}

        def total(state):
            out = cost[0][0]
            for i in range(1, n):
                a, b = state[page.parent[i]], state[i]
                if (a, b) in ((1, 0), (2, 0), (2, 1)):
                    return -np.inf
                out += cost[int(b == 1)][i] - {(0, 1): html_main.ENTER, (1, 2): html_main.LEAVE}.get((a, b), 0)
            return out
        best = max(total((0, *s)) for s in itertools.product((0, 1, 2), repeat=n - 1))
        kept = html_main.decode(page, odds)
        same = [s for s in itertools.product((0, 1, 2), repeat=n - 1) if [x == 1 for x in s] == list(kept[1:])]
        assert max(total((0, *s)) for s in same) == pytest.approx(best)
