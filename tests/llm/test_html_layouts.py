"""The shipped labeller on layouts written by hand: none of them comes from make_page.

In a layout a line that starts with + belongs to the article; its text must come out whole.
"""

import re

import numpy as np
import pytest

from lightfold.llm import html

LONG = "The river had risen for three days before anybody in the village thought of moving the boats, and by then the lower meadow was under water."
MORE = "Older people remembered a flood of that kind, but nobody could say whether it had come in spring or in the autumn after the long drought."
END = "When the water fell at last, the bridge was still there."
TOP = '<header><div class="logo">Valley Post</div></header><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
BOTTOM = '<footer><p>© 2023 Valley Post. All rights reserved.</p><a href="/p">Privacy</a> <a href="/i">Imprint</a></footer>'


def article(x, home="article", close=None):
    return f"<html><head><title>t</title></head><body>{TOP}<{home}><h1>A flood in the valley</h1><p>{LONG}</p>{x}<p>{MORE}</p><p>{END}</p></{close or home.split()[0]}>{BOTTOM}</body></html>"


BASE = ["A flood in the valley", LONG, MORE, END]
INSERTS = {
    "table of one row": ("<table><tr><td>1921</td><td>2.4 m</td></tr></table>", ["1921", "2.4 m"]),
    "table": ("<table><thead><tr><th>Year</th><th>Level</th></tr></thead><tbody><tr><td>1921</td><td>2.4 m</td></tr><tr><td>1954</td><td>3.1 m</td></tr></tbody></table>", ["Year", "Level", "1921", "2.4 m", "1954", "3.1 m"]),
    "code": ("<pre>level = gauge.read()\nif level > 3:\n    warn()</pre>", ["level = gauge.read() if level > 3: warn()"]),
    "code in pre": ("<pre><code>make flood\n./run --level 3</code></pre>", ["make flood ./run --level 3"]),
    "short list": ("<ul><li>one</li><li>two</li></ul>", ["one", "two"]),
    "long list": ("<ol><li>Move the boats to the upper shore before dusk.</li><li>Carry the seed corn into the loft.</li><li>Open the sluice at the mill.</li></ol>", ["Move the boats to the upper shore before dusk.", "Carry the seed corn into the loft.", "Open the sluice at the mill."]),
    "figure": ('<figure><img src="a.png"><figcaption>The bridge in May, seen from the mill.</figcaption></figure>', ["The bridge in May, seen from the mill."]),
    "terms": ("<dl><dt>Gauge</dt><dd>A marked post in the stream.</dd><dt>Weir</dt><dd>A low wall across it.</dd></dl>", ["Gauge", "A marked post in the stream.", "Weir", "A low wall across it."]),
    "section": (f"<section><h2>What was lost</h2><p>{MORE[:70]}</p></section>", ["What was lost", MORE[:70]]),
    "quotation": ("<blockquote><p>It came up the stairs like a guest, said the miller.</p></blockquote>", ["It came up the stairs like a guest, said the miller."]),
    "drawing": ("<p>See <svg><text>Axis</text></svg> fig.</p>", ["See Axis fig."]),
    "comments": ('<div class="comments"><p>Anna says: great article, thanks!</p><p>Reply</p></div>', []),
    "advert": ('<div class="advert"><p>Special offer, only today: buy now!</p></div>', []),
    "newsletter": ('<form class="newsletter"><p>Subscribe to our newsletter</p><label>Your email address</label></form>', []),
    "related": ('<aside class="related"><h3>Related posts</h3><ul><li><a href="/a">A dry summer</a></li><li><a href="/b">New mill opened</a></li></ul></aside>', []),
}
HOMES = ["article", "main", 'div class="post-content"', "div id=content"]


@pytest.fixture(scope="module")
def model():
    return html.load()


def recall(found, kept):
    """(article blocks kept, article blocks, other blocks kept)"""
    want = [re.sub(r"\s+", " ", t) for t in found]
    left = list(kept)
    hit = 0
    for t in want:
        if t in left:
            left.remove(t)
            hit += 1
    return hit, len(want), len(left)


@pytest.mark.parametrize("name", sorted(INSERTS))
def test_article_with(model, name):
    """Within an article element what stands between two paragraphs is kept or dropped as it is, and takes nothing along."""
    x, blocks = INSERTS[name]
    kept = html.main_texts([article(x)], model)[0].split("\n")
    want = BASE[:2] + blocks + BASE[2:]
    assert kept == want


def test_all_homes_together(model):
    """Over all homes and pairs of inserts: share of article blocks kept, and of kept blocks that belong."""
    hit = total = extra = 0
    for home in HOMES:
        for a in sorted(INSERTS):
            for b in ("figure", "comments", "table"):
                x = INSERTS[a][0] + f"<p>{LONG[::-1]}</p>" + INSERTS[b][0]
                kept = html.main_texts([article(x, home)], model)[0].split("\n")
                h, n, e = recall(BASE + INSERTS[a][1] + INSERTS[b][1] + [LONG[::-1]], kept)
                hit, total, extra = hit + h, total + n, extra + e
    assert hit / total > 0.97 and extra / total < 0.03, (hit, total, extra)


def test_generated_pages_not_trained_on(model):
    rng = np.random.default_rng(991)
    right = n = 0
    for _ in range(150):
        x, y = html.labelled_page(rng)
        if len(y):
            p = model.score(*html.padded([x]))[:, 0]
            right, n = right + int(((p >= 0.5) == (y > 0)).sum()), n + len(y)
    assert right / n > 0.95, right / n


def test_ties_and_columns(spark, model):
    """A score of one half keeps a block; further columns are ignored; null and empty pages give empty texts."""
    even = html.Labeller()
    even.p = {k: np.zeros_like(v) for k, v in even.p.items()}
    assert html.main_texts(["<p>a</p><p>b</p>"], even) == ["a\nb"]
    rows = [(1, "u", article(""), "x", 3), (2, None, None, "y", None), (2, "u", "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["url"] or "", r["text"], r["n_chars"]) for r in html.extract(pages, model).collect())
    whole = "\n".join(BASE)
    assert got == [(1, "u", whole, len(whole)), (2, "", "", 0), (2, "u", "", 0)]
    assert html.extract(pages.limit(0), model).collect() == []


def test_open_title_and_textarea_take_nothing(model):
    for tag in ("title", "textarea", "template"):
        assert [t for _, t, _ in html.blocks(f"<p>one</p><{tag}><p>two</p>")] == ["one", "two"]
    assert [t for _, t, _ in html.blocks("<p>one</p><script><p>two</p>")] == ["one"]
