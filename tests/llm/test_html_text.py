import random
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from foreign_pages import PAGES

from tallyloom.llm import html_text as H
from tallyloom.llm import queries
from tallyloom.llm.boosting import BoostedTrees


def main_text(source):
    page = H.Page(source)
    return H.text_of(page, H.decode(page, H.model().predict(H.features(page))))


def test_held_out_layouts():
    r = random.Random(99)
    good = total = kept = 0
    for _ in range(150):
        source = H.layouts(r)
        page, y, known = H.labelled(source)
        state = H.decode(page, H.model().predict(H.features(page)))
        for node, text in page.segments:
            total += y[node] == 1
            good += bool(y[node] == 1 and state[node])
            kept += state[node]
    assert good / total > 0.93 and good / kept > 0.93


class PlainBlocks(HTMLParser):
    """Texts between tags that are not inline, by the standard parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.hidden = [], [], 0
        self.feed(source)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in H.RAW:
            self.hidden += 1
        elif self.hidden:
            pass
        elif tag == "br":
            self.parts.append(" ")
        elif tag not in H.INLINE and (tag not in H.VOID or tag == "hr"):
            self.end()

    def handle_endtag(self, tag):
        if tag in H.RAW:
            self.hidden -= 1
        elif not self.hidden and tag not in H.INLINE and tag not in H.VOID:
            self.end()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_blocks_match_the_standard_parser():
    r = random.Random(4)
    sources = [page for _, page, _ in PAGES] + [H.layouts(r).translate({1: None, 2: None}) for _ in range(100)]
    sources += ["<p>a&#x41;&eacute;&nbsp;b&lt;c&gt;<hr>d<br>e<!-- <p>no</p> -->f<select><option>no</select>g", "<DIV>A<B>b</B>c</DIV><p title='a > b'>d"]
    for source in sources:
        assert [text for _, text in H.Page(source).segments] == PlainBlocks(source).blocks


def test_foreign_layouts(spark, tmp_path):
    """The whole query on pages that the generator does not draw: words found of those wanted, and wanted of those found."""
    rows = [(k, name, page) for k, (name, page, _) in enumerate(PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op3_html_extraction(spark, str(tmp_path)).collect()}
    exact = 0
    for k, (name, _, blocks) in enumerate(PAGES):
        wanted, found = Counter(" ".join(blocks).split()), Counter(got[k].text.split())
        both = (wanted & found).total()
        assert both >= 0.98 * wanted.total() and both >= 0.95 * found.total(), name
        assert (got[k].url, got[k].n_chars) == (name, len(got[k].text))
        exact += got[k].text == " ".join(blocks)
    assert exact >= 9  # the blog's link to its content is kept


def test_a_page_with_everything():
    source = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div class="ad">Buy now!</div>
    <article><h1>A  title</h1><p>First &amp; <b>bold<br>text,</b> with&#10;a break. It goes on for some more words, as articles do.
    <p>Second paragraph, with enough words to be read as prose. It also has a second sentence.</p>
    <div class="ad">Another advert</div><p>Third &lt;paragraph&gt; closes the piece, after some further words of text.</p></article>
    <form><input name=q><button>Go</button></form><aside><h3>Related</h3><ul><li><a href="/x">Other</a></li></ul></aside>
    <section class="comments"><p>Nice piece!</p><p>I disagree with most of it.</p></section><footer>&copy; 2024 Site</footer></body></html>"""
    assert main_text(source) == (
        "A title First & bold text, with a break. It goes on for some more words, as articles do. "
        "Second paragraph, with enough words to be read as prose. It also has a second sentence. "
        "Third <paragraph> closes the piece, after some further words of text."
    )


def test_decoding_is_consistent_and_best():
    r = np.random.default_rng(0)
    page = H.Page("<div><section><p>a</p><div><p>b</p></div></section></div>")
    parents = page.parents
    for _ in range(50):
        p = r.uniform(0.05, 0.95, len(parents))
        state = H.decode(page, p)
        best, best_score = None, -1e9
        for code in range(3 ** len(parents)):
            s = [code // 3**k % 3 for k in range(len(parents))]
            if s[0] != 0 or any(s[i] not in ((0, 1), (1, 2), (2,))[s[parents[i]]] for i in range(1, len(parents))):
                continue
            score = sum(np.log(p[i]) if s[i] == 1 else np.log(1 - p[i]) for i in range(1, len(parents)))
            if score > best_score:
                best, best_score = [x == 1 for x in s], score
        assert state == best


def test_odd_sources(spark):
    long = "<article><p>" + "word and more, " * 60000 + "</p></article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text, no markup"), (4, "u", "<p>open <b>tags <!-- never closed"), (5, "u", '<a href="x>y'), (6, "u", long), (6, "u", long), (None, "u", "<<>>< p>&amp;")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars long")
    got = {r.page_id: r for r in H.extract(df).collect()}
    assert H.extract(df).count() == len(rows)
    assert (got[1].text, got[2].text, got[3].text) == ("", "", "plain text, no markup")
    assert got[6].n_chars == len(" ".join(("word and more, " * 60000).split()))
    assert H.extract(df.limit(0)).count() == 0


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    m = BoostedTrees().fit(x[:1500], y[:1500])
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
