"""Pages written by hand, of layouts that the generator of training pages does not draw: (name, html, main text blocks)."""

from __future__ import annotations

LOREM = [
    "The harbour was quiet when the first boats came back, an hour before the light. Nobody had expected them so early.",
    "By noon the market was full, and the price of herring had fallen by a third. Traders blamed the weather, as they always do.",
    "The council will meet again on Thursday; until then, the old rules stay in force.",
    "Her grandfather had kept a notebook of every catch since 1951, and it shows how slowly the numbers changed at first.",
    "Short line.",
    "What comes next is less clear. Two of the yards have closed, the third is for sale, and the young people leave for the city.",
]


def _blog() -> tuple[str, str, list[str]]:
    page = f"""<!doctype html><html lang="en-US"><head><title>Boats | A Coast Diary</title><link rel="stylesheet" href="/s.css"></head>
<body class="post-template-default single single-post postid-88 wp-embed">
<div id="page" class="hfeed site"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<div id="masthead" class="site-branding"><p class="site-title"><a href="/">A Coast Diary</a></p><p class="site-description">Notes from the north</p></div>
<div id="site-navigation" class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/archive">Archive</a></li></ul></div>
<div id="content" class="site-content"><div id="primary" class="content-area"><article id="post-88" class="post type-post hentry">
<h1 class="entry-title">Boats before light</h1>
<div class="entry-content"><p>{LOREM[0]}</p><p>{LOREM[1]}</p><blockquote><p>{LOREM[2]}</p></blockquote><p>{LOREM[3]}</p></div>
<div class="sharedaddy social-share"><ul><li><a href="#">Facebook</a></li><li><a href="#">Mail</a></li></ul></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Lovely piece, my uncle was on one of those boats, and he tells it the same way.</p></li><li class="comment"><p>Thanks for this!</p></li></ol>
<div id="respond" class="comment-respond"><form><p>Your email address will not be published.</p><textarea></textarea><input type=submit></form></div></div></div>
<div id="secondary" class="widget-area"><div class="widget"><h2>Recent Posts</h2><ul><li><a href="/1">Ice</a></li><li><a href="/2">Nets</a></li></ul></div></div></div>
<div id="colophon" class="site-footer"><p>Proudly powered by a very fine blog system. All rights reserved.</p></div></div></body></html>"""
    return "blog", page, ["Boats before light", *LOREM[:4]]


def _news() -> tuple[str, str, list[str]]:
    page = f"""<html><head><title>x</title></head><body><header class="gh"><div class="gh-in"><a href="/">Daily Tide</a><nav><a href="/w">World</a> <a href="/s">Sport</a> <a href="/b">Business</a></nav></div></header>
<div class="leaderboard-ad"><div class="ad-label">Advertisement</div></div>
<main><div class="grid"><div class="col-8"><h1>Herring falls by a third</h1><figure><img src="a.jpg"></figure>
<div class="story-text"><p>{LOREM[1]}</p><p>{LOREM[0]}</p><div class="newsletter-signup"><p>Sign up for our morning briefing and never miss a story again.</p></div><p>{LOREM[5]}</p><h2>What the council says</h2><p>{LOREM[2]}</p><div class="ad-slot">Buy a boat today!</div><p>{LOREM[3]}</p></div></div>
<div class="col-4"><div class="most-popular"><h3>Most read</h3><ol><li><a href="/1">Storm closes the bridge</a></li><li><a href="/2">Five soups for cold days</a></li></ol></div></div></div></main>
<footer><div><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul><p>Daily Tide is published by Tide Media, 4 Quay Street.</p></div></footer></body></html>"""
    return "news", page, ["Herring falls by a third", LOREM[1], LOREM[0], LOREM[5], "What the council says", LOREM[2], LOREM[3]]


def _old_table() -> tuple[str, str, list[str]]:
    page = f"""<HTML><HEAD><TITLE>Harbour history</TITLE></HEAD><BODY BGCOLOR=#ffffff>
<TABLE WIDTH=100% BORDER=0><TR><TD COLSPAN=2><CENTER><A HREF=index.htm>Home</A> | <A HREF=maps.htm>Maps</A> | <A HREF=links.htm>Links</A></CENTER></TD></TR>
<TR><TD VALIGN=top WIDTH=120><A HREF=a.htm>1900-1920</A><BR><A HREF=b.htm>1920-1940</A><BR><A HREF=c.htm>1940-1960</A></TD>
<TD><H2>Harbour history</H2><P>{LOREM[3]}<P>{LOREM[0]}<P>{LOREM[1]}<P>{LOREM[5]}</TD></TR></TABLE></BODY></HTML>"""
    return "old_table", page, ["Harbour history", LOREM[3], LOREM[0], LOREM[1], LOREM[5]]


def _hashed() -> tuple[str, str, list[str]]:
    page = f"""<html><head><title>t</title></head><body><div id="root"><div class="css-1x9f"><div class="css-8b2"><a href="/">Log</a><a href="/in">Sign in</a><a href="/up">Get started</a></div></div>
<div class="css-q0d"><div class="css-77a"><h1 class="css-kk1">Leaving the yards</h1><p class="css-p1">{LOREM[5]}</p><p class="css-p1">{LOREM[0]}</p><h2 class="css-kk2">Numbers</h2><p class="css-p1">{LOREM[3]}</p><ul class="css-u"><li>Two yards have closed since the spring.</li><li>One is for sale, at a price nobody will pay.</li></ul><p class="css-p1">{LOREM[1]}</p></div></div>
<div class="css-z9"><div class="css-zz"><a href="/h">Help</a><a href="/s">Status</a><a href="/p">Privacy</a><a href="/t">Terms</a></div></div></div></body></html>"""
    return "hashed", page, ["Leaving the yards", LOREM[5], LOREM[0], "Numbers", LOREM[3], "Two yards have closed since the spring.", "One is for sale, at a price nobody will pay.", LOREM[1]]


def _plain() -> tuple[str, str, list[str]]:
    page = f"<html><head><title>Notes</title></head><body><h1>Notes on the fleet</h1><p>{LOREM[0]}</p><p>{LOREM[4]}</p><p>{LOREM[1]}</p></body></html>"
    return "plain", page, ["Notes on the fleet", LOREM[0], LOREM[4], LOREM[1]]


def _docs() -> tuple[str, str, list[str]]:
    page = f"""<html><head><title>Tide tables</title></head><body><div class="header-bar"><form role="search"><input name=q></form></div><div class="document"><div class="sphinxsidebar" role="navigation"><h3>Contents</h3><ul><li><a href="#a">Install</a><ul><li><a href="#b">Unix</a></li></ul></li><li><a href="#c">Use</a></li></ul></div>
<div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main"><section id="use"><h1>Use</h1><p>{LOREM[2]}</p><pre>tide --port north --day 12
tide --help</pre><p>{LOREM[5]}</p><table><tr><th>Port</th><th>Height</th></tr><tr><td>North</td><td>2.1</td></tr></table><dl><dt>port</dt><dd>The name of the harbour whose table is read.</dd></dl></section></div></div></div></div>
<div class="footer" role="contentinfo">&copy; Copyright 2019, the tide people. Created with care.</div></body></html>"""
    return "docs", page, ["Use", LOREM[2], "tide --port north --day 12 tide --help", LOREM[5], "Port", "Height", "North", "2.1", "port", "The name of the harbour whose table is read."]


def _consent() -> tuple[str, str, list[str]]:
    page = f"""<html><body><div id="onetrust-consent-sdk"><div class="ot-banner"><p>We and our 812 partners store and access information on your device. You may accept or manage your choices by clicking below.</p><button>Accept all</button></div></div>
<nav class="breadcrumb"><ol><li><a href="/">Home</a></li><li><a href="/r">Region</a></li></ol></nav>
<div class="wrapper"><section class="body-copy"><h1>Old rules stay</h1><p>{LOREM[2]}</p><p>{LOREM[1]}</p><aside class="related-links"><h4>Read more</h4><a href="/x">The herring war</a></aside><p>{LOREM[3]}</p></section>
<div class="disqus_thread" id="disqus_thread"><div class="post-body">I was there in 1974 and can say that none of this is how it went, not at all.</div></div></div></body></html>"""
    return "consent", page, ["Old rules stay", LOREM[2], LOREM[1], LOREM[3]]


def _korean() -> tuple[str, str, list[str]]:
    a, b = "새벽의 항구는 조용했고, 첫 배가 들어온 것은 해가 뜨기 한 시간 전이었다. 아무도 그렇게 일찍 올 줄 몰랐다.", "정오가 되자 시장은 사람들로 가득 찼다. 청어 값은 삼분의 일이 내렸고 상인들은 날씨를 탓했다."
    page = f"""<html lang=ko><head><meta charset=utf-8><title>항구</title></head><body><div id="gnb"><ul><li><a href="/">홈</a></li><li><a href="/n">뉴스</a></li></ul></div>
<div id="wrap"><div id="container"><div class="view_head"><h3>새벽 항구</h3></div><div class="article_view" id="articleBody"><p>{a}</p><p>{b}</p><p>{a}</p></div>
<div class="reply_wrap comments"><ul><li>좋은 글입니다.</li><li>잘 읽었어요.</li></ul></div></div></div><div id="footer">Copyright &copy; 항구신문. 무단 전재 금지.</div></body></html>"""
    return "korean", page, ["새벽 항구", a, b, a]


def _breaks() -> tuple[str, str, list[str]]:
    page = f"""<html><body><div class="top"><a href=/>Index</a> &raquo; <a href=/e>Essays</a></div><div class="essay">{LOREM[0]}<br><br>{LOREM[1]}<br><br>{LOREM[5]} {LOREM[3]}</div><div class="nav-bottom"><a href=/p>Previous</a> <a href=/n>Next</a></div></body></html>"""
    return "breaks", page, [f"{LOREM[0]} {LOREM[1]} {LOREM[5]} {LOREM[3]}"]


def _recipe() -> tuple[str, str, list[str]]:
    steps = ["Scale the fish and rinse them under cold water.", "Salt both sides, then rest them for an hour.", "Fry in butter until the skin is crisp, four minutes a side."]
    page = f"""<html><body><header><a href="/">Kitchen</a></header><article itemscope><h1 itemprop="name">Fried herring</h1><div class="author-bio"><a href="/a">By Ana</a></div><p>{LOREM[3]}</p><div class="promo-box"><a href="/shop">Shop our pans</a></div><h2>Ingredients</h2><ul><li>6 herrings</li><li>Coarse salt</li><li>80 g butter</li></ul><h2>Method</h2><ol>{''.join(f'<li>{s}</li>' for s in steps)}</ol></article><section class="user-reviews"><h2>Reviews</h2><div>Five stars, will make it again for my family next week.</div></section><footer>Kitchen 2020</footer></body></html>"""
    return "recipe", page, ["Fried herring", LOREM[3], "Ingredients", "6 herrings", "Coarse salt", "80 g butter", "Method", *steps]


PAGES = [f() for f in (_blog, _news, _old_table, _hashed, _plain, _docs, _consent, _korean, _breaks, _recipe)]
