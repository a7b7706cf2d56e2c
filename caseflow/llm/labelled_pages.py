"""Small labelled pages that the extraction weights are learned from.

The text of an element with ``data-main`` is wanted, but for that of elements with ``data-skip`` inside it.
"""

from __future__ import annotations

_LINE = "The river rose two metres in one night and the lower road was closed until the morning."
_MORE = "Nobody was hurt, said the mayor, and <a href='/x'>the bridge</a> will be looked at this week."
_MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Sport</a></li><li><a href='/d'>Weather</a></li></ul>"
_COMMENTS = "<div class='comment'><p>I saw it all from my window, it was frightening.</p></div><div class='comment'><p>Thanks for the report.</p></div>"

PAGES = (
    f"""<html><body><nav>{_MENU}</nav><div class="ad">Buy two boats and get one free. Order today.</div><article data-main><h1>High
    water</h1><p>{_LINE}</p><p><b>{_MORE}</b><br>It rained for days.</p><p>So.</p></article><footer>&copy; The Daily River. All rights
    reserved by the publisher.</footer></body></html>""",
    f"""<body><nav>{_MENU}</nav><div class="ad">Great offers this week only.</div><article data-main><h1>Flood</h1><p>{_LINE}<p>{_MORE}
    <ul><li>The lower road is closed</li><li>The school is open</li></ul></article><footer><p>Imprint and contact of the
    publisher, written by nobody.</p></footer>""",
    f"""<body><header class="site-header"><h1><a href="/">Daily River</a></h1><p>The paper for the whole valley</p></header><main><article
    data-main><header><h1>High water</h1><p>By a reporter</p></header><p>{_LINE}</p><blockquote><p>We had an hour.</p></blockquote>
    <p>{_MORE}</p><figure><figcaption>The bridge at noon</figcaption></figure><aside data-skip><h2>Read more</h2><p>Ten tips for a dry
    cellar that you should know.</p></aside><p>{_LINE}</p></article><section class="comments"><h2>Comments</h2>{_COMMENTS}</section></main>
    <aside class="sidebar"><h3>Most read</h3>{_MENU}<p>Subscribe to our letter and never miss a story again.</p></aside><footer>{_MENU}</footer>""",
    f"""<body><div id="cookie-notice" class="notice banner"><p>We use cookies to make this site better. By staying you agree to
    them.</p><button>Accept</button></div><div class="header"><div class="logo">Daily River</div><div class="menu"><a href="/a">Home</a> |
    <a href="/b">News</a> | <a href="/c">Sport</a></div></div><div id="content" class="content"><div class="post" data-main><h2>High
    water</h2><p>{_LINE}</p><div class="advert" data-skip><p>Buy two boats and get one free.</p></div><p>{_MORE}</p><p>{_LINE}</p></div><div
    id="comments">{_COMMENTS}<form><label>Your comment is welcome here</label></form></div></div><div class="sidebar"><div
    class="widget"><p>Follow us and tell your friends about us.</p></div></div><div class="footer"><p>Copyright by the publisher.</p></div>""",
    f"""<body><table><tr><td class="left menu">{_MENU}</td><td class="main" data-main><h1>Flood</h1><p>{_LINE}</p><p>{_MORE}</p></td><td
    class="right"><div class="promo"><p>Win a trip to the sea with our sponsor.</p></div></td></tr></table><div class="footer">Contact
    us</div>""",
    f"""<body><nav class="breadcrumb"><a href="/">Home</a> <a href="/n">News</a></nav><main data-main><h1>Flood</h1><p>{_LINE}</p><table>
    <tr><th>Day</th><td>Level</td></tr><tr><td>Monday</td><td>two metres</td></tr></table><pre>level = 2</pre><form data-skip><p>Get the
    letter by mail every week, free of charge.</p></form><div class="related" data-skip><h3>Related</h3>{_MENU}</div><div class="share"
    data-skip>Share this page with friends</div><p>{_LINE}</p></main><div class="newsletter"><p>Get our letter every week.</p></div><footer>
    <p>Terms of use and privacy, last changed in May.</p></footer>""",
    f"""<body><div class="navbar">{_MENU}</div><div class="ads"><p>Cheap boats for sale, call now and save.</p></div><section><div
    class="article-body" data-main><h1>Flood</h1><p>{_LINE}</p><h2>What next</h2><p>{_MORE}</p><ol><li>Stay at home</li><li>{_LINE}</li></ol>
    </div></section><div class="reader-comments"><h3>What readers say</h3>{_COMMENTS}</div><div role="contentinfo" class="footer-links">
    {_MENU}</div>""",
    f"""<body><div class="top-bar"><p>Call us any day between nine and five.</p></div><div class="entry" data-main><p>{_LINE}</p><p>{_MORE}</p>
    <p>{_LINE}</p></div><div class="comments"><ul><li><p>This is what I think about it all.</p></li></ul></div><div class="popup modal">
    <p>Before you go, sign up for our letter.</p></div><div class="sponsored"><p>Paid content from our partner, about boats.</p></div>""",
    f"""<body><header><nav>{_MENU}</nav><p>Welcome to the paper for the valley.</p></header><div data-main><h1>Flood</h1><p>{_LINE}</p><p>
    {_MORE}</p></div><footer><div><p>Written and printed in the valley since 1901.</p></div></footer><div class="ad-slot"><p>Buy now.</p></div>""",
    f"""<body><div><a href="/">Daily River</a></div><div><div><p>{_LINE}</p><p>{_MORE}</p></div></div></body>""".replace("<div><div>", "<div><div data-main>"),
    f"""<body><div><div data-main>{_LINE} {_MORE}<br><br>{_LINE}<br>So.</div></div><div class="copyright">All rights reserved by us.</div>""",
    f"""<body><nav class="menu">{_MENU}</nav><article data-main><header><h1>Flood</h1></header><nav data-skip>{_MENU}</nav><div class="ad" data-skip>
    <p>Great offers on boats, this week only, in every shop.</p></div><section><h2>The night</h2><p>{_LINE}</p><ul><li>Boats</li><li>Sand bags
    and pumps</li></ul></section><aside data-skip><p>Did you know that the river is four hundred miles long?</p></aside><p>{_MORE}</p><form
    data-skip><p>Leave your name here and we will write to you.</p></form><div class="notice" data-skip><p>This site uses cookies to work
    well for you.</p></div><p>{_LINE}</p><section class="comments" data-skip><h2>Comments</h2>{_COMMENTS}</section><footer data-skip><p>Written
    by a reporter, filed under weather.</p></footer></article><section class="comments" id="comments"><ol><li class="comment"><p>{_LINE}</p></li>
    </ol></section><aside class="sidebar"><p>{_LINE}</p></aside><form><p>Search the whole site by word.</p></form><footer><p>{_LINE}</p></footer>""",
    f"""<body><header><h1>Daily River</h1><p>{_LINE}</p></header><div class="sidebar"><p>{_LINE}</p></div><div class="article" data-main><div><p>{_LINE}</p>
    </div><div class="text"><h3>Later</h3><p>{_MORE}</p></div><div class="advertisement" data-skip>{_LINE}</div><div class="comments" data-skip><p>{_LINE}</p>
    </div></div><div class="footer"><p>{_LINE}</p></div><div class="notice"><p>{_LINE}</p></div><div class="banner"><p>{_LINE}</p></div>""",
)

#: Names by which page authors mark what is not the article, and what is; each gets a page with and within an article.
ASIDE_NAMES = """ad ads advert advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay
    newsletter subscribe signup social share sharing related recommended trending popular breadcrumb breadcrumbs pagination pager toolbar
    topbar navbar menu nav navigation sidebar widget rail footer copyright legal masthead comments comment discussion disqus replies respond
    feedback login search form""".split()
MAIN_NAMES = "article post entry content main story text body".split()
ASIDE_TAGS = "nav aside form footer".split()


def _marked(open_: str, close: str) -> str:
    return (f"<body><div>{open_}<p>{_LINE}</p>{close}</div><article data-main><h1>Flood</h1><p>{_LINE}</p>{open_.replace('>', ' data-skip>', 1)}"
            f"{_MORE}{close}<p>So.</p></article>{open_}Read this. {_LINE}{close}")


PAGES += tuple(_marked(f'<div class="{x}">', "</div>") for x in ASIDE_NAMES)
PAGES += tuple(_marked(f"<{x}>", f"</{x}>") for x in ASIDE_TAGS)
PAGES += tuple(f"""<body><header><p>{_LINE}</p></header><div class="{x}" data-main><h1>Flood</h1><p>{_LINE}</p><p>So.</p><ul><li>{_LINE}</li></ul>
    <h2>Then</h2>Yes.</div><footer>Ours.</footer>""" for x in MAIN_NAMES)
PAGES += ("<p data-main>Only this.", "<body><div data-main>A short page.<br>Two lines.</div>", "<div data-main><p>One thing.</p><p>And one more.</p></div>",
          f"<div data-main><h1>Flood</h1><p>It rained.</p><p>{_LINE}</p><p>So.</p></div>")
