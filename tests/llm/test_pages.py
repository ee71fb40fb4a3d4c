"""Pages written by hand, each of which has to give its article and nothing else."""

import pytest

from assayer.llm import pagetext

MODEL = pagetext.trained()
A, B, C = "The council met on Monday to discuss the new bridge over the river.", "Nobody had expected the costs to rise so quickly, the mayor said.", "Work begins in spring."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer>"
WANT = f"A bridge too far {A} {B} {C}"
BODY = f"<h1>A bridge too far</h1><p>{A}</p><p>{B}</p><p>{C}</p>"


def text(page):
    return pagetext.main_text(page, *MODEL)


MISLEADING = (
    "information platform football-news stock-report trailer blueprint-post legal-news popular-science performance-review reading-pane review "
    "advertising-history menu-planning formula1 print-edition trending-now-story commentary postgraduate social-history cookie-recipes footwear "
    "headline-story brandenburg formal-letter tagalog-lessons searching-for-gold sidereal-time alerting-neighbours promoter badge"
).split()


@pytest.mark.parametrize("name", MISLEADING)
@pytest.mark.parametrize("tag", ["div", "article", "section"])
def test_misleading_names(name, tag):
    assert text(f'<html><body>{NAV}<{tag} class="{name}">{BODY}</{tag}>{FOOT}</body></html>') == WANT
    assert text(f"<body><div class='site-header'>The Daily</div><{tag} id={name}>{BODY}</{tag}><aside><p>Read more stories.</p></aside></body>") == WANT


PAGES = {
    "bare": f"<h1>A bridge too far</h1><p>{A}<p>{B}<p>{C}",
    "own header": f"<body>{NAV}<article><header><h1>A bridge too far</h1></header><p>{A}</p><p>{B}</p><p>{C}</p></article>{FOOT}</body>",
    "own footer": f"<body>{NAV}<article>{BODY}<footer><p>Filed under: bridges</p></footer></article>{FOOT}</body>",
    "entry header": f'<body><div id="masthead">The Daily</div><div class="post"><div class="entry-header"><h1>A bridge too far</h1></div><div class="entry-content"><p>{A}</p><p>{B}</p><p>{C}</p></div></div><div id="colophon">Proudly published</div></body>',
    "cookie bar": f'<body><div class="cookie-notice"><p>We use cookies to give you the best experience.</p></div>{NAV}<main>{BODY}</main>{FOOT}</body>',
    "camel case": f'<body><div class="cookieConsentBar">We use cookies here.</div><div class="mainMenu"><a href=/>Home</a> <a href=/b>Blog</a></div><article>{BODY}</article><div class="siteFooter">Imprint</div></body>',
    "advert inside": f'<body>{NAV}<article><h1>A bridge too far</h1><p>{A}</p><div class="ad">Buy one, get one free!</div><p>{B}</p><p>{C}</p></article>{FOOT}</body>',
    "comments": f'<body><article>{BODY}</article><section class="comments"><h3>2 comments</h3><p>What a waste of money, if you ask me.</p><p>I like the bridge.</p></section>{FOOT}</body>',
    "disqus": f'<body><main>{BODY}</main><div id="disqus_thread"><p>First! Great article, thanks for sharing it.</p></div></body>',
    "sidebar": f'<body>{NAV}<div id="content">{BODY}</div><div id="sidebar"><h3>Related</h3><ul><li><a href=/1>Ten bridges to see</a></li><li><a href=/2>River news</a></li></ul></div>{FOOT}</body>',
    "newsletter": f'<body><article>{BODY}</article><form action="/s"><p>Get our newsletter every week.</p><input name=mail><button>Sign up</button></form>{FOOT}</body>',
    "share bar": f'<body><article>{BODY}</article><ul class="social-share"><li><a href=/f>Share</a></li><li><a href=/t>Tweet</a></li></ul>{FOOT}</body>',
    "script": f"<body><script>var a = '<p>not text</p>';</script><article>{BODY}</article><style>p {{ margin: 0 }}</style><noscript></noscript>{FOOT}</body>",
    "breadcrumbs": f'<body><div class="breadcrumbs"><a href=/>Home</a> &raquo; <a href=/n>News</a></div><article>{BODY}</article></body>',
    "commented out": f"<body><!-- <p>An old article that nobody reads.</p> --><article>{BODY}</article><!-- unclosed",
    "entities": f"<body>{NAV}<article>{BODY.replace('the new', 'the&#32;new').replace('Nobody', 'No&#98;ody')}</article>{FOOT}</body>",
    "white space": f"<body>{NAV}<article>\n\n  <h1>A  bridge\n too far</h1>\t<p>{A}</p><p>{B}</p>\n<p>{C}  </p></article>{FOOT}</body>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layouts(name):
    assert text(PAGES[name]) == WANT


LAYOUTS = (
    "has-sidebar no-sidebar right-sidebar left-sidebar page-with-sidebar sticky-header header-fixed fixed-header page-header-large search-page search-results "
    "login-page form-page social-share-on widgets-on with-comments comments-open no-comments menu-open nav-open has-navigation cookie-consent-shown modal-open "
    "footer-visible ads-enabled sidebar-right layout-sidebar"
).split()


@pytest.mark.parametrize("name", LAYOUTS)
def test_names_of_layouts(name):
    plain = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
    assert text(f'<body class="{name}">{NAV}<article>{BODY}</article>{FOOT}</body>') == WANT
    assert text(f'<body class="{name}">{NAV}<div>{BODY}</div>{FOOT}</body>') == WANT
    assert text(f'<body>{NAV}<div class="{name}">{BODY}</div>{FOOT}</body>') == WANT
    assert text(f'<body>{NAV}<main class="{name}">{BODY}</main>{FOOT}</body>') == WANT
    assert text(f'<body><div id="page" class="site {name}">{NAV}<div class="content">{BODY}</div><div class="sidebar"><p>Most read this week.</p></div>{FOOT}</div></body>') == WANT
    assert text(f'<body class="{name}"><div class="{name}">{NAV}<article>{plain}</article>{FOOT}</div></body>') == f"{A} {B} {C}"


LINKS = "<ul><li><a href=/1>Ten bridges to see</a></li><li><a href=/2>River news of old</a></li><li><a href=/3>Maps</a></li></ul>"
LISTED = f"{A} Ten bridges to see River news of old Maps {B}"
REPLIES = "".join(f"<article><p>What a waste of money, if you ask me, number {i}.</p></article>" for i in range(30))
OTHERS = {
    "form around": (f'<body><form action="/p.aspx">{NAV}<div>{BODY}</div>{FOOT}</form></body>', WANT),
    "form around boxes": (f"<body><form id=aspnetForm><div class=wrap>{NAV}<article>{BODY}</article><div id=footer>Imprint</div></div></form></body>", WANT),
    "breaks": (f"<body>{A}<br>{B}<br><br>{C}</body>", f"{A} {B} {C}"),
    "text": (f"{A} {B}", f"{A} {B}"),
    "div of text": (f"<body><div>{A}<br>{B}</div></body>", f"{A} {B}"),
    "links in an article": (f"<body>{NAV}<article><p>{A}</p>{LINKS}<p>{B}</p></article>{FOOT}</body>", LISTED),
    "links below a heading": (f"<body>{NAV}<article><h1>X</h1><p>{A}</p>{LINKS}<p>{B}</p></article>{FOOT}</body>", f"X {LISTED}"),
    "links in a main": (f"<body>{NAV}<main><p>{A}</p>{LINKS}<p>{B}</p></main>{FOOT}</body>", LISTED),
    "noscript": (f"<body>{NAV}<article>{BODY}</article><noscript><p>Please enable scripts to read this page fully.</p></noscript>{FOOT}</body>", WANT),
    "ad slot": (f'<body>{NAV}<div id=content><h1>A bridge too far</h1><p>{A}</p><div class="ad-slot">Buy one, get one free now!</div><p>{B}</p><p>{C}</p></div>{FOOT}</body>', WANT),
    "unmarked comments": (f"<body>{NAV}<article>{BODY}</article><section><h3>2 comments</h3><p>What a waste of money, if you ask me.</p><p>I like the bridge.</p></section>{FOOT}</body>", WANT),
    "more comments than text": (f'<body>{NAV}<article>{BODY}</article><section class="comments"><h3>30 comments</h3>{REPLIES}</section>{FOOT}</body>', WANT),
    "logo in a heading": (f"<body><header><h1>The Daily</h1></header>{NAV}<article><h2>A bridge too far</h2><p>{A}</p><p>{B}</p><p>{C}</p></article>{FOOT}</body>", WANT),
    "furniture only": (f"<body>{NAV}<div class=footer><p>All rights reserved here.</p><p>Made in house.</p></div></body>", ""),
    "notice only": (f"<body>{NAV}<div class=cookie-notice><p>We use cookies to give you the best experience.</p></div>{FOOT}</body>", ""),
    "teasers beside": (f"<body>{NAV}<article>{BODY}</article><aside><article><p>Read on.</p></article><article><p>And on.</p></article></aside>{FOOT}</body>", WANT),
}


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_other_layouts(name):
    page, want = OTHERS[name]
    assert text(page) == want


def test_parts_of_an_article():
    inner = f"<h1>T &amp; U</h1><p>{A}</p><h2>Costs</h2><ul><li>Steel is dear.</li><li>Stone is not.</li></ul><blockquote>{B}</blockquote><pre>x = 1</pre><table><tr><td>One</td><td>Two</td></tr></table>"
    assert text(f"<body>{NAV}<article>{inner}</article>{FOOT}</body>") == f"T & U {A} Costs Steel is dear. Stone is not. {B} x = 1 One Two"
    formula = "<p>The area is <math><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup></math> for every square of this kind.</p>"
    assert text(f"<body>{NAV}<article><p>{A}</p>{formula}</article></body>") == f"{A} The area is a=r2 for every square of this kind."
    assert text(None) == text("") == text(NAV + FOOT) == ""


def test_very_long_page():
    long = "".join(f"<p>Sentence number {i} of a very long article.</p>" for i in range(50_000))
    assert text(f"<body>{NAV}<article>{long}</article>{FOOT}</body>") == " ".join(f"Sentence number {i} of a very long article." for i in range(50_000))
