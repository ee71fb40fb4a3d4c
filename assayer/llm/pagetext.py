"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree."""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S
)
_HINTED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW = frozenset("script style textarea title template svg noframes noscript iframe select option button object annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder "
    "munderover mfenced mtable mtr mtd".split()
)
#: tags that end the open element of the same group
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: kinds of class, id and role names, by the words these are made of; tried in this order
HINTS = {
    name: frozenset(words.split())
    for name, words in (
        ("comment", "comment comments commentlist disqus reply replies respond discussion guestbook"),
        ("advert", "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners outbrain taboola dfp commercial"),
        ("notice", "cookie cookies consent gdpr notice notices alert alerts popup modal paywall overlay toast disclaimer"),
        ("form", "form forms subscribe subscription newsletter signup login signin search searchbox poll"),
        ("side", "sidebar sidebars aside widget widgets related recommended recommendations popular trending rail complementary teaser teasers mostread"),
        ("share", "share sharing social follow toolbar print tag tags tagcloud authorbox bylinebox"),
        ("menu", "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager skip skiplink toc"),
        ("foot", "foot footer copyright legal imprint colophon contentinfo"),
        ("head", "head header masthead logo sitetitle topbar brand branding"),
        ("main", "article articles content post posts entry story main body text prose markdown"),
    )
}
#: words that tell where or what a box is, and leave the kind of the word beside them as it is
PLAIN = frozenset(
    "site page global primary secondary top bottom left right upper lower box block bar list item items wrapper wrap container outer inner section area "
    "slot unit zone placement panel module group row col column links link small large fixed sticky user my the a of in on and main content article post entry c js mobile desktop".split()
)
#: words that make a name a state of the page or a layout, not a kind of box: has-sidebar, with-header, menu-open
STATES = frozenset("has no not with without is open opened closed fixed sticky active enabled disabled visible hidden expanded collapsed on off large wide full".split())
#: tags and kinds that can be told wrongly of a box that holds the page's text
BOXES = frozenset("form aside header footer nav".split())
WRAPPING = frozenset("side head menu form share".split())
#: fixed values: words of headings that open a list of comments
COMMENTS = re.compile(r"^\W*\d*\W*(comments?|replies|responses|discussion|kommentare?|commentaires?|comentarios?|respuestas|antworten|réponses)\W*\d*\W*$", re.I)
#: words that mean one kind whatever stands beside them
SURE = frozenset("disqus outbrain taboola gdpr navbar breadcrumb breadcrumbs colophon masthead contentinfo sidebar sidebars adsense guestbook".split())
_CASES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@functools.lru_cache(65536)
def _kind_of(name: str) -> tuple[str, bool] | None:
    """(kind, sure) of one class, id or role name: sure where it holds a kind's word and otherwise plain ones, as in
    site-footer; not sure where other words stand beside it, as in popular-science or legal-news."""
    words = [w.lower() for w in _CASES.findall(name)]
    joined = "".join(words)
    for kind, own in HINTS.items():
        if joined in own or any(w in own for w in words):
            if words[0] in STATES and len(words) > 1 and words[0] not in ("sticky", "fixed", "large", "wide", "full", "active"):
                return None  # has-sidebar says that there is one
            rest = [w for w in words if w not in own and w not in PLAIN and w not in STATES]
            if kind == "head" and any(w in HINTS["main"] for w in words):  # entry-header: the article's own
                kind = "main"
            return kind, joined in own or not rest or not SURE.isdisjoint(words)
    return None


@functools.lru_cache(4096)
def _hint(attributes: str) -> str | None:
    """The kind that an element's names tell: the first sure one, else the first with a question mark."""
    found = [k for _, v in _HINTED.findall(attributes) for n in v.strip("\"'").split() if (k := _kind_of(n))]
    order = {k: i for i, k in enumerate(HINTS)}
    sure = sorted({k for k, s in found if s}, key=order.get)
    doubtful = sorted({k for k, s in found if not s}, key=order.get)
    return sure[0] if sure else f"{doubtful[0]}?" if doubtful else None


class _Boxes:
    """The elements of a page in the order of their opening: tag, hint, parent, and what they hold."""

    def __init__(self):
        self.tags, self.hints, self.parents, self.mass, self.holds = ["#page"], [None], [-1], [0], [0]

    def open(self, tag: str, hint: str | None, parent: int) -> int:
        self.tags.append(tag)
        self.hints.append(hint)
        self.parents.append(parent)
        self.mass.append(0)
        self.holds.append({"main": 1, "article": 2, "h1": 4, "nav": 8}.get(tag, 0))
        return len(self.tags) - 1

    def paths(self) -> list[tuple]:
        """The path of every element. A box that holds the page's text isn't furniture, whatever it is called: body and main, what a
        main stands in, and what holds most of the text with the first heading or an article. Classes of such boxes tell
        their layout (no-sidebar, sticky-header, login-page), and a form around them is the page's."""
        own = list(self.holds)
        for i in range(len(self.tags) - 1, 0, -1):
            p = self.parents[i]
            self.mass[p] += self.mass[i]
            self.holds[p] |= self.holds[i]
        total, out = self.mass[0] or 1, [()]
        for i in range(1, len(self.tags)):
            tag, hint = self.tags[i], self.hints[i]
            kind = hint.rstrip("?") if hint else None
            if (kind and kind != "main") or tag in BOXES:
                share, holds = self.mass[i] / total, self.holds[i] & ~(own[i] if tag != "main" else 0)
                most = share >= 0.5 and (holds & 4 or holds & 2 and (kind != "comment" or holds & 8))
                nearly = share >= 0.9 and (kind in WRAPPING or tag == "form") and tag not in BOXES - {"form"}
                if tag in ("html", "body", "main") or holds & 1 or most or nearly:
                    tag, hint = "div" if tag in BOXES else tag, None
            out.append((*out[self.parents[i]], (tag, hint)))
        return out


def blocks(page: str | None):
    """(path, text, letters inside links) of each leaf block in page order; path: the open elements with their hints."""
    boxes, stack = _Boxes(), [0]
    parts: list[str] = []
    linked, in_link, out = 0, False, []
    page, at = page or "", 0

    def flush():
        nonlocal linked, parts
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((stack[-1], text, linked))
                boxes.mass[stack[-1]] += max(len(text) - linked, 0)
                leaf = boxes.tags[stack[-1]]
                if len(text) < 60 and leaf in ("h2", "h3", "h4", "h5") and COMMENTS.match(text):
                    box = stack[-2]
                    if boxes.tags[box] in ("section", "div", "aside") and not boxes.holds[box] & 7:
                        boxes.hints[box] = "comment"
            parts, linked = [], 0

    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m.group(2)
        if tag is None:
            raw = m.group()
            if raw[0] != "<" or raw == "<":
                data = html.unescape(raw) if "&" in raw else raw
                parts.append(data)
                linked += len(data) if in_link else 0
            continue
        tag, closing = tag.lower(), m.group(1)
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            in_link = in_link if tag != "a" else not closing
        elif tag in RAW:
            if not closing and not m.group(3).endswith("/"):  # what stands inside isn't markup and isn't text
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea") else at
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            flush()
            in_link = False
            if closing:
                if any(boxes.tags[i] == tag for i in stack):
                    while boxes.tags[stack.pop()] != tag:
                        pass
            else:
                ends, last = _ENDS.get(tag, set()), boxes.tags[stack[-1]]
                if last == "p" or last in ends:
                    stack.pop()
                stack.append(boxes.open(tag, _hint(m.group(3)) if m.group(3) else None, stack[-1]))
    flush()
    paths = boxes.paths()
    return [(paths[i], text, links) for i, text, links in out]


@functools.lru_cache(65536)
def _path_features(path: tuple) -> tuple[str, ...]:
    """Tags and kinds above a block. A header inside an article or main element is its own, not the page's, and so is a footer."""
    leaf = path[-1][0] if path else "none"
    tags, inside = set(), False
    for t, h in path:
        tags.add(f"own:{t}" if inside and t in ("header", "footer") else f"in:{t}")
        inside = inside or t in ("article", "main") or h == "main"
    hints = [h for _, h in path if h]
    return (f"leaf:{leaf}", *sorted(tags - {"in:html", "in:body"}), *sorted({f"hint:{h}" for h in hints}), *(["doubt"] if any(h[-1] == "?" for h in hints) else []), f"last:{hints[-1] if hints else '-'}", f"depth:{min(len(path), 6)}")


def text_features(text: str, linked: int, k: int, n: int) -> tuple[str, ...]:
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 7 else 2 if words < 15 else 3 if words < 40 else 4
    share = linked / len(text)
    return (
        "bias", f"words:{size}", f"links:{0 if not share else 1 if share < 0.4 else 2 if share < 0.9 else 3}",
        f"stop:{text[-1] in '.!?…\"”»'}", f"sign:{'©' in text}", f"edge:{'only' if n == 1 else 'first' if k == 0 else 'last' if k == n - 1 else '-'}",
    )


_KINDS = tuple(HINTS)


def labelled_page(rng: random.Random) -> list[tuple[tuple, str, int, int]]:
    """A made page as (path, text, linked letters, 1 for main text): the same layouts with tags, with classes, or bare."""
    semantic, classed = rng.random() < 0.6, rng.random() < 0.6
    word = lambda: "".join(rng.choice(("an", "the", "or", "ti", "en", "st", "ou", "re", "le", "mi")) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda a=4, b=70: say(a, b).capitalize() + rng.choice(".....!?")
    base, rows = (("html", None), ("body", None)), []
    misled = f"{rng.choice(_KINDS)}?" if rng.random() < 0.5 else None
    wrap = ((rng.choice(("div", "section", "main")), None),) if rng.random() < 0.4 else ()

    def add(tag, kind, leaf, text, label, link=0.0, keep_hint=None):
        tagged = semantic and tag != "div"
        hint = kind if (classed or not tagged if keep_hint is None else keep_hint) else None
        if misled and kind == "main":  # a name such as popular-science
            hint = misled
        elif hint and kind != "main" and rng.random() < 0.03:
            hint = f"{hint}?"
        outer = base + wrap + ((tag if tagged else "div", hint),)
        path = outer + ((leaf, None),) if leaf else outer
        if rng.random() < 0.15 and leaf:
            path = outer + (("div", None), (leaf, None))
        rows.append((path, text, int(len(text) * link), label))

    def some(p):
        return rng.random() < p

    if some(0.5):
        for _ in range(rng.randint(1, 2)):
            add("header", "head", rng.choice(("h1", "p", None)), say(1, 5), 0)
    for _ in range(rng.randint(0, 8)):
        add("nav", "menu", rng.choice(("li", "li", "li", None)), say(1, 3), 0, rng.choice((1.0, 1.0, 0.7)))
    if some(0.4):
        add("div", "notice", rng.choice(("p", None)), prose(5, 30), 0)
    for _ in range(rng.randint(0, 2)):
        add("div", "advert", rng.choice(("p", None)), prose(2, 14), 0)
    if some(0.85):
        bare = not semantic and some(0.3)
        main = lambda leaf, text, link=0.0: add("article" if some(0.8) else "main", "main", leaf, text, 1, link, False if bare else None)
        if some(0.25):  # a header of the article's own: heading, perhaps a standfirst
            box = (("article" if semantic else "div", misled or "main"), ("header", "head" if some(0.3) else None))
            rows.extend((base + box + ((leaf, None),), say(2, 9) if leaf == "h1" else prose(4, 20), 0, 1) for leaf in ("h1", "p")[: rng.randint(1, 2)])
        elif some(0.8):
            main(rng.choice(("h1", "h2")), say(2, 9) + rng.choice(("", ".")))
        for _ in range(rng.randint(1, 14)):
            main(rng.choices(("p", "h2", "h3", "li", "blockquote", "pre", "td", "figcaption", None), (20, 2, 1, 3, 1, 1, 1, 1, 1))[0], prose(1, rng.choice((3, 12, 40, 90))) if some(0.9) else " | ".join(say(1, 2) for _ in range(rng.randint(2, 9))), rng.choice((0, 0, 0, 0.2, 0.6)))
            if not bare and some(0.1):  # a list of links that belongs to the article
                for _ in range(rng.randint(2, 5)):
                    main("li", say(1, 6), 1.0)
            if some(0.08):
                x = rng.choice(("advert", "share", "side", "form", "notice"))
                tag = rng.choice(("div", "aside") if x != "form" else ("form", "div"))
                inner = (("article" if semantic else "div", misled or "main"), (tag, x if tag == "div" or some(0.5) else None))
                rows.append((base + inner + ((("p", None),) if some(0.6) else ()), prose(2, 12), 0, 0))
        if some(0.15):  # a footer of the article's own
            box = (("article" if semantic else "div", misled or "main"), ("footer", None))
            rows.append((base + box + (("p", None),), say(1, 6), 0, 0))
    for _ in range(rng.randint(0, 4)):
        add("aside", "side", rng.choice(("li", "p", "h3")), prose(2, 12), 0, rng.choice((0, 1.0)))
    if some(0.2):
        add("div", "share", "li", say(1, 3), 0, 1.0)
    if some(0.4):
        for _ in range(rng.randint(1, 5)):
            add(rng.choice(("section", "div", "ol")), "comment", rng.choice(("p", "li", "article")), prose(2, 40), 0, 0, True)
    if some(0.3):
        add("form", "form", rng.choice(("p", None)), say(1, 8), 0)
    if some(0.8):
        for _ in range(rng.randint(1, 3)):
            add("footer", "foot", rng.choice(("p", None, "li")), rng.choice(("© ", "")) + prose(2, 14), 0, rng.choice((0, 0, 1.0)))
    if some(0.1):  # nothing but text, with line breaks or paragraphs
        at = () if some(0.2) else rng.choice(((), base[1:], base)) + wrap + rng.choice(((), (("div", None),)))
        return [(at + ((leaf, None),) if leaf else at, prose(8, 200), 0, 1) for leaf in (("p",) * rng.randint(1, 6) if some(0.5) else (None,))]
    return rows or [(base + (("p", None),), prose(), 0, 1)]


@functools.lru_cache(4)
def trained(pages: int = 400, seed: int = 11, rounds: int = 150, ridge: float = 1e-3):
    """(weights of features for main text, transitions 2x2) by gradient ascent on the likelihood of ``pages`` labelled pages."""
    rng = random.Random(seed)
    made = [labelled_page(rng) for _ in range(pages)]
    feats = [[_path_features(p) + text_features(t, ln, k, len(rows)) for k, (p, t, ln, _) in enumerate(rows)] for rows in made]
    names = {f: i for i, f in enumerate(sorted({f for rows in feats for fs in rows for f in fs}))}
    size = max(map(len, made))
    x, y, on = np.zeros((pages, size, len(names)), np.float32), np.zeros((pages, size), int), np.zeros((pages, size), bool)
    for i, rows in enumerate(feats):
        for k, fs in enumerate(rows):
            x[i, k, [names[f] for f in fs]] = 1
            y[i, k], on[i, k] = made[i][k][3], True
    w, trans = np.zeros(len(names)), np.zeros((2, 2))
    flat, moments = x.reshape(-1, len(names)), [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[:, :-1][on[:, 1:]], y[:, 1:][on[:, 1:]]), 1)
    for r in range(1, rounds + 1):
        e = np.stack([np.zeros(y.shape), (flat @ w).reshape(y.shape)], 2)
        fwd, back = np.zeros(e.shape), np.zeros(e.shape)
        fwd[:, 0] = e[:, 0]
        for k in range(1, size):
            fwd[:, k] = e[:, k] + np.logaddexp(fwd[:, k - 1, 0, None] + trans[0], fwd[:, k - 1, 1, None] + trans[1])
        for k in range(size - 2, -1, -1):
            to = (e[:, k + 1] + back[:, k + 1])[:, None, :] + trans
            back[:, k] = np.where(on[:, k + 1, None], np.logaddexp(to[..., 0], to[..., 1]), 0)
        both = fwd + back
        p1 = np.where(on, np.exp(both[..., 1] - np.logaddexp(both[..., 0], both[..., 1])), 0)
        pair = fwd[:, :-1, :, None] + trans + (e + back)[:, 1:, None, :]
        norm = np.logaddexp(both[:, :1, 0], both[:, :1, 1])[..., None, None]
        expected = (np.exp(np.minimum(pair - norm, 0)) * on[:, 1:, None, None]).sum((0, 1))
        g = np.concatenate([flat.T @ (y * on - p1).ravel() / pages - ridge * w, ((gold - expected) / pages - ridge * trans).ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        step = 0.1 * (moments[0] / (1 - 0.9**r)) / (np.sqrt(moments[1] / (1 - 0.99**r)) + 1e-8)
        w, trans = w + step[:-4], trans + step[-4:].reshape(2, 2)
    return {f: float(w[i]) for f, i in names.items()}, trans.tolist()


def main_text(page: str | None, weights: dict[str, float], trans) -> str:
    """The blocks on the best path's main-text state, in page order, joined by one blank."""
    found = blocks(page)
    n, get = len(found), weights.get
    (t00, t01), (t10, t11) = trans
    a, b, back = 0.0, 0.0, []
    for k, (path, text, linked) in enumerate(found):
        e = sum([get(f, 0.0) for f in _path_features(path)]) + sum([get(f, 0.0) for f in text_features(text, linked, k, n)])
        if k:
            from0, from1 = b + t10 > a + t00, b + t11 >= a + t01
            back.append((from0, from1))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
        else:
            a, b = 0.0, e
    state, out = b >= a, []
    for k in range(n - 1, -1, -1):
        if state:
            out.append(found[k][1])
        if k:
            state = back[k - 1][1 if state else 0]
    return " ".join(reversed(out))


def extract_pages(pages: DataFrame, training_pages: int = 400) -> DataFrame:
    """page_id, url, text, n_chars of every page, whole pages without any cap.

    A header inside the article (its heading and standfirst) belongs to the article; a footer inside it doesn't. Formulas stay
    in their sentence. Null and empty pages, and pages without main text, give ''. Repeated rows give repeated rows; null ids and urls stay
    null. Other columns are ignored. The model is trained on ``training_pages`` made, labelled pages.
    """
    weights, trans = trained(training_pages)

    def run(batches):
        for b in batches:
            texts = [main_text(x, weights, trans) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
