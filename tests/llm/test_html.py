"""Main-text extraction: labelled layouts, hostile pages, and what readers of the rows rely on."""

import time

import pytest

from tidewatch.llm import htmltext

A = "The first paragraph of the article, which has some commas, and is long enough to be read as prose by anyone."
B = "A second paragraph follows it, with other words, more commas, and a proper end of the sentence that it makes."
LINKS = "".join(f'<li><a href="/{i}">Another headline number {i} of the site</a></li>' for i in range(8))

LAYOUTS = {
    "article": (f"<body><nav>{LINKS}</nav><article><h1>Title</h1><p>{A}</p><p>{B}</p></article><footer>end</footer>", ["Title", A, B]),
    "main": (f"<header><h1>Site</h1></header><main><h1>Title</h1><p>{A}</p><p>{B}</p></main><aside>{A}</aside>", ["Title", A, B]),
    "header in the article": (f'<main><h1 class="article-header">Title</h1><p>{A}</p><p>{B}</p></main>', ["Title", A, B]),
    "header part": (f'<main><div class="post-header"><h1>Title</h1><p>By someone</p></div><p>{A}</p></main>', ["Title", "By someone", A]),
    "related prose": (f'<article><p>{A}</p><div class="related-work"><h2>Related work</h2><p>{B}</p></div></article>', [A, "Related work", B]),
    "related links": (f'<article><p>{A}</p><p>{B}</p><div class="related"><h2>Read on</h2><ul>{LINKS}</ul></div></article>', [A, B]),
    "a wrapper with a sidebar": (f'<div class="layout has-sidebar"><div class="content"><p>{A}</p><p>{B}</p></div></div>', [A, B]),
    "a wrapper without one": (f'<body class="sidebar-left"><div class="no-sidebar"><p>{A}</p><p>{B}</p></div>', [A, B]),
    "comments named on the wrapper": (f'<div class="post has-comments"><p>{A}</p><p>{B}</p></div>', [A, B]),
    "a widget wrapper": (f'<div class="container widget"><article><p>{A}</p><p>{B}</p></article></div>', [A, B]),
    "a sidebar wrapper of the article": (f'<div id="sidebarPage"><div><article><p>{A}</p></article></div><div class="sidebar"><p>{B}</p></div></div>', [A]),
    "tags": (f'<div class="post tag-alert category-comments"><p>{A}</p><p>{B}</p></div>', [A, B]),
    "ad free": (f'<div class="ad-free"><p>{A}</p><p>{B}</p></div>', [A, B]),
    "adverts": (f'<article><p>{A}</p><div class="ad">Buy, buy, buy this very fine thing now, and a second one, for less than nothing at all.</div><p>{B}</p></article>', [A, B]),
    "inline adverts": (f'<article><p>{A} <span class="sponsored">Buy it.</span></p><p>{B}</p></article>', [A, B]),
    "comments": (f'<article><p>{A}</p><p>{B}</p></article><div id="comments"><article class="comment"><p>{B}</p></article><article class="comment"><p>{A}</p></article></div>', [A, B]),
    "comments in the article": (f'<article><p>{A}</p><section class="comments-area"><h3>Two comments</h3><p>{B}</p></section></article>', [A]),
    "cookie notice": (f'<div class="cookie-notice"><p>{B}</p></div><div><p>{A}</p><p>{B}</p></div>', [A, B]),
    "newsletter": (f'<main><p>{A}</p><div class="newsletterSignup"><p>{B}</p></div></main>', [A]),
    "alert": (f'<main><p>{A}</p><div class="alert">Saved.</div><p>{B}</p></main>', [A, B]),
    "hidden": (f'<main><p>{A}</p><div hidden><p>{B}</p></div><div style="display: none"><p>{B}</p></div></main>', [A]),
    "sections": (f"<article><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2><p>{B}</p></section></article>", ["One", A, "Two", B]),
    "siblings": (f"<div><div><p>{A}</p><p>{B}</p><p>{A}</p></div><div><p>{B}</p></div><div><ul>{LINKS}</ul></div></div>", [A, B, A, B]),
    "nothing but marked parts": (f'<div class="sidebar"><p>{A}</p><p>{B}</p></div>', [A, B]),
    "table": (f"<article><p>{A}</p><table><tr><td>one<td>two</table></article>", [A, "one", "two"]),
    "quotes in values": (f"<article><p title='a > b' data-x=it's>{A}</p><img alt=\"<p>no</p>\"><p>{B}</p></article>", [A, B]),
    "a topic named by a mark": (f'<article><p>{A}</p><div class="notice-board-history"><p>{B}</p></div><div class="share-price-analysis"><p>{A}</p></div></article>', [A, B, A]),
    "a story and a piece": (f'<main><p>{A}</p><div id="banner-story"><p>{B}</p></div><div class="comment-piece"><h2>Piece</h2><p>{A}</p></div></main>', [A, B, "Piece", A]),
    "an article that is a comment piece": (f'<article class="comment-piece"><p>{A}</p><p>{B}</p></article>', [A, B]),
    "a topic of links only": (f'<article><p>{A}</p><p>{B}</p><div class="share-price-links-page"><ul>{LINKS}</ul></div></article>', [A, B]),
    "pieces of a page": (f'<article><p>{A}</p><div class="share-buttons"><p>{B}</p></div><div class="comment-body-text"><p>{B}</p></div><div class="notice-bar-1"><p>{B}</p></div><div id="site-notice"><p>{B}</p></div><p>{B}</p></article>', [A, B]),
    "adverts by any name": (f'<article><p>{A}</p><div class="ad-campaign"><p>{B}</p></div><div class="sponsored-story"><p>{B}</p></div><div class="ad-banner-story"><p>{B}</p></div></article>', [A]),
    "references": (f"<article><p>{A} &#0065;&#x42;&#99999999999;&nbsp;&amp;lt;</p></article>", [A + " AB� &lt;"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    source, blocks = LAYOUTS[name]
    assert htmltext.main_text(source).split("\n\n") == blocks


M = 1 << 20
HOSTILE = {
    "open tags": "<a " * (M // 3) + '"', "open quotes": '<a x="' * (M // 6), "both quotes": "<a x='" * (M // 12) + '<b y="' * (M // 12), "comments": "<!--" * (M // 4), "less than": "<" * M,
    "open elements": "<div>" * 100_000 + "x", "blocks in open elements": "<div>" * 100_000 + "<p>x" * 50_000, "stray ends": "<b>" * 100_000 + "x</div>" * 100_000, "open lists": "<ul>" * 100_000 + "<li>x" * 50_000,
    "digits": "&#" + "9" * M, "zeros": "&#" + "0" * M + "65;", "classes": '<div class="' + "ad-" * (M // 4) + '">x', "styles": "<p " + 'style="' * (M // 8) + ">", "blanks": "<p class" + " " * M, "scripts": "<script>" * (M // 8),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.process_time()
    assert isinstance(htmltext.main_text(HOSTILE[name]), str)
    assert time.process_time() - began < 4  # under two seconds on an idle machine; the old reader took minutes


def test_elements_far_up_are_closed():
    """An open list item is closed by the next one, however many elements are open in between."""
    page = htmltext.Page("<ul><li>" + "<b>" * 300 + "one<li>two</ul>")
    items = [e for e, name in enumerate(page.name) if name == "li"]
    assert len(items) == 2 and page.parent[items[0]] == page.parent[items[1]]


def plain(source):
    """The same rules on a well-formed page, read by another parser, told anew for every element and block: in quadratic time."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(source)
    up = {child: element for element in root.iter() for child in element}
    above = lambda e: [] if e not in up else [up[e], *above(up[e])]
    order = list(root.iter())
    within = lambda e, other: e is other or other in above(e)
    mark = {e: htmltext._marks(e.tag, "".join(f' {k}="{v}"' for k, v in e.attrib.items())) for e in order}
    found = []  # element, text, characters in links

    def walk(e, linked):
        if e.tag in htmltext.BLOCK:
            found.append([e, "", 0])
        for text, inside in [(e.text, linked or e.tag == "a"), *((c, None) for c in e)]:
            if inside is None:
                walk(text, linked or e.tag == "a")
                if text.tag in htmltext.BLOCK:
                    found.append([next(x for x in [e, *above(e)] if x.tag in htmltext.BLOCK), "", 0])
                text, inside = text.tail, linked or e.tag == "a"
            if text and not any(x.tag in htmltext.NEVER or x.tag not in htmltext.BLOCK and mark[x] == 2 for x in [e, *above(e)]):
                found[-1][1] += text
                found[-1][2] += len(text) if inside else 0

    walk(root, False)
    blocks = [(e, " ".join(t.split()), n) for e, t, n in found if t.split()]
    blocks = [(e, t, min(n, len(t))) for e, t, n in blocks]

    def best(heed):
        def gone(e):
            if e.tag in htmltext.NEVER or e.tag == "header" and not any(x.tag in ("article", "main") for x in above(e)):
                return True
            inside = [b for b in blocks if within(b[0], e)]
            chars, linked = sum(len(t) for _, t, _ in inside), sum(n for _, _, n in inside)
            good = any(len(t) >= htmltext.PROSE or b.tag in htmltext.HEADINGS for b, t, _ in inside) and linked < htmltext.LINKS * max(chars, 1)
            holder = any(x is not e and within(x, e) and (x.tag == "h1" or x.tag in ("article", "main") and mark[x] < 2) for x in order)
            return heed and e.tag in htmltext.BLOCK and not holder and (mark[e] == 2 or mark[e] == 1 and not good)

        out = {e for e in order if any(gone(x) for x in [e, *above(e)])}
        kept = [b for b in blocks if b[0] not in out]
        points, scores = dict.fromkeys(order, 0.0), {}
        for e, text, _ in kept:
            line = ([e, *above(e)] if e.tag not in htmltext.LEAVES or e not in up else above(e))[:4]
            for part, x in enumerate(line, 1):
                points[x] += (0.5 if e.tag in htmltext.HEADINGS else 1 + text.count(",") + min(len(text) / 100, 3)) / part
        share = {}
        for e in order:
            inside = [b for b in kept if within(b[0], e)]
            chars = sum(len(t) for _, t, _ in inside)
            share[e] = sum(n for _, _, n in inside) / chars if chars else None
            scores[e] = (points[e] + htmltext.START.get(e.tag, 0)) * (1 - share[e]) if points[e] and chars and e not in out else 0.0
        top = max(order, key=lambda e: (scores[e], order.index(e)))
        if scores[top] <= 0:
            return []
        chosen = {top}
        for e in up.get(top, ()):
            own = " ".join(t for b, t, _ in kept if b is e)
            if e not in out and share[e] is not None and e is not top:
                reads = e.tag in htmltext.LEAVES and (share[e] < htmltext.LINKS and len(own) > 80 or not share[e] and (e.tag == "h1" or own[-1:] in ".!?"))
                if scores[e] >= scores[top] / 5 or reads:
                    chosen.add(e)
        return [t for b, t, _ in kept if any(within(b, c) for c in chosen)]

    return "\n\n".join(best(True) or best(False))


def test_equals_a_plain_reading_of_well_formed_pages():
    import random

    rng, kept = random.Random(5), 0
    labels = ["", "", "", "", ' class="ad"', ' class="related"', ' id="comments"', ' class="share-price-history"', ' class="post-header main"', ' class="has-sidebar"']
    words = ["one", "two,", "three", "four.", "five,", "six"]

    def some(depth):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 0, 1, 4, 30])))
        if depth == 0 or rng.random() < 0.15:
            return text
        tag = rng.choice(["div", "div", "section", "article", "p", "p", "ul", "h1", "h2", "a", "span", "nav", "header", "blockquote", "main", "footer"])
        if tag in ("p", "h1", "h2", "a", "span"):
            inner = "".join(f"<a>{rng.choice(words)}</a> {rng.choice(words)} " if rng.random() < 0.3 else text for _ in range(rng.randint(1, 2)))
        elif tag == "ul":
            inner = "".join(f"<li>{text} <a>{rng.choice(words)}</a></li>" for _ in range(rng.randint(1, 4)))
        else:
            inner = text + "".join(some(depth - 1) + " " for _ in range(rng.randint(1, 4)))
        return f"<{tag}{rng.choice(labels)}>{inner}</{tag}>{text if rng.random() < 0.2 else ''}"

    for i in range(400):
        page = f"<html><body>{''.join(some(4) for _ in range(rng.randint(1, 4)))}</body></html>"
        got = htmltext.main_text(page)
        kept += bool(got)
        assert got == plain(page), page
    assert kept > 200
