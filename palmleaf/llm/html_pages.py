"""Labelled pages that train the extraction model.

A page is written as nested tuples ``(label, tag, attributes, children)``; a
child is another tuple or a text.  ``label`` is 1 for an element whose own text
belongs to the main text.  The pages cover the layouts that the model has to
tell apart; the texts are fillers of a given length.
"""

from __future__ import annotations

_FILL = "palm leaves carry lines of ink that readers copy with patience and care every season "


def text(n: int) -> str:
    return (_FILL * (n // len(_FILL) + 1))[:n]


def yes(tag, *children, **attrs):
    return (1, tag, attrs, children)


def no(tag, *children, **attrs):
    return (0, tag, attrs, children)


def links(n: int, size: int = 8):
    return [no("li", no("a", text(size))) for _ in range(n)]


def paragraphs(n: int, size: int = 220):
    out = []
    for k in range(n):
        length = max(6, size * (k % 4 + 1) // 3)
        if k % 5 == 1:
            out.append(yes("p", yes("b", text(length), yes("br"))))
        elif k % 5 == 2:
            out.append(yes("p", text(length), yes("a", text(9)), text(40)))
        elif k % 5 == 3:
            out.append(yes("p", yes("em", text(12)), text(length)))
        else:
            out.append(yes("p", text(length)))
    return out


def article_parts(n: int):
    return [
        yes("h1", text(40)),
        *paragraphs(n),
        yes("h2", text(25)),
        yes("ul", yes("li", text(60)), yes("li", text(30)), yes("li", yes("a", text(20)), text(30))),
        *paragraphs(n),
        yes("blockquote", yes("p", text(150))),
        yes("table", yes("tbody", yes("tr", yes("td", text(12)), yes("td", text(8))), yes("tr", yes("td", text(9)), yes("td", text(30))))),
        yes("figure", no("img"), yes("figcaption", text(45))),
        yes("pre", yes("code", text(80))),
        yes("div", yes("p", text(200)), yes("span", text(30))),
        yes("section", yes("h3", text(20)), yes("p", text(180))),
        yes("ol", yes("li", text(90)), yes("li", text(50))),
        yes("dl", yes("dt", text(12)), yes("dd", text(60))),
    ]


def inside():
    """What an article may hold that is not main text."""
    return [
        no("div", text(60), **{"class": "ad"}),
        no("div", no("p", text(180)), **{"class": "advert sponsored"}),
        no("aside", no("h3", text(15)), no("p", text(140)), no("ul", *links(3, 25))),
        no("form", no("label", text(12)), no("input"), no("p", text(30)), no("p", text(90)), no("button", text(6))),
        no("form", no("p", text(12)), no("div", no("label", text(10)), no("input")), no("p", text(160), no("a", text(9)))),
        no("div", no("p", text(120)), no("button", text(6)), **{"class": "cookie-notice"}),
        no("section", no("h2", text(10)), no("div", no("p", text(260)), no("span", text(12)), **{"class": "comment"}),
           no("div", no("p", text(90)), no("p", text(300)), **{"class": "comment"}), **{"class": "comments", "id": "comments"}),
        no("div", no("a", text(6)), no("a", text(7)), **{"class": "share social"}),
        no("div", no("h3", text(12)), no("ul", *links(4, 40)), **{"class": "related"}),
        no("nav", no("a", text(10)), no("a", text(10))),
        no("footer", no("p", text(60)), no("a", text(12))),
    ]


def header():
    return no("header", no("div", no("a", text(12)), **{"class": "logo"}), no("h2", text(14)), no("p", text(50)), no("nav", no("ul", *links(5))))


def footer():
    return no("footer", text(70), no("p", text(120)), no("a", text(9)), no("ul", *links(3)))


def pages() -> list[tuple]:
    out = []
    for n in (1, 3, 6):
        out += [
            no("body", no("nav", no("ul", *links(6))), no("div", text(50), **{"class": "ad"}), yes("article", *article_parts(n)), footer()),
            no("body", no("nav", no("ul", *links(4))), no("div", text(50), **{"class": "ad"}), yes("article", yes("h1", text(40)), *paragraphs(n)), footer()),
            no("body", no("nav", no("ul", *links(4))), no("div", text(90), **{"class": "ad"}), yes("article", yes("h1", text(40)), yes("p", text(8))), footer()),
            no("body", header(), yes("main", yes("article", *article_parts(n), *inside())), no("aside", no("p", text(150)), no("ul", *links(4)), **{"class": "sidebar"}), footer()),
            no("body", header(), no("div", yes("div", *article_parts(n), *inside(), **{"class": "post-content entry"}),
               no("div", no("h3", text(12)), no("p", text(160)), *links(4), **{"class": "sidebar"}), **{"class": "wrapper"}), footer()),
            no("body", no("div", *links(5), **{"class": "menu"}), no("div", no("p", text(130)), **{"class": "banner notice"}),
               yes("div", *article_parts(n), **{"id": "content", "class": "main"}), *inside()[6:7], no("div", no("p", text(150)), **{"class": "footer", "id": "footer"})),
            no("body", header(), yes("main", *article_parts(n)), *inside()[:7], footer()),
            no("body", no("div", no("ul", *links(6)), **{"id": "nav"}), no("div", no("div", yes("div", yes("div", yes("h1", text(30)), *paragraphs(n), **{"class": "text"}), **{"class": "story"}))),
               no("div", *links(6, 30), no("p", text(110)), **{"id": "sidebar"}), footer()),
        ]
    out.append(no("body", no("ul", *links(5)), yes("h1", text(30)), *paragraphs(6), no("div", text(60), **{"class": "footer"})))
    out.append(no("body", no("nav", *links(6)), no("header", no("h1", text(20))), no("form", no("input"), no("p", text(40))), footer()))
    out.append(no("body", yes("article", yes("header", yes("h1", text(30)), no("p", text(14), **{"class": "byline meta"})), *paragraphs(4), no("div", no("p", text(70)), **{"class": "newsletter subscribe"}))))
    return out
