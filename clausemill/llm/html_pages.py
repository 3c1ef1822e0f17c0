"""Made pages with known main text, to train and to test the extraction on.

Layouts, element names and the furniture around the article vary from page to page; words are made up from
random letters, so a model cannot learn them.
"""

from __future__ import annotations

import html
import random


def _word(r: random.Random) -> str:
    return "".join(r.choice("aeioulnrstdmcpbgé") for _ in range(r.randint(2, 10)))


def sentence(r: random.Random, low: int = 3, high: int = 25) -> str:
    text = " ".join(_word(r) for _ in range(r.randint(low, high)))
    return text[0].upper() + text[1:] + r.choice(["."] * 8 + ["!", "?", "", " &", " – x."])


def prose(r: random.Random) -> str:
    return " ".join(sentence(r) for _ in range(r.choice([1, 1, 2, 3, 4, 6])))


def _attribute(r: random.Random, names: list[str]) -> str:
    name = r.choice(names)
    return "" if not name else f' {r.choice(["class", "class", "id"])}="{name}"'


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{_word(r)}">{" ".join(_word(r) for _ in range(r.choice([1, 1, 2, 5])))}</a></li>' for _ in range(n))


def _furniture(r: random.Random, kind: str) -> str:
    if kind == "nav":
        tag, names = r.choice([("nav", ["", "main-nav", "site-menu"]), ("div", ["nav", "menu", "breadcrumbs", "navbar top"])])
        return f"<{tag}{_attribute(r, names)}><ul>{_links(r, r.randint(2, 9))}</ul></{tag}>"
    if kind == "header":
        tag, names = r.choice([("header", ["", "site-header"]), ("div", ["header", "masthead", "topbar", "banner"])])
        return f"<{tag}{_attribute(r, names)}>{r.choice(['<h1>', '<p>', '<div>'])}{sentence(r, 1, 5)}{r.choice(['', '<p>' + sentence(r, 2, 8) + '</p>'])}</{tag}>"
    if kind == "footer":
        tag, names = r.choice([("footer", ["", "site-footer"]), ("div", ["footer", "colophon", "site-info legal"])])
        return f"<{tag}{_attribute(r, names)}>{r.choice(['&copy; ', 'Copyright © ', ''])}{_word(r)}.example &middot; {prose(r)}{r.choice(['', '<ul>' + _links(r, 3) + '</ul>'])}</{tag}>"
    if kind == "side":
        tag, names = r.choice([("aside", ["", "sidebar"]), ("div", ["sidebar", "widget related", "right-rail", "related-posts"])])
        return f"<{tag}{_attribute(r, names)}><h3>{sentence(r, 1, 3)}</h3>{r.choice(['<p>' + prose(r) + '</p>', '<ul>' + _links(r, 4) + '</ul>'])}</{tag}>"
    if kind == "ad":
        return f'<{(t := r.choice(["div", "div", "section", "aside"]))}{_attribute(r, ["ad", "ads", "advert", "sponsored", "ad-banner", "ad slot"])}>{prose(r)}</{t}>'
    if kind == "talk":
        tag, names = r.choice([("div", ["comments", "comment-list", "disqus", "replies"]), ("section", ["comments", "discussion", "responses"])])
        each = "".join(f"<{(t := r.choice(['p', 'div', 'li', 'article']))}{r.choice(['', ' class=comment'])}>{prose(r)}</{t}>" for _ in range(r.randint(1, 6)))
        return f"<{tag}{_attribute(r, names)}><h2>{sentence(r, 1, 3)}</h2>{each}</{tag}>"
    if kind == "notice":
        tag = r.choice(["div", "div", "section", "dialog"])
        return f'<{tag}{_attribute(r, ["cookie-banner", "notice", "cookie-consent", "newsletter", "popup modal", "alert", "gdpr"])}>{r.choice(["<p>", ""])}{prose(r)}<button>{_word(r)}</button></{tag}>'
    if kind == "form":
        return f'<form{_attribute(r, ["", "search", "login", "contact"])}><label>{sentence(r, 1, 4)}</label><input name="q">{r.choice(["", "<p>" + prose(r) + "</p>"])}<button>{_word(r)}</button></form>'
    return f'<div{_attribute(r, ["share", "social", "share-buttons"])}><a href="#">{_word(r)}</a> <a href="#">{_word(r)}</a></div>'


def labelled_page(r: random.Random) -> tuple[str, set[str]]:
    """A page and the texts of the blocks of its article."""
    texts: set[str] = set()

    def own(text: str) -> str:
        texts.add(" ".join(text.split()))
        return html.escape(text, quote=r.random() < 0.5)

    body = [f"<h1>{own(sentence(r, 2, 12))}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice([1, 2, 4, 8, 16])):
        kind = r.random()
        if kind < 0.72:
            text = own(prose(r))
            body.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"]))
        elif kind < 0.8:
            body.append(f"<h2>{own(sentence(r, 1, 6))}</h2>")
        elif kind < 0.87:
            body.append("<ul>" + "".join(f"<li>{own(sentence(r, 2, 10))}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
        elif kind < 0.91:
            body.append(f"<blockquote>{own(prose(r))}</blockquote>")
        elif kind < 0.95:
            a, b, c = (" ".join(_word(r) for _ in range(r.randint(1, 8))) for _ in range(3))
            own(f"{a} {b} {c}")
            body.append(f'<p>{a} <a href="/x">{b}</a> {c}</p>')
        else:
            body.append(_furniture(r, r.choice(["ad", "side", "share", "form", "notice", "talk", "nav"])))
    inner = "".join(body)
    wrap = r.random()
    if wrap < 0.55:
        main = f"<article{_attribute(r, ['', '', 'post', 'story'])}>{inner}</article>"
    elif wrap < 0.75:
        main = f"<main{_attribute(r, ['', 'content'])}>{inner}</main>"
    else:
        main = f"<div{_attribute(r, ['content', 'post-content', 'entry', 'article-body', 'main', 'story', 'page-content'])}>{inner}</div>"
    before = [_furniture(r, k) for k in ("header", "nav", "ad", "notice", "form", "side", "share") if r.random() < (0.6 if k in ("header", "nav") else 0.25)]
    after = [_furniture(r, k) for k in ("share", "ad", "side", "talk", "form", "notice", "nav", "footer") if r.random() < (0.75 if k == "footer" else 0.3)]
    r.shuffle(before)
    if r.random() < 0.2:
        main = f'<div class="wrapper">{main}</div>'
    page = f'<!DOCTYPE html><html><head><title>{sentence(r)}</title><style>p{{margin:0}}</style><script>var t="</p>";x({r.randint(0, 9)});</script></head><body>'
    page += "".join(before) + f"<!-- {_word(r)} -->" + main + "".join(after)
    return page + r.choice(["</body></html>", "", "</body>"]), texts
