"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Each block has features of its own words and of the elements above it; the field adds weights for the label
of the block before. It is fitted on labelled pages (by default ones made by ``html_pages``, whose number is a
documented bound) by stochastic gradient steps on the likelihood, with forward-backward sums, and decoded by
Viterbi. Pages are independent rows: nothing is shuffled, and the model is a small table of weights.

Defined results for odd input: a null or empty page, or one without main text, gives the empty text; pages of
any length are read whole, in time that grows with them at any depth; bytes that are not UTF-8 become U+FFFD; equal rows give equal results, row by row; an empty table gives an empty table;
other columns pass through untouched, whatever their names, but for one named as ``out`` in any case of letters,
which it replaces.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausemill.llm.columns import Passing, utf8
from clausemill.llm.html_blocks import HEADINGS, Above, Block, blocks_of

#: Words in class and id names, by what they announce.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs skip",
    "head": "header masthead banner topbar logo site-title hero-nav branding",
    "foot": "footer colophon copyright legal site-info bottom",
    "side": "sidebar aside side rail widget related recommended popular trending more-stories see-also teaser promo",
    "ad": "ad ads advert advertisement sponsor sponsored dfp adsense banner-ad outbrain taboola promoted",
    "talk": "comment comments reply replies respond discussion disqus thread reviews responses",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall toast announcement",
    "share": "share sharing social follow tweet like",
    "form": "form search login register contact-form",
    "meta": "byline author date meta tags tag category timestamp",
    "main": "article content post entry story main body text page-content post-content entry-content article-body prose",
}
_KIND = {w: kind for kind, ws in NAMES.items() for w in ws.split()}
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_STATE = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "table", "ul", "ol", "button", "fieldset", "address", "dialog", "figure", "blockquote", "menu")


def named_kinds(names: str) -> set[str]:
    kinds = set()
    for word in _WORD.findall(names.replace("_", "-")):
        if word in _KIND:
            kinds.add(_KIND[word])
        else:
            kinds.update(_KIND[p] for p in word.split("-") if p in _KIND)
    if "hidden" in names.split():
        kinds.add("hidden")
    return kinds


@dataclass(frozen=True)
class _Told:
    """What the elements above a block add: the innermost telling tag, the known tags, the kinds of names, and the nearest ones."""

    tag: str = "none"
    tags: frozenset = frozenset()
    kinds: frozenset = frozenset()
    nearest: tuple[str, ...] = ()


_NONE, _KNOWN_TAGS = _Told(), frozenset(_STATE) | HEADINGS


def told_by(above: Above | None) -> _Told:
    """What an element and those above it add; each element is looked at once, and sets that do not change are shared."""
    todo = []
    while above is not None and above.told is None:
        todo.append(above)
        above = above.parent
    told = _NONE if above is None else above.told
    for node in reversed(todo):
        kinds = named_kinds(node.names) if node.names else frozenset()
        told = node.told = _Told(
            told.tag if node.tag in ("div", "span", "body", "html") else node.tag,
            told.tags if node.tag in told.tags or node.tag not in _KNOWN_TAGS else told.tags | {node.tag},
            told.kinds if told.kinds >= kinds else told.kinds | kinds,
            tuple(sorted(kinds)) or told.nearest,
        )
    return told


def features(block: Block) -> list[str]:
    """The features of one block."""
    text, told = block.text, told_by(block.above)
    n = text.count(" ") + 1
    share = block.link_chars / len(text)
    out = [
        "bias",
        f"words{min(n.bit_length(), 7)}",
        "links" + ("0" if share == 0 else "1" if share < 0.34 else "2" if share < 0.8 else "3"),
        "end." if text[-1] in ".!?…:”\"'»)" else "end-",
        f"tag:{told.tag}",
    ]
    above = told.tags
    out += [f"in:{t}" for t in _STATE if t in above]
    if not above & {"article", "main"}:
        out.append("no-article")
    out += sorted(f"name:{k}" for k in told.kinds)
    out += [f"near:{k}" for k in told.nearest]
    if "©" in text or "(c)" in text.lower():
        out.append("copyright")
    if above & HEADINGS:
        out.append("heading-in" if above & {"article", "main"} else "heading-out")
    return out


Weights = dict[str, tuple[float, float]]


def _potentials(rows: list[list[str]], emit: Weights) -> list[tuple[float, float]]:
    none = (0.0, 0.0)
    out = []
    for fs in rows:
        a = b = 0.0
        for f in fs:
            w = emit.get(f, none)
            a += w[0]
            b += w[1]
        out.append((a, b))
    return out


def _log_add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def viterbi(rows: list[list[str]], emit: Weights, move: list[list[float]]) -> list[int]:
    """The most likely labels (0 other, 1 main text) of a page's blocks."""
    if not rows:
        return []
    scores = _potentials(rows, emit)
    a, b = scores[0]
    back = []
    for s, t in scores[1:]:
        aa, ba, ab, bb = a + move[0][0], b + move[1][0], a + move[0][1], b + move[1][1]
        back.append((int(ba > aa), int(bb > ab)))
        a, b = max(aa, ba) + s, max(ab, bb) + t
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> tuple[Weights, list[list[float]]]:
    """Weights that make the labels of the pages likely: AdaGrad steps, a page at a time."""
    emit: dict[str, list[float]] = {}
    scale: dict[str, list[float]] = {}
    move, move_scale = [[0.0, 0.0], [0.0, 0.0]], [[1e-6, 1e-6], [1e-6, 1e-6]]
    order, rng = list(range(len(pages))), random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for k in order:
            rows, labels = pages[k]
            if not rows:
                continue
            scores = _potentials(rows, emit)
            forward = [list(scores[0])]
            for s in scores[1:]:
                p = forward[-1]
                forward.append([_log_add(p[0] + move[0][y], p[1] + move[1][y]) + s[y] for y in (0, 1)])
            backward = [[0.0, 0.0]]
            for s in reversed(scores[1:]):
                q = backward[-1]
                backward.append([_log_add(move[x][0] + s[0] + q[0], move[x][1] + s[1] + q[1]) for x in (0, 1)])
            backward.reverse()
            total = _log_add(*forward[-1])
            for i, fs in enumerate(rows):
                main = math.exp(forward[i][1] + backward[i][1] - total)
                step = labels[i] - main
                for f in fs:
                    w, g = emit.setdefault(f, [0.0, 0.0]), scale.setdefault(f, [1e-6, 1e-6])
                    for y, d in ((0, -step), (1, step)):
                        d -= decay * w[y]
                        g[y] += d * d
                        w[y] += rate * d / math.sqrt(g[y])
            for x in (0, 1):
                for y in (0, 1):
                    d = -decay * move[x][y]
                    for i in range(1, len(rows)):
                        d += (labels[i - 1] == x and labels[i] == y) - math.exp(forward[i - 1][x] + move[x][y] + scores[i][y] + backward[i][y] - total)
                    move_scale[x][y] += d * d
                    move[x][y] += rate * d / math.sqrt(move_scale[x][y])
    return {f: (w[0], w[1]) for f, w in emit.items()}, move


def default_model(training_pages: int = 500, seed: int = 7) -> tuple[Weights, list[list[float]]]:
    """The field fitted on ``training_pages`` made pages."""
    from clausemill.llm.html_pages import labelled_page

    rng = random.Random(seed)
    pages = []
    for _ in range(training_pages):
        page, texts = labelled_page(rng)
        blocks = blocks_of(page)
        pages.append(([features(b) for b in blocks], [int(b.text in texts) for b in blocks]))
    return fit(pages, seed=seed)


def main_text(page: str | None, model: tuple[Weights, list[list[float]]]) -> str:
    blocks = blocks_of(page or "")
    labels = viterbi([features(b) for b in blocks], *model)
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, html: str = "html", out: str = "text", model: tuple[Weights, list[list[float]]] | None = None) -> DataFrame:
    """The pages with their main text in place of the html, in column ``out``."""
    model = model or default_model()
    passing = Passing(pages, [out], without=[html])
    n = len(passing.kept)
    source = passing.inner.select(*passing.kept, utf8(F.col(passing.inside(html))).alias("page"))
    schema = T.StructType(source.schema.fields[:n] + [T.StructField(out, T.StringType())])
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = pa.array([main_text(x.as_py(), known) for x in batch.column(n)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], texts], names=schema.names)

    return passing.outer(source.mapInArrow(run, schema), out)
