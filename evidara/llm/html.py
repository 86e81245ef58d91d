"""HTML extraction: a linear-chain CRF over the leaf blocks of a page's DOM.

A page is read into leaf blocks (runs of text between block-level tags) with
their ancestors.  Each block has features from its ancestors' tags and class
names and from its text; a two-state chain (main text or not) is trained on
labelled pages by gradient ascent on the exact log-likelihood (forward-backward)
and decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Left out unread: scripts, styles, templates and form controls.
RAW = frozenset("script style template textarea select option".split())
# Elements of formulas and drawings; their texts belong to the text around them.
MATH_SVG = frozenset(
    "math semantics annotation annotation-xml mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose merror maction "
    "svg g defs symbol use desc text tspan textpath path line polyline polygon rect circle ellipse image marker pattern mask clippath lineargradient radialgradient stop filter foreignobject".split()
)
INLINE = MATH_SVG | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"]),
}
# Words in class and id attributes that tell parts of a page.
HINTS = frozenset(
    "ad ads advert advertisement promo promoted sponsor sponsored banner cookie cookies consent notice alert message gdpr popup modal overlay comment comments reply replies disqus discussion "
    "nav menu navbar navigation breadcrumb breadcrumbs sidebar side aside related widget footer header masthead top bottom share social newsletter subscribe signup login form search copyright legal "
    "content article post entry main story body text page paragraph lead headline title".split()
)
#: Elements that tell a part of the page by themselves.
SECTIONS = frozenset("nav header footer aside article main form head section".split())
# Names of elements that can hold blocks; others give no feature of their own.
KNOWN = MATH_SVG | INLINE | SECTIONS | frozenset(CLOSED_BY) | frozenset("html body div address blockquote details dialog dir dl fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup menu ol pre summary table tbody tfoot thead ul title caption colgroup button label legend output progress meter object noscript canvas video audio iframe search center".split())
# A quote that nothing closes is a stray character of its tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>?", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACE = re.compile(r"\s+")
_PIECE = re.compile(r"[a-z]+")


def _hints(attributes: str) -> tuple[str, ...]:
    out = []
    for _, value in _ATTRIBUTE.findall(attributes):
        out += [w for w in _PIECE.findall(value.lower()) if w in HINTS]
    return tuple(dict.fromkeys(out))


class Open:
    """An open element and what its ancestors tell, kept so that no block reads them again.

    Inline elements without hints tell nothing.  ``block`` is the tag of the
    innermost element that is not inline.
    """

    __slots__ = ("block", "hints", "near", "own", "parent", "said", "tag", "tags")

    def __init__(self, tag: str, hints: tuple[str, ...], parent: Open | None):
        self.tag, self.parent, self.said = tag, parent, None
        self.own, self.tags, self.hints, self.near, self.block = (parent.own, parent.tags, parent.hints, parent.near, parent.block) if parent else ("none", frozenset(), frozenset(), None, None)
        if tag not in INLINE:
            self.block = tag
        if tag in INLINE and not hints:
            return
        self.own = tag
        if tag in KNOWN and tag not in self.tags:
            self.tags |= {tag}
        if not self.hints.issuperset(hints):
            self.hints |= set(hints)
        if hints:
            self.near = hints[0]
        elif tag in SECTIONS:
            self.near = tag

    def features(self) -> list[str]:
        """In a fixed order, as their weights are summed."""
        if self.said is None:
            self.said = ["bias", f"own={self.own}", *(f"in={t}" for t in sorted(self.tags) if t not in ("html", "body")), *(f"hint={h}" for h in sorted(self.hints))]
            # The innermost part of the page that its name or tag tells.
            if self.near:
                self.said.append(f"near={self.near}")
        return self.said


_ROOT = Open("", (), None)
_ROOT.own, _ROOT.block, _ROOT.tags = "none", None, frozenset()


def leaf_blocks(html: str) -> list[tuple[Open, str, int]]:
    """The leaf blocks of a page in order: (innermost open element, text, characters inside links).

    Character references are decoded, white space runs are one space, blocks
    without text are left out.  Unclosed and stray tags are mended the way
    browsers mostly do.  The time is linear in the page's length, however deep
    its tags are nested.
    """
    blocks, stack, texts = [], [_ROOT], []
    count: Counter = Counter()  # open elements by tag
    endless: set[str] = set()  # raw tags without a further end tag
    held = 0

    def flush():
        nonlocal held
        if texts:
            text = _SPACE.sub(" ", unescape("".join(texts))).strip()
            if text:
                blocks.append((stack[-1], text, held))
            texts.clear()
        held = 0

    def close(tag):
        if count[tag]:
            if tag not in INLINE:
                flush()
            while True:
                last = stack.pop().tag
                count[last] -= 1
                if last == tag:
                    return

    at, n = 0, len(html)
    while at < n:
        found = _TOKEN.search(html, at)
        until = found.start() if found else n
        if until > at:
            piece = html[at:until]
            texts.append(piece)
            if count["a"]:
                held += len(piece)
        if not found:
            break
        at = found.end() if found.end() > found.start() else found.start() + 1
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            close(tag)
            if tag == "br":
                texts.append(" ")
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if end is None:
                endless.add(tag)
            if tag not in INLINE:
                texts.append(" ")
            # Without an end tag a form control or a template ends with its parent; a script or a style reaches to the end.
            at = end.end() if end else (n if tag in ("script", "style", "textarea") else at)
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            elif tag == "br":
                texts.append(" ")
            continue
        block = stack[-1].block
        if tag in CLOSED_BY.get(block, ()):
            close(block)
        if tag not in INLINE:
            flush()
        stack.append(Open(tag, _hints(found[3]) if found[3] else (), stack[-1]))
        count[tag] += 1
    flush()
    return blocks


def features(blocks: list) -> list[list[str]]:
    """The active features of each block."""
    out, n = [], len(blocks)
    for i, (inside, text, linked) in enumerate(blocks):
        f = [*inside.features()]
        words = text.count(" ") + 1
        f.append(f"words={min(words.bit_length(), 7)}")
        if linked * 2 > len(text):
            f.append("linked")
        if text[-1] in ".!?\"'”»…":
            f.append("ends")
        if "©" in text or "copyright" in text.lower():
            f.append("rights")
        if i == 0:
            f.append("first")
        if i == n - 1:
            f.append("last")
        out.append(f)
    return out


class ChainModel:
    """Weights of a two-state chain: state scores of features, and transitions."""

    def __init__(self, index: dict[str, int], states: np.ndarray, moves: np.ndarray):
        self.index, self.states, self.moves = index, states, moves
        self.weight = {f: tuple(states[i].tolist()) for f, i in index.items()}

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi: the most probable states (1 is main text)."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        v0 = v1 = 0.0
        back = []
        for i, row in enumerate(rows):
            e0 = e1 = 0.0
            for f in row:
                w = self.weight.get(f)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if i == 0:
                v0, v1 = e0, e1
                back.append((0, 0))
                continue
            a, b = (v0 + m00, v1 + m10), (v0 + m01, v1 + m11)
            back.append((int(a[1] > a[0]), int(b[1] > b[0])))
            v0, v1 = max(a) + e0, max(b) + e1
        if not rows:
            return []
        out = [int(v1 > v0)]
        for step in reversed(back[1:]):
            out.append(step[out[-1]])
        return out[::-1]


def train_chain(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-3) -> ChainModel:
    """Maximum likelihood by Adagrad over whole pages, gradients by forward-backward."""
    index: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index))
    states, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    g2s, g2m = np.full_like(states, 1e-2), np.full_like(moves, 1e-2)
    coded = [([np.array([index[f] for f in row]) for row in rows], np.array(labels)) for rows, labels in pages if rows]
    for _ in range(rounds):
        gs, gm = -decay * states, -decay * moves
        for rows, labels in coded:
            n = len(rows)
            e = np.array([states[r].sum(axis=0) for r in rows])
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = e[0]
            for i in range(1, n):
                alpha[i] = e[i] + np.logaddexp(alpha[i - 1][0] + moves[0], alpha[i - 1][1] + moves[1])
            for i in range(n - 2, -1, -1):
                beta[i] = np.logaddexp(moves[:, 0] + e[i + 1][0] + beta[i + 1][0], moves[:, 1] + e[i + 1][1] + beta[i + 1][1])
            z = np.logaddexp(*alpha[-1])
            p = np.exp(alpha + beta - z)
            truth = np.eye(2)[labels]
            for r, d in zip(rows, (truth - p) / len(coded), strict=True):
                gs[r] += d
            if n > 1:
                pair = np.exp(alpha[:-1, :, None] + moves[None] + (e[1:] + beta[1:])[:, None, :] - z)
                gm += (np.einsum("ij,ik->jk", truth[:-1], truth[1:]) - pair.sum(axis=0)) / len(coded)
        g2s += gs**2
        g2m += gm**2
        states += rate * gs / np.sqrt(g2s)
        moves += rate * gm / np.sqrt(g2m)
    return ChainModel(index, states, moves)


# Names that pages give to parts of a kind, in class and id attributes.
PART_NAMES = {
    "nav": ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs"], "header": ["header", "masthead", "top"], "footer": ["footer", "bottom", "copyright", "legal"],
    "ad": ["ad", "ads", "advert", "advertisement", "promo", "promoted", "sponsor", "sponsored", "banner"], "aside": ["sidebar", "side", "aside", "related", "widget"],
    "notice": ["cookie", "cookies", "cookie-banner", "consent", "notice", "alert", "message", "gdpr", "popup", "modal", "overlay"],
    "form": ["newsletter", "subscribe", "signup", "login", "form", "search"], "comments": ["comments", "comment", "replies", "reply", "disqus", "discussion"], "share": ["share", "social"],
}
_SYLLABLES = "ka lo mi ten dra su vel por ni sha gre tu ba len fos".split()


def labelled_pages(count: int = 240, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Labelled training pages, written by a seeded generator: (html, main-text blocks in order).

    They vary in what marks the article (tag, class name or nothing but its
    place), in what surrounds it and in what is nested inside it.
    """
    r = random.Random(seed)

    def words(low, high, end=""):
        text = " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))
        return text.capitalize() + end

    def links(low=2, high=7):
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(r.randint(low, high))) + "</ul>"

    def sentence():
        return words(3, r.choice((6, 20, 60)), r.choice((".", ".", ".", "?", "!", "")))

    def boilerplate(kind):
        c = r.choice
        if kind in PART_NAMES and r.random() < 0.35:
            inner = c((f"<p>{sentence()}</p>", sentence(), f"<h3>{words(1, 3)}</h3><p>{sentence()}</p><p>{sentence()}</p>", links()))
            tag = c(("div", "div", "section", "aside"))
            return f'<{tag} {c(("class", "class", "id"))}="{c(PART_NAMES[kind])}">{inner}</{tag}>'
        return {
            "nav": lambda: c((f"<nav>{links()}</nav>", f'<div class="menu">{links()}</div>', f'<ul class="nav">{"".join(f"<li><a href=#>{words(1, 2)}</a></li>" for _ in range(4))}</ul>', f'<div id="breadcrumbs"><a href="/">{words(1, 1)}</a> &gt; <a href="/x">{words(1, 2)}</a></div>')),
            "header": lambda: c((f"<header><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>", f'<div class="header"><a href="/">{words(1, 3)}</a></div>', f"<header>{words(1, 4)}{links()}</header>")),
            "ad": lambda: c((f'<div class="ad">{sentence()}</div>', f'<div class="ads banner"><p>{sentence()}</p></div>', f'<div id="sponsored"><p>{sentence()}</p><p>{sentence()}</p></div>', f'<aside class="promo">{sentence()}</aside>', f'<p class="advert">{sentence()}</p>')),
            "aside": lambda: c((f"<aside><h3>{words(1, 3)}</h3>{links()}</aside>", f"<aside><p>{sentence()}</p><p>{sentence()}</p></aside>", f'<div class="sidebar"><h2>{words(1, 3)}</h2><p>{sentence()}</p>{links()}</div>', f'<div id="related">{links()}</div>')),
            "notice": lambda: c((f'<div class="cookie-notice"><p>{sentence()}</p><button>{words(1, 2)}</button></div>', f'<div id="cookie-consent">{sentence()}</div>', f'<div class="alert notice">{sentence()}</div>', f'<div class="popup newsletter"><p>{sentence()}</p></div>', f'<div role="alert">{sentence()}</div>')),
            "form": lambda: c((f'<form action="/s"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 1)}</button></form>', f'<form class="subscribe"><p>{sentence()}</p><input type="text"><button>{words(1, 2)}</button></form>', f'<div class="login"><form><label>{words(1, 2)}</label></form></div>')),
            "comments": lambda: c((f'<section class="comments"><h3>{words(1, 2)}</h3>{"".join(f"<p>{sentence()}</p>" for _ in range(r.randint(1, 5)))}</section>', f'<div id="comments">{"".join(f"<div class=comment><b>{words(1, 2)}</b><p>{sentence()}</p></div>" for _ in range(r.randint(1, 5)))}</div>', f'<ol class="commentlist comments">{"".join(f"<li>{sentence()}</li>" for _ in range(r.randint(1, 5)))}</ol>', f'<article class="comment"><p>{sentence()}</p></article>', f'<ul class="replies">{"".join(f"<li><p>{sentence()}</p></li>" for _ in range(3))}</ul>')),
            "share": lambda: c((f'<div class="share">{links(2, 4)}</div>', f'<div class="social"><a href="#">{words(1, 1)}</a> <a href="#">{words(1, 1)}</a></div>')),
            "footer": lambda: c((f"<footer>&copy; {words(1, 3)} &middot; {sentence()}</footer>", f"<footer><p>{words(2, 6)}</p>{links()}</footer>", f'<div class="footer"><p>&copy; 2020 {words(1, 4)}</p></div>', f'<div id="footer">{words(2, 8)}</div>')),
            "script": lambda: f"<script>var x = '<p>{words(2, 4)}</p>';</script><style>p {{ margin: 0 }}</style><!-- {words(1, 3)} -->",
        }[kind]()

    out = []
    for _ in range(count):
        main: list[str] = []

        def block(tag, text, main=main):
            main.append(text)
            inner = text if r.random() < 0.8 else f"<b>{text}</b>"
            return f"<{tag}>{inner}" + (f"</{tag}>" if r.random() < 0.9 or tag[0] != "p" else "")

        parts = [block("h1", words(2, 9))] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.75:
                parts.append(block("p", sentence()))
            elif kind < 0.83:
                parts.append(block(r.choice(("h2", "h3")), words(1, 6)))
            elif kind < 0.9:
                items = "".join(block("li", sentence()) for _ in range(r.randint(2, 4)))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.93:
                parts.append("<blockquote>" + block("p", sentence()) + "</blockquote>")
            elif kind < 0.96:
                parts.append("<table><tr>" + block("td", words(1, 4)) + block("td", words(1, 4)) + "</tr></table>")
            else:
                parts.append(block("pre", words(3, 12)))
            if r.random() < 0.12:
                parts.append(boilerplate(r.choice(("ad", "aside", "notice", "share", "script", "nav", "form", "comments"))))
        if r.random() < 0.15:
            parts.append(boilerplate(r.choice(("comments", "footer", "share", "form"))))
        mark = r.choice(("<article>", "<article>", "<article>", '<article class="post">', "<main>", "<main><article>", '<div class="content">', '<div class="post entry">', '<div id="main">', '<section class="story">', "<div>"))
        body = mark + "".join(parts) + "".join(f"</{t}>" for t in re.findall(r"<(\w+)", mark)[::-1])
        before = "".join(boilerplate(k) for k in ("notice", "header", "nav", "ad", "form", "script", "aside") if r.random() < 0.45)
        after = "".join(boilerplate(k) for k in ("share", "aside", "comments", "form", "ad", "footer", "script", "notice") if r.random() < 0.45)
        title = f"<title>{words(2, 8)}</title>" if r.random() < 0.9 else ""
        out.append((f"<!DOCTYPE html><html><head>{title}<style>p{{}}</style></head><body>{before}{body}{after}" + ("</body></html>" if r.random() < 0.9 else ""), main))
    return out


def labelled_chain(html: str, main: list[str]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a labelled page: its main blocks are matched in order."""
    blocks, labels, at = leaf_blocks(html), [], 0
    for _, text, _ in blocks:
        hit = at < len(main) and text == main[at]
        at += hit
        labels.append(int(hit))
    return features(blocks), labels


_MODEL: dict[str, ChainModel] = {}


def default_model() -> ChainModel:
    """The chain trained on ``labelled_pages()``, once a process."""
    if "chain" not in _MODEL:
        _MODEL["chain"] = train_chain([labelled_chain(h, m) for h, m in labelled_pages()])
    return _MODEL["chain"]


def extract_text(html: str | None, model: ChainModel) -> str:
    """Main text of one page: its main blocks, joined by a line feed."""
    blocks = leaf_blocks(html) if html else []
    if not blocks:
        return ""
    return "\n".join(text for (_, text, _), main in zip(blocks, model.decode(features(blocks)), strict=True) if main)


def extract_pages(pages: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Null or empty html, and a page without main text, give an empty text and 0.
    Rows are neither merged nor dropped; other columns are not read.
    """
    chain = model or default_model()
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            texts = [extract_text(h, chain) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
