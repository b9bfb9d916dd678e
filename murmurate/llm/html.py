"""Main-text extraction with a linear-chain conditional random field.

A page is cut into leaf blocks of its DOM: stretches of text between block-level
tags.  Each block has features of its ancestors (tags, class and id words) and
of its text (length, share of linked text, punctuation).  A two-label chain
(article, other) with these features and label transitions is trained on
labelled pages and decoded by Viterbi.

The labelled pages are made here by ``labelled_pages`` from layout parameters,
as no labelled pages come with the data, in layouts that a test holds out one by
one; training takes seconds on the driver, and the model is a fixed-size array
(``FEATURES`` hashed features).  Blocks end at block-level tags; ``<br>`` is white
space inside one.

The whole page is parsed; text in scripts, styles, templates and the head is
never a block.  Defined cases: null or empty html gives the empty text; a null
page_id or url stays; broken markup never fails (unclosed tags end with their
parent, a lone ``<`` is text); repeated rows give equal results; very long pages
are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 16
ARTICLE, OTHER = 1, 0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    # a head ends at its end tag or the body's start, else after its last element
    r"|<(?P<head>head)(?=[\s/>])[^>]*>(?:(?:(?!<body\b).)*?</head\s*>|(?:\s|<!--.*?-->|<(?:meta|link|base)\b[^>]*>|<(?P<inner>title|script|style|noscript|template)\b[^>]*>.*?</(?P=inner)\s*>)*+)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAME = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del input acronym".split())
#: Their text is never a block; without an end tag they end with their parent.
_HIDDEN = frozenset("noscript template svg iframe".split())
#: Start tags that end an open svg.
_BREAKS = frozenset("article aside blockquote body center dd div dl dt embed footer h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of these.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What sites say around their articles.
_AROUND = ("All rights reserved.", "Home", "Contact us", "About", "Subscribe", "Log in", "Sign up for our newsletter.", "Privacy policy", "Terms of use", "Read more", "Share this", "Advertisement", "We use cookies.", "Search", "Related stories", "Most read", "Skip to content", "Menu", "Next page", "Follow us")
_TELLING = frozenset(w.lower() for text in _AROUND for w in _WORD.findall(text) if len(w) > 5)


@dataclass
class Block:
    text: str
    linked: int
    tags: tuple[str, ...]
    names: tuple[str, ...]


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link = 0, 0
    hidden: int | None = None  # place of an open hidden element in the stack

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), tuple(t for t, _ in stack), tuple(n for _, names in stack for n in names)))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if hidden is not None:
                continue
            parts.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and hidden is None:
                parts.append(" ")
            continue
        if hidden is not None:
            if m["close"]:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if k is None or k >= hidden:
                    if k is not None:
                        del stack[k:]
                        hidden = None if k == hidden else hidden
                    continue
            elif stack[hidden][0] != "svg" or tag not in _BREAKS:
                if tag not in _VOID and tag not in _INLINE and not m["attrs"].endswith("/"):
                    stack.append((tag, ()))
                continue
            del stack[hidden:]
            hidden = None
        if tag in _HIDDEN:
            if not m["close"] and not (tag == "svg" and m["attrs"].endswith("/")):
                hidden = len(stack)
                stack.append((tag, ()))
            parts.append(" ")
            continue
        if tag == "br":  # white space inside a block
            parts.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if m["close"] else 1
            continue
        flush()
        in_link = 0
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(tag, ())):
            stack.pop()
        if tag not in _VOID:
            names = tuple(w.lower() for v in _NAME.findall(m["attrs"]) for w in _WORD.findall("".join(v)))
            stack.append((tag, names))
    if hidden is not None:
        del stack[hidden:]
    flush()
    return out


def features(page: list[Block]) -> list[np.ndarray]:
    """Hashed feature numbers of each block."""
    out = []
    has = {t for b in page for t in b.tags} & {"article", "main"}
    for b in page:
        n = len(b.text)
        words = b.text.count(" ") + 1
        names = ["bias", f"parent={b.tags[-1] if b.tags else ''}"]
        names += [f"anc={t}" for t in set(b.tags)]
        names.append(f"main={len(has)}:{len(has & set(b.tags))}")
        if words <= 8:  # short blocks say what they are
            names += [f"word={w}" for w in {w.lower() for w in _WORD.findall(b.text)} & _TELLING]
        names += [f"name={w}" for w in set(b.names)]
        names.append(f"len={min(7, n.bit_length() // 2)}")
        names.append(f"words={min(6, words.bit_length())}")
        names.append(f"link={(4 * b.linked) // max(n, 1)}")
        names.append(f"end={'p' if b.text[-1] in '.!?…»”' else 'x'}")
        if b.text[0] in "©|›»←→":
            names.append("sign")
        if b.tags and b.tags[-1] in ("li", "p", "div", "td"):
            names.append(f"{b.tags[-1]}:link={(4 * b.linked) // max(n, 1)}")
        out.append(np.array([zlib.crc32(x.encode()) % FEATURES for x in names], np.int64))
    return out


class Chain:
    """Linear-chain CRF with two labels."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, 2)) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    def scores(self, feats: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for f in feats])

    def viterbi(self, feats: list[np.ndarray]) -> list[int]:
        if not feats:
            return []
        s = self.scores(feats).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = s[0]
        back: list[tuple[int, int]] = []
        for x, y in s[1:]:
            p, q = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 > b + m11 else 1)
            a, b = x + ((b + m10) if p else (a + m00)), y + ((b + m11) if q else (a + m01))
            back.append((p, q))
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[np.ndarray], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> Chain:
        """Ascent on the log-likelihood (AdaGrad), gradients by forward-backward."""
        rng = random.Random(seed)
        order = list(range(len(pages)))
        gw, gm = np.full((FEATURES, 2), 1e-6), np.full((2, 2), 1e-6)
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                feats, gold = pages[k]
                n = len(gold)
                if not n:
                    continue
                s = self.scores(feats)
                f, b = np.zeros((n, 2)), np.zeros((n, 2))
                f[0] = s[0]
                for t in range(1, n):
                    f[t] = s[t] + np.logaddexp(f[t - 1, 0] + self.moves[0], f[t - 1, 1] + self.moves[1])
                for t in range(n - 2, -1, -1):
                    z = self.moves + (s[t + 1] + b[t + 1])[None, :]
                    b[t] = np.logaddexp(z[:, 0], z[:, 1])
                total = np.logaddexp(f[-1, 0], f[-1, 1])
                error = -np.exp(f + b - total)
                error[np.arange(n), gold] += 1
                move = np.zeros((2, 2))
                for t in range(1, n):
                    move -= np.exp(f[t - 1][:, None] + self.moves + (s[t] + b[t])[None, :] - total)
                    move[gold[t - 1], gold[t]] += 1
                for t in range(n):
                    gw[feats[t]] += error[t] ** 2
                    self.weights[feats[t]] += rate * (error[t] - decay * self.weights[feats[t]]) / np.sqrt(gw[feats[t]] + 1e-2)
                gm += move**2
                self.moves += rate * move / np.sqrt(gm + 1e-2)
        return self


#: Ways to lay out a page; each can be held out.
LAYOUTS = ("semantic", "divs", "table", "blog", "portal")


def labelled_pages(n: int = 400, seed: int = 11, layouts: tuple[str, ...] = LAYOUTS) -> list[tuple[str, list[int]]]:
    """Pages in several layouts, with the label of each of their blocks."""
    rng = random.Random(seed)
    syllables = "ba ke lo mi nu ra te so ven dor al is qu en tion er".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def phrase(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def sentence(lo: int = 3, hi: int = 60) -> str:
        return phrase(lo, hi).capitalize() + rng.choice([".", ".", ".", "!", "?", ",", ""])

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def around() -> str:
        return rng.choice(_AROUND) if rng.random() < 0.5 else phrase(1, 4).capitalize()

    def attr(*names: str) -> str:
        """A telling name, a name that says nothing, or none."""
        k = rng.random()
        return f' {rng.choice(["class", "id"])}="{rng.choice(names)}"' if names and k < 0.55 else f' class="{word()}"' if k < 0.75 else ""

    pages = []
    for _ in range(n):
        layout = rng.choice(layouts)
        body: list[str] = []
        labels: list[int] = []

        def emit(markup: str, count: int = 0, label: int = OTHER, body: list[str] = body, labels: list[int] = labels) -> None:
            body.append(markup)
            labels.extend([label] * count)

        def links(tag: str, *names: str) -> None:
            k = rng.randint(2, 7)
            form = rng.randint(0, 3)
            if form == 0:
                emit(f"<{tag}{attr(*names)}>" + rng.choice([" ", " | ", "<br>"]).join(link(around()) for _ in range(k)) + f"</{tag}>", 1)
            elif form == 1:
                emit(f"<{tag}{attr(*names)}>" + "".join(f"<div>{link(around())}</div>" for _ in range(k)) + f"</{tag}>", k)
            else:
                emit(f"<{tag}{attr(*names)}><ul>" + "".join(f"<li>{link(around())}</li>" for _ in range(k)) + f"</ul></{tag}>", k)

        def box(tag: str, *names: str, short: bool = False) -> None:
            form = rng.randint(0, 3)
            if form == 0:
                links(tag, *names)
            elif form == 1:
                emit(f"<{tag}{attr(*names)}>{sentence(2, 8 if short else 30)}</{tag}>", 1)
            elif form == 2:
                k = rng.randint(1, 3)
                emit(f"<{tag}{attr(*names)}>" + "".join(f"<p>{rng.choice([sentence(3, 30), around()])}</p>" for _ in range(k)) + f"</{tag}>", k)
            else:
                emit(f"<{tag}{attr(*names)}><h3>{around()}</h3><p>{sentence(3, 25)}</p></{tag}>", 2)

        def named(tag: str, kind: str) -> None:
            """A box that only its name tells from the text."""
            form = rng.randint(0, 2)
            if form == 0:
                emit(f'<{tag} class="{kind}">{sentence(2, 40)}</{tag}>', 1)
            elif form == 1:
                emit(f'<{tag} class="{kind}"><h3>{phrase(1, 4)}</h3><p>{sentence(3, 30)}</p></{tag}>', 2)
            else:
                k = rng.randint(1, 3)
                emit(f'<{tag} class="{kind}">' + "".join(f"<p>{sentence(3, 40)}</p>" for _ in range(k)) + f"</{tag}>", k)

        ads = ("ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement")
        notices = ("notice", "cookie", "cookies", "alert", "consent", "popup", "newsletter", "subscribe", "signup")
        extras = ("share", "social", "tags", "breadcrumb", "pagination", "meta", "related", "recommended", "sidebar", "menu", "widget", "more")

        def aside() -> None:
            pick = rng.randint(0, 5)
            if pick == 0:
                links("nav", "menu", "nav", "top")
            elif pick == 1:
                box("aside", "sidebar", "widget")
            elif pick == 2:
                emit(f"<form{attr('search', 'login')}><label>{around()}</label><button>{around()}</button></form>", 2)
            elif pick == 3:
                named("div", rng.choice(ads))
            elif pick == 4:
                named(rng.choice(["div", "section"]), rng.choice(notices))
            else:
                named("div", rng.choice(extras))

        def site_header() -> None:
            tag = "header" if layout in ("semantic", "blog") or rng.random() < 0.4 else "div"
            names = ("header", "top", "masthead", "banner", "site")
            name = f' class="{rng.choice(names)}"' if tag == "div" else attr(*names)
            inner = rng.choice(["h1", "h2", "p", "div"])
            k = rng.randint(1, 2)
            emit(f"<{tag}{name}><{inner}>{rng.choice([link(phrase(1, 3)), phrase(1, 3).title()])}</{inner}>" + (f"<p>{sentence(2, 8)}</p>" if k == 2 else ""), k)
            if rng.random() < 0.5:
                links("nav", "menu")
            emit(f"</{tag}>")

        def site_footer() -> None:
            tag = "footer" if layout in ("semantic", "blog") or rng.random() < 0.6 else "div"
            name = f' class="{rng.choice(["footer", "copyright", "legal", "bottom"])}"' if tag == "div" else attr("footer", "site")
            form = rng.randint(0, 3)
            if form == 0:
                emit(f"<{tag}{name}>&copy; {word()} &middot; {sentence(2, 12)}</{tag}>", 1)
            elif form == 1:
                k = rng.randint(1, 3)
                emit(f"<{tag}{name}>" + "".join(f"<p>{rng.choice([around(), sentence(2, 14), '&copy; ' + phrase(1, 4)])}</p>" for _ in range(k)) + f"</{tag}>", k)
            elif form == 2:
                emit(f"<{tag}{name}>{around()}</{tag}>", 1)
            else:
                links(tag, "footer")

        def article() -> None:
            head = rng.random()
            if head < 0.75:
                h = rng.choice(["h1", "h1", "h2"])
                title = f"<{h}>{sentence(2, 12)}</{h}>"
                emit(f"<header>{title}</header>" if layout in ("semantic", "blog") and rng.random() < 0.2 else title, 1, ARTICLE)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
                kind = rng.random()
                if kind < 0.60:
                    emit(f"<p>{sentence(1, 120)}</p>", 1, ARTICLE)
                elif kind < 0.66:
                    emit(f"<p>{sentence(3, 20)[:-1]} {link(phrase(1, 3))} {sentence(3, 20)}</p>", 1, ARTICLE)
                elif kind < 0.70:
                    emit(f"<p>{sentence(3, 30)}<br>{sentence(3, 30)}</p>", 1, ARTICLE)
                elif kind < 0.75:
                    k = rng.randint(1, 5)
                    emit("<ul>" + "".join(f"<li>{sentence(2, 20)}</li>" for _ in range(k)) + "</ul>", k, ARTICLE)
                elif kind < 0.79:
                    emit(f"<h2>{phrase(1, 8)}</h2>", 1, ARTICLE)
                elif kind < 0.82:
                    emit(f"<blockquote>{sentence(3, 40)}</blockquote>", 1, ARTICLE)
                elif kind < 0.86:
                    emit(f"<p><b>{sentence(2, 20)}<br><p>{sentence(2, 60)}</p>", 2, ARTICLE)
                elif kind < 0.89:
                    emit(f"<table><tr><td>{phrase(1, 4)}</td><td>{phrase(1, 4)}</td></tr></table>", 2, ARTICLE)
                elif kind < 0.92:
                    emit(f"<pre>{phrase(3, 20)}</pre>", 1, ARTICLE)
                else:
                    aside()

        def comments() -> None:
            if rng.random() < 0.35:
                k = rng.randint(1, 4)
                name = rng.choice(["comments", "comment", "discussion", "replies", "responses"])
                tag = rng.choice(["section", "div"])
                emit(f'<{tag} class="{name}">' + "".join(f'<div class="{rng.choice(["comment", "reply", ""])}"><p>{sentence(3, 50)}</p></div>' for _ in range(k)) + f"</{tag}>", k)

        if rng.random() < 0.6:
            site_header()
        for _ in range(rng.randint(0, 2)):
            aside()
        if layout == "table":
            emit("<table><tr>")
            if rng.random() < 0.8:
                links("td", "menu", "nav", "left")
            emit(f"<td{attr('content', 'main')}>")
            article()
            emit("</td>")
            if rng.random() < 0.4:
                box("td", "right", "sidebar", short=True)
            emit("</tr></table>")
            comments()
        else:
            outer = {
                "semantic": ["article", "article", "main", "main><article"],
                "divs": ['div class="content"', 'div id="main"', 'div class="article-body"', 'div class="text"', "div"],
                "blog": ["article", 'div class="post"', 'section class="entry"', 'div class="entry-content"'],
                "portal": ["article", 'div class="story"', "main", 'div class="page"><div class="text"'],
            }[layout]
            pick = rng.choice(outer)
            if layout == "portal":
                emit('<div class="wrap">')
                links("div", "menu", "left", "nav")
            emit(f"<{pick}>")
            article()
            if layout == "blog" and rng.random() < 0.5:
                comments()
            emit("".join(f"</{t.split()[0]}>" for t in reversed(pick.split("><"))))
            if layout == "portal":
                box("div", "sidebar", "right", "widget", short=True)
                emit("</div>")
            comments()
        for _ in range(rng.randint(0, 2)):
            aside()
        if rng.random() < 0.85:
            site_footer()
        pages.append(("<html><head><title>x</title></head><body>" + "".join(body) + "</body></html>", labels))
    return pages


def train(pages: list[tuple[str, list[int]]] | None = None) -> Chain:
    data = []
    for page, labels in pages or labelled_pages():
        cut = blocks(page)
        if len(cut) == len(labels):
            data.append((features(cut), labels))
    return Chain().fit(data)


def main_text(page: str | None, model: Chain) -> str:
    cut = blocks(page or "")
    return "\n".join(b.text for b, label in zip(cut, model.viterbi(features(cut)), strict=True) if label == ARTICLE)


def extract(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [main_text(p, shared.value) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")
