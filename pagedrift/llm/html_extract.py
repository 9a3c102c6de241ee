"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagedrift.llm.common import lean, slices

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S).match
_attribute = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""").findall
_name = re.compile(r"[a-z]+").findall
_end_of = functools.cache(lambda tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search)

#: Fixed values of HTML: elements without an end, elements whose content is no text, inline elements, implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template svg iframe textarea select title".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow msqrt msub msup mtext q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Of the silent elements, those that HTML reads as bare text up to their end tag, or to the page's end without one.
BARE = frozenset("script style iframe textarea title".split())
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags of the ancestors, the outermost first
    names: tuple[str, ...]  # words of their classes, ids and roles
    linked: int  # characters within links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text that no block element parts, with character references decoded and white
    space turned into single spaces. Blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    run: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                own = [(t, n) for t, n in stack if t not in INLINE]
                out.append(Block(text, tuple(t for t, _ in own), tuple(x for _, n in own for x in n), linked))
            run.clear()
        linked = 0

    unended: set[str] = set()
    at_char = 0
    while at_char < len(page):
        m = _token(page, at_char)
        at_char = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if s[:2] not in ("<!", "<?"):
                run.append(s)
                if any(t == "a" for t, _ in stack):
                    linked += len(s)
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE and tag not in SILENT:
                close()
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            # an inline end reaches no further out than its block
            if at >= 0 and (tag not in INLINE or all(t in INLINE for t, _ in stack[at:])):
                del stack[at:]
            continue
        if tag == "br" or tag == "wbr":
            run.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE and tag not in SILENT:
            close()
            if tag in ENDS or tag in CLOSE_P:
                ends = ENDS.get(tag, set()) | ({"p"} if tag in CLOSE_P else set())
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ends), -1)
                if at >= 0 and all(t in INLINE or t in ends for t, _ in stack[at:]):
                    del stack[at:]
        if tag in SILENT:
            # its content is searched for the end tag, never read as tags: scripts hold bare <
            if not m[3].rstrip().endswith("/"):
                end = None if tag in unended else _end_of(tag)(page, at_char)
                if end:
                    at_char = end.start()
                elif tag in BARE:
                    break
                else:
                    unended.add(tag)
            continue
        if tag in VOID:
            continue
        names: tuple[str, ...] = ()
        if "=" in m[3]:
            names = tuple(x for k, *v in _attribute(m[3]) if k.lower() in ("class", "id", "role", "itemprop", "aria-label") for x in _name("".join(v).lower()))
        stack.append((tag, names))
    close()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features of each block: ancestor tags, words of their classes and ids, and traits of its text."""
    out = []
    for i, b in enumerate(page):
        n = len(b.text)
        f = ["bias", f"own={b.path[-1] if b.path else ''}"]
        f += [f"in={t}" for t in set(b.path)]
        f += [f"name={x}" for x in set(b.names)]
        f.append(f"size={min(8, int(math.log2(n + 1)))}")
        f.append(f"links={min(4, b.linked * 4 // n)}")
        f.append(f"stop={b.text[-1] in '.!?…\"”'}")
        if "©" in b.text or "All rights" in b.text:
            f.append("copyright")
        if i == 0:
            f.append("first")
        if i == len(page) - 1:
            f.append("last")
        out.append(f)
    return out


@dataclass
class Crf:
    """Two states, 0 boilerplate and 1 main text."""

    weights: dict[str, tuple[float, float]]
    moves: np.ndarray

    def emissions(self, feats: list[list[str]]) -> np.ndarray:
        none = (0.0, 0.0)
        e = np.zeros((len(feats), 2))
        for i, f in enumerate(feats):
            a = b = 0.0
            for x in f:
                u, v = self.weights.get(x, none)
                a += u
                b += v
            e[i] = a, b
        return e

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The likeliest sequence of states, by Viterbi."""
        if not feats:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        e = self.emissions(feats).tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        state = int(b > a)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.2, decay: float = 1e-4) -> Crf:
    """Maximise the likelihood of labelled pages by stochastic gradients from forward-backward marginals (AdaGrad)."""
    index = {x: i for i, x in enumerate(sorted({x for f, _ in pages for b in f for x in b}))}
    w, gw = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-2)
    t, gt = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    coded = [([np.array([index[x] for x in b]) for b in f], y) for f, y in pages if f]
    order = random.Random(5)
    for _ in range(epochs):
        order.shuffle(coded)
        for f, y in coded:
            n = len(f)
            e = np.array([w[b].sum(0) for b in f])
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = e[0]
            for i in range(1, n):
                fwd[i] = e[i] + np.logaddexp(fwd[i - 1, 0] + t[0], fwd[i - 1, 1] + t[1])
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp(t[:, 0] + e[i + 1, 0] + bwd[i + 1, 0], t[:, 1] + e[i + 1, 1] + bwd[i + 1, 1])
            z = np.logaddexp(*fwd[-1])
            g = -np.exp(fwd + bwd - z)
            g[np.arange(n), y] += 1
            gm = np.zeros((2, 2))
            for i in range(1, n):
                gm -= np.exp(fwd[i - 1][:, None] + t + (e[i] + bwd[i])[None, :] - z)
                gm[y[i - 1], y[i]] += 1
            for b, gb in zip(f, g, strict=True):
                gw[b] += gb * gb
                w[b] += rate * (gb / np.sqrt(gw[b]) - decay * w[b])
            gt += gm * gm
            t += rate * gm / np.sqrt(gt)
    return Crf({x: (float(w[i, 0]), float(w[i, 1])) for x, i in index.items()}, t)


def labelled_pages(n: int = 600, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Generated pages and the blocks of their main text: many layouts, all kinds of boilerplate before, amid and after it."""
    r = random.Random(seed)
    syllables = "ba be bi bo da de do ka ke ki la le lo ma me mi na ne no ra re ro sa se so ta te ti va ve un er an on st tion".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    say = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    prose = lambda: " ".join(say(r.randint(1, 24)) for _ in range(r.choice([1, 1, 1, 2, 4, 8])))
    few = lambda: " ".join(word() for _ in range(r.randint(1, 5)))
    links = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{few()}</a></li>' for _ in range(r.randint(2, 8))) + "</ul>"
    ps = lambda k: "".join(f"<p>{prose()}</p>" for _ in range(k))
    any_text = lambda: r.choice([say(8), few(), prose(), f"<p>{prose()}</p>"])

    def mess() -> str:
        kind = r.randrange(12)
        if kind == 11:
            return r.choice(["<noscript>{}</noscript>", "<object>{}</object>", "<noscript><p>{}</p></noscript>"]).format(any_text())
        if kind == 0:
            return r.choice(["<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<ul class="breadcrumb">{}</ul>']).format(links())
        if kind == 1:
            return r.choice(['<div class="ad">{}</div>', '<div class="advert">{}</div>', '<div class="ads sponsored">{}</div>', '<aside class="promo">{}</aside>', '<div id="banner">{}</div>']).format(any_text())
        if kind == 2:
            return r.choice(['<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div class="related">{}</div>', '<aside class="widget">{}</aside>']).format(r.choice([links(), ps(2), f"<h3>{few()}</h3>{links()}"]))
        if kind == 3:
            return r.choice(['<div class="cookie-notice">{}</div>', '<div class="notice">{}</div>', '<div class="consent banner">{}</div>', '<div role="alert">{}</div>', '<div id="cookies">{}</div>', '<div class="gdpr">{}</div>']).format(r.choice([any_text(), f"<p>{prose()}</p><button>{few()}</button>"]))
        if kind == 4:
            return f"<form action='/x'><label>{few()}</label><input name=q><button>{few()}</button>{r.choice(['', '<p>' + prose() + '</p>'])}</form>"
        if kind == 5:
            return r.choice(['<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comment-list">{}</div>', '<ol class="commentlist comments">{}</ol>']).format("".join(f'<div class="comment"><b>{few()}</b><p>{prose()}</p></div>' for _ in range(r.randint(1, 5))))
        if kind == 6:
            return r.choice(['<div class="share social">{}</div>', '<div class="newsletter subscribe">{}</div>', '<div class="popup modal">{}</div>']).format(any_text())
        if kind == 7:
            return f"<script>var a='<p>{few()}</p>';</script><style>p{{margin:0}}</style><!-- {few()} -->"
        if kind == 8:
            return r.choice(['<div class="tags">{}</div>', '<div class="meta byline">{}</div>', '<div class="pagination">{}</div>']).format(links())
        if kind == 9:
            return r.choice(["<header>{}</header>", '<div class="header">{}</div>']).format(r.choice([few(), f"<h1>{few()}</h1>", f"<p>{prose()}</p>"]))
        return r.choice(["<footer>&copy; {}</footer>", "<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">&copy; {}</div>']).format(any_text())

    out = []
    for i in range(n):
        body = []
        if r.random() < 0.8:
            body.append(f"<h1>{few()}</h1>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 6, 12])):
            body.append(r.choice([ps(1), ps(1), ps(1), f"<p><b>{prose()}<br>", f"<h2>{few()}</h2>{ps(1)}", f"<ul><li>{say(6)}</li><li>{say(9)}</li></ul>", f"<blockquote>{prose()}</blockquote>", f"<pre>{say(5)}</pre>", f'<p>{say(5)} <a href="/x">{few()}</a> {say(7)}</p>', f"<table><tr><td>{few()}</td><td>{few()}</td></tr></table>"]))
        inner = "".join(body)
        main = [b.text for b in blocks(inner)]
        marked = inner
        for _ in range(r.choice([0, 0, 1, 2])):
            marked += mess()
        shell = ["<article>{}</article>", "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<main><article>{}</article></main>', '<div class="content">{}</div>', '<div id="main" role="main">{}</div>', '<div class="post-body entry article">{}</div>', '<section class="article story">{}</section>'][i % 9].format(marked)
        if i % 20 == 0:
            shell = marked
        bare = r.random() < 0.15
        some = lambda: "" if bare or r.random() < 0.1 else "".join(mess() for _ in range(r.randint(1, 4)))  # noqa: B023,E731
        page = some() + shell + some()
        if not bare and r.random() < 0.75:
            page += f"<footer>&copy; {few()} &middot; {prose()}</footer>"
        out.append((f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{few()}</title></head><body>{page}' + ("</body></html>" if r.random() < 0.9 else ""), main))
    return out


def label(page: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks that are, in order, the texts of main."""
    out, at = [], 0
    start = next((i for i in range(len(page)) if [b.text for b in page[i : i + len(main)]] == main), len(page))
    for at, _ in enumerate(page):
        out.append(int(start <= at < start + len(main)))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> Crf:
    """The model fitted on labelled_pages(); some seconds, once in a driver."""
    coded = []
    for page, main in labelled_pages():
        found = blocks(page)
        coded.append((features(found), label(found, main)))
    return train(coded)


def main_text(page: str, model: Crf) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, s in zip(found, model.decode(features(found)), strict=True) if s)


def _extract(model: Crf):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h or "", model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return extract


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """Main text of every row of pages(page_id, url, html): page_id, url, text, n_chars.

    A null or empty page has an empty text. Rows are independent: repeated rows give repeated results and an empty table
    an empty one; other columns play no part. There is no shuffle.

    A script, style, frame, text area or title without an end tag runs to the page's end, as in browsers; any other element
    without one ends with an element around it, or with the page. Pages of any length and depth are read in one pass without
    recursion. Formulas are text of their paragraph.
    """
    lean(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(model or trained()), "page_id long, url string, text string, n_chars long")
