"""Main text of web pages: a recurrent labeller over the page's blocks.

A page is read once from left to right into blocks, the text between two borders of block elements,
with the open elements above it (tags, classes, ids). A bidirectional LSTM, written and trained in
numpy, reads for each block the sum of hashed path vectors, the mean of hashed word vectors and a few
numbers, so a block's label draws on the whole page before and after it. The numbers, four marks among
them (an element above is known not to be main text; one is known to be; the page has such a one; it has
none and the block is a link alone), also enter the block's logit directly, so that blocks around it do
not outweigh what stands above it.

Training takes at most ``MAX_PAGES`` pages, chosen by a hash of the id, of ``MAX_TRAIN_CHARS`` or
less each. Their blocks get weak labels from the elements above them; each page is also varied:
containers renamed, and menus, notices, forms, adverts, side columns and reader comments of its own
words put in, and lists, tables, quotations and links into the articles, so the labeller knows forms
that the sample lacks. Whole pages are cut into runs of ``RUN`` blocks, of which ``MAX_RUNS`` at most, drawn evenly from all of them, are learned from.
Extraction reads every whole page, in batches of a bounded number of padded cells.

Text: character references decoded, white space inside a block made one space, trimmed; blocks of
the main text are joined in page order by two line feeds. Comments, and what is inside script, style,
noscript, template, svg, iframe and textarea, are no text.

Defined cases: null and empty pages, and pages without text, give ''. Unclosed elements, comments and
scripts go on to the end of the page. Without training pages (an empty table gives no rows) every block
outside of head counts. Very long pages are read whole. Repeated rows give a row each. Extra columns
are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adam import Adam

MAX_PAGES, MAX_TRAIN_CHARS, MAX_RUNS, RUN = 240, 200_000, 800, 120
MARK = 4  # what a mark weighs among the numbers
CELLS = 1 << 14  # blocks, with padding, that are scored at once (a longer page alone)
PATH_SPACE, PATH_DIM, WORD_SPACE, WORD_DIM, NUMBERS, HIDDEN = 1 << 10, 12, 1 << 11, 6, 9, 12

# Quotes bound an attribute's value only where it begins; in other places they are signs like any other.
INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)\b{INSIDE}(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({INSIDE})(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PART = re.compile(r"[a-z0-9]+")
# Elements without an end, elements inside a line, the names of what is not main text, and words in a name after which others tell what a page has, not what an element is.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
OTHER_TAGS = set("head title nav header footer aside form button select option menu dialog".split())
OTHER_NAMES = set("ad ads adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies disclaimer disqus feedback footer form gdpr header login masthead menu modal nav navbar navi navigation newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup promo promoted rail reactions recommendations recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar trending widget widgets".split())
HAS = set("has have no not with without".split())
MAIN = {"article", "main"}
MAIN_NAMES = set("article content entry main post story".split())


class Block:
    __slots__ = ("last", "link", "marks", "path", "size", "text")

    def __init__(self, text: str, path: tuple[str, ...], last: str, link: int):
        self.text, self.path, self.last, self.size = text, path, last, len(text)
        self.link, self.marks = link / sum(map(len, text.split())), (0, 0, 0, 0)


def _names(attributes: str) -> list[str]:
    out = []
    for m in NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = PART.findall(HUMP.sub(" ", name).lower())
            out += [f"#{p}" for p in parts[: next((k for k, p in enumerate(parts) if p in HAS), None)]]
    return out


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order, each with the different names (tags, ``#`` classes, ids and roles) above it, outermost first."""
    page, stack, out, run = page or "", [], [], []
    at = link = links = 0

    def close() -> None:
        nonlocal link
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(Block(text, *(stack[-1][1:] if stack else ((), "")), link))
            run.clear()
        link = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            run.append(piece := entities.unescape(piece) if "&" in piece else piece)
            link += links and sum(map(len, piece.split()))
        at = m.end()
        tag = m[3] and m[3].lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                links = 0 if m[2] else 1
            continue
        close()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and not m[4].endswith("/"):
            if stack and stack[-1][0] == "p":
                stack.pop()  # a paragraph ends where the next block begins
            if stack and stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "option"):
                stack.pop()
            names, above = [tag] if tag in ("html", "body") else [tag, *_names(m[4])], stack[-1][1] if stack else ()
            new = tuple(dict.fromkeys(n for n in names if n not in above))
            stack.append((tag, above + new if new else above, names[-1]))  # elements in elements of the same names share one path
    if at < len(page):
        run.append(entities.unescape(page[at:]))
    close()
    _mark(out)
    return out


def _mark(found: list[Block]) -> None:
    """Whether an element above each block is not main text, whether one is, whether the page has such a one, and whether it has none and the block is a link alone."""
    kinds: dict[tuple[str, ...], tuple[bool, bool]] = {}
    for b in found:
        if b.path not in kinds:
            other = any(n in OTHER_TAGS or n[0] == "#" and n[1:] in OTHER_NAMES for n in _own(b.path))
            kinds[b.path] = other, any(n in MAIN or n[0] == "#" and n[1:] in MAIN_NAMES for n in b.path)
    known = any(inside and not other for other, inside in kinds.values())
    for b in found:
        o, i = kinds[b.path]
        b.marks = (int(o), int(i), int(known), int(not known and b.link >= 1))


def weak_labels(found: list[Block]) -> np.ndarray:
    """1 for blocks of the main text as the elements above them tell it; a link alone is none where no element tells of main text."""
    return np.array([not other and (inside or not known and not alone) for b in found for other, inside, known, alone in [b.marks]], np.float32)


def _own(path: tuple[str, ...]) -> tuple[str, ...]:
    """A header inside an article belongs to it."""
    return tuple(n for k, n in enumerate(path) if n not in ("header", "#header") or not MAIN & set(path[:k]))


def vary(page: str, rng: random.Random) -> str:
    """The page with renamed containers and more of what is not main text."""
    words = re.findall(r"\w+", re.sub(r"<[^>]*>", " ", page)) or ["x"]
    say = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    name = lambda *xs: rng.choice(xs)
    comments = "".join(f'<{(t := name("div", "li", "article"))} class="comment"><p>{say(3, 60)}</p></{t}>' for _ in range(rng.randint(1, 5)))
    told = [
        f'<{(u := name("ul", "ol"))}>{"".join(f"<li>{say(1, 12)}</li>" for _ in range(rng.randint(1, 6)))}</{u}>',
        f'<table><tr><th>{say(1, 3)}</th><th>{say(1, 3)}</th></tr><tr><td>{say(1, 6)}</td><td>{say(1, 6)}</td></tr></table>',
        f'<blockquote><p>{say(3, 30)}</p></blockquote>', f'<h2>{say(1, 6)}</h2>', f'<p><a href="/x">{say(1, 6)}</a></p>', f'<div>{say(2, 40)}</div>',
    ]
    for piece in rng.sample(told, rng.randint(0, 3)):
        places = [m.end() for m in re.finditer(r"</p>(?=.*</article>)", page, re.S)]
        at = rng.choice(places) if places else len(page)
        page = page[:at] + piece + page[at:]
    extra = [
        f'<header class="{name("site-header", "top", "masthead")}"><div>{say(1, 6)}</div><p>{say(2, 12)}</p></header>',
        f'<div class="{name("cookie-notice", "notice", "gdpr consent", "banner")}"><p>{say(4, 30)}</p></div>',
        f'<aside{name("", " class=sidebar")}><h3>{say(1, 4)}</h3><ul><li><a href="/">{say(1, 5)}</a></li><li>{say(1, 5)}</li></ul><p>{say(3, 40)}</p></aside>',
        f'<div class="{name("ad", "ads", "advert", "sponsored", "promo")}">{say(2, 30)}</div>',
        f'<form action="/s"><label>{say(1, 3)}</label><input><button>{say(1, 2)}</button><p>{say(2, 10)}</p></form>',
        f'<{(s := name("section", "div"))} {name("class", "id")}="comments"><h2>{say(1, 3)}</h2>{comments}</{s}>',
        f'<nav><a href="/">{say(1, 3)}</a> <a href="/a">{say(1, 3)}</a></nav>',
        f'<footer><p>{say(3, 30)}</p></footer>',
        f'<div class="{name("newsletter", "widget-area sidebar-right", "related", "share social", "disqus")}"><p>{say(2, 30)}</p></div>',
        f'<div><a href="/n">{say(1, 4)}</a></div>',
    ]
    for piece in rng.sample(extra, rng.randint(2, 6)):
        places = [m.end() for m in re.finditer(r"</(?:p|h1|h2|nav|ul|article)>|<body[^>]*>|<article[^>]*>", page)]
        at = rng.choice(places) if places else len(page)
        page = page[:at] + piece + page[at:]
    swap = rng.choice([("article", ""), ("main", ""), ("main", ' id="content"'), ("div", ' class="article-body"'), ("div", ' id="content"'), ("div", ""), ("section", ' class="post"')])
    return re.sub(r"</article>", f"</{swap[0]}>", re.sub(r"<article>", f"<{swap[0]}{swap[1]}>", page))


def _hash(text: str, space: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % space


class Features:
    """Hashed names and words of blocks as flat arrays with ends."""

    def __init__(self) -> None:
        self.path: dict[tuple[tuple[str, ...], str], np.ndarray] = {}
        self.word: dict[str, int] = {}

    def of(self, found: list[Block], at: int = 0, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``found``: a page's blocks, or those from place ``at`` of a page of ``size`` blocks."""
        if len(self.path) > 50_000 or len(self.word) > 300_000:
            self.path.clear(), self.word.clear()
        path_ids, path_n, word_ids, word_n, numbers = [], [], [], [], []
        for k, b in enumerate(found):
            if (above := (b.path, b.last)) not in self.path:
                self.path[above] = np.array(sorted({_hash(n, PATH_SPACE) for n in b.path} | {_hash("last " + b.last, PATH_SPACE)}), np.int64)
            words = b.text.split()
            for w in words:
                if w not in self.word:
                    self.word[w] = _hash(w.lower(), WORD_SPACE)
            path_ids.append(ids := self.path[above]), path_n.append(len(ids))
            word_ids.extend(map(self.word.__getitem__, words)), word_n.append(len(words))
            numbers.append((np.log1p(b.size) / 8, min(1, b.link), (at + k) / max(1, (size or len(found)) - 1), b.text[-1] in ".!?…", len(b.path) / 16, *(MARK * m for m in b.marks)))
        return np.concatenate(path_ids), np.array(path_n), np.array(word_ids, np.int64), np.array(word_n), np.array(numbers, np.float32)


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 3):
        rng, size = np.random.default_rng(seed), PATH_DIM + WORD_DIM + NUMBERS
        f = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
        self.path, self.word = f(PATH_SPACE, PATH_DIM), f(WORD_SPACE, WORD_DIM) * np.float32(0.1)
        self.w = [f(size + HIDDEN, 4 * HIDDEN) for _ in range(2)]
        self.b = [np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32) for _ in range(2)]
        self.out, self.out_b, self.own = f(2 * HIDDEN), np.zeros(1, np.float32), f(NUMBERS)

    def params(self) -> list[np.ndarray]:
        return [self.path, self.word, *self.w, *self.b, self.out, self.out_b, self.own]

    def inputs(self, feats: tuple) -> np.ndarray:
        path_ids, path_n, word_ids, word_n, numbers = feats
        p = np.add.reduceat(self.path[path_ids], np.cumsum(path_n) - path_n)
        w = np.add.reduceat(self.word[word_ids], np.cumsum(word_n) - word_n) / word_n[:, None].astype(np.float32)
        return np.concatenate([p, w, numbers], 1)

    def run(self, x: np.ndarray, side: int, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: steps x pages x inputs; hidden states for each step, and what training needs."""
        steps, n, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        hs, kept = np.empty((steps, n, HIDDEN), np.float32), []
        size = x.shape[2]
        xw = x @ self.w[side][:size] + self.b[side]
        for t in range(steps):
            z = xw[t] + h @ self.w[side][size:]
            f, i, o = (_sig(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = hs[t] = o * tc
            if keep:
                kept.append((f, i, o, g, before, tc, h_before))
        return hs, kept

    def scores(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """For pages of like length: the chance of main text for each block."""
        n, size = len(xs), [len(x) for x in xs]
        steps = max(size)
        pad, back = np.zeros((2, steps, n, xs[0].shape[1]), np.float32)
        for k, x in enumerate(xs):
            pad[: size[k], k], back[: size[k], k] = x, x[::-1]
        a, b = self.run(pad, 0)[0], self.run(back, 1)[0]
        return [_sig(np.concatenate([a[:s, k], b[:s, k][::-1]], 1) @ self.out + xs[k][:, -NUMBERS:] @ self.own + self.out_b) for k, s in enumerate(size)]

    def grads(self, feats: tuple, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean loss over one page's blocks."""
        x = self.inputs(feats)
        n = len(x)
        seq = [x[:, None], x[::-1][:, None]]
        (a, ka), (b, kb) = (self.run(s, k, True) for k, s in enumerate(seq))
        h = np.concatenate([a[:, 0], b[::-1, 0]], 1)
        d = ((_sig(h @ self.out + x[:, -NUMBERS:] @ self.own + self.out_b) - y) / n).astype(np.float32)
        dh, gx, gw, gb = d[:, None] * self.out, np.zeros_like(x), [], []
        for side, (kept, own) in enumerate(((ka, dh[:, :HIDDEN]), (kb, dh[::-1, HIDDEN:]))):
            w, s = self.w[side], seq[side]
            dw, db, dx = np.zeros_like(w), np.zeros_like(self.b[side]), np.zeros_like(x)
            next_h = next_c = np.zeros((1, HIDDEN), np.float32)
            for t in range(n - 1, -1, -1):
                f, i, o, g, before, tc, h_before = kept[t]
                th = own[t] + next_h
                dc = next_c + th * o * (1 - tc * tc)
                dz = np.concatenate([dc * before * f * (1 - f), dc * g * i * (1 - i), th * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                both = np.concatenate([s[t], h_before], 1)
                dw += both.T @ dz
                db += dz[0]
                back = dz @ w.T
                dx[t], next_h, next_c = back[0, : x.shape[1]], back[:, x.shape[1] :], dc * f
            gw.append(dw), gb.append(db)
            gx += dx if side == 0 else dx[::-1]
        path_ids, path_n, word_ids, word_n, numbers = feats
        gp, gword = np.zeros_like(self.path), np.zeros_like(self.word)
        np.add.at(gp, path_ids, np.repeat(gx[:, :PATH_DIM], path_n, 0))
        np.add.at(gword, word_ids, np.repeat(gx[:, PATH_DIM : PATH_DIM + WORD_DIM] / word_n[:, None], word_n, 0))
        return [gp, gword, *gw, *gb, h.T @ d, d.sum(keepdims=True), numbers.T @ d]


def fit(pages: list[str], epochs: int = 6, seed: int = 3) -> Labeller | None:
    rng, feats, examples, seen = random.Random(seed), Features(), [], 0
    for page in pages:
        for variant in (page, vary(page, rng), vary(page, rng)):
            found = blocks(variant)
            labels = weak_labels(found)
            for at in range(0, len(found), RUN):  # each run has the same chance to be among those kept
                seen += 1
                place = len(examples) if len(examples) < MAX_RUNS else rng.randrange(seen)
                if place < MAX_RUNS:
                    examples[place : place + 1] = [(feats.of(found[at : at + RUN], at, len(found)), labels[at : at + RUN])]
    if not examples:
        return None
    model = Labeller(seed)
    adam = Adam(model.params(), 0.01)
    for epoch in range(epochs):
        rng.shuffle(examples)
        adam.rate = 0.01 * (1 - epoch / epochs)
        for at in range(0, len(examples), 4):
            each = [model.grads(f, y) for f, y in examples[at : at + 4]]
            adam.step([sum(gs) / len(each) for gs in zip(*each, strict=True)])
    return model


def train(pages: DataFrame) -> Labeller | None:
    sound = pages.where(F.col("page_id").isNotNull() & (F.length("html") <= MAX_TRAIN_CHARS))
    ids = sound.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(MAX_PAGES).distinct()
    got = sound.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi").orderBy("page_id").limit(MAX_PAGES)
    return fit([r["html"] for r in got.collect()])


def main_text(page: str | None, model: Labeller | None, feats: Features) -> str:
    return main_texts([page], model, feats)[0]


def main_texts(pages: list[str | None], model: Labeller | None, feats: Features) -> list[str]:
    found = [blocks(p) for p in pages]
    if model is None:
        return ["\n\n".join(b.text for b in f if "head" not in b.path) for f in found]
    out, full = [""] * len(pages), sorted((k for k, f in enumerate(found) if f), key=lambda k: len(found[k]))
    while full:
        fit_in = next((n for n in range(1, len(full)) if (n + 1) * len(found[full[n]]) > CELLS), len(full))
        some, full = full[:fit_in], full[fit_in:]
        for k, s in zip(some, model.scores([model.inputs(feats.of(found[k])) for k in some]), strict=True):
            out[k] = "\n\n".join(b.text for b, p in zip(found[k], s, strict=True) if p > 0.5)
    return out


def extract(pages: DataFrame, model: Labeller | None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = Features()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = main_texts(part.column(2).to_pylist(), model, feats)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")
