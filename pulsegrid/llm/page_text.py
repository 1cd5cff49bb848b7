"""HTML extraction by a recurrent block labeller.

A page is a sequence of blocks. Each block becomes a vector: the mean of learned vectors of the hashed names on its tag
path, the mean of learned vectors of its hashed words, and a few numbers. A bidirectional LSTM, in numpy, reads the
whole sequence both ways and gives every block the probability of being main text, so each decision sees the document
around it. Blocks at a half or more are joined.

There are no labelled pages, so the labeller learns from layouts: texts of a bounded sample of the given pages are laid
out anew, inside containers drawn from the words that page authors use for articles and for what stands around them.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.html_blocks import Block, Place, blocks_of, place_of
from pulsegrid.llm.shared import grouped, whole_text

BUCKETS = 1 << 13
PATH, WORD, NUMBERS, HIDDEN = 16, 6, 5, 20

# How authors name things. Elements, then words of class, id or role.
ARTICLE = ["article", "main", "main article", "main .content", "div.content", "div.main-content", "div.article-body", "div.post", "div.entry-content",
           "section.story", "div.post-content article", "article.post", "div.text", "div.story-body", "main.article", "div.page-body", "article.entry",
           "div.blog-post", "div.main", "section.article", "div.body-copy", "td.content", "div.markdown-body"]
SIDE = {
    "menu": ["nav ul li", "nav", "div.menu ul li", "div.navbar", "ul.nav li", "div.navigation", "div.breadcrumbs", "nav.breadcrumb ol li", "div.topnav",
             "aside nav ul li", "div.toc ul li", "ul.menu li", "div.pagination", "nav.pager", "div.skip-links", "div.tabs", "section.navigation"],
    "header": ["header", "header h1", "div.header", "div.masthead", "div.site-header h1", "header.banner", "div.topbar", "header.top p", "div.logo", "div.branding", "header nav"],
    "footer": ["footer", "footer p", "div.footer", "div.site-footer p", "footer.bottom", "div.copyright", "div.colophon", "small.legal", "footer ul li", "section.footer", "div.imprint"],
    "side": ["aside", "aside p", "div.sidebar", "div.sidebar p", "div.side h3", "aside.widget ul li", "div.widget", "div.related ul li", "section.related h3",
             "div.recommended", "div.trending li", "div.popular", "div.rail", "aside h2", "div.secondary", "aside.sidebar h3", "div.more-stories", "div.author-box", "div.tags", "div.read-next p"],
    "notice": ["div.notice", "div.cookie-notice", "div.cookie-banner p", "div.alert", "div.warning", "div.gdpr", "div.consent p", "div.announcement", "div.disclaimer",
               "div.popup", "div.modal p", "div.notification", "p.notice", "section.notice p", "div.message", "div.overlay p", "dialog p", "div.paywall", "div.toast"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement p", "div.sponsor", "div.sponsored", "div.promo", "div.banner-ad", "aside.ad", "section.promotion p",
               "div.ad-slot", "p.ad", "div.affiliate", "div.adsbygoogle", "ins.ad p", "div.commercial", "figure.advert figcaption", "div.teaser-ad"],
    "form": ["form", "form label", "form p", "form button", "div.newsletter", "form.search button", "div.subscribe p", "div.signup", "div.login form p", "fieldset legend",
             "form.contact label", "button", "form div", "div.search", "form fieldset label", "div.share", "div.social ul li", "form.subscribe p"],
    "comment": ["div.comments", "div.comments p", "section.comments h2", "div.comment p", "ol.comment-list li p", "section.discussion p", "div.replies p", "div.reader-comments p",
                "ul.comments li", "div.comment-body p", "article.comment p", "div.responses p", "section.comments article p", "div.disqus p", "div.feedback p", "div.thread p",
                "li.comment p", "section.reader-comments blockquote", "aside.comments p", "div.comment-form p"],
}
INSIDE = ["p"] * 12 + ["h2", "h3", "ul li", "ol li", "blockquote", "blockquote p", "table tr td", "pre", "figure figcaption", "section p", "div p", "section h2", "div", "dl dd", "div.row p"]
WRAPPERS = ["", "", "", "div.wrapper", "div.page", "div.container", "div.site", "div.layout div.row", "div.root", "div.main-wrapper", "table tr td"]
FILLER = ["clearfix", "row", "col", "md", "6", "12", "inner", "outer", "block", "section", "box", "css", "js", "js2", "wrap", "left", "center", "wide", "dark", "v2", "item", "default", "text"]


@dataclass
class FitParams:
    """`fit_pages` bounds the pages whose texts are learnt from: those whose ids have the smallest hashes."""

    fit_pages: int = 300
    layouts: int = 900
    epochs: int = 12
    batch: int = 32
    rate: float = 0.006
    seed: int = 17
    threshold: float = 0.5


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def element(said: str) -> tuple[str, ...]:
    tag, _, names = said.partition(".")
    return (tag or "div", *("." + w for w in names.split("-") if w))


class Layouts:
    """Draws pages as blocks with labels from texts of real pages."""

    def __init__(self, texts: list[str], pick: random.Random):
        self.pick = pick
        self.long = [t for t in texts if len(t) > 60] or ["A text of some length that stands for a paragraph of a page."]
        self.short = [t for t in texts if len(t) <= 60] or ["Home", "About us", "Contact"]

    def path(self, said: str, noise: float = 0.25) -> list[tuple[str, ...]]:
        out = [element(s) for s in said.split()]
        add = lambda: "." + (self.pick.choice(FILLER) if self.pick.random() < 0.6 else f"x{self.pick.randrange(10**6)}")
        return [e + (add(),) if self.pick.random() < noise else e for e in out]

    def words(self, short: float) -> str:
        if self.pick.random() < short:
            t = self.pick.choice(self.short)
            return t if self.pick.random() < 0.5 else " ".join(self.pick.choice(self.long).split()[:self.pick.randrange(1, 7)])
        t = self.pick.choice(self.long)
        return t if self.pick.random() < 0.7 else " ".join(t.split()[:self.pick.randrange(4, 40)])

    def side(self, kind: str, out: list, outer: list):
        where = self.path(self.pick.choice(SIDE[kind]))
        short = {"menu": 0.95, "form": 0.8, "comment": 0.2, "notice": 0.3, "advert": 0.4}.get(kind, 0.55)
        for _ in range(self.pick.randrange(1, 7) if kind in ("menu", "comment", "side") else self.pick.randrange(1, 4)):
            text = self.words(short)
            deeper = self.path(self.pick.choice(["p", "h3", "div", "ul li", "span"])) if self.pick.random() < 0.3 else []
            linked = len(text) if kind == "menu" or self.pick.random() < 0.3 else 0
            out.append((Block(place_of(outer + where + [e for e in deeper if e[0] != "span"]), text, linked), 0))

    def page(self) -> list[tuple[Block, int]]:
        pick, out = self.pick, []
        root = [("html",), ("body",)]
        title = self.words(0.4)
        if pick.random() < 0.9:
            out.append((Block(place_of([("html",), ("head",), ("title",)]), title, 0), 0))
        root = root + self.path(pick.choice(WRAPPERS))
        before = ["menu", "header", "advert", "notice", "form", "side"]
        after = ["comment", "footer", "side", "advert", "form", "notice", "menu", "comment", "footer"]
        for kind in pick.sample(before, pick.randrange(0, 4)):
            self.side(kind, out, root)
        body = root + self.path(pick.choice(ARTICLE))
        if pick.random() < 0.9:
            out.append((Block(place_of(body + self.path(pick.choice(["h1", "h1", "h1", "h2", "header h1"]))), title, 0), 1))
        for _ in range(pick.randrange(1, 14) if pick.random() < 0.85 else pick.randrange(14, 80)):
            text = self.words(0.3)
            out.append((Block(place_of(body + self.path(pick.choice(INSIDE), 0.1)), text, pick.choice([0, 0, 0, len(text) // 5])), 1))
            if pick.random() < 0.1:
                self.side(pick.choice(["advert", "side", "form", "notice", "menu", "comment"]), out, body)
        for kind in pick.sample(after, pick.randrange(0, 5)):
            self.side(kind, out, root if pick.random() < 0.8 else body)
        return out


@dataclass
class Sequence:
    path: list[np.ndarray] = field(default_factory=list)  # hashed names on the path of each block
    word: list[np.ndarray] = field(default_factory=list)  # hashed words of each block
    number: list[list[float]] = field(default_factory=list)


class Seen(NamedTuple):
    """Hashed names of a path: of all its elements, and with the innermost one's marked."""

    number: int
    inside: frozenset[int]
    marked: np.ndarray


_numbers = iter(range(1 << 62))
_NOWHERE = Seen(next(_numbers), frozenset(), np.array([bucket("none")]))
_AT_MOST = 100_000


def seen_at(place: Place | None, known: dict) -> Seen:
    """The hashed names of a place; each element adds to what is around it, so a path costs what is new on it."""
    new = []
    while place is not None and place.seen is None:
        new.append(place)
        place = place.outer
    seen = _NOWHERE if place is None else place.seen
    for place in reversed(new):
        key = seen.number, place.names
        if key not in known:
            if len(known) > _AT_MOST:
                known.clear()
            more = {bucket("in" + n) for n in place.names}
            inside = seen.inside if more <= seen.inside else seen.inside | more
            marked = np.array(sorted(inside | {bucket("at" + n) for n in place.names}))
            known[key] = Seen(next(_numbers), inside, marked)
        place.seen = seen = known[key]
    return seen


def vectors(blocks: list[Block], known: dict) -> Sequence:
    """Hashed names and words of the blocks. `known` remembers the hashes of paths."""
    out = Sequence()
    for b in blocks:
        out.path.append(seen_at(b.place, known).marked)
        words = b.text.lower().split()
        out.word.append(np.fromiter(((hash_of(w)) for w in words), dtype=np.int64, count=len(words)))
        n = len(b.text)
        marks = sum(b.text.count(c) for c in ".,;:!?")
        depth = 0 if b.place is None else b.place.depth
        out.number.append([np.log1p(n) / 8, np.log1p(len(words)) / 6, b.linked / n, marks / len(words), depth / 10])
    return out


def hash_of(word: str) -> int:
    """Stable from run to run, unlike Python's own hash."""
    return zlib.crc32(word.encode()) & (BUCKETS - 1)


def means(table: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(p) for p in places])
    flat = np.concatenate(places)
    return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes) / sizes[:, None]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network. Sequences of a batch are padded at their ends; a mask stops states at padding."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        width = PATH + WORD + NUMBERS
        self.w = {"path": rng.normal(0, 0.3, (BUCKETS, PATH)), "word": rng.normal(0, 0.1, (BUCKETS, WORD)),
                  "out": rng.normal(0, 0.2, (2 * HIDDEN + width, 1)), "bias": np.zeros(1)}
        for d in ("ahead", "back"):
            self.w[d] = rng.normal(0, 0.2, (width + HIDDEN, 4 * HIDDEN))
            self.w[d + "_bias"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def inputs(self, batch: list[Sequence]) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(s.path) for s in batch]
        x = np.zeros((len(batch), max(sizes), PATH + WORD + NUMBERS))
        mask = np.arange(max(sizes)) < np.array(sizes)[:, None]
        x[mask] = np.hstack([means(self.w["path"], [p for s in batch for p in s.path]),
                             means(self.w["word"], [p for s in batch for p in s.word]), np.array([n for s in batch for n in s.number])])
        return x, mask

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        h = np.zeros((len(x), HIDDEN))
        c = np.zeros_like(h)
        out = np.zeros((*mask.shape, HIDDEN))
        from_x = x @ self.w[d][:x.shape[2]] + self.w[d + "_bias"]
        w = self.w[d][x.shape[2]:]
        for t in range(x.shape[1]) if d == "ahead" else range(x.shape[1] - 1, -1, -1):
            z = from_x[:, t] + h @ w
            i, f, o = (sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            fresh = f * c + i * g
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, np.tanh(fresh), m))
            c = np.where(m, fresh, c)
            h = np.where(m, o * np.tanh(fresh), h)
            out[:, t] = h
        return out

    def probabilities(self, batch: list[Sequence]) -> list[np.ndarray]:
        x, mask = self.inputs(batch)
        p = sigmoid(np.concatenate([self._run("ahead", x, mask), self._run("back", x, mask), x], axis=2) @ self.w["out"] + self.w["bias"])[..., 0]
        return [p[k, :len(s.path)] for k, s in enumerate(batch)]

    def gradients(self, batch: list[Sequence], labels: list[np.ndarray]) -> tuple[float, dict]:
        x, mask = self.inputs(batch)
        kept = {"ahead": [], "back": []}
        states = np.concatenate([self._run("ahead", x, mask, kept["ahead"]), self._run("back", x, mask, kept["back"]), x], axis=2)
        y = np.zeros(mask.shape)
        y[mask] = np.concatenate(labels)
        p = sigmoid(states @ self.w["out"] + self.w["bias"])[..., 0]
        loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-12) * mask).sum() / mask.sum()
        dz = ((p - y) * mask / mask.sum())[..., None]
        grads = {"out": np.tensordot(states, dz, ([0, 1], [0, 1])), "bias": dz.sum(axis=(0, 1))}
        ds = dz @ self.w["out"].T
        dx = ds[..., 2 * HIDDEN:].copy()
        for d, part in (("ahead", ds[..., :HIDDEN]), ("back", ds[..., HIDDEN:2 * HIDDEN])):
            w = self.w[d]
            dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN)
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, i, f, o, g, c, h, tc, m in reversed(kept[d]):
                dh = dh + part[:, t]
                live = dh * m
                dfresh = live * o * (1 - tc**2) + dc * m
                da = np.hstack([dfresh * g * i * (1 - i), dfresh * c * f * (1 - f), live * tc * o * (1 - o), dfresh * i * (1 - g**2)])
                dw += np.hstack([x[:, t], h]).T @ da
                db += da.sum(axis=0)
                back = da @ w.T
                dx[:, t] += back[:, :x.shape[2]]
                dh = back[:, x.shape[2]:] + dh * ~m
                dc = dfresh * f + dc * ~m
            grads[d], grads[d + "_bias"] = dw, db
        flat = dx[mask]
        for name, low, high, of in (("path", 0, PATH, "path"), ("word", PATH, PATH + WORD, "word")):
            places = [p for s in batch for p in getattr(s, of)]
            sizes = np.array([len(p) for p in places])
            grads[name] = np.zeros_like(self.w[name])
            np.add.at(grads[name], np.concatenate(places), np.repeat(flat[:, low:high] / sizes[:, None], sizes, axis=0))
        return loss, grads

    def learn(self, pages: list[Sequence], labels: list[np.ndarray], p: FitParams):
        rng = np.random.default_rng(p.seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(p.epochs):
            order = rng.permutation(len(pages))
            rate = p.rate * (1 - epoch / p.epochs)
            for a in range(0, len(order), p.batch):
                some = order[a:a + p.batch]
                _, grads = self.gradients([pages[k] for k in some], [labels[k] for k in some])
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)


def fitted(texts: list[str], p: FitParams = FitParams()) -> Labeller:
    """A labeller for layouts of these texts."""
    draw, known = Layouts(texts, random.Random(p.seed)), {}
    drawn = [draw.page() for _ in range(p.layouts)]
    model = Labeller(p.seed)
    pages = [vectors([b for b, _ in page], known) for page in drawn]
    model.learn(pages, [np.array([y for _, y in page], dtype=float) for page in drawn], p)
    model.w = {k: v.astype(np.float32) for k, v in model.w.items()}
    return model


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", p: FitParams = FitParams()) -> Labeller:
    """Fits on the texts of at most `p.fit_pages` pages."""
    rows = pages.select(F.col(id_col).alias("id"), whole_text(html_col).alias("html"))
    # Thinned first by hash, so that tasks send the driver few more pages than are learnt from.
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, pages.count() // (2 * p.fit_pages)))) == 0)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(p.fit_pages).collect()
    return fitted([b.text for r in some for b in blocks_of(r.html)], p)


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """page_id, url, text of every page, and its blocks as array<struct<text, probability>>.

    No shuffle; a task reads some pages at a time, one very long page alone. A null or empty page, or one without any
    text, has the empty text; null ids and urls and repeated rows are kept as they are; an empty table gives an empty
    result. The whole html is read, whatever is wrong with it.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole_text(html_col).alias("html"))
    kinds = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}"
    shared = rows.sparkSession.sparkContext.broadcast(model.w)  # BUCKETS * (PATH + WORD) numbers, whatever the input

    def work(batches):
        own = Labeller.__new__(Labeller)
        own.w, known = shared.value, {}
        for batch in batches:
            at = 0
            for texts in grouped(batch.column(2).to_pylist()):
                pages_ = [blocks_of(t) for t in texts]
                full = sorted((k for k, b in enumerate(pages_) if b), key=lambda k: len(pages_[k]))
                marks = [[] for _ in texts]
                a = 0
                while a < len(full):  # pages of like length, some thousands of blocks at a time
                    z = a + 1
                    while z < len(full) and z - a < 128 and (z - a + 1) * len(pages_[full[z]]) <= 8000:
                        z += 1
                    for k, p in zip(full[a:z], own.probabilities([vectors(pages_[k], known) for k in full[a:z]])):
                        marks[k] = p.tolist()
                    a = z
                said = ["\n".join(b.text for b, p in zip(blocks, ps) if p >= threshold) for blocks, ps in zip(pages_, marks)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(said, pa.string()),
                    pa.array([[{"text": b.text, "probability": p} for b, p in zip(blocks, ps)] for blocks, ps in zip(pages_, marks)],
                             pa.list_(pa.struct([("text", pa.string()), ("probability", pa.float64())]))),
                ], names=["page_id", "url", "text", "blocks"])
                at += len(texts)

    return rows.mapInArrow(work, f"{kinds}, text string, blocks array<struct<text:string,probability:double>>")
