"""HTML extraction by a recurrent block labeller (operator 7).

A page becomes its sequence of text blocks, each with the names on its tag path, hashed words and shape. A bidirectional LSTM in
numpy reads the whole sequence and says for each block whether it belongs to the article. It is trained here, on blocks
of a bounded sample of the pages: as they stand, labelled by the elements they are in, and set anew into generated layouts
(other containers, side bars, notices, forms, comments, adverts inside the article) whose labels are known.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outfall.llm.common import pieces

#: Pages to train on, at most.
SAMPLE_PAGES = 300
BUCKETS = 1 << 12
EMBED, HIDDEN, SHAPE = 12, 12, 5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_RAW = re.compile(r"(script|style|template|noscript|iframe|textarea|title|svg|select|object)\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style template noscript iframe textarea title svg select object".split()}
_INNER = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+")
_MARK = re.compile(r"['\">]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements that run inside a line of text, that stand alone, and that an opening block closes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Names of elements, classes and ids that mark what is not the article, and what is.
OUTSIDE = frozenset("nav menu footer header aside sidebar form ad ads advert adverts advertisement sponsored promo banner cookie cookies consent notice notices alert newsletter subscribe comment comments "
                    "reply replies discussion related share social breadcrumb breadcrumbs pagination toolbar widget popup modal login search copyright legal disclaimer head button".split())
INSIDE = frozenset("article main content post story entry body text".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


class Tags:
    """Where a tag ends: at the first ``>`` outside of quotes, or with the page.

    A quote that is never closed makes a text of what looked like a tag. To find that out takes a look at the rest of the page; from then on each quote
    is looked at once only, so a page full of such quotes still takes time in proportion to its size.
    """

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[int, int] | None = None

    def _ends(self) -> dict[int, int]:
        """For each quote or ``>``, met outside of quotes: the end of its tag, or -1."""
        marks = [(m.start(), m[0]) for m in _MARK.finditer(self.page)]
        after: dict[str, int] = {}  # the next quote of a kind
        ends: dict[int, int] = {}
        self.marks = [at for at, _ in marks]
        for k in range(len(marks) - 1, -1, -1):
            at, c = marks[k]
            if c == ">":
                ends[k] = at
            else:
                close = after.get(c)
                ends[k] = -1 if close is None else ends.get(close + 1, len(self.page))
                after[c] = k
        return ends

    def end(self, start: int) -> int:
        """The place of the ``>``, the length of the page, or -1."""
        if self.ends is None:
            at = _INNER.match(self.page, start).end()
            if at == len(self.page) or self.page[at] == ">":
                return at
            self.ends = self._ends()
        return self.ends.get(bisect.bisect_left(self.marks, start), len(self.page))


class Stack:
    """Open elements with the names on the way to the innermost, each once, in order; no step looks through all of it."""

    def __init__(self) -> None:
        self.names: list[tuple[str, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.count: dict[str, int] = {}

    def push(self, name: str, hints: list[str]) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        own = (name, *(f".{h}" for h in hints))
        self.names.append((name, own))
        for n in own:
            self.count[n] = self.count.get(n, 0) + 1

    def pop(self) -> None:
        name, own = self.names.pop()
        self.at[name].pop()
        for n in own:
            self.count[n] -= 1
            if not self.count[n]:
                del self.count[n]

    def close(self, name: str) -> None:
        if self.at.get(name):
            to = self.at[name][-1]
            while len(self.names) > to:
                self.pop()

    def path(self) -> tuple[str, ...]:
        return tuple(self.count)


def tokens(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing, name, attributes) of markup; the name of what is no element, or holds no text to read, is None."""
    tags, at = Tags(page), 0
    while m := _TOKEN.search(page, at):
        if m[2] is None:
            yield m.start(), m.end(), False, None, ""
            at = m.end()
            continue
        raw = None if m[1] else _RAW.match(page, m.start(2))
        if raw and 0 <= (end := tags.end(raw.end())) < len(page):
            stop = _RAW_END[raw[1].lower()].search(page, end + 1)
            at = stop.end() if stop else len(page)
            yield m.start(), at, False, None, ""
            continue
        name = m[2]
        if (end := tags.end(m.end())) < 0 and (quote := _MARK.search(name)):
            name = name[: quote.start()]
            end = tags.end(m.start(2) + len(name))
        if end < 0:
            at = m.start() + 1
            continue
        at = min(end + 1, len(page))
        yield m.start(), at, bool(m[1]), name.lower(), page[m.start(2) + len(name):end]


def blocks(page: str) -> list[Block]:
    """Runs of text between block elements, with character references decoded and white space as one space."""
    out: list[Block] = []
    stack = Stack()
    run: list[str] = []
    linked = anchors = at = 0

    def end() -> None:
        nonlocal linked
        if run and (text := " ".join("".join(run).split())):
            out.append(Block(stack.path(), text, linked))
        run.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            run.append(text)
            if anchors:
                linked += len(text)

    for start, stop, closing, name, attributes in tokens(page):
        say(page[at:start])
        at = stop
        if not name:
            continue
        if name in INLINE:
            anchors = max(0, anchors + (-1 if closing else 1)) if name == "a" else anchors
            continue
        if name in ("br", "hr") or name in VOID:
            run.append(" ")
            continue
        end()
        anchors = 0
        if closing:
            stack.close(name)
            continue
        while stack.names and (stack.names[-1][0] in CLOSES.get(name, ()) or stack.names[-1][0] == "p" and name in CLOSE_P):
            stack.pop()
        hints = [w for a in _ATTRIBUTE.finditer(attributes) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower())] if attributes else []
        stack.push(name, hints)
    say(page[at:])
    end()
    return out


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


@dataclass
class Read:
    """Blocks of many pages as flat arrays: hashed names and words (one list after the other), shape numbers, and each page's bounds."""

    names: np.ndarray
    names_at: np.ndarray
    words: np.ndarray
    words_at: np.ndarray
    shape: np.ndarray
    bound: np.ndarray


def read(pages: list[list[Block]]) -> Read:
    known: dict[str, int] = {}
    bucket = lambda w: known[w] if w in known else known.setdefault(w, _bucket(w))
    names, words, shape, n_at, w_at = [], [], [], [0], [0]
    for page in pages:
        for b in page:
            names += [bucket(n) for n in b.path] or [0]
            n_at.append(len(names))
            said = b.text.split(" ")
            words += [bucket(w) for w in said]
            w_at.append(len(words))
            shape.append((np.log1p(len(b.text)) / 8, min(1.0, b.linked / len(b.text)), min(1.0, sum(w[-1] in ".,;:!?" for w in said) / len(said)), len(said) < 5, b.text[-1] in ".!?"))
    size = [len(p) for p in pages]
    return Read(np.array(names, int), np.array(n_at), np.array(words, int), np.array(w_at), np.array(shape, float).reshape(-1, SHAPE), np.concatenate(([0], np.cumsum(size))).astype(int))


@dataclass
class Labeller:
    """Embeddings of hashed names and words, two LSTMs (forwards, backwards) and the output layer."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        d = 2 * EMBED + SHAPE
        p = {"names": rng.normal(0, 0.3, (BUCKETS, EMBED)), "words": rng.normal(0, 0.05, (BUCKETS, EMBED)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in "fb":
            p[f"w{side}"] = rng.normal(0, 0.25, (d, 4 * HIDDEN))
            p[f"u{side}"] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            p[f"c{side}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
        return Labeller(p)

    def inputs(self, r: Read) -> np.ndarray:
        mean = lambda table, ids, at: np.add.reduceat(table[ids], at[:-1]) / np.diff(at)[:, None]
        return np.column_stack((mean(self.p["names"], r.names, r.names_at), mean(self.p["words"], r.words, r.words_at), r.shape))

    def scores(self, r: Read) -> np.ndarray:
        """Log-odds of each block to belong to the article."""
        if not len(r.shape):
            return np.zeros(0)
        x = self.inputs(r)
        return sum(self._side(x, r.bound, s)["h"] @ self.p["out"][i * HIDDEN:(i + 1) * HIDDEN] for i, s in enumerate("fb")) + self.p["bias"][0]

    def _side(self, x: np.ndarray, bound: np.ndarray, side: str) -> dict:
        """One direction over all pages at once; pages drop out as they end."""
        u = self.p[f"u{side}"]
        z = x @ self.p[f"w{side}"] + self.p[f"c{side}"]
        gates, cells, hidden = np.zeros_like(z), np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        steps = _steps(bound, side == "b")
        for k, (at, before) in enumerate(steps):
            a = z[at] + (hidden[before] @ u if k else 0)
            g = 1 / (1 + np.exp(-np.clip(a, -30, 30)))
            g[:, 3 * HIDDEN:] = np.tanh(a[:, 3 * HIDDEN:])
            i, f, o, new = np.split(g, 4, axis=1)
            cells[at] = i * new + (f * cells[before] if k else 0)
            hidden[at] = o * np.tanh(cells[at])
            gates[at] = g
        return {"h": hidden, "c": cells, "g": gates, "steps": steps}

    def gradient(self, r: Read, y: np.ndarray) -> dict[str, np.ndarray]:
        x = self.inputs(r)
        sides = {s: self._side(x, r.bound, s) for s in "fb"}
        score = sum(sides[s]["h"] @ self.p["out"][i * HIDDEN:(i + 1) * HIDDEN] for i, s in enumerate("fb")) + self.p["bias"][0]
        d = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(y)
        g = {"out": np.concatenate([sides[s]["h"].T @ d for s in "fb"]), "bias": np.array([d.sum()])}
        dx = np.zeros_like(x)
        for n, s in enumerate("fb"):
            run, u = sides[s], self.p[f"u{s}"]
            dh, dc, dz = d[:, None] * self.p["out"][n * HIDDEN:(n + 1) * HIDDEN], np.zeros((len(x), HIDDEN)), np.zeros_like(run["g"])
            g[f"u{s}"] = np.zeros_like(u)
            for k in range(len(run["steps"]) - 1, -1, -1):
                at, before = run["steps"][k]
                i, f, o, new = np.split(run["g"][at], 4, axis=1)
                t = np.tanh(run["c"][at])
                c = dc[at] + dh[at] * o * (1 - t * t)
                old = run["c"][before] if k else 0
                dz[at] = np.column_stack((c * new * i * (1 - i), c * old * f * (1 - f), dh[at] * t * o * (1 - o), c * i * (1 - new * new)))
                if k:
                    dc[before] += c * f
                    dh[before] += dz[at] @ u.T
                    g[f"u{s}"] += run["h"][before].T @ dz[at]
            g[f"w{s}"], g[f"c{s}"] = x.T @ dz, dz.sum(axis=0)
            dx += dz @ self.p[f"w{s}"].T
        for part, ids, at, cols in (("names", r.names, r.names_at, slice(0, EMBED)), ("words", r.words, r.words_at, slice(EMBED, 2 * EMBED))):
            g[part] = np.zeros_like(self.p[part])
            np.add.at(g[part], ids, np.repeat(dx[:, cols] / np.diff(at)[:, None], np.diff(at), axis=0))
        return g


def _steps(bound: np.ndarray, backwards: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    size = np.diff(bound)
    order = np.argsort(-size, kind="stable")
    out = []
    for k in range(int(size.max(initial=0))):
        live = order[: int(np.searchsorted(-size[order], -k))]
        at = bound[1:][live] - 1 - k if backwards else bound[:-1][live] + k
        out.append((at, at + 1 if backwards else at - 1))
    return out


def teach(page: list[Block]) -> list[int]:
    """Labels by element, class and id: what a page's author has marked."""
    marked = any(n.lstrip(".") in INSIDE and n != "body" for b in page for n in b.path)
    inside = lambda b: not marked or any(n.lstrip(".") in INSIDE and n != "body" for n in b.path)
    return [int(inside(b) and not any(n.lstrip(".") in OUTSIDE for n in b.path)) for b in page]


def layouts(said: list[str], rest: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A generated page: article texts in some container, other texts around and inside it."""
    pick = lambda a: a[int(rng.integers(len(a)))]
    tags = ("div", "section", "ul", "aside", "p")
    outside = sorted(OUTSIDE - {"head", "button"})
    named = ("nav", "footer", "header", "aside", "form")

    def other(base: tuple[str, ...]) -> list[Block]:
        word = pick(outside)
        path = (word,) if word in named and rng.random() < 0.6 else (pick(tags), f".{word}", *(() if rng.random() < 0.6 else (f".{pick(outside)}",)))
        leaf = pick((("ul", "li"), ("p",), (), ("div",), ("p",)))
        short = rng.random() < 0.5
        many = [pick(rest if rng.random() < 0.5 else said) for _ in range(int(rng.integers(1, 5)))]
        cut = [" ".join(t.split(" ")[: int(rng.integers(1, 5))]) if short else t for t in many]
        return [Block((*base, *path, *leaf), t, len(t) if leaf == ("ul", "li") else 0) for t in cut]

    base = ("html", "body", *pick(((), (), ("div",), ("div", ".page"), ("div", ".wrapper", ".site"))))
    holder = pick((("article",), ("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("section", ".story"), ("div", ".entry"), ("div", ".article", ".body"), ("div", ".main", ".text")))
    page, labels = [], []
    for _ in range(int(rng.integers(0, 4))):
        found = other(base)
        page, labels = page + found, labels + [0] * len(found)
    for k in range(int(rng.integers(1, 12))):
        leaf = ("h1",) if not k and rng.random() < 0.8 else pick((("p",), ("p",), ("p",), ("p",), ("ul", "li"), ("blockquote", "p"), ("h2",), ()))
        text = pick(said)
        text = " ".join(text.split(" ")[:3]) if rng.random() < 0.15 else text
        page.append(Block((*base, *holder, *leaf), text, 0))
        labels.append(1)
        if rng.random() < 0.12:
            found = other((*base, *holder))
            page, labels = page + found, labels + [0] * len(found)
    for _ in range(int(rng.integers(0, 4))):
        found = other(base)
        page, labels = page + found, labels + [0] * len(found)
    return page, labels


def train(sample: list[list[Block]], rounds: int = 12, batch: int = 32, seed: int = 11) -> Labeller:
    """Adam over the sampled pages and twice as many generated ones."""
    rng = np.random.default_rng(seed)
    known = [(p, teach(p)) for p in sample if p]
    said = [b.text for p, y in known for b, v in zip(p, y, strict=True) if v] or ["Text."]
    rest = [b.text for p, y in known for b, v in zip(p, y, strict=True) if not v] or ["Menu"]
    cases = known + [layouts(said, rest, rng) for _ in range(max(600, 2 * len(known)))]
    model = Labeller.fresh()
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    t = 0
    for turn in range(rounds):
        order = rng.permutation(len(cases))
        for at in range(0, len(order), batch):
            some = [cases[i] for i in order[at:at + batch]]
            g = model.gradient(read([p for p, _ in some]), np.array([v for _, y in some for v in y], float))
            t += 1
            rate = 0.02 * (1 - turn / rounds) + 0.001
            for k in g:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-8)
    return model


def _extract(model: Labeller, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        pages = [blocks(h or "") for h in batch.column("html").to_pylist()]
        score = model.scores(read(pages))
        at, texts = 0, []
        kept = []
        for page in pages:
            inside = [b.text for b, s in zip(page, score[at:at + len(page)], strict=True) if s >= 0]
            at += len(page)
            kept.append(len(inside))
            texts.append(" ".join(inside))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()),
                                          pa.array([len(p) for p in pages], pa.int64()), pa.array(kept, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text of the article, n_chars, and the numbers of blocks and of blocks kept, for every page.

    Null or empty html, or html without text: an empty text. Repeated rows and equal pages get equal texts; other columns are left out.
    No pages: no rows. The labeller is trained on at most about ``sample_pages`` pages chosen by hash; labelling covers all.
    """
    share = min(1.0, sample_pages / max(1, pages.count()))
    chosen = pages.where(F.col("html").isNotNull() & (F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(share * (1 << 30))))
    rows = chosen.select("html", F.xxhash64("html").alias("h")).orderBy("h").limit(2 * sample_pages).collect()
    shared = pages.sparkSession.sparkContext.broadcast(train([blocks(r["html"]) for r in rows]))  # of fixed size
    return pages.select("page_id", "url", "html").mapInArrow(lambda batches: _extract(shared.value, batches), "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
