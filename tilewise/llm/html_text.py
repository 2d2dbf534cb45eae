"""Main text of HTML pages by a recurrent block labeller.

A page is read into blocks, the runs of text between block-level tags, each with the tags, classes and ids above it. A
block's vector holds its hashed tag path, its hashed words and a few measures (length, links, punctuation, place). A
bidirectional LSTM in numpy reads the page's blocks in order, so each is labelled in the light of the whole document.

Training is on at most TRAIN_PAGES pages, a parameter, those with the smallest hashes of url and html, labelled by their own markup
(containers of content and of everything around it), and on as many made-up pages that put the same texts into other
layouts, with comments, forms, notices and side bars; in a part of both the telling tags and names are taken away, or
others put beside them, so that words, links and context have to do. Labelling covers all pages and whole texts.

Defined results: a null or empty html, or one without content blocks, gives an empty text; markup that is broken is
closed as browsers do (a head by what can't be in it, elements more than DEPTH deep are not nested further); rows that repeat give the same; a null url or id is carried; a table without pages gives an empty
one; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import key_uniform, table

TRAIN_PAGES, EPOCHS, HIDDEN, PATH_DIM, WORD_DIM, MEASURES = 250, 6, 20, 96, 48, 8
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style noscript template svg math textarea select object canvas audio video iframe head title".split())
FOREIGN_TAGS = frozenset(("svg", "math"))
#: HTML that ends an open svg or math, and elements of those that may hold HTML.
LEAVES_FOREIGN = (BLOCK_TAGS | frozenset("a b big br center code em embed font hr i img listing nobr ruby s small span strike strong sub sup tt u var".split())) - frozenset(("a", "title", "option", "label", "button", "select"))
HOLDS_HTML = frozenset(("foreignobject", "annotation-xml", "desc", "title", "mi", "mo", "mn", "ms", "mtext"))
#: What a head may hold; anything else ends it.
HEAD_TAGS = frozenset("base link meta noscript script style template title".split())
#: Most elements above one another that are told apart, as in browsers; most blocks and most padded blocks that are scored at once.
DEPTH, BLOCKS, CELLS, STEPS = 512, 20_000, 32_768, 512
CLOSED_BY = {"p": BLOCK_TAGS - {"br", "button", "label"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Names of containers, as tags, classes or ids.
CONTENT = frozenset("article main content story post entry body-text articlebody prose".split())
AROUND = frozenset("nav header footer aside form menu navbar navigation sidebar side ad ads advert advertisement banner promo sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay comment comments reply replies discussion disqus share social related recommended breadcrumb breadcrumbs widget subscribe newsletter pagination pager copyright disclaimer login search toolbar masthead legal button".split())


_buckets: dict[str, int] = {}


def _bucket(name: str) -> int:
    if (b := _buckets.get(name)) is None:
        b = zlib.crc32(name.encode("utf-8", "surrogatepass"))
        if len(_buckets) < 200_000:
            _buckets[name] = b
    return b


class Path:
    """The names of the elements above a block: what vectors and labels need of them, made from the path above by its own names alone."""

    __slots__ = ("buckets", "tail", "kind", "plain", "below")

    def __init__(self, above: Path | None, names: list[str], plain: bool = True):
        self.buckets = above.buckets.copy() if above else np.zeros(PATH_DIM, bool)
        self.buckets[[_bucket(n) % PATH_DIM for n in names]] = True
        self.tail = ((above.tail if above else ()) + tuple(names))[-3:]
        kind = above.kind if above else None
        for n in (n.lstrip(".") for n in names):
            # a header inside the content holds its headline; what lies around stays around
            kind = 0 if n in AROUND and not (n == "header" and kind) else 1 if n in CONTENT and kind is None else kind
        #: 1 inside content, 0 around it, None if nothing tells.
        self.kind = kind
        #: The same path without the names of containers.
        self.plain = Path(above.plain if above else None, ["div" if n in CONTENT or n in AROUND else n for n in names if not (n[0] == "." and n[1:] in CONTENT | AROUND)], False) if plain else None
        self.below: dict[tuple[str, ...], Path] = {}

    def child(self, names: list[str]) -> Path:
        """The path of an element of these names in this one; alike elements have one path."""
        key = tuple(names)
        if (path := self.below.get(key)) is None:
            path = self.below[key] = Path(self, names)
        return path


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class Reader(HTMLParser):
    """The blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def read(self, html: str) -> list[Block]:
        self.reset()
        self.stack: list[tuple[str, Path, bool]] = []
        self.deep: Counter[str] = Counter()
        self.top = Path(None, [])
        self.blocks, self.parts, self.linked, self.silent, self.links = [], [], 0, 0, 0
        self.feed(html)
        if self.rawdata.startswith(("<!", "<?")):
            self.rawdata = ""  # a comment, declaration or CDATA without an end goes on to the end of the page
        self.close()
        self._flush()
        return self.blocks

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.stack[-1][1] if self.stack else self.top, text, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, _, hidden = self.stack.pop()
            self.silent -= tag in SILENT_TAGS or hidden
            self.links -= tag == "a"

    def _close(self, tags: tuple[str, ...]) -> None:
        """Ends an open element of one of these tags that nothing but such elements is in."""
        while self.stack and self.stack[-1][0] in tags:
            self._pop(len(self.stack) - 1)

    def _breaks(self, tag: str) -> bool:
        """Whether a tag ends the block before it; the title of an svg doesn't."""
        return tag in BLOCK_TAGS and not (tag == "title" and any(above in FOREIGN_TAGS for above, _, _ in self.stack))

    def _leave_foreign(self) -> None:
        """Ends an svg or math that isn't closed where HTML begins inside it, as browsers do."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in HOLDS_HTML:
                return
            if self.stack[i][0] in FOREIGN_TAGS:
                self._pop(i)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in LEAVES_FOREIGN and self.silent:
            self._leave_foreign()
        if tag not in HEAD_TAGS:
            self._close(("head", "title"))
        if self._breaks(tag):
            self._flush()
            if tag not in ("option", "hr", "button", "legend"):
                self._close(("option", "optgroup", "select"))
            for i in range(len(self.stack) - 1, -1, -1):
                above = self.stack[i][0]
                if tag in CLOSED_BY.get(above, ()):
                    self._pop(i)
                    break
                if above in FOREIGN_TAGS or above in HOLDS_HTML or above in ("div", "article", "section", "ul", "ol", "table", "td", "li", "nav", "footer", "main", "body"):
                    break
        if tag in VOID_TAGS:
            return
        names, hidden = [tag], False
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                names += [f".{x}" for x in re.split(r"[^a-z0-9]+", v.lower()) if x]
            hidden |= k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in (v or "").replace(" ", "").lower()
        if len(self.stack) >= DEPTH and tag not in SILENT_TAGS and not hidden:
            self.deep[tag] += 1
            return
        self.stack.append((tag, (self.stack[-1][1] if self.stack else self.top).child(names), hidden))
        self.silent += tag in SILENT_TAGS or hidden
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """The slash makes foreign elements, svg and math and what lies in them, empty; browsers ignore it on others."""
        if tag not in FOREIGN_TAGS and not any(above in FOREIGN_TAGS for above, _, _ in self.stack):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self._breaks(tag):
            self._flush()
        if self.deep[tag] > 0:
            self.deep[tag] -= 1
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                break

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._close(("head",))
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def vectors(blocks: list[Block], noise: random.Random | None = None) -> np.ndarray:
    """One row per block: tag path, words, measures; noise: of the names that tell nothing, which pages are full of, on some paths."""
    others: dict[int, list[int]] = {}
    out = np.zeros((len(blocks), PATH_DIM + WORD_DIM + MEASURES), np.float32)
    for i, b in enumerate(blocks):
        row, words = out[i], b.text.lower().split()
        row[:PATH_DIM] = b.path.buckets
        if noise:
            if (some := others.get(id(b.path))) is None:
                some = others[id(b.path)] = [noise.randrange(PATH_DIM) for _ in range(noise.randint(0, 4))]
            row[some] = 1
        for a, c in zip(b.path.tail, b.path.tail[1:], strict=False):
            row[_bucket(f"{a}>{c}") % PATH_DIM] = 1
        h = np.array([_bucket(w) for w in words], np.int64)
        row[PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(h % WORD_DIM, 1.0 - 2 * (h >> 20 & 1), WORD_DIM) / np.sqrt(len(words))
        n = len(b.text)
        row[-MEASURES:] = (np.log1p(len(words)) / 5, min(1, b.linked / n), len(words) < 4, sum(map(b.text.count, ".,;!?")) / len(words) / 2, i / len(blocks), np.log1p(len(blocks)) / 5, b.text[-1] in ".!?", np.log1p(n / len(words)) / 3)
    return out


class Labeller:
    """A bidirectional LSTM and a sigmoid over its states."""

    def __init__(self, seed: int = 2, hidden: int = HIDDEN, size: int = PATH_DIM + WORD_DIM + MEASURES):
        rng, h = np.random.default_rng(seed), hidden
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        forget = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.hidden = h
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(size, 4 * h)), ("U", draw(h, 4 * h)), ("b", forget.copy()))} | {"o": draw(2 * h, 1), "c": np.zeros(1, np.float32)}

    @staticmethod
    def _turned(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each sequence of x (pages x steps x size) from its last element to its first."""
        at = np.arange(x.shape[1])[None]
        return np.take_along_axis(x, np.where(at < n[:, None], n[:, None] - 1 - at, at)[:, :, None], 1)

    def _run(self, x: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """The states of all steps, and what the way back needs of each if that is to be kept."""
        h, (pages, steps, _), n = np.zeros((len(x), self.hidden), np.float32), x.shape, self.hidden
        c, out, kept = h, np.empty((pages, steps, n), np.float32), []
        for lo in range(0, steps, STEPS):
            gates = x[:, lo : lo + STEPS] @ self.p["W" + d] + self.p["b" + d]
            for t in range(gates.shape[1]):
                a = gates[:, t] + h @ self.p["U" + d]
                s = 1 / (1 + np.exp(-a[:, : 3 * n]))
                i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(a[:, 3 * n :])
                before, c = c, f * c + i * g
                tc = np.tanh(c)
                if keep:
                    kept.append((h, before, i, f, o, g, tc))
                h = o * tc
                out[:, lo + t] = h
        return out, kept

    def _back(self, x: np.ndarray, kept: list, d_out: np.ndarray, d: str, grads: dict) -> None:
        n, dh, dc, u = self.hidden, 0, 0, self.p["U" + d]
        da_all = np.empty((*d_out.shape[:2], 4 * n), np.float32)
        for t in reversed(range(x.shape[1])):
            h, before, i, f, o, g, tc = kept[t]
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - tc**2)
            da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
            grads["U" + d] += h.T @ da
            da_all[:, t] = da
            dh, dc = da @ u.T, dc * f
        grads["W" + d] += np.einsum("pts,ptg->sg", x, da_all, optimize=True)
        grads["b" + d] += da_all.sum((0, 1))

    def scores(self, pages: list[np.ndarray], batch: int = 64) -> list[np.ndarray]:
        """The probability of each block of each page that it is content."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            # the longest of a batch are its last, so the cells of a batch are bounded unless a page alone has more
            k = 1
            while k < min(batch, len(order)) and (k + 1) * len(pages[order[k]]) <= CELLS:
                k += 1
            some, order = order[:k], order[k:]
            x, n = self._padded([pages[i] for i in some])
            y = self._forward(x, n, keep=False)[0]
            for i, row, k in zip(some, y, n, strict=True):
                out[i] = row[:k]
        return out

    @staticmethod
    def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(p) for p in pages])
        x = np.zeros((len(pages), n.max(), pages[0].shape[1]), np.float32)
        for row, p in zip(x, pages, strict=True):
            row[: len(p)] = p
        return x, n

    def _forward(self, x: np.ndarray, n: np.ndarray, keep: bool = True):
        turned = self._turned(x, n)
        fw, kf = self._run(x, "f", keep)
        bw, kb = self._run(turned, "b", keep)
        both = np.concatenate([fw, self._turned(bw, n)], 2)
        y = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["c"])[:, :, 0]))
        return y, turned, kf, kb, both

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 16, rate: float = 8e-3) -> list[float]:
        rng, m, v, t, losses = np.random.default_rng(3), {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0, []
        usable = [i for i in range(len(pages)) if len(pages[i])]
        for _ in range(epochs):
            by_size = sorted(usable, key=lambda i: len(pages[i]) + rng.random())
            groups = [by_size[i : i + batch] for i in range(0, len(by_size), batch)]
            loss = 0.0
            for g in rng.permutation(len(groups)):
                x, n = self._padded([pages[i] for i in groups[g]])
                mask = np.arange(x.shape[1])[None] < n[:, None]
                want = np.zeros(mask.shape, np.float32)
                for row, i in zip(want, groups[g], strict=True):
                    row[: len(labels[i])] = labels[i]
                y, turned, kf, kb, both = self._forward(x, n)
                loss -= float(np.log(np.where(want > 0, y, 1 - y)[mask] + 1e-9).mean()) / len(groups)
                d = ((y - want) * mask / mask.sum())[:, :, None].astype(np.float32)
                grads = {k: np.zeros_like(w) for k, w in self.p.items()}
                grads["o"], grads["c"] = np.einsum("pth,ptk->hk", both, d), d.sum((0, 1))
                d_both = d @ self.p["o"].T
                self._back(x, kf, d_both[:, :, : self.hidden], "f", grads)
                self._back(turned, kb, self._turned(d_both[:, :, self.hidden :], n), "b", grads)
                t += 1
                for k, gr in grads.items():
                    m[k] += 0.1 * (gr - m[k])
                    v[k] += 0.01 * (gr * gr - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
            losses.append(loss)
        return losses


def markup_labels(blocks: list[Block]) -> list[int]:
    """1 for blocks whose innermost telling container is one of content; without any, for long blocks with few links."""
    told = [b.path.kind for b in blocks]
    if 1 in told:
        return [int(k == 1) for k in told]
    return [int(k is None and len(b.text.split()) >= 8 and b.linked < len(b.text) / 3) for k, b in zip(told, blocks, strict=True)]


def hidden_names(blocks: list[Block]) -> list[Block]:
    """The blocks without the names of containers."""
    return [Block(b.path.plain, b.text, b.linked) for b in blocks]


def made_up_page(rng: random.Random, content: list[str], around: list[str]) -> tuple[list[Block], list[int]]:
    """Blocks of a page in one of many layouts, with their labels."""
    blocks, labels = [], []
    pick = lambda xs: rng.choice(xs) if xs else "text"

    def put(path: list[str], text: str, label: int, linked: bool = False) -> None:
        blocks.append(Block(Path(None, ["html", "body", *path]), text, len(text) if linked else 0))
        labels.append(label)

    def short(a: int, b: int) -> str:
        words = pick(content + around).split()
        i = rng.randrange(len(words))
        return " ".join(words[i : i + rng.randint(a, b)]) or "more"

    def side(names: list[list[str]], a: int, b: int, many: tuple[int, int], linked: float) -> None:
        path = rng.choice(names)
        for _ in range(rng.randint(*many)):
            # what lies around can be as long as content
            long = rng.random() < 0.3
            put([*path, *rng.choice([["ul", "li"], ["p"], ["div"], ["span"], []])], pick(content) if long and linked < 0.5 else short(a, b), 0, rng.random() < linked)

    if rng.random() < 0.5:
        side([["header"], ["div", ".header"], ["div", ".masthead"], ["div", ".banner"], ["div", ".cookie", ".notice"], ["div", ".alert"]], 1, 12, (1, 3), 0.3)
    side([["nav"], ["div", ".nav"], ["div", ".menu"], ["ul", ".menu"], ["div", ".breadcrumbs"]], 1, 3, (2, 9), 0.95)
    if rng.random() < 0.6:
        side([["div", ".ad"], ["div", ".ads"], ["aside", ".promo"], ["div", ".sponsored"], ["aside"]], 2, 20, (1, 2), 0.3)
    inside = rng.choice([["article"], ["main"], ["main", "article"], ["div", ".content"], ["div", ".post"], ["div", ".entry", ".content"], ["section", ".story"], ["div", ".main"]])
    put([*inside, *rng.choice([["h1"], ["header", "h1"], ["h2"]])], short(2, 12), 1)
    for i in range(rng.randint(1, 9)):
        put([*inside, *rng.choice([["p"], ["p"], ["p", "b"], ["blockquote"], ["ul", "li"], ["h2"], ["div"], ["pre"], ["table", "tr", "td"]])], pick(content) if rng.random() < 0.75 else short(1, 8), 1, rng.random() < 0.05)
        if i and rng.random() < 0.12:
            side([[*inside, "aside"], [*inside, "div", ".ad"], [*inside, "div", ".share"], [*inside, "form", ".newsletter"], [*inside, "div", ".related"]], 2, 12, (1, 3), 0.4)
    if rng.random() < 0.4:
        side([["section", ".comments"], ["div", ".comments", "div", ".comment"], [*inside, "div", ".comments"], ["ol", ".comment", ".list"], ["div", ".discussion"]], 3, 40, (1, 6), 0.1)
    if rng.random() < 0.5:
        side([["aside"], ["div", ".sidebar"], ["div", ".widget"], ["div", ".related"], ["form"], ["form", ".subscribe"]], 1, 12, (1, 5), 0.6)
    side([["footer"], ["div", ".footer"], ["div", ".copyright"], ["footer", ".legal"]], 2, 20, (1, 4), 0.3)
    return blocks, labels


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, epochs: int = EPOCHS) -> Labeller:
    """A labeller from a bounded sample of pages (url, html), and no more made-up pages than those (30 at least)."""
    n = pages.count()
    key = key_uniform("url", "html", seed=2)
    # twice as many as are wanted pass the first cut, so that it leaves some to spare; the order decides, not the layout
    some = pages.where(F.col("html").isNotNull()).where(key < min(1.0, (2 * train_pages + 100) / max(1, n)))
    sample = some.orderBy(key, "url", "html").select("html").limit(train_pages).collect()
    rng, reader, x, y, content, around = random.Random(20), Reader(), [], [], [], []
    for (html,) in sorted(sample):
        blocks = reader.read(html)
        labels = markup_labels(blocks)
        for b, label in zip(blocks, labels, strict=True):
            (content if label else around).append(b.text)
        plain = rng.random() < 0.5
        x.append(vectors(hidden_names(blocks) if plain else blocks, rng if plain or rng.random() < 0.4 else None))
        y.append(np.array(labels, np.float32))
    for _ in range(max(30, len(sample))):
        blocks, labels = made_up_page(rng, content, around)
        plain = rng.random() < 0.5
        x.append(vectors(hidden_names(blocks) if plain else blocks, rng if plain or rng.random() < 0.4 else None))
        y.append(np.array(labels, np.float32))
    model = Labeller()
    model.train(x, y, epochs if len(sample) > 50 else 4 * epochs)
    return model


def main_text(pages: DataFrame, model: Labeller, cut: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of all pages."""
    schema = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, m = Reader(), sent.value
        for batch in batches:
            lo, blocks, held = 0, [], 0
            for row, html in enumerate(batch.column(2)):
                blocks.append(reader.read(html.as_py() or ""))
                held += len(blocks[-1])
                if held < BLOCKS and len(blocks) < 256 and row + 1 < batch.num_rows:
                    continue
                part, lo = batch.slice(lo, len(blocks)), row + 1
                kept = [[b.text for b, s in zip(bs, ss, strict=True) if s > cut] for bs, ss in zip(blocks, m.scores([vectors(bs) for bs in blocks]), strict=True)]
                texts = [" ".join(k) for k in kept]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in blocks], pa.int64()), pa.array([len(k) for k in kept], pa.int64())], names=[f.split()[0] for f in schema.split(", ")])
                blocks, held = [], 0

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages))
