"""Main text of web pages: a bidirectional LSTM labels every text block of a page as content or not.

A page is cut into leaf blocks, each with its tag path and its words. Both are
hashed into embeddings, so no vocabulary is needed; the network reads the whole
sequence of blocks in both directions before it labels any of them.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches

_PART = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>",
    re.S,
)
#: Elements without text of the page, by their end tags; of those in ``_TO_END`` an unclosed one has the rest of the page.
_RAW = {
    tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
    for tag in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title")
}
_TO_END = frozenset(("script", "style", "textarea", "title"))
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCK - {"button", "label", "option", "select", "body", "html", "head"}
_LANDMARK = frozenset("article main nav aside footer header form".split())
PATHS, WORDS = 512, 2048
_cache: dict[str, int] = {}


def _bucket(word: str, size: int) -> int:
    if len(_cache) > 250_000:
        _cache.clear()
    h = _cache.get(word)
    if h is None:
        h = _cache[word] = zlib.crc32(word.encode())
    return h % size


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...] = field(default=())


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and the title are no text."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[_Open] = []
    held: list[str] = []
    links = linked = 0
    path: tuple[str, ...] | None = None

    def flush():
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Block(path_of(), text, min(linked, len(text))))
            held.clear()
        linked = 0

    def path_of() -> tuple[str, ...]:
        nonlocal path
        if path is None:
            # all near ones; of those further out all that a part of a page is named by, each name once
            near = [x for x in stack if x.tag in _BLOCK]
            far = [n for x in near[:-16] if x.names or x.tag in _LANDMARK for n in (x.tag, *x.names)]
            last = {n: i for i, n in enumerate(far)}
            path = (*(n for i, n in enumerate(far) if last[n] == i), *(n for x in near[-16:] for n in (x.tag, *x.names)))
        return path

    def pop_to(i: int):
        nonlocal path, links
        for x in stack[i:]:
            links -= x.tag == "a"
        del stack[i:]
        path = None

    at, unclosed = 0, set()
    while m := _PART.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW and not m[1]:
            held.append(" ")
            if tag == "svg" and m[3].endswith("/"):
                continue
            end = None if tag in unclosed else _RAW[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in _TO_END:
                at = len(page)
            else:
                unclosed.add(tag)
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            held.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if stack[i].tag in ("ul", "ol", "menu", "table", "tbody", "tr", "dl", "select"):
                    break
        names = tuple(
            w for x in _NAMES.finditer(m[3] or "") for w in re.split(r"[^a-z]+", (x[1] or x[2] or x[3] or "").lower()) if w
        ) if m[3] and tag in _BLOCK else ()
        stack.append(_Open(tag, names))
        links += tag == "a"
        path = None
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def inputs(blocks: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """(path buckets, word buckets, plain numbers) of each block."""
    paths = [[_bucket(p, PATHS) for p in b.path] or [0] for b in blocks]
    words = [[_bucket(w, WORDS) for w in b.text.lower().split()] or [0] for b in blocks]
    plain = np.zeros((len(blocks), 4))
    for i, b in enumerate(blocks):
        n = len(b.text)
        plain[i] = (np.log1p(n) / 5, b.linked / n, i / len(blocks), b.text[-1] in ".!?:")
    return paths, words, plain


class Labeller:
    """Embeddings, an LSTM for each direction and a logistic output, in numpy."""

    def __init__(self, dim: int = 12, hidden: int = 16, seed: int = 7):
        r, d = np.random.default_rng(seed), 2 * dim + 4
        self.hidden = hidden
        self.w = {
            "path": r.normal(0, 0.3, (PATHS, dim)), "word": r.normal(0, 0.05, (WORDS, dim)),
            "f": r.normal(0, 0.2, (d + hidden, 4 * hidden)), "fb": np.zeros(4 * hidden),
            "b": r.normal(0, 0.2, (d + hidden, 4 * hidden)), "bb": np.zeros(4 * hidden),
            "out": r.normal(0, 0.2, (2 * hidden, 1)), "ob": np.zeros(1),
        }
        self.w["fb"][hidden : 2 * hidden] = self.w["bb"][hidden : 2 * hidden] = 1

    def embed(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, list]:
        """(time x page x features, mask, bags) of pages padded to the longest."""
        steps = max(len(p[0]) for p in pages)
        dim = self.w["path"].shape[1]
        x = np.zeros((steps, len(pages), 2 * dim + 4))
        mask = np.zeros((steps, len(pages)))
        bags = []
        for j, (paths, words, plain) in enumerate(pages):
            n, kept = len(paths), []
            for k, (bag, name) in enumerate(((paths, "path"), (words, "word"))):
                flat = np.concatenate([np.asarray(v) for v in bag])
                size = np.array([len(v) for v in bag])
                x[:n, j, k * dim : (k + 1) * dim] = np.add.reduceat(self.w[name][flat], np.cumsum(size) - size) / size[:, None]
                kept.append((flat, size))
            x[:n, j, 2 * dim :] = plain
            mask[:n, j] = 1
            bags.append(kept)
        return x, mask, bags

    def _run(self, x, mask, which, keep):
        w, b, h = self.w[which], self.w[which + "b"], self.hidden
        steps, n, d = x.shape
        out, seen = np.zeros((steps, n, h)), []
        ht, ct = np.zeros((n, h)), np.zeros((n, h))
        pre = x @ w[:d] + b
        for t in range(steps) if which == "f" else range(steps - 1, -1, -1):
            z = pre[t] + ht @ w[d:]
            i, f, o = (1 / (1 + np.exp(-z[:, k * h : (k + 1) * h])) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = f * ct + i * g
            tanh = np.tanh(new)
            if keep:
                seen.append((t, ht, ct, i, f, o, g, tanh, m))
            ct = m * new + (1 - m) * ct
            ht = m * (o * tanh) + (1 - m) * ht
            out[t] = ht
        return out, seen

    def forward(self, x, mask, keep=False):
        f, seen_f = self._run(x, mask, "f", keep)
        b, seen_b = self._run(x, mask, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["ob"])[..., 0])), both, (seen_f, seen_b)

    def _back(self, x, seen, which, dout):
        w, h, d = self.w[which], self.hidden, x.shape[2]
        dw, db, dx = np.zeros_like(w), np.zeros(4 * h), np.zeros_like(x)
        dh, dc = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
        for t, h0, c0, i, f, o, g, tanh, m in reversed(seen):
            dh = dh + dout[t]
            dht, dct = m * dh, m * dc
            dnew = dct + dht * o * (1 - tanh**2)
            dz = np.concatenate(
                [dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), dht * tanh * o * (1 - o), dnew * i * (1 - g**2)], axis=1
            )
            dw[:d] += x[t].T @ dz
            dw[d:] += h0.T @ dz
            db += dz.sum(0)
            dx[t] = dz @ w[:d].T
            dh = dz @ w[d:].T + (1 - m) * dh
            dc = dnew * f + (1 - m) * dc
        return dw, db, dx

    def gradients(self, pages, labels):
        """(loss, gradients) of the mean cross-entropy over the blocks of the pages."""
        x, mask, bags = self.embed(pages)
        y = np.zeros(mask.shape)
        for j, v in enumerate(labels):
            y[: len(v), j] = v
        p, both, (seen_f, seen_b) = self.forward(x, mask, True)
        n, h, dim = mask.sum(), self.hidden, self.w["path"].shape[1]
        loss = -(mask * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / n
        dz = (mask * (p - y) / n)[..., None]
        grad = {"out": np.einsum("tnh,tno->ho", both, dz), "ob": dz.sum((0, 1))}
        dboth = dz @ self.w["out"].T
        grad["f"], grad["fb"], dxf = self._back(x, seen_f, "f", dboth[..., :h])
        grad["b"], grad["bb"], dxb = self._back(x, seen_b, "b", dboth[..., h:])
        dx = dxf + dxb
        grad["path"], grad["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        for j, kept in enumerate(bags):
            for k, (name, (flat, size)) in enumerate(zip(("path", "word"), kept, strict=True)):
                part = dx[: len(size), j, k * dim : (k + 1) * dim] / size[:, None]
                np.add.at(grad[name], flat, np.repeat(part, size, axis=0))
        return loss, grad

    def train(self, pages, labels, epochs: int = 12, batch: int = 16, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over shuffled batches; the mean loss of every epoch."""
        r, mean, square, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        for _ in range(epochs):
            order, total = r.permutation(len(pages)), []
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                loss, grad = self.gradients([pages[j] for j in some], [labels[j] for j in some])
                total.append(loss)
                step += 1
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
                    square[k] = 0.999 * square.get(k, 0) + 0.001 * g * g
                    self.w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(float(np.mean(total)))
        return losses

    def label(self, pages: list[list[Block]], batch: int = 64) -> list[np.ndarray]:
        """Content probabilities of the blocks of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            # pages of like length together; few very long ones at a time
            some = order[-max(1, min(batch, 200_000 // len(pages[order[-1]]))) :]
            del order[-len(some) :]
            x, mask, _ = self.embed([inputs(pages[i]) for i in some])
            p = self.forward(x, mask)[0]
            for j, i in enumerate(some):
                out[i] = p[: len(pages[i]), j]
        return out


# Names that page authors give to the parts of a page.
_CONTENT = "article main content post entry story body text".split()
_OTHER = (
    "nav menu navigation breadcrumb header masthead banner topbar footer sidebar aside widget related recommended teaser ad ads "
    "advert advertisement sponsor promo cookie consent notice alert popup modal newsletter subscribe signup form login search share "
    "social tags comment comments reply respond discussion disqus copyright legal pagination toolbar"
).split()


def seed_label(path: tuple[str, ...]) -> int | None:
    """What the names on the path say, the innermost first: content 1, other 0, nothing None."""
    for name in reversed(path):
        if name in _OTHER or name in _LANDMARK - {"article", "main"}:
            return 0
        if name in ("article", "main"):
            return 1
    return None


def variants(blocks: list[Block], labels: list[int], pool: list[str], r: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page of the same blocks in another template: other names for its parts, and parts that it lacks."""
    pick = lambda names: names[int(r.integers(len(names)))]
    some = lambda k: " ".join(pick(pool).split()[: int(r.integers(1, 2 + k))])
    outer = ("html", "body") + (("div", pick(["wrapper", "container", "page", "site", "layout"])) if r.random() < 0.5 else ())
    good = pick([("article",), ("main",), ("main", "article"), ("article", "div", pick(_CONTENT)), ("div", pick(_CONTENT)), ("section", pick(_CONTENT))])
    out, y = [], []

    def other(name: str, n: int, kinds=(("div",), ("p",), ("li",), ("ul", "li"), ("span",)), words: int = 12, link: float = 0.5):
        holder = (pick(["div", "section", "aside", "ul"]), name) if name not in _LANDMARK else (name,)
        kind, is_link = pick(list(kinds)), r.random() < link
        for _ in range(n):
            text = some(words) or "x"
            out.append(Block(outer + holder + kind, text, len(text) if is_link else 0))
            y.append(0)

    for name in ("header", "nav", pick(["menu", "breadcrumb", "banner", "topbar", "cookie", "notice", "ad", "search"])):
        if r.random() < 0.6:
            other(name, int(r.integers(1, 7)))
    inside = [i for i, v in enumerate(labels) if v]
    for i, (b, v) in enumerate(zip(blocks, labels, strict=True)):
        if v:
            if r.random() < 0.05:
                name = pick(["ad", "advert", "related", "promo", "newsletter", "share", "notice", "form"])
                out.append(Block(outer + good + ("div", name) + (("p",) if r.random() < 0.5 else ()), some(30) or "x"))
                y.append(0)
            leaf = b.path[-1:] if r.random() < 0.8 else (pick(["p", "div", "blockquote", "li", "h2", "pre", "td"]),)
            out.append(Block(outer + good + leaf, b.text, b.linked))
        elif inside and r.random() < 0.3:
            continue
        else:
            out.append(Block(b.path, b.text, b.linked))
        y.append(v)
    for name in (pick(["comments", "comment", "discussion", "respond"]), pick(["sidebar", "aside", "related", "widget", "promo"]), "form", "footer"):
        if r.random() < 0.5:
            long = name in ("comments", "comment", "discussion", "respond")
            if long and r.random() < 0.5:  # comments may stand inside the article
                outer, keep = outer + good, outer
                other(name, int(r.integers(1, 8)), words=60, link=0.1)
                outer = keep
            else:
                other(name, int(r.integers(1, 8)), words=60 if long else 15, link=0.1 if long else 0.5)
    return out, y


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 200, copies: int = 4, epochs: int = 10, seed: int = 7) -> Labeller:
    """Train on at most ``sample`` pages (those with the smallest hashes of their ids) whose tags name their parts.

    The names give every block its label; ``copies`` versions of each page in other
    templates teach what such parts look like elsewhere. Without usable pages the
    network learns from made-up parts around no text, and labels by their names.
    """
    given = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{html_col}`").alias("html"))
    given = given.where("html IS NOT NULL AND page_id IS NOT NULL").withColumn("place", F.xxhash64("page_id"))
    # The last place is sought on narrow rows, so that tasks send html of sampled pages only.
    first = given.select("place", "page_id").orderBy("place", "page_id").limit(sample)
    last = first.agg(F.max(F.struct("place", "page_id")).alias("last")).first().last
    rows = []
    if last is not None:
        upto = (F.col("place") < last.place) | ((F.col("place") == last.place) & (F.col("page_id") <= F.lit(last.page_id)))
        rows = given.where(upto).orderBy("place", "page_id", F.xxhash64("html")).limit(sample).collect()
    r, examples, pool = np.random.default_rng(seed), [], []
    for row in rows:
        blocks = blocks_of(row.html)
        labels = [seed_label(b.path) for b in blocks]
        known = [(b, v) for b, v in zip(blocks, labels, strict=True) if v is not None]
        if known:
            examples.append(([b for b, _ in known], [v for _, v in known]))
            pool += [b.text for b, _ in known]
    pool = pool or ["text"]
    examples = examples or [([Block(("html", "body", "article", "p"), "text.")], [1])] * 8
    every = [*examples, *(variants(b, v, pool, r) for b, v in examples for _ in range(copies))]
    every = [(b, v) for b, v in every if b]
    out = Labeller(seed=seed)
    out.train([inputs(b) for b, _ in every], [v for _, v in every], epochs, seed=seed)
    return out


def extract(pages: DataFrame, labeller: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars: the content blocks of every page, joined by line feeds in page order.

    Character references are decoded and white space within a block becomes one
    blank. Null and empty pages, and pages without content, have an empty text. Repeated rows
    are each extracted. Nothing is cut from long pages. No page: no row.
    """
    fields = {x.name: x.dataType for x in pages.schema}
    schema = T.StructType(
        [T.StructField("page_id", fields[id_col]), T.StructField("url", fields[url_col]), T.StructField("text", T.StringType()),
         T.StructField("n_chars", T.LongType())]
    )
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def rows(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                ids, urls, html = (x.slice(i, 512).to_pylist() for x in b.columns)
                cut = [blocks_of(h) for h in html]
                for page, url, blocks, p in zip(ids, urls, cut, shared.value.label(cut), strict=True):
                    text = "\n".join(x.text for x, q in zip(blocks, p, strict=True) if q >= at_least)
                    yield page, url, text, len(text)

    return pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), F.col(f"`{html_col}`").cast("string")).mapInArrow(
        lambda it: in_batches(schema, rows(it), 1024), schema
    )
