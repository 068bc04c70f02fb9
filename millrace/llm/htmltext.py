"""Main text of web pages: a recurrent network labels every block, reading the whole page.

A page becomes a sequence of leaves, the text blocks between block-level tags. A leaf is two hashed
vectors, of its tag path (open elements with their classes and ids) and of all its words, and a few plain
measures. A bidirectional LSTM, in numpy, reads the sequence both ways, so that each block is
classified with the document around it. The main blocks, in page order, are the text.

Before the network, only what a browser does not show as text of the page goes: titles, comments, scripts, styles,
templates, frames, the fields of forms (``select``, ``textarea``) and annotations of formulas. Parsing takes time in proportion
to the page, however deep, unclosed or broken its tags are.

The network is trained here, on pages made up by ``made_page`` from random words in many layouts, so
their labels are known by construction. Its weights lie beside this module; ``python -m
millrace.llm.htmltext`` makes them anew.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import prepare, slices, word_hashes

PATH_BITS = 128
WORD_BITS = 64
PLAIN = 8
HIDDEN = 16
WIDTH = PATH_BITS + WORD_BITS + PLAIN
WEIGHTS = Path(__file__).with_name("htmltext.npz")
#: Leaves in a piece: longer pages are read in pieces, the states going on from one to the next.
PIECE = 512
#: Leaves, padding included, that go through the network together.
TOGETHER = 16_384
#: Characters of html that are parsed before their leaves are labelled.
PAGES = 4 << 20
#: Tags with a quote that never ends after which quotes no longer hide a tag's end.
BROKEN = 16

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)")
_SIMPLE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-label|itemprop|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content is not markup: it ends at their own end tag only.
RAW = frozenset("script style textarea iframe".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)|\Z", re.I) for t in RAW}
#: Elements whose content is not shown as text of the page.
UNSEEN = frozenset("title select template annotation annotation-xml".split())
#: What may stand in a head; any other tag ends it.
IN_HEAD = frozenset("title meta link base style script noscript template html head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext object q rp rt ruby s samp semantics small span strike strong sub sup svg time tt u var wbr".split()
)
#: Tags that do not end the block around them.
WITHIN = INLINE | UNSEEN
#: Elements that end when one of these opens: tags that HTML lets authors leave out.
CLOSED_BY = {
    "p": "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(),
    "li": ["li"],
    "dt": ["dt", "dd"],
    "dd": ["dt", "dd"],
    "tr": ["tr", "tbody", "tfoot"],
    "td": ["td", "th", "tr", "tbody", "tfoot"],
    "th": ["td", "th", "tr", "tbody", "tfoot"],
    "option": ["option", "optgroup"],
}
_CLOSES: dict[str, list[str]] = {}
for _t, _by in CLOSED_BY.items():
    for _o in _by:
        _CLOSES.setdefault(_o, []).append(_t)
SCOPE = frozenset(["table", "ul", "ol", "dl", "div", "article", "section", "body", "main", "aside", "td", "blockquote"])


class Element:
    """An open element. ``bits``: the hashed names of it and all around it; ``block``: its nearest block-level tag."""

    __slots__ = ("tag", "bits", "depth", "block")

    def __init__(self, tag: str, bits: int, depth: int, block: str) -> None:
        self.tag, self.bits, self.depth, self.block = tag, bits, depth, block


_OUTSIDE = Element("", 0, 0, "")


class Leaf:
    __slots__ = ("at", "text", "linked")

    def __init__(self, at: Element, text: str, linked: float) -> None:
        self.at, self.text, self.linked = at, text, linked

    @property
    def tag(self) -> str:
        return self.at.block


_bits: dict[tuple[str, str], int] = {}


def _own_bits(tag: str, attributes: str) -> int:
    """The tag and the words of its class, id, role and the like, as hashed bits."""
    known = _bits.get((tag, attributes))
    if known is not None:
        return known
    names = {tag}
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
            names.add("#hidden")
        elif kind != "style":
            names.update(f".{w.lower()}" for w in _NAME_PART.findall(value))
    out = 0
    for n in names:
        out |= 1 << crc32(n.encode()) % PATH_BITS
    if len(_bits) > 50_000:
        _bits.clear()
    if len(attributes) < 500:
        _bits[tag, attributes] = out
    return out


class _Open:
    """The open elements, with what is asked about them kept up to date."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.unseen = self.linked = 0

    def push(self, tag: str, attributes: str) -> None:
        above = self.stack[-1] if self.stack else _OUTSIDE
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.unseen += tag in UNSEEN
        self.linked += tag == "a" or tag == "button"
        self.stack.append(Element(tag, above.bits | _own_bits(tag, attributes), above.depth + 1, above.block if tag in INLINE else tag))

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.unseen -= tag in UNSEEN
            self.linked -= tag == "a" or tag == "button"

    def opens(self, tag: str) -> None:
        """End what ``tag`` ends by opening: elements up to the nearest one that bounds such an effect."""
        if tag not in IN_HEAD and self.places.get("head"):
            self.cut(self.places["head"][0])
        names = _CLOSES.get(tag)
        if not names:
            return
        bound = -1
        for i in reversed(self.scopes):
            if self.stack[i].tag not in CLOSED_BY:
                bound = i
                break
        least = len(self.stack)
        for t in names:
            own = self.places.get(t)
            if own and own[-1] > bound:
                least = min(least, own[bisect_right(own, bound)])
        self.cut(least)

    def closes(self, tag: str) -> None:
        own = self.places.get(tag)
        if own and not (tag in INLINE and self.scopes and self.scopes[-1] > own[-1]):
            self.cut(own[-1])


def leaves(page: str) -> list[Leaf]:
    """The text blocks of a page in order, with their open elements."""
    out: list[Leaf] = []
    open_ = _Open()
    parts: list[str] = []
    linked, where, broken, size = 0, None, 0, len(page)

    def end() -> None:
        nonlocal linked, where
        if where is not None:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Leaf(where, text, min(1.0, linked / len(text))))
        parts.clear()
        linked, where = 0, None

    def add(text: str) -> None:
        nonlocal linked, where
        if open_.unseen:
            return
        if "&" in text:
            text = entities.unescape(text)
        if where is None:
            if text.isspace():
                return
            where = open_.stack[-1] if open_.stack else _OUTSIDE
        parts.append(text)
        if open_.linked:
            linked += len(text.strip())

    at = begin = 0
    while at < size:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1 : at + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                stop = size if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", at):
                stop = page.find("]]>", at)
                stop = size if stop < 0 else stop + 3
            else:
                stop = page.find(">", at)
                stop = size if stop < 0 else stop + 1
            if at > begin:
                add(page[begin:at])
            at = begin = stop
            continue
        m = _TAG.match(page, at) if broken < BROKEN else None
        if m is None and (after.isascii() and after.isalpha() or after == "/"):
            m = _SIMPLE_TAG.match(page, at)
            broken += m is not None
        if m is None:
            at += 1
            continue
        if at > begin:
            add(page[begin:at])
        tag, attributes = m[1].lower(), m[2]
        begin = m.end()
        if tag == "br":
            parts.append(" ")
        elif after == "/":
            if tag not in WITHIN:
                end()
            open_.closes(tag)
        elif tag in RAW:
            if tag not in ("script", "style"):
                parts.append(" ")
            begin = _RAW_END[tag].search(page, begin).end()
        else:
            if tag not in WITHIN:
                end()
                open_.opens(tag)
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                open_.push(tag, attributes)
        at = begin
    if begin < size:
        add(page[begin:])
    end()
    return out


_PLAIN_TAGS = {"h1": 1, "h2": 1, "h3": 1, "li": 2, "p": 3, "td": 4}
_NO_MARKS = np.arange(256, dtype=np.uint8)
_NO_MARKS[np.frombuffer(b".,:;!?()\"'", np.uint8)] = 0x20


def _word_shares(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its words' counts by hashed cell, scaled to unit length, and the number of its words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = _NO_MARKS[np.frombuffer(b"".join(raw), np.uint8)]
    out, number = np.zeros((len(texts), WORD_BITS), np.float32), np.zeros(len(texts), np.int64)
    for a, b in slices(offsets):
        lo, hi = offsets[a], offsets[b]
        words, first = word_hashes(data[lo:hi], offsets[a : b + 1] - lo)
        number[a:b] = np.diff(first)
        cell = np.repeat(np.arange(b - a), number[a:b]) * WORD_BITS + (words % np.uint64(WORD_BITS)).astype(np.int64)
        out[a:b] = np.bincount(cell, minlength=(b - a) * WORD_BITS).reshape(b - a, WORD_BITS)
    return out / np.sqrt(np.maximum((out**2).sum(axis=1, keepdims=True), 1)), number


def vectors(found: list[Leaf]) -> np.ndarray:
    """One row for each leaf: hashed tag path, hashed words, and plain measures."""
    out = np.zeros((len(found), WIDTH), np.float32)
    if not found:
        return out
    bits = b"".join(leaf.at.bits.to_bytes(PATH_BITS // 8, "little") for leaf in found)
    out[:, :PATH_BITS] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").reshape(len(found), PATH_BITS)
    out[:, PATH_BITS : PATH_BITS + WORD_BITS], n = _word_shares([leaf.text for leaf in found])
    plain = out[:, PATH_BITS + WORD_BITS :]
    plain[:, 0] = [leaf.linked for leaf in found]
    plain[:, 1] = np.log1p(n) / 3
    plain[:, 2] = np.log1p([leaf.at.depth for leaf in found])
    for row, leaf in zip(plain, found, strict=True):
        kind = _PLAIN_TAGS.get(leaf.at.block)
        if kind:
            row[3 + kind] = 1.0
    return out


class Network:
    """A bidirectional LSTM with one hidden layer, and a logistic unit on both directions."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            w[f"h{d}"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        w["out"] = rng.normal(0, 0.1, (2 * HIDDEN + WIDTH, 1)).astype(np.float32)
        w["bias"] = np.zeros(1, np.float32)
        return Network(w)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, state=None, keep: list | None = None):
        """States of one direction over ``x`` (steps, pages, features); padding leaves states unchanged."""
        sig = lambda v: 1 / (1 + np.exp(-v))
        steps, pages, _ = x.shape
        given = (x.reshape(steps * pages, -1) @ self.w[f"x{d}"] + self.w[f"b{d}"]).reshape(steps, pages, -1)
        h, c = state if state is not None else (np.zeros((pages, HIDDEN), given.dtype),) * 2
        out = np.zeros((steps, pages, HIDDEN), given.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.w[f"h{d}"]
            i, f, o = (sig(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c2, c)
            out[t] = h
        return out, (h, c)

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of being main text for every leaf (steps, pages)."""
        steps = len(x)
        cuts = range(0, steps, PIECE)
        state, forward = None, []
        for a in cuts:
            out, state = self.run(x[a : a + PIECE], mask[a : a + PIECE], "f", state)
            forward.append(out)
        state, back = None, []
        for a in reversed(cuts):
            out, state = self.run(x[a : a + PIECE], mask[a : a + PIECE], "b", state)
            back.insert(0, out)
        both = np.concatenate([np.concatenate(forward), np.concatenate(back), x], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["bias"])[..., 0]))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        outs = [self.run(x, mask, d, None, kept[d])[0] for d in "fb"]
        both = np.concatenate([*outs, x], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.w["out"] + self.w["bias"])[..., 0]))
        err = ((p - y) * mask / max(1, mask.sum()))[..., None].astype(p.dtype)
        flat = both.reshape(-1, both.shape[2])
        grads = {"out": flat.T @ err.reshape(-1, 1), "bias": err.sum(keepdims=True).reshape(1)}
        dboth = err @ self.w["out"].T
        for n, d in enumerate("fb"):
            dh_out = dboth[..., n * HIDDEN : (n + 1) * HIDDEN]
            wx, wh = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"h{d}"])
            b = np.zeros_like(self.w[f"b{d}"])
            dh = np.zeros((x.shape[1], HIDDEN), p.dtype)
            dc = np.zeros_like(dh)
            for t, h0, c0, i, f, o, g, tc, m in reversed(kept[d]):
                dh = dh + dh_out[t]
                live = np.where(m, dh, 0)
                dcell = np.where(m, dc, 0) + live * o * (1 - tc**2)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * c0 * f * (1 - f), live * tc * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
                wx += x[t].T @ dz
                wh += h0.T @ dz
                b += dz.sum(axis=0)
                dh = np.where(m, 0, dh) + dz @ self.w[f"h{d}"].T
                dc = np.where(m, 0, dc) + dcell * f
            grads |= {f"x{d}": wx, f"h{d}": wh, f"b{d}": b}
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = True
    return x, mask


class Extractor:
    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.net = Network(weights)

    def texts(self, pages: list[str]) -> list[str]:
        """The main text of each page: its main blocks with an empty line between them."""
        out = [""] * len(pages)
        sizes = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
        for a, b in slices(sizes, PAGES):
            out[a:b] = self._texts(pages[a:b])
        return out

    def _texts(self, pages: list[str]) -> list[str]:
        found = [leaves(p) for p in pages]
        out = [""] * len(pages)
        order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
        while order:
            group = [order.pop()]
            while order and len(found[group[0]]) * (len(group) + 1) <= TOGETHER:
                group.append(order.pop())
            x, mask = padded([vectors(found[i]) for i in group])
            p = self.net.score(x, mask)
            for k, i in enumerate(group):
                out[i] = "\n\n".join(leaf.text for leaf, v in zip(found[i], p[:, k], strict=False) if v > 0.5)
        return out


def _weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as z:
        return {k: z[k] for k in z.files}


def _extract(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        extractor = Extractor(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = extractor.texts([x.as_py() or "" for x in part.column("html")])
                yield pa.record_batch(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def main_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    Null and empty pages, and pages without a main block, have an empty text. The broadcast weights have
    a fixed size of some 60 kB.
    """
    prepare(spark)
    shared = spark.sparkContext.broadcast(_weights())
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")


# --- training --------------------------------------------------------------------------------

_CHROME = {
    "nav": ("nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu toc pager pagination", "home about contact login search next previous page menu products news blog"),
    "header": ("header masthead site-header banner logo topbar hero-bar", "welcome sign in subscribe search site"),
    "footer": ("footer site-footer copyright legal colophon bottom", "copyright all rights reserved terms privacy policy © contact imprint"),
    "aside": ("sidebar side widget related recommended popular trending aside links tags author-box", "related popular most read more tags archive also recommended"),
    "ad": ("ad ads advert advertisement banner sponsor sponsored promo promotion adsbygoogle", "advertisement sponsored buy now offer sale"),
    "notice": ("cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe paywall", "cookies accept consent we use privacy agree newsletter sign up"),
    "form": ("form search-form contact-form login signup subscribe-form", "name email message send submit password your"),
    "comments": ("comments comment comment-list discussion replies reader-comments disqus respond", "reply says posted comment ago great thanks"),
    "share": ("share social social-links sharing buttons", "facebook twitter share email print whatsapp"),
}
_MAIN = "content article post entry main story body text post-content entry-content article-body main-content page-content story-body node".split()


def made_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A made-up page and the texts of its main blocks."""
    letters = np.array(list("etaoinshrdlucmfwypvbgk"))

    def words(a: int, b: int, extra: str = "") -> str:
        own = extra.split()
        out = []
        for _ in range(int(rng.integers(a, b))):
            w = str(rng.choice(own)) if own and rng.random() < 0.5 else "".join(rng.choice(letters, int(rng.integers(1, 9))))
            out.append(w.capitalize() if rng.random() < 0.15 else w + ("." if rng.random() < 0.1 else ""))
        return " ".join(out)

    def attr(names: str, chance: float = 0.8) -> str:
        if rng.random() > chance:
            return ""
        name = str(rng.choice(names.split()))
        return f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", " x1", " clearfix", "-2"])}"'

    def chrome(kind: str) -> str:
        names, said = _CHROME[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        if rng.random() < 0.45 and kind not in ("form",):
            tag = "div"
        a = attr(names, 1.0 if tag in ("div", "section") else 0.5)
        style = rng.integers(0, 4)
        if kind in ("nav", "share") or kind in ("aside", "footer", "header") and style == 0:
            item = [f'<li><a href="/{i}">{words(1, 4, said if rng.random() < 0.5 else "")}</a></li>' for i in range(int(rng.integers(2, 9)))]
            inner = "<ul>" + "".join(item) + "</ul>"
            if rng.random() < 0.3:
                inner = " ".join(f'<a href="/{i}">{words(1, 3)}</a>' for i in range(int(rng.integers(2, 6))))
        elif kind == "form":
            inner = "".join(f'<label>{words(1, 3, said)}</label><input type="text">' for _ in range(int(rng.integers(1, 4)))) + f"<button>{words(1, 3, said)}</button>" + (f"<p>{words(3, 20, said)}</p>" if rng.random() < 0.5 else "")
        elif kind == "comments":
            inner = f"<h3>{words(1, 4, said)}</h3>" + "".join(
                f'<{t}{attr("comment reply comment-body", 0.5)}><p>{words(2, 50)}</p></{t}>' for t in [str(rng.choice(["div", "li", "article"]))] * int(rng.integers(1, 5))
            )
        else:
            kinds = ["p", "div", "span", "h3", ""]
            inner = ""
            for _ in range(int(rng.integers(1, 4))):
                t = str(rng.choice(kinds))
                most = 40 if kind in ("aside", "notice", "footer", "ad") else 10
                if kind in ("notice", "ad") and rng.random() < 0.2:  # a long one, whose telling words may stand anywhere
                    said_now = f"{words(10, 60)} {words(8, 30, said)} {words(10, 60)}"
                else:
                    said_now = words(2, most, said if rng.random() < 0.4 else "")
                inner += f"<{t}>{said_now}</{t}>" if t else said_now
        return f"<{tag}{a}>{inner}</{tag}>"

    main: list[str] = []

    def block(text: str) -> str:
        main.append(" ".join(text.split()))
        return text

    def article() -> str:
        out = []
        if rng.random() < 0.85:
            out.append(f"<h1>{block(words(1, 14))}</h1>")
        for _ in range(int(rng.integers(1, 14)) if rng.random() < 0.97 else int(rng.integers(40, 90))):
            kind = rng.random()
            n = (1, 8) if rng.random() < 0.25 else (4, 90)
            if kind < 0.62:
                t = block(words(*n))
                shape = rng.random()
                if shape < 0.1:
                    out.append(f"<p><b>{t}<br>")
                elif shape < 0.2:
                    k = t.find(" ") if " " in t else len(t)
                    out.append(f'<p><a href="/x">{t[:k]}</a>{t[k:]}</p>')
                elif shape < 0.3:
                    out.append(f"<p>{t}")
                elif shape < 0.4:
                    out.append(f"<p><em>{t}</em></p>")
                else:
                    out.append(f"<p>{t}</p>")
            elif kind < 0.72:
                out.append(f"<h{k}>{block(words(1, 9))}</h{k}>" if (k := int(rng.integers(2, 5))) else "")
            elif kind < 0.8:
                t = str(rng.choice(["ul", "ol"]))
                out.append(f"<{t}>" + "".join(f"<li>{block(words(2, 18))}</li>" for _ in range(int(rng.integers(2, 6)))) + f"</{t}>")
            elif kind < 0.86:
                out.append(f"<blockquote><p>{block(words(4, 40))}</p></blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{block(words(1, 5))}</td><td>{block(words(1, 5))}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.93:
                out.append(f"<pre>{block(words(3, 25))}</pre>")
            elif kind < 0.95:
                out.append(f"<div>{block(words(4, 60))}</div>")
            elif kind < 0.97:
                out.append(chrome(str(rng.choice(["ad", "share", "notice", "form"]))))
            else:
                out.append(f"<script>var x = '<p>{words(2, 5)}</p>';</script><style>p {{margin: 0}}</style>")
        return "".join(out)

    before = [k for k in ("notice", "header", "nav", "ad", "share") if rng.random() < 0.55]
    after = [k for k in ("share", "comments", "form", "aside", "ad", "nav", "footer", "notice") if rng.random() < 0.5]
    head = "".join(chrome(k) for k in before)
    style = rng.integers(0, 8)
    body = article()
    wrap = {0: ("<article>", "</article>"), 1: ("<main>", "</main>"), 2: ("<main><article>", "</article></main>")}
    a, z = wrap.get(int(style), (f'<div{attr(" ".join(_MAIN), 1.0)}>', "</div>"))
    if style == 5:
        a, z = f'<section{attr(" ".join(_MAIN), 0.7)}>', "</section>"
    if style == 6:  # nothing tells the article's element from others
        a, z = f'<div{attr("a1 b2 box block section inner c7 row", 0.6)}>', "</div>"
    if style == 7:
        a, z = "", ""
    if rng.random() < 0.3:
        a, z = f'<div{attr("wrapper container page layout row col site", 0.9)}>' + a, z + "</div>"
    if rng.random() < 0.2:
        a, z = f"<div class=\"layout\">{chrome('aside')}" + a, z + "</div>"
    tail = "".join(chrome(k) for k in after)
    close = "</body></html>" if rng.random() < 0.9 else ""
    return f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title></head><body>{head}{a}{body}{z}{tail}{close}", main


def labelled(page: str, main: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a made-up page; main blocks are found by their texts, in order."""
    found = leaves(page)
    y, k = np.zeros(len(found), np.float32), 0
    for i, leaf in enumerate(found):
        if k < len(main) and leaf.text == main[k]:
            y[i], k = 1, k + 1
    if k < len(main):
        raise ValueError("a main block is not among the leaves")
    return vectors(found), y


def train(pages: int = 20_000, rounds: int = 6, batch: int = 32, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data = [labelled(*made_page(rng)) for _ in range(pages)]
    net = Network.fresh()
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    step = 0
    total = rounds * (len(data) // batch)
    for _ in range(rounds):
        order = sorted(range(len(data)), key=lambda i: len(data[i][1]) + rng.random() * 8)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            x, mask = padded([data[i][0] for i in groups[g]])
            if rng.random() < 0.5:  # words and classes that are not known must not decide
                x[..., : PATH_BITS + WORD_BITS] *= rng.random((1, x.shape[1], PATH_BITS + WORD_BITS)) > 0.08
            y = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(groups[g]):
                y[: len(data[i][1]), k] = data[i][1]
            step += 1
            rate = 0.008 * max(0.05, 1 - step / total)
            for key, grad in net.gradients(x, mask, y).items():
                m[key] = 0.9 * m[key] + 0.1 * grad
                v[key] = 0.999 * v[key] + 0.001 * grad**2
                net.w[key] -= (rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net.w


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16).astype(np.float32) for k, v in train().items()})
