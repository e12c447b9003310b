"""Main text of web pages by a recurrent block labeller.

A page is lexed into text blocks in page order; each block carries its path of
open elements. A block becomes a vector: signed hashes of the path's tags and
of the words of their class, id and role; signed hashes of the block's words;
and a few sizes. A bidirectional LSTM in numpy reads the whole sequence of a
page's blocks and labels each as main text or not, so a block is judged in its
document's context. The weights are learned here, from seeded synthetic pages
whose blocks are labelled by construction.

Character references are decoded, white space inside a block becomes one space,
and the kept blocks are joined by a line feed; nothing else is dropped or
capped. Scripts, styles, comments and markup never make blocks. Null html
counts as empty and gives the empty text. Text outside any element is a block
too. A script or style without an end tag drops its start tag only. Unclosed and
misplaced tags are tolerated; after a quotation mark without a partner such
marks no longer hide the end of a tag. Time and memory are linear in a page,
hostile ones included. Repeated rows are extracted alike, and ids and urls may
be null or repeated. An empty table gives no rows. Columns beyond ``page_id``,
``url`` and ``html`` are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html
import pickle
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame

from . import bytehash
from .common import arrow_map

PATH, WORDS, SIZES, HIDDEN = 64, 32, 6, 16
INPUT = PATH + WORDS + SIZES

# Elements by their role in HTML.
BREAKING = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
EMBEDDED = frozenset("noscript template iframe svg object".split())  # may stand inside a paragraph; their blocks are judged by their path
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select body html article section div".split())

_QUOTED = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_PLAIN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _direction(token: str, size: int) -> np.ndarray:
    """A token's fixed signed vector: three places chosen by its hash."""
    out = np.zeros(size, np.float32)
    for k in range(3):
        h = zlib.crc32(f"{k}:{token}".encode("utf-8", "surrogatepass"))
        out[h % size] += 1.0 if h >> 20 & 1 else -1.0
    return out


@functools.lru_cache(maxsize=50_000)
def element_vector(tag: str, attributes: str) -> np.ndarray:
    tokens = ["<" + tag]
    for m in _NAMES.finditer(attributes):
        tokens += [w.lower() for w in _NAME_PART.findall(m[1] or m[2] or m[3] or "")]
    return np.sum([_direction(t, PATH) for t in tokens], axis=0)


def blocks(page: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, path vectors and shares of characters inside links of a page's blocks."""
    page = page or ""
    texts: list[str] = []
    paths: list[np.ndarray] = []
    linked: list[float] = []
    names: list[str] = []
    places: dict[str, list[int]] = defaultdict(list)  # of each name among the open ones
    vectors = [np.zeros(PATH, np.float32)]
    parts: list[str] = []
    in_link = [0, 0]  # characters inside links; open links

    def flush() -> None:
        if parts:
            raw = "".join(parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                texts.append(text)
                paths.append(vectors[-1] / (1 + len(names)) ** 0.5)
                linked.append(in_link[0] / max(1, len(raw)))
            parts.clear()
        in_link[0] = 0

    def add(text: str) -> None:
        if text:
            parts.append(text)
            in_link[0] += len(text) if in_link[1] else 0

    def last_of(wanted) -> int:
        return max((places[n][-1] for n in wanted if places.get(n)), default=-1)

    def close(to: int) -> None:
        for n in names[to:]:
            places[n].pop()
        del names[to:], vectors[to + 1 :]

    def open_(tag: str, attributes: str) -> None:
        places[tag].append(len(names))
        names.append(tag)
        vectors.append(vectors[-1] + element_vector(tag, attributes))

    at, tags, endless = 0, _QUOTED, set()
    last = page.rfind(">") + 1  # no tag ends behind it
    while True:
        m = tags.search(page, at, last)
        if not m:
            rest = page.find("<!--", max(at, last))
            add(page[at:rest] if rest >= 0 else page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--"):
            if not m[0].endswith("-->"):  # an open comment holds the rest
                break
            continue
        if tags is _QUOTED and m[5]:
            # A quotation mark without a partner: from here on such marks mean nothing, so no tag is searched to the end again.
            tags, found = _PLAIN, m.group(4, 5, 6)
        else:
            found = m.group(1, 2, 3)
        if not found[1]:
            continue
        ending, tag, attributes = found[0], found[1].lower(), found[2]
        if tag in RAW:
            if not ending and not attributes.endswith("/") and tag not in endless:
                end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
                at = end.end() if end else at
                if not end:
                    endless.add(tag)
            continue
        if tag in EMBEDDED:
            flush()
            if ending:
                if places.get(tag):
                    close(places[tag][-1])
            elif not attributes.endswith("/"):
                open_(tag, attributes)
            continue
        if tag in BREAKING:
            flush()
        elif tag == "br":
            add(" ")
            continue
        elif tag == "a":
            in_link[1] = max(0, in_link[1] + (-1 if ending else 1))
        if tag not in BREAKING or tag in VOID:
            continue
        if ending:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if places.get("p"):  # a block closes an open paragraph
            close(places["p"][-1])
        if (k := last_of(CLOSES.get(tag, ()))) > last_of(SCOPES):
            close(k)
        open_(tag, attributes)
    flush()
    n = len(texts)
    return texts, np.array(paths, np.float32).reshape(n, PATH), np.array(linked, np.float32)


def word_vectors(texts: list[str]) -> np.ndarray:
    """Signed hashes of lower-case words, scaled to length 1."""
    out = np.zeros((len(texts), WORDS), np.float32)
    first = 0
    while first < len(texts):
        raws, size = [], 0
        while first + len(raws) < len(texts) and (not raws or size < bytehash.CHUNK):
            raws.append(texts[first + len(raws)].lower().encode("utf-8", "surrogatepass"))
            size += len(raws[-1]) + 1
        data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        starts, _, h = bytehash.tokens(data)
        owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, "right")
        place = owner * WORDS + (h >> np.uint64(59)).astype(np.int64)
        sign = np.where((h & np.uint64(1)) > 0, 1.0, -1.0)
        got = np.bincount(place, sign, minlength=len(raws) * WORDS).reshape(len(raws), WORDS)
        out[first : first + len(raws)] = got / np.maximum(np.linalg.norm(got, axis=1), 1)[:, None]
        first += len(raws)
    return out


def features(page: str | None) -> tuple[list[str], np.ndarray]:
    texts, paths, linked = blocks(page)
    if not texts:
        return texts, np.zeros((0, INPUT), np.float32)
    length = np.array([len(t) for t in texts], np.float32)
    marks = np.array([sum(t.count(c) for c in ".!?") for t in texts], np.float32)
    sizes = np.stack([np.log1p(length) / 4, linked, np.minimum(marks, 5) / 5, length < 25, np.array([t[-1:] in ".!?:\"" for t in texts]), np.linspace(0, 1, len(texts))], axis=1)
    return texts, np.concatenate([paths, word_vectors(texts), sizes.astype(np.float32)], axis=1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """Two directions over padded sequences, then a logistic output for every step."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["x" + d] = r.standard_normal((INPUT, 4 * HIDDEN)) / INPUT**0.5
            self.p["h" + d] = r.standard_normal((HIDDEN, 4 * HIDDEN)) / HIDDEN**0.5
            self.p["o" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]  # the forget gates start open
        self.p["w"], self.p["c"] = r.standard_normal((2 * HIDDEN, 1)) / HIDDEN**0.5, np.zeros(1)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: (steps, pages, INPUT); masked steps leave the state as it is."""
        steps, n, _ = x.shape
        z = x @ self.p["x" + d] + self.p["o" + d]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, trace = np.zeros((steps, n, HIDDEN), np.float32), []
        wh = self.p["h" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ wh
            gates = sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if keep:
                trace.append((t, i, f, o, g, c, h, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out, trace

    def forward(self, x, mask, keep=False):
        (f, tf), (b, tb) = self._run("f", x, mask, keep), self._run("b", x, mask, keep)
        both = np.concatenate([f, b], axis=2)
        return sigmoid(both @ self.p["w"] + self.p["c"])[:, :, 0], both, (tf, tb)

    def gradients(self, x, mask, y):
        prob, both, traces = self.forward(x, mask, True)
        d = ((prob - y) * mask / mask.sum()).astype(np.float32)[:, :, None]
        grads = {"w": np.einsum("tnh,tnk->hk", both, d), "c": d.sum((0, 1))}
        up = d @ self.p["w"].T
        for name, trace, part in (("f", traces[0], up[:, :, :HIDDEN]), ("b", traces[1], up[:, :, HIDDEN:])):
            wh = self.p["h" + name]
            dh = dc = np.zeros(part.shape[1:], np.float32)
            dz = np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            for t, i, f, o, g, c, h, tc, m in reversed(trace):
                dh = dh + part[t]
                mh = m * dh
                dcell = dc + mh * o * (1 - tc**2)
                mc = m * dcell
                da = np.concatenate([mc * g * i * (1 - i), mc * c * f * (1 - f), mh * tc * o * (1 - o), mc * i * (1 - g**2)], axis=1)
                dz[t] = da
                gh += h.T @ da
                dh = (1 - m) * dh + da @ wh.T
                dc = mc * f + (1 - m) * dcell
            grads |= {"h" + name: gh, "x" + name: np.einsum("tni,tnk->ik", x, dz, optimize=True), "o" + name: dz.sum((0, 1))}
        return grads, prob

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, batch: int = 32, rate: float = 0.012, seed: int = 2) -> None:
        """Adam over batches of pages of like length."""
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        pages = sorted(pages, key=lambda q: len(q[0]))
        cuts = [pages[i : i + batch] for i in range(0, len(pages), batch)]
        for epoch in range(epochs):
            for k in r.permutation(len(cuts)):
                x, mask = padded([q[0] for q in cuts[k]])
                y, _ = padded([q[1][:, None] for q in cuts[k]])
                grads, _ = self.gradients(x, mask, y[:, :, 0])
                step += 1
                pace = rate * (1 - epoch / epochs) + rate / 10
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.p[name] -= (pace * m[name] / (1 - 0.9**step) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[np.ndarray], cells: int = 1 << 21) -> list[np.ndarray]:
        """Probabilities for the blocks of each page; pages of like length go together, at most ``cells`` numbers a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * INPUT * (end + 1 - at) <= cells and end - at < 512:
                end += 1
            x, mask = padded([pages[k] for k in order[at:end]])
            prob = self.forward(x, mask)[0]
            for n, k in enumerate(order[at:end]):
                out[k] = prob[: len(pages[k]), n]
            at = end
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), rows[0].shape[1]), np.float32), np.zeros((steps, len(rows)), np.float32)
    for n, r in enumerate(rows):
        x[: len(r), n], mask[: len(r), n] = r, 1
    return x, mask


# Training pages -----------------------------------------------------------------------------------------------------

_SYLLABLES = "an the re on ti er en de la le ou que ver sch ung ción ado os mi ta ló é ñ ä ü ra ne so lo in st mo pa vi ku zen ba hal".split()
_CHROME = {
    "nav": (["nav", "div|menu", "div|navbar", "ul|nav-links", "div|breadcrumb", "div|main-navigation", "div|site-menu", "div|pagination", "ul|menu"], "list"),
    "header": (["header", "div|header", "div|site-header", "div|masthead", "div|banner", "div|top-bar", "header|page-header", "div|branding logo"], "title"),
    "ad": (["div|ad", "div|ads", "div|advert", "div|advertisement", "div|sponsored", "aside|promo", "div|ad-slot", "div|banner-ad", "section|sponsor", "ins|adsbygoogle ad"], "prose"),
    "notice": (["div|notice", "div|cookie-notice", "div|cookie-banner", "div|alert", "div|gdpr consent", "section|message notice", "div|popup", "div|newsletter-banner", "p|notice"], "prose"),
    "sidebar": (["aside", "div|sidebar", "div|widget", "aside|sidebar", "section|related", "div|related-posts", "div|recommended", "div|trending", "div|share social"], "mixed"),
    "form": (["form", "form|search", "form|login", "form|newsletter signup", "form|subscribe", "form|contact"], "form"),
    "comments": (["section|comments", "div|comments", "div|comment-list", "ol|comment-list", "div|reader-comments", "div|discussion", "div|responses", "div|disqus_thread comments", "section|comments-area"], "comments"),
    "footer": (["footer", "div|footer", "div|site-footer", "footer|footer", "div|copyright", "div|page-footer"], "foot"),
}
_MAIN = ["article", "article", "article", "article", "main", "div|content", "div|post", "div|entry-content", "div|article-body", "section|post-content", "div|story", "main|main-content", "article|post", "div|text body"]


class Pages:
    """A seeded maker of pages with the label of each block."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, items):
        return items[int(self.r.random() * len(items))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int) -> str:
        def word():
            return "".join(self.pick(_SYLLABLES) for _ in range(self.r.randrange(1, 5)))

        found = [word() for _ in range(self.r.randrange(low, high + 1))]
        style = self.r.random()
        if style < 0.06:
            found = [w + self.pick(["***", "$$$", "%%%", "###", "&amp;&amp;&amp;"]) for w in found]
        elif style < 0.1:
            found = [w.upper() + "!!" for w in found]
        elif style < 0.13:
            return " | ".join(found)
        elif style < 0.16:
            found = found[:1] * len(found)
        text = " ".join(found)
        return text[:1].upper() + text[1:] + ("." if self.chance(0.8) else "")

    def prose(self) -> str:
        return " ".join(self.words(1, 25) for _ in range(self.r.randrange(1, 6)))

    def opened(self, kind: str) -> tuple[str, str]:
        tag, _, names = kind.partition("|")
        key = self.pick(["class", "class", "class", "id"])
        return (f'<{tag} {key}="{names}">' if names else f"<{tag}>"), f"</{tag}>"

    def chrome(self, kind: str) -> str:
        kinds, inside = _CHROME[kind]
        start, end = self.opened(self.pick(kinds))
        link = lambda: f'<a href="/{self.r.randrange(999)}">{self.words(1, 3)}</a>'
        items = "".join(f"<li>{link()}</li>" for _ in range(self.r.randrange(2, 9)))
        if inside == "list":
            body = self.pick([f"<ul>{items}</ul>", items, " ".join(link() for _ in range(5))]) if not start.startswith("<ul") else items
        elif inside == "title":
            body = self.pick([f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 9)}</p>", f"<div>{link()}</div>", f"<h2>{self.words(1, 4)}</h2>", self.words(1, 6)])
        elif inside == "prose":
            text = self.pick([self.words(3, 20), self.prose()])
            body = self.pick([text, text, f"<p>{text}</p>", f"<h3>{self.words(1, 4)}</h3><p>{text}</p>{link()}"])
        elif inside == "mixed":
            body = f"<h3>{self.words(1, 4)}</h3>" + self.pick([f"<ul>{items}</ul>", f"<p>{self.prose()}</p>", f"<p>{self.words(4, 20)}</p>{link()}"])
        elif inside == "form":
            body = f"<label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><p>{self.words(3, 12)}</p><button>{self.words(1, 2)}</button>"
        elif inside == "comments":
            body = f"<h3>{self.words(1, 3)}</h3>" + "".join(f'<{t} class="comment"><b>{self.words(1, 2)}</b><p>{self.prose()}</p></{t}>' for t in [self.pick(["div", "li", "article"])] for _ in range(self.r.randrange(1, 5)))
        else:
            text = f"&copy; {self.words(1, 3)} &middot; {self.words(3, 12)}"
            body = self.pick([text, text, f"<p>{text}</p>", f"<ul>{items}</ul><p>{text}</p>", f"<p>{self.prose()}</p>"])
        return start + body + end

    def paragraph(self) -> str:
        text = self.prose() if self.chance(0.75) else self.words(1, 4)
        kind = self.r.random()
        if kind < 0.12:
            return f"<p><b>{text}<br>"
        if kind < 0.2:
            return f"<p>{self.words(2, 8)} <a href='/x'>{self.words(1, 3)}</a> {self.words(2, 9)}</p>"
        if kind < 0.26:
            return f"<{(h := self.pick(['h2', 'h3', 'h4']))}>{self.words(1, 7)}</{h}>"
        if kind < 0.32:
            return "<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.36:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.39:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}<td>{self.words(1, 6)}</tr>" for _ in range(3)) + "</table>"
        if kind < 0.42:
            return f"<pre>{text}</pre>"
        if kind < 0.45:
            return f"<div>{text}</div>"
        return f"<p>{text}</p>"

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        """Html, and its pieces with a label: each piece's blocks all have it."""
        parts: list[tuple[str, int]] = [(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.words(1, 9)}</title><style>p{{}}</style></head><body>", 0)]
        for kind, p in (("notice", 0.3), ("header", 0.5), ("nav", 0.75), ("ad", 0.5), ("sidebar", 0.25), ("form", 0.2)):
            if self.chance(p):
                parts.append((self.chrome(kind), 0))
        start, end = ("", "") if self.chance(0.04) else self.opened(self.pick(_MAIN))
        if self.chance(0.25):
            start, end = start + self.pick(["<div>", '<div class="inner">', "<section>"]), end  # left unclosed, as many are
        parts.append((start, 1))
        if self.chance(0.8):
            title = f"<h1>{self.words(1, 9)}</h1>"
            parts.append((f"<header>{title}</header>" if self.chance(0.2) else title, 1))
        length = self.r.random()
        for _ in range(self.r.randrange(1, 9) if length > 0.16 else self.r.randrange(9, 60) if length > 0.03 else self.r.randrange(60, 240)):
            parts.append((self.paragraph(), 1))
            if start and self.chance(0.08):
                parts.append((self.chrome(self.pick(["ad", "sidebar", "notice", "form"])), 0))
        if start and self.chance(0.1):
            parts.append((self.chrome("comments"), 0))
        parts.append((end, 1))
        for kind, p in (("comments", 0.35), ("sidebar", 0.35), ("ad", 0.2), ("form", 0.2), ("nav", 0.15), ("notice", 0.15), ("footer", 0.85)):
            if self.chance(p):
                parts.append((self.chrome(kind), 0))
        parts.append(("</body></html>", 0))
        return "".join(p for p, _ in parts), parts


def labelled_page(maker: Pages) -> tuple[str, np.ndarray, list[str]]:
    """Html, the label of each block in order, and the texts of the main ones."""
    whole, parts = maker.page()
    marked = "".join(re.sub(r">([^<>]+)", lambda m: f">{m[1]}" if keep and m[1].strip() else m[0], part) if keep else part for part, keep in parts)
    texts = blocks(marked)[0]
    labels = np.array(["" in t for t in texts], np.float32)
    return whole, labels, [t for t, y in zip(blocks(whole)[0], labels, strict=True) if y]


@functools.lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 17) -> Lstm:
    maker, data = Pages(seed), []
    for _ in range(pages):
        whole, labels, _ = labelled_page(maker)
        x = features(whole)[1]
        if len(x):
            data.append((x, labels))
    net = Lstm()
    net.train(data)
    return net


def extract_texts(pages: list[str | None], net: Lstm) -> list[str]:
    made = [features(p) for p in pages]
    return ["\n".join(t for t, p in zip(texts, prob) if p >= 0.5) for (texts, _), prob in zip(made, net.label([x for _, x in made]))]


def extract(pages: DataFrame, net: Lstm | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; nothing is shuffled."""
    packed = pickle.dumps((net or trained()).p)

    def run(batch, held=[]):  # noqa: B006  one network a worker
        if not held:
            held.append(Lstm())
            held[0].p = pickle.loads(packed)
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = extract_texts(part.column("html").to_pylist(), held[0])
            yield {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.selectExpr("cast(page_id as bigint) page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
