"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with the path
of open tags (with id and class words). A bidirectional LSTM in numpy reads the page's sequence
of blocks, each as hashed vectors of its tag path and its words plus a few counts, and labels
every block in the context of all others; blocks labelled main text are joined in page order.

Pages carry no labels, so the labeller is trained on PAGES generated pages (make_page)
whose blocks' parts are known: articles in many kinds of containers, with tables, code, lists,
figures, captions and sections, among and around menus, headers, sidebars, notices, adverts, forms
and reader comments. `python -m lightfold.llm.html` trains it with a fixed seed and writes its
weights beside this file (WEIGHTS), from which queries read them; tests measure them on other
generated pages, on layouts written by hand and on given pages.

Scripts, styles, comments, the head and text areas never become blocks; text inside noscript,
object, iframe, template, math and svg is read like any other. A script or style left open takes
the rest of the page; a title or text area left open takes nothing. Null or empty html gives
an empty text; a page is read to its end however long it is, tags left open end with their
parent, and broken markup counts as text. A block whose score is exactly one half is kept.
Repeated pages get a row each; an empty table gives an empty result. Further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html
import math
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

PATH, WORDS, COUNTS = 96, 32, 8
HIDDEN = 20
PAGES = 4000
EPOCHS = 10
SEED = 22
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "labeller.npz")
BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
ENDLESS = frozenset(("script", "style"))  # left open, these take the rest of the page
FOREIGN = frozenset(("svg", "math"))  # the only ones that a closing slash ends
#: What an opening tag closes: an open element of the same set, up to the nearest of the stops.
CLOSES = {"p": ({"p"}, {"div", "article", "section", "td", "li", "blockquote", "body", "main", "aside"}), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"})}
_MARK = re.compile(r"<(?=[!?a-zA-Z]|/[a-zA-Z])")
_SKIP = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?)", re.S)
_NAMED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_PLAIN = re.compile(r"[^>\"']*+")
_BARE = re.compile(r"=\s*[^\s\"'=]*/\Z")  # a last slash that belongs to a value without quotes
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW} | {"head": re.compile(r"</head\s*>|<body\b", re.I)}


class _Tags:
    """The tags and comments of a page, in order; a tag ends at the first > outside quotes.

    What is known to have no end is remembered, so that a page of open quotes takes linear time.
    """

    def __init__(self, page: str):
        self.page = page
        self.name_until = self.plain_until = 0  # a name or a run without quotes up to here has no end
        self.dead: set[int] = set()  # opening quotes behind which there is no end

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next one; the name of a comment is empty."""
        page = self.page
        for m in _MARK.finditer(page, at):
            s = m.start()
            if page[s + 1] in "!?":
                return s, _SKIP.match(page, s).end(), "", "", ""
            if s < self.name_until and page[s + 1] != "/":
                continue
            k = _NAMED.match(page, s)
            end = self._end(k.end()) if k.end() > self.plain_until else None
            if end:
                return s, end, k[1], k[2].lower(), page[k.end() : end - 1]
            self.name_until = k.end()
        return None

    def _end(self, at: int) -> int | None:
        page, opened, i = self.page, [], at
        first = None
        while True:
            i = _PLAIN.match(page, i).end()
            first = i if first is None else first
            if page[i : i + 1] == ">":
                return i + 1
            if i >= len(page) or i in self.dead:
                break
            opened.append(i)
            i = page.find(page[i], i + 1) + 1
            if not i:
                break
        self.dead.update(opened)
        self.plain_until = first
        return None


class Path:
    """The open tags of a block, outermost first; what paths have in common is held once."""

    __slots__ = ("above", "mark", "bits", "last")

    def __init__(self, above: "Path | None" = None, mark: str = ""):
        self.above, self.mark = above, mark
        self.bits = above.bits if above else frozenset()  # buckets of all words of the path
        self.last = -1  # bucket of the innermost tag
        if mark:
            more = {_bucket("t", w, PATH) for w in mark.split()}
            self.bits = self.bits if more <= self.bits else self.bits | more
            self.last = _bucket("last", mark.split(None, 1)[0], PATH)

    def __iter__(self) -> Iterator[str]:
        out, node = [], self
        while node.above:
            out.append(node.mark)
            node = node.above
        return reversed(out)

    def __getitem__(self, i: int) -> str:
        return tuple(self)[i]


class _Open:
    """The open tags of a page; closing one takes time for what it closes, not for what stays open."""

    def __init__(self):
        self.names: list[str] = []
        self.paths = [Path()]
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, mark: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.paths.append(Path(self.paths[-1], mark) if name in BLOCK or name == "a" else self.paths[-1])

    def top(self, names: Iterable[str]) -> int:
        """Place of the innermost open tag of these names, -1 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int) -> None:
        while len(self.names) > place:
            self.places[self.names.pop()].pop()
            self.paths.pop()

    def within(self, name: str) -> bool:
        return bool(self.places.get(name))


def blocks(page: str | None) -> list[tuple[Path, str, float]]:
    """(path, text, share of the text inside links) of each leaf block, in page order."""
    page = page or ""
    out: list[tuple[Path, str, float]] = []
    opened = _Open()
    texts: list[str] = []
    linked, spoken = 0, False
    path = opened.paths[-1]

    def close() -> None:
        nonlocal texts, linked, spoken
        if spoken:
            t = _SPACE.sub(" ", "".join(texts)).strip()
            out.append((path, t, min(1.0, linked / max(1, len(t)))))
        texts, linked, spoken = [], 0, False

    def say(raw: str) -> None:
        nonlocal path, linked, spoken
        if not raw:
            return
        t = html.unescape(raw) if "&" in raw else raw
        if not spoken:
            path = opened.paths[-1]
        texts.append(t)
        size = len(t.strip())
        spoken = spoken or size > 0
        if opened.within("a"):
            linked += size

    at = 0
    size = len(page)
    tags = _Tags(page)
    endless: set[str] = set()  # names of which no end is left
    while at < size:
        tag = tags.after(at)
        if not tag:
            say(page[at:])
            break
        start, end, slash, name, given = tag
        say(page[at:start])
        at = end
        if not name:
            continue
        if slash:
            if name in BLOCK:
                close()
            if opened.within(name):
                opened.cut(opened.top((name,)))
            continue
        if name == "br":
            say(" ")
            continue
        if name in FOREIGN and given.endswith("/") and not _BARE.search(given):
            continue
        if name in RAW or name == "head":
            end = None if name in endless else _END[name].search(page, at)
            if end:
                at = end.start() if name == "head" else end.end()
                continue
            endless.add(name)
            if name in ENDLESS:
                break
            continue
        if name in BLOCK:
            close()
            if name in CLOSES:
                shut, stop = CLOSES[name]
                place = opened.top(shut)
                if place > opened.top(stop):
                    opened.cut(place)
        if name not in VOID:
            mark = name
            if given:
                said = " ".join(x for a in _ATTR.findall(given) for x in a[1:] if x).lower()
                if said:
                    mark += " " + " ".join(_NAME.findall(said))
            opened.push(name, mark)
    close()
    return out


_memo: dict[str, int] = {}


def _bucket(kind: str, word: str, n: int) -> int:
    key = kind + word
    got = _memo.get(key)
    if got is None:
        if len(_memo) > 200_000:
            _memo.clear()
        got = _memo[key] = zlib.crc32(key.encode("utf-8", "surrogatepass")) % n
    return got


def features(found: list[tuple[Path, str, float]]) -> np.ndarray:
    """One row a block: hashed tag path, hashed words, counts."""
    out = np.zeros((len(found), PATH + WORDS + COUNTS), np.float32)
    n = len(found)
    for i, (path, text, linked) in enumerate(found):
        if path:
            out[i, list(path.bits)] = 1.0
            if path.last >= 0:
                out[i, path.last] += 0.5
        words = _WORD.findall(text.lower())
        if words:
            out[i, PATH : PATH + WORDS] = np.bincount([_bucket("w", w, WORDS) for w in words], minlength=WORDS) / len(words)
        size = len(text)
        out[i, PATH + WORDS :] = (np.log1p(size) / 6, linked, (text.count(".") + text.count(",")) / (1 + size / 40), text[-1] in ".!?:;\"'”»", i / n, (n - i) / n, "©" in text or "@" in text, np.log1p(len(words)) / 5)
    return out


class Labeller:
    """Bidirectional LSTM and a logistic output."""

    def __init__(self, size: int = PATH + WORDS + COUNTS, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, size**-0.5, (size, 4 * hidden)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            self.p["b" + d] = np.zeros(4 * hidden, np.float32)
            self.p["b" + d][hidden : 2 * hidden] = 1.0
        self.p["o"] = rng.normal(0, 0.1, 2 * hidden).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x (time, pages, size); states where mask is 0 stay as they were."""
        steps, pages, _ = x.shape
        h = self.hidden
        given = x @ self.p["W" + d] + self.p["b" + d]
        s, c = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
        out, memory = np.zeros((steps, pages, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + s @ self.p["U" + d]
            g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            i, f, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            a = np.tanh(z[:, 3 * h :])
            c2 = f * c + i * a
            tc = np.tanh(c2)
            s2 = o * tc
            m = mask[t][:, None]
            if keep:
                memory.append((t, s, c, i, f, o, a, tc, m))
            s, c = m * s2 + (1 - m) * s, m * c2 + (1 - m) * c
            out[t] = s
        return out, memory

    def score(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, _ = self._run(x, mask, "f", False)
        b, _ = self._run(x, mask, "b", False)
        z = np.concatenate((f, b), 2) @ self.p["o"] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h = self.hidden
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        (f, mf), (b, mb) = self._run(x, mask, "f", True), self._run(x, mask, "b", True)
        both = np.concatenate((f, b), 2)
        z = both @ self.p["o"] + self.p["c"]
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * mask / mask.sum()
        grad["o"] = np.einsum("tp,tph->h", dz, both)
        grad["c"][0] = dz.sum()
        dout = dz[:, :, None] * self.p["o"]
        for d, memory, dh in (("f", mf, dout[:, :, :h]), ("b", mb, dout[:, :, h:])):
            ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            dzs = np.zeros((*x.shape[:2], 4 * h), np.float32)
            for t, s, c, i, fg, o, a, tc, m in reversed(memory):
                ds = ds + dh[t]
                d2, dkeep = m * ds, (1 - m) * ds
                dc2 = m * dc + d2 * o * (1 - tc**2)
                v = np.concatenate((dc2 * a * i * (1 - i), dc2 * c * fg * (1 - fg), d2 * tc * o * (1 - o), dc2 * i * (1 - a**2)), 1)
                dzs[t] = v
                grad["U" + d] += s.T @ v
                ds = v @ self.p["U" + d].T + dkeep
                dc = dc2 * fg + (1 - m) * dc
            grad["W" + d] = np.einsum("tpi,tpj->ij", x, dzs, optimize=True)
            grad["b" + d] = dzs.sum((0, 1))
        return grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), PATH + WORDS + COUNTS), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


_PARTS = {
    "menu": (["nav", "div menu", "ul nav", "div navigation", "div topbar", "nav main menu", "div breadcrumb"], "Home News Sports Contact About Login Sign in Search Menu Products Archive Help".split()),
    "header": (["header", "div header", "div masthead", "div site header", "header top"], "Welcome to Daily site logo since Your source for".split()),
    "footer": (["footer", "div footer", "div site footer", "footer bottom", "div copyright"], "© Copyright 2024 All rights reserved Privacy Terms Imprint Contact Sitemap".split()),
    "side": (["aside", "div sidebar", "div widget", "aside related", "div right rail", "section related posts", "div recommended"], "Popular posts Related Most read Tags Archives Read more Trending".split()),
    "advert": (["div ad", "div advert", "div banner ad", "aside sponsored", "div promo", "ins ads", "section ad slot"], "Advertisement Sponsored Buy now Special offer only today discount".split()),
    "notice": (["div cookie", "div cookie banner", "div notice", "div consent", "section alert", "div popup modal", "dialog"], "We use cookies accept settings consent privacy This site uses Accept all notice".split()),
    "form": (["form", "form newsletter", "div subscribe", "form login", "form search", "div signup form"], "Subscribe Your email address Sign up newsletter Submit Name Password Send".split()),
    "comments": (["section comments", "div comments", "div comment list", "ol commentlist", "div disqus thread", "div reader comments"], "says Reply comment posted by user hours ago likes Great article thanks".split()),
    "share": (["div share", "div social", "ul share buttons"], "Share Tweet Facebook Print Email this Follow us".split()),
}
_HOMES = ["article", "article", "article", "article article", "article story", "main", "main article", "div content", "div main content", "div post body", "div article body", "section article", "div entry content", "article post", "div story", "main content", "div", "section", "body"]


def make_page(rng: np.random.Generator) -> str:
    """A generated page; blocks of main text hold the mark \x01, which is taken out before reading."""
    letters = [c + v for c in "bcdfghjklmnprstvwz" for v in "aeiou"] + ["th", "er", "on", "an", "re", "in", "é", "ß", "ñ"]
    pick = lambda xs: xs[rng.integers(len(xs))]

    def word() -> str:
        return "".join(pick(letters) for _ in range(rng.integers(1, 5)))

    def prose(least: int, most: int) -> str:
        out = []
        for _ in range(int(rng.integers(least, most + 1))):
            out.append(word() + pick(["", "", "", "", "", ",", "."]))
        return (" ".join(out)).capitalize() + pick([".", ".", ".", ""])

    def element(mark: str, inner: str) -> str:
        name, *words = mark.split()
        if words and rng.random() < 0.05:
            words = [word() for _ in words]
        attr = f' {pick(["class", "class", "id"])}="{" ".join(words)}"' if words else ""
        return f"<{name}{attr}>{inner}" + ("" if name in ("p", "li") and rng.random() < 0.2 else f"</{name}>")

    def rough(kind: str) -> str:
        homes, said = _PARTS[kind]
        items = []
        for _ in range(int(rng.integers(1, 8))):
            t = " ".join(pick(said) for _ in range(rng.integers(1, 5))) if rng.random() < 0.5 else prose(1, 5)
            if kind in ("comments", "advert", "notice", "side", "footer") and rng.random() < 0.5:
                t = prose(4, 40)
            if kind in ("menu", "share") or kind in ("side", "footer") and rng.random() < 0.6:
                t = f'<a href="/{word()}">{t}</a>'
            items.append(t)
        if kind in ("menu", "share") or rng.random() < 0.3:
            inner = "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
        else:
            inner = "".join(t if rng.random() < 0.5 and len(items) == 1 else element(pick(["p", "div", "span", "p", "h3"]), t) for t in items)
        return element(pick(homes), inner)

    def number() -> str:
        return pick(["", "$", "", ""]) + str(rng.integers(1, 5000)) + pick(["", ".5", " %", " km", "th"])

    def cell() -> str:
        return number() if rng.random() < 0.5 else prose(1, 5)

    def grid() -> str:
        wide = int(rng.integers(1, 5))
        rows = [[f"<{t}>\x01{cell()}</{t}>" for _ in range(wide)] for t in (["th"] if rng.random() < 0.4 else []) + ["td"] * int(rng.integers(1, 7))]
        inner = "".join(f"<tr>{''.join(r)}</tr>" for r in rows)
        inner = f"<tbody>{inner}</tbody>" if rng.random() < 0.4 else inner
        return element(pick(["table", "table", "table data", f"table {word()}"]), (f"<caption>\x01{prose(2, 9)}</caption>" if rng.random() < 0.3 else "") + inner)

    def code() -> str:
        lines = [pick(["", "  ", "    "]) + word() + pick([" = ", "(", ".", " -> ", ": "]) + word() + pick([")", ";", "", " {", " + 1"]) for _ in range(int(rng.integers(1, 9)))]
        text = "\x01" + "\n".join(lines)
        return f"<pre>{text}</pre>" if rng.random() < 0.5 else f"<pre><code>{text}</code></pre>"

    def figure() -> str:
        shown = pick([f'<img src="/{word()}.png" alt="{word()}">', "", f"<svg><text>\x01{word()}</text></svg>", code() if rng.random() < 0.3 else ""])
        if rng.random() < 0.75:
            return element(pick(["figure", "figure image", "figure"]), f"{shown}<figcaption>\x01{prose(2, 20)}</figcaption>")
        return element(pick(["div figure", "div caption", "div image"]), f"{shown}<p>\x01{prose(2, 20)}</p>")

    def listing() -> str:
        least = 1 if rng.random() < 0.5 else 3
        items = "".join(f"<li>\x01{prose(least, 15 if least > 1 else 3)}" + pick(["</li>", "</li>", ""]) for _ in range(rng.integers(1, 7)))
        return element(pick(["ul", "ul", "ol", f"ul {word()}"]), items)

    def terms() -> str:
        return "<dl>" + "".join(f"<dt>\x01{prose(1, 4)}</dt><dd>\x01{prose(2, 20)}</dd>" for _ in range(rng.integers(1, 5))) + "</dl>"

    def paragraph() -> str:
        t = prose(1, 6) if rng.random() < 0.25 else prose(8, 120)
        if rng.random() < 0.1:
            t += f' <a href="/{word()}">{word()}</a> ' + prose(3, 20)
        return element(pick(["p"] * 12 + ["div", f"p {word()}"]), pick(["", "", "<b>", "<em>"]) + "\x01" + t + pick(["", "", "<br>"]))

    def body() -> str:
        parts = [f"<{h}>\x01{prose(3, 12)}</{h}>" for h in ["h1"] if rng.random() < 0.85]
        rich = rng.random() < 0.7  # else little but paragraphs
        for _ in range(int(rng.integers(1, 14)) if rng.random() < 0.9 else int(rng.integers(14, 70))):
            kind = rng.random()
            if kind < 0.02:  # one line over and over
                parts += [paragraph()] * int(rng.integers(2, 40))
            elif kind < (0.5 if rich else 0.88):
                parts.append(paragraph())
            elif kind < (0.56 if rich else 0.95):
                h = pick(["h2", "h2", "h3", "h4"])
                parts.append(f"<{h}>\x01{prose(1, 8)}</{h}>")
            elif kind < 0.9:
                parts.append(pick([grid, code, figure, listing, listing, terms, lambda: f"<blockquote>\x01{prose(6, 40)}</blockquote>", lambda: f"<details><summary>\x01{prose(1, 5)}</summary>{paragraph()}</details>"])())
            else:
                parts.append(rough(pick(["advert", "share", "form", "side", "comments", "comments", "notice", "menu"])))
                if rng.random() < 0.92:  # the article goes on
                    parts += [paragraph() for _ in range(rng.integers(1, 3))]
        if rng.random() < 0.25 and len(parts) > 2:
            at = int(rng.integers(1, len(parts)))
            parts = parts[:at] + [element(pick(["section", "div", f"div {word()}", f"section {word()}"]), "".join(parts[at:]))]
        return "".join(parts)

    before = [k for k in ("notice", "header", "menu", "advert", "form", "share") if rng.random() < 0.55]
    after = [k for k in ("comments", "side", "advert", "form", "share", "footer") if rng.random() < 0.55]
    if rng.random() < 0.3:
        rng.shuffle(before)
    home = pick(_HOMES)
    inner = body()
    page = "".join(rough(k) for k in before) + (inner if home == "body" else element(home, inner)) + "".join(rough(k) for k in after)
    if rng.random() < 0.3:
        page = element(pick(["div wrapper", "div page", "div container"]), page)
    return f"<!DOCTYPE html><html><head><title>{prose(2, 9)}</title><script>var a='<p>';</script></head><body>{page}" + pick(["</body></html>", ""])


def labelled_page(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    found = blocks(make_page(rng))
    y = np.array(["\x01" in t for _, t, _ in found], np.float32)
    return features([(p, t.replace("\x01", "") or "x", s) for p, t, s in found]), y


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rng = np.random.default_rng(seed)
    data = [labelled_page(rng) for _ in range(pages)]
    model = Labeller(seed=seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    mean = {k: v.copy() for k, v in model.p.items()}  # running mean of the weights, steadier than the last ones
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        order = order[np.argsort([len(data[i][1]) // 8 for i in order], kind="stable")]
        starts = np.arange(0, len(order), 16)
        rng.shuffle(starts)
        for lo in starts:
            some = [data[i] for i in order[lo : lo + 16]]
            x, mask = padded([f for f, _ in some])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, t) in enumerate(some):
                y[: len(t), i] = t
            step += 1
            rate = 0.0001 + 0.004 * (1 + math.cos(math.pi * step / (epochs * len(starts))))
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                mean[k] += (model.p[k] - mean[k]) / min(step, 400)
    model.p = mean
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    out = [""] * len(found)
    order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
    lo = 0
    while lo < len(order):
        # pages of like length together, some thousand blocks at most unless one page alone has more
        hi = lo + 1
        while hi < len(order) and hi - lo < 256 and len(found[order[hi]]) * (hi - lo + 1) <= 8192:
            hi += 1
        some = order[lo:hi]
        x, mask = padded([features(found[i]) for i in some])
        y = model.score(x, mask)
        for j, i in enumerate(some):
            out[i] = "\n".join(t for (_, t, _), s in zip(found[i], y[:, j]) if s >= 0.5)
        lo = hi
    return out


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    prepare(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = main_texts(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return given.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def save(model: Labeller, path: str = WEIGHTS) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float32) for k, v in model.p.items()})


def load(path: str = WEIGHTS) -> Labeller:
    model = Labeller()
    with np.load(path) as held:
        model.p = {k: held[k] for k in model.p}
    return model


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(prepare(spark), sf_dir, "pages"), load())


if __name__ == "__main__":
    save(train())
