"""Main text of web pages with a recurrent block labeller in numpy.

A page is cut into leaf blocks: runs of text between block-level tags, each with its path of tags,
class words and ids.  A block becomes a vector of its hashed path, its hashed words and a few numbers,
and a bidirectional LSTM reads the page's blocks in order, both ways, and gives each the probability
of being part of the article.  So a block is judged with the whole page in view.

The network is trained here, on ``pages`` made-up pages whose layouts mix articles with menus,
headers, footers, sidebars, notices, adverts, forms and comments; nothing of the data is used.

Nulls: a null or empty page has an empty text.  Scripts, styles, comments and the head hold no blocks.
Nor do drawings and templates (``SILENT``) that are closed; of one left open only the start tag is dropped,
while an unclosed script or style runs to the end of the page.  The text that noscript, canvas and other
embedded elements (``FALLBACK``) hold is text like any other.  Other unclosed tags are closed by what
follows; text without any tag is one block.  A page is read whole, in time in proportion to its length.
An empty table gives no rows; repeated rows get equal texts.  A column of the name that is added is replaced.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corymb.llm import tokens
from corymb.llm.batches import append_columns
from corymb.llm.shared import need

#: Elements that end the block before them, that have no end tag, and that hold no text of the page.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("template svg".split())
#: Elements that say nothing of what kind of text they hold: what they show instead of themselves is judged by what is around it.
FALLBACK = frozenset("noscript iframe object canvas audio video".split())
HEAD = frozenset(["head", "title"])
#: Start tags that may stand in a head; any other closes it, and a title that was left open.
IN_HEAD = HEAD | frozenset("base basefont bgsound link meta noframes noscript".split())
#: An open element of the first kind is closed by a start tag of the second.
CLOSES = {"p": BLOCK - {"button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: An open element of one of these kinds is closed by the start tag.
CLOSED_BY = {tag: tuple(k for k, tags in CLOSES.items() if tag in tags) for tag in frozenset().union(*CLOSES.values())}
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"[^>=]*(?:=\s*|>|\Z)")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in ("script", "style")}
#: A title's text runs to its end tag, unless one of the others comes first: then it was left open.
_TITLE_END = re.compile(r"<(?:(?P<close>/title)|/head|body|title|svg)(?=[\s/>])[^>]*>", re.I | re.A)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")

PATH, WORDS, NUMBERS, HIDDEN = 192, 32, 5, 20
INPUT = PATH + WORDS + NUMBERS


class Tag(NamedTuple):
    """A tag, or what isn't text (no name), from ``start`` to ``stop``."""

    start: int
    stop: int
    name: str = ""
    end: bool = False
    attrs: str = ""

    @property
    def self_closed(self) -> bool:
        return self.attrs.rstrip().endswith("/")


class Tags:
    """Finds a page's tags in one pass.

    Quotes count where a value begins.  If a quote never ends, so that the page would end inside a tag, quotes
    no longer count from there on; so a page takes time in proportion to its length.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.comments = page, True, True

    def _close(self, at: int) -> int:
        """After the ``>`` that ends the tag whose attributes begin at ``at``; -1 if none does."""
        page, start = self.page, at
        while self.quotes:
            m = _VALUE.match(page, at)
            at = m.end()
            if page[at - 1 : at] == ">" and at > m.start():
                return at
            if at >= len(page):
                self.quotes = False
            elif page[at] in "\"'" and page[at - 1 : at] != ">":
                stop = page.find(page[at], at + 1)
                self.quotes = stop >= 0
                at = stop + 1
        return page.find(">", start) + 1 or -1

    def next(self, at: int) -> Tag | None:
        """The first tag from ``at`` on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start) and self.comments:
                stop = page.find("-->", start + 4)
                if stop >= 0:
                    return Tag(start, stop + 3)
                self.comments = False
            if page.startswith(("<!", "<?"), start):
                stop = page.find(">", start)
                if stop < 0:
                    return None
                return Tag(start, stop + 1)
            if not (m := _TAG.match(page, at)):
                continue
            stop = self._close(m.end())
            if stop < 0:
                return None  # no > is left, so no tag
            name, end, attrs = m[2].lower(), bool(m[1]), page[m.end() : stop - 1]
            if name in _RAW_END and not end:
                close = _RAW_END[name].search(page, stop)
                stop = page.find(">", close.end()) + 1 if close else 0
                return Tag(start, stop or len(page))
            return Tag(start, stop, name, end, attrs)
        return None


def _silent_ends(page: str) -> dict[int, int]:
    """Where each closed embedded element ends, by where it starts; an end tag closes the last open one of its name."""
    opened, ends, tags, at = {}, {}, Tags(page), 0
    while t := tags.next(at):
        at = t.stop
        if t.name in SILENT:
            if t.end and opened.get(t.name):
                ends[opened[t.name].pop()] = at
            elif not t.end and not (t.name == "svg" and t.self_closed):
                opened.setdefault(t.name, []).append(t.start)
    return ends


class Path(NamedTuple):
    """All open elements' names as a set of hash bits, and the last four names; it takes as long to add to whatever the depth."""

    bits: int = 0
    last: tuple[str, ...] = ()

    def below(self, names: tuple[str, ...]) -> Path:
        bits = self.bits
        for name in names:
            bits |= _bit(name)
        return Path(bits, (self.last + names)[-4:])


@lru_cache(50_000)
def _bit(name: str) -> int:
    return 1 << zlib.crc32(name.encode()) % (PATH - 32)


def leaf_blocks(page: str) -> list[tuple[str, Path, int]]:
    """(text, path, characters in links) of each non-empty block outside the head."""
    out, stack, parts, links, at = [], [], [], 0, 0
    ends, tags, opened = None, Tags(page), Counter()

    def cut() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text and not (opened["head"] or opened["title"]):
                out.append((text, stack[-1][1] if stack else Path(), links))
            parts.clear()
        links = 0

    def close_from(i: int) -> None:
        opened.subtract(t for t, _ in stack[i:])
        del stack[i:]

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            piece = html.unescape(piece)
            if stack and stack[-1][0] == "head" and not piece.isspace():
                close_from(len(stack) - 1)
            parts.append(piece)
            if opened["a"]:
                links += len(piece.strip())

    while t := tags.next(at):
        if t.start > at:
            add(page[at : t.start])
        at, tag = t.stop, t.name
        if not tag:
            continue
        if tag in SILENT:
            if not t.end and not (tag == "svg" and t.self_closed):
                ends = _silent_ends(page) if ends is None else ends
                at = max(at, ends.get(t.start, at))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            cut()
        if t.end:
            if opened[tag] > 0:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close_from(i)
            continue
        if tag == "title" and (close := _TITLE_END.search(page, at)) and close["close"]:
            at = close.end()
            continue
        if tag not in IN_HEAD and (opened["head"] > 0 or opened["title"] > 0):
            close_from(next(i for i, (x, _) in enumerate(stack) if x in HEAD))
        if any(opened[x] > 0 for x in CLOSED_BY.get(tag, ())):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSED_BY[tag]:
                    close_from(i)
                    break
                if stack[i][0] in BLOCK and stack[i][0] not in CLOSES:
                    break
        if tag not in VOID and not t.self_closed:
            named = "".join(f" {a or b or c}" for a, b, c in _NAMES.findall(t.attrs)) if t.attrs else ""
            path = stack[-1][1] if stack else Path()
            stack.append((tag, path if tag in FALLBACK else path.below((f"<{tag}>", *(w.lower() for w in _WORD.findall(named))))))
            opened[tag] += 1
    add(page[at:])
    cut()
    return out


@lru_cache(20_000)
def _path_vector(path: Path) -> np.ndarray:
    out = np.zeros(PATH, np.float32)
    out[[i for i in range(PATH - 32) if path.bits >> i & 1]] = 1
    for name in path.last:
        if name[0] == "<":
            out[PATH - 32 + zlib.crc32(f"{name} near".encode()) % 32] = 1
    return out


def vectors(blocks: list[tuple[str, Path, int]]) -> np.ndarray:
    """The network's input for consecutive blocks."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return x
    x[:, :PATH] = [_path_vector(p) for _, p, _ in blocks]
    data, offsets = tokens.text_bytes(pa.array([t for t, _, _ in blocks], pa.large_string()))
    hashes, bounds = tokens.words(data, offsets, tokens.NOT_SPACE)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(len(blocks)), count)
    bins = np.bincount(owner * WORDS + (hashes & np.uint64(WORDS - 1)).astype(np.int64), minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    x[:, PATH : PATH + WORDS] = bins / np.maximum(count, 1)[:, None] * 0.5
    size = np.diff(offsets)
    x[:, PATH + WORDS] = np.log1p(count) / 5
    x[:, PATH + WORDS + 1] = [min(1.0, n / max(1, len(t))) for t, _, n in blocks]
    x[:, PATH + WORDS + 2] = [t[-1] in ".!?:;»”\"" for t, _, _ in blocks]
    x[:, PATH + WORDS + 3] = size / np.maximum(count, 1) / 10
    x[:, PATH + WORDS + 4] = 1
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockTagger:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"{d}x"] = normal(INPUT, 4 * HIDDEN, scale=0.15)
            self.p[f"{d}h"] = normal(HIDDEN, 4 * HIDDEN, scale=0.2)
            self.p[f"{d}b"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # open forget gates
        self.p["out"] = normal(2 * HIDDEN, scale=0.3)
        self.p["bias"] = np.zeros(1, np.float32)

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """x: (time, pages, input); the state stays where a page has no block."""
        z_in = x @ self.p[f"{d}x"] + self.p[f"{d}b"]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = h.copy()
        out, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = z_in[t] + h @ self.p[f"{d}h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            now = f * c + i * g
            tanh = np.tanh(now)
            m = mask[t][:, None]
            kept.append((t, h, c, i, f, o, g, tanh, m))
            h, c = np.where(m, o * tanh, h), np.where(m, now, c)
            out[t] = h
        return out, kept

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's vectors, the probability of each block; pages of like length run together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * len(pages[order[hi]]) <= 8192:
                hi += 1
            group = order[lo:hi]
            p = self._forward([pages[i] for i in group])[0]
            for k, i in enumerate(group):
                out[i] = p[: len(pages[i]), k]
            lo = hi
        return out

    def _forward(self, pages: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
        n = max(map(len, pages))
        x, mask = np.zeros((n, len(pages), INPUT), np.float32), np.zeros((n, len(pages)), bool)
        for k, v in enumerate(pages):
            x[: len(v), k], mask[: len(v), k] = v, True
        f, kf = self._pass("f", x, mask)
        b, kb = self._pass("b", x, mask)
        both = np.concatenate([f, b], 2)
        return _sigmoid(both @ self.p["out"] + self.p["bias"]), (x, mask, both, kf, kb)

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        p, (x, mask, both, kf, kb) = self._forward(pages)
        y = np.zeros_like(p)
        for k, v in enumerate(labels):
            y[: len(v), k] = v
        dz = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
        g = {"out": np.einsum("tn,tnh->h", dz, both), "bias": np.array([dz.sum()], np.float32)}
        back = dz[:, :, None] * self.p["out"]
        for d, kept, dh_out in (("f", kf, back[:, :, :HIDDEN]), ("b", kb, back[:, :, HIDDEN:])):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            g[f"{d}h"] = np.zeros_like(self.p[f"{d}h"])
            for t, h, c, i, f, o, cand, tanh, m in reversed(kept):
                dh = dh + dh_out[t]
                at, past = np.where(m, dh, 0), np.where(m, 0, dh)
                dcell = np.where(m, dc, 0) + at * o * (1 - tanh**2)
                z = np.concatenate([dcell * cand * i * (1 - i), dcell * c * f * (1 - f), at * tanh * o * (1 - o), dcell * i * (1 - cand**2)], 1)
                gates[t] = z
                g[f"{d}h"] += h.T @ z
                dh = z @ self.p[f"{d}h"].T + past
                dc = np.where(m, dcell * f, dc)
            flat = gates.reshape(-1, 4 * HIDDEN)
            g[f"{d}x"], g[f"{d}b"] = x.reshape(-1, INPUT).T @ flat, flat.sum(0)
        return g

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], *, epochs: int = 8, batch: int = 24, rate: float = 0.01, seed: int = 5) -> BlockTagger:
        rng = np.random.default_rng(seed)
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        t, total = 0, epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            groups = []
            for lo in range(0, len(order), 12 * batch):  # pages of like length share a batch: little padding
                part = sorted(order[lo : lo + 12 * batch], key=lambda i: len(pages[i]))
                groups += [part[i : i + batch] for i in range(0, len(part), batch)]
            for g in rng.permutation(len(groups)):
                t += 1
                pick = groups[g]
                for k, g in self.gradients([pages[i] for i in pick], [labels[i] for i in pick]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= (rate * (1 - 0.95 * t / total) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


#: Names that mark what isn't part of an article, by kind, and names of articles and of mere wrappers.
ASIDE_NAMES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs topnav toc pagination pager skip links",
    "header": "header masthead topbar logo branding sitename site-header page-header",
    "footer": "footer copyright colophon legal site-footer bottom credits",
    "aside": "aside sidebar side widget related recommended trending popular rail complementary more tags tagcloud",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adbox dfp commercial",
    "notice": "notice cookie cookies consent gdpr popup modal alert disclaimer overlay privacy warning paywall",
    "form": "form newsletter subscribe signup login search contact survey poll input",
    "comments": "comments comment reply replies respond discussion thread disqus reader-comments feedback reviews",
    "share": "share sharing social follow buttons toolbar byline-share",
}
ARTICLE_NAMES = "article content main post entry story body text article-body post-content entry-content story-body prose".split()
WRAPPER_NAMES = "container wrapper page row col inner outer layout section block grid region wrap site".split()


@lru_cache(1)
def _vocabulary(n: int = 5000) -> list[str]:
    """Made-up words of one to three syllables."""
    rng = np.random.default_rng(29)
    syllables = "an be ch de en er fa ge ha in ka la mo ne or pa qu re st th ti un ve wh za on ed ing".split()
    return ["".join(syllables[i] for i in rng.integers(0, len(syllables), int(k))) for k in rng.integers(1, 4, n)]


def made_up_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page, and for each of its leaf blocks whether the article holds it."""
    out: list[str] = []
    labels: list[int] = []
    pool = _vocabulary()
    word = lambda: pool[int(rng.integers(len(pool)))]
    pick = lambda names: str(rng.choice(names.split() if isinstance(names, str) else names))

    def words(lo: int, hi: int) -> str:
        text = " ".join(pool[i] for i in rng.integers(0, len(pool), int(rng.integers(lo, hi))))
        return (text.capitalize() + ".") if rng.random() < 0.7 else text

    def block(text: str, label: int) -> str:
        labels.append(label)
        return text

    def attrs(names: str | None) -> str:
        return f' {pick(["class", "class", "class", "id"])}="{names}"' if names else ""

    def paragraphs(label: int, lo: int, hi: int) -> None:
        for _ in range(int(rng.integers(lo, hi))):
            kind = rng.random()
            text = words(2, 60) if rng.random() < 0.8 else words(1, 5)
            if rng.random() < 0.15:
                text = f"<b>{text}" + ("</b>" if rng.random() < 0.5 else "")
            if rng.random() < 0.15:
                text += f' <a href="/x">{word()}</a> {word()}'
            if kind < 0.72:
                out.append(f"<p>{block(text, label)}" + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.8:
                out.append(f"<h{rng.integers(2, 4)}>{block(words(1, 8), label)}</h2>".replace("</h2>", "</h2></h3>"))
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{block(words(1, 12), label)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote>{block(text, label)}</blockquote>")
            elif kind < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{block(words(1, 5), label)}</td><td>{block(words(1, 5), label)}</td></tr>" for _ in range(int(rng.integers(1, 4)))) + "</table>")
            else:
                out.append(f"<div>{block(text, label)}</div>")

    def side(kind: str) -> None:
        names = ASIDE_NAMES[kind]
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        bare = rng.random() < 0.4 and own not in ("div", "section")
        tag = own if bare or rng.random() < 0.3 else pick(["div", "section", "div", "ul" if kind == "nav" else "div"])
        out.append(f"<{tag}{attrs(None if bare else pick(names) + (' ' + pick(WRAPPER_NAMES) if rng.random() < 0.3 else ''))}>")
        style = rng.random()
        if kind in ("nav", "share") and style < 0.8 or kind in ("aside", "footer") and style < 0.3:
            listed = tag != "ul" and rng.random() < 0.8
            out.append("<ul>" * listed + "".join(f'<li><a href="/{word()}">{block(words(1, 4), 0)}</a></li>' for _ in range(int(rng.integers(1, 9)))) + "</ul>" * listed)
        elif kind == "form":
            out.append(f'<label>{block(words(1, 4), 0)}</label><input name="q"><button>{block(words(1, 3), 0)}</button>')
        elif kind == "comments" or style < 0.5:
            if kind == "comments" and rng.random() < 0.6:
                for _ in range(int(rng.integers(1, 5))):
                    out.append(f'<div class="{pick(names)}">')
                    paragraphs(0, 1, 3)
                    out.append("</div>")
            else:
                paragraphs(0, 1, 4)
        elif kind == "header":
            out.append(f"<h1>{block(words(1, 6), 0)}</h1>" if rng.random() < 0.5 else f"<p>{block(words(1, 8), 0)}</p>")
        else:
            out.append(block(words(1, 25), 0))
        out.append(f"</{tag}>")

    if rng.random() < 0.03:  # text without any tag
        return block(" ".join(words(3, 40) for _ in range(int(rng.integers(1, 4)))), 1), labels
    wrapped = rng.random() < 0.4
    out.append(f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{}}</style></head><body>")
    if wrapped:
        out.append(f"<div{attrs(pick(WRAPPER_NAMES))}>")
    sides = list(ASIDE_NAMES)
    for kind in ("nav", "header", "ad", "notice", "share", "form", "aside"):
        if rng.random() < 0.35:
            side(kind)
    how = rng.random()
    opening = "<article>" if how < 0.35 else "<main>" if how < 0.42 else f"<article{attrs(pick(ARTICLE_NAMES))}>" if how < 0.55 else f"<div{attrs(pick(ARTICLE_NAMES))}>" if how < 0.88 else ""
    if opening and rng.random() < 0.25:
        opening = f"<main>{opening}" if rng.random() < 0.5 else f"<div{attrs(pick(WRAPPER_NAMES))}>{opening}"
    out.append(opening)
    if rng.random() < 0.75:
        head = rng.random() < 0.1 and opening
        out.append(f"{'<header>' if head else ''}<h1>{block(words(1, 12), 1)}</h1>{'</header>' if head else ''}")
    paragraphs(1, 1, 9)
    if rng.random() < 0.5:
        side(pick(["ad", "ad", "aside", "share", "form", "notice", "comments", "nav"]))
        if rng.random() < 0.7:
            paragraphs(1, 1, 4)
    out += [f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening))]
    for kind in sides:
        if rng.random() < 0.3:
            side(kind)
    if wrapped:
        out.append("</div>")
    if rng.random() < 0.7:
        side("footer")
    out.append("</body></html>")
    return "".join(out), labels


@lru_cache(2)
def fit(pages: int = 1200, seed: int = 17) -> BlockTagger:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    while len(xs) < pages:
        page, labels = made_up_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise AssertionError(f"{len(blocks)} blocks and {len(labels)} labels: {page}")
        xs.append(vectors(blocks))
        ys.append(np.array(labels, np.float32))
    return BlockTagger().train(xs, ys)


def extract(model: BlockTagger, pages: list[str | None], least: float = 0.5) -> list[str]:
    """The main text of each page."""
    out = []
    for lo in range(0, len(pages), 200):
        blocks = [leaf_blocks(p or "") for p in pages[lo : lo + 200]]
        flat = vectors([b for page in blocks for b in page])
        ends = np.cumsum([len(b) for b in blocks])
        found = model.probabilities(np.split(flat, ends[:-1]))
        out += [" ".join(t for (t, _, _), p in zip(page, ps, strict=True) if p >= least) for page, ps in zip(blocks, found, strict=True)]
    return out


def extract_pages(df: DataFrame, model: BlockTagger, *, html_col: str = "html", name: str = "text") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    at = [c.lower() for c in df.columns].index(html_col)
    return append_columns(df, lambda b: [pa.array(extract(shared.value, b.column(at).to_pylist()), pa.string())], T.StructType([T.StructField(name, T.StringType())]), drop=(name,))


def page_digest(pages: DataFrame) -> DataFrame:
    out = extract_pages(need(pages, page_id="long", url="string", html="string"), fit())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
