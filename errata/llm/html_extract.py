"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 10).

A page becomes a tree of elements and text runs. Each node gets features:
what its tag is, words in its class, id and role, the same for its ancestors,
depth, place among its siblings, and the density of text, links, paragraphs
and sentences in its subtree. Boosted trees score whether a node holds main
text. The scores of a page are decoded together: a node that holds none rules
out its descendants, one that does may still drop any of them, and the choice
with the highest total likelihood wins. It is found in one pass up and one
down the tree.

The trees are trained when a query starts, on pages composed here from the text
of a bounded sample of the given pages (``SAMPLE_PAGES``): articles in many
layouts, among menus, headers, footers, sidebars, notices, adverts, forms and
comments, so the truth of every node is known.

Text keeps page order. Runs of white space in a block become one space, blocks
are trimmed and joined by line feeds; a line break element is white space.

Defined results: null, empty and text-less pages give the empty text; broken
markup is read leniently (unknown ends are skipped, open elements end with the
page); repeated rows each give a row; an empty table gives an empty result;
extra columns are ignored. Work is linear in the page, at any nesting depth.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.llm.common import read_table

#: Pages whose text the training pages are made of (smallest hashes, of at most SAMPLE_BYTES), and how many are made.
SAMPLE_PAGES = 200
SAMPLE_BYTES = 1 << 16
TRAIN_PAGES = 400
#: Nodes scored together.
BATCH_NODES = 40_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that the start of one of these ends, if it is open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
#: Elements past which such an implied end, or a stray end tag, does not reach.
SCOPES = frozenset("table ul ol dl select".split())
TAG_GROUPS = [frozenset(g.split()) for g in (
    "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "a", "nav", "header", "footer", "aside",
    "form input button select option label fieldset", "article", "main", "section", "div", "table tbody tr td th",
    "blockquote pre figure figcaption", "body html", "#text")]
WORD_GROUPS = [frozenset(g.split()) for g in (
    "article content main post entry story body text prose page maincontent",
    "nav menu navigation navbar breadcrumb breadcrumbs toc links tabs pagination pager",
    "header head masthead banner topbar top logo branding hero",
    "footer foot bottom copyright legal colophon",
    "sidebar side aside widget widgets rail related recommended more popular trending",
    "ad ads advert advertisement advertising sponsor sponsored promo promotion promoted adsense",
    "cookie cookies consent notice gdpr alert popup modal overlay subscribe newsletter paywall",
    "comment comments reply replies respond discussion disqus feedback reviews",
    "form login search signup register share social sharing follow")]

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*")


class Page:
    """The tree of a page as parallel lists; node 0 is the page itself."""

    def __init__(self, source: str):
        self.parent, self.tag, self.words, self.text, self.block = [-1], ["html"], [""], [""], [0]
        self.truth: list[int] = [0]
        self._stack = [0]
        self._open: dict[str, int] = {}
        self._blocks = 0
        at = 0
        low = source.lower() if "<" in source else ""
        while True:
            m = _TAG.search(source, at)
            self._run(source[at:m.start() if m else len(source)])
            if not m:
                return
            at = m.end()
            close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if close:
                self._end(name)
            elif name in RAW:
                if not rest.rstrip().endswith("/") or name != "svg":
                    stop = low.find("</" + name, at)
                    at = len(source) if stop < 0 else stop
            else:
                self._start(name, rest)

    def _add(self, tag: str, words: str, text: str) -> int:
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.block.append(self._blocks)
        return len(self.parent) - 1

    def _run(self, raw: str) -> None:
        if raw:
            self._add("#text", "", html.unescape(raw))

    def _start(self, name: str, rest: str) -> None:
        if name not in INLINE:
            if name == "br":
                self._add("#text", "", "\n")
                return
            self._blocks += 1
            if self._open.get("p") and name != "body":
                self._close("p")
        for other in ENDS.get(name, ()):
            if self._open.get(other):
                self._close(other, SCOPES)
        words = " ".join(v for a in _ATTRIBUTE.findall(rest) for v in a[1:] if v) if rest else ""
        node = self._add(name, words, "")
        if name not in VOID and not rest.rstrip().endswith("/"):
            self._stack.append(node)
            self._open[name] = self._open.get(name, 0) + 1

    def _close(self, name: str, stop: frozenset = frozenset()) -> None:
        """Ends the innermost open ``name`` and all in it, unless a scope is nearer."""
        k = len(self._stack) - 1
        while k > 0 and self.tag[self._stack[k]] != name:
            if self.tag[self._stack[k]] in stop:
                return
            k -= 1
        if k > 0:
            for n in self._stack[k:]:
                self._open[self.tag[n]] -= 1
            del self._stack[k:]

    def _end(self, name: str) -> None:
        if name in RAW:
            return
        if name not in INLINE:
            self._blocks += 1
        if self._open.get(name):
            self._close(name)

    def main_text(self, keep: np.ndarray) -> str:
        """The kept text runs, block by block."""
        blocks: dict[int, list[str]] = {}
        for k in np.flatnonzero(keep).tolist():
            if self.text[k]:
                blocks.setdefault(self.block[k], []).append(self.text[k])
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        return "\n".join(x for x in lines if x)


class Forest:
    """The nodes of several pages, with features by level-wise sums."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.first = np.cumsum([0, *sizes])
        n = int(self.first[-1])
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f)
                                      for p, f in zip(pages, self.first)]) if pages else np.zeros(0, int)
        self.depth = np.zeros(n, dtype=int)
        for k, p in enumerate(self.parent.tolist()):
            if p >= 0:
                self.depth[k] = self.depth[p] + 1
        order = np.argsort(self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        self.levels = np.split(order, cuts) if n else []
        self.x = self._features([t for p in pages for t in p.tag], [w for p in pages for w in p.words],
                                [t for p in pages for t in p.text])

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        total = values.astype(float).copy()
        for level in self.levels[:0:-1]:
            np.add.at(total, self.parent[level], total[level])
        return total

    def _features(self, tags: list[str], words: list[str], texts: list[str]) -> np.ndarray:
        n = len(tags)
        inside = np.maximum(self.parent, 0)
        known = {t: k for k, g in enumerate(TAG_GROUPS) for t in g}
        group = np.array([known.get(t, len(TAG_GROUPS)) for t in tags], dtype=int)
        tag = np.zeros((n, len(TAG_GROUPS) + 1))
        tag[np.arange(n), group] = 1
        word = np.zeros((n, len(WORD_GROUPS)))
        for k, w in enumerate(words):
            if w:
                has = {x.lower() for x in _WORD.findall(w)}
                word[k] = [len(has & g) for g in WORD_GROUPS]
        chars = np.array([len(t) - t.count(" ") if t else 0 for t in texts], dtype=float)
        marks = np.array([sum(map(t.count, ".,;!?")) if t else 0 for t in texts], dtype=float)
        is_text, is_p, is_a = group == len(TAG_GROUPS) - 1, tag[:, 0] > 0, tag[:, 4] > 0
        in_link = is_a.copy()
        above_tag, above_word = np.zeros_like(tag), np.zeros_like(word)
        for level in self.levels[1:]:
            p = self.parent[level]
            in_link[level] |= in_link[p]
            above_tag[level] = np.maximum(above_tag[p], tag[p])
            above_word[level] = np.maximum(above_word[p], word[p])
        all_chars, link_chars = self.up(chars), self.up(chars * in_link)
        all_marks, elements, paragraphs = self.up(marks), self.up(~is_text), self.up(is_p)
        children = np.bincount(self.parent[self.parent >= 0], minlength=n)
        place = np.zeros(n)
        like = np.zeros(n)
        seen: dict[int, int] = {}
        kinds: dict[tuple[int, int], int] = {}
        for k, (p, g) in enumerate(zip(self.parent.tolist(), group.tolist())):
            place[k] = seen[p] = seen.get(p, -1) + 1
            kinds[p, g] = kinds.get((p, g), 0) + 1
        for k, (p, g) in enumerate(zip(self.parent.tolist(), group.tolist())):
            like[k] = kinds[p, g]
        siblings = np.maximum(children[inside], 1)
        page = np.zeros(n)
        for a, b in zip(self.first[:-1], self.first[1:]):
            page[a:b] = all_chars[a] + 1
        dense = np.stack([
            np.log1p(all_chars), link_chars / (all_chars + 1), np.log1p(all_chars / (elements + 1)),
            all_marks / (all_chars + 1), np.log1p(paragraphs), paragraphs / (elements + 1), np.log1p(elements),
            np.log1p(children), self.depth, place / siblings, like / siblings, np.log1p(like),
            all_chars / page, all_chars / (all_chars[inside] + 1), np.log1p(all_chars[inside]),
            link_chars[inside] / (all_chars[inside] + 1), np.log1p(paragraphs[inside]), np.log1p(chars)], axis=1)
        return np.hstack([tag, tag[inside], above_tag, word, above_word, dense]).astype(np.float32)

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The likeliest choice in which no node is kept under one that is not."""
        p = np.clip(p, 1e-6, 1 - 1e-6)
        drop = self.up(np.log(1 - p))
        keep = np.log(p)
        for level in self.levels[:0:-1]:
            np.add.at(keep, self.parent[level], np.maximum(keep[level], drop[level]))
        chosen = keep > drop
        for level in self.levels[1:]:
            chosen[level] &= chosen[self.parent[level]]
        return chosen


class BoostedTrees:
    """Binary gradient boosting: histogram-grown trees of fixed depth."""

    def __init__(self, depth: int = 4, rounds: int = 60, rate: float = 0.25, l2: float = 1.0, bins: int = 32):
        self.depth, self.rounds, self.rate, self.l2, self.bins = depth, rounds, rate, l2, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        cuts = [np.unique(np.quantile(c, grid)) for c in x.T]
        # A column with few values is cut at each of them.
        cuts = [np.unique(c)[:-1] if len(np.unique(c)) <= self.bins else q for c, q in zip(x.T, cuts)]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees = []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=int)
            levels = []
            for d in range(self.depth):
                column, cut = self._split(binned, cuts, node, g, h, 1 << d)
                levels.append((column, cut))
                node = 2 * node + (x[np.arange(len(x)), column[node]] > cut[node])
            size = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, size) / (np.bincount(node, h, size) + self.l2)
            self.trees.append((levels, leaf))
            f += leaf[node]
        return self

    def _split(self, binned, cuts, node, g, h, count):
        """The best (column, cut) of each of ``count`` nodes; a cut of infinity does not split."""
        gain, column, cut = np.full(count, 1e-6), np.zeros(count, dtype=int), np.full(count, np.inf)
        gn, hn = np.bincount(node, g, count), np.bincount(node, h, count)
        for c in range(binned.shape[1]):
            width = len(cuts[c]) + 1
            if width == 1:
                continue
            at = node * width + binned[:, c]
            gl = np.bincount(at, g, count * width).reshape(count, width).cumsum(axis=1)[:, :-1]
            hl = np.bincount(at, h, count * width).reshape(count, width).cumsum(axis=1)[:, :-1]
            gr, hr = gn[:, None] - gl, hn[:, None] - hl
            won = gl ** 2 / (hl + self.l2) + gr ** 2 / (hr + self.l2) - (gn ** 2 / (hn + self.l2))[:, None]
            won[(hl < 1e-3) | (hr < 1e-3)] = 0
            best = won.argmax(axis=1)
            better = won[np.arange(count), best] > gain
            gain[better] = won[np.arange(count), best][better]
            column[better], cut[better] = c, np.asarray(cuts[c])[best[better]]
        return column, cut

    def __call__(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for levels, leaf in self.trees:
            node = np.zeros(len(x), dtype=int)
            for column, cut in levels:
                node = 2 * node + (x[rows, column[node]] > cut[node])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


class Composer:
    """Makes pages with known main text out of given paragraphs."""

    def __init__(self, paragraphs: list[str], seed: int):
        self.rnd = random.Random(seed)
        self.paragraphs = paragraphs or ["One sentence of text. And a second one, with a comma."]

    def _esc(self, text: str) -> str:
        return html.escape(text, quote=False)

    def _para(self) -> str:
        return self._esc(self.rnd.choice(self.paragraphs))

    def _short(self, most: int = 5) -> str:
        words = self.rnd.choice(self.paragraphs).split()
        k = self.rnd.randint(1, most)
        at = self.rnd.randrange(max(1, len(words) - k))
        return self._esc(" ".join(words[at:at + k]))

    def _attr(self, group: int) -> str:
        """Mostly a telling class or id, sometimes none."""
        word = self.rnd.choice(sorted(WORD_GROUPS[group]))
        extra = self.rnd.choice(["", "", "-box", "-inner", " wide", " x1", "-wrap"])
        kind = self.rnd.choice(["class", "class", "id", "role"])
        return f' {kind}="{word}{extra}"' if self.rnd.random() < 0.85 else ""

    def _links(self, n: int) -> str:
        items = [f'<a href="/{k}">{self._short()}</a>' for k in range(n)]
        form = self.rnd.randrange(4)
        if form <= 1:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " | ".join(items) if form == 2 else "".join(f"<div>{x}</div>" for x in items)

    def _boilerplate(self) -> str:
        r, kind = self.rnd, self.rnd.randrange(9)
        if kind == 0:
            return f"<nav{self._attr(1)}>{self._links(r.randint(2, 9))}</nav>" if r.random() < 0.6 else \
                f'<div class="{r.choice(sorted(WORD_GROUPS[1]))}">{self._links(r.randint(3, 9))}</div>'
        if kind == 1:
            inner = r.choice([f"<h1>{self._short()}</h1>", f"<a href='/'>{self._short(3)}</a>", f"<p>{self._short(8)}</p>"])
            return f"<header{self._attr(2)}>{inner}</header>" if r.random() < 0.6 else \
                f'<div class="{r.choice(sorted(WORD_GROUPS[2]))}">{inner}</div>'
        if kind == 2:
            inner = r.choice([f"&copy; {self._short()} &middot; {self._para()}", f"<p>{self._para()}</p>", self._links(4)])
            return f"<footer{self._attr(3)}>{inner}</footer>" if r.random() < 0.6 else \
                f'<div id="{r.choice(sorted(WORD_GROUPS[3]))}">{inner}</div>'
        if kind == 3:
            inner = f"<h3>{self._short()}</h3>" + r.choice([self._links(5), f"<p>{self._para()}</p>", f"<p>{self._short(12)}</p>" * 2])
            return f"<aside{self._attr(4)}>{inner}</aside>" if r.random() < 0.5 else \
                f'<div class="{r.choice(sorted(WORD_GROUPS[4]))}">{inner}</div>'
        if kind == 4:
            inner = r.choice([self._para(), f"<p>{self._para()}</p>", f'<a href="//x">{self._short(8)}</a>', self._short(9)])
            t = r.choice(["div", "div", "section"] if "<p>" in inner else ["div", "section", "p"])
            return f'<{t} class="{r.choice(sorted(WORD_GROUPS[5]))}">{inner}</{t}>'
        if kind == 5:
            inner = f"<p>{self._para()}</p><button>{self._short(2)}</button>" if r.random() < 0.5 else self._short(14)
            return f'<div {r.choice(["class", "id"])}="{r.choice(sorted(WORD_GROUPS[6]))}">{inner}</div>'
        if kind == 6:
            posts = "".join(f"<{t}{self._attr(7)}><b>{self._short(2)}</b> <p>{self._para()}</p></{t}>"
                            for t in [r.choice(["div", "li", "article"])] * r.randint(1, 5))
            t = r.choice(["section", "div", "div"])
            return f'<{t} id="{r.choice(sorted(WORD_GROUPS[7]))}">{posts}</{t}>'
        if kind == 7:
            return f"<form{self._attr(8)}><label>{self._short(3)}</label><input name='q'><button>{self._short(1)}</button></form>"
        return f'<div class="{r.choice(sorted(WORD_GROUPS[8]))}">{self._links(r.randint(2, 5))}</div>'

    def _article(self) -> str:
        r = self.rnd
        parts = [f"<h1>{self._short(9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 4, 6, 10, 20])):
            kind = r.random()
            text = self._para()
            if kind < 0.12:
                text = f"<b>{self._short(6)}</b><br>"
            elif kind < 0.3:
                words = text.split(" ")
                k = r.randrange(len(words))
                words[k] = r.choice([f'<a href="/w">{words[k]}</a>', f"<em>{words[k]}</em>", f"<b>{words[k]}"])
                text = " ".join(words)
            if kind > 0.9:
                parts.append(r.choice([f"<h2>{self._short()}</h2>", f"<blockquote><p>{text}</p></blockquote>", f"<pre>{text}</pre>",
                                       "<ul>" + "".join(f"<li>{self._short(12)}</li>" for _ in range(3)) + "</ul>", f"<div>{text}</div>"]))
            else:
                parts.append(f"<p>{text}" + ("</p>" if r.random() < 0.85 else ""))
        return "".join(f"\x02{p}\x03" for p in parts)

    def page(self) -> Page:
        """Marks \\x02 and \\x03 stand around main text until the nodes are labelled."""
        r = self.rnd
        body = self._article()
        if r.random() < 0.3:  # something that is not main text, in the midst of it
            cut = body.find("\x03", r.randrange(len(body))) + 1
            body = body[:cut] + self._boilerplate() + body[cut:]
        wrap = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<div{a}>{}</div>", "<div>{}</div>",
                         "<main><article{a}>{}</article></main>", "<div{a}><div>{}</div></div>", "<section{a}>{}</section>",
                         "<table><tr><td>{}</td></tr></table>", "{}"])
        body = wrap.format(body, a=self._attr(0))
        before = "".join(self._boilerplate() for _ in range(r.randint(0, 4)))
        after = "".join(self._boilerplate() for _ in range(r.randint(0, 4)))
        head = f"<!DOCTYPE html><html><head><title>{self._short()}</title></head><body>" if r.random() < 0.9 else ""
        page = Page(head + before + body + after + r.choice(["</body></html>", ""]))
        main, truth = False, [0] * len(page.text)
        for k, t in enumerate(page.text):
            if t:
                kept = []
                for c in re.split("([\x02\x03])", t):
                    main = c == "\x02" or (main and c != "\x03")
                    kept += [c] if main and c.strip("\x02 \n") else []
                page.text[k] = t.replace("\x02", "").replace("\x03", "")
                truth[k] = int(bool(kept) and bool(page.text[k].strip()))
        for k in range(len(truth) - 1, 0, -1):
            truth[page.parent[k]] |= truth[k]
        page.truth = truth
        return page


def train(sources: list[str], seed: int = 11, pages: int = TRAIN_PAGES) -> BoostedTrees:
    """Trees fitted on composed pages; ``sources`` give the words."""
    paragraphs = []
    for s in sources:
        page = Page(s)
        paragraphs += [" ".join(t.split()) for t in page.text if len(t) > 30]
    composer = Composer(sorted(set(paragraphs))[:5000], seed)
    made = [composer.page() for _ in range(pages)]
    forest = Forest(made)
    # Runs that held nothing but a mark are no nodes of a real page.
    real = np.array([t != "#text" or bool(x) for p in made for t, x in zip(p.tag, p.text)])
    return BoostedTrees().fit(forest.x[real], np.array([t for p in made for t in p.truth], dtype=float)[real])


def extract(model: BoostedTrees, sources: list[str | None]) -> list[str]:
    """Main text of each page; pages are scored together, up to BATCH_NODES at a time."""
    out: list[str] = []
    held: list[Page] = []
    nodes = 0

    def flush() -> None:
        forest = Forest(held)
        keep = forest.decode(model(forest.x))
        out.extend(p.main_text(keep[a:b]) for p, a, b in zip(held, forest.first[:-1], forest.first[1:]))
        held.clear()

    for s in sources:
        page = Page(s or "")
        if held and nodes + len(page.parent) > BATCH_NODES:
            flush()
            nodes = 0
        held.append(page)
        nodes += len(page.parent)
    if held:
        flush()
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    sample = (pages.where(F.octet_length("html").between(1, SAMPLE_BYTES))
              .orderBy(F.xxhash64("page_id", "html"), "page_id").limit(SAMPLE_PAGES).select("html").collect())
    model = train([r.html for r in sample])

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(extract(model, list(b)))

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         text_of("html").alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))
