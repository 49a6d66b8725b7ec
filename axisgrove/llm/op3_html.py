"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

A tolerant parser makes a tree of the page's block elements (and of inline ones with a telling attribute). Each node
has features: tag, tokens of class, id and role, its own and its ancestors' hints, depth, text density and link share of
its subtree, position, and its siblings. Gradient-boosted trees give the probability that the node's text is content.
Decoding picks, by dynamic programming over the whole tree, for each node to keep it, to drop it with everything below,
or (under nodes that are not kept) to look further down; a change between a node and its child costs, so that single
odd nodes do not tear an article, and nothing below a dropped node is ever kept.

The trees are fitted on the driver, in seconds, on pages that this module generates: layouts of many kinds with known
content (TRAIN_PAGES, a fixed number). No page of the input is looked at for that.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
page order by one space.

Defined results: null or empty html has empty text; a page without any block that is kept has empty text; markup that
never closes ends with the page, and only a comment or one of HTML's raw-text elements that does takes the rest of the
page with it; whatever attributes a page has, the training marker among them, it is parsed alike; the time for a page is
linear in its length; repeated rows are judged row by row; an empty table gives an empty result; columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

import functools
import html as entities
import re
import sys
from collections import Counter

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY = {"button": {"button"}, "select": {"select"}, "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
SCOPES = set("ul ol table dl body html article section div main aside nav header footer form blockquote".split())

# Attribute tokens that hint at boilerplate or content.
BAD = {
    "ad": "ad ads advert adverts advertisement adslot adbox banner promo promoted sponsor sponsored dfp outbrain taboola".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc topbar tabs skip".split(),
    "edge": "header masthead footer foot colophon sidebar side rail aside widget widgets copyright legal".split(),
    "talk": "comment comments disqus respond reply replies discussion reactions".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall subscribe newsletter signup login".split(),
    "more": "related share sharing social recommended recommendations popular trending tags author-bio search form".split(),
}
GOOD = "article content post entry story text body main page-content blog news single article-body post-content entry-content".split()
HINT = {t: i for i, ts in enumerate(BAD.values()) for t in ts}
GOOD_SET = set(GOOD)
TAGS = ("nav", "header", "footer", "aside", "form", "ul", "li", "article", "main", "section", "div", "p", "h", "table", "quote")
TAG_OF = {**{t: i for i, t in enumerate(TAGS)}, "ol": 5, "dl": 5, "dd": 6, "dt": 6, **{f"h{k}": 12 for k in range(1, 7)}, "tr": 13, "td": 13, "th": 13, "tbody": 13, "blockquote": 14, "pre": 14, "figure": 14, "figcaption": 14, "fieldset": 4, "button": 4, "select": 4, "option": 4, "body": 10, "html": 10, "center": 10}

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|data-truth)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACES = re.compile(r"[\x20\x09-\x0D]+")
ZEROS, HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def unescaped(text: str) -> str:
    """Character references decoded; numbers far beyond the last character, of any length, are replacement characters."""
    if "&#" in text:
        text = HUGE.sub("\ufffd", ZEROS.sub("&#", text))
    return entities.unescape(text) if "&" in text else text


class Open:
    """The open elements. Tags inside a block, and inside a scope, are counted, so that a tag which closes nothing costs
    no walk over the stack: parsing is linear in the page."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("html-root", 0)]
        self.open: Counter = Counter()
        self.inline: list[Counter] = [Counter()]  # of each block that is open
        self.scope: list[Counter] = [Counter()]
        self.linked = 0

    def push(self, name: str, node: int) -> None:
        self.stack.append((name, node))
        self.open[name] += 1
        self.linked += name == "a"
        if name in INLINE:
            self.inline[-1][name] += 1
        else:
            self.inline.append(Counter())
        self.scope[-1][name] += 1
        if name in SCOPES:
            self.scope.append(Counter())

    def pop_to(self, names) -> bool:
        """Closes the last element of one of the names and all inside it; whether that closed a block."""
        block = False
        while True:
            name, _ = self.stack.pop()
            if name in SCOPES:
                self.scope.pop()
            self.scope[-1][name] -= 1
            if name in INLINE:
                self.inline[-1][name] -= 1
            else:
                self.inline.pop()
                block = True
            self.open[name] -= 1
            self.linked -= name == "a"
            if name in names:
                return block

    def close(self, name: str) -> bool:
        """An end tag: an inline element is closed only inside its own block."""
        return self.pop_to({name}) if (self.inline[-1] if name in INLINE else self.open)[name] > 0 else False

    def imply(self, closes: set) -> None:
        """A start tag that ends elements of these names, inside the scope."""
        if any(self.scope[-1][t] > 0 for t in closes):
            self.pop_to(closes)


END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW} | {"head": re.compile(r"</head\b[^>]*>|<body\b", re.I)}


class Page:
    """Nodes in page order (0: the root) and the pieces of text between breaks."""

    def __init__(self, source: str, training: bool = False) -> None:
        self.tag, self.parent, self.hint, self.good, self.truth = [len(TAGS)], [-1], [-1], [0], [0]
        self.own, self.links, self.anchors = [0], [0], [0]
        self.pieces: list[tuple[int, str, bool]] = []  # node, text, whether a block begins before it
        self.fresh, around = True, Open()
        at, last, ends = 0, source.rfind(">"), {}
        while at <= last:
            m = TOKEN.search(source, at, last + 1)
            if not m:
                break
            self.read(source[at : m.start()], around)
            at = m.end()
            name = (m.group(2) or m.group(5) or "").lower()
            rest = m.group(3) or m.group(6) or ""
            if not name:
                # a comment that never ends takes the rest
                at = len(source) if m.group().startswith("<!--") and not m.group().endswith("-->") else at
            elif m.group(1) or m.group(4):
                block = around.close(name)
                self.fresh = self.fresh or block or name not in INLINE
            elif name in VOID:
                self.fresh = self.fresh or name in ("br", "hr")
            elif name in RAW or name == "head":
                if not rest.endswith("/") or name in ("script", "style"):
                    if ends.get(name, 0) is not None:
                        ends[name] = END[name].search(source, at)
                    end = ends[name]
                    # a head that never ends holds nothing but what belongs there
                    if end:
                        at = end.start() if end.group().lower().startswith("<body") else end.end()
                    elif name != "head":
                        at = len(source)
                self.fresh = True
            else:
                self.start(name, rest, around, training)
        self.read(source[at:], around)

    def read(self, raw: str, around: Open) -> None:
        if raw and not (raw.isspace() and self.fresh):
            t = unescaped(raw)
            node = around.stack[-1][1]
            size = len(t) - sum(map(t.count, " \n\t\r"))
            self.own[node] += size
            if around.linked:
                self.links[node] += size
            self.pieces.append((node, t, self.fresh))
            self.fresh = False

    def start(self, name: str, rest: str, around: Open, training: bool) -> None:
        if name not in INLINE:
            self.fresh = True
            around.imply(CLOSED_BY.get(name, set()) | ({"p"} if name in CLOSES_P else set()))
        node = around.stack[-1][1]
        hint, good, truth = -1, 0, self.truth[node]
        if "=" in rest:
            for key, a, b, c in ATTRIBUTE.findall(rest):
                value = (a or b or c).lower()
                if key.lower() == "data-truth":
                    truth = int(value) if training else truth
                    continue
                for token in re.split(r"[\s_]+", value):
                    for part in {token, *token.split("-")}:
                        if part in HINT:
                            hint = HINT[part]
                        elif part in GOOD_SET:
                            good = 1
        if name == "a":
            self.anchors[node] += 1
        if name not in INLINE or hint >= 0:
            self.tag.append(TAG_OF.get(name, len(TAGS)))
            self.parent.append(node)
            self.hint.append(hint)
            self.good.append(good)
            self.truth.append(truth)
            self.own.append(0)
            self.links.append(0)
            self.anchors.append(0)
            node = len(self.tag) - 1
        if not rest.endswith("/"):
            around.push(name, node)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        own, links, anchors = (np.array(x, dtype=float) for x in (self.own, self.links, self.anchors))
        text, link, hooks, nodes, paras = own.copy(), links.copy(), anchors.copy(), np.ones(n), (np.array(self.tag) == TAG_OF["p"]).astype(float)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            link[p] += link[i]
            hooks[p] += hooks[i]
            nodes[p] += nodes[i]
            paras[p] += paras[i]
        depth, bad_above, good_above, kids, nth, before = (np.zeros(n) for _ in range(6))
        hints_above = np.zeros((n, len(BAD)))
        tags_above = np.zeros((n, 5))
        last: dict[int, int] = {}
        hint, good, tag = self.hint, self.good, self.tag
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            hints_above[i] = hints_above[p]
            tags_above[i] = tags_above[p]
            if hint[p] >= 0:
                hints_above[i, hint[p]] = 1
            if tag[p] < 5:
                tags_above[i, tag[p]] = 1
            bad_above[i] = bad_above[p] + (hint[p] >= 0)
            good_above[i] = good_above[p] + (good[p] or tag[p] in (7, 8))
            nth[i] = kids[p]
            kids[p] += 1
            before[i] = before[last[p]] + text[last[p]] if p in last else before[p]
            last[p] = i
        whole = max(text[0], 1.0)
        par = np.array([max(x, 0) for x in parent])
        cols = [np.array(tag) == k for k in range(len(TAGS))]
        cols += [np.array(hint) == k for k in range(len(BAD))]
        cols += [np.array(good), np.minimum(depth, 30), np.minimum(bad_above, 5), np.minimum(good_above, 5)]
        cols += [hints_above[:, k] for k in range(len(BAD))] + [tags_above[:, k] for k in range(5)]
        cols += [np.log1p(text), np.log1p(own), text / nodes, link / np.maximum(text, 1), hooks / (1 + text / 20), text / whole, text / np.maximum(text[par], 1), before / whole, nth, kids[par], kids, paras, paras / nodes, np.log1p(text[par]), link[par] / np.maximum(text[par], 1)]
        return np.stack(cols, axis=1).astype(np.float32)

    def weights(self) -> np.ndarray:
        text = np.array(self.own, dtype=float)
        for i in range(len(text) - 1, 0, -1):
            text[self.parent[i]] += text[i]
        return np.log1p(text)

    def text(self, kept: np.ndarray) -> str:
        blocks: list[list[str]] = []
        open_block = False
        for node, t, fresh in self.pieces:
            if not kept[node]:
                open_block = False
                continue
            if fresh or not open_block:
                blocks.append([])
                open_block = True
            blocks[-1].append(t)
        return " ".join(x for x in (SPACES.sub(" ", "".join(b)).strip(" ") for b in blocks) if x)


def decoded(parent: list[int], weight: np.ndarray, p: np.ndarray, change: float = 2.0) -> np.ndarray:
    """Which nodes are kept: the best consistent choice of keep, drop and pass for the whole tree."""
    n = len(parent)
    yes, no = weight * np.log(p), weight * np.log(1 - p)
    keep, drop, skip = yes.copy(), no.copy(), 0.5 * no
    for i in range(n - 1, 0, -1):
        q = parent[i]
        keep[q] += max(keep[i], drop[i] - change)
        drop[q] += drop[i]
        skip[q] += max(keep[i] - change, drop[i], skip[i])
    state = np.zeros(n, dtype=np.int8)  # 0 drop, 1 keep, 2 pass
    state[0] = int(np.argmax([drop[0], keep[0] - change, skip[0]]))
    for i in range(1, n):
        above = state[parent[i]]
        if above == 1:
            state[i] = keep[i] >= drop[i] - change
        elif above == 2:
            state[i] = int(np.argmax([drop[i], keep[i] - change, skip[i]]))
    return state == 1


class Boosted:
    """Gradient-boosted trees for the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> None:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        f = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.start, self.depth, self.trees = float(f[0]), depth, []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p) + 1e-6
            at = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, 255, dtype=np.int64)
            for d in range(depth):
                width, base = 2**d, 2**d - 1
                best = np.zeros(width)
                for j in range(b.shape[1]):
                    key = (at - base) * bins + b[:, j]
                    sg = np.cumsum(np.bincount(key, g, width * bins).reshape(width, bins), axis=1)
                    sh = np.cumsum(np.bincount(key, h, width * bins).reshape(width, bins), axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feature[base : base + width][better] = j
                    cut[base : base + width][better] = k[better]
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - (2**depth - 1)
            value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
            f += value[leaf]
            self.trees.append((feature, cut, value))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            f += value[at - (2**self.depth - 1)]
        return np.clip(1 / (1 + np.exp(-f)), 1e-4, 1 - 1e-4)


# --- generated training pages

TRAIN_PAGES = 500


def generated(rng: np.random.Generator) -> str:
    """A page of a random layout; data-truth marks what is content."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p

    def words(lo: int, hi: int) -> str:
        w = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 10)))) for _ in range(int(rng.integers(lo, hi + 1)))]
        return " ".join(w).capitalize() + pick(".", "", "!", "...")

    def linked(k: int, lo: int = 1, hi: int = 3) -> str:
        return "".join(f"<li><a href=/x>{words(lo, hi)}</a></li>" for _ in range(k))

    def ad() -> str:
        kind = pick("ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo", "advertisement")
        return f'<div {pick("class", "class", "id")}="{kind}" data-truth=0>{pick("", "<p>")}{words(2, 25)}{pick("", "<a href=/y>" + words(1, 3) + "</a>")}</div>'

    def nav() -> str:
        inner = f"<ul>{linked(int(rng.integers(3, 9)))}</ul>"
        return pick(f"<nav>{inner}</nav>", f'<nav class="menu">{inner}</nav>', f'<div class="navbar">{inner}</div>', f'<div id="menu">{inner}</div>', f"<header><h2>{words(1, 3)}</h2>{inner}</header>", f'<div class="header">{words(1, 4)}{inner}</div>', f"<nav>{inner}</nav>")

    def footer() -> str:
        inner = f"&copy; {words(1, 12)}" + (f"<ul>{linked(4)}</ul>" if chance(0.3) else "")
        return pick(f"<footer>{inner}</footer>", f'<div class="footer">{inner}</div>', f"<footer><p>{inner}</p></footer>", f'<div id="footer"><p>{inner}</p></div>', f"<footer>{inner}</footer>")

    def sidebar() -> str:
        inner = f"<h3>{words(1, 3)}</h3><ul>{linked(int(rng.integers(3, 8)), 2, 9)}</ul>" + (f"<p>{words(5, 30)}</p>" if chance(0.5) else "")
        return pick(f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="rail" class="widget">{inner}</div>', f'<aside class="related">{inner}</aside>')

    def notice() -> str:
        return f'<div class="{pick("cookie-notice", "cookie", "consent", "notice", "popup", "newsletter", "alert")}"><p>{words(6, 30)}</p><button>{words(1, 1)}</button></div>'

    def form() -> str:
        return f'<form action=/s><label>{words(1, 4)}</label><input name=q><p>{words(2, 12)}</p><button>Go</button></form>'

    def talk() -> str:
        items = "".join(f'<{(t := pick("li", "div"))} class="comment"><b>{words(1, 2)}</b><p>{words(3, 45)}</p></{t}>' for _ in range(int(rng.integers(1, 6))))
        return pick(f'<div id="comments"><h3>{words(1, 2)}</h3>{items}</div>', f'<section class="comments">{items}</section>', f'<ul class="comment-list">{items}</ul>')

    def para() -> str:
        body = words(1, 90) if chance(0.9) else words(90, 400)
        if chance(0.25):
            body += f" <a href=/z>{words(1, 4)}</a> {words(1, 30)}"
        if chance(0.15):
            body = f"<b>{body}<br>"
        return pick(f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}")

    def article() -> str:
        out = [f"<h1>{words(1, 12)}</h1>"] if chance(0.85) else []
        for _ in range(int(rng.integers(1, 14)) if chance(0.9) else 0):
            r = rng.random()
            if r < 0.78:
                out.append(para())
            elif r < 0.84:
                out.append(f"<h2>{words(1, 7)}</h2>")
            elif r < 0.89:
                out.append("<ul>" + "".join(f"<li>{words(2, 18)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif r < 0.92:
                out.append(f"<blockquote>{para()}</blockquote>")
            elif r < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 5)}<td>{words(1, 5)}</tr>" for _ in range(3)) + "</table>")
            elif r < 0.97:
                out.append(ad())
            else:
                out.append(pick(f'<div class="share" data-truth=0><a href=/s>{words(1, 2)}</a></div>', f"<aside data-truth=0><p>{words(5, 20)}</p></aside>", '<div data-truth=0 class="newsletter">' + form() + "</div>"))
        inner = "".join(out)
        a, b = pick(("<article data-truth=1>", "</article>"), ("<article data-truth=1>", "</article>"), ("<article data-truth=1>", "</article>"), ("<main><article data-truth=1>", "</article></main>"), ('<div id="content" data-truth=1>', "</div>"), ('<div class="post-content" data-truth=1>', "</div>"), ('<section class="article-body" data-truth=1>', "</section>"), ("<main data-truth=1>", "</main>"), ("<div data-truth=1>", "</div>"), ("<table><tr><td data-truth=1>", "</td></tr></table>"), ('<div class="entry"><div data-truth=1>', "</div></div>"))
        return a + inner + b

    top = [nav()] + [notice()] * chance(0.3) + [ad()] * chance(0.6) + [form()] * chance(0.15)
    rng.shuffle(top)
    after = [sidebar()] * chance(0.35) + [talk()] * chance(0.35) + [ad()] * chance(0.25) + [form()] * chance(0.15)
    rng.shuffle(after)
    page = "".join(top) + (sidebar() if chance(0.1) else "") + article() + "".join(after) + (footer() if chance(0.9) else "")
    if chance(0.3):
        page = f'<div class="{pick("wrapper", "page", "container")}">{page}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(1, 8)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{page}" + ("</body></html>" if chance(0.9) else "")


@functools.lru_cache
def fit(pages: int = TRAIN_PAGES, seed: int = 3) -> Boosted:
    """The same trees for the same arguments, so a process fits them once."""
    rng = np.random.default_rng(seed)
    trees = [Page(generated(rng), training=True) for _ in range(pages)]
    return Boosted(np.concatenate([t.features() for t in trees]), np.concatenate([np.array(t.truth, dtype=float) for t in trees]))


def main_text(source: str | None, model: Boosted) -> str:
    page = Page(source or "")
    if not page.pieces:
        return ""
    return page.text(decoded(page.parent, page.weights(), model.predict(page.features())))


def extractor(model: Boosted):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sources = batch.column(2).to_pylist()
            for lo in range(0, len(sources), 200):
                part = [Page(x or "") for x in sources[lo : lo + 200]]
                p = model.predict(np.concatenate([x.features() for x in part]))
                texts, at = [], 0
                for x in part:
                    n = len(x.tag)
                    texts.append(x.text(decoded(x.parent, x.weights(), p[at : at + n])) if x.pieces else "")
                    at += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), batch.column(1).slice(lo, len(part)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """Returns page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(extractor(model or fit()), "page_id bigint, url string, text string, n_chars bigint")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
