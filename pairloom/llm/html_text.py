"""HTML extraction by minimum-cut labelling.

A page is cut into blocks, runs of text between block-level tags, each with its path of open elements. A classifier gives
each block the log-odds that it is content, and these are the capacities to the two terminals, all on one scale and bounded
by TEXT_BOUND and CONTEXT. Neighbours in page order, and blocks under one container, are tied by smoothness edges, stronger
the closer they stand in the tree; the ties of a block sum to about as much as its own capacity may be. The labels are the
sides of the minimum cut, found by max-flow over the whole page.

The log-odds have two parts. What the text and its tag say (length, links, punctuation) is a logistic regression, fitted by
`learn` on the blocks of a bounded sample of pages, TRAIN_PAGES of at most TRAIN_CHARS characters: blocks in an article or
main element are its content, blocks in elements that hold no article text its boilerplate. Its weights have a Gaussian
prior at PRIOR, so pages without such elements leave them there. What the path says (article, main, nav, names such as
sidebar) is a bounded amount for the context, CONTEXT; a name of several words counts if all of them are names or say where something
stands, and a heading's own name never does. The name or form of an element that holds most of the page's text
says nothing, and an article or main element below such a name is free of it where it holds the page's larger part.

A page is read in one pass without going back: each character is looked at a bounded number of times, and end tags look up
what is open instead of scanning for it.

Defined cases: a null or empty page, or an empty table, gives an empty text or table. Unclosed and misnested tags are
closed as browsers do for paragraphs, list items and table parts; a stray end tag is ignored; an unclosed comment, tag,
script or style runs to the end. A page of short blocks only, a list or a few words, keeps those that no element and no links
speak against. Repeated rows are treated alike. Blocks that both labels suit equally well are boilerplate.
`extract` keeps all other columns; `text` and `n_chars` of the input are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import text_batches

#: Where a tag ends: at the first > outside of quoted attribute values.
TAG_PART = re.compile(r"=\s*([\"'])|>")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
COMMENT_START, COMMENT_END = re.compile("-?>"), re.compile("--!?>")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names by their role in HTML.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas audio video xmp noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of these, what stands unclosed holds all the rest of the page.
TO_THE_END = frozenset("script style textarea title xmp".split())
#: Groups of elements whose start tags end each other, up to the nearest element that holds the group.
GROUPS = {
    "item": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "term": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "row": (frozenset(["tr"]), frozenset(["table"])),
    "cell": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ENDS = {tag: g for g, (ended, _) in GROUPS.items() for tag in ended}
GROUPS_OF = {tag: tuple(g for g, (ended, within) in GROUPS.items() if tag in ended | within) for ended_within in GROUPS.values() for tag in ended_within[0] | ended_within[1]}
#: Elements and roles that hold no article text.
AWAY = frozenset("nav footer aside button select menu dialog search".split())
#: Elements that rather hold no article text, but may wrap a page.
MARKS = frozenset(["form", "fieldset"])
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar tooltip status".split())
HOME = frozenset(["article", "main"])
#: Parts of class and id names that speak against content, and for it.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner bottombar breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus dropdown feedback footer form gdpr header legal links login masthead menu metanav modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup print promo promoted promotion rail reactions recommend recommended register related remark replies reply respond responses rss search share sharing shoutbox sidebar sidenav signin signup skip skyscraper social sponsor sponsored subscribe subscription taboola tags teaser toc toolbar topbar tracking warning widget widgets".split()
)
#: Words that say where something stands or what it is made of: beside one of BAD_NAMES they leave the name as it is. A name with
#: any other word, such as one made of a heading's words, says nothing.
PLACE_NAMES = frozenset(
    "above after all and area article articles aside bar below big block body bottom box btn button buttons card cards center col column columns container content desktop entry extra fixed float floating global grid group hidden icon icons image inline inner item items js latest layout left level line list lists main media menus middle mini mobile module more most my news of on outer overlay page pages panel popular post posts primary quick read reader readers recent right row secondary section sections side single site slider slot small sticky stories story strip sub tab table tabs tertiary text the title to top unit user users vertical view web website widget wrap wrapper you your zone".split()
)
GOOD_NAMES = frozenset("article articlebody body content copy entry hentry main page paragraph post prose story text".split())
#: First parts of names that tell a page's layout, such as has-sidebar.
LAYOUT = frozenset("has no not with without".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("tag", "parent", "depth", "away", "home", "good", "link", "named", "mark", "state", "block")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.away = parent.away if parent else False
        self.home = parent.home if parent else False
        self.good = parent.good if parent else False
        self.link = parent.link if parent else False
        self.named = False  # by its own name against content
        self.state: tuple[Element | None, bool] | None = None
        #: the nearest block element, itself included, or the root
        self.block = self if tag in BLOCK or parent is None else parent.block
        if tag == "a":
            self.link = True
        if tag in HOME:
            self.home = True
        if tag in AWAY or (tag == "header" and not self.home):
            self.away = True
        if attributes and not attributes.isspace():
            self._read(attributes)
        #: the nearest element, itself included, that is marked against content
        self.mark = self if tag in MARKS or (self.named and tag not in HOME) else parent.mark if parent else None

    def _read(self, attributes: str) -> None:
        names: list[str] = []
        bad: set[str] = set()
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for token in value.split():
                    parts = NAME.findall(token)
                    if len(parts) == 1 or (parts and parts[0].lower() not in LAYOUT):
                        low = [x.lower() for x in parts]
                        names += low
                        if all(x in BAD_NAMES or x in PLACE_NAMES for x in low):
                            bad.update(x for x in low if x in BAD_NAMES)
            elif key == "role" and value.lower() == "form":
                self.named = True
            elif key == "role" and value.lower() in AWAY_ROLES:
                self.away = True
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                self.away = True
        if names and self.tag not in ("html", "body"):
            # a header of the article itself may be named so; a heading's name is made of its own words
            if bad - {"header"} if self.home else bad:
                self.named = self.tag not in HEADINGS
            elif not GOOD_NAMES.isdisjoint(names) and self.tag not in HOME:
                self.good = True


class Block:
    __slots__ = ("text", "home", "words", "links")

    def __init__(self, text: str, home: Element, links: int):
        self.text, self.home, self.links = text, home, links
        self.words = text.count(" ") + 1


class _Open:
    """The open elements: a stack that knows what a tag may close without scanning it."""

    def __init__(self):
        self.stack = [Element("", "", None)]
        self.blocks: list[int] = []  # places of the block elements
        self.inline: list[dict[str, int]] = [{}]  # inline names open above each of them, and above the root
        self.names: dict[str, int] = {}  # block names that are open
        self.groups: dict[str, list[int]] = {g: [] for g in GROUPS}

    def push(self, name: str, attributes: str) -> None:
        at = len(self.stack)
        self.stack.append(Element(name, attributes, self.stack[-1]))
        if name in BLOCK:
            self.blocks.append(at)
            self.inline.append({})
            self.names[name] = self.names.get(name, 0) + 1
            for g in GROUPS_OF.get(name, ()):
                self.groups[g].append(at)
        else:
            self.inline[-1][name] = self.inline[-1].get(name, 0) + 1

    def pop(self) -> str:
        name = self.stack.pop().tag
        if name in BLOCK:
            self.blocks.pop()
            self.inline.pop()
            self.names[name] -= 1
            for g in GROUPS_OF.get(name, ()):
                self.groups[g].pop()
        else:
            self.inline[-1][name] -= 1
        return name

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.pop()

    def close(self, name: str) -> None:
        """An end tag. That of an inline element doesn't close blocks; one that nothing is open for is ignored."""
        if (self.names if name in BLOCK else self.inline[-1]).get(name):
            while self.pop() != name:
                pass

    def before_block(self, name: str) -> None:
        """Close what a block's start tag ends: its like in its group, an open paragraph, and a heading an open heading."""
        for g in ("cell", "row") if name == "tr" else (ENDS[name],) if name in ENDS else ():
            ended, places = GROUPS[g][0], self.groups[g]
            if places and self.stack[places[-1]].tag in ended:
                self.cut(places[-1])
        if self.blocks:
            tag = self.stack[self.blocks[-1]].tag
            if tag == "p" or (name in HEADINGS and tag in HEADINGS):
                self.cut(self.blocks[-1])


def _tag_end(html: str, at: int) -> int:
    """The place after the > that ends the tag at `at`, or -1."""
    while (m := TAG_PART.search(html, at)) is not None:
        if m[1] is None:
            return m.end()
        closed = html.find(m[1], m.end())
        if closed < 0:
            break
        at = closed + 1
    return -1


def _comment_end(html: str, at: int) -> int:
    """The place after the comment whose text begins at `at`, or 0. <!--> and <!---> are whole comments."""
    short = COMMENT_START.match(html, at)
    found = short or COMMENT_END.search(html, at)
    return found.end() if found else 0


def _pieces(html: str) -> Iterator[tuple[str, str, str]]:
    """Text as ("text", raw, ""), tags as ("start" or "end", name, attributes); raw elements as ("raw", name, "")."""
    at, end = 0, len(html)
    closers: dict[str, re.Pattern | None] = {}
    while at < end:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 == end:
            yield "text", html[at:], ""
            return
        ahead = html[lt + 1]
        if ahead in "!?" or (ahead == "/" and TAG_NAME.match(html, lt + 2) is None):
            closed = _comment_end(html, lt + 4) if html.startswith("!--", lt + 1) else html.find(">", lt) + 1
            if lt > at:
                yield "text", html[at:lt], ""
            if not closed:
                return
            at = closed
            continue
        kind = "end" if ahead == "/" else "start"
        name = TAG_NAME.match(html, lt + 2 if kind == "end" else lt + 1)
        if name is None:  # this < is text
            yield "text", html[at : lt + 1], ""
            at = lt + 1
            continue
        if lt > at:
            yield "text", html[at:lt], ""
        closed = _tag_end(html, name.end())
        if closed < 0:
            return
        at, tag, attributes = closed, name[0].lower(), html[name.end() : closed - 1]
        if kind == "start" and tag in RAW and not attributes.endswith("/"):
            if tag not in closers:
                closers[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)
            found = closers[tag].search(html, at) if closers[tag] is not None else None
            if found is not None:
                at = _tag_end(html, found.end())
                if at < 0:
                    return
            else:
                closers[tag] = None  # nor is there one further on
                if tag in TO_THE_END:
                    return
            yield "raw", tag, ""
        elif kind == "start" and tag in RAW:
            yield "raw", tag, ""
        else:
            yield kind, tag, attributes


def blocks(html: str) -> list[Block]:
    """The page's runs of text in order, character references decoded, white space single, with their elements."""
    open_, out = _Open(), []
    pieces: list[tuple[str, bool]] = []
    home = open_.stack[0]

    def flush() -> None:
        if pieces:
            text = " ".join("".join([p for p, _ in pieces]).split())
            if text:
                out.append(Block(text, home, sum(len(p) for p, linked in pieces if linked)))
            pieces.clear()

    for kind, what, attributes in _pieces(html):
        if kind == "text":
            if pieces or not what.isspace():
                if not pieces:
                    home = open_.stack[-1]  # the innermost element: inline names count too
                pieces.append((unescape(what) if "&" in what else what, open_.stack[-1].link))
        elif kind == "raw" or (kind == "start" and what == "br"):
            if pieces:
                pieces.append((" ", False))
        elif kind == "end":
            if what in BLOCK or what == "br":
                flush()
            open_.close(what)
        else:
            if what in BLOCK:
                flush()
                open_.before_block(what)
            if what not in VOID:
                open_.push(what, attributes)
    flush()
    return out


def _marks(bs: list[Block]) -> list[Element]:
    """All marks above the blocks, the deepest first."""
    out = set()
    for b in bs:
        m = b.home.mark
        while m is not None and m not in out:
            out.add(m)
            m = m.parent.mark
    return sorted(out, key=lambda m: -m.depth)


def settle(bs: list[Block]) -> None:
    """Gives the blocks' elements and those above them their state: the outermost mark in force, and whether an article
    or main element holds them."""
    inside: dict[Element, int] = {}  # unlinked characters below each mark
    lengths = [0 if b.home.away else max(len(b.text) - b.links, 0) for b in bs]
    order = _marks(bs)

    def gather(into: dict[Element, int], amounts: list[int]) -> None:
        for b, n in zip(bs, amounts):
            if b.home.mark is not None:
                into[b.home.mark] = into.get(b.home.mark, 0) + n
        for m in order:
            if m.parent.mark is not None:
                into[m.parent.mark] = into.get(m.parent.mark, 0) + into.get(m, 0)

    gather(inside, lengths)
    total = sum(lengths)
    # the text of content elements under no mark but such as hold most of the page, and how much of it stands below each mark
    likely = [n if (b.home.home or b.home.good) and (b.home.mark is None or 2 * inside[b.home.mark] > total) else 0 for b, n in zip(bs, lengths)]
    held: dict[Element, int] = {}
    gather(held, likely)
    free = sum(likely)
    for b in bs:
        path, e = [], b.home
        while e is not None and e.state is None:
            path.append(e)
            e = e.parent
        mark, home = e.state if e is not None else (None, False)
        for e in reversed(path):
            if e.mark is e and mark is None and not (2 * inside[e] > total and 10 * (free - held[e]) < inside[e]):
                mark = e
            if e.tag in HOME:
                if mark is not None and not e.named and inside[mark] > free - held[mark]:
                    mark = None
                home = home or mark is None
            e.state = (mark, home)


#: What the path may say, in log-odds: an article or main element; names of content; names and forms against it; elements
#: that hold no article text.
CONTEXT = {"home": 3.5, "good": 1.5, "mark": -4.0, "away": -4.0}
#: The most that a block's text and tag may say either way.
TEXT_BOUND = 3.0
#: What is added for blocks that no element speaks against, where otherwise none of a page's blocks were content.
ALONE = 2.0
FEATURES = ("one", "words", "sentence", "links", "paragraph", "heading", "item", "copyright")
#: Log-odds of the text's features before any page is seen: long runs that end like sentences are content, links aren't.
PRIOR = (-0.6, 1.0, 0.8, -4.0, 0.6, 0.4, -0.4, -3.0)
#: Precision of the prior: how many blocks it counts for.
PRIOR_BLOCKS = 50.0
TRAIN_PAGES, TRAIN_CHARS = 500, 100_000


def features(b: Block) -> tuple[float, ...]:
    tag = b.home.tag
    return (1.0, min(b.words, 40) / 20, float(b.text[-1] in ".!?…。\"”»"), min(1.0, b.links / len(b.text)), float(tag == "p"), float(tag in HEADINGS), float(tag == "li"), float("©" in b.text[:40]))


def against(e: Element) -> bool:
    return e.away or e.state[0] is not None


def context(b: Block) -> float:
    if b.home.away:
        return CONTEXT["away"]
    mark, held = b.home.state
    if mark is not None:
        return CONTEXT["mark"]
    return CONTEXT["home"] * held + CONTEXT["good"] * b.home.good


def score(b: Block, weights: Sequence[float] = PRIOR) -> float:
    """The block's log-odds of being content."""
    said = sum(w * x for w, x in zip(weights, features(b), strict=True))
    return min(max(said, -TEXT_BOUND), TEXT_BOUND) + context(b)


def learn(pages: Iterable[str]) -> tuple[float, ...]:
    """Weights of FEATURES from the blocks of pages: the mode of a logistic regression with a Gaussian prior at PRIOR, both
    kinds of blocks with equal weight in all."""
    rows, kinds = [], []
    for html in pages:
        bs = blocks(html)
        settle(bs)
        for b in bs:
            if against(b.home) or b.home.state[1]:
                rows.append(features(b))
                kinds.append(not against(b.home))
    x, y, prior = np.array(rows).reshape(-1, len(PRIOR)), np.array(kinds, bool), np.array(PRIOR)
    if not y.any() or y.all():
        return PRIOR
    share = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (y - p)) - PRIOR_BLOCKS * (w - prior)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + PRIOR_BLOCKS * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(np.round(w, 6).tolist())


#: Ties of neighbours in page order at tree distance 0, of a block to its container, and the share of both that is left
#: between an element that holds no article text and one that may: there the tree draws a line already.
NEIGHBOURS, SIBLINGS, LOOSE = 1.2, 0.5, 0.1


def edges(bs: list[Block]) -> tuple[list[tuple[int, int, float]], int]:
    """Smoothness edges; nodes from len(bs) on stand for containers."""
    out, node_of = [], {}
    above = [b.home.block.parent or b.home.block for b in bs]
    for i in range(len(bs) - 1):
        x, y = above[i], above[i + 1]
        steps = 0
        while x is not y and steps < 6:
            if x.depth >= y.depth:
                x = x.parent
            else:
                y = y.parent
            steps += 1
        out.append((i, i + 1, NEIGHBOURS / (1 + steps) * (LOOSE if against(bs[i].home) != against(bs[i + 1].home) else 1)))
    for i, e in enumerate(above):
        if id(e) not in node_of:
            node_of[id(e)] = len(bs) + len(node_of)
        out.append((i, node_of[id(e)], SIBLINGS * (LOOSE if against(bs[i].home) else 1)))
    return out, len(node_of)


def minimum_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of |score| of nodes labelled against their score and of cut ties; True: content."""
    near: list[dict[int, float]] = [{} for _ in scores]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    reached = _max_flow(scores, near)
    return [v in reached for v in range(len(scores))]


def _max_flow(s: list[float], near: list[dict[int, float]]) -> set[int]:
    """The source's side after max-flow by shortest augmenting paths in layers."""
    source, sink = len(s), len(s) + 1
    cap: list[dict[int, float]] = [dict(n) for n in near] + [{}, {}]
    for v, x in enumerate(s):
        if x > 0:
            cap[source][v], cap[v][source] = x, 0.0
        elif x < 0:
            cap[v][sink], cap[sink][v] = -x, 0.0
    tiny = 1e-9
    while True:
        level, queue = {source: 0}, [source]
        for v in queue:  # grows while it is read
            below = level[v] + 1
            for u, c in cap[v].items():
                if c > tiny and u not in level:
                    level[u] = below
                    queue.append(u)
            if sink in level:
                break
        if sink not in level:
            return level.keys() - {source}
        todo: dict[int, list[int]] = {}
        path = [source]
        while path:
            v = path[-1]
            if v == sink:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                full = len(path)
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    cap[a][b] -= push
                    cap[b][a] += push
                    if cap[a][b] <= tiny and full > k:
                        full = k
                del path[full + 1 :]  # go on before the first full edge
                continue
            if v not in todo:
                todo[v] = [u for u in cap[v] if level.get(u) == level[v] + 1]
            own = todo[v]
            while own:
                if cap[v][own[-1]] > tiny:
                    path.append(own[-1])
                    break
                own.pop()
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()


def labels(bs: list[Block], weights: Sequence[float] = PRIOR) -> list[bool]:
    """Whether each block is content."""
    settle(bs)
    ties, extra = edges(bs)
    scores = [score(b, weights) for b in bs]
    found = minimum_cut(scores + [0.0] * extra, ties)[: len(bs)]
    free = [not b.home.away and b.home.mark is None for b in bs]
    if any(found) or not any(free):
        return found
    # nothing but short blocks: what no element speaks against is likelier than usual
    return minimum_cut([x + ALONE if f else x for f, x in zip(free, scores)] + [0.0] * extra, ties)[: len(bs)]


def main_text(html: str | None, weights: Sequence[float] = PRIOR) -> str:
    bs = blocks(html) if html else []
    return "\n".join(b.text for b, keep in zip(bs, labels(bs, weights)) if keep)


def sample(pages: DataFrame, html: str = "html") -> list[str]:
    """At most TRAIN_PAGES pages of at most TRAIN_CHARS characters: pages are dealt to as many buckets by the hash of their
    html, and the least hash of each bucket is taken, so the minima are summed before any shuffle."""
    rows = pages.where(F.length(html).between(1, TRAIN_CHARS)).select(F.xxhash64(F.col(html)).alias("_mark"), F.col(html).alias("_html"))
    least = rows.groupBy(F.pmod("_mark", F.lit(TRAIN_PAGES)).alias("_b")).agg(F.min("_mark").alias("_mark")).select("_mark")
    return [r[0] for r in rows.join(F.broadcast(least), "_mark").groupBy("_mark").agg(F.first("_html").alias("_html")).orderBy("_mark").select("_html").collect()]


def extract(pages: DataFrame, html: str = "html", weights: Sequence[float] | None = None) -> DataFrame:
    """pages with text and n_chars, the code points of the text. weights: of FEATURES, by default learned from pages."""
    text_batches(pages.sparkSession)
    own = learn(sample(pages, html)) if weights is None else tuple(weights)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), own) for x in column], pa.string())

    return pages.withColumn("text", text(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))
