"""Main text of web pages by a tree-structured graphical model.

Each element of a page is a node with one of three states: boilerplate, content, or container (an element around content that
isn't content itself). A node's features give its states potentials; a parent's and a child's state share a potential. One
pass of sum-product messages up the tree and one down give each node's exact marginals, for all pages of a batch at once,
level by level.

The potentials are trained on pages whose own markup labels their elements: they climb the likelihood of the labels,
whose gradient is the counts seen less the counts that the marginals expect, from hand-set first values to which a
ridge ties them. Three quarters of the pages lose the labelling element names, the classes or all names before, and half get
their footers moved into the article, so that the model learns to tell content by what elements hold and where they stand. Potentials of features that the sample
lacks keep their first values.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOILERPLATE, CONTENT, CONTAINER = range(3)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
MARKS = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
DROPPED = frozenset("script style template noscript title textarea select option iframe object svg math canvas audio video".split())
#: Of these the text up to the end tag isn't markup.
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr img br input button".split())
#: Inline elements that are nodes even without a class: their text is none of the sentence around them.
CONTROLS = frozenset("button label".split())
#: A start tag of the key closes an open element of the value, up to the nearest of BARRIER.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = frozenset("html body article section main div nav aside footer header table ul ol dl form blockquote".split())
#: Words in class, id and role that speak for boilerplate and for content. Priors; the counts of a corpus add to them.
AGAINST = frozenset("ad ads advert advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments discussion reply replies respond pagination pager toolbar tags copyright legal disclaimer form contentinfo complementary".split())
FOR = frozenset("article content post entry story main body text articlebody maincontent prose".split())
TAG_PRIOR = {
    **dict.fromkeys("nav footer aside form menu dialog fieldset button label".split(), (60.0, 0.02, 0.02)),
    "header": (40.0, 3.0, 0.3),
    "address": (4.0, 1.0, 0.5),
    **dict.fromkeys("article main".split(), (0.5, 60.0, 4.0)),
    **dict.fromkeys("html body".split(), (0.02, 0.5, 60.0)),
    "head": (60.0, 0.02, 0.02),
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split(), (40.0, 15.0, 0.1)),
    **dict.fromkeys("ul ol li dl dt dd table tr td th span a".split(), (8.0, 30.0, 0.3)),
}
LABELLING = {"article": CONTENT, "main": CONTENT, **dict.fromkeys("nav footer aside form menu dialog fieldset button label head".split(), BOILERPLATE)}
FEW = 20
OWN, ALL, LINKS = np.array([1, 25, 80, 200]), np.array([1, 25, 80, 200, 800]), np.array([0.01, 0.34, 0.67])


class Page:
    """Elements in page order, each with its parent, and pieces of text: (element, block, text)."""

    __slots__ = ("parent", "tag", "mark", "own", "linked", "depth", "pieces")

    @property
    def place(self) -> list[int]:
        """0: the page has no article or main element that counts as its main text; 1: in such, or around it; 2: outside of it."""
        roots = [LABELLING.get(t) == CONTENT and m != 1 for t, m in zip(self.tag, self.mark)]
        if not any(roots):
            return [0] * len(roots)
        bad, inside, around = [False] * len(roots), [False] * len(roots), [False] * len(roots)
        for i in range(1, len(roots)):
            above = self.parent[i]
            bad[i] = bad[above] or LABELLING.get(self.tag[i]) == BOILERPLATE or self.mark[i] == 1
            inside[i] = inside[above] or roots[i] and not bad[i]
        if not any(inside):
            return [0] * len(roots)
        for i in range(len(roots) - 1, 0, -1):
            around[self.parent[i]] |= inside[i] or around[i]
        return [1 if a or b else 2 for a, b in zip(inside, around)]

    def __init__(self, html: str):
        self.parent, self.tag, self.mark, self.own, self.linked, self.depth = [-1], ["#page"], [0], [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []
        stack: list[tuple[str, int, bool, bool]] = [("#page", 0, False, False)]  # tag, element, dropped, in a link
        block, at, n = 0, 0, len(html)
        while at < n:
            m = TOKEN.search(html, at)
            end = m.start() if m else n
            if end > at and not stack[-1][2]:
                text = html[at:end]
                if "&" in text:
                    text = html_lib.unescape(text)
                node, size = stack[-1][1], len(text.strip())
                self.own[node] += size
                self.linked[node] += size * stack[-1][3]
                self.pieces.append((node, block, text))
            if not m:
                break
            at = m.end()
            if not m[2] or not m[4]:
                continue
            tag = m[2].lower()
            inline = tag in INLINE
            if m[1]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if inline and stack[i][0] in BARRIER:
                        break
                block += not inline
                continue
            if tag == "br":
                self.pieces.append((stack[-1][1], block, " "))
                continue
            block += not inline
            closes = CLOSES.get(tag) or (() if inline else ("p",))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in BARRIER:
                    break
            mark = self.marks(m[3]) if "=" in m[3] else None
            _, parent, dropped, link = stack[-1]
            node = parent
            if not inline or mark is not None or tag in CONTROLS:
                node = len(self.parent)
                self.parent.append(parent)
                self.tag.append(tag)
                self.mark.append(mark or 0)
                self.own.append(0)
                self.linked.append(0)
                self.depth.append(self.depth[parent] + 1)
            if tag in VOID or m[3].endswith("/") and tag not in BARRIER and tag not in RAW and tag != "p":
                continue
            dropped |= tag in DROPPED
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(html, at)
                at = close.end() if close else n
                continue
            stack.append((tag, node, dropped, link or tag == "a"))

    @staticmethod
    def marks(attributes: str) -> int | None:
        """0: has a class, id or role that says nothing; 1: against; 2: for; None: has none."""
        found = [a or b or c for a, b, c in MARKS.findall(attributes)]
        if not found:
            return None
        parts = set(PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(found)).lower()))
        against, speaks_for = bool(parts & AGAINST), bool(parts & FOR)
        return 0 if against == speaks_for else 1 if against else 2


class Forest:
    """The elements of many pages in flat arrays."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.first = np.cumsum(sizes) - sizes
        flat = lambda name: [x for p in pages for x in getattr(p, name)]
        self.parent = np.array(flat("parent"), np.int64) + np.repeat(self.first, sizes)
        self.tag, self.mark, self.place = flat("tag"), np.array(flat("mark"), np.int64), np.array(flat("place"), np.int64)
        self.depth = np.array(flat("depth"), np.int64)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if len(order) else []
        self.own = np.array(flat("own"), np.int64)
        self.all, linked = self.own.astype(float), np.array(flat("linked"), float)
        for level in self.levels[:0:-1]:
            np.add.at(self.all, self.parent[level], self.all[level])
            np.add.at(linked, self.parent[level], linked[level])
        self.links = linked / np.maximum(self.all, 1)

    def features(self, tags: dict[str, int]) -> np.ndarray:
        tag = np.array([tags.get(t, 0) for t in self.tag], np.int64)
        return np.column_stack([tag, self.mark, np.searchsorted(OWN, self.own, "right"), np.searchsorted(ALL, self.all, "right"), np.searchsorted(LINKS, self.links, "right"), self.place])


class Model:
    """log potentials: tables[i][value, state] of feature i, and step[parent's state, state]."""

    def __init__(self, tags: dict[str, int], tables: list[np.ndarray], step: np.ndarray, first: Model | None = None):
        self.tags, self.tables, self.step, self.first = tags, tables, step, first

    def beliefs(self, forest: Forest, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By one upward and one downward pass of messages, the marginal of each element's state, and the expected number of
        (parent's state, state) over all elements with a parent."""
        inside = sum(t[f[:, i]] for i, t in enumerate(self.tables))
        message = np.zeros_like(inside)
        for level in forest.levels[:0:-1]:
            message[level] = np.logaddexp.reduce(inside[level][:, None, :] + self.step, axis=2)
            np.add.at(inside, forest.parent[level], message[level])
        outside = np.zeros_like(inside)
        steps = np.zeros((3, 3))
        if forest.levels:
            outside[forest.levels[0]] = np.log([0.05, 0.25, 0.7])
        for level in forest.levels[1:]:
            above = forest.parent[level]
            rest = (inside[above] - message[level] + outside[above])[:, :, None] + self.step
            outside[level] = np.logaddexp.reduce(rest, axis=1)
            both = rest + inside[level][:, None, :]
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            steps += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        belief = inside + outside
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True)), steps

    def marginals(self, forest: Forest) -> np.ndarray:
        """The probability of each state for each element."""
        return self.beliefs(forest, forest.features(self.tags))[0]

    def texts(self, sources: list[str | None]) -> list[str]:
        """The main text of each page: blocks in page order, white space as one space, two line ends between blocks."""
        pages = [Page(s or "") for s in sources]
        out = self.kept_texts(pages)
        if self.first is not None:
            # A page of prose isn't empty: what training leaves nothing of is read by the first potentials.
            empty = [i for i, t in enumerate(out) if not t and pages[i].pieces]
            for i, t in zip(empty, self.first.kept_texts([pages[i] for i in empty])):
                out[i] = t
        return out

    def kept_texts(self, pages: list[Page]) -> list[str]:
        """The text of each page's elements that are content rather than not."""
        if not pages:
            return []
        forest = Forest(pages)
        content = self.marginals(forest)[:, CONTENT] >= 0.5
        out = []
        for page, first in zip(pages, forest.first.tolist()):
            blocks: dict[int, list[str]] = {}
            keep = content[first : first + len(page.parent)].tolist()
            for node, block, text in page.pieces:
                if keep[node]:
                    blocks.setdefault(block, []).append(text)
            out.append("\n\n".join(t for b in blocks.values() if (t := " ".join("".join(b).split()))))
        return out


def labelled_states(page: Page) -> list[int] | None:
    """States as the page's own markup says, or None for a page without an article or main element."""
    state = [CONTAINER] * len(page.parent)
    if not any(LABELLING.get(t) == CONTENT for t in page.tag):
        return None
    holds = [False] * len(page.parent)
    for i in range(len(page.parent) - 1, 0, -1):
        holds[i] |= LABELLING.get(page.tag[i]) == CONTENT
        holds[page.parent[i]] |= holds[i]
    for i in range(1, len(page.parent)):
        above, own = state[page.parent[i]], LABELLING.get(page.tag[i])
        if above == BOILERPLATE or own == BOILERPLATE or page.mark[i] == 1:
            state[i] = BOILERPLATE
        elif above == CONTENT or own == CONTENT:
            state[i] = CONTENT
        else:
            state[i] = CONTAINER if holds[i] else BOILERPLATE
    return state


def first_model(tags: dict[str, int]) -> Model:
    """Hand-set potentials, from which training starts."""
    tables = [np.full((len(tags) + 1, 3), 1.0), np.ones((3, 3)), np.ones((len(OWN) + 1, 3)), np.ones((len(ALL) + 1, 3)), np.ones((len(LINKS) + 1, 3)), np.ones((3, 3))]
    tables[0][0] = 3.0
    tables[0][tags["div"]] = tables[0][tags["section"]] = (20.0, 20.0, 20.0)
    for t, p in TAG_PRIOR.items():
        tables[0][tags[t]] = p
    tables[1][:] = [[30.0, 80.0, 80.0], [80.0, 0.02, 0.02], [1.0, 10.0, 4.0]]
    tables[2][:] = [[30, 40, 60], [20, 15, 1], [15, 20, 0.5], [10, 20, 0.3], [8, 20, 0.3]]
    tables[3][:] = [[10, 4, 0.5], [15, 6, 1], [20, 8, 2], [20, 12, 4], [15, 20, 12], [8, 20, 40]]
    tables[4][:] = [[25, 60, 30], [8, 10, 20], [12, 1, 6], [35, 0.5, 1]]
    tables[5][:] = [[30, 30, 30], [30, 60, 60], [40, 1, 1]]
    step = np.array([[80.0, 0.05, 0.05], [3.0, 100.0, 0.1], [30.0, 15.0, 20.0]])
    return Model(tags, [np.log(t / t.sum(axis=0)) for t in tables], np.log(step / step.sum(axis=1, keepdims=True)))


def stripped(page: Page, way: int) -> Page:
    """The page as it is (0), without labelling element names (1), without classes (2), or with neither these nor any names (3)."""
    if way == 1:
        page.tag = ["div" if t in LABELLING and t != "head" else t for t in page.tag]
    if way == 3:
        page.tag = [t if t in ("#page", "html", "head", "body") else "div" for t in page.tag]
    if way > 1:
        page.mark = [0] * len(page.mark)
    return page


def grafted(page: Page) -> Page:
    """The page with a footer or the like that follows the article moved into it: some sites put them there."""
    roots = [i for i, t in enumerate(page.tag) if LABELLING.get(t) == CONTENT]
    for i in range(len(page.tag) - 1, 0, -1):
        if LABELLING.get(page.tag[i]) == BOILERPLATE and roots and roots[0] < i and LABELLING.get(page.tag[page.parent[i]]) is None:
            page.parent[i] = roots[0]
    for i in range(1, len(page.depth)):
        page.depth[i] = page.depth[page.parent[i]] + 1
    return page


def thinned(page: Page, state: list[int], way: int) -> tuple[Page, list[int]]:
    """The page as it is (0), without the element around the article, whose blocks then stand beside others (1), with no more of the article
    than its first heading and its first paragraph or other block (2), or both (3): many pages have short articles, and many no element around them."""
    article = [LABELLING.get(t) == CONTENT and s == CONTENT for t, s in zip(page.tag, state)]
    unwrap, short = way % 2 == 1, way >= 2
    gone, cut, heads, blocks = set(), set(), set(), set()
    for i in range(1, len(page.tag)):
        above = page.parent[i]
        if above in cut:
            cut.add(i)
        elif short and article[above] and state[i] == CONTENT and not article[i]:
            seen = heads if re.fullmatch("h[1-6]", page.tag[i]) else blocks
            if above in seen:
                cut.add(i)
            seen.add(above)
        if unwrap and article[i]:
            gone.add(i)
    gone |= cut
    if not gone:
        return page, state
    kept = [i for i in range(len(page.tag)) if i not in gone]
    number = {i: n for n, i in enumerate(kept)}

    def parent(i: int) -> int:
        while i in gone:
            i = page.parent[i]
        return number.get(i, -1)

    page.parent = [parent(page.parent[i]) for i in kept]
    for name in ("tag", "mark", "own", "linked"):
        setattr(page, name, [getattr(page, name)[i] for i in kept])
    page.depth = [0] * len(kept)
    for n in range(1, len(kept)):
        page.depth[n] = page.depth[page.parent[n]] + 1
    return page, [state[i] for i in kept]


def train(sources: list[str], ridge: float = 0.3, step_ridge: float = 1.0, rounds: int = 60, rate: float = 0.2) -> Model:
    """Potentials that fit the labels of the pages which have some: the mean log likelihood of a page, less `ridge` / 2 times the
    squared distance from the first potentials, climbed in `rounds` steps with a rate for each potential (Adam).

    The mean and the ridge don't depend on the number of pages, so a middling and a large sample of the same kind train
    alike; against a sample of a few pages, FEW others count as if the first potentials fitted them.
    """
    known = [(p, s) for i, p in enumerate(Page(s) for s in sources if s) if (s := labelled_states(grafted(p) if i // 4 % 2 else p))]
    # Without any names short blocks of an article are like those of a menu.
    known = [thinned(p, s, i // 8 % 4 if i % 4 < 3 else 0) for i, (p, s) in enumerate(known)]
    known = [(stripped(p, i % 4), s) for i, (p, s) in enumerate(known)]
    names = sorted({*TAG_PRIOR, "div", "section"} | {t for p, _ in known for t in p.tag})
    tags = {t: i + 1 for i, t in enumerate(names)}  # 0: any other element
    model = first_model(tags)
    model.first = first_model(tags)
    if not known:
        return model
    forest, state = Forest([p for p, _ in known]), np.array([x for _, s in known for x in s])
    f, below = forest.features(model.tags), np.flatnonzero(forest.depth > 0)
    seen_step = np.zeros((3, 3))
    np.add.at(seen_step, (state[forest.parent[below]], state[below]), 1)
    shown = np.eye(3)[state]
    values = [*model.tables, model.step]
    start, mean, square = [v.copy() for v in values], [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for n in range(1, rounds + 1):
        belief, steps = model.beliefs(forest, f)
        miss = (shown - belief)[below]
        for i, v in enumerate(values):
            if i < len(model.tables):
                climb = np.zeros_like(v)
                np.add.at(climb, f[below, i], miss)
            else:
                climb = seen_step - steps
            climb = climb / (len(known) + FEW) - (ridge if i < len(model.tables) else step_ridge) * (v - start[i])
            mean[i] = 0.9 * mean[i] + 0.1 * climb
            square[i] = 0.99 * square[i] + 0.01 * climb**2
            v += rate * (1 - n / (rounds + 1)) * (mean[i] / (1 - 0.9**n)) / (np.sqrt(square[i] / (1 - 0.99**n)) + 1e-4)
    return model


def fitted(pages: DataFrame, max_pages: int = 1000, max_chars: int = 100_000) -> Model:
    """train() on at most max_pages pages of at most max_chars characters, those of the smallest hash of the id; of pages that
    share an id, the least. So no more than max_pages * max_chars characters reach the driver."""
    short = pages.filter(F.col("page_id").isNotNull() & (F.length("html") <= max_chars)).select("page_id", "html")
    ids = short.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    sample = short.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))  # max_pages ids at most
    return train([r["html"] for r in sample.orderBy("page_id").collect()])


def extract(pages: DataFrame, max_pages: int = 1000) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Null and empty html give empty text. Broken markup is read as far as it goes. Repeated rows and null ids are kept as they are.
    An empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fitted(pages, max_pages))  # some kB, whatever the data

    def run(batches):
        for b in batches:
            part = b["html"].str.len().fillna(0).cumsum() // 1_000_000
            for _, rows in b.groupby(part, sort=True):
                text = shared.value.texts([h if isinstance(h, str) else "" for h in rows["html"]])
                yield pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
