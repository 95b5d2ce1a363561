"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tags and text blocks. Words score by the elements around them and tags by their names, with
weights learned from labelled pages: those that mark their article themselves (an article or main element); of these at most
about `max_train_pages`, chosen by a hash, are counted. A key's weight is the log-odds of its words lying inside
the article, under a prior (pseudo-counts) that knows the usual names of page furniture; a tag's weight is that of its
occurrences and never positive. Names say nothing against what they hold on elements that are the page's frame: html, body, a
form around most of the page, the article itself and all that holds it. One linear scan finds the contiguous region of the highest score; its blocks of positive weight are the
text, so furniture inside the article goes as well.

A page that marks no article is scanned twice: furniture inside the container of its best region (an element named as content,
else the innermost element around the region) then costs nothing, so text behind an advert is not lost.

Defined cases: a null or empty page has the empty text; a page without a positive block too; unclosed, misnested and cut-off
markup is read as far as it goes (an unfinished tag at the end is markup, an unfinished reference is text); very long and
very deep pages are read whole, in time and memory in proportion to their length; of regions with equal scores the first is taken; repeated rows
give repeated rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: comments, declarations, elements whose content is not text, and tags (quoted attribute values may hold ">")
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(script|style|noscript|template|title|svg|math|iframe|object|select|textarea|button|canvas|audio|video)(?=[\s/>]).*?(?:</\1\s*>|\Z)
    |<(/?)([a-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z)""", re.S | re.I | re.X)
NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: a new one of these ends an open one
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
BARRIERS = ("table", "ul", "ol", "div", "article", "section")
#: elements that hold one block of text as a rule
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th figcaption".split())
#: prior: usual names of page furniture, and of articles
FURNITURE = frozenset("""nav menu navigation header footer sidebar aside ad ads advert advertisement advertising banner sponsor sponsored promo promotion
    cookie cookies consent notice notices alert popup modal overlay comment comments reply replies respond disqus form newsletter subscribe signup login search share sharing social
    related recommended breadcrumb breadcrumbs pagination pager toolbar widget copyright masthead toc""".split())
ARTICLE = frozenset("article main articlebody".split())
CONTENT = frozenset("article main articlebody content post entry story".split())
PRIOR_WORDS = 40.0
#: weight of a name that only the prior knows
PRIOR_WEIGHT = math.log(PRIOR_WORDS + 1)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def element_keys(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name and the words of its class, id and role. Names of html and body are the page's, and a heading's id
    is an anchor made of its words: neither counts."""
    keys = [name]
    if "=" in attributes and name not in ("html", "body"):
        for m in NAMED.finditer(attributes):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind == "id" and name in HEADINGS:
                continue
            if (kind, value.lower()) in (("role", "main"), ("itemprop", "articlebody")):
                keys.append("articlebody")
            keys += [x.lower() for x in PART.findall(value)]
    return tuple(dict.fromkeys(keys))


@dataclass
class Page:
    """A page as items in its order, each with the innermost element around it (-1: none): ("tag", name) and ("block", text);
    and its elements in the order of their tags, each with its parent, so a parent comes before what it holds."""
    items: list[tuple[str, str, int]] = field(default_factory=list)
    keys: list[tuple[str, ...]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)


def parse(page: str) -> Page:
    """The page's items and elements; time and memory in proportion to its length, however deep it is nested."""
    got, stack, text, end = Page(), [], [], 0
    at_name = defaultdict(list)  # places in the stack of the open elements of a name
    held = []  # (place in the stack, element, text so far) of blocks that inline furniture interrupts

    def inner():
        return stack[-1] if stack else -1

    def emit(parts, element):
        block = " ".join(html.unescape("".join(parts)).split())
        if block:
            got.items.append(("block", block, element))
        parts.clear()

    def flush():
        for _, element, parts in held:
            emit(parts, element)
        held.clear()
        emit(text, inner())

    def push(keys):
        at_name[keys[0]].append(len(stack))
        got.keys.append(keys)
        got.parent.append(inner())
        stack.append(len(got.keys) - 1)

    def cut(at):
        while len(stack) > at:
            at_name[got.keys[stack.pop()][0]].pop()

    def place(*names):
        return max((at_name[x][-1] for x in names if at_name.get(x)), default=-1)

    for m in MARKUP.finditer(page):
        if m.start() > end:
            text.append(page[end: m.start()])
        end = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if name == "br":
            text.append(" ")
        if name in INLINE or name == "br":
            got.items.append(("tag", name, inner()))
            # inline elements are part of their block, but for named furniture (and what it holds of the same name)
            at = place(name)
            if m[2] and at >= 0:
                while held and held[-1][0] > at:  # what it held and left open ends with it
                    _, element, parts = held.pop()
                    emit(parts, element)
                emit(text, inner())
                cut(at)
                if held and held[-1][0] == at:
                    text = held.pop()[2]
                    text.append(" ")
            elif not m[2] and name not in VOID and name != "br":
                keys = element_keys(name, m[4])
                if at >= 0 or not FURNITURE.isdisjoint(keys):
                    held.append((len(stack), inner(), text))
                    text = []
                    push(keys)
            continue
        flush()
        got.items.append(("tag", name, inner()))
        if m[2]:
            if (at := place(name)) >= 0:
                cut(at)
            continue
        ends = SELF_ENDING.get(name)
        if ends and (at := place(*ends)) > place(*BARRIERS):
            cut(at)
        if name not in VOID:
            push(element_keys(name, m[4]))
    if end < len(page):
        text.append(page[end:])
    flush()
    return got


def marks(keys: tuple[str, ...], names: frozenset = ARTICLE) -> bool:
    """Whether an element marks an article: by its tag, role or itemprop, or by such a name without one of furniture."""
    return not names.isdisjoint(keys) and (keys[0] in ("article", "main") or "articlebody" in keys or FURNITURE.isdisjoint(keys))


def is_furniture(keys: tuple[str, ...]) -> bool:
    return not FURNITURE.isdisjoint(keys)


class Frame:
    """What the elements of a page say about what they hold. The page's own articles are the marked elements with the fewest
    names of furniture around them, unless an element named as content elsewhere has fewer: then (or without any marked
    element) such elements are its containers. Names of the elements around either (and of a form around most of the page)
    say nothing against what they hold. Every rule is one pass down the elements."""

    def __init__(self, page: Page):
        self.page = page
        words = [0] * len(page.keys)
        for kind, what, e in page.items:
            if kind == "block" and e >= 0:
                words[e] += what.count(" ") + 1
        total = sum(what.count(" ") + 1 for kind, what, _ in page.items if kind == "block")
        for e in range(len(words) - 1, -1, -1):
            if page.parent[e] >= 0:
                words[page.parent[e]] += words[e]
        self.framed = {e for e, k in enumerate(page.keys) if k[0] == "form" and 2 * words[e] > total}
        few, own, holders = self._least(ARTICLE)
        self.own, self.named = own, set()
        if few != 0:
            other, found, others = self._least(CONTENT, own | holders)
            if few is None or (other is not None and other < few):
                self.own, self.named, holders = set(), found, others
        self.framed |= holders
        #: the outermost own article, and named container, of an element (or it itself); -1: none
        self.article, self.container = self._outermost(self.own), self._outermost(self.named)
        #: whether furniture holds what an element holds: inside the page's own article only names below it count
        self.furniture = []
        for e, k in enumerate(page.keys):
            up = page.parent[e]
            self.furniture.append(self.article[e] != e and (up >= 0 and self.furniture[up] or e not in self.framed and is_furniture(k)))

    def _outermost(self, those: set[int]) -> list[int]:
        got = []
        for e, up in enumerate(self.page.parent):
            got.append(got[up] if up >= 0 and got[up] >= 0 else e if e in those else -1)
        return got

    def _least(self, names: frozenset, skip: frozenset | set = frozenset()) -> tuple[int | None, set[int], set[int]]:
        """Elements marked by the names, of those with blocks the ones with the fewest names of furniture around them:
        that number (None: no such element), they, and all that holds them. Marked elements of skip hide what they hold."""
        keys, parent = self.page.keys, self.page.parent
        first, hidden, barred, around = [], [], [], []
        for e, k in enumerate(keys):
            up = parent[e]
            hidden.append(up >= 0 and hidden[up] or e in skip and marks(k))
            first.append(first[up] if up >= 0 and first[up] >= 0 else e if e not in skip and marks(k, names) else -1)
            # strictly around it: aside, nav, footer and the like are no frame by their tag
            barred.append(up >= 0 and (barred[up] or keys[up][0] in FURNITURE and keys[up][0] != "form"))
            around.append(0 if up < 0 else around[up] + (up not in self.framed and is_furniture(keys[up])))
        found = {first[e] for kind, _, e in self.page.items if kind == "block" and e >= 0 and not hidden[e] and first[e] >= 0 and not barred[first[e]]}
        few = min((around[j] for j in found), default=None)
        found = {j for j in found if around[j] == few}
        holders = set()
        for j in found:
            up = parent[j]
            while up >= 0 and up not in holders:
                holders.add(up)
                up = parent[up]
        return few, found, holders

    def in_article(self, e: int) -> bool:
        return e >= 0 and self.article[e] >= 0

    def in_furniture(self, e: int) -> bool:
        return e >= 0 and self.furniture[e]


def count_page(text: str) -> Counter:
    """(kind, key, inside) counts of a page that marks its article; empty for other pages. A block's words count once for
    each key around it: they are summed up the elements, and a key counts where it is outermost."""
    page = parse(text)
    frame = Frame(page)
    inside = [kind == "block" and frame.in_article(e) and not frame.in_furniture(e) for kind, _, e in page.items]
    if not any(inside):
        return Counter()
    first, last, got = inside.index(True), len(inside) - 1 - inside[::-1].index(True), Counter()
    # words inside, outside, and of known furniture: that explains what it holds, plain containers around are not blamed
    sums = [[0, 0, 0] for _ in page.keys]
    for i, (kind, what, e) in enumerate(page.items):
        explained = frame.in_furniture(e)
        if kind == "tag":
            if not explained:
                got["tag", what, first <= i <= last] += 1
        elif e >= 0:
            sums[e][2 if explained else 0 if inside[i] else 1] += what.count(" ") + 1
    for e in range(len(sums) - 1, -1, -1):
        up = page.parent[e]
        if up >= 0:
            sums[up][0] += sums[e][0]
            sums[up][1] += sums[e][1]
            # names of furniture around the article hold its words, and do not explain furniture inside it
            if frame.article[e] != e:
                sums[up][2] += sums[e][2]

    def names(e):  # the article's own names do not count below it
        return [*page.keys[e], *((frame.article[e], k) for k in page.keys[e] if frame.article[e] != e)]

    path, seen = [], Counter()
    for e, keys in enumerate(page.keys):
        while path and path[-1] != page.parent[e]:
            seen.subtract(names(path.pop()))
        for k in keys:
            if not seen[k]:
                got["word", k, True] += sums[e][0]
                got["word", k, False] += sums[e][1]
            if k in FURNITURE and frame.article[e] != e and not seen[frame.article[e], k]:
                got["word", k, False] += sums[e][2]
        seen.update(names(e))
        path.append(e)
    return +got


def best_region(score: list[float]) -> tuple[int, int]:
    """First and past-last index of the contiguous run of the highest positive sum, by one scan; of equal ones the first."""
    best, top, start, run = (0, 0), 0.0, 0, 0.0
    for i, s in enumerate(score):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > top:
            top, best = run, (start, i + 1)
    return best


@dataclass
class RegionModel:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word_weights(self, frame: Frame) -> list[float]:
        """For each element, the weight of the words that it holds directly."""
        good, bad, weight = [], [], []
        for e, keys in enumerate(frame.page.keys):
            up = frame.page.parent[e]
            g, b = (good[up], bad[up]) if up >= 0 else (0.0, 0.0)
            framed = e in frame.framed or e in frame.own
            for key in keys:
                if key == "header" and frame.in_article(up):
                    continue  # an article's own head
                w = self.words.get(key)
                if w is None:
                    w = -PRIOR_WEIGHT if key in FURNITURE else PRIOR_WEIGHT if key in CONTENT else 0.0
                if w > 0:
                    g = max(g, w)
                elif not framed:
                    b = min(b, w)
            good.append(g)
            bad.append(b)
            # strong evidence against (furniture) outweighs whatever holds it; weak evidence does not outweigh strong evidence for
            weight.append(b if b <= -3.0 or g + b < 0 else max(g + b, 0.1))
        return weight

    def extract(self, text: str) -> str:
        page = parse(text)
        frame = Frame(page)
        weight = self.word_weights(frame)
        score, kept = [], []
        for kind, what, e in page.items:
            marked = frame.in_article(e)
            if kind == "tag":
                score.append(-0.05 if marked else self.tags.get(what, -0.5))
                kept.append(None)
            else:
                w = weight[e] if e >= 0 else 0.1
                # furniture between parts of the text goes, but its length does not cut the text in two: inside a marked
                # article it costs nothing, elsewhere little
                score.append((w if w > 0 else 0.0 if marked else 0.25 * w) * (what.count(" ") + 1))
                kept.append(what if w > 0 else None)
        lo, hi = best_region(score)
        if not frame.own:
            lo, hi = best_region(self._within(page, frame, weight, score, self._container(page, frame, [e for k, (_, _, e) in zip(kept[lo:hi], page.items[lo:hi]) if k])))
        return "\n".join(b for b in kept[lo:hi] if b)

    def _container(self, page: Page, frame: Frame, of: list[int]) -> int:
        """The element that holds a region of a page that marks no article: its named container, else the innermost one around
        all its blocks, for a lone paragraph or the like the element around that; -1: none but the page."""
        if not of or min(of) < 0:
            return -1
        if frame.container[of[0]] >= 0:
            return frame.container[of[0]]
        holds, e = [0] * len(page.keys), 0
        for x in of:
            holds[x] += 1
        for e in range(len(holds) - 1, -1, -1):  # what it holds was added up before
            if holds[e] == len(of):
                break
            if page.parent[e] >= 0:
                holds[page.parent[e]] += holds[e]
        else:
            return -1
        return page.parent[e] if page.keys[e][0] in LEAVES else e

    def _within(self, page: Page, frame: Frame, weight: list[float], score: list[float], container: int) -> list[float]:
        """Scores for the second scan: furniture inside the region's container costs nothing, nor do its tags, and inside a
        named container other tags cost what they cost in a marked article."""
        if container < 0:
            return score
        named = container in frame.named
        within, against = [], []
        for e, up in enumerate(page.parent):
            within.append(e == container or up >= 0 and within[up])
            against.append(within[e] and (up >= 0 and against[up] or weight[e] <= 0))
        got = []
        for i, (s, (kind, what, e)) in enumerate(zip(score, page.items)):
            if e >= 0 and within[e] and s < 0:
                # a tag stands before (start) or after (end) its element: its own items lie around it
                opens = kind == "tag" and i + 1 < len(page.items) and page.items[i + 1][2] > e and against[page.items[i + 1][2]]
                s = 0.0 if against[e] or opens else max(s, -0.05) if named else s
            got.append(s)
        return got


def fit_regions(pages: DataFrame, max_train_pages: int = 2_000, min_z: float = 2.0) -> RegionModel:
    """Weights from at most about max_train_pages pages. Known names, and of other keys of words all whose share inside lies min_z
    standard errors from even, are weighed; keys short of that say nothing either way."""
    n = pages.count()
    some = pages.where(F.pmod(F.xxhash64("url", "html"), F.lit(1_000_000)) < F.lit(math.ceil(1_000_000 * min(1.0, max_train_pages / n)))) if n else pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = Counter()
            for t in b.column(0):
                got.update(count_page(t.as_py() or ""))
            rows = list(got.items())
            yield pa.RecordBatch.from_arrays([pa.array([k for (k, _, _), _ in rows], pa.string()), pa.array([x for (_, x, _), _ in rows], pa.string()), pa.array([i for (_, _, i), _ in rows], pa.bool_()), pa.array([c for _, c in rows], pa.int64())],
                                             names=["kind", "name", "inside", "n"])

    side = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    rows = (some.select("html").mapInArrow(run, "kind string, name string, inside boolean, n bigint").groupBy("kind", "name")
            .agg(side(F.col("inside")).alias("a"), side(~F.col("inside")).alias("b"))
            .where((F.col("kind") == "tag") | F.col("name").isin(*sorted(FURNITURE | CONTENT)) | (F.abs(F.log((F.col("a") + 1) / (F.col("b") + 1))) >= min_z * F.sqrt(1 / (F.col("a") + 1) + 1 / (F.col("b") + 1))))
            .orderBy("kind", "name").collect())
    model = RegionModel()
    for kind in ("word", "tag"):
        mine = [r for r in rows if r["kind"] == kind]
        a0, b0 = sum(r["a"] for r in mine) or 1, sum(r["b"] for r in mine) or 1
        for r in mine:
            key = r["name"]
            if kind == "tag":
                # per occurrence: inside against outside, as shares of each side's tags
                model.tags[key] = min(-0.05, max(-1.5, math.log((r["a"] + 1) / (r["b"] + 1))))
                continue
            a, b = r["a"] + PRIOR_WORDS * (key in CONTENT), r["b"] + PRIOR_WORDS * (key in FURNITURE)
            w = math.log((a + 1) / (b + 1))
            # names that both sides use alike (html, body) say nothing
            if key in ("html", "body") or abs(w - math.log(a0 / b0)) < 0.2:
                continue
            model.words[key] = max(-6.0, min(4.0, w))
    for key in ARTICLE:
        model.words[key] = max(model.words.get(key, 3.0), 3.0)
    return model


def extract_main(pages: DataFrame, model: RegionModel) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [model.extract(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
