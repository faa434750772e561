"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Every word scores positive and every tag negative; one
linear scan finds the contiguous run with the greatest sum, and that run is the main text, but for
sections that are no text of an article (menus, adverts, forms, comments and the like) within it: such
elements, and containers of such a class or role. A name on a heading, a paragraph or within a line cuts
nothing, as it mostly is an anchor, and an id of a container does only if it names a part of the layout
or if the container has neither a headed text nor a paragraph of some length.

Weights are log odds of standing inside the article rather than outside it, counted on labelled
pages: a bounded sample of the pages that mark their own article. A word's feature is where it
stands (inside a mark, outside one, in an apart section, on a page without marks, or there in a section of such an id that stays), its element,
the length of its block and whether that is a link; a tag's is where it stands and its name.
Labelled pages are counted twice, with their marks and names and without both, so that pages
without marks are scored from the same labels.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are counted on at most.
SAMPLE = 500
#: Weights are whole numbers of this part of a unit, so that sums are exact; least and greatest word weight, greatest tag cost.
UNIT, LEAST, MOST, COST = 1_000_000, 1, 2.0, 8.0
#: Words and tags that the weights before any label count for.
PRIOR_WORDS, PRIOR_TAGS = 200, 20

# Elements of HTML.
MARKS = frozenset("article main".split())
APART = frozenset("nav footer aside form menu dialog button select textarea fieldset iframe object noscript template svg math head title script style".split())
RAW = frozenset("script style textarea title iframe noscript template xmp".split())
HEAD = frozenset("head title meta link base script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
# What sections that are no article are called. A name is meant as a whole: all its parts must be known.
NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation sidebar footer header masthead cookie cookies consent notice alert gdpr popup modal"
    " newsletter subscribe signup login disqus related share sharing social breadcrumb breadcrumbs pagination pager toolbar widget".split()
)
SITE = frozenset(
    "site page global main top bottom left right wrap wrapper container box area inner outer list links link item items buttons button section slot unit form bar icons widgets google email policy law msg".split()
)
COMMENTS = frozenset("comment comments respond disqus".split())
#: Names that parts of an article have too: within a marked one they say nothing.
OWN = frozenset("header masthead alert notice banner".split())
#: Elements that hold sections; of those names the ones that stand for a part of the layout as an id, too.
CONTAINERS = frozenset("div section article main ul ol dl li table header center".split())
LAYOUT = frozenset("nav navbar navigation sidebar footer masthead breadcrumb breadcrumbs pagination pager toolbar popup modal adsense".split())
#: Words of paragraphs from which on a section with such an id is text.
PARAGRAPH = 25
#: First parts of names that tell a state of the layout.
STATES = frozenset("has have no not with without is hide show".split())

#: Element kinds, and the weights of their words and of tags before any label is seen.
KINDS = {**dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "heading"), **dict.fromkeys("p pre blockquote figcaption".split(), "prose"), **dict.fromkeys("li dd dt".split(), "item"), **dict.fromkeys("td th caption".split(), "cell")}
WORD_PRIOR = {"heading": 0.5, "prose": 1.0, "item": 0.3, "cell": 0.3, "other": 0.2}
TAG_PRIOR = {**dict.fromkeys("div section ul ol dl table header".split(), 0.5), **dict.fromkeys("p br li dd dt tr td th h1 h2 h3 h4 h5 h6 blockquote pre a img".split(), 0.1), **dict.fromkeys(INLINE - {"a", "img"}, 0.02)}

_MARKUP = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*+)|[!?])")
_STOP = re.compile(r"=\s*+([\"'])|>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPEAKS = re.compile(r"class|id|role|itemprop", re.I)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass(slots=True)
class Block:
    """A run of text between block tags: its text and words, features of the words and of the tags since the block before."""

    text: str
    words: int
    inside: bool  # of the marked article and no apart section in it
    apart: bool
    feature: tuple
    tags: list[tuple]
    hidden: tuple = ()  # the same features with marks and names hidden
    hidden_tags: list[tuple] = field(default_factory=list)


@dataclass(slots=True)
class _Section:
    """An element apart by its name: the section around it, whether it holds comments, its first block and the one after its last, whether only its id says so."""

    parent: int
    comments: bool
    first: int
    last: int = -1
    weak: bool = False


def _names(attributes: str) -> tuple[list[str], list[str], list[str]]:
    """What class and role say, what id says, and what role and itemprop say alone."""
    names, ids, roles = [], [], []
    if attributes and _SPEAKS.search(attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            if key in ("class", "id", "role", "itemprop"):
                said = (m[2] or m[3] or m[4] or "").split()
                if key in ("class", "role"):
                    names += said
                if key == "id":
                    ids += said
                if key in ("role", "itemprop"):
                    roles += said
    return names, ids, roles


def _apart_name(name: str, marked: bool) -> str | None:
    """"comments" or "apart" for a name that sets an element apart, else None; `marked` within a marked article."""
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or parts[0] in STATES:
        return None
    last = next((p for p in reversed(parts) if p not in SITE), "")
    if last in COMMENTS:
        return "comments"
    if all(p in NAMES or p in SITE for p in parts) and any(p in NAMES and not (marked and p in OWN) for p in parts):
        return "apart"
    return None


def _section_of(element: str, names: list[str], ids: list[str], marked: bool) -> str | None:
    """"comments", "apart" or "weak" (by an id that may be an anchor) for a container whose names set it apart, else None."""
    if element not in CONTAINERS:
        return None
    said = next((x for x in (_apart_name(n, marked) for n in names) if x), None)
    for n in () if said else ids:
        kind = _apart_name(n, marked)
        if kind == "apart" and not LAYOUT.intersection(p.lower() for p in _PART.findall(n)):
            kind = None if marked else "weak"
        said = said or kind
    return said


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Where the tag that goes on at `at` ends, by its first > outside of quoted values; -1 if it is cut off by the page's end."""
    while m := _STOP.search(page, at):
        if m[1] is None:
            return m.start()
        end = -1 if m[1] in lost else page.find(m[1], m.end())
        if end < 0:
            lost.add(m[1])  # no such quote follows any more: it stands for itself
        at = m.end() if end < 0 else end + 1
    return -1


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, in time linear in its length. Misnested and cut-off markup is read as far as it goes.

    A section apart by its name that holds most of the page's words is not apart, unless it holds
    comments or the page marks an article elsewhere. No mark counts within comments or apart elements but forms.
    """
    found: list[tuple] = []  # text, element, hard, section, root, linked, tags
    sections = [_Section(-1, False, 0)]
    stack: list[tuple] = []  # element, hard, section, root
    depth: Counter = Counter()
    lost: set[str] = set()
    text: list[str] = []
    tags: list[tuple] = []  # name, hard, section, root, edge, boundary
    element, hard, section, root, roots = "", False, 0, 0, 0
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal tags, linked
        if text:
            said = " ".join("".join(text).split())
            text.clear()
            if said:
                found.append((said, element, hard, section, root, 2 * linked > len(said), tags))
                tags = []
        linked = 0

    def say(part: str) -> None:
        nonlocal linked
        if part:
            part = html.unescape(part) if "&" in part else part
            text.append(part)
            if in_link:
                linked += len(part)

    def close(i: int) -> None:
        """Close the elements of the stack from i on."""
        for name, *_ in stack[i:]:
            depth[name] -= 1
        inner = section
        del stack[i:]
        kept = stack[-1][2] if stack else 0
        while inner != kept and sections[inner].parent >= 0:
            if sections[inner].last < 0:
                sections[inner].last = len(found)
            inner = sections[inner].parent

    at, n = 0, len(page)
    while m := _MARKUP.search(page, at):
        say(page[at : m.start()])
        name = m[2]
        if name is None:
            end = page.find("-->", m.start() + 2) + 2 if page.startswith("<!--", m.start()) else page.find(">", m.end())
            at = end + 1 if end > 1 else n
            continue
        name, closing = name.lower(), m[1] == "/"
        end = _tag_end(page, m.end(), lost)
        if end < 0:
            at = n
            break
        at = end + 1
        if name == "a":
            in_link = not closing
        block = name not in INLINE
        if block:
            flush()
        if closing:
            if not depth[name]:
                tags.append((name, hard, section, root, False, False))
                continue
            i = len(stack) - 1
            while stack[i][0] != name:
                i -= 1
            before = stack[i - 1] if i else ("", False, 0, 0)
            tags.append((name, stack[i][1], stack[i][2], root, stack[i][3] != before[3], stack[i][1] != before[1] or stack[i][2] != before[2]))
            close(i)
        else:
            if depth["head"] and name not in HEAD:
                flush()
                close(next(i for i, x in enumerate(stack) if x[0] == "head"))
                element, hard, section, root = stack[-1] if stack else ("", False, 0, 0)
            attributes = page[m.end() : end]
            names, ids, roles = _names(attributes)
            own_hard, own_section, own_root = hard, section, root
            if name in APART or (name == "header" and not root):
                own_hard = True
            elif (names or ids) and (said := _section_of(name, names, ids, root > 0)):
                own_section = len(sections)
                sections.append(_Section(section, said == "comments" or sections[section].comments, len(found), weak=said == "weak"))
            if (name in MARKS or "main" in roles or "articleBody" in roles) and not root and not sections[own_section].comments and not (hard and not _only_forms(stack)):
                roots += 1
                own_root, own_hard = roots, False
            tags.append((name, own_hard, own_section, own_root, own_root != root, own_hard != hard or own_section != section))
            if name in RAW:
                end = _raw_end(name).search(page, at)
                at = end.start() if end else n
            elif name in VOID or attributes.endswith("/") or (not block and own_section == section):
                if own_section != section:
                    sections[own_section].last = len(found)
                continue
            depth[name] += 1
            stack.append((name, own_hard, own_section, own_root))
        element, hard, section, root = stack[-1] if stack else ("", False, 0, 0)
    say(page[at:])
    flush()
    return _resolved(found, sections, roots > 0)


def _only_forms(stack: list[tuple]) -> bool:
    return all(x[0] == "form" for x in stack if x[0] in APART or x[0] == "header")


def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def _resolved(found: list[tuple], sections: list[_Section], marked: bool) -> list[Block]:
    """The blocks with their features, once it is known which named sections are apart."""
    words, content, heads, other, prose = [0], [0], [0], [0], [0]
    sizes = [f[0].count(" ") + 1 for f in found]
    for f, k in zip(found, sizes, strict=True):
        words.append(words[-1] + (0 if f[2] else k))
        content.append(content[-1] + (f[4] > 0))
        kind = None if f[2] or f[5] else KINDS.get(f[1], "other")
        heads.append(heads[-1] + (kind == "heading"))
        other.append(other[-1] + (kind not in (None, "heading")))
        prose.append(prose[-1] + (k if kind == "prose" else 0))
    apart, named = [False], [False]
    for s in sections[1:]:
        last = s.last if s.last >= 0 else len(found)
        most = 2 * (words[last] - words[s.first]) > words[-1] and (not marked or content[last] > content[s.first])
        text = s.weak and (prose[last] - prose[s.first] >= PARAGRAPH or (heads[last] > heads[s.first] and other[last] > other[s.first]))
        apart.append(apart[s.parent] or s.comments or not (most or text))
        named.append(named[s.parent] or (s.weak and text))
    out = []
    for (text, element, hard, section, root, linked, tags), k in zip(found, sizes, strict=True):
        away = hard or apart[section]
        shape = (KINDS.get(element, "other"), min(k.bit_length(), 7), linked)
        place = "apart" if away else "in" if root else "out" if marked else "named" if named[section] else "plain"
        block = Block(text, k, root > 0 and not away, away, (place, *shape), [])
        block.hidden = ("apart" if hard else "plain", *shape)
        for name, t_hard, t_section, t_root, edge, boundary in tags:
            outer = sections[t_section].parent
            if t_hard or apart[t_section]:
                first = boundary and not t_root and not (outer >= 0 and apart[outer])  # within a mark they part nothing
                block.tags.append(("apart", name) if first else ("inner", ""))
            else:
                block.tags.append(("edge", "") if edge else ("in" if t_root else "out" if marked else "plain", name))
            block.hidden_tags.append((("apart", name) if boundary else ("inner", "")) if t_hard else ("plain", "div" if name in MARKS else name))
        out.append(block)
    return out


def _prior(kind: str, feature: tuple) -> float:
    """The log odds of a feature before any label is seen."""
    place = feature[0]
    if kind == "tag":
        return {"edge": -COST, "inner": 0.0, "apart": -4.0, "in": 4.0, "out": -1.0}.get(place, -TAG_PRIOR.get(feature[1], 1.0))
    if place not in ("plain", "named"):
        return {"in": 4.0, "out": -3.0, "apart": -4.0}[place]
    _, element, size, linked = feature
    return (WORD_PRIOR[element] + 0.15 * (size - 3)) * (0.1 if linked else 1.0) * (0.7 if place == "named" else 1.0)


@dataclass
class Weights:
    """Counts (inside, outside) of features on labelled pages; what words score and tags cost follows from them. Bounded by SAMPLE pages."""

    seen: dict = field(default_factory=dict)
    known: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"seen": self.seen, "known": {}}

    def of(self, kind: str, feature: tuple) -> int:
        key = (kind, feature)
        w = self.known.get(key)
        if w is None:
            inside, outside = self.seen.get(key, (0, 0))
            share, strength = 1 / (1 + math.exp(-_prior(kind, feature))), PRIOR_WORDS if kind == "word" else PRIOR_TAGS
            odds = math.log((inside + strength * share) / (outside + strength * (1 - share)))
            if kind == "word":
                w = max(LEAST, round(UNIT * min(MOST, odds)))
            else:
                w = -max(LEAST, round(UNIT * min(COST, -odds))) if feature[0] != "inner" else -LEAST
            self.known[key] = w
        return w

    def block(self, b: Block) -> int:
        return self.of("word", b.feature) * b.words

    def between(self, b: Block) -> int:
        """What the tags since the block before cost."""
        return sum(self.of("tag", t) for t in b.tags)


def best_run(blocks: list[Block], weights: Weights) -> tuple[int, int]:
    """First and last + 1 of the contiguous blocks with the greatest sum of their words and of the tags between them: one scan."""
    best, span, here, start = 0, (0, 0), 0, 0
    for i, b in enumerate(blocks):
        here += weights.between(b)
        if here <= 0:
            here, start = 0, i
        here += weights.block(b)
        if here > best:
            best, span = here, (start, i + 1)
    return span


def main_text(page: str, weights: Weights) -> str:
    blocks = blocks_of(page)
    first, last = best_run(blocks, weights)
    return "\n".join(b.text for b in blocks[first:last] if not b.apart)


def count(page: str) -> Counter | None:
    """How often each feature stands in and out of the marked article of a labelled page; None if it marks none."""
    blocks = blocks_of(page)
    if not any(b.inside for b in blocks):
        return None
    seen: Counter = Counter()
    before = False
    for b in blocks:
        for feature in (b.feature, b.hidden):
            seen["word", feature, b.inside] += b.words
        for t in (*b.tags, *b.hidden_tags):
            seen["tag", t, b.inside and before] += 1
        before = b.inside
    return seen


def _sampled(pages: DataFrame, body: str) -> DataFrame:
    """(h, body) of at most SAMPLE distinct pages with a mark, by hash order. Only hashes are sorted, at most SAMPLE a task; bodies stay where they are."""
    marked = pages.where(F.col(body).rlike(r"(?i)<(article|main)[\s>]")).select(F.xxhash64(body).alias("h"), F.col(body).alias("body"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for b in batches:
            held = np.unique(np.r_[held, b.column(0).to_numpy(zero_copy_only=False)])[:SAMPLE]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], names=["h"])

    picked = [r.h for r in marked.select("h").mapInArrow(least, "h long").distinct().orderBy("h").limit(SAMPLE).collect()]
    return marked.where(F.col("h").isin(picked)) if picked else marked.where(F.lit(False))


def learn(pages: DataFrame, body: str = "html") -> Weights:
    """Weights from at most SAMPLE distinct pages that mark an article; those before any label where there are none. Repeated pages count once."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = set()
        for b in batches:
            for h, page in zip(b.h, b.body, strict=True):
                if h in done:
                    continue
                done.add(h)
                rows = [(h, kind, "\t".join(map(str, feature)), inside, n) for (kind, feature, inside), n in (count(page) or {}).items()]
                if rows:
                    yield pd.DataFrame(rows, columns=["h", "kind", "feature", "inside", "n"])

    rows = _sampled(pages, body).mapInPandas(counted, "h long, kind string, feature string, inside boolean, n long").dropDuplicates(["h", "kind", "feature", "inside"])
    weights = Weights()
    for r in rows.groupBy("kind", "feature", "inside").agg(F.sum("n").alias("n")).collect():
        parts = r.feature.split("\t")
        key = (r.kind, (parts[0], parts[1], int(parts[2]), parts[3] == "True") if r.kind == "word" else tuple(parts))
        inside, outside = weights.seen.get(key, (0, 0))
        weights.seen[key] = (inside + r.n, outside) if r.inside else (inside, outside + r.n)
    return weights


def extract(pages: DataFrame, weights: Weights, body: str = "html", out: str = "text") -> DataFrame:
    """Add `out`, the main text of each whole page; other columns stay (one called `out` is replaced).

    Null and empty pages, and pages without words, give an empty text; repeated pages and keys are rows like others;
    a very long or hostile page takes time linear in its length.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(p, weights) if p else "" for p in s], dtype=object)

    return pages.withColumn(out, run(F.col(body)))
