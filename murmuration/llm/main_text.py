"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores the share of words of its kind (in a heading, list or other text, in a link
or not) that stand inside the article on labelled pages, a tag loses its share outside times a cost; both shares and
the cost that finds labelled articles best are learned from a bounded sample of pages that mark their article with one
article or main element. Those marks are no features, so the weights hold for pages without them. One linear scan
finds the run of blocks with the highest sum. Elements that are no part of any article (menus, forms, adverts,
comments and so on, told by name, role or class) neither score nor come out, and a page that marks its article
has the run corrected to it where they mostly agree.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmuration.llm import scratch
from murmuration.llm.text_blocks import frugal

#: Labelled pages that the weights are learned from at most: those of least hash of id and url.
SAMPLE = 2000
#: Costs of a tag outside, from which the one of highest word-level F1 on the sample is taken; the loss of any tag.
COSTS, LEAST_LOSS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0), 0.05
#: Pseudo-observations of every feature, and the share inside that they stand for: words, words in links, tags.
PRIOR, PRIOR_WORD, PRIOR_LINK, PRIOR_TEXT_TAG, PRIOR_TAG = 5.0, 0.7, 0.2, 0.9, 0.5

# Names of HTML elements by what they do, and words of classes, ids and roles
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong br q cite code sup sub".split())
HEADINGS, LISTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split()), frozenset("li dt dd".split())
NEVER = frozenset("head svg math object audio video canvas template select option button datalist".split())
APART = frozenset("nav aside footer header form menu dialog".split())
ARTICLE = frozenset("article main".split())
NO_FEATURE = frozenset("html body article main".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
COMMENT_WORDS = frozenset("comment comments commentlist commentary respond reply replies disqus discussion".split())
APART_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar navbar navigation nav menu breadcrumb breadcrumbs footer masthead cookie
    cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations
    widget toolbar pagination pager copyright outbrain taboola toc""".split()
)
LAYOUT_WORDS = frozenset("with without has no layout grid".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    """A run of text between block tags, with the tags that stand before it."""

    kind: str
    owners: tuple[int, ...]
    apart: int
    article: int
    tags: list[str] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


@dataclass
class Open:
    """An open element: its number, what it lies in, and whether its text is dropped for good."""

    name: str
    number: int
    apart: int
    article: int
    never: bool
    link: bool
    headings_only: bool


class Page:
    """Blocks of a page. `apart` of a block is the number of the outermost element that keeps it out, or 0."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.kinds: dict[int, str] = {}  # of elements that keep text out: name, class or comment
        self.holds: set[int] = set()  # those of them that hold an article or main element, and forms that hold an h1
        self._stack: list[Open] = [Open("", 0, 0, 0, False, False, False)]
        self._number, self._tags, self._block = 0, [], None
        self._read(source)
        self._restore()

    def _read(self, source: str) -> None:
        at, folded, last = 0, None, source.rfind(">")
        while at < len(source):
            m = _TOKEN.search(source, at) if at <= last or source.find("<!", at) >= 0 else None
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if not m["name"]:
                continue
            name = m["name"].lower()
            if m["end"]:
                self._close(name)
                continue
            if name in RAW:
                folded = folded if folded is not None else _ascii_lower(source)
                end = folded.find(f"</{name}", at)
                at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
                continue
            self._open(name, m["more"])

    def _text(self, raw: str) -> None:
        top = self._stack[-1]
        if top.never or (top.headings_only and not any(x.name in HEADINGS for x in self._stack)):
            return
        value = html.unescape(raw) if "&" in raw else raw
        n = len(value.split())
        if self._block is None:
            if not n:
                return
            kind = next((x.name for x in reversed(self._stack) if x.name in BLOCK), "body")
            self._block = Block(kind, tuple(x.number for x in self._stack if x.name in BLOCK and x.name != "html"), top.apart, top.article, self._tags)
            self._tags = []
            self.blocks.append(self._block)
        self._block.pieces.append(value)
        self._block.words += n
        self._block.linked += n * top.link

    def _tag(self, name: str) -> None:
        if self._stack[-1].never:
            return
        if name in BLOCK:
            self._block = None
        elif name == "br" and self._block is not None:
            self._block.pieces.append(" ")
        if name not in NO_FEATURE:
            (self._block.tags if self._block is not None else self._tags).append(name)

    def _open(self, name: str, more: str) -> None:
        if name in BLOCK:
            self._end_paragraph()
        if name in CLOSED_BY:
            closed, within = CLOSED_BY[name]
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k].name in closed:
                    del self._stack[k:]
                    break
                if self._stack[k].name in within:
                    break
        self._tag(name)
        if name in VOID:
            return
        self._number += 1
        top = self._stack[-1]
        why = "" if name in ("html", "body") else self._why_apart(name, more, top)
        inner_header = name == "header" and top.article and not top.apart
        apart, article = top.apart, top.article
        if why and not apart and not inner_header:
            apart, self.kinds[self._number] = self._number, why
        if apart and (name in ARTICLE or name == "h1" and self.kinds[apart] == "form"):
            self.holds.add(apart)
        if name in ARTICLE and not article:
            article = self._number
        self._stack.append(Open(name, self._number, apart, article, top.never or name in NEVER or why == "hidden", top.link or name == "a", top.headings_only or inner_header))

    def _why_apart(self, name: str, more: str, top: Open) -> str:
        said = ""
        if more and ("=" in more or "hidden" in more):
            given = {k.lower(): html.unescape(a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(more)}
            if "hidden" in given or _HIDDEN.search(given.get("style", "")):
                return "hidden"
            for value in (*given.get("class", "").split(), given.get("id", "")):
                parts = _WORD.findall(value)
                if LAYOUT_WORDS.intersection(parts):
                    continue
                if COMMENT_WORDS.intersection(parts):
                    return "comment"
                if APART_WORDS.intersection(parts):
                    said = "class"
            if given.get("role") in APART_ROLES:
                said = "class"
        return name if name in APART else "" if name in ARTICLE else said

    def _end_paragraph(self) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].name == "p":
                del self._stack[k:]
                return
            if self._stack[k].name in BLOCK:
                return

    def _close(self, name: str) -> None:
        if name in VOID:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].name == name:
                self._tag(f"/{name}" if name not in BLOCK else name)
                del self._stack[k:]
                return
            if self._stack[k].name in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return  # an end tag in a cell closes nothing outside of it

    def _restore(self) -> None:
        """Elements that hold the article itself don't keep it out, be they forms around whole pages or never closed."""
        free = set() if any(b.article and not b.apart for b in self.blocks) else {k for k in self.holds if self.kinds[k] not in ("comment", "hidden")}
        left = Counter()
        for b in self.blocks:
            if b.apart in free:
                b.apart = 0
            left[b.apart] += b.words
        if not left[0] and (rest := {k: n for k, n in left.items() if k and self.kinds[k] in ("form", "class")}):
            most = max(rest, key=lambda k: (rest[k], -k))
            for b in self.blocks:
                b.apart = 0 if b.apart == most else b.apart


def _ascii_lower(source: str) -> str:
    """Same length as source; only A-Z change."""
    return source.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Weights:
    words: dict[str, float]
    tags: dict[str, float]
    cost: float

    def word(self, kind: str) -> float:
        return self.words.get(kind, _prior_share(kind))

    def tag(self, name: str) -> float:
        return -LEAST_LOSS - self.cost * (1 - self.tags.get(name, _prior_share("<" + name)))


def _prior_share(feature: str) -> float:
    if feature.startswith("<"):
        return PRIOR_TEXT_TAG if feature[1:].removeprefix("/") in TEXT_TAGS else PRIOR_TAG
    return PRIOR_LINK if feature.startswith("a ") else PRIOR_WORD


DEFAULT = Weights({}, {}, 2.0)


def _kind(block: Block) -> str:
    """Headings, lists and all other text: what element holds other text tells little, as pages differ."""
    return "heading" if block.kind in HEADINGS else "list" if block.kind in LISTS else "text"


def scores(blocks: list[Block], weights: Weights) -> list[tuple[float, float]]:
    """(tags before and in a block, its words) of each block."""
    return [(sum(map(weights.tag, b.tags)), (b.words - b.linked) * weights.word(_kind(b)) + b.linked * weights.word("a " + _kind(b))) for b in blocks]


def best_run(values: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last block of the run whose words and inner tags sum highest (the first such, shortest); (0, -1) if none is above 0."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for k, (tags, words) in enumerate(values):
        if total + tags <= 0:
            total, start = 0.0, k
        else:
            total += tags
        total += words
        if total > best:
            best, found = total, (start, k)
    return found


def content(page: Page, weights: Weights) -> list[Block]:
    """The blocks of the main text in page order."""
    blocks = [b for b in page.blocks if not b.apart]
    first, last = best_run(scores(blocks, weights))
    run = blocks[first : last + 1]
    if not run:
        return []
    by_article = Counter()
    for b in run:
        by_article[b.article] += b.words
    marked = {b.article for b in blocks if b.article}
    if len(marked) == 1 and 2 * by_article[(only := marked.pop())] >= sum(by_article.values()):
        return [b for b in blocks if b.article == only]
    # a block cut off at the run's ends belongs to it if it stands in the element of most of its words and is no list of links
    held = Counter()
    for b in run:
        held[b.owners[:-1]] += b.words
    own = max(held, key=lambda k: (held[k], len(k)))
    alike = lambda b: 2 * b.linked < b.words and b.owners[: len(own)] == own and (own or len(b.owners) < 2)
    while first > 0 and alike(blocks[first - 1]):
        first -= 1
    while last + 1 < len(blocks) and alike(blocks[last + 1]):
        last += 1
    return blocks[first : last + 1]


def extract(source: str | None, weights: Weights = DEFAULT) -> str:
    """Main text of one page."""
    return "\n".join(filter(None, (b.text() for b in content(Page(source or ""), weights))))


def _observations(source: str) -> tuple[Page, list[tuple[str, int, bool]]] | None:
    """Features of a labelled page as (feature, times, inside); None if the page isn't marked by one article or main."""
    page = Page(source)
    if len({b.article for b in page.blocks if b.article and not b.apart}) != 1:
        return None
    out = []
    for b in page.blocks:
        inside = bool(b.article and not b.apart)
        out += [(_kind(b), b.words - b.linked, inside), ("a " + _kind(b), b.linked, inside), *(("<" + t, 1, inside) for t in b.tags)]
    return page, out


_KNOWN = VOID | BLOCK | TEXT_TAGS | frozenset("a span small u s big font label abbr time mark kbd samp var dfn ins del img heading list text other".split())


def _known(feature: str) -> str:
    """Features of unheard-of elements count together, so that there are a few hundred at most."""
    lead = "a " if feature.startswith("a ") else "</" if feature.startswith("</") else "<" if feature.startswith("<") else ""
    return feature if feature.removeprefix(lead) in _KNOWN else lead + "other"


def sample_of(pages: DataFrame, most: int = SAMPLE, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """html of at most `most` pages that hold an article or main element, those of least hash of id and url; rows that share
    the last hash stay out."""
    key = F.xxhash64(F.col(page_id), F.col(url))
    marked = pages.filter(F.col(source).rlike("(?i)<(article|main)\\b")).select(key.alias("key"), F.col(source).cast("string").alias("html"))
    cut = marked.select("key").orderBy("key").limit(most + 1).agg(F.max("key").alias("last"), F.count("*").alias("n")).first()
    return marked.filter(F.col("key") < cut.last if cut.n > most else F.lit(True)).select("html")


def train(pages: DataFrame, most: int = SAMPLE, page_id: str = "page_id", url: str = "url", source: str = "html") -> Weights:
    """Weights of words and tags from at most `most` labelled pages; `DEFAULT`'s priors where there are none."""
    some = scratch.materialize(sample_of(pages, most, page_id, url, source), "labelled-pages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for value in batch.column("html"):
                for f, n, is_in in (_observations(value.as_py() or "") or (None, ()))[1]:
                    (inside if is_in else outside)[_known(f)] += n
        names = sorted(inside | outside)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in (inside, outside))], ["feature", "inside", "outside"])

    summed = some.mapInArrow(frugal(count), "feature string, inside bigint, outside bigint").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    share = {r.feature: (r.inside + PRIOR * _prior_share(r.feature)) / (r.inside + r.outside + PRIOR) for r in summed.collect()}
    words, tags = {f: s for f, s in share.items() if not f.startswith("<")}, {f[1:]: s for f, s in share.items() if f.startswith("<")}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, taken, wanted = ([0] * len(COSTS) for _ in range(3))
        for batch in batches:
            for value in batch.column("html"):
                if (seen := _observations(value.as_py() or "")) is None:
                    continue
                blocks = [b for b in seen[0].blocks if not b.apart]
                for k, cost in enumerate(COSTS):
                    first, last = best_run(scores(blocks, Weights(words, tags, cost)))
                    right[k] += sum(b.words for b in blocks[first : last + 1] if b.article)
                    taken[k] += sum(b.words for b in blocks[first : last + 1])
                    wanted[k] += sum(b.words for b in blocks if b.article)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(COSTS)), pa.int32()), *(pa.array(x, pa.int64()) for x in (right, taken, wanted))], ["k", "right", "taken", "wanted"])

    found = some.mapInArrow(frugal(judge), "k int, right bigint, taken bigint, wanted bigint").groupBy("k").agg(*[F.sum(x).alias(x) for x in ("right", "taken", "wanted")]).collect()
    f1 = {COSTS[r.k]: 2 * r.right / (r.taken + r.wanted) for r in found if r.wanted}
    return Weights(words, tags, max(f1, key=lambda c: (f1[c], -abs(c - DEFAULT.cost))) if f1 else DEFAULT.cost)


@scratch.sized
def main_text(pages: DataFrame, weights: Weights | None = None, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page: its main text, a line for each block, and the text's code points.

    Null and empty pages, and pages without text, have an empty text. Character references are decoded, white space
    in a block becomes one space, br too. A page of any length is read whole; one page has to fit a task. Rows that
    repeat are rows each, and an empty table gives no rows. Of the pages only the three named columns are read,
    whatever the others are called. Without `weights` they are learned from these pages.
    """
    weights = weights or train(pages, page_id=page_id, url=url, source=source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(value.as_py(), weights) for value in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(frugal(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op13_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
