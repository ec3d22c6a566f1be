"""Main text of web pages by block rules in two passes.

A page becomes blocks: runs of text between block-level tags, outside scripts,
styles and containers that say by tag, role or style that they are not the
article. An article or main part inside a menu, header or form ends that, since the
tag around it was left open or spans the page; a form around the page is a hint. A
class or id is a hint only: an article inside is free of it, inside an
article it counts for what holds no good block, and where nothing good would be
left it does not count. Names of adverts, notices and the like count for good blocks
too, and those of reader comments also for the articles inside. Pass one looks at
each block alone: a high share of links is bad (in a marked article, links and
nothing else), a good length with a good share of stop words or with few links is
good, all else is open. The stop words are those of four languages; on a page that hardly has
any, a shorter length with few links is enough. Their absence never makes a block
bad. Pass two gives every open block the label of the nearest decided block on its
side: blocks of marked articles look at each other, and the rest at the rest. Without
any, it stays in, except beside a marked article, where only a top heading and the
open blocks from there to the article do. A mark decides open blocks alone: good ones
stay wherever they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags by role, words that name what is not the article, stop words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset(
    "article aside blockquote body button dd details dialog div dl dt fieldset figure footer form head header html li main menu nav ol "
    "section select span table tbody td th tr ul object svg template noscript iframe".split()
)
IMPLIED_ENDS = {  # an opening tag ends an open one of these, unless one of the others is in between
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
}
RAW_TAGS = frozenset("script style title textarea xmp noembed noframes iframe svg template noscript canvas video audio".split())
OUTSIDE_TAGS = frozenset("nav footer aside menu dialog head button select fieldset".split())
AROUND_TAGS = frozenset("nav menu header form".split())  # may be left open, or span a page
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
AROUND_ROLES = frozenset("navigation banner search form menu menubar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification "
    "overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget widgets".split()
)
NEVER_WORDS = frozenset(  # of those, names of what is never the article, however long its text
    "ad ads advert adverts advertisement advertising consent cookie cookies disqus gdpr login newsletter notice notification "
    "popup promo promoted promotion sidebar signup sponsor sponsored subscribe".split()
)
COMMENT_WORDS = frozenset("disqus replies reply respond".split())
NO_COMMENT_WORDS = frozenset("commentaries commentary commentator commentators commented commenting".split())
LAYOUT_WORDS = frozenset(  # a name with one of them tells what the page looks like, or its subject
    "body category closed content disabled enabled fixed format has is layout main no off on open opened page site status tag "
    "type with without wrap wrapped wrapper".split()
)
PLACE_WORDS = frozenset("main page site".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it its not of on or that the their there they this to was were which with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einen er es für hat ich im ist mit nach nicht oder sich sie sind "
    "und von war wie wird zu zum zur "
    "al como con del el en era este la las lo los más no para pero por que se sin su sus un una y "
    "au aux avec ce ces dans de du elle est et il ils je le les leur mais ne nous ou par pas plus pour qui sa ses son sont sur très une vous".split()
)
SHORT, LONG = 70, 200  # characters
DENSE = 3  # letters that one character of Chinese, Japanese or Korean counts for
LINKS, FEW_LINKS = 0.4, 0.2  # share of a block's characters inside links
STOPS_LOW, STOPS_HIGH = 0.12, 0.25  # share of stop words among a block's words
STOPS_KNOWN = 0.05  # share of stop words on a page in a language of the list

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # comments
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"  # unbalanced quotes
    r"|[^<]+|<",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")  # userComments has two
NAMED, NEVER, COMMENTS = 1, 2, 3  # how much a name says that an element is not the article
REACH = 32  # open elements among which an implied end is looked for
_WORD = re.compile(r"\w+")
_IDEOGRAPHS = re.compile("[\u1100-\u11ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    article: bool
    hint: int = 0  # number of the element whose class or id says it is not the article; 0 without
    top: bool = False  # a heading of the first level
    never: bool = False  # its name is one that good blocks do not outweigh


@dataclass
class _Element:
    tag: str
    outside: bool
    around: bool  # outside by a tag or role that an article inside ends
    article: bool
    hint: int
    kind: int  # of the hint


@dataclass
class _Page:
    """State of one pass over a page's tags."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=lambda: [_Element("", False, False, False, 0, 0)])
    opened: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    block_outside: bool = False  # the tag that opened this block says it is not the article
    block_hint: int = 0
    block_never: bool = False
    block_top: bool = False
    hints: int = 0

    @property
    def outside(self) -> bool:
        return self.block_outside or self.stack[-1].outside

    def text(self, raw: str) -> None:
        if not self.outside:
            raw = unescape(raw)
            self.parts.append(raw)
            if self.links:
                self.linked += len("".join(raw.split()))

    def close(self) -> None:
        text, here = " ".join("".join(self.parts).split()), self.stack[-1]
        if text:
            never = here.kind >= NEVER if here.hint else self.block_never
            self.blocks.append(Block(text, self.linked, here.article, here.hint or self.block_hint, self.block_top, never))
        self.parts, self.linked, self.block_outside, self.block_hint, self.block_top = [], 0, False, 0, False
        self.block_never = False

    def open_tag(self, tag: str, attributes: str) -> None:
        if tag in IMPLIED_ENDS:
            self._end_implied(*IMPLIED_ENDS[tag])
        here = self.stack[-1]
        outside, around, article, main, kind = self._says(tag, attributes, here.article)
        self.hints += kind > 0
        if tag in CONTAINERS:
            inside = article or here.article and not (kind and tag == "article")
            free = article and (main or (not here.article and here.kind < COMMENTS))
            if free:
                hint, named = 0, 0
            elif kind > here.kind:
                hint, named = self.hints, kind
            else:
                hint, named = here.hint, here.kind
            still, still_around = here.outside, here.around
            if article and here.around:
                still = still_around = False
            now = _Element(tag, outside or still, around if outside and not still else still_around and not outside, inside, hint, named)
            if (now.outside, now.article, now.hint) != (here.outside, here.article, here.hint):
                self.close()
            self.stack.append(now)
            self.opened[tag] += 1
        elif tag in BLOCK_TAGS:
            self.block_outside, self.block_top = outside, tag == "h1"
            self.block_hint, self.block_never = self.hints * (kind > 0), kind >= NEVER

    def _pop(self) -> str:
        tag = self.stack.pop().tag
        self.opened[tag] -= 1
        return tag

    def close_tag(self, tag: str) -> None:
        if tag in CONTAINERS and self.opened[tag]:
            while self._pop() != tag:
                pass

    def _end_implied(self, ends: set[str], bounds: set[str]) -> None:
        for place in range(len(self.stack) - 1, max(len(self.stack) - 1 - REACH, 0), -1):
            if self.stack[place].tag in bounds:
                return
            if self.stack[place].tag in ends:
                while len(self.stack) > place:
                    self._pop()
                return

    def _says(self, tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool, bool, int]:
        """Whether a tag opens something outside the article, which an article inside would end; whether
        an article, or the main part; and how much its names hint at the outside."""
        main, article = tag == "main", tag in ("article", "main")
        outside = tag in OUTSIDE_TAGS or (tag == "header" and not inside) or (tag == "form" and inside)
        around, kind = outside and not inside and tag in AROUND_TAGS, NAMED * (tag == "form" and not inside)
        if attributes and not attributes.isspace():
            values = {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) for k, v in _ATTRIBUTE.findall(attributes)}
            roles = values.get("role", "").lower().split()
            main = main or "main" in roles
            article = article or main or "article" in roles
            hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true"
            hidden = hidden or bool(_HIDDEN.search(values.get("style", "")))
            if tag not in ("html", "body", "main") and tag not in HEADINGS and "main" not in roles:
                names = f"{values.get('class', '')} {values.get('id', '')}".split()
                kind = max([kind, *(_kind([w.lower() for w in _NAME_WORD.findall(x)]) for x in names)])
            if tag not in ("html", "body", "main", "article") and not article and not OUTSIDE_ROLES.isdisjoint(roles):
                around = not inside and (around or not outside) and AROUND_ROLES.issuperset(OUTSIDE_ROLES.intersection(roles))
                outside = True
            if hidden:
                outside, around = True, False
        hinted = kind > 0
        return outside, around, article and not hinted, main and not hinted, kind


def _kind(words: list[str]) -> int:
    """What a class or id name, in words, says of an element."""
    if words and words[-1] in NEVER_WORDS:  # site-ad, page-sidebar
        words = [w for w in words if w not in PLACE_WORDS]
    if not LAYOUT_WORDS.isdisjoint(words):
        return 0
    for w in words:
        comment = w.startswith("comment") or w.endswith(("comment", "comments"))
        if w in COMMENT_WORDS or comment and w not in NO_COMMENT_WORDS:
            return COMMENTS
    return NEVER if not NEVER_WORDS.isdisjoint(words) else NAMED if not OUTSIDE_WORDS.isdisjoint(words) else 0


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, without those outside the article by their markup."""
    page, place = _Page(), 0
    while match := _TOKEN.match(html, place):
        place = match.end()
        tag = match["tag"] or match["tag2"]
        if not tag:
            token = match.group()
            if not token.startswith(("<!", "<?")):
                page.text(token)
            continue
        tag, ending = tag.lower(), match["end"] or match["end2"]
        attributes = (match["attrs"] or match["attrs2"] or "").rstrip()
        if tag in RAW_TAGS and not ending and not attributes.endswith("/"):
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(html, place)
            place = end.end() if end else len(html)
            continue
        if tag == "a":
            page.links = 0 if ending else 1
        elif tag == "br":
            page.text(" ")
        if tag in BLOCK_TAGS:
            page.close()
        if ending:
            page.close_tag(tag)
        else:
            page.open_tag(tag, attributes)
    page.close()
    return page.blocks


def _stops(text: str) -> tuple[int, int]:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def known_language(found: list[Block]) -> bool:
    """Whether a page has stop words as a text in a language of the list has; scripts without blanks have a word a character."""
    counts = [(*_stops(b.text), 0 if b.text.isascii() else len(_IDEOGRAPHS.findall(b.text))) for b in found]
    return sum(stops for stops, _, _ in counts) >= STOPS_KNOWN * sum(n + dense for _, n, dense in counts)


def first_pass(block: Block, known: bool = True) -> bool | None:
    """Good, bad or open, from the block alone and whether the page's language is known."""
    letters = len(block.text.replace(" ", ""))
    if block.linked > LINKS * letters:
        return None if block.article and block.linked < letters else False
    size = len(block.text) if block.text.isascii() else len(block.text) + (DENSE - 1) * len(_IDEOGRAPHS.findall(block.text))
    if size >= (LONG if known else SHORT) and block.linked <= FEW_LINKS * letters:
        return True
    stops, n = _stops(block.text)
    share = stops / n if n else 0.0
    if size >= SHORT and share >= STOPS_HIGH or size >= LONG and share >= STOPS_LOW:
        return True
    return None


def second_pass(labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided one; good where two are as near, or none is."""
    decided = [(i, x) for i, x in enumerate(labels) if x is not None]
    out, following = [], 0
    for i, label in enumerate(labels):
        while following < len(decided) and decided[following][0] < i:
            following += 1
        near = decided[max(following - 1, 0) : following + 1]
        if label is not None:
            out.append(label)
        elif not near:
            out.append(True)
        else:
            least = min(abs(j - i) for j, _ in near)
            out.append(any(x for j, x in near if abs(j - i) == least))
    return out


def unhinted(found: list[Block], labels: list[bool | None]) -> list[Block]:
    """Blocks that no name takes away: in an article, elements with a good block stay, but those of
    adverts, notices and comments; elsewhere none does, if a good one is left."""
    content = {b.hint for b, label in zip(found, labels) if b.article and label and not b.never}
    kept = [not b.hint or (b.article and not b.never and b.hint in content) for b in found]
    if not any(k and (label or b.article) for b, label, k in zip(found, labels, kept)) and True in labels:
        return found
    return [b for b, k in zip(found, kept) if k]


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    known = known_language(found)
    found = unhinted(found, [first_pass(b, known) for b in found])
    labels = [first_pass(b, known) for b in found]
    marked = [i for i, b in enumerate(found) if b.article]
    rest = [i for i, b in enumerate(found) if not b.article]
    beside = not marked or any(labels[i] is not None for i in rest)
    kept = dict(zip(marked, second_pass([labels[i] for i in marked])))
    kept |= dict(zip(rest, second_pass([labels[i] for i in rest]) if beside else [False] * len(rest)))
    if marked:
        heading = max((i for i in rest if found[i].top and i < marked[0]), default=marked[0])
        kept |= {i: labels[i] is not False for i in range(heading, marked[0])}
    return "\n".join(b.text for i, b in enumerate(found) if kept[i])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    Null and empty pages have an empty text; repeated rows give repeated results;
    null ids and urls pass through. Unclosed and unbalanced tags end at the next
    one of their kind. An empty table gives no rows.
    """
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    plain = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(_scan, f"{kinds}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
