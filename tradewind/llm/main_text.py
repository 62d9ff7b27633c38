"""The main text of HTML pages by two passes of rules over blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.batches import with_columns
from tradewind.llm.quality import STOP_WORDS

# Limits of the first pass.
MAX_LINK_DENSITY = 0.35
LONG_CHARS, SHORT_CHARS = 200, 70
HIGH_STOPS, LOW_STOPS = 0.25, 0.12

# HTML element names by how they shape a page.
_BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend "
    "li main menu nav noscript ol optgroup option p pre section select summary table tbody td "
    "template tfoot th thead title tr ul".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTAINERS = set(
    "article aside body button details dialog div dl fieldset figure footer form head header "
    "main menu nav noscript ol section select table template ul".split()
)
_RAW = set("iframe noembed noframes script style textarea title xmp".split())
_APART = set(
    "aside button dialog footer form head header menu nav noscript select template".split()
)
_MAIN = {"article", "main"}
#: Elements within a block whose text is not part of it: pictures, and what stands in for media.
_MUTED = set("svg object canvas audio video".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that end where the next of their like begins.
_ITEMS = set("dd dt li option td th tr".split())

# Words in a class, id or role that tell what a part of a page is for.
_READERS = set("comment comments disqus replies reply respond discussion feedback reviews".split())
_HINTS = set(
    "ad ads adsense advert advertisement advertisements adverts banner breadcrumb breadcrumbs "
    "complementary consent contentinfo cookie cookies copyright dialog footer form gdpr header "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination paywall popup promo promoted promotion promotions recommended "
    "related search share sharing sidebar signup social sponsor sponsored sponsors subscribe "
    "subscription tags teaser toolbar widget widgets alert".split()
)
#: Names of whole parts, by themselves: what the elements nav and footer say.
_LANDMARKS = set("contentinfo footer menu menubar nav navbar navigation".split())
#: Beside such a word a name tells how a layout is set ("with-sidebar", "comments-open").
_STATES = set("allow closed disabled enabled has hide no open show with without".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
_NAMED = re.compile(
    r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I
)
_UNSEEN = re.compile(
    r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I
)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)", re.I)
_NO_DISPLAY = re.compile(r"""(?:^|\s)style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
#: Ends of sentences.
_STOP = re.compile(r"[.!?\u2026\u0964](?=\s|$|[\"'\u00bb\u201d)])|[\u3002\uff01\uff1f]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_EDGES = ".,;:!?\"'()[]«»“”‘’…-–—¿¡"


@dataclass(eq=False)
class Part:
    """An open element that can hold blocks. What holds for a part holds for all parts in it, so
    a part only knows the one around it."""

    name: str
    around: Part | None = None
    apart: bool = False
    named: bool = False  # as the readers' part, or as a menu or footer
    hints: frozenset[str] = frozenset()
    holds_main: bool = False
    mutes: bool = False  # no text in it is read
    in_main: bool = field(init=False)
    # What the part and those around it come to, set once the page is read.
    is_apart: bool = False
    all_hints: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.in_main = self.name in _MAIN or (self.around is not None and self.around.in_main)

    def settle(self) -> None:
        """Sets what the part comes to, after the parts around it."""
        up = self.around or _OUTSIDE
        self.is_apart = up.is_apart or (self.apart and not self.holds_main)
        own = frozenset() if self.holds_main else self.hints
        self.all_hints = up.all_hints if own <= up.all_hints else up.all_hints | own


_OUTSIDE = Part("")


@dataclass(eq=False)
class Block:
    text: str
    linked: int
    name: str
    part: Part
    good: bool | None = None

    @property
    def in_main(self) -> bool:
        return self.part.in_main

    @property
    def is_apart(self) -> bool:
        return self.part.is_apart

    @property
    def hints(self) -> frozenset[str]:
        return self.part.all_hints


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)  # all, each after the one around it
    open: list[Part] = field(default_factory=list)
    names: Counter[str] = field(default_factory=Counter)  # of the open parts
    texts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: bool = False
    name: str = ""
    muted: int = 0  # open parts that mute
    beneath: Counter[str] = field(default_factory=Counter)  # names of what was open before them

    @property
    def innermost(self) -> Part:
        return self.open[-1] if self.open else _OUTSIDE

    def add(self, raw: str) -> None:
        if raw and not self.muted:
            text = unescape(raw)
            self.texts.append(text)
            if self.in_link:
                self.linked += len(text)

    def end_block(self, name: str) -> None:
        text = " ".join("".join(self.texts).split())
        if text:
            self.blocks.append(Block(text, self.linked, self.name, self.innermost))
        self.texts, self.linked, self.name = [], 0, name

    def enter(self, part: Part) -> None:
        if part.mutes:
            if not self.muted:
                self.beneath = self.names.copy()
            self.muted += 1
        self.open.append(part)
        self.parts.append(part)
        self.names[part.name] += 1
        if part.name in _MAIN:
            around = part.around
            while around and not around.holds_main:
                around.holds_main = True
                around = around.around

    def leave(self, name: str) -> None:
        """Closes the innermost part of that name, if any, and all that it holds."""
        while self.names[name]:
            gone = self.open.pop()
            self.names[gone.name] -= 1
            self.muted -= gone.mutes
            if gone.name == name:
                break

    def unmute(self) -> None:
        while self.muted:
            self.leave(self.open[-1].name)

    def stays_muted(self, name: str, closing: bool, attributes: str) -> bool:
        """Takes a tag within a part that mutes; false if that part ends before the tag."""
        inside = self.names[name] - self.beneath[name]
        top = self.open[-1]
        if closing and inside > 0:
            self.leave(name)
        elif name in _BLOCKS and (closing or top.mutes and _ends(top.name, name)):
            self.unmute()
            return False
        elif not closing and name not in _VOID and (name in _BLOCKS | _CONTAINERS or inside > 0):
            self.enter(Part(name, top, top.apart))
        return True


    def leave_head(self) -> None:
        """A body ends the head; what is open in it goes on without it."""
        first = [p.name for p in self.open].index("head")
        left = [p for p in self.open[first:] if p.name != "head"]
        self.open = self.open[:first]
        self.names = Counter(p.name for p in self.open)
        for part in left:
            self.enter(replace(part, around=self.open[-1] if self.open else None))


def _ends(open_name: str, name: str) -> bool:
    """Whether an open block ends where another begins: a paragraph does, and an item at its like."""
    return open_name == "p" or (open_name == name and name in _ITEMS)


def _is_hidden(attributes: str) -> bool:
    """Whether an element within the text is not shown."""
    return bool(_HIDDEN.search(_QUOTED.sub('""', attributes)) or _NO_DISPLAY.search(attributes))


def _opened(name: str, attributes: str, page: _Page) -> Part:
    words: set[str] = set()
    named = False
    free = name in _MAIN or name == "body"
    if attributes and not free:
        for value in _NAMED.findall(attributes):
            for token in value.strip("\"'").split():
                own = {w.lower() for w in _PARTS.findall(token)}
                if not own & _STATES:
                    words |= own
                    named = named or token.lower() in _LANDMARKS
    hints = words & _HINTS
    apart = name in _APART
    if (name == "header" or hints == {"header"}) and page.innermost.in_main:
        hints, apart = set(), False  # an article's own header holds its title
    unseen = bool(attributes) and name != "body" and bool(_UNSEEN.search(attributes))
    around = page.open[-1] if page.open else None
    return Part(name, around, apart or unseen, named or bool(words & _READERS), frozenset(hints))


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text, in order. White space within a block is one space."""
    page, at = _Page(), 0
    while found := _TOKEN.search(html, at):
        page.add(html[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name = name.lower()
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name == "a":
            page.in_link = not closing
        elif name == "br":
            page.add(" ")
        if name in _RAW and not closing:
            end = re.compile(f"</{name}", re.I).search(html, at)
            at = end.start() if end else len(html)
        if page.muted and page.stays_muted(name, closing, attributes):
            continue
        if name in _BLOCKS:
            page.end_block("" if closing else name)
        if not closing and (name in _MUTED or (name not in _CONTAINERS | _VOID and attributes and _is_hidden(attributes))):
            if not (name == "svg" and attributes.endswith("/")):
                around = page.open[-1] if page.open else None
                page.enter(Part(name, around, mutes=True))
            continue
        if name not in _CONTAINERS:
            continue
        page.in_link = False
        if closing:
            page.leave(name)
            continue
        if name == "body" and page.names["head"]:
            page.leave_head()
        page.enter(_opened(name, attributes, page))
    page.add(html[at:])
    page.end_block("")
    for part in page.parts:
        part.settle()
    return page.blocks


def _stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w in _STOPS or w.strip(_EDGES) in _STOPS for w in words) / len(words)


_STOPS = frozenset(STOP_WORDS)


def _is_linked(block: Block) -> bool:
    return block.linked > MAX_LINK_DENSITY * len(block.text)


def _size(text: str) -> int:
    """Code points, those of scripts whose signs stand for syllables or words three times."""
    return len(text) if text.isascii() else len(text) + 2 * sum(c >= "\u2e80" for c in text)


def _is_foreign(text: str) -> bool:
    """Whether most letters are of another script than the lists' of stop words."""
    letters = [c for c in text if c.isalpha()]
    return sum(c > "\u024f" for c in letters) * 2 > len(letters)


def _reads_on(text: str) -> bool:
    """Whether the text runs in sentences, of five words or more on average."""
    ends = len(_STOP.findall(text))
    return ends > 0 and len(text.split()) >= 5 * ends


#: Labels of running text: "good", "near" (rather good), and "long", good by its length alone.
_RUNNING = ("good", "near", "long")


def _by_density(block: Block) -> str:
    """A label of running text, "bad", or undecided: "short", or "plain", of few stop words.

    Few stop words may mean a list, or a language without a list: a long text in sentences, or in
    another script, is then taken for running text.
    """
    if _is_linked(block):
        return "bad"
    size = _size(block.text)
    if size < SHORT_CHARS:
        return "bad" if block.linked else "short"
    stops = _stop_density(block.text)
    if stops >= HIGH_STOPS:
        return "good" if size > LONG_CHARS else "near"
    if stops >= LOW_STOPS:
        return "near"
    if _is_foreign(block.text) or (size > LONG_CHARS and _reads_on(block.text)):
        return "long"
    return "plain"


def _in_article(block: Block, label: str) -> str:
    """The label of a block of the article: a grade better, but for links in plenty."""
    if _is_linked(block):
        return "near" if block.name in _HEADINGS else "bad"
    return "good" if label in _RUNNING else "near"


def _chars(blocks: list[Block], labels: dict[int, str], kinds: tuple[str, ...] = _RUNNING) -> int:
    """Code points of the blocks with such labels, by default of running text."""
    return sum(len(b.text) for b in blocks if labels[id(b)] in kinds)


def _let_length_decide(own: list[Block], labels: dict[int, str]) -> None:
    """Where more text has few stop words than has many, the page's language has no list of them,
    and all that is neither short nor linked is taken for running text."""
    if _chars(own, labels, ("plain", "long")) > _chars(own, labels, ("good", "near")):
        for b in own:
            if labels[id(b)] == "plain":
                labels[id(b)] = "long"


def _around(blocks: list[Block]) -> list[Part]:
    """All parts that hold any of the blocks, each after the one around it."""
    found: dict[Part, None] = {}
    for b in blocks:
        way = []
        part: Part | None = b.part
        while part is not None and part not in found:
            way.append(part)
            part = part.around
        found.update(dict.fromkeys(reversed(way)))
    return list(found)


def _largest_main(parts: list[Part], own: list[Block], labels: dict[int, str]) -> tuple[Part | None, int]:
    """The article with the most running text, and its code points."""
    chars = dict.fromkeys(parts, 0)
    for b in own:
        if labels[id(b)] in _RUNNING:
            chars[b.part] += len(b.text)
    for part in reversed(parts):
        if part.around is not None:
            chars[part.around] += chars[part]
    mains = [p for p in parts if p.name in _MAIN]
    largest = max(mains, key=lambda p: chars[p], default=None)
    return largest, chars[largest] if largest else 0


def _set_named_apart(own: list[Block], labels: dict[int, str]) -> list[Block]:
    """``own`` without parts named for readers, menus or footers, unless the page's text is there.

    Such a name counts for nothing around the largest article, if that has more running text than
    all that stands in no such part, and nowhere if running text stands in such parts alone.
    """
    parts = _around(own)
    if not any(p.named for p in parts):
        return own
    largest, chars = _largest_main(parts, own, labels)

    def inherited(holds: Callable[[Part], bool]) -> dict[Part | None, bool]:
        found: dict[Part | None, bool] = {None: False}
        for p in parts:
            found[p] = holds(p) or found[p.around]
        return found

    named = inherited(lambda p: p.named)
    freed: set[Part] = set()
    if largest:
        inside = inherited(lambda p: p is largest)
        rest = [b for b in own if not named[b.part] and not inside[b.part]]
        if chars > _chars(rest, labels):
            around = largest.around
            while around is not None:
                freed.add(around)
                around = around.around
    set_apart = inherited(lambda p: p.named and p not in freed)
    kept = [b for b in own if not set_apart[b.part]]
    if not _chars([b for b in kept if not b.hints], labels) and _chars(own, labels):
        return own
    return kept


def _drop_hinted(own: list[Block], labels: dict[int, str]) -> list[Block]:
    """``own`` without blocks whose part has a hint, unless their densities say good.

    A hint under which long running text stands that makes half of the page tells of the layout,
    and is none.
    """
    under: dict[str, int] = {}
    for b in own:
        if labels[id(b)] in _RUNNING:
            for w in b.hints:
                under[w] = under.get(w, 0) + len(b.text)
    half = sum(len(b.text) for b in own if not _is_linked(b)) / 2
    void = {w for w, n in under.items() if n >= half and n > LONG_CHARS}
    return [b for b in own if not b.hints - void or labels[id(b)] == "good"]


def classify(blocks: list[Block]) -> None:
    """Sets ``good`` of every block.

    First pass: link density, length and density of stop words decide, but not in menus, forms
    and the like; names of classes, ids and roles count where the densities don't say otherwise.
    If articles hold most of the running text, only their blocks can be good, and are graded better
    by one; else all blocks are judged alike, rather good ones as good if no better ones are there.
    Second pass: undecided blocks take the label of the nearest decided ones before and after. Where
    these differ, a rather good one is good and another is not, but a heading before a good block
    is. Blocks outside the article, and set apart in it, are no neighbours of those inside.
    """
    for b in blocks:
        b.good = False
    own = [b for b in blocks if not b.is_apart]
    by_id = {id(b): _by_density(b) for b in own}
    _let_length_decide(own, by_id)
    own = _drop_hinted(_set_named_apart(own, by_id), by_id)
    _let_length_decide(own, by_id)
    inside = [b for b in own if b.in_main]
    if inside and 2 * _chars(inside, by_id) >= _chars(own, by_id):
        own = inside
        labels = [_in_article(b, by_id[id(b)]) for b in own]
    else:
        in_play = {id(b) for b in own}
        own = blocks
        labels = [by_id[id(b)] if id(b) in in_play else "bad" for b in own]
        if not {"good", "long"} & set(labels):  # no long paragraph: the best there is
            labels = ["good" if x == "near" else x for x in labels]
    for b, good in zip(own, inherited(labels, [b.name in _HEADINGS for b in own]), strict=True):
        b.good = good


def inherited(labels: list[str], headings: list[bool]) -> list[bool]:
    """The second pass: whether each block is good, undecided ones by their nearest decided
    neighbours; where no block is decided, all are good."""
    decided = [None if x in ("near", "short", "plain") else x != "bad" for x in labels]
    before: list[bool | None] = []
    for x in decided:
        before.append(x if x is not None else before[-1] if before else None)
    after: list[bool | None] = []
    for x in reversed(decided):
        after.append(x if x is not None else after[-1] if after else None)
    after.reverse()
    out = []
    for own, left, right, label, heading in zip(decided, before, after, labels, headings, strict=True):
        near = {x for x in (left, right) if x is not None}
        if own is not None:
            out.append(own)
        elif len(near) == 2:
            out.append(label == "near" or (heading and right is True))
        else:
            out.append(near != {False})
    return out


def main_text(html: str) -> str:
    """The good blocks, joined by line breaks."""
    blocks = blocks_of(html)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.good)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points), in place of columns of those names.

    A null or empty page has an empty text, as has one whose blocks are all boilerplate. Markup
    may be broken: a tag that isn't closed ends with what holds it, one that doesn't end is text.
    Repeated rows get equal texts; an empty table gives an empty one; pages of any length are read
    whole, in one pass over their tags. Rows are worked on alone, so nothing is shuffled.
    """

    def compute():
        return lambda texts, _: [[main_text(t) for t in texts]]

    found = with_columns(pages, {text: T.StringType()}, compute, html)
    return found.withColumn("n_chars", F.length(text).cast("long"))
