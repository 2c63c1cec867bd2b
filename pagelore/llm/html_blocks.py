"""Main text of a web page by two passes over its blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Frequent function words of the languages that pages are expected in.
STOP_WORDS = frozenset(
    (
        # English
        "the of and to in a is it that for was on are as with be at by this from or an not have had he his they "
        "but we you she which were been has their will would there who can all more if one about when its into "
        # French
        "le la les de des du et un une en est que qui dans pour pas sur au par avec ne se ce il elle on ou mais "
        "sont plus son sa ses aux cette comme nous vous ils "
        # German
        "der die das und ist nicht ein eine zu den von mit sich des auf für im dem es auch als an er hat aus bei "
        "nach wird sie wie war sind oder aber noch nur um einen einer eines einem zum zur "
        # Spanish
        "el los las y que del se por con una su para es al lo como más o pero sus ha me si sin sobre este ya "
        "entre cuando todo esta ser son dos también fue había era muy"
    ).split()
)

# Elements that begin a block, that hold no text, that are not the article.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style title textarea xmp noembed noframes".split())
SIDE_TAGS = frozenset(
    "nav footer aside form menu dialog noscript template iframe object svg math select button head search "
    "datalist canvas audio video".split()
)
MAIN_TAGS = frozenset(["article", "main"])
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

# Words of class, id and role names of what surrounds an article.
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail widget widgets header masthead footer "
    "foot copyright cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter "
    "subscribe subscription signup login search share sharing social related recommended recommendations "
    "pagination pager toolbar toc disclaimer legal form contentinfo complementary".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies reply reactions discussion".split())

# Names of what holds an article, and words that turn a name round (``with-sidebar``).
MAIN_NAMES = frozenset("content main article post entry story body text page prose".split())
TURNING = frozenset("with has no without not".split())

# Thresholds of the first pass.
LONG_CHARS = 200
SHORT_CHARS = 70
MANY_STOP_WORDS = 0.2
SOME_STOP_WORDS = 0.1
MOST_LINKED = 0.4
_LAST_LATIN = "\u024f"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    # A value in quotes ends at its closing quote, however far that is; without one in the
    # rest of the page the quote is a character like others.
    r"(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+(?:>|\Z))"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
# Attributes with their values; a value can hold what looks like attributes.
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE) for tag in RAW_TAGS}


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    side: bool
    main: int  # number of the article or main element it is in, 0 for none
    hint: int  # number of the element whose name speaks against it, 0 for none
    parent: int
    label: str = ""


@dataclass
class _Element:
    tag: str
    number: int
    side: bool = False
    comment: bool = False
    main: int = 0
    hint: int = 0


@dataclass
class Names:
    """What the attributes of an element tell."""

    side: bool = False  # a name of what surrounds an article is among its names
    plainly: bool = False  # one of its names is made of nothing else
    main: bool = False
    comment: bool = False
    hidden: bool = False


def names_of(attributes: str, with_id: bool) -> Names:
    found = Names()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden":
            found.hidden = True
        elif name == "style":
            found.hidden |= _HIDDEN_STYLE.search(value) is not None
        elif name in ("class", "role") or (name == "id" and with_id):
            for one in value.split():
                words = {w.lower() for w in _NAME_WORD.findall(one)}
                if not words or words & TURNING:
                    continue
                found.side |= bool(words & SIDE_NAMES)
                found.plainly |= words <= SIDE_NAMES
                found.main |= bool(words & MAIN_NAMES)
                found.comment |= bool(words & COMMENT_NAMES)
    return found


@dataclass
class _Reader:
    """Blocks of a page in order; knows the elements that are open."""

    blocks: list[Block] = field(default_factory=list)
    open: list[_Element] = field(default_factory=lambda: [_Element("", 0)])
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    heading: bool = False
    numbers: int = 0
    # Of the paragraph or heading that is open: whether it is hidden, and whether its names speak against it.
    hidden: bool = False
    named: int = 0

    def text(self, piece: str) -> None:
        self.pieces.append(piece)
        if self.links:
            self.linked += len("".join(unescape(piece).split()))

    def end_block(self) -> None:
        text = " ".join(unescape("".join(self.pieces)).split()) if self.pieces else ""
        if text:
            at = self.open[-1]
            side, hint = at.side or self.hidden, at.hint or self.named
            self.blocks.append(Block(text, self.linked, self.heading, side, at.main, hint, at.number))
        self.pieces, self.linked = [], 0
        self.hidden, self.named = False, 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag == "a":
            self.links = 1
        if tag not in BLOCK_TAGS and tag not in SIDE_TAGS:
            return
        self.end_block()
        if tag in HEADINGS:
            self.heading = True
        if tag in VOID_TAGS or attributes.endswith("/>"):
            return
        above = self.open[-1]
        self.numbers += 1
        names = names_of(attributes, tag not in MAIN_TAGS) if len(attributes) > 1 else Names()
        if tag == "p" or tag in HEADINGS:
            self.hidden = names.hidden or names.comment or (names.plainly and above.main > 0)
            self.named = self.numbers if names.plainly else 0
            return
        if tag == "li":
            # An item ends the one before it in the same list.
            self.close_until("li", ("ul", "ol", "menu", "dir"))
            above = self.open[-1]
        element = _Element(tag, self.numbers, above.side or names.hidden, above.comment, above.main, above.hint)
        if names.comment:
            element.comment = element.side = True
        elif tag in MAIN_TAGS and not element.comment:
            element.main, element.side = self.numbers, names.hidden
            element.hint = self.numbers if names.plainly else 0
        elif tag in ("body", "html"):
            pass
        elif tag in SIDE_TAGS or (tag == "header" and not above.main) or (names.plainly and above.main):
            element.side = True
        elif names.side and (names.plainly or not names.main):
            element.hint = above.hint or self.numbers
        self.open.append(element)

    def close_until(self, tag: str, within: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag not in BLOCK_TAGS and tag not in SIDE_TAGS:
            return
        self.end_block()
        if tag in HEADINGS:
            self.heading = False
        elif tag != "p":
            # A stray end tag inside an article does not close what is around the article.
            self.close_until(tag, () if tag in MAIN_TAGS or tag in ("body", "html") else tuple(MAIN_TAGS))


def blocks_of(html: str) -> list[Block]:
    reader = _Reader()
    at = 0
    while True:
        found = _TOKEN.search(html, at)
        if found is None:
            break
        if found.start() > at:
            reader.text(html[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["close"]:
            reader.end(tag)
        elif tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                reader.end_block()
            end = _END[tag].search(html, at)
            at = len(html) if end is None else end.end()
        else:
            reader.start(tag, found["attributes"])
    if at < len(html):
        reader.text(html[at:])
    reader.end_block()
    return reader.blocks


def first_pass(block: Block) -> str:
    """``good``, ``bad``, or nothing for a block that cannot be told by itself.

    Bad: in a part of the page that is not the article, or mostly links, or short where a
    name speaks against it. Good: long or
    rich in stop words, or of some length in a script that none of them is written in.
    A name does not settle a long block; its neighbours do.
    Any other block is left to its neighbours: that it has no stop words may be its
    language, or that it is code, a table or a list of names.
    """
    text = block.text
    if block.side or block.linked > MOST_LINKED * len(text):
        return "bad"
    words = [w.strip(".,;:!?\"'()«»“”¿¡").lower() for w in text.split()]
    density = sum(w in STOP_WORDS for w in words) / len(words)
    is_good = (len(text) >= LONG_CHARS and density >= SOME_STOP_WORDS) or (
        len(text) >= SHORT_CHARS and density >= MANY_STOP_WORDS
    )
    if not is_good and len(text) >= SHORT_CHARS and density < SOME_STOP_WORDS:
        letters = sum(map(str.isalpha, text))
        is_good = 2 * sum(c > _LAST_LATIN and c.isalpha() for c in text) > letters
    if block.hint:
        return "" if is_good and len(text) >= LONG_CHARS else "bad"
    return "good" if is_good else ""


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided neighbours; what a name decided is no neighbour.

    Those in an article element look only at neighbours in it, and are good if there is
    none. So do those of a page without such an element, all of which are good if no
    block of it surely is: then nothing tells them from the article. Elsewhere, in a page
    that has one, a block without neighbours is bad. Two neighbours that differ are settled by which of them has the same
    parent, then by which is nearer; a heading goes with what follows, else bad wins.
    """
    has_main = any(block.main and not block.side for block in blocks)
    if not has_main and not any(block.label == "good" for block in blocks):
        for block in blocks:
            block.label = block.label or "good"
        return
    before: list[int | None] = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        before.append(last.get(block.main))
        if block.label and not block.hint and (has_main or not block.side):
            last[block.main] = i
    last = {}
    for i in range(len(blocks) - 1, -1, -1):
        block = blocks[i]
        if block.label:
            if not block.hint and (has_main or not block.side):
                last[block.main] = i
            continue
        near = [j for j in (before[i], last.get(block.main)) if j is not None]
        if block.main:
            near = [j for j in near if not blocks[j].side]
        labels = {blocks[j].label for j in near}
        if not near:
            chosen = "good" if block.main else "bad"
        elif len(labels) == 1:
            chosen = labels.pop()
        elif block.heading:
            chosen = blocks[near[-1]].label
        else:
            same = [j for j in near if blocks[j].parent == block.parent]
            far = [abs(i - j) for j in near]
            if len(same) == 1:
                chosen = blocks[same[0]].label
            elif far[0] != far[1]:
                chosen = blocks[near[far.index(min(far))]].label
            else:
                chosen = "good" if block.main else "bad"
        blocks[i].label = chosen + "?"
    for block in blocks:
        block.label = block.label.rstrip("?")


def main_text(html: str) -> str:
    """The good blocks, in order, one line each."""
    blocks = blocks_of(html)
    for block in blocks:
        block.label = first_pass(block)
    second_pass(blocks)
    # Where a name spoke against a part that turned out good, it holds no less of the article.
    good = {b.hint for b in blocks if b.hint and b.label == "good"}
    for block in blocks:
        if block.hint in good and not block.side and block.linked <= MOST_LINKED * len(block.text):
            block.label = "good"
    return "\n".join(b.text for b in blocks if b.label == "good")
