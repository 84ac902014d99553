"""Main text of web pages by two passes of block rules.

The first pass holds each block of a page against its length, its share of stop words and its share of text in links:
content, boilerplate or undecided. The second lets undecided blocks, most of them short, take the label of the nearest
decided neighbours, those in the same container being nearer than others. A short block in another language than the page
is boilerplate; blocks in another script than the stop words', and sentences on pages whose long blocks are in none of their
languages, are held against length and links alone.

What a page says of its elements (a navigation, an advert's class, an article) moves these thresholds, as far as the
blocks bear it out. In a marked article sentences need no length, and an undecided block has a content neighbour three
blocks away. What is marked as boilerplate, or lies outside a marked article, has to amount to an article by itself, with
ten times the prose of the rest; then the marks mislead, and the page, or the containers with that prose, are decided
without them. Only readers' comments and hidden text, which read like content, are what they are marked as.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import pick

SHORT, MOST_LINKS, MOST_LINKS_SHORT, STOP_LOW, STOP_HIGH = 70, 0.5, 0.3, 0.15, 0.3
#: A page's long blocks in Latin script have a lower share of stop words if they are in another language; where stop words say nothing, content has so few links.
STOP_OTHER, FEW_LINKS = 0.1, 0.2
#: So many more stop words of another language than of the page's make a short block a foreign one.
FOREIGN = 2
#: Prose in code points that makes an article, and how many times the rest of the page's it has to be to outweigh marks.
ARTICLE, OUTWEIGH = 1_000, 10
#: In steps between blocks: how much farther a neighbour in another container is, and how far the content that a mark stands for.
ACROSS, MARK_AWAY = 3, 3

# Function words of four languages, and HTML's own element names.
ENGLISH = frozenset(
    """a about all an and are as at be but by can for from had has have he her his i if in is it its not of on or our she so
    that the their there they this to was we were which who will with you""".split()
)
GERMAN = frozenset(
    """aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist
    mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wie wird zu zum zur""".split()
)
FRENCH = frozenset(
    """a au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus
    pour qu que qui sa se ses son sont sur un une vous""".split()
)
SPANISH = frozenset(
    """a al como con de del el ella en entre era es esta este fue ha hay la las lo los más me mi muy no o para pero por que se si
    sin sobre son su sus también un una y ya""".split()
)
LANGUAGES = (ENGLISH, GERMAN, FRENCH, SPANISH)
STOP_WORDS = frozenset().union(*LANGUAGES)
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2
    h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td
    textarea tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
BOILER_TAGS = frozenset("nav footer aside form button dialog menu head".split())
WHOLE_TAGS = frozenset("html body main article".split())
BOILER_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu
    menubar breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices notification alert popup
    modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus reply
    replies respond related recommended recommendations widget toolbar pagination pager copyright legal disclaimer hidden teaser""".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
MAIN_NAMES = frozenset("article content post entry story main".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
HEADING = re.compile(r"h[1-6]$")
MARKS = """.,;:!?"'()[]{}#*$%&|<>"""
SENTENCE = re.compile(r"[.!?…]")
RIGHTS = re.compile(r"\W*(©|\(c\)|copyright\b|all rights reserved\b)", re.I)


MARKED, SURE = 1, 2


class Block:
    """A block's text, its characters in links, its marks (boiler: SURE for comments and hidden text) and its container; what
    the passes ask of it: length, words, stop words in all and by language, whether it holds a sentence's end."""

    __slots__ = ("text", "links", "boiler", "main", "heading", "box", "size", "words", "stops", "languages", "sentence", "script")

    def __init__(self, text: str, links: int, boiler: int, main: bool, heading: bool, box: int = 0):
        self.text, self.links, self.boiler, self.main, self.heading, self.box = text, links, boiler, main, heading, box
        stops = [w for w in (x.strip(MARKS).lower() for x in text.split()) if w in STOP_WORDS]
        self.size, self.words, self.stops = _size(text), len(text.split()), len(stops)
        self.languages = [sum(w in language for w in stops) for language in LANGUAGES]
        self.sentence, self.script = bool(SENTENCE.search(text)), _other_script(text)


def _kind(name: str, attributes: str, in_main: bool) -> tuple[int, bool]:
    """Whether an element says that it is boilerplate (SURE: comments, or hidden), and that it is the page's article."""
    boiler, main = int(name in BOILER_TAGS or (name == "header" and not in_main)), name in ("article", "main")
    if attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id"):
                names = {w for x in value.split() for w in (x, *re.split(r"[-_:]+", x))}
                if name in WHOLE_TAGS:
                    continue  # its names tell of what the page has, not of what it is
                if names & BOILER_NAMES or ("header" in names and not in_main):
                    boiler = max(boiler, SURE if names & COMMENT_NAMES else MARKED)
                main |= bool(names & MAIN_NAMES) and name in ("div", "section", "td")
            elif key == "role":
                boiler = max(boiler, int(value in BOILER_ROLES))
                main |= value == "main"
            elif key == "hidden" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                boiler = SURE
    return boiler, main and not boiler


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order; scripts, styles and the like leave none."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = []  # open elements: name, in boilerplate, in the article, number
    opened = 0
    text: list[str] = []
    linked: list[str] = []
    heading = False

    def flush() -> None:
        nonlocal heading
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                _, boiler, main, _ = stack[-1] if stack else ("", 0, False, 0)
                within = [number for element, _, _, number in stack if element in BLOCKS]
                out.append(Block(whole, len(" ".join("".join(linked).split())), boiler, main, heading, within[-2] if len(within) > 1 else 0))
            text.clear()
            linked.clear()

    def add(raw: str) -> None:
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            text.append(t)
            if links:
                linked.append(t)

    at, n, links = 0, len(page), 0
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if not m[2] and not page.startswith(">", at - 1):
            break  # a tag that the page's end cuts off
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCKS:
            flush()
        if name == "br":
            text.append(" ")
        elif closing:
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            if attributes.rstrip().endswith("/"):
                continue
            at = end.start() if end else n
            flush()
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # the last one of its kind ends where the next begins
                for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCKS:
                        break
            _, boiler, main, _ = stack[-1] if stack else ("", 0, False, 0)
            own_boiler, own_main = _kind(name, attributes, main)
            if not attributes.rstrip().endswith("/"):
                opened += 1
                stack.append((name, max(boiler, own_boiler), main or own_main, opened))
                if name == "a":
                    links += 1
        if name in BLOCKS:
            heading = bool(HEADING.match(name)) and not closing
            if name not in ("li",):
                links = 0 if name in ("article", "main", "body") else links
    flush()
    return out


def _size(text: str) -> int:
    """Length, with ideographs and the like, which say more each, counted twice."""
    return len(text) if text.isascii() else len(text) + sum(c >= "\u2e80" for c in text)


def _other_script(text: str) -> bool:
    letters = [c for c in text if c.isalpha()] if not text.isascii() else []
    return 2 * sum(c >= "\u0370" for c in letters) > len(letters)


def _plain(b: Block, language: int, unknown: bool) -> str:
    """A block's label by its length, stop words and links: good, bad or ? (undecided)."""
    links = b.links / len(b.text)
    foreign = max(b.languages) >= b.languages[language] + FOREIGN
    if links > MOST_LINKS or RIGHTS.match(b.text):
        return "bad"
    if b.size < SHORT or b.heading:
        return "bad" if links > MOST_LINKS_SHORT or (foreign and not b.heading) else "?"
    if b.size < 2 * SHORT and foreign:
        return "?"
    if b.stops >= STOP_HIGH * b.words or (b.stops >= STOP_LOW * b.words and links <= FEW_LINKS and b.sentence):
        return "good"
    if links <= FEW_LINKS and (b.script or (unknown and b.sentence)):
        return "good"
    return "?" if b.stops >= STOP_LOW * b.words or (links <= FEW_LINKS and b.sentence) else "bad"


def _favoured(b: Block) -> str:
    """A block's label in a marked article: what is no heading is content by a sentence's end or by few stop words."""
    if b.links > MOST_LINKS * len(b.text):
        return "bad"
    if not b.heading and (b.sentence or (b.size >= SHORT and b.stops >= STOP_LOW * b.words)):
        return "good"
    return "?"


def first_pass(blocks: list[Block]) -> tuple[list[str], list[int]]:
    """Each block's label, good, bad or ? (undecided), and the weight of its marks: 1 in an article, -1 in boilerplate or
    outside a marked article, 0 where nothing is marked or the page's prose contradicts the marks."""
    long = [b for b in blocks if not b.heading and b.size >= SHORT and b.links <= FEW_LINKS * len(b.text) and not b.script]
    native = [b for b in long if not b.boiler] or long
    told = [sum(b.languages[k] for b in native) for k in range(len(LANGUAGES))]
    language = told.index(max(told))
    unknown = sum(b.stops for b in native) < STOP_OTHER * sum(b.words for b in native)
    labels = [_plain(b, language, unknown) for b in blocks]
    prose = {"main": 0, "rest": 0, "boiler": 0}
    where = ["sure" if b.boiler == SURE else "boiler" if b.boiler else "main" if b.main else "rest" for b in blocks]
    for b, label, place in zip(blocks, labels, where):
        if label == "good" and place in prose:
            prose[place] += b.size
    main, rest, boiler = prose.values()
    trust_boiler = boiler < max(ARTICLE, OUTWEIGH * (main + rest))
    told_wrong = {b.box for b, label, place in zip(blocks, labels, where) if place == "boiler" and label == "good" and not trust_boiler}
    trust_main = "main" in where and trust_boiler and rest < max(ARTICLE, OUTWEIGH * main)
    weights = []
    for k, (b, place) in enumerate(zip(blocks, where)):
        if place == "sure" or (place == "boiler" and b.box not in told_wrong) or (place == "rest" and trust_main):
            weights.append(-1)
            labels[k] = "bad"
        elif place == "main" and trust_main:
            weights.append(1)
            labels[k] = _favoured(b)
        else:
            weights.append(0)
    return labels, weights


def second_pass(blocks: list[Block], labels: list[str], weights: list[int]) -> list[bool]:
    """Whether each block is content: decided ones are what they are; an undecided one follows the nearer of the decided
    blocks before and after it, a heading the one after it. A decided block in another container is ACROSS steps farther (the nearer of two that come out as far is taken), and
    an article's mark is a content block MARK_AWAY steps away on both sides. If both sides are as near and differ, whole
    sentences are content. A page's ends decide nothing."""
    far = len(blocks) + ACROSS + MARK_AWAY

    def nearest(order) -> dict[int, tuple[str, int]]:
        """Of each block, the label and distance of the nearest decided one that comes before it in this order."""
        out, last, of_box = {}, None, {}
        for step, k in enumerate(order):
            label, steps = "?", far
            if blocks[k].box in of_box:
                at, label = of_box[blocks[k].box]
                steps = step - at
            if last and step - last[0] + ACROSS <= steps:
                label, steps = last[1], step - last[0] + ACROSS
            if weights[k] > 0 and MARK_AWAY < steps:
                label, steps = "good", MARK_AWAY
            out[k] = label, steps
            if labels[k] != "?":
                last = of_box[blocks[k].box] = step, labels[k]
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    content = []
    for k, label in enumerate(labels):
        if label == "?":
            (up, near_up), (down, near_down) = before[k], after[k]
            if blocks[k].heading and down != "?":
                label = down
            elif up == down or near_up == near_down:
                label = up if up == down else "good" if blocks[k].sentence else "bad"
            else:
                label = up if near_up < near_down else down
        content.append(label == "good")
    return content


def classify(blocks: list[Block]) -> list[Block]:
    """Both passes; the blocks that are content."""
    return [b for b, content in zip(blocks, second_pass(blocks, *first_pass(blocks))) if content]


def main_text(page: str) -> str:
    return "\n".join(b.text for b in classify(blocks_of(page)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages(page_id, url, html).

    A null or empty page, or one without content, has an empty text; a very long one is read whole. Undecided blocks as near
    to content as to boilerplate are content if they are sentences. Repeated rows stay. An empty table gives an empty
    table; further columns take no part."""

    def run(batches):
        for batch in batches:
            texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pick(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
