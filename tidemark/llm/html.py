"""HTML extraction by maximum-scoring subsequence.

A page is read as one sequence of words and tags. Words score positive in blocks of forms that the content of
labelled pages has, negative in those outside it (by length, share of links and whether a heading holds them,
unless an element like article is around them) and slightly negative below elements that were seen
outside; tags score negative, by how rarely they were seen inside. A linear scan finds the contiguous
region with the highest sum; its blocks, without those enclosed by boilerplate elements, are the main text.

What a block says decides nothing, so wording and language do not matter. Notices, rights lines, tag lists
and comments without a telling element or class are left out by where they stand: the core of a page is the
innermost element that holds most of its unlinked words, and a region that goes beyond it pays a part of the
core's words, so it does so only for as much text again.

The weights are log ratios of counts inside and outside the content, taken over labelled pages: a
bounded sample of the table's pages that mark their article, and generated pages with the usual
menus, headers, sidebars, notices, adverts, forms and comments, with and without telling classes. The price of
leaving the core is the one with which most labelled pages come out right.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, short_batches

# Elements whose content is not text, that end themselves, and that do not break a block.
RAW = ("script", "style", "textarea", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that do not break a block either.
FLOWS = INLINE | frozenset("annotation annotation-xml canvas iframe maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover noscript object semantics svg template path g circle rect line polyline polygon ellipse use defs".split())
#: Elements that may mark the content by their names.
MARKING = ("article", "main")
#: Elements shown apart from the text or not at all, up to their end tags; without one they hold nothing.
HIDDEN = ("svg", "template", "iframe")
#: A start tag on the left ends an open element named on the right.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BREAKS_OUT = frozenset("b big body br center code dd dt em embed head html i img label button input li meta nobr ruby s small span strike strong sub sup tbody td th thead tr tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
HIDES, UNQUOTED_SLASH = re.compile(rf"<(?:{'|'.join(HIDDEN)})[\s/>]", re.IGNORECASE), re.compile(r"=\s*[^\s\"'>]*/\Z")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
WORDS_OF = re.compile(r"[A-Za-z]{2,}")
#: Headings, and words of a block below which it counts as short.
HEADINGS, SHORT = frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), 10
#: The core of a page is the innermost element with so large a part of its unlinked words and so many blocks.
CORE_PART, CORE_BLOCKS = 0.6, 3
#: It is widened to an element with the page's first heading if that adds so large a part of its words at most, or so many words.
WIDEN_PART, WIDEN_WORDS = 0.1, 30


def self_closed(attributes: str | None) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value."""
    return bool(attributes) and attributes.endswith("/") and not UNQUOTED_SLASH.search(attributes)


class Token(tuple):
    """A piece of markup: where it starts and ends, whether it closes, its name ('' of what is skipped) and attributes."""

    start, end, closing, name, attributes = (property(lambda self, i=i: self[i]) for i in range(5))


def tokens_of(html: str) -> Iterator[Token]:
    """Comments, declarations, raw elements with their text, and tags, in one pass that only moves forward."""
    at, ends = 0, {}
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            token = Token((at, end + 3 if end >= 0 else len(html), False, "", ""))
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            token = Token((at, end + 1 if end >= 0 else len(html), False, "", ""))
        elif m := TAG.match(html, at):
            name = m.group(2).lower()
            if name in RAW_END and not m.group(1):
                # Once no end tag follows, none follows any later start tag.
                found = None if ends.get(name) == "none" else RAW_END[name].search(html, m.end())
                if found is None:
                    ends[name] = "none"
                token = Token((at, found.end() if found else len(html), False, "", ""))
            else:
                token = Token((at, m.end(), bool(m.group(1)), name, m.group(3)))
        else:
            at += 1
            continue
        yield token
        at = token.end


def hidden(tokens: list[Token]) -> dict[int, tuple[int, int]]:
    """By the place of a hidden element's start tag, the place of the tag and the offset at which the page goes on.

    An svg has no end tag behind a tag that only a page can hold, unless that is inside its foreignObject.
    """
    ends, starts, inside = {}, {name: [] for name in HIDDEN}, Counter()
    for i, t in enumerate(tokens):
        name, closing = t.name, t.closing
        if starts["svg"] and (name in BREAKS_OUT or name in CLOSES_P or (closing and name in INLINE)) and not inside["foreignobject"] and not (closing and inside[name]):
            ends |= {x: (x + 1, tokens[x].end) for x in starts["svg"]}
            starts["svg"].clear()
        if name in HIDDEN and closing and starts[name]:
            ends[starts[name][0] if name == "iframe" else starts[name].pop()] = (i + 1, t.end)
            if name == "iframe":  # what it holds is no markup
                starts[name].clear()
        elif name in HIDDEN and not closing:
            if self_closed(t.attributes):
                ends[i] = (i + 1, t.end)
            else:
                starts[name].append(i)
        elif starts["svg"] and name and not self_closed(t.attributes):
            inside[name] = max(0, inside[name] + (-1 if closing else 1))
        if not starts["svg"]:
            inside.clear()
    return {i: (i + 1, tokens[i].end) for x in starts.values() for i in x} | ends


def events(html: str) -> Iterator[tuple[str, int, str, str]]:
    """(kind, offset, name or text, attributes); kind is text, open or close. Comments, declarations, raw and hidden elements are skipped."""
    tokens = list(tokens_of(html))
    at, until, over = 0, 0, hidden(tokens) if HIDES.search(html) else {}
    foreign = 0
    for i, t in enumerate(tokens):
        if i < until:
            continue
        if t.start > at:
            yield "text", at, html[at : t.start], ""
        at = t.end
        if i in over:
            until, at = over[i]
        elif name := t.name:
            yield "close" if t.closing else "open", t.start, name, t.attributes
            # A slash closes math and what is in it, and no other element.
            slash = not t.closing and self_closed(t.attributes) and (name == "math" or foreign > 0) and name not in VOID
            if slash:
                yield "close", t.start, name, ""
            elif name == "math":
                foreign = max(0, foreign + (-1 if t.closing else 1))
            elif name in CLOSES_P:
                foreign = 0
    if at < len(html):
        yield "text", at, html[at:], ""


def keys_of(name: str, attributes: str) -> tuple[str, ...]:
    """What an element is known by: its name, and the words of its class, id and role."""
    if "=" not in attributes:
        return (name,)
    words = {w.lower() for m in NAMED.finditer(attributes) for w in WORDS_OF.findall(m.group(2) or m.group(3) or m.group(4) or "")}
    return (name, *(f".{w}" for w in sorted(words)))


class Open:
    """The open elements, each with its keys and a value carried down from its parent."""

    def __init__(self, root):
        self.stack, self.count = [("", (), root)], Counter()

    @property
    def value(self):
        """The value at the innermost open element."""
        return self.stack[-1][2]

    def pop_to(self, name: str) -> list[tuple[str, ...]]:
        """Closes the innermost ``name`` with all it holds; the keys of what was closed."""
        gone = []
        while self.count[name]:
            last, keys, _ = self.stack.pop()
            self.count[last] -= 1
            gone.append(keys)
            if last == name:
                break
        return gone

    def start(self, name: str) -> None:
        """Closes what a start tag ends by itself."""
        if name in CLOSES_P and self.count["p"] and self.stack[-1][0] in ("p", *INLINE):
            self.pop_to("p")
        for other in ENDS.get(name, ()):
            if self.stack[-1][0] == other or (self.count[other] and self.stack[-1][0] in INLINE):
                self.pop_to(other)

    def push(self, name: str, keys: tuple[str, ...], value) -> None:
        """Opens an element."""
        self.stack.append((name, keys, value))
        self.count[name] += 1


@dataclass(frozen=True)
class Weights:
    """Log ratios inside over outside of words below a key, of tags with a key and of words in a form of block, and
    the part of the core's words that leaving it costs."""

    below: dict[str, float]
    tags: dict[str, float]
    forms: dict[str, float]
    leave: float = 0.35
    boilerplate: float = -1.0
    content: float = 3.0

    def word(self, form: str) -> float:
        """Score of a word in a form of block, between -1 and 1; 1 for forms not seen."""
        return max(-1.0, min(1.0, self.forms.get(form, 1.0)))

    def tag(self, keys: tuple[str, ...]) -> float:
        """Score of a tag, between -4 and -0.05."""
        return min(-0.05, max(-4.0, min(self.tags.get(k, -0.2) for k in keys)))

    def marks(self, keys: tuple[str, ...]) -> bool:
        """True for elements whose words were nearly all seen inside the content: how blocks in them open means nothing."""
        return any(self.below.get(k, 0.0) > self.content for k in keys if k[0] == "." or k in MARKING)

    def clean(self, keys: tuple[str, ...]) -> bool:
        """False for elements whose words were mostly seen outside the content; inline ones go with their block."""
        return all(self.below.get(k, 0.0) > self.boilerplate for k in keys[keys[0] in INLINE :])


def generated_pages(n: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Labelled pages: html and the offset ranges of its content."""
    rng = random.Random(seed)
    say = lambda a, b: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(rng.randint(a, b)))
    links = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(k)) + "</ul>"
    outside = (
        lambda: f"<nav>{links(6)}</nav>", lambda: f'<div class="menu">{links(5)}</div>', lambda: f'<div id="navigation" role="navigation">{links(5)}</div>', lambda: f'<header><a href="/">{say(1, 3)}</a><p>{say(2, 8)}</p></header>', lambda: f'<div class="header banner">{say(2, 8)}</div>',
        lambda: f'<aside><h3>{say(1, 3)}</h3><p>{say(8, 30)}</p>{links(4)}</aside>', lambda: f'<div class="sidebar"><p>{say(8, 30)}</p></div>', lambda: f'<div class="ad">{say(3, 30)}</div>', lambda: f'<div class="ads advert advertisement sponsored promo">{say(3, 30)}</div>', lambda: f'<div class="cookie cookies consent notice banner"><p>{say(6, 25)}</p><button>{say(1, 2)}</button></div>',
        lambda: f"<form><label>{say(1, 2)}</label><input name='q'><button>{say(1, 1)}</button></form>", lambda: f'<div class="newsletter subscribe signup popup modal"><p>{say(4, 20)}</p></div>', lambda: f'<section class="comments" id="comments"><h2>{say(1, 2)}</h2>' + "".join(f'<div class="comment reply"><p>{say(5, 30)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
        lambda: f"<footer>&copy; {say(2, 20)}</footer>", lambda: f'<div class="footer copyright">{say(2, 12)}</div>', lambda: f'<div class="share social"><a href="#">{say(1, 2)}</a></div>', lambda: f'<div class="related recommended">{links(4)}</div>', lambda: f'<div class="breadcrumb breadcrumbs pagination">{links(3)}</div>', lambda: f'<dialog><p>{say(4, 12)}</p></dialog>',
    )
    # The same kinds of things in elements whose names say nothing.
    plain = (
        lambda: f"<div>{links(5)}</div>", lambda: f"<p>{say(2, 12)}</p>", lambda: f"<div>{say(1, 1)} <a href='/t'>{say(1, 1)}</a> {say(1, 2)}</div>", lambda: f"<p>{say(1, 6)}</p>",
        lambda: f"<div><h3>{say(1, 3)}</h3>" + "".join(f"<div><b>{say(1, 2)}</b><p>{say(3, 15)}</p></div>" for _ in range(rng.randint(1, 3))) + "</div>", lambda: f"<div><p>{say(2, 14)}</p></div>", lambda: f"<p><a href='/'>{say(1, 3)}</a> <a href='/b'>{say(1, 3)}</a> <a href='/c'>{say(1, 3)}</a></p>",
    )
    blocks = (
        lambda: f"<p>{say(10, 60)}</p>", lambda: f"<p>{say(5, 20)} <b>{say(1, 3)}</b> <a href='/x'>{say(1, 3)}</a> {say(5, 20)}</p>", lambda: f"<h2>{say(2, 6)}</h2>", lambda: "<ul>" + "".join(f"<li>{say(3, 15)}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote><p>{say(6, 20)}</p></blockquote>",
        lambda: f"<p>{say(3, 9)}<br>{say(3, 9)}</p>", lambda: f"<div>{say(10, 40)}</div>", lambda: f"<pre>{say(4, 12)}</pre>", lambda: "<table>" + "".join(f"<tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr>" for _ in range(3)) + "</table>", lambda: f"<figure><img src='x'><figcaption>{say(2, 8)}</figcaption></figure>", lambda: f"<section><h3>{say(1, 4)}</h3><p>{say(10, 40)}</p></section>",
    )
    around = (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content post entry">', "</div>"), ('<div id="main" role="main">', "</div>"), ("<div>", "</div>"), ("", ""))
    pages = []
    for _ in range(n):
        head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{say(2, 6)}</title></head><body>" + "".join(rng.choice(outside)() for _ in range(rng.randint(1, 4))) + (rng.choice(plain)() if rng.random() < 0.3 else "")
        before, after = rng.choice(around)
        parts = [rng.choice(blocks)() for _ in range(rng.randint(2, 12))]
        if rng.random() < 0.1:  # an article of two elements side by side
            before, after, cut = "<div>", "</div>", rng.randint(1, len(parts))
            parts = [*parts[:cut], "</div><div>", *parts[cut:]]
        body = f"{before}<h1>{say(2, 7)}</h1>" + "".join(parts)
        ranges, html = [(len(head), len(head) + len(body))], head + body
        if rng.random() < 0.4:
            html += rng.choice(outside)()
            more = "".join(rng.choice(blocks)() for _ in range(rng.randint(2, 6)))
            ranges.append((len(html), len(html) + len(more)))
            html += more
        pages.append((html + after + (rng.choice(plain)() if rng.random() < 0.3 else "") + "".join(rng.choice(outside)() for _ in range(rng.randint(1, 4))) + "</body></html>", ranges))
    return pages


def article_ranges(html: str) -> list[tuple[int, int]]:
    """Offset ranges of the article elements, for pages that mark them."""
    return [(m.start(), m.end()) for m in re.finditer(r"<article\b.*?(?:</article\s*>|\Z)", html, re.DOTALL | re.IGNORECASE)]


def form_of(words: int, linked: int, heading: bool) -> str:
    """The form of a block: whether links hold most of its words or some, whether a heading holds it, and its length."""
    links = "links" if 2 * linked > words else "some links" if linked else "text"
    return f"{links}, heading" if heading else f"{links}, short" if words < SHORT else links


class Block:
    """A run of text between tags that break blocks: its parts, number of words and of linked ones, whether
    it is shown, whether an element around it marks the content and whether a heading holds it."""

    def __init__(self, state: tuple[bool, bool, int]):
        (self.shown, self.marked, self.element), self.parts, self.linked, self.words, self.heading = state, [], 0, 0, False

    def form(self, core: list[bool] | None) -> str:
        """How the block looks and whether it lies in the page's core, whatever it says."""
        return form_of(self.words, self.linked, self.heading) + ("" if core is None else ", core" if core[self.element] else ", beyond")


class Tree:
    """The elements of a page in the order of their start tags: the parent, own unlinked words and blocks, and name of each."""

    def __init__(self):
        self.parents, self.words, self.blocks, self.names = [-1], [0], [0], [""]

    def add(self, parent: int, name: str) -> int:
        """A new element's number."""
        self.parents.append(parent)
        self.words.append(0)
        self.blocks.append(0)
        self.names.append(name)
        return len(self.parents) - 1

    def core(self) -> tuple[list[bool] | None, int]:
        """Whether each element is in the core, and the core's words; None where the whole page is."""
        words, blocks, first = list(self.words), list(self.blocks), {}
        for i in range(len(words) - 1, 0, -1):
            words[self.parents[i]] += words[i]
            blocks[self.parents[i]] += blocks[i]
        for i, name in enumerate(self.names):
            if name in ("h1", "h2") and words[i]:
                first.setdefault(name, i)
        core = 0
        for i in range(1, len(words)):
            if self.parents[i] == core and words[i] >= CORE_PART * words[0] and blocks[i] >= CORE_BLOCKS:
                core = i
        heading = first.get("h1", first.get("h2"))
        above = set()
        while heading is not None and heading >= 0:
            above.add(heading)
            heading = self.parents[heading]
        wider = core
        while above and wider not in above:
            wider = self.parents[wider]
        if words[wider] - words[core] <= max(WIDEN_WORDS, WIDEN_PART * words[core]):
            core = wider
        if core == 0:
            return None, words[0]
        inside = [False] * len(words)
        for i in range(1, len(words)):
            inside[i] = i == core or inside[self.parents[i]]
        return inside, words[core]


def walk(html: str, clean, marks, note) -> tuple[list[Block], Tree]:
    """Blocks of a page in order, and its elements. ``clean(keys)`` says whether an element is shown, ``marks(keys)`` whether it
    marks the content; ``note(kind, at, value)`` is told of every tag, by its keys and whether what follows is shown, and of every text, by
    (block, words, open elements)."""
    tree = Tree()
    blocks, open_, counted = [Block((True, False, 0))], Open((True, False, 0)), -1
    for kind, at, name, attributes in events(html):
        if kind == "text":
            n, state = len(name.split()), open_.value
            if not n and not blocks[-1].parts:
                continue
            if blocks[-1].shown != state[0]:
                blocks.append(Block(state))
            block, linked = blocks[-1], open_.count["a"] > 0
            if not block.words:
                block.element = state[2]
            block.parts.append(name)
            block.words += n
            block.linked += n * linked
            if n:
                block.heading = any(open_.count[h] for h in HEADINGS)
                if state[0] and not linked:
                    tree.words[state[2]] += n
                    tree.blocks[state[2]] += counted != len(blocks)
                    counted = len(blocks)
                note("text", at, (len(blocks) - 1, n, open_))
            continue
        if kind == "open":
            keys = keys_of(name, attributes)
            open_.start(name)
            if name not in VOID:
                shown, marked, element = open_.value
                open_.push(name, keys, (shown and clean(keys), marked or marks(keys), tree.add(element, name)))
        else:
            closed = open_.pop_to(name)
            keys = closed[-1] if closed else (name,)
        note(kind, at, (keys, open_.value[0]))
        if name == "br":
            if open_.value[0] and blocks[-1].parts:
                blocks[-1].parts.append(" ")
        elif name not in FLOWS:
            if blocks[-1].parts:
                blocks.append(Block(open_.value))
            else:
                blocks[-1].shown, blocks[-1].marked = open_.value[:2]
    return blocks, tree


#: Parts of the core's words tried as the price of leaving it.
PRICES = (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)


def fit(pages: list[tuple[str, list[tuple[int, int]]]]) -> Weights:
    """Weights from labelled pages: (html, offset ranges of the content)."""
    words, tags, forms = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())
    for html, ranges in pages:
        inside = lambda at, ranges=ranges: any(a <= at < b for a, b in ranges)
        texts = []

        def note(kind, at, value, inside=inside, texts=texts):
            if kind == "text":
                block, n, open_ = value
                texts.append((block, n, inside(at), {k for _, keys, _ in open_.stack for k in keys}))
            elif kind == "open":
                for key in value[0]:
                    tags[inside(at)][key] += 1

        blocks, tree = walk(html, lambda keys: True, lambda keys: False, note)
        core, _ = tree.core()
        for block, n, within, keys in texts:
            for key in keys:
                words[within][key] += n
            forms[within][blocks[block].form(core)] += n
    share = [max(1, sum(c.values())) for c in tags]
    below = {k: math.log((words[1][k] + 1) / (words[0][k] + 1)) for k in words[0].keys() | words[1].keys()}
    ratio = lambda c, k, of: math.log((c[1][k] + 1) / of[1] / ((c[0][k] + 1) / of[0]))
    all_words = [max(1, sum(c.values())) for c in forms]
    shapes = {k: ratio(forms, k, all_words) for k in forms[0].keys() | forms[1].keys()}
    weights = Weights(below, {k: ratio(tags, k, share) for k in tags[0].keys() | tags[1].keys()}, shapes | {f"text{where}": 1.0 for where in ("", ", core", ", beyond")})
    read = [(scan(html, weights), sum(b - a for a, b in ranges), ranges) for html, ranges in pages[:: max(1, len(pages) // PRICED)]]
    return replace(weights, leave=max(PRICES, key=lambda price: (sum(agrees(found.span(price), found, ranges) for found, _, ranges in read), -price)))


#: What words and tags below boilerplate cost in the scan: a part of their scores, and so much between two shown blocks at most.
ASIDE, ASIDE_MOST = 0.05, 2.0


#: Labelled pages on which prices are tried.
PRICED = 200


@dataclass
class Scan:
    """A page as steps: (block, words, whether in the core) of text, or -1 and a tag's score, or -2 and that of a tag not shown;
    its blocks, their scores a word, the core's words, and where each block's text begins."""

    steps: list[tuple[int, float, bool]]
    blocks: list[Block]
    scores: list[float]
    core: int
    starts: dict[int, int]

    def span(self, leave: float) -> tuple[int, int] | None:
        """First and last block of the region with the highest sum."""
        here, first, best, span, aside, inside = 0.0, 0, 0.0, None, 0.0, None
        for block, amount, core in self.steps:
            if block == -1:
                here += amount
            elif block == -2 or not self.blocks[block].shown:
                cost = min(ASIDE * abs(amount), ASIDE_MOST - aside)
                here, aside = here - cost, aside + cost
            else:
                aside = 0.0
                if inside is not None and inside != core and not self.blocks[block].marked:
                    here -= leave * self.core
                inside = core
                if here <= 0:
                    here, first = 0.0, block
                here += self.scores[block] * amount
                if here > best:
                    best, span = here, (first, block)
        return span


def scan(html: str, weights: Weights) -> Scan:
    """Reads a page once, forward."""
    steps: list[tuple[int, float, int]] = []
    starts: dict[int, int] = {}

    def note(kind, at, value):
        if kind == "text":
            starts.setdefault(value[0], at)
            steps.append((value[0], float(value[1]), value[2].value[2]))
        else:
            steps.append((-1 if value[1] else -2, weights.tag(value[0]), 0))

    blocks, tree = walk(html, weights.clean, weights.marks, note)
    inside, core = tree.core()
    scores = [0.0 if not b.shown or not b.words else 1.0 if b.marked else weights.word(b.form(inside)) for b in blocks]
    return Scan([(b, amount, inside is None or inside[e]) for b, amount, e in steps], blocks, scores, core if inside else 0, starts)


def agrees(span: tuple[int, int] | None, found: Scan, ranges: list[tuple[int, int]]) -> bool:
    """Whether a region takes just the blocks of the content, of those that are shown."""
    wanted = {b for b, at in found.starts.items() if any(x <= at < y for x, y in ranges)}
    return {b for b in found.starts if found.blocks[b].shown and span and span[0] <= b <= span[1]} == wanted


def extract(html: str | None, weights: Weights) -> str:
    """The main text: blocks of the best region, one per line."""
    if not html:
        return ""
    found = scan(html, weights)
    span = found.span(weights.leave)
    if span is None:
        return ""
    lines = (" ".join(unescape("".join(b.parts)).split()) for b in found.blocks[span[0] : span[1] + 1] if b.shown)
    return "\n".join(line for line in lines if line)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_rows: int = 300, generated: int = 300, seed: int = 3) -> Weights:
    """Weights from ``generated`` pages and at most ``sample_rows`` of the table's, of up to 50,000 characters, that mark their article."""
    narrow = pages.select(F.col(id_col).alias("i"), F.col(html_col).cast("string").alias("text"))
    got = sorted((r.i, r.text) for r in bounded_sample(narrow, "i", sample_rows, seed, 50_000).collect())
    own = [(html, ranges) for _, html in got if (ranges := article_ranges(html))]
    return fit(own + generated_pages(generated, seed))


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page's id, url, text and n_chars from its whole html; no shuffle. Null or empty html, and pages
    without content, give an empty text; a very long page is read whole, in time proportional to it; repeated rows
    have the same text; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    short_batches(pages.sparkSession)
    narrow = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(run, f"{id_col} {narrow.schema[0].dataType.simpleString()}, {url_col} {narrow.schema[1].dataType.simpleString()}, text string, n_chars long")
