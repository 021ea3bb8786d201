"""Operator 3, main text of HTML pages: two-pass block rules over stop-word density, length and link density."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from quillmesh.llm.common import add_columns, read_table

#: Characters of blocks: shorter ones are left to their neighbours, longer ones may be good by themselves.
SHORT_CHARS, LONG_CHARS = 70, 200
MAX_LINK_DENSITY, LOW_STOPWORDS, HIGH_STOPWORDS = 0.2, 0.10, 0.20
#: Below this share of listed words in a page's longer blocks, its language is taken as one that the list does not know.
UNLISTED = 0.05

# fixed values: frequent function words of the corpus languages
STOPWORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their
    they this to was were which will with you we i if so no can all would there what about into more
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch
    le la les de des du un une et à en est que qui dans pour par sur avec ne pas plus au aux se ce il elle sont son sa ses
    ou mais comme nous vous ils leur cette être
    el los las y a que del se por con para una su al lo como más pero sus este ha o si porque esta entre cuando muy sin
    sobre también me hasta hay donde no es en""".split()
)
# fixed values: HTML element names
BLOCKS = frozenset(
    """address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
    section select summary table tbody td tfoot th thead title tr ul""".split()
)
DROPPED = frozenset("script style noscript template svg math head title select option button textarea form nav aside footer iframe object canvas dialog menu label input audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements whose end tag another start tag implies, by group: (members, elements that keep outer members out of reach).
IMPLIED = {
    "item": (frozenset(["li"]), BLOCKS - {"address", "div", "p", "li"}),
    "entry": (frozenset(["dt", "dd"]), BLOCKS - {"address", "div", "p", "dt", "dd"}),
    "cell": (frozenset(["td", "th"]), frozenset(["tr", "table", "thead", "tbody", "tfoot"])),
    "row": (frozenset(["tr"]), frozenset(["table"])),
    "section": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "p": (frozenset(["p"]), BLOCKS - {"p"}),
}
#: Groups that a start tag ends; the outer ones take the inner ones with them. Every block also ends an open paragraph.
_ENDS = {"li": ["item"], "dt": ["entry"], "dd": ["entry"], "td": ["cell"], "th": ["cell"], "tr": ["row", "cell"], "option": ["option"]} | dict.fromkeys(["thead", "tbody", "tfoot", "caption"], ["section", "row", "cell"])
#: Letters of scripts that put no spaces between words; one says about as much as WIDE letters of others.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
WIDE = 3
_SENTENCE = re.compile("[.!?\u2026][\"'\u00bb\u201d\u2019)]*(?:\\s|$)|[\u3002\uff01\uff1f\u0964\u06d4\u061f]")
#: Words of class, id and role values that mark what surrounds an article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adverts?|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|repl(?:y|ies)|respond|cookies?|consent|gdpr|"
    r"notices?|alert|popup|modal|overlay|sidebar|side|widget\w*|related|recommend\w*|share|sharing|social|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|masthead|topbar|toolbar|newsletter|subscribe|subscription|signup|login|search|pagination|pager|copyright|legal|"
    r"skip|tags|meta|complementary|contentinfo)(?=$|[\s_-])",
    re.I,
)
#: Class words after these say what an element has beside it, not what it is.
_BESIDE = re.compile(r"(?:^|(?<=\s))(?:with|has|no|not|without|is|js)-\S*", re.I)
#: A tag to its end; quotes count only where a value starts. Possessive, so that no character is read twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=\"']++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>")
_OPEN = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "noscript", "title", "iframe", "template", "svg")}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    marked: bool
    scope: int  # number of the innermost article or main element, 0 outside
    label: str = ""
    wrapper: int = 0  # number of the outermost element that a class, id or role alone marks, 0 outside


def tokens(source: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, value, end) of the parts of a page in one pass: kinds are text, open and close.

    Comments, declarations and an unfinished tag at the end are left out. What is inside the elements of _RAW is skipped.
    """
    at, end = 0, len(source)
    endless: set[str] = set()  # ends that were looked for and don't come any more
    while at < end:
        start = source.find("<", at)
        if start < 0:
            start = end
        if start > at:
            yield "text", "", source[at:start], start
            at = start
            continue
        if source.startswith(("<!", "<?"), at):
            close = "-->" if source.startswith("<!--", at) else "]]>" if source.startswith("<![CDATA[", at) else ">"
            stop = -1 if close in endless else source.find(close, at + (4 if close == "-->" else 2))
            if stop < 0:
                endless.add(close)
                stop = end
            if close == "]]>":
                yield "text", "", source[at + 9 : stop], stop
            at = min(end, stop + len(close))
            continue
        if not _OPEN.match(source, at):
            yield "text", "", "<", at + 1
            at += 1
            continue
        found = _TAG.match(source, at)
        if found is None:  # no end of a tag follows: the rest is markup
            return
        at, name = found.end(), found[2].lower()
        raw = _RAW.get(name)
        if raw is not None and not found[1] and not found[0].endswith("/>"):
            close = None if name in endless else raw.search(source, at)
            if close:
                at = close.end()
            else:
                endless.add(name)
                if name in ("script", "style"):
                    at = end
            yield "skipped", name, "", at
            continue
        yield "close" if found[1] else "open", name, found[3], at


def _marked_by_attributes(attributes: str) -> bool:
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = a or b or c, key.lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key not in ("style", "hidden") and MARKED.search(_BESIDE.sub("", value)):
            return True
    return False


def blocks_of(source: str) -> list[Block]:
    """Text blocks in page order. Blocks of scripts' and forms' like are never there or marked; the stack of open elements
    is read at its top alone, so that deep pages cost no more than flat ones."""
    out: list[Block] = []
    # name, dropped by its name or an outer one's, wrapper number, scope number, all as they hold inside; then for each group
    # of IMPLIED the place of the open member that a start tag would end here, or 0, so that no stack is ever searched
    stack: list[tuple[str, bool, int, int, dict[str, int]]] = [("", False, 0, 0, dict.fromkeys(IMPLIED, 0))]
    open_names: Counter[str] = Counter()
    text: list[str] = []
    links = scopes = wrappers = link_open = heading = 0

    def flush() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined:
            _, dropped, wrapper, scope, _ = stack[-1]
            out.append(Block(joined, links, heading > 0, dropped or wrapper > 0, scope, wrapper=0 if dropped else wrapper))
        text.clear()
        links = 0

    for kind, name, value, _ in tokens(source):
        if kind == "text":
            value = html.unescape(value)  # before runs are joined: a reference does not go on behind a tag
            text.append(value)
            if link_open:
                links += len("".join(value.split()))
            continue
        block = name in BLOCKS
        if block:
            flush()
        if kind == "skipped":
            continue
        if kind == "close":
            if name == "a":
                link_open = max(0, link_open - 1)
            if name in HEADINGS:
                heading = max(0, heading - 1)
            if open_names[name]:
                if not block:
                    flush()
                while True:
                    last = stack.pop()[0]
                    open_names[last] -= 1
                    if last == name:
                        break
            continue
        if name in VOID:
            continue
        if name == "a":
            link_open += 1
        if name in HEADINGS:
            heading += 1
        if not block and name not in DROPPED and "=" not in value:
            continue  # inline elements without attributes decide nothing
        for group in [*_ENDS.get(name, ()), *(["p"] if block else ())]:
            at = stack[-1][4][group]
            while at and len(stack) > at:
                open_names[stack.pop()[0]] -= 1
        _, dropped, wrapper, scope, places = stack[-1]
        framing = name in ("article", "main")
        gone = name in DROPPED or name == "header" and not scope
        soft = not gone and not framing and name not in ("html", "body") and _marked_by_attributes(value)
        if block or gone or soft:
            if not block:
                flush()
            scopes += framing
            if framing and not scope:
                wrapper = 0  # what stands around an article does not mark it
            elif soft and not wrapper:
                wrappers += 1
                wrapper = wrappers
            if block:
                places = {g: len(stack) if name in members else 0 if name in walls else places[g] for g, (members, walls) in IMPLIED.items()}
            stack.append((name, dropped or gone, wrapper, scopes if framing else scope, places))
            open_names[name] += 1
    flush()
    return out


def _width(text: str) -> int:
    """Characters of a text, letters of scripts without spaces WIDE times."""
    return len(text) + (WIDE - 1) * sum(1 for _ in _UNSPACED.finditer(text)) if not text.isascii() else len(text)


def _prose(text: str) -> bool:
    """Does a text of unlisted words read as sentences: an end of one in every 400 characters, and mostly letters?"""
    return _SENTENCE.search(text) is not None and 400 * sum(1 for _ in _SENTENCE.finditer(text)) >= len(text) and sum(map(str.isalpha, text)) >= 0.6 * len(text)


def _densities(blocks: list[Block]) -> None:
    """First pass: good, bad, near (good) or short by marks, length, stop words and links.

    Where the list of stop words does not know a page's language (they are hardly any of the words of its longer blocks,
    or its script has no words between spaces), length, links and sentences decide alone.
    """
    seen: list[tuple[Block, int, int, int]] = []
    words_, stops_ = 0, 0
    for b in blocks:
        n, words = _width(b.text), _WORD.findall(b.text.lower())
        stops = sum(w in STOPWORDS for w in words)
        if not b.marked and n >= SHORT_CHARS and b.link_chars <= MAX_LINK_DENSITY * len(b.text):
            unspaced = n - len(b.text) > len(b.text) // 2
            words_ += n // (2 * WIDE) if unspaced else len(words)
            stops_ += 0 if unspaced else stops
        seen.append((b, n, len(words), stops))
    unlisted = stops_ < UNLISTED * words_
    for b, n, count, found in seen:
        stops = found / max(1, count)
        density = b.link_chars / max(1, len(b.text))
        if b.marked or density > MAX_LINK_DENSITY or "\xa9" in b.text and n < SHORT_CHARS and not b.scope:
            b.label = "bad"
        elif n < SHORT_CHARS:
            b.label = "short"
        elif stops >= HIGH_STOPWORDS:
            b.label = "good" if n > LONG_CHARS else "near"
        elif stops >= LOW_STOPWORDS:
            b.label = "near"
        elif unlisted and n > LONG_CHARS and _prose(b.text):
            b.label = "good"
        else:
            b.label = "near" if b.scope or n > LONG_CHARS and (stops > 0 or _prose(b.text)) or unlisted and _prose(b.text) else "bad"


def classify(blocks: list[Block]) -> list[Block]:
    """Labels ``good`` or ``bad``: density rules first, then ambiguous blocks by their nearest decided neighbours.

    An article or main element is a feature beside density: a block takes labels from its own element (or from
    outside all), and one whose element decides nothing is good, unless good text elsewhere outweighs the element.
    Marks by class, id or role hold unless no other block is good by itself: then the marked element with the most
    text is the page's frame, and its mark is void.
    """
    _densities(blocks)
    if not any(b.label == "good" for b in blocks):
        size: Counter[int] = Counter()
        for b in blocks:
            if b.wrapper:
                size[b.wrapper] += len(b.text)
        frame = max(size, key=lambda k: (size[k], -k)) if size else 0
        if frame and 2 * size[frame] > sum(len(b.text) for b in blocks if b.wrapper or not b.marked):
            for b in blocks:
                b.marked &= b.wrapper != frame
            _densities(blocks)
    framed = any(b.scope and not b.marked for b in blocks)
    weak = _weak_scopes(blocks)
    decided = ["short" if b.label == "near" and b.scope in weak else b.label for b in blocks]
    back, forward = range(len(blocks)), range(len(blocks) - 1, -1, -1)
    own = _nearest(blocks, decided, back, True), _nearest(blocks, decided, forward, True)
    page = _nearest(blocks, decided, back, False), _nearest(blocks, decided, forward, False)
    for i, b in enumerate(blocks):
        if decided[i] not in ("near", "short"):
            continue
        if b.scope in weak:  # a card or teaser, or a short post between others
            b.label = "good" if page[0][i][0] == page[1][i][0] == "good" else "bad"
            continue
        (left, ldist), (right, rdist) = own[0][i], own[1][i]
        if left == right and left:
            b.label = left
        elif b.heading:  # a heading goes with what follows it
            b.label = (right or left or "good") if b.scope else page[1][i][0] or "bad"
        elif decided[i] == "near" and "good" in (left, right):
            b.label = "good"
        else:
            b.label = (left if ldist <= rdist else right) or ("good" if b.scope or decided[i] == "near" and not framed else "bad")
    return blocks


def _weak_scopes(blocks: list[Block]) -> set[int]:
    """Article and main elements without a block that is good by itself, and with less text than such blocks elsewhere."""
    size: dict[int, int] = {}
    strong = {b.scope for b in blocks if b.label == "good"}
    for b in blocks:
        if b.label != "bad":
            size[b.scope] = size.get(b.scope, 0) + len(b.text)
    good = sum(len(b.text) for b in blocks if b.label == "good")
    return {k for k, n in size.items() if k and k not in strong and n < good}


def _nearest(blocks: list[Block], decided: list[str], order: range, own: bool) -> list[tuple[str, int]]:
    """For each ambiguous block, the last decided label before it in ``order`` and its distance, in one pass.

    Near-good counts as good for short blocks. With ``own`` only labels of the block's own scope count, and in an
    article not those of marked blocks: an insertion says nothing about the text around it.
    """
    out, last = [("", len(blocks))] * len(blocks), {}
    for i in order:
        b, label = blocks[i], decided[i]
        scope = b.scope if own else 0
        if label in ("near", "short"):
            k = last.get((scope, label))
            if k is not None:
                out[i] = "bad" if decided[k] == "bad" else "good", abs(i - k)
        if label == "near":
            last[scope, "short"] = i
        elif label in ("good", "bad") and not (scope and b.marked):
            last[scope, "short"] = last[scope, "near"] = i
    return out


def main_text(source: str | None) -> str:
    """Good blocks of a page, in order, joined by one space."""
    return " ".join(b.text for b in classify(blocks_of(source or "")) if b.label == "good")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row per input row; a null or empty page has the empty text.

    Malformed pages are read on: an unmatched end tag is skipped, open elements end with the page, a tag without an end
    is the last thing read. Time grows in proportion to the page. Other columns are not read.
    """
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def work(part: pa.RecordBatch) -> list:
        texts = [main_text(h) for h in part.column("html").to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return add_columns(pages.select("page_id", "url", pages["html"].cast("string").alias("html")), "html", fields, work, drop_input=True)


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null pages have the empty text, repeated ids a row each."""
    return page_texts(read_table(spark, sf_dir, "pages"))
