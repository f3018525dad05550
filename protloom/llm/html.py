"""Main text of HTML pages by block rules in two passes."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its more no not of on
    one or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch
    nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou où par pas plus pour qu que qui sa se ses son sont sur un
    une vous y à été
    al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no o para pero por que se ser si sin sobre son su
    sus también un una uno y ya""".split()
)
# Elements.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template iframe svg annotation annotation-xml textarea select title object canvas head".split())
BOILERPLATE = frozenset("nav footer aside menu dialog button label".split())
# Of those, the ones that stand within a line: they are left out, but don't end it.
WITHIN_LINE = frozenset("svg annotation annotation-xml button label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of class, id and role values that mark what isn't the article.
CUE = frozenset("ad ads adv advert adverts advertisement breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disclaimer discussion disqus footer masthead menu nav navbar navigation newsletter popup promo promoted sidebar signup sponsor sponsored subscribe subscription".split())
# Those that mark it only alone, or beside another mark or a word of layout.
WEAK_CUE = frozenset("banner copyright header legal login modal notice notices promotion related reply replies search share sharing skip social teaser toolbar widget".split())
LAYOUT = frozenset("area articles bar block bottom box button buttons container content global holder icons item items left link links list main page panel posts right row section site stories top wrap wrapper".split())
# Parts that say whether something is there, and marks of readers' comments.
STATE = frozenset("closed disabled enabled has hide is no not open show with without".split())
COMMENTS = frozenset("comment comments discussion disqus reply replies".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_CUES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[^\W\d_]+")
# Scripts in which a character is about half a word (kana, CJK, Hangul).
_DENSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")


@dataclass
class Block:
    """A run of text between block elements. inside: the number of the outermost article or main element around it (0: none);
    off: within a menu, note etc.; mark: number of the innermost form or marked element around it (-1: none); item: of a list."""

    text: str
    links: int
    inside: int
    off: bool
    heading: bool
    item: bool = False
    mark: int = -1
    label: str = ""


@dataclass
class Mark:
    """A form or an element marked by class, id or role: the mark around it (-1: none), what kind it is, whether it is off the
    article whatever it holds, and whether an article within makes it part of the page."""

    parent: int
    kind: str
    final: bool
    holds: bool = False


def cues(attributes: str) -> tuple[bool, bool]:
    """Whether an element's class, id or role marks it as no part of the article, and as readers' comments."""
    marked = comments = False
    for value in _CUES.findall(attributes):
        for token in value.strip("\"'").lower().split():
            parts = {x for x in re.split(r"[^a-z]+", token) if x}
            strong, weak = parts & CUE, parts & WEAK_CUE
            if parts & STATE or not (strong or weak and (len(weak) > 1 or not parts - WEAK_CUE - LAYOUT)):
                continue
            marked, comments = True, comments or bool(parts & COMMENTS)
    return marked, comments


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. Comments, raw elements and markup are left out, character references decoded.

    A form or an element marked by its class, id or role is off the article, unless it holds the article: an article or
    main element, or, on a page without one, more than half of the text, alone or, where little stands outside marks,
    together with others of the same mark. Marks of readers' comments hold anyway; marks around an article's h1 don't.
    Time and memory grow with the page, however deep its elements are left open.
    """
    out: list[Block] = []
    text: list[str] = []
    state = {"links": 0, "a": 0, "inside": 0, "region": 0, "regions": 0, "heading": "", "br": False, "item": False}
    off: list[list] = []  # open elements off the article: [tag, depth of the same tag within, number of the mark or None: certain]
    tags: Counter[str] = Counter()  # of off
    marks: list[Mark] = []
    where = [-1, False, False]  # the innermost mark; whether something certain, and something within a line, is open

    def settle() -> None:
        where[0] = next((o[2] for o in reversed(off) if o[2] is not None), -1)
        where[1] = any(o[2] is None for o in off) if len(off) < 50 or any(tags[t] for t in (*BOILERPLATE, "header")) else False
        where[2] = any(tags[t] for t in WITHIN_LINE)

    def end() -> None:
        if text:
            raw = " ".join(_html.unescape("".join(text)).split())
            if raw:
                top = state["heading"] == "h1" and state["inside"] and not (where[0] >= 0 and marks[where[0]].final)
                out.append(Block(raw, min(len(raw), state["links"]), state["region"] if state["inside"] > 0 else 0, where[1], bool(state["heading"]), state["item"], -1 if top else where[0]))
        text.clear()
        state.update(links=0, br=False)

    def add(piece: str) -> None:
        if piece and not where[2]:
            text.append(piece)
            if piece.strip():
                state["br"] = False
                if state["a"]:
                    state["links"] += len(" ".join(_html.unescape(piece).split()))

    at = 0
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        opens = not m[1]
        if tag in RAW:
            if opens and not m[0].endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                if close or tag != "head":
                    at = close.end() if close else len(page)
                if tag not in WITHIN_LINE:
                    end()
            continue
        if tag == "a":
            state["a"] = int(opens)
            continue
        if tag == "br":
            if state["br"]:
                end()
            else:
                text.append(" ")
                state["br"] = bool(text)
            continue
        if tag in BLOCK or tag in BOILERPLATE and tag not in WITHIN_LINE:
            end()
            state["a"] = 0
            state["item"] = tag == "li" and opens
        if tag in ("article", "main"):
            if opens and not state["inside"]:
                state["regions"] += 1
                state["region"] = state["regions"]
            state["inside"] = max(0, state["inside"] + (1 if opens else -1))
            if opens:
                if off and off[-1][0] in BOILERPLATE:
                    off[:] = [o for o in off if o[2] is not None]  # an element left open doesn't swallow the article
                    tags = Counter(o[0] for o in off)
                    settle()
                k = where[0]
                if not (cues(m[3])[1] or k >= 0 and marks[k].final):
                    while k >= 0 and not marks[k].holds:
                        marks[k].holds, k = True, marks[k].parent
        if tag in HEADING:
            state["heading"] = tag if opens else ""
        if opens and tag not in VOID and not m[0].endswith("/>"):
            marked, comments = (False, False) if tag in ("html", "body", "article", "main") else cues(m[3])
            if tag in BOILERPLATE or (tag == "header" and not state["inside"]):
                off.append([tag, 1, None])
            elif tag == "form" or marked:
                kind = "" if tag == "form" else tag + "".join(sorted(" ".join(v.strip("\"'").lower() for v in _CUES.findall(m[3])).split()))
                marks.append(Mark(where[0], kind, comments or where[0] >= 0 and marks[where[0]].final))
                off.append([tag, 1, len(marks) - 1])
            else:
                if off and off[-1][0] == tag:
                    off[-1][1] += 1
                continue
            tags[tag] += 1
            settle() if off[-1][2] is None else where.__setitem__(0, off[-1][2])
        elif not opens and tags[tag]:
            for i in range(len(off) - 1, -1, -1):
                if off[i][0] == tag:
                    off[i][1] -= 1
                    gone = off[i + (off[i][1] > 0) :]
                    if gone:
                        del off[len(off) - len(gone) :]
                        tags.subtract(o[0] for o in gone)
                        settle()
                    break
    add(page[at:])
    end()
    left = [b for b in out if not b.off]
    if marks and not any(k.holds for k in marks) and not any(b.inside and b.mark < 0 for b in left):
        _holders(left, marks)
    gone: list[bool] = []
    for k in marks:
        gone.append(not k.holds or k.parent >= 0 and gone[k.parent])
    for b in left:
        b.off = b.mark >= 0 and gone[b.mark]
    return out


def _holders(left: list[Block], marks: list[Mark]) -> None:
    """Sets holds of the marks that hold more than half of the text: each alone, or those of one kind together where less than a
    quarter stands outside marks."""
    size = [0] * len(marks)
    whole = outside = 0
    for b in left:
        if b.mark < 0 or not marks[b.mark].final:
            whole += len(b.text)
        if b.mark < 0:
            outside += len(b.text)
        else:
            size[b.mark] += len(b.text)
    for k in range(len(marks) - 1, -1, -1):
        if marks[k].parent >= 0:
            size[marks[k].parent] += size[k]
    joint: Counter[str] = Counter()
    for k, x in enumerate(marks):
        if x.kind and not x.final and not (x.parent >= 0 and marks[x.parent].kind == x.kind):
            joint[x.kind] += size[k]
    for k, x in enumerate(marks):
        x.holds = not x.final and (2 * size[k] > whole or bool(x.kind) and 4 * outside < whole and 2 * joint[x.kind] > whole)
    for x in reversed(marks):
        if x.holds and x.parent >= 0 and not marks[x.parent].final:
            marks[x.parent].holds = True


def _weight(text: str) -> int:
    """Characters, of which those of scripts that write a word in one or two count twice."""
    return len(text) if text.isascii() else len(text) + len(_DENSE.findall(text))


def _density(text: str) -> tuple[int, int]:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def classify(found: list[Block], short: int = 70, long: int = 140, links: float = 0.5, stop: float = 0.12) -> None:
    """Labels blocks good or bad.

    The article elements are the region of the text unless two or more blocks of running text (at least `long` characters, few
    links, enough stop words) stand beside them and have over twice as much text: then several article elements are cards
    of further pages and bad, a single one counts as any element. Where running text has hardly any of the listed
    stop words, its language isn't among them, and blocks are decided by length and links alone.

    Pass 1 decides by rule: bad is what stands in a menu, form, note or the like, has over `links` of its text in links, or
    stands outside the region where there is one; good is what has at least `stop` of its words among stop words
    and, outside an article element, `long` characters. Inside an article element blocks of links are bad only if they
    are nothing but links and stand in a row of three such blocks, or of two in a list: a menu or list of further pages. Pass 2: ambiguous blocks
    (short ones, headings, long ones of few stop words, other blocks of links) take the label that their nearest decided
    neighbours in the same region (menus, forms, notes aside) share; where these differ, a heading takes the following
    one's, others are good inside an article element and bad outside. With no decided neighbour they are good inside an
    article element only.
    """
    density = [_density(b.text) for b in found]
    weight = [_weight(b.text) for b in found]
    prose = [not b.off and not b.heading and b.links <= links * len(b.text) and w >= long for b, w in zip(found, weight)]
    hits, words = (sum(d[i] for d, p in zip(density, prose) if p) for i in (0, 1))
    told = hits >= stop / 4 * words  # whether a listed language fits
    within = sum(w for b, w in zip(found, weight) if b.inside and not b.off and not b.heading and b.links <= links * len(b.text))
    beside = [w for b, w, p, (h, n) in zip(found, weight, prose, density) if p and not b.inside and (not told or h >= stop * n)]
    if len(beside) > 1 and sum(beside) > 2 * within:
        cards = len({b.inside for b in found if b.inside and not b.off}) > 1
        for b in found:
            b.off, b.inside = b.off or cards and b.inside > 0, 0
    region = any(b.inside and not b.off for b in found)
    linked = [b.inside > 0 and not b.off and b.links >= 0.9 * len(b.text) for b in found]
    row = [False] * len(found)
    i = 0
    while i < len(found):
        j = i
        while j < len(found) and linked[j]:
            j += 1
        if j - i >= 3 or j - i == 2 and found[i].item and found[i + 1].item:
            row[i:j] = [True] * (j - i)
        i = max(j, i + 1)
    for b, w, (h, n), listed in zip(found, weight, density, row):
        few = told and h < stop * max(1, n)
        if b.off or region and not b.inside or b.links > links * len(b.text) and (not b.inside or listed):
            b.label = "bad"
        elif b.heading or w < (short if b.inside else long) or few or b.links > links * len(b.text):
            b.label = ""
        else:
            b.label = "good"
    rows = [b for b in found if not b.off and (b.inside or not region)]
    decided = [b.label for b in rows]
    before, last = [], ""
    for x in decided:
        before.append(last)
        last = x or last
    after, last = [], ""
    for x in reversed(decided):
        after.append(last)
        last = x or last
    for b, x, prev, next_ in zip(rows, decided, before, reversed(after), strict=True):
        if not x:
            near = {prev, next_} - {""}
            b.label = near.pop() if len(near) == 1 else (next_ if near and b.heading else "good" if b.inside else "bad")
            if b.inside and b.label == "bad" and not b.links:
                b.label = "good"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns but html, with text and n_chars (code points) of the main text.

    Null, empty and text-free pages give an empty text and 0. Nothing is cut: pages of any length are parsed whole, in
    one pass. Repeated rows stay, columns named text or n_chars are replaced, an empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html, 8 << 20):
                text = pa.array([main_text(x) for x in part.column(html).to_pylist()], pa.string())
                yield pa.record_batch([*[part.column(c) for c in kept], text, pc.utf8_length(text).cast(pa.int64())], names=[*kept, "text", "n_chars"])

    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(pages.select(*[F.col(c) for c in kept], F.col(html).cast("string")), run, f"{fields}{', ' * bool(kept)}text string, n_chars bigint", trim=False)
