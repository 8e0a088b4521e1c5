"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block tags. Pass one decides blocks by link
density, length and stop-word density: text with many links is out, text that is
long enough and has stop words is in, and what is neither stays undecided. On a
page in none of the languages with stop words, text is what is long and has
sentences. Being inside an article halves the length that is asked for; it
decides nothing by itself.

What stands in an element of a menu, footer or sidebar, or is hidden, is out.
Forms, page headers, and elements whose class, id or role has a name such as
``comments`` or ``ad`` (a whole name, not a part of one) are only likely frames:
one counts unless the text outside is little beside its own, as where a wrapper
or a whole-page form has such a name. A comment section counts as long as there
is any text outside.

Pass two gives each undecided block the label of its nearest decided neighbours; if
those differ, the nearer wins, a heading goes with what follows, and a tie is
out. Labels of a few words, no sentence, outside an article are out before the
first and behind the last decided block. If no block of a page is in, the
undecided ones of its article are, or else all.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by a line feed. Quotes only open a value behind an equals
sign; one that never closes ends with its tag. The work is linear in the page.
Null or empty pages give an empty text. Repeated pages are extracted each; ids
and urls may be null. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbit.llm.common import slices

# The elements of HTML that break text into blocks, that hold no text, and that frame a page.
BLOCKS = set("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = set("script style noscript template iframe object svg math canvas audio video title head textarea select button".split())
RAW = set("script style textarea title noscript iframe template svg".split())
FRAME = set("nav aside footer menu dialog".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next of their kind ends.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"br", "p"}
#: Names of likely frames, and among them those of comment sections.
COMMENTS = frozenset("comment comments commentlist comment-list comments-area respond replies disqus disqus_thread discussion".split())
MARKS = COMMENTS | frozenset(
    """ad ads advert adverts advertisement advertisements advertising adbox banner banners sponsor sponsored sponsors promo promoted promotion cookie cookies
    cookie-banner cookie-notice cookie-consent consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login sidebar side-bar aside
    menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer foot masthead site-header page-header site-footer page-footer topbar social share
    sharing social-share related related-posts recommended recommendations widget toolbar skip-link copyright legal disclaimer search""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
STOP_WORDS = frozenset(
    """the of and to in is was that it for on with as by at from this are be or an which have not but they his her you we all their has had were been will would can
    der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an er hat aus bei sind noch wie einer
    le la les de des du et est un une dans que qui en au pour pas sur par ce il elle avec plus sont se aux ne
    el los las y es un una en que por con para se del al no su lo como más pero sus""".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|([^<]+|<)", re.S)
#: A closing slash that is no part of a value.
EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[^\W\d_]+")

LINKS_OUT, LINKS_MAYBE = 0.5, 0.25
LONG, SHORT = 120, 30
STOPS_HIGH, STOPS_LOW = 0.2, 0.08
#: Share of words that a page in a language with stop words has at least.
KNOWN = 0.02
#: Words of a label at most.
LABEL = 4
#: A likely frame counts unless the text outside is less than this share of its own.
LITTLE = 0.25
SENTENCE = re.compile(r"[.!?…。！？।۔]")
GOOD, BAD, OPEN = 1, 0, -1


@dataclass
class Block:
    text: str
    linked: int
    framed: bool
    inside: bool
    heading: bool
    #: The innermost likely frame around it; 0: none.
    likely: int = 0


@dataclass
class Likely:
    """A likely frame: the one around it (0: none), and whether it is a comment section."""

    around: int
    comments: bool


def blocks(page: str) -> tuple[list[Block], list[Likely]]:
    """The page's blocks with text, in order, and its likely frames, of which the first stands for none."""
    out: list[Block] = []
    frames_found = [Likely(0, False)]
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, frames, is an article, is a likely frame
    likely = 0
    places: dict[str, list[int]] = {}  # where in the stack a tag is open
    open_blocks: list[int] = []  # where it has block tags
    parts: list[str] = []
    linked = hidden = framed = inside = links = 0
    heading = False

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(linked, len(text)), framed > 0, inside > 0, heading, likely))
        parts, linked = [], 0

    def close(to: int) -> None:
        nonlocal hidden, framed, inside, links, likely
        while len(stack) > to:
            tag, frames, article, mark = stack.pop()
            places[tag].pop()
            if mark:
                end_block()  # its last text is still inside
                likely = frames_found[likely].around
            if tag in BLOCKS:
                open_blocks.pop()
            framed -= frames
            inside -= article
            hidden -= tag in HIDDEN
            links -= tag == "a"
            if tag in BLOCKS:
                end_block_of(tag)

    def end_block_of(tag: str) -> None:
        nonlocal heading
        if tag[:1] == "h" and tag[1:].isdigit():
            heading = False

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m.group(5) if m.group(5) is not None else m.group(1)
        if text is not None:
            if not hidden:
                plain = html.unescape(text) if "&" in text and m.group(1) is None else text
                parts.append(plain)
                if links:
                    linked += len(" ".join(plain.split()))
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):  # an end tag
            if tag in BLOCKS:
                end_block()
            if (found := places.get(tag)) and (tag in BLOCKS or not open_blocks or open_blocks[-1] < found[-1]):
                close(found[-1])
            continue
        if tag in BLOCKS:
            end_block()
            if (tag in ENDS_P or tag == "p") and open_blocks and stack[open_blocks[-1]][0] == "p":
                close(open_blocks[-1])
        if (ends := SELF_CLOSING.get(tag)) and open_blocks and stack[open_blocks[-1]][0] in ends:
            close(open_blocks[-1])
        raw_attributes = m.group(4) or ""
        if tag in VOID or EMPTY.search(raw_attributes) and tag not in RAW:
            if tag not in BLOCKS and tag in ("img", "input"):
                parts.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        frames, mark, comments = tag in FRAME, tag == "form", False
        article = tag in ("article", "main")
        if raw_attributes.strip() and tag not in ("html", "body", "article", "main"):
            got = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw_attributes)}
            names = set(f"{got.get('class', '')} {got.get('id', '')}".lower().split())
            frames = frames or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
            mark = mark or bool(names & MARKS) or bool(ROLES.intersection(got.get("role", "").lower().split()))
            comments = bool(names & COMMENTS)
        if tag == "header" and not inside:
            mark = True
        if mark:
            end_block()
            frames_found.append(Likely(likely, comments))
            likely = len(frames_found) - 1
        framed += frames
        inside += article
        hidden += tag in HIDDEN
        links += tag == "a"
        if tag[:1] == "h" and tag[1:].isdigit():
            heading = True
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((tag, frames, article, mark))
    end_block()
    return out, frames_found


def stop_share(text: str) -> tuple[int, int]:
    """Stop words, and words."""
    words = [w.lower() for w in WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(found: list[Block]) -> list[int]:
    """GOOD, BAD or OPEN for each block, whatever likely frames it stands in."""
    out = []
    shares = [stop_share(b.text) for b in found]
    known = sum(s for s, _ in shares) >= KNOWN * sum(n for _, n in shares)
    for b, (stops, words) in zip(found, shares, strict=True):
        density = b.linked / max(1, len(b.text))
        stops /= max(1, words)
        if not known and SENTENCE.search(b.text):
            stops = STOPS_LOW
        size = len(b.text) * (2 if b.inside else 1)
        if b.framed or density > LINKS_OUT:
            out.append(BAD)
        elif density > LINKS_MAYBE:
            out.append(OPEN if b.inside or size >= LONG and stops >= STOPS_HIGH else BAD)
        elif size >= LONG and stops >= STOPS_LOW or size >= SHORT and stops >= STOPS_HIGH and not b.heading:
            out.append(GOOD)
        else:
            out.append(OPEN)
    return out


def in_frames(found: list[Block], labels: list[int], likely: list[Likely]) -> list[bool]:
    """Whether each likely frame counts, or stands in one that does: a frame that holds the page's text doesn't.

    From the outside, the frame with most text goes while the text outside is
    little beside it, or nothing if there is an article outside. Comment
    sections go last, and only if there is no text but theirs.
    """
    own, below = [0] * len(likely), [[] for _ in likely]
    outside, article = 0, False
    for b, label in zip(found, labels, strict=True):
        if label == GOOD:
            own[b.likely] += len(b.text)
        elif label == OPEN and not b.likely and not is_label(b):
            outside += len(b.text)
        article |= b.inside and not b.likely and label != BAD
    outside += own[0]
    held = list(own)
    for m in range(len(likely) - 1, 0, -1):
        held[likely[m].around] += held[m]
        below[likely[m].around].append(m)
    counts = [False] + [True] * (len(likely) - 1)
    waiting: list[tuple[bool, int, int]] = []
    for m in below[0]:
        heapq.heappush(waiting, (likely[m].comments, -held[m], m))
    while waiting:
        comments, size, m = heapq.heappop(waiting)
        if not size or outside and (comments or article or outside >= -LITTLE * size):
            continue
        counts[m] = False
        outside += own[m]
        for x in below[m]:
            heapq.heappush(waiting, (likely[x].comments, -held[x], x))
    for m in range(1, len(likely)):
        counts[m] = counts[m] or counts[likely[m].around]
    return counts


def is_label(b: Block) -> bool:
    """A few words that are no sentence, no heading, and in no article."""
    return not (b.inside or b.heading or SENTENCE.search(b.text)) and len(WORD.findall(b.text)) <= LABEL and not stop_share(b.text)[0]


def second_pass(labels: list[int], headings: list[bool], short: list[bool] | None = None) -> list[int]:
    """OPEN blocks inherit from the nearest decided neighbours; between differing ones, a heading goes with what follows. Those that are ``short`` need decided neighbours on both sides."""
    n = len(labels)
    short = short or [False] * n
    before, after = [(BAD, n + 1)] * n, [(BAD, n + 1)] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            if labels[i] != OPEN:
                last = (labels[i], i)
            elif last is not None:
                side[i] = (last[0], abs(i - last[1]))
    out = []
    for i, label in enumerate(labels):
        if label != OPEN:
            out.append(label)
            continue
        (a, da), (b, db) = before[i], after[i]
        if short[i] and max(da, db) > n:
            out.append(BAD)
            continue
        out.append(a if a == b else b if headings[i] and db <= n else a if da < db else b if db < da else BAD)
    return out


def inherits(found: list[Block], labels: list[int], likely: list[Likely]) -> list[int]:
    """second_pass among the blocks that could be text: framed ones are no neighbours."""
    framed = in_frames(found, labels, likely)
    out = [BAD if framed[b.likely] else label for b, label in zip(found, labels, strict=True)]
    own = [i for i, b in enumerate(found) if not b.framed and not framed[b.likely]]
    for i, label in zip(own, second_pass([labels[i] for i in own], [found[i].heading for i in own], [is_label(found[i]) for i in own]), strict=True):
        out[i] = label
    if not any(label == GOOD for label in out):  # nothing but short blocks: an article's are the text, or else all
        left = [i for i in own if labels[i] == OPEN]
        for i in [i for i in left if found[i].inside] or left:
            out[i] = GOOD
    return [BAD if x == OPEN else x for x in out]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, likely = blocks(page)
    return "\n".join(b.text for b, label in zip(found, inherits(found, first_pass(found), likely), strict=True) if label == GOOD)


def extract(df: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("page"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
