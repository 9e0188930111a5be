"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block tags. Menus, headers, footers, sidebars, forms, scripts and other parts that a tag, role, class
or id names as such are left out. In the first pass, stop-word density, length and link density call each block good, bad or
open; within an <article> or <main> the stop words are asked for less. In the second pass open (ambiguous, short) blocks inherit
the label of the nearest decided neighbours: good if the nearer one, or either of two as near, is good; else bad.

A page whose long blocks hold hardly any of the listed stop words is in another language; it is judged by length and links alone.

Character references are decoded; white space within a block becomes one space; good blocks are joined by one newline in page
order. A null or empty page, or one without good blocks, has the empty text. Broken and truncated markup is read as far as it goes.
Repeated rows are extracted each. Columns of the input stay, but for text and n_chars, which are set.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.llm.common import numbered

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on
    one or our out she so some than that the their there they this to up was we were what when which who will with would you
    aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist
    kann man mit nach nicht noch nur oder sehr sich sie sind so über um und uns von vor war was wie wir zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se
    ses son sont sur un une vous y
    al como con de del el ella en es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que se si sin sobre su sus un una y ya""".split()
)
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
#: Left out with all they hold, tags unread; an open one reaches to the end of the page.
RAW = ("script", "style", "textarea", "title")
#: Left out to their end tag; without one only the tag itself is.
INNER = frozenset("noscript template svg iframe object canvas".split())
OUT = frozenset("nav aside form footer button select menu dialog head".split())
#: Left out too unless within the main part.
OUT_ABOVE = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus
    footer gdpr menu modal nav navbar navigation newsletter pager pagination paywall popup promo sidebar signup sponsored toolbar topbar widget
    widgets""".split()
)
#: Words that name such a part only where they begin a class or id: elsewhere they may speak of what a part is about.
LEADING = frozenset("banner hidden login notice notices notification promoted promotion related recommended recommendations replies respond share sharing skip social sponsor subscribe subscription".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Limits of the first pass: characters, stop words and linked characters by share.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.12, 0.2, 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r""")(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:"[^"]*+"|'[^']*+'|[^>"'])*+)(?:>|\Z)|(?P<text>[^<]++|<)""",
    re.S | re.I,
)
#: One attribute after the other, so that what looks like one within a value is none.
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s"'<>/=]+)(?:\s*=\s*("[^"]*+"?|'[^']*+'?|[^\s"'>]+))?|[\s"'=<>/]""")
_WORD = re.compile(r"\w+")
_PARTS = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    linked: int  # characters within links
    out: bool  # lies in a part that is left out
    main: bool  # lies in the main part
    heading: bool


def _left_out(tag: str, rest: str, main: bool) -> bool:
    if tag in OUT or (tag in OUT_ABOVE and not main):
        return True
    if tag in ("body", "html") or tag in MAIN or "=" not in rest and "hidden" not in rest.lower():
        return False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = (m[1] or "").lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and _names_a_part(value, main):
            return True
    return False


def _names_a_part(value: str, main: bool) -> bool:
    """Whether a class or id names a part that is left out: within the main part by one of its names as a whole, since there a longer one may speak of what the text is about."""
    if main:
        return any(name in NAMES or name in LEADING for name in value.split())
    return not NAMES.isdisjoint(_PARTS.split(value)) or not LEADING.isdisjoint(_PARTS.split(value.strip().partition(" ")[0]))


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, left out, main
    depth: Counter[str] = Counter()  # tags on the stack
    endless: set[str] = set()  # tags of which no end tag follows
    low = page.lower() if any(f"<{tag}" in page or f"<{tag.upper()}" in page for tag in INNER) else ""
    low = low if len(low) == len(page) else page
    parts: list[str] = []
    linked = links = breaks = 0
    heading = False
    left, main = False, False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, left, main, heading))
            parts, linked = [], 0

    def pop(k: int) -> None:
        nonlocal left, main
        for t, _, _ in stack[k:]:
            depth[t] -= 1
        del stack[k:]
        left, main = stack[-1][1:] if stack else (False, False)

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            parts.append(text)
            if links:
                linked += len(text)
            if not text.isspace():
                breaks = 0
            continue
        if m["tag"] is None:
            if m["raw"] is not None and m["raw"].lower() == "title":
                close()
            continue
        tag, end = m["tag"].lower(), bool(m["end"])
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
            continue
        breaks = 0
        if tag == "a":
            links = 0 if end else 1
            continue
        if tag in INNER and not end and not m["rest"].endswith("/") and tag not in endless:
            over = low.find(f"</{tag}", at)
            if over < 0:
                endless.add(tag)
            else:
                over = page.find(">", over)
                at = over + 1 if over >= 0 else len(page)
            continue
        block = tag in BLOCKS or tag in OUT
        if block:
            close()
            links = 0
            heading = tag in HEADINGS and not end
        if tag in VOID or m["rest"].endswith("/"):
            continue
        if end:
            if depth[tag]:
                close()
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        goes = _left_out(tag, m["rest"], main)
        # a tag within a left-out one of its name is kept count of, so that its end does not end the outer one
        if block and tag not in ("p", "li", *HEADINGS) or goes or (depth[tag] and not block):
            if block or goes:
                close()
            stack.append((tag, left or goes, main or tag in MAIN))
            depth[tag] += 1
            left, main = stack[-1][1:]
        elif block and stack and stack[-1][0] in ("p", "li", *HEADINGS):
            pop(len(stack) - 1)
    close()
    return out


def labels(found: list[Block]) -> list[bool]:
    """For each block whether it belongs to the main text."""
    shares = []
    for b in found:
        words = _WORD.findall(b.text.lower())
        shares.append((sum(w in STOP_WORDS for w in words), len(words)))
    # a page whose long blocks lack such words is in a language that the list does not know: length and links decide alone
    asked = [x for x, b in zip(shares, found, strict=True) if not b.out and len(b.text) >= LONG and b.linked <= LINKS * len(b.text)]
    foreign = sum(n for n, _ in asked) < STOP_LOW * sum(n for _, n in asked)
    first: list[bool | None] = []
    for b, (hits, n) in zip(found, shares, strict=True):
        stop = 1.0 if foreign else hits / n if n else 0.0
        if b.out or b.linked > LINKS * len(b.text):
            first.append(False)
        elif len(b.text) < SHORT and not (b.heading and b.main):
            first.append(None)
        elif b.main or (stop >= STOP_HIGH and len(b.text) >= LONG):
            first.append(True)
        elif stop >= STOP_LOW:
            first.append(None)
        else:
            first.append(False)
    # the nearest decided block on either side; what lies outside the main part says little about it, and a left-out part within it nothing
    def nearest(order: range) -> list[tuple[int, bool] | None]:
        last: dict[bool, tuple[int, bool]] = {}
        out: list[tuple[int, bool] | None] = [None] * len(found)
        for i in order:
            out[i] = last.get(found[i].main)
            if first[i] is not None and not (found[i].out and found[i].main):
                last[found[i].main] = (i, first[i])
        return out

    out = []
    for i, (v, before, after) in enumerate(zip(first, nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1)), strict=True)):
        if v is not None:
            out.append(v)
        elif before is None and after is None:
            out.append(found[i].main)
        elif before is None or after is None:
            out.append((before or after)[1])
        else:
            left, right = i - before[0], after[0] - i
            out.append(before[1] and left <= right or after[1] and right <= left)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, ok in zip(found, labels(found), strict=True) if ok)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text (the main text of the column) and n_chars (its code points); the column itself is dropped."""
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    names = [f.name for f in pages.schema.fields if f.name not in (column, "text", "n_chars")]
    rows = numbered(pages.select(*map(quoted, names), quoted(column)))
    kept = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in kept), "text", "n_chars"])

    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])
    return rows.mapInArrow(run, schema).toDF(*names, "text", "n_chars")


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
