"""The main text of web pages by two passes of rules over blocks.

A page becomes blocks of text between block-level tags. Markup decides first: blocks inside menus,
headers and footers of the page, sidebars, notices, adverts, forms and reader comments, told by
their elements, roles, classes and ids, are boilerplate, and scripts, styles and other text that is
not shown is never read. If an article or main element is left with text, the main text lies in it,
and what stands outside is boilerplate. The first pass then looks at link density, length and
stop-word density: many links, or length without stop words, are boilerplate; long blocks of many
stop words are main text; those between are near to it, and short ones are ambiguous. Inside an
article or main element only lists of links are boilerplate, links by themselves are ambiguous, and
all else is main text. In the second pass ambiguous and near blocks inherit the label of their
nearest decided neighbours: near ones take a good neighbour on either side, and short ones need both
or the nearer of the two; headings look ahead.

Character references are decoded, white space (also a decoded no-break space) becomes one space,
blocks are joined in page order by one space. Null and empty pages, and pages without main text,
have an empty text. Unclosed elements end with the element around them, a page may end anywhere.
Rows with one page_id, and repeated rows, count each; an empty table gives no rows. Only page_id, url
and html are read, so extra columns of any name do no harm."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Elements of HTML by what they do to text, and names that pages give their parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = set("h1 h2 h3 h4 h5 h6".split())
LISTS = set("ul ol dl menu dir".split())
BOILER_TAGS = set("aside button datalist dialog fieldset footer form label legend menu nav optgroup option select".split())
BOILER_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())
#: A word of a class or id that makes a part boilerplate, always or unless a word of SHELL stands beside it.
BOILER_WORDS = set(
    "ad ads adbox adsense adslot advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription signup paywall popup modal "
    "comment comments commentlist disqus respond replies breadcrumb breadcrumbs pagination pager related recommended share sharing".split()
)
WEAK_WORDS = set("header masthead footer sidebar sidenav aside banner menu nav navbar navigation notice notices notification alert social widget toolbar topbar login search form copyright tags".split())
SHELL = set("has with no without layout page wrapper wrap container content main article post body entry story text".split())
MAIN_WORDS = set("articlebody article-body article-content post-content post-body entry-content story-body main-content".split())
#: An element of the left ends open ones of the right, up to the element that holds them.
CLOSES = {"li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, BLOCK)}
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it not of on or that the their they this to was we were which with you "  # English
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne ou où par pas pour qu que qui sa se ses son sont sur un une "  # French
    "als am auch auf aus bei das dass dem den der die ein eine einen einer er es für hat ich im ist mit nach nicht noch sich sie sind so und von war wie wird zu zum zur "  # German
    "al como con cuando del el ella ellos entre era fue hay la las lo los más muy no nos para pero por se sin sobre su sus también tiene una unos y ya".split()  # Spanish
)
MAX_LINKS, LINK_LIST, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.2, 0.5, 70, 200, 0.15, 0.3

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|noembed|noframes|template|iframe|svg|math|xmp|object|audio|video|canvas)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>[^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+)>"""
    r"|</?[a-z][^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
EDGES = ".,;:!?\"'()[]{}«»“”‘’…-–—*#%$&|<>/"


@dataclass(slots=True)
class Block:
    text: str
    links: int
    boiler: bool
    main: bool
    heading: bool
    listed: bool
    label: str = ""


def hints(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool]:
    """(boilerplate, main) by an element's name and attributes."""
    boiler = tag in BOILER_TAGS or tag == "header" and not inside_main
    main = tag in ("article", "main")
    if not attributes or attributes.isspace():
        return boiler, main and not boiler
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if not found:
        return boiler, main and not boiler
    role = found.get("role", "").strip().lower()
    named = f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}"
    main = main or role == "main" or any(x in MAIN_WORDS for x in named.lower().split())
    boiler = boiler or role in BOILER_ROLES and not (role == "banner" and inside_main) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag not in ("html", "body", "main"):
        for name in named.split():
            words = set(WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()))
            if words & BOILER_WORDS or not main and words & WEAK_WORDS and not words & SHELL and not (inside_main and words & {"header"}):
                boiler = True
    return boiler, main and not boiler


def page_blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []  # name, boilerplate, main: of the element and all around it
    text: list[str] = []
    links = 0

    def end_block() -> None:
        nonlocal links
        if text:
            whole = "".join(text)
            words = " ".join((references.unescape(whole) if "&" in whole else whole).split())
            if words:
                names = [x[0] for x in open_]
                boiler, main = open_[-1][1:] if open_ else (False, False)
                out.append(Block(words, links, boiler, main, any(x in HEADING for x in names), any(x in LISTS for x in names)))
            text.clear()
            links = 0

    def read(piece: str) -> None:
        nonlocal links
        if piece:
            text.append(piece)
            if any(x[0] == "a" for x in open_):
                links += len(" ".join((references.unescape(piece) if "&" in piece else piece).split()))

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            read(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"]:
            if tag in BLOCK:
                end_block()
            elif tag == "br":
                text.append("\n")
            if any(x[0] == tag for x in open_):
                while open_.pop()[0] != tag:
                    pass
            continue
        if tag in BLOCK:
            end_block()
            if open_ and open_[-1][0] == "p":
                open_.pop()
        elif tag == "br":
            text.append("\n")
        if tag in CLOSES:
            ended, within = CLOSES[tag]
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in ended:
                    del open_[k:]
                    break
                if open_[k][0] in within:
                    break
        attributes = token["attributes"]
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        boiler, main = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
        if tag == "a" or tag in BLOCK or tag in BOILER_TAGS or attributes:
            told = hints(tag, attributes, main)
            open_.append((tag, boiler or told[0], (main or told[1]) and not told[0]))
    read(page[at:])
    end_block()
    return out


def first_pass(block: Block, within: bool) -> str:
    """The label that a block has by itself: good, bad, near or short. within: the page has a main part."""
    if block.boiler or within and not block.main:
        return "bad"
    n = len(block.text)
    links = block.links / n
    if within:
        return "good" if links <= LINK_LIST else "bad" if block.listed else "short"
    if links > MAX_LINKS or "©" in block.text:
        return "bad"
    if n < SHORT:
        return "bad" if block.links else "short"
    words = block.text.lower().split()
    stops = sum(w.strip(EDGES) in STOP_WORDS for w in words) / len(words)
    if stops >= MANY_STOPS:
        return "good" if n > LONG else "near"
    return "near" if stops >= FEW_STOPS else "bad"


def label(blocks: list[Block]) -> None:
    """Both passes over a page's blocks."""
    within = any(b.main and not b.boiler for b in blocks)
    first = [first_pass(b, within) for b in blocks]
    for wanted in ("near", "short"):  # near blocks are decided first, and then count as decided
        before, after = _nearest(first), _nearest(first[::-1])[::-1]
        now = list(first)
        for k, block in enumerate(blocks):
            if first[k] != wanted:
                continue
            (left, i), (right, j) = before[k], after[k]
            if wanted == "near":
                good = "good" in (left, right)
            elif block.heading and right:
                good = right == "good"
            else:
                good = left == right == "good" or left == "good" != right and i < j or right == "good" != left and j < i
            now[k] = "good" if good or wanted == "short" and within and not (left or right) else "bad"
        first = now
    for block, x in zip(blocks, first):
        block.label = x


def _nearest(labels: list[str]) -> list[tuple[str, int]]:
    """(label, distance) of the nearest decided block before each; none has an empty label."""
    out, last, at = [], "", -1
    for k, x in enumerate(labels):
        out.append((last, k - at if last else 1 << 60))
        if x in ("good", "bad"):
            last, at = x, k
    return out


def main_text(page: str | None) -> str:
    """The main text of a page."""
    blocks = page_blocks(page or "")
    label(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[str] = []
        first = size = 0
        for k in range(batch.num_rows):
            held.append(main_text(batch.column(2)[k].as_py()))
            size += len(held[-1])
            if size > 1 << 22 or k == batch.num_rows - 1:
                yield pa.record_batch([batch.column(0).slice(first, len(held)), batch.column(1).slice(first, len(held)), pa.array(held, pa.string()), pa.array([len(x) for x in held], pa.int64())], ["page_id", "url", "text", "n_chars"])
                first, held, size = k + 1, [], 0


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page and its length in code points."""
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            blocks = page_blocks(batch.column(1)[k].as_py() or "")
            label(blocks)
            ids = pa.array([batch.column(0)[k].as_py()] * len(blocks), batch.column(0).type)
            yield pa.record_batch([ids, pa.array(range(len(blocks)), pa.int32()), pa.array([b.label for b in blocks], pa.string()), pa.array([b.links for b in blocks], pa.int64()), pa.array([b.text for b in blocks], pa.string())], ["page_id", "block", "label", "link_chars", "text"])


def labelled_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, label, link_chars, text): every block of every page with its label, good or bad."""
    return pages.select("page_id", "html").mapInArrow(_labelled, f"page_id {dict(pages.dtypes)['page_id']}, block int, label string, link_chars bigint, text string")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
