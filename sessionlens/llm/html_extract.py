"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags.  Menus, headers, footers, sidebars, notices,
adverts, forms and comments known by element, class, id or role are out.  The first pass
decides all other blocks by their length, link density and stop-word density.  Short blocks
and headings stay open.  An article or main element is a prior of this pass: if it holds at
least as much unlinked text as the good blocks beside it, ``PRIOR`` lowers the stop words asked
for in it and raises those beside it, where short blocks are out; a smaller one (a teaser, a
card) is judged like the rest of the page.  In the second pass an open block takes the label of
its nearest decided neighbours: the common one, or else the nearer one's, and the later one's
if both are as near (a heading belongs to what follows).  Surroundings are nobody's neighbours,
nor is what stands beside a trusted article for the blocks in it.  A page without a decided
block, or a trusted article without a good one, keeps its open ones.  A notice or comment in
full sentences inside an article, without a known name, is not told from the article.

White space includes all that Unicode calls so; a line break inside a block is white space.
Every kept block is kept whole.

Defined results: null or empty html gives an empty text; broken markup (unclosed tags, stray
ends, a tag cut off at the end) is read as far as it goes; repeated rows are read each; an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .places import small_batches

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about all an and are as at be been but by can for from had has have he her his i if in is it its not of on or "
    "she so that the their them there they this to was we were what when which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für "
    "hat ich ihr im in ist kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn "
    "werden wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on "
    "ou où par pas plus pour qu que qui sa se ses son sont sur tu un une vous y "
    "al algo como con cual cuando de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más "
    "me mi muy no nos o para pero por que se si sin sobre son su sus también te un una uno y ya".split()
)
# Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
# Elements whose text is never main text.
OUTSIDE = frozenset("nav footer aside form head menu dialog select option button fieldset svg math object template".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Class names, ids and roles of what surrounds an article.
SURROUNDINGS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies dialog disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SHORT, LONG = 70, 200
MOST_LINKED = 0.5
STOPS_LOW, STOPS_HIGH = 0.1, 0.2
PRIOR = 0.1


def surrounds(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is known to hold no main text."""
    if name in OUTSIDE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden":
            return True
        if key in ("class", "id", "role"):
            for word in "".join(values).lower().split():
                parts = re.split(r"[-_]+", word)
                if word in SURROUNDINGS or parts[0] in SURROUNDINGS or (len(parts) == 2 and parts[1] in SURROUNDINGS and parts[0] not in ("has", "no", "with")):
                    return True
    return False


class Block:
    __slots__ = ("text", "linked", "outside", "article", "heading")

    def __init__(self, text: str, linked: int, outside: bool, article: bool, heading: bool):
        self.text, self.linked, self.outside, self.article, self.heading = text, linked, outside, article, heading


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in order."""
    found: list[Block] = []
    open_: list[tuple[str, bool]] = []  # element, and whether it is one of the surroundings
    outside = article = links = heading = 0
    pieces: list[str] = []
    linked = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            found.append(Block(text, linked, outside > 0, article > 0, heading > 0))
        pieces.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            pieces.append(piece)
            if links:
                linked += len(piece.strip())

    while at < end:
        match = TOKEN.search(page, at)
        if match is None:
            cut = page.rfind("<", at)
            # a tag cut off at the end of the page is no text
            text(page[at : cut if cut >= 0 and re.match(r"<[/a-zA-Z!?]", page[cut:]) else end])
            break
        text(page[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if match[1]:
            if any(name == n for n, _ in open_):
                while True:
                    last, was = open_.pop()
                    outside -= was
                    article -= last in ("article", "main")
                    links -= last == "a"
                    heading -= last in HEADINGS
                    if last == name:
                        break
        elif name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
        elif name == "br":
            pieces.append(" ")
        elif name not in VOID and name != "p" and not match[3].endswith("/"):
            was = surrounds(name, match[3], article > 0)
            open_.append((name, was))
            outside += was
            article += name in ("article", "main")
            links += name == "a"
            heading += name in HEADINGS
    flush()
    return found


def decided(b: Block, prior: float = 0.0) -> bool | None:
    """A block's label by its own text, None if open; ``prior`` lowers the stop words asked for."""
    if b.linked > MOST_LINKED * len(b.text):
        return None if b.heading and prior > 0 else False
    if b.heading or len(b.text) < SHORT:
        return None
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if len(b.text) >= LONG:
        return stops >= STOPS_LOW - prior
    return True if stops >= STOPS_HIGH - prior else None


def first_pass(page_blocks: list[Block]) -> tuple[list[bool | None], bool]:
    """Labels, and whether the page's article or main elements are its main part."""
    labels = [False if b.outside else decided(b) for b in page_blocks]
    marked = sum(len(b.text) - b.linked for b in page_blocks if b.article and not b.outside)
    beside = sum(len(b.text) for b, label in zip(page_blocks, labels, strict=True) if label and not b.article)
    if not any(b.article and not b.outside for b in page_blocks) or marked < beside:
        return labels, False
    labels = [False if b.outside else decided(b, PRIOR if b.article else -PRIOR) for b in page_blocks]
    return [False if label is None and not b.article and not b.heading else label for b, label in zip(page_blocks, labels, strict=True)], True


def main_text(page: str | None) -> str:
    """The kept blocks of a page, joined by an empty line."""
    page_blocks = blocks(page or "")
    labels, trusted = first_pass(page_blocks)
    # an article without a block decided as main text keeps its open ones
    bare = trusted and not any(label and b.article for b, label in zip(page_blocks, labels, strict=True))
    sides: list[list[tuple[bool, int]]] = [[] for _ in labels]
    for way in (range(len(labels) - 1, -1, -1), range(len(labels))):
        last: dict[bool, tuple[bool, int]] = {}
        for k in way:
            b, label = page_blocks[k], labels[k]
            # blocks beside a trusted article say nothing of the open ones in it
            groups = (True, False) if b.article or not trusted else (False,)
            if label is not None and not b.outside:
                last.update((group, (label, k)) for group in groups)
            elif label is None and (b.article or not trusted) in last:
                sides[k].append(last[b.article or not trusted])
    kept = []
    for k, (b, label) in enumerate(zip(page_blocks, labels, strict=True)):
        if label is None:
            near = sides[k]  # the following one first
            label = True if bare and b.article else (min(near, key=lambda s: abs(s[1] - k))[0] if near else True)
        if label:
            kept.append(b.text)
    return "\n\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""
    chosen = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return small_batches(chosen).mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extracted(spark.read.parquet(f"{folder}/pages.parquet")).withColumn("n_chars", F.length("text").cast("bigint"))
