"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is read as leaf blocks of text with the tags, classes and ids above them. Features of a block are its ancestors,
pairs of them, the words of their classes and ids, and the form of its text; the chain learns which blocks follow one
another. The best labels are found by the Viterbi method, and the main text is the blocks labelled as content.

**Labelled pages.** No labels come with the pages, so they are made from pages that mark their article up
themselves: blocks within ``article`` or ``main`` are content, those in menus, headers, footers, sidebars, forms and adverts are
not. Each such page is taken as it is and laid out anew in the ways other sites do (articles in plain ``div``s or tables,
with side columns, notices, forms and reader comments of other pages' sentences inside and outside the article), so
that the chain doesn't rest on one tag. About ``TRAIN_PAGES`` pages, chosen by a hash, are used, each up to ``TRAIN_BLOCKS`` blocks.

Extraction reads the whole html of every page in Arrow batches. Defined results: null, empty and textless pages give an
empty text; broken markup is read as far as it goes (unclosed tags, comments and scripts end with the page); repeated rows
each get their own row; without a page to learn from, blocks in ``article`` or ``main`` are the content.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crf import Chain, train
from .data import only, query, ship_package, table

TRAIN_PAGES = 250
TRAIN_BLOCKS = 120
VARIANTS = 5

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*|[^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_QUOTED = re.compile(r"""\"[^\"]*\"|'[^']*'""")
_SPLIT = re.compile(r"[^a-z]+")
_RAW = {"script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "select"}
_HIDDEN = _RAW - {"title"} | {"head"}
_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "dfn", "em", "font", "i", "img", "ins", "del", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements that end when one of the same kind, or a block for ``p``, begins.
_ALONE = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_FENCES = {"ul", "ol", "table", "dl", "div", "article", "section", "aside", "nav", "body"}


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    words: tuple[str, ...]
    linked: int


def _past(page: str, at: int, name: str, attributes: str) -> int:
    """Where a raw element ends whose start tag ends at ``at``: a self-closed svg at once, svg and template with those nested in them."""
    if name == "svg" and _closed(attributes):
        return at
    ends = re.compile(rf"</{re.escape(name)}\s*>?", re.I)
    end = ends.search(page, at)
    first = end.end() if end else len(page)
    if not end or name not in ("svg", "template"):
        return first
    depth = 1
    while found := _MARKUP.search(page, at):
        at = found.end()
        inner = (found[2] or "").lower()
        if inner == name and found[1]:
            depth -= 1
            if not depth:
                return at
        elif inner == name:
            depth += name == "template" or not _closed(found[3] or "")
        elif name == "template" and inner in _RAW and not found[1]:
            at = _past(page, at, inner, found[3] or "")
    return first  # an inner one is not closed: the first end tag ends all of them


def _closed(attributes: str) -> bool:
    """Whether a tag ends with a slash that is not part of an unquoted value."""
    return attributes.endswith("/") and not re.search(r"=\s*[^\s\"']\S*/\Z", _QUOTED.sub("''", attributes))


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of text in page order, with the elements above them."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, at, hidden = 0, 0, 0
    anchors = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            path = [s for s in stack if s[0] not in _INLINE]
            out.append(Block(text, tuple(s[0] for s in path), tuple(w for s in stack for w in s[1]), linked))
        pieces.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if anchors:
                linked += len(text.strip())

    def pop(k: int) -> None:
        nonlocal hidden, anchors
        for name, _ in stack[k:]:
            hidden -= name in _HIDDEN
            anchors -= name == "a"
        del stack[k:]

    while at < len(page):
        found = _MARKUP.search(page, at)
        if not found:
            take(page[at:])
            break
        take(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            close()
        elif name == "br":
            take(" ")
            continue
        if stack and stack[-1][0] == "head" and name not in _HEAD:
            pop(len(stack) - 1)  # the head ends where the body's first element begins
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if name in _INLINE and stack[k][0] not in _INLINE:
                    break
            continue
        if name in _RAW:
            at = _past(page, at, name, found[3] or "")
            continue
        if name in _VOID:
            continue
        if name not in _INLINE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in _ALONE.get(name, ()):
                    pop(k)
                elif stack[k][0] in _FENCES:
                    break
        attributes = found[3] or ""
        words = ()
        if "=" in attributes:
            words = tuple(w for m in _NAMES.finditer(attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w)
        stack.append((name, words))
        hidden += name in _HIDDEN
        anchors += name == "a"
    close()
    return out


def _bucket(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    size = len(blocks)
    for k, block in enumerate(blocks):
        text, length = block.text, len(block.text)
        own = [f"t={t}" for t in set(block.tags)]
        own += [f"p={a}>{b}" for a, b in set(zip(block.tags, block.tags[1:]))]
        own += [f"w={w}" for w in set(block.words)]
        count = text.count(" ") + 1
        own += [
            "bias", f"last={block.tags[-1] if block.tags else ''}", f"len={_bucket(count, (2, 4, 8, 15, 30, 60))}",
            f"link={_bucket(block.linked / length, (0.01, 0.3, 0.8))}", f"stop={text[-1] in '.!?'}", f"comma={_bucket(text.count(','), (1, 3))}",
            f"mark={'©' in text or '|' in text[:40] or '·' in text}", f"at={_bucket(k / size, (0.05, 0.2, 0.5, 0.8, 0.95))}", f"upper={text[:1].isupper()}",
        ]
        out.append(own)
    return out


# ---- labelled pages

_GOOD, _BAD = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
_BAD_WORDS = {
    "ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner", "sidebar", "menu", "nav", "navigation", "breadcrumb", "breadcrumbs", "comment",
    "comments", "reply", "replies", "footer", "cookie", "consent", "notice", "newsletter", "subscribe", "share", "social", "related", "widget", "popup",
}


def marked_up(blocks: list[Block]) -> list[int] | None:
    """Labels that a page's own markup gives; None if it has no article with text."""
    def inside(b: Block) -> bool:
        at = next((k for k, t in enumerate(b.tags) if t in _GOOD), None)
        if at is None or _BAD_WORDS & set(b.words):
            return False
        return not _BAD & set(b.tags[:at]) and not (_BAD - {"header"}) & set(b.tags[at:])  # an article may have a header of its own

    labels = [int(inside(b)) for b in blocks]
    return labels if any(labels) else None


_LAYOUTS = (
    # page, article, heading, side parts in the order: menu, notice, advert, side column, comments, form, footer
    ("<body>{menu}{notice}<div class='container'><div class='content'>{article}{advert}</div>{side}{comments}</div>{footer}",
     "<div class='post'>{}</div>", "<h1>{}</h1>"),
    ("<body><div id='header'>{menu}</div><main><article>{article}{form}</article>{comments}</main>{side}{notice}{footer}", "{}", "<header><h2>{}</h2></header>"),
    ("<body><header>{title}{menu}</header><section><article>{article}{advert}{comments}</article></section><aside>{side}</aside>{form}{footer}", "{}", "<h1>{}</h1>"),
    ("<body><table><tr><td>{menu}{side}</td><td>{article}{comments}</td></tr></table>{advert}{notice}{footer}", "{}", "<h2>{}</h2>"),
    ("<body>{notice}{menu}{advert}<article>{article}</article>{form}{comments}{footer}", "<div class='entry-content body'>{}</div>", "<h1>{}</h1>"),
    ("<body><div class='page'><div class='main'>{article}</div>{form}{side}{comments}</div>{menu}{footer}", "<section class='story text'>{}</section>", "<h1 class='title'>{}</h1>"),
)
_WRAPS = {
    "menu": ("<nav><ul>{links}</ul></nav>", "<div class='menu'><ul>{links}</ul></div>", "<ul class='navigation' id='top-nav'>{links}</ul>", "<div class='breadcrumbs'>{inline}</div>"),
    "notice": ("<div class='cookie-notice'><p>{short}</p><button>{word}</button></div>", "<div class='notice banner'>{short}</div>", "<div id='consent'><p>{short}</p></div>", "<div class='alert' role='alert'>{short}</div>", ""),
    "advert": ("<div class='ad'>{short}</div>", "<div class='advert sponsored'><p>{short}</p></div>", "<aside class='promo'><a href='/x'>{short}</a></aside>", "<div class='ads banner'><p>{short}</p></div>", ""),
    "side": ("<div class='sidebar'><h3>{word}</h3><ul>{links}</ul><p>{short}</p></div>", "<aside><h3>{word}</h3><p>{short}</p></aside>", "<div class='related widget'><h4>{word}</h4><ul>{links}</ul></div>", ""),
    "comments": ("<div class='comments'><h3>{word}</h3>{replies}</div>", "<section id='comments'>{replies}</section>", "<ol class='comment-list'>{replies}</ol>", ""),
    "form": ("<form><label>{word}</label><input name='q'><button>{word}</button></form>", "<form class='newsletter subscribe'><p>{short}</p><input><button>{word}</button></form>", "<div class='share social'>{inline}</div>", ""),
    "footer": ("<footer>&copy; {short}</footer>", "<div class='footer'><p>{short}</p><ul>{links}</ul></div>", "<div id='footer' class='copyright legal'>&copy; {short}</div>", "<footer><p>{short}</p>{inline}</footer>"),
}
_REPLIES = ("<div class='comment'><b>{word}</b><p>{long}</p></div>", "<article class='comment'><p>{long}</p></article>", "<li class='reply'><p>{long}</p></li>", "<div class='comment-body'>{long}</div>")


def laid_out(content: list[str], others: list[str], draw: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A page in another layout with the given content, and its labels; other texts fill the rest of the page."""
    def one(options):
        return options[draw.integers(len(options))]

    def words(low: int, high: int) -> str:
        text = one(others).split()
        start = int(draw.integers(max(1, len(text) - 3)))
        return entities.escape(" ".join(text[start : start + int(draw.integers(low, high))]) or "more")

    def links(item: str) -> str:
        return "".join(item.format(words(1, 3)) for _ in range(int(draw.integers(3, 8))))

    def part(kind: str) -> str:
        replies = "".join(one(_REPLIES).format(word=words(1, 2), long=words(4, 60)) for _ in range(int(draw.integers(1, 5))))
        values = {"links": links("<li><a href='/x'>{}</a></li>"), "inline": links("<a href='/x'>{}</a> "), "short": words(3, 20), "word": words(1, 3), "replies": replies}
        return one(_WRAPS[kind]).format(**values)

    start, end = "\x02", "\x03"
    frame, around, heading = one(_LAYOUTS)
    paragraphs = [
        one(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<h3>{}</h3>") if len(text) < 80 else ("<p>{}</p>", "<p>{}</p>", "<div>{}</div>"))
        .format(entities.escape(text)) for text in content[1:]]
    if len(paragraphs) > 1 and draw.random() < 0.5:  # something between two paragraphs
        paragraphs.insert(int(draw.integers(1, len(paragraphs))), f"<p>{end}</p>{part(one(('advert', 'advert', 'form', 'notice', 'comments', 'side')))}<p>{start}</p>")
    inner = heading.format(entities.escape(content[0])) + "".join(paragraphs)
    page = frame.format(article=f"<p>{start}</p>{around.format(inner)}<p>{end}</p>", title=f"<div class='site'>{words(1, 3)}</div>", **{kind: part(kind) for kind in _WRAPS})
    blocks, labels, within = [], [], 0
    for block in blocks_of(page):
        if block.text in (start, end):
            within = int(block.text == start)
            continue
        blocks.append(block)
        labels.append(within)
    return blocks, labels


def learn(pages: list[str], seed: int = 1, variants: int = VARIANTS) -> Chain | None:
    """Train on pages that mark up their article, as they are and in other layouts."""
    draw = np.random.Generator(np.random.PCG64(seed))
    read = [(blocks, labels) for page in pages if (labels := marked_up(blocks := blocks_of(page)[:TRAIN_BLOCKS]))]
    if not read:
        return None
    others = [b.text for blocks, _ in read for b in blocks]
    examples = []
    for blocks, labels in read:
        examples.append((features(blocks), labels))
        content = [b.text for b, y in zip(blocks, labels) if y]
        for _ in range(variants):
            made, marks = laid_out(content, others, draw)
            examples.append((features(made), marks))
    return train(examples)


def fit(pages: DataFrame, count: int = TRAIN_PAGES) -> Chain | None:
    """Learn from about ``count`` pages with an article of their own, chosen by the hash of their html."""
    html = pages.select("html").where(F.col("html").rlike("(?i)<(article|main)\\b"))
    total = html.count()
    draw = F.pmod(F.xxhash64(F.lit("pages"), "html"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = html.where(draw < min(1.0, count / max(1, total))).orderBy(F.xxhash64("html")).limit(2 * count)
    return learn([r.html for r in chosen.collect()])


def main_text(page: str | None, chain: Chain | None) -> str:
    blocks = blocks_of(page or "")
    labels = chain.decode(features(blocks)) if chain else marked_up(blocks) or []
    return "\n".join(block.text for block, label in zip(blocks, labels) if label)


def extract(pages: DataFrame, chain: Chain | None) -> DataFrame:
    """Pages with ``text`` and ``n_chars``; all other columns stay."""
    spark = pages.sparkSession
    ship_package(spark)
    plain = pages.drop("text", "n_chars")
    place = plain.columns.index("html")
    shared = spark.sparkContext.broadcast(chain)

    def read(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), shared.value) for page in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*batch.schema.names, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(read, f"{kinds}, text string, n_chars long")


@query()
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = only(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
