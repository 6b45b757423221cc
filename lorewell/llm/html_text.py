"""Main text of HTML pages by line-block distribution (operator 6).

Markup is stripped into lines, one for each block element; elements that are never article text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers) leave empty lines. Every line has a
weight: its text length, nothing for a line that is mostly links, and `SURGE` more inside an article or main element, so that its
short lines count as well. Where such elements hold `SHARE` of the page's text or more, lines outside weigh nothing. The weights
are summed over windows of `WINDOW` lines. The text surges where a window passes `SURGE` and either its first line does so alone
or the windows after it are not empty, and dives where the sums fall to nothing; the lines between surge and dive are
kept. Of a header inside an article its headings stay; its other lines (authors, dates, tools) go.

A null or empty page, or one without article text, gives an empty text. Repeated rows give repeated rows, and a sum that equals
`SURGE` is no surge. A page of any length is one row, scanned once from its start to its end; columns whose names clash with the
new ones stay, and the new ones get underscores.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

WINDOW, SURGE, SHARE = 3, 86, 0.25
_RAW = "script|style|noscript|template|svg|math|iframe|textarea|select|object|canvas|title|xmp|noembed|noframes"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{_RAW})\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|</?[a-z][^>]*>|<[!?/][^>]*(?:>|\Z)|<[a-z][^<>]*\Z",
    re.S | re.I,
)
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav aside footer form button dialog menu head label input fieldset".split())
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menus?|side-?bars?|ads?|adverts?|advertisements?|banners?|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|overlay|comments?|comment-?list|respond|disqus|replies"
    r"|foot|footers?|headers?|masthead|share|sharing|social|related|recommended|newsletter|subscribe|signup|breadcrumbs?|widgets?|login|search|pagination|pager|toolbar|complementary|contentinfo|skip-?link)(?=$|[\s_-])",
    re.I,
)
_HEAD = re.compile(r"(?:^|[\s_-])(?:headers?|masthead)(?=$|[\s_-])", re.I)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply)(?=$|[\s_-])", re.I)
_SPACE = re.compile(r"\s+")


def _names(attrs: str) -> str:
    return " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)) if "=" in attrs else ""


def lines_of(page: str) -> list[tuple[str, bool, float]]:
    """(text, inside article or main, share of link text) of each line; empty text where something was stripped whole."""
    out: list[tuple[str, bool, float]] = []
    buf: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, stripped (1: but for headings), inside main
    skip, main = 0, False
    link = linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
        if text or not out or out[-1][0]:  # tags that follow each other leave one empty line
            out.append((text, main, linked / max(len(text), 1)))
        buf.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if not skip and m.start() > at:
            piece = page[at : m.start()]
            buf.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m["end"] else 1
        if tag == "br":
            if not skip:
                buf.append(" ")
            continue
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if not skip:
                        flush()
                    del stack[i:]
                    was = skip
                    skip, main = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                    if was and not skip:
                        out.append(("", main, 0.0))
                    break
            else:
                if tag in _BLOCK and not skip:
                    flush()
            continue
        if tag in _BLOCK:
            if not skip:
                flush()
            if stack and stack[-1][0] == "p":
                stack.pop()
                skip, main = (stack[-1][1], stack[-1][2]) if stack else (0, False)
        names = _names(m["attrs"] or "")
        strip = 2 if tag in _NEVER else (1 if main else 2) if tag == "header" else 0
        if strip < 2 and names and tag not in ("body", "html", "main"):
            if tag == "article":
                strip = 2 * bool(_COMMENT.search(names))
            elif _BOILER.search(_HEAD.sub(" ", names)):
                strip = 2
            elif _HEAD.search(names):
                strip = 1 if main else 2
        if skip == 1 and tag in _HEADINGS and not strip:  # a heading in an article's header
            stack.append((tag, 0, main))
            skip = 0
            continue
        if tag in _VOID or (m["attrs"] or "").rstrip().endswith("/"):
            continue
        if strip or tag in _BLOCK and tag not in ("p", "li", "option") or tag == "head":
            if strip and not skip:
                flush()
            stack.append((tag, max(skip, strip), main or tag in ("article", "main") or "main" in names.lower().split()))
            skip, main = stack[-1][1], stack[-1][2]
    if not skip and at < len(page):
        buf.append(page[at:])
    flush()
    return out


def between(sizes: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Ranges of lines from each surge to the next dive of the window sums."""
    n, out, begin = len(sizes), [], None
    sums = [sum(sizes[i : i + window]) for i in range(n)]
    surge = min(surge, max(sums, default=0) / 2)  # a page of short lines surges at half its fullest window
    for i in range(n):
        if begin is None:
            if sums[i] > surge and sizes[i] and (sizes[i] > surge or any(sums[i + 1 : i + 1 + window]) or i + 1 >= n):
                begin = i
        elif sums[i] == 0:
            out.append((begin, i))
            begin = None
    if begin is not None:
        out.append((begin, n))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    weights = line_weights(lines)
    return "\n\n".join(lines[i][0] for a, z in between(weights) for i in range(a, z) if lines[i][0] and (weights[i] or not lines[i][1]))


def line_weights(lines: list[tuple[str, bool, float]]) -> list[int]:
    """The weight of each line of lines_of()."""
    inside = sum(len(t) for t, main, _ in lines if main)
    alone = inside and inside >= SHARE * sum(len(t) for t, _, _ in lines)
    return [0 if not t else len(t) + SURGE if main else 0 if alone or share > 0.5 else len(t) for t, main, share in lines]


def extract_text(pages: DataFrame, html_col: str = "html", text_name: str = "text", chars_name: str = "n_chars") -> DataFrame:
    """pages without the HTML column, with the main text and its length in code points; new names get underscores if taken."""
    rest = [c for c in pages.columns if c != html_col]
    (row,) = fresh(pages, "row")
    df = pages.select(F.struct(F.lit(0).alias(fresh(pages, "pad")[0]), *[F.col(f"`{c}`") for c in rest]).alias(row), F.col(f"`{html_col}`").cast("string").alias("page"))
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n"])

    done = df.mapInArrow(run, T.StructType([T.StructField("row", df.schema[row].dataType), T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
    a, b = fresh(pages.drop(html_col), text_name, chars_name)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.col("text").alias(a), F.col("n").alias(b))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op6_html_text": op6_html_text}
