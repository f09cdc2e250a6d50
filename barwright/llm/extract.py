"""Main text of web pages: flat text blocks, described by their own and their neighbours' word counts and link
densities and by the containers around them, kept or left out by a decision tree trained on a small labelled table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barwright.llm.trees import decide, parse_trees

# Element names and the words in class, id and role that tell what a container holds
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset(
    "article aside body dialog details div fieldset figure footer form header main menu nav ol section select table ul head "
    "button blockquote dl".split()
)
RAW = frozenset("script style noscript template iframe object svg math textarea noembed noframes xmp".split())
DROPPED = frozenset(["head", "title"])
BOILER = frozenset("nav footer aside form dialog menu button select fieldset".split())
CONTENT = frozenset(["article", "main"])
HINTS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side|ad|ads|adv|advert|adverts|advertisement|"
    r"adsense|banner|promo|promotion|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|signup|login|search|share|sharing|social|comment|comments|disqus|reply|replies|respond|related|"
    r"recommended|breadcrumb|breadcrumbs|pagination|pager|widget|toolbar|copyright|legal|disclaimer|skip|contentinfo|"
    r"complementary|form)(?:$|[\s_-]|\d)"
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "boiler", "content"]


def is_boiler(name: str, attributes: str, in_content: bool) -> bool:
    """Does this element hold something else than the article? A header inside an article is part of it."""
    if name in BOILER or (name == "header" and not in_content):
        return True
    if attributes:
        for k, a, b, c in _ATTRIBUTE.findall(attributes):
            k, v = k.lower(), (a or b or c).lower()
            if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none", v)):
                return True
            if k in ("class", "id", "role") and name not in ("body", "html", "article", "main") and HINTS.search(v):
                return True
    return False


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words inside links, in a boilerplate container, in an article) in page order; no empty ones.

    Unclosed and stray tags are tolerated: an end tag closes the nearest open container of its name, or nothing.
    """
    out: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate here or above, article here or above
    own_boiler: list[str] = []  # open elements that are not containers but marked as boilerplate
    pieces: list[str] = []
    linked: list[str] = []
    in_link = False
    pos, end = 0, len(page)

    def close() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                _, boiler, content = stack[-1] if stack else ("", False, False)
                out.append((text, text.count(" ") + 1, len("".join(linked).split()), boiler or bool(own_boiler), content))
            pieces.clear()
            linked.clear()

    def add(text: str) -> None:
        text = entities.unescape(text) if "&" in text else text
        pieces.append(text)
        if in_link:
            linked.append(text)

    while pos < end:
        m = _TOKEN.search(page, pos)
        if not m:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in RAW or (name in DROPPED and not closing):
            if not closing and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>" + (r"|(?=<body\b)" if name == "head" else ""), re.I).search(page, pos)
                pos = stop.end() if stop else end
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = not closing
            continue
        if name in BLOCK:
            close()
            in_link = False
            own_boiler.clear()
        if name in CONTAINER:
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                _, boiler, content = stack[-1] if stack else ("", False, False)
                stack.append((name, boiler or is_boiler(name, attributes, content), content or name in CONTENT))
        elif not closing and name in BLOCK and attributes and is_boiler(name, attributes, False):
            own_boiler.append(name)
    close()
    return out


def features(found: list[tuple[str, int, int, bool, bool]]) -> list[list[float]]:
    """One row for each block, in the order of FEATURES. Without any article on the page, `content` is one half."""
    size = [float(w) for _, w, _, _, _ in found]
    density = [min(1.0, a / w) for _, w, a, _, _ in found]
    has = any(c for *_, c in found)
    rows = []
    for k, (_, _, _, boiler, content) in enumerate(found):
        before, after = k - 1 if k else None, k + 1 if k + 1 < len(found) else None
        rows.append([
            size[k], density[k], 0.0 if before is None else size[before], 0.0 if before is None else density[before],
            0.0 if after is None else size[after], 0.0 if after is None else density[after],
            float(boiler), float(content) if has else 0.5,
        ])
    return rows


_LONG = "The council met on Tuesday to discuss the new bridge and how the town would pay for it over ten years."
_MORE = "Engineers said that the old pillars were sound, but that the deck had to be replaced before the winter came."
_LAST = "A vote is planned for June, after the public has had a chance to see the drawings and to comment on them."
_LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul>'
#: The labelled table: pages, and which of their blocks are main text.
LABELLED = [
    (f"<nav>{_LINKS}</nav><article><h1>New bridge</h1><p>{_LONG}</p><p>Yes.</p><p>{_MORE}</p></article><footer>&copy; Town "
     "paper</footer>", ["New bridge", _LONG, "Yes.", _MORE]),
    (f'<div class="ad">Buy two lamps and get a third one free today</div><article><h1>Vote in June</h1><p>{_LAST}</p><p>It '
     'passed.</p></article><aside><p>Most read this week in our town</p></aside>', ["Vote in June", _LAST, "It passed."]),
    (f'<header><p>The Town Paper, every morning since 1901</p></header><main><p>{_LONG}</p><p>No.</p><ul><li>One pillar</li>'
     f'<li>Two pillars</li></ul></main><form><p>Leave your address and we will write to you each week</p></form>',
     [_LONG, "No.", "One pillar", "Two pillars"]),
    (f'<article><p>{_MORE}</p><p>See the <a href="/x">drawings</a>.</p><section class="comments"><p>I have lived here for '
     f'forty years and the bridge was never a problem for anyone that I know of.</p></section></article>',
     [_MORE, "See the drawings."]),
    (f'<article><p><a href="/r">Report of the engineers</a></p><p>{_LAST}</p></article><div id="cookie-notice"><p>We use '
     f'cookies to make this page work, and you agree to that by reading on.</p></div>', ["Report of the engineers", _LAST]),
    (f"<div>{_LINKS}</div><div><p>{_LONG}</p><p>{_MORE}</p><p>{_LAST}</p></div><div><a href='/p'>Privacy</a> <a href='/t'>Terms"
     "</a></div>", [_LONG, _MORE, _LAST]),
    (f"<div>{_LINKS}</div><div><h2>New bridge</h2><p>{_LONG}</p><p>Yes.</p><p>{_MORE}</p></div><div><a href='/q'>Imprint</a>"
     "</div>", ["New bridge", _LONG, "Yes.", _MORE]),
    (f"<table><tr><td>{_LINKS}</td><td><p>{_MORE}</p><p>{_LAST}</p></td></tr></table><p><a href='/n'>Next page</a></p>",
     [_MORE, _LAST]),
    (f'<div class="sidebar"><p>{_LONG}</p></div><div><p>{_LAST}</p><p>{_MORE}</p></div>', [_LAST, _MORE]),
    (f"<article><p>Is.</p></article><footer><p>{_LONG}</p></footer>", ["Is."]),
    (f"<div class='ad'>{_MORE}</div><article><h1>It</h1><p>{_LAST}</p></article>", ["It", _LAST]),
    (f"<nav><p>{_LAST}</p></nav><article><p>A b c</p><p>D</p><p>E f</p></article>", ["A b c", "D", "E f"]),
    (f"<p>{_LONG}</p><article><p>Short one</p><p>Two</p></article><p>{_MORE}</p>", ["Short one", "Two"]),
    (f"<p>{_MORE}</p><p>{_LONG}</p>", [_MORE, _LONG]),
    (f"<p>Short words here</p><p>{_LONG}</p><p>Ok.</p>", ["Short words here", _LONG, "Ok."]),
]


def labelled_blocks() -> list[tuple[list[float], int]]:
    out = []
    for page, main in LABELLED:
        found = blocks(page)
        seen = list(main)
        for (text, *_), x in zip(found, features(found), strict=True):
            # the same sentence may stand once in the article and once elsewhere: boilerplate is never main text
            label = int(text in seen and not x[6] and x[7] != 0.0)
            out.append((x, label))
    return out


def train_tree(spark: SparkSession, depth: int = 6):
    """A Spark ML decision tree over the labelled blocks, as plain values."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.dense(x), float(y)) for x, y in labelled_blocks()], ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=1, maxBins=64, seed=7).fit(rows.coalesce(1))
    return parse_trees(model.toDebugString)[0]


def main_text(page: str | None, tree) -> str:
    """Kept blocks in page order, one line each; empty if there are none."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b[0] for b, x in zip(found, features(found), strict=True) if decide(tree, x) >= 0.5)


def extract_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars for every page, without a shuffle. Null or empty html: empty text.

    Nothing is cut: pages are parsed whole, one at a time.
    """
    tree = train_tree(pages.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [main_text(p, tree) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[key, url, "text", "n_chars"],
                )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(key, url, html).mapInArrow(batches, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
