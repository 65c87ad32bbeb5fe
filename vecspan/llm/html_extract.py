"""Main text of web pages, with each site's templates removed.

Element subtrees are hashed, the pages of a host that hold each hash are counted in Spark, and subtrees that recur
across many pages of the host are deleted, along with elements that are boilerplate by tag, role, class or id. A page's
``article`` or ``main`` element is its content. A subtree inside is a template if it recurs on half of the host's pages,
in contents that differ, and if the templates hold less than half of the page's content: quoted passages and copied
articles, exact or edited, stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

MIN_PAGES = 5
MIN_SHARE = 0.05
CONTENT_SHARE = 0.5  #: of a host's pages, for subtrees of content elements
MAX_BROADCAST_ROWS = 200_000

_VALUE = r"(?:\"[^\"<]*\"|'[^'<]*'|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^\s\"'>][^\s>]*+)"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*+)((?:[^=>]++|=\s*+{_VALUE}?)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("head script style noscript template svg math iframe object canvas audio video nav aside footer form button select textarea dialog menu fieldset label datalist map title".split())
_CONTENT = frozenset(("article", "main"))
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
_SCOPE = frozenset("table ul ol dl div section article main body html aside nav header footer form blockquote".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|adslot|banners?|sponsor\w*|promos?|promotions?|cookies?|consent|gdpr|notices?|notifications?|alerts?|sidebars?|menus?|nav|navbar|navigation|"
    r"breadcrumbs?|footer|foot|masthead|topbar|toolbar|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|pagination|pager|widgets?|skip-link)(?:$|[\s_-])",
    re.I,
)


#: whole class names that are no content inside of content either
_INSIDE = re.compile(
    r"(?:ads?|adverts?|advertisements?|adsense|adslot|ad[-_](?:slot|box|container|wrapper|unit|banner)|sponsored|promos?|comments?|commentlist|comments?[-_](?:list|area|section|thread|body|form|item)|disqus|disqus_thread|respond|replies|reply|"
    r"share|sharing|share[-_]?(?:buttons?|bar|links?)|social|social[-_](?:share|links|media|buttons)|sharedaddy|related|related[-_](?:posts|articles|stories|links)|recommended|recommendations|newsletter|newsletter[-_]\w+|subscribe|"
    r"cookies?[-_]?(?:notice|banner|consent)?|consent|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|popup|modal|overlay|widgets?|skip-link|login|signup)",
    re.I,
)


def _boilerplate(tag: str, attributes: str, in_content: bool) -> bool:
    if tag in _DROP or tag == "header" and not in_content:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    exact = in_content or tag == "article"
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        named = name in ("class", "id") and (any(map(_INSIDE.fullmatch, value.split())) if exact else _NAMES.search(value))
        if named or name == "role" and value.strip().lower() in _ROLES or name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class _Page:
    """One pass over a page: blocks of text (in content, text, in a template), and hashes of subtrees (hash, in content)."""

    def __init__(self, source: str, templates: frozenset[int] | None = None) -> None:
        self.blocks: list[tuple[bool, str, bool]] = []
        self.subtrees: list[tuple[int, bool]] = []
        self.has_content = False
        self._text: list[str] = []
        #: (tag, position, blocks so far, drops, in content)
        self._open: list[tuple[str, int, int, bool, bool]] = []
        self._dropping = self._content = 0
        self._templates = templates
        self._run(source)

    def _end_block(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._content > 0, text, False))
            self._text = []

    def _pop(self, source: str, end: int) -> None:
        tag, start, blocks, drops, content = self._open.pop()
        if tag in _BLOCK:
            self._end_block()
        if content:
            self._content -= 1
        if drops:
            self._dropping -= 1
        if not content and not self._dropping and tag in _BLOCK and tag not in ("html", "body"):
            inside = self._content > 0
            h = xxhash.xxh3_64_intdigest(source[start:end].encode("utf-8", "surrogatepass"), int(inside)) - (1 << 63)
            if self._templates is None:
                self.subtrees.append((h, inside))
            elif h in self._templates:
                self.blocks[blocks:] = [(c, t, c == inside or gone) for c, t, gone in self.blocks[blocks:]]

    def _close_to(self, names: tuple[str, ...], source: str, end: int) -> None:
        """Close the nearest open element of ``names`` within the scope, with all in it."""
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] in names:
                while len(self._open) > k:
                    self._pop(source, end)
                return
            if self._open[k][0] in _SCOPE:
                return

    def _run(self, source: str) -> None:
        at = 0
        skip_to = 0
        for m in _TAG.finditer(source):
            start, end = m.span()
            if start < skip_to:
                continue
            if start > at and not self._dropping:
                self._text.append(source[at:start])
            at = end
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if any(o[0] == tag for o in self._open):
                    while self._open[-1][0] != tag:
                        self._pop(source, start)
                    self._pop(source, end)
                elif tag in _BLOCK:
                    self._end_block()
                continue
            if tag in _VOID:
                if tag == "br":
                    self._text.append(" ")
                elif tag == "hr":
                    self._close_to(("p",), source, start)
                    self._end_block()
                continue
            if tag in _BLOCK:
                self._close_to(("p",), source, start)
                if tag in _CLOSES:
                    self._close_to(_CLOSES[tag], source, start)
                self._end_block()
            drops = _boilerplate(tag, m[3], self._content > 0)
            content = tag in _CONTENT and not self._dropping or "role" in m[3] and bool(re.search(r"role\s*=\s*[\"']?main\b", m[3]))
            if tag in _RAW:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, end)
                if not drops and not self._dropping:
                    self._text.append(source[end : close.start() if close else len(source)])
                at = skip_to = close.end() if close else len(source)
                continue
            if m[0].endswith("/>") and tag not in _BLOCK:
                continue
            self._open.append((tag, start, len(self.blocks), drops, content))
            self._dropping += drops
            self._content += content
            self.has_content |= content
        if at < len(source) and not self._dropping:
            self._text.append(source[at:])
        self._end_block()
        while self._open:
            self._pop(source, len(source))


    def kept(self) -> list[str]:
        own = [b for b in self.blocks if b[0] or not self.has_content]
        if self.has_content and 2 * sum(len(t) for _, t, gone in own if gone) >= sum(len(t) for _, t, _ in own):
            return [t for _, t, _ in own]
        return [t for _, t, gone in own if not gone]


def subtree_hashes(source: str | None) -> list[tuple[int, int]]:
    """Distinct hashes of a page's block elements, with a hash of the page's content for those inside of it, else 0."""
    if not source:
        return []
    page = _Page(source)
    content = xxhash.xxh3_64_intdigest("\n".join(page.kept()).encode("utf-8", "surrogatepass")) >> 1 | 1
    return [(h, content if inside else 0) for h, inside in dict.fromkeys(page.subtrees)]


def main_text(source: str | None, templates: frozenset[int] = frozenset()) -> str:
    """Main text of a page: blocks in page order, joined by blank lines. Null and empty pages give an empty text.

    White space in a block is one space, character references are decoded. With an ``article`` or ``main`` element
    only its blocks count, otherwise all; blocks in boilerplate or in a subtree of ``templates`` don't.
    """
    return "\n\n".join(_Page(source, templates).kept()) if source else ""


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, content_share: float = CONTENT_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that stand on at least ``min_pages`` pages and ``min_share`` of the pages of a host;
    inside of content, on ``content_share`` of them and in two contents at least.

    Counts are over all pages, with partial sums before the shuffle. A host has at most 1 / min_share times the
    subtrees of an average page of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, contents = [], [], []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                for h, content in ((0, 0), *subtree_hashes(source)):  # 0 counts the page
                    hosts.append(host)
                    hashes.append(h)
                    contents.append(content)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(contents, pa.int64())], ["host", "hash", "content"])

    each = _with_host(pages).select("host", "html").mapInArrow(run, "host string, hash long, content long")
    counted = each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    counts = materialize(counted.where(f"n >= {int(min_pages)} and (high = 0 or low < high) or hash = 0"), "subtrees")
    of_host = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    return counts.where("hash <> 0").join(of_host, "host").where(F.col("n") >= F.when(F.col("high") > 0, content_share).otherwise(min_share) * F.col("pages")).select("host", "hash")


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"))


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null and empty pages have an empty text; pages whose url is null or has no host form one host. Repeated rows stay,
    and count as pages of their host. Other columns are ignored. Broken markup never fails: unclosed elements end with the page.
    """
    templates = site_templates(pages, min_pages, min_share).groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("templates"))
    templates = materialize(templates, "templates")
    n = templates.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0))).first()[0]
    joined = _with_host(pages).join(F.broadcast(templates) if n <= MAX_BROADCAST_ROWS else templates, "host", "left").select("page_id", "url", "html", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset] = {}
        for batch in batches:
            out = []
            for source, hashes in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist()):
                key = tuple(hashes or ())
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = frozenset(key)
                out.append(main_text(source, known[key]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
