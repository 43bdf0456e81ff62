"""Main text of web pages, by removal of site templates.

A page is cut into its element tree.  Every block-level subtree with text gets
a hash of its tags and text; Spark counts, for each host, on how many pages
with different main text a hash stands (a page counts by its longest block, so
copies of an article under several addresses count once).  A subtree that
recurs on many pages of its host is template and is deleted, with all in it.

The article is the content of ``article`` elements, else of ``main``, else of
the whole body.  Its paragraphs, headings, lists and tables are its author's:
a passage that a site prints in many articles is still text of each, so inside
an article only sections and boxes can be template, and only if they stand on
half of the host's pages.  Elements that say what they are (nav, footer, aside,
form, script, class="ad", id="comments", role="navigation", ...) go as well,
also on pages whose host has too few pages to count.

Blocks travel compressed, as one text with empty lines between them (a block
holds no line break), and only those of pages where an unmarked subtree holds
some of them; the text of other pages is settled where it is read.  A host's
pages need not meet in one task: hashes are counted map-side first by (host,
hash, main text), then by (host, hash), and looked up with a salt.

Defined cases: a null or empty page has no text; a page without a host (null
or relative address) has no template, only marked elements go; unclosed
elements end with their parent, a cut-off tag at the end is no text, an unknown
character reference stays as it is; rows that repeat a page are returned each,
and count as one page; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.llm.components import stored

# Many pages: at least so many, and this share of the host's pages.
MIN_PAGES = 5
MIN_SHARE = 0.005
# ... for boxes inside an article.
INNER_SHARE = 0.5
SALTS = 8

# Fixed values of the HTML standard: elements without content, elements whose
# content is not markup, and elements that begin and end a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_P, _NOT_P = frozenset({"p"}), _BLOCK - {"p"}
_ENDS_P = _BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody tfoot "
                             "thead tr".split()) | {"hr"}
# An element that ends open ones of the same kind, up to a container.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "thead": ({"tr", "td", "th"}, {"table"}),
}

# Elements that are never part of an article.
_RULED = frozenset(
    "script style template noscript noembed noframes iframe head title nav footer aside form button "
    "select option textarea input object svg canvas map dialog menu search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog "
                   "menu menubar toolbar".split())
# Words of class and id that name such an element.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense advertising sponsor sponsored promo "
    "promotion cookie cookies consent gdpr notice notices notification banner popup modal sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead footer comment "
    "comments disqus respond share sharing social related recommended newsletter subscribe signup "
    "login widget widgets toolbar".split())
# ... also with a header's name, outside articles and unless it is the article's own,
_HEADER, _OWN_HEADER = "header", frozenset("post entry article title".split())
# ... but not if it only tells that the page has such an element.
_NOT_NAMES = frozenset("with without no not has have is".split())
# What can be template inside an article.
_BOX = frozenset("div section header fieldset details".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?P<close>>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for tag in _RAW}


def _marked(tag: str, attrs: str, root: str) -> bool:
    """Whether class, id or role name an element that is no article text."""
    if "=" not in attrs or tag in ("html", "body", "main"):
        return False
    for name, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            if value.strip() in _ROLES:
                return True
            continue
        for token in value.split():
            words = _NAME.findall(token)
            if not words or _NOT_NAMES.intersection(words):
                continue
            if words[0] in _NAMES or words[-1] in _NAMES:
                return True
            if words[-1] == _HEADER and not root and not _OWN_HEADER.intersection(words):
                return True
    return False


class _Element:
    """An open element: whether it or an element around it is marked, the kind
    of article around its content, whether it lies in one, the texts and hashes
    of its content, and the number of blocks before it."""

    __slots__ = ("tag", "ruled", "own_ruled", "root", "inner", "holds_root", "parts", "first_block",
                 "outside")

    def __init__(self, tag: str, ruled: bool, own_ruled: bool, root: str, inner: bool, first_block: int):
        self.tag, self.ruled, self.own_ruled = tag, ruled, own_ruled
        self.root, self.inner, self.holds_root = root, inner, False
        self.parts: list[str] = []
        self.first_block = first_block
        self.outside: list[str] | None = None  # the block around a marked inline element


class Page:
    """Blocks and candidate subtrees of one page.

    ``blocks`` holds (text, root) of the blocks that no marked element hides,
    in page order; ``subtrees`` holds (hash, inner, marked, first, end): the
    block-level subtrees that may be template, with the range of blocks that
    they cover."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str]] = []
        self.subtrees: list[tuple[int, bool, bool, int, int]] = []
        self.roots: set[str] = set()
        self._stack: list[_Element] = []
        self._open_tags: Counter[str] = Counter()
        self._text: list[str] = []
        self._open("#page", "")
        self._read(source)
        while self._stack:
            self._close()

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if not m:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at:m.start()])
            at = m.end()
            tag = m["tag"]
            if not tag or not m["close"]:
                continue  # a comment, or a tag that the page's end cuts off
            tag = tag.lower()
            if m["end"]:
                self._end(tag)
                continue
            attrs = m["attrs"]
            self._start(tag, attrs)
            if tag in _RAW:
                stop = _RAW_END[tag].search(source, at)
                if tag in ("textarea", "title"):
                    self._add(source[at:stop.start() if stop else end])
                at = stop.end() if stop else end
                self._end(tag)

    def _add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._text.append(text)

    def _flush(self) -> None:
        """Ends the block that is being read."""
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        self._text = []
        if not text:
            return
        top = self._stack[-1]
        top.parts.append(text)
        if not top.ruled:
            self.blocks.append((text, top.root))

    def _start(self, tag: str, attrs: str) -> None:
        if self._stack[-1].tag == "head" and tag not in _IN_HEAD:
            self._close()
        if tag in _ENDS_P:
            self._end_open(_P, _NOT_P)
        if tag in _ENDS:
            self._end_open(*_ENDS[tag])
        if tag == "br" or tag in ("td", "th"):
            self._text.append(" ")
        if tag == "hr":
            self._flush()
        if tag in _VOID:
            return
        self._open(tag, attrs)

    def _open(self, tag: str, attrs: str) -> None:
        parent = self._stack[-1] if self._stack else None
        root = parent.root if parent else ""
        own = tag in _RULED or (tag == "header" and not root) or _marked(tag, attrs, root)
        if tag in _BLOCK:
            self._flush()
        ruled = own or (parent.ruled if parent else False)
        inner = bool(root)
        if not ruled and (tag == "article" or (tag == "main" and root != "article")):
            root = tag
            self.roots.add(tag)
            for e in self._stack:
                e.holds_root = True
        self._stack.append(_Element(tag, ruled, own, root, inner, len(self.blocks)))
        self._open_tags[tag] += 1
        if own and tag not in _BLOCK:
            self._stack[-1].outside, self._text = self._text, []

    def _close(self) -> None:
        top = self._stack[-1]
        block = top.tag in _BLOCK or top.own_ruled or top.tag == "#page"
        if block:
            self._flush()
        if top.outside is not None:
            self._text = top.outside
        self._stack.pop()
        self._open_tags[top.tag] -= 1
        if not block:
            if self._stack:
                self._stack[-1].parts += top.parts
            return
        if not top.parts or not self._stack:
            return
        hashed = xxhash.xxh64_intdigest("\x00".join([top.tag, *top.parts]))
        parent = self._stack[-1]
        parent.parts.append(f"\x01{hashed:x}")
        is_root = top.root and not top.inner
        if top.tag in ("head", "title", "script", "style") or top.holds_root or is_root:
            return
        hidden = top.ruled and not top.own_ruled  # its marked parent speaks for it
        if not hidden and (not top.inner or top.own_ruled or top.tag in _BOX):
            self.subtrees.append((hashed - (1 << 63), top.inner and not top.own_ruled, top.own_ruled,
                                  top.first_block, len(self.blocks)))

    def _end(self, tag: str) -> None:
        if tag in ("td", "th"):
            self._text.append(" ")
        if not self._open_tags[tag]:
            if tag == "p":
                self._flush()
            elif tag == "br":
                self._text.append(" ")
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                while len(self._stack) > i:
                    self._close()
                return
            if tag not in _BLOCK and self._stack[i].tag in _BLOCK:
                return  # a stray inline end tag stays inside its block

    def _end_open(self, tags, limit) -> None:
        if not any(self._open_tags[t] for t in tags):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag in tags:
                while len(self._stack) > i:
                    self._close()
                return
            if self._stack[i].tag in limit:
                return

    def root(self) -> str:
        return "article" if "article" in self.roots else "main" if "main" in self.roots else ""


_PARSED = ("page_id long, url string, host string, main long, blocks binary, "
           "subtrees array<struct<hash: long, inner: boolean, marked: boolean, first: int, stop: int>>")


def host_of(url: Column) -> Column:
    """The host of an absolute address, in lower case; else null."""
    found = F.lower(F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def parse(pages: DataFrame) -> DataFrame:
    """Pages with their blocks (those of the article) and candidate subtrees."""
    types = pa.list_(pa.struct([("hash", pa.int64()), ("inner", pa.bool_()), ("marked", pa.bool_()),
                                ("first", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                mains, blocks, subtrees = [], [], []
                for source in batch.column("html").to_pylist():
                    page = Page(source or "")
                    root = page.root()
                    keep = [r == root or not root for _, r in page.blocks]
                    place = [0]
                    for k in keep:
                        place.append(place[-1] + k)
                    own = [t for (t, _), k in zip(page.blocks, keep, strict=True) if k]
                    longest = max(own, key=len, default=source or "")
                    mains.append(xxhash.xxh64_intdigest(longest) - (1 << 63))
                    blocks.append(packer.compress("\n\n".join(own).encode()))
                    subtrees.append([{"hash": h, "inner": i, "marked": m, "first": place[a], "stop": place[b]}
                                     for h, i, m, a, b in page.subtrees])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), batch.column("host"),
                     pa.array(mains, pa.int64()), pa.array(blocks, pa.binary()),
                     pa.array(subtrees, types)],
                    names=["page_id", "url", "host", "main", "blocks", "subtrees"])

    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
                        host_of(url).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, _PARSED)


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
              inner_share: float = INNER_SHARE) -> DataFrame:
    """host, hash, pages, outer, inner: subtrees that recur on many pages of
    their host, and whether they do outside and inside articles."""
    seen = (parsed.filter("host is not null")
            .select("host", "main", F.explode(F.array_distinct(F.concat(
                F.array(F.lit(None).cast("long")), F.col("subtrees.hash")))).alias("hash"))
            .groupBy("host", "hash", "main").agg(F.lit(1).alias("one"))
            .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")))
    seen = stored(seen.filter((F.col("pages") >= min_pages) | F.col("hash").isNull()), "subtrees")
    hosts = seen.filter("hash is null and pages >= " + str(int(min_pages))).select(
        "host", F.col("pages").alias("of"))
    many = seen.filter("hash is not null").join(hosts, "host")
    return many.select("host", "hash", "pages", (F.col("pages") >= F.col("of") * min_share).alias("outer"),
                       (F.col("pages") >= F.col("of") * inner_share).alias("inner")).filter("outer")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
            inner_share: float = INNER_SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_template (subtrees with text of the
    article that were deleted as template of the site), n_marked (subtrees that
    said what they are)."""
    parsed = stored(parse(pages).withColumn("row", F.monotonically_increasing_id()), "parsed_pages")
    # what may change a text: unmarked subtrees that hold blocks of it
    holding = F.filter("subtrees", lambda s: s["first"] < s["stop"])
    marked = F.size(F.filter("subtrees", lambda s: s["marked"])).cast("long").alias("n_marked")
    none = F.array().cast("array<int>")
    result = ["page_id", "url", "blocks", "first", "stop", "n_marked"]
    may = F.col("host").isNotNull() & (F.size("holding") > 0)
    parsed = parsed.select("*", holding.alias("holding"), marked)
    open_ = parsed.filter(may).select("row", "host", "page_id", "url", "blocks", "holding", "n_marked")
    # a template of a large host stands on many rows: they are looked up by
    # host, hash and a salt
    salted = templates(parsed, min_pages, min_share, inner_share).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = (open_.select("row", "host", F.explode("holding").alias("s"),
                         F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
            .select("row", "host", "salt", F.col("s.hash").alias("hash"), F.col("s.inner").alias("inside"),
                    F.struct("s.first", "s.stop").alias("range"))
            .join(salted, ["host", "hash", "salt"]).filter("not inside or inner")
            .groupBy("row").agg(F.collect_set("range").alias("gone")))
    opened = open_.join(gone, "row", "left").select(
        "page_id", "url", "blocks", *[F.coalesce(F.col("gone")[c], none).alias(c) for c in ("first", "stop")],
        "n_marked")
    settled = parsed.filter(~may).select("page_id", "url", "blocks", none.alias("first"),
                                         none.alias("stop"), "n_marked")
    return settled.select(result).unionByName(opened.select(result)).mapInArrow(
        _left, "page_id long, url string, text string, n_chars long, n_template long, n_marked long")


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the blocks of deleted subtrees."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = []
        gone = zip(batch.column("first").to_pylist(), batch.column("stop").to_pylist(), strict=True)
        for packed, (first, stop) in zip(batch.column("blocks").to_pylist(), gone, strict=True):
            text = unpacker.decompress(packed).decode()
            if any(a < b for a, b in zip(first, stop, strict=True)):
                blocks = text.split("\n\n")
                keep = np.ones(len(blocks), dtype=bool)
                for a, b in zip(first, stop, strict=True):
                    keep[a:b] = False
                text = "\n\n".join(b for b, k in zip(blocks, keep, strict=True) if k)
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64()),
             pa.array([len(x) for x in batch.column("first").to_pylist()], pa.int64()),
             batch.column("n_marked")],
            names=["page_id", "url", "text", "n_chars", "n_template", "n_marked"])
