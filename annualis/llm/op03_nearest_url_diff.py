"""Main text of HTML pages by nearest-URL page differencing.

A page is read into text lines, one for every block of its markup; each line knows whether
the markup itself calls it boilerplate (navigation, header, footer, aside, form, notice,
advert, comments, ...), article text (inside ``article`` or ``main``) or neither.  Pages of
a host are ordered by URL path and each is paired with the neighbour that shares the
longest path prefix.  The two line sequences are aligned by their longest common
subsequence; the lines they share are template lines and are deleted.

Lines inside ``article`` or ``main`` are compared like all others.  The element is a hint only:
the text is what the page has of its own inside it, unless more stands beside it (a teaser in an
article, the story in plain boxes).  A page whose text is mostly shared, and its article too, is a
copy of its neighbour, not a template, so that nothing is deleted from it.

Ordering a host needs no task that holds it: ids and paths (no texts) are range-partitioned,
neighbours are found inside each range, and the one row that each range lacks on either side
is joined in.  Only line hashes travel to the neighbour."""

from __future__ import annotations

import html as _html
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annualis.llm.common import written

# Element names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title select option svg math object canvas audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_BOILERPLATE = frozenset("nav aside footer form menu dialog button head label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class and id names that mark boilerplate.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion dfp adsense "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager toolbar topbar skip "
    "sidebar sidebars aside rail widget widgets header masthead banner banners footer foot colophon copyright "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social related recommended recommendations recirculation trending popular tags taglist".split())
#: Boxes that hold the page or its article: class names say nothing about their text there.
_HOLDERS = frozenset("html body main article".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^<>"']|"[^"]*"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^<>]*(?:>|\Z)|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")

BOILERPLATE, OPEN, ARTICLE = 0, 1, 2
#: A page with an article that shares more than this of its characters with its neighbour is a copy of it.
COPY = 0.8


def _marked(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element and all it holds is boilerplate by its markup."""
    if name in _BOILERPLATE or (name == "header" and not in_article):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if attrs.get("role", "").lower() in _ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    words = {w.lower() for w in _NAME.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
    if name in _HOLDERS:
        return name == "article" and bool(words & {"comment", "comments", "reply", "ad", "advert", "advertisement", "promo", "sponsored"})
    if in_article:  # an article's own header or its tags line stay text
        words -= {"header", "tags", "aside", "foot", "popular"}
    return bool(words & _MARKS)


def read_lines(html: str | None) -> list[tuple[str, int, int]]:
    """(text, kind, characters inside links) of the text blocks of a page, in page order.

    Unclosed and stray tags are tolerated; raw-text elements, comments and declarations give
    no text; character references are decoded; white space inside a block is one space."""
    html = html or ""
    lines: list[tuple[str, int, int]] = []
    parts: list[tuple[str, bool]] = []
    kind = OPEN
    stack: list[tuple[str, int, bool]] = []  # (element, kind around it, inside a link)
    link = False

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", "".join(t for t, _ in parts)).strip()
            if text:
                lines.append((text, kind, sum(len(t) for t, a in parts if a)))
            parts.clear()

    def close(depth: int) -> None:
        nonlocal kind, link
        block = any(n in _BLOCK for n, _, _ in stack[depth:])
        if block:
            flush()
        _, kind, link = stack[depth]
        del stack[depth:]

    pos, end = 0, len(html)
    while pos < end:
        m = _TOKEN.match(html, pos)
        token, pos = m.group(), m.end()
        if token[0] != "<" or token == "<":
            if kind != BOILERPLATE or token.strip():
                parts.append((_html.unescape(token) if "&" in token else token, link))
            continue
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                parts.append((token[9:-3] if token.endswith("]]>") else token[9:], link))
            continue
        closing = token[1] == "/"
        name = re.match(r"[^\s/>]+", token[1 + closing:]).group().lower()
        if closing:
            if name in ("p", "br"):
                parts.append((" ", link))
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if stack[depth][0] in ("article", "main", "body", "td", "th") and name not in ("article", "main", "body", "html", "table", "tr"):
                    break  # a stray end tag does not close what it stands in
            continue
        if name in _RAW:
            if token.endswith("/>") and name in ("svg", "iframe"):
                continue
            stop = re.compile(rf"</{name}\s*>", re.I).search(html, pos)
            pos = stop.end() if stop else end
            parts.append((" ", link))
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr", "img"):
                parts.append(("" if name == "wbr" else " ", link))
            continue
        if name in _BLOCK:
            flush()
            while stack and (stack[-1][0] == "p" or _closes(name, stack[-1][0])):
                close(len(stack) - 1)
            if any(n == "p" for n, _, _ in stack[-6:]):  # a block ends a paragraph left open
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p":
                        close(depth)
                        break
                    if stack[depth][0] in _BLOCK:
                        break
        if token.endswith("/>") and name not in _BLOCK:
            continue
        stack.append((name, kind, link))
        if kind != BOILERPLATE:
            attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(token[1 + len(name):].rstrip("/>"))} if " " in token or "\n" in token or "\t" in token else {}
            if _marked(name, attrs, kind == ARTICLE):
                if name not in _BLOCK:  # a marked inline element must not taint the text before it
                    flush()
                kind = BOILERPLATE
            elif name in ("article", "main"):
                kind = ARTICLE
        link = link or name == "a"
    flush()
    return lines


def _closes(new: str, open_: str) -> bool:
    return (new == open_ == "li") or (new in ("dt", "dd") and open_ in ("dt", "dd")) \
        or (new in ("td", "th", "tr") and open_ in ("td", "th")) or (new == "tr" and open_ == "tr")


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which lines of ``a`` lie on a longest common subsequence of ``a`` and ``b``.

    Common ends are cut off first; the rest is the longest increasing chain of matching line
    numbers, whose work grows with the number of matches."""
    n, m = len(a), len(b)
    out = [False] * n
    head = 0
    while head < n and head < m and a[head] == b[head]:
        out[head] = True
        head += 1
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail] == b[m - 1 - tail]:
        out[n - 1 - tail] = True
        tail += 1
    both = set(a[head:n - tail]) & set(b[head:m - tail])
    ia = [i for i in range(head, n - tail) if a[i] in both]
    jb = [j for j in range(head, m - tail) if b[j] in both]
    x, y = [a[i] for i in ia], [b[j] for j in jb]
    where: dict[int, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        where.setdefault(y[j], []).append(j)
    ends: list[int] = []
    best: list[tuple] = []
    for i, v in enumerate(x):
        for j in where[v]:
            k = bisect_left(ends, j)
            chain = (i, best[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                best.append(chain)
            else:
                ends[k] = j
                best[k] = chain
    chain = best[-1] if best else None
    while chain:
        out[ia[chain[0]]] = True
        chain = chain[1]
    return out


def main_text(lines: list[tuple[str, int, int]], shared: list[bool], template: list[bool]) -> str:
    """Article and open lines without those that the neighbour shares (article lines go only if they
    are templates of the host as well) and, where open, are mere links; joined by a blank line.  Open
    lines count if they outweigh the article."""
    def size(at: list[int]) -> int:
        return sum(len(lines[i][0]) for i in at)

    def own(at: list[int]) -> list[int]:
        return [i for i in at if not shared[i]]

    article, open_ = ([i for i, (_, k, _) in enumerate(lines) if k == kind] for kind in (ARTICLE, OPEN))
    if article:
        copy = size(own(article)) < (1 - COPY) * size(article) and size(own(article + open_)) < (1 - COPY) * size(article + open_)
    else:
        copy = 2 * (size(open_) - size(own(open_))) > size(list(range(len(lines))))
    inside, beside = (article, open_) if copy else ([i for i in article if not (shared[i] and template[i])], own(open_))
    beside = [i for i in beside if 2 * lines[i][2] <= len(lines[i][0])]
    kept = inside if inside and size(inside) >= size(beside) else sorted(inside + beside)
    return "\n\n".join(lines[i][0] for i in kept)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _pack(lines: list[tuple[str, int, int]]) -> bytes:
    return zlib.compress("\n".join(f"{kind} {linked} {text}" for text, kind, linked in lines).encode("utf-8", "surrogatepass"), 1)


def _unpack(packed: bytes) -> list[tuple[str, int, int]]:
    rows = zlib.decompress(packed).decode("utf-8", "surrogatepass")
    return [(t, int(k), int(x)) for k, x, t in (r.split(" ", 2) for r in rows.split("\n"))] if rows else []


def _read(pages: DataFrame, with_lines: bool) -> DataFrame:
    """key, host, path and line hashes of every page; ``with_lines`` adds the packed lines."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://|[?#].*$", "")
    keyed = pages.select("page_id", "url", html.alias("html"), F.regexp_extract(bare, r"^[^/]*", 0).alias("host"),
                         F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"(/|\.html?)$", "").alias("path"))
    schema = "page_id long, url string, host string, path string, hashes array<long>, lines binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                cut = b.slice(s, 256)
                read = [read_lines(t) for t in cut.column(2).to_pylist()]
                hashes = pa.array([[_hash(t) for t, _, _ in r] for r in read], pa.list_(pa.int64()))
                lines = pa.array([_pack(r) if with_lines else None for r in read], pa.binary())
                yield pa.record_batch([cut.column(0), cut.column(1), cut.column(3), cut.column(4), hashes, lines],
                                      ["page_id", "url", "host", "path", "hashes", "lines"])

    return keyed.mapInArrow(run, schema).withColumn("key", F.xxhash64("host", "path", "url", "hashes"))


def nearest(pages: DataFrame) -> DataFrame:
    """(key, host, other): the neighbour of every distinct page in its host's path order, by the
    longest common path prefix (a tie: the preceding one); a lone page has none.

    ``pages`` has key, host and path.  The order is over (host, path, key)."""
    ranged = pages.select("host", "path", "key").distinct().repartitionByRange("host", "path", "key") \
        .withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "order")
    w = Window.partitionBy("part").orderBy("host", "path", "key")
    row = F.struct("host", "path", "key")
    inner = ranged.withColumns({"before": F.lag(row).over(w), "after": F.lead(row).over(w)})
    ends = ranged.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    # one row a range: the ranges' ends, each with the range before and after it
    order = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(order).alias("above"), F.lead("first").over(order).alias("below"))
    both = inner.join(F.broadcast(ends), "part").select(
        "key", "host", "path", F.coalesce("before", "above").alias("before"), F.coalesce("after", "below").alias("after"))

    def common(side: str):
        same = F.zip_with(F.split("path", ""), F.split(f"{side}.path", ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
        stop = F.array_position(same, False)
        return F.when(F.col(f"{side}.host") == F.col("host"), F.when(stop > 0, stop - 1).otherwise(F.size(same)))

    b, a = common("before"), common("after")
    pick = F.when(a.isNull() | (b >= a), F.when(b.isNotNull(), F.col("before.key"))).otherwise(F.col("after.key"))
    return both.select("key", "host", pick.alias("other")).where("other is not null")


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, templates): hashes of the lines that half of a host's pages or more hold, of hosts with
    two pages or more.

    ``pages`` has a row per distinct page with host and hashes.  Lines are counted per host and line,
    so no host is one task; a host's list is at most twice as long as its pages are on average."""
    n = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    lines = pages.select("host", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("c"))
    often = lines.where("c > 1").join(n.where("n > 1"), "host").where("2 * c >= n")
    return often.groupBy("host").agg(F.collect_list("h").alias("templates"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars): one row per input row, in which text is the main text.

    Null and empty html give an empty text.  Null urls belong to a host of their own ("").
    Repeated rows are paired like one page and each get their row; copies of one page under
    one url are not each other's neighbours unless their html differs.  Extra columns are
    ignored."""
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).alias("html"))
    read = _read(named, False).groupBy("key").agg(*[F.first(c).alias(c) for c in ("host", "path", "hashes")])
    read = written(read, "hashes")
    other = read.select(F.col("key").alias("other"), F.col("hashes").alias("beside"))
    beside = nearest(read).join(other, "other").join(host_templates(read), "host", "left").select("key", "beside", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for packed, own, beside, templates in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                shared = shared_lines(own, beside) if beside else [False] * len(own)
                common = frozenset(templates or ())
                out.append(main_text(_unpack(packed), shared, [h in common for h in own]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string()),
                                   pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    done = _read(named, True).join(beside, "key", "left").select("page_id", "url", "lines", "hashes", "beside", "templates") \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
    return done.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
