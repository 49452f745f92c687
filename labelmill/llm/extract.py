"""Main text of web pages: each page proposes a container, hosts vote, pages are read again by the winning paths.

1. Every page is parsed and scored: of each element the readable text that is not linked and not in menus, headers,
   footers, sidebars, notices, adverts, forms or reader comments. Its container is the largest ``article``, else the
   deepest element below ``main`` or ``body`` that still holds ``MOST`` of the score.
2. The container's path of tags and classes, numbers generalised, is the page's vote. Spark counts the votes of each
   host, partial sums first, so a host of any size costs no more than its different paths.
3. Paths with at least a ``FEW``-th of a host's most voted path (``PATHS`` at most) win. Each page is read again: of
   the winning paths that lead to text in it the deepest is taken, so that a page whose own text is too short to stand
   out follows the others. Where none leads to text, or the page has no host, its own container holds.

Blocks are runs of text between block-level tags; ``br`` is a blank. Character references are decoded, white space
in a block is one blank, blocks are joined by two newlines in page order. Broken markup is read as browsers do: tags
left open end with their parent, a tag cut off by the end of the page is none. A null or empty page, or one without
readable text, has the empty text. Rows are read each on its own, whatever their ids; input columns named like an
added one in any case are replaced.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .columns import beside
from .storage import materialise
from .textbuf import batch_pieces

MOST, ARTICLE, LINKED, FEW, PATHS = 0.8, 0.25, 0.9, 5, 5
#: Bytes of all winning paths up to which they are broadcast; beyond, they are joined by host.
BROADCAST_BYTES = 16 << 20

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements without text of the article.
NEVER = frozenset("script style textarea title xmp iframe noembed noframes noscript head nav footer aside form button select option template svg math object canvas audio video dialog menu header".split())
#: What a class, id or role begins or ends with that stands for something beside the article.
BESIDE = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter "
    "subscribe subscription share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation topnav subnav sidebar sidebars aside widget widgets footer header masthead comment comments commentlist disqus respond replies "
    "reply related recommended recommendations pagination pager login signup signin register search toolbar skip hidden copyright disclaimer complementary contentinfo dialog form".split()
)
_STATE = frozenset("with has no is not js".split())
_TOKEN = re.compile(r"""<(?:(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|!--(?:>|->|(?s:.*?)--!?>|(?s:.*))|[!?/][^>]*+>)""")
_ATTR = re.compile(r"""(?P<name>[^\s=>"'/]++)\s*+=\s*+(?:"(?P<d>[^"]*+)"|'(?P<s>[^']*+)'|(?P<u>[^\s>]*+))|(?P<bare>[^\s=>"'/]++)""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_P_SCOPE = frozenset("td th caption button object template".split())
#: Open elements that a start tag ends, and those that keep it from looking further up.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}


@lru_cache(1 << 14)
def is_beside(value: str) -> bool:
    """Whether a class, id or role names something beside the article by its first or last word."""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        words = [w for w in words if not w.isdigit()]
        if words and words[0] not in _STATE and (words[0] in BESIDE or words[-1] in BESIDE):
            return True
    return False


@lru_cache(1 << 14)
def label(tag: str, classes: str) -> str:
    """A step of a path: the tag and its classes, numbers generalised."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes.split()})])


class Page:
    """A page's block-level elements in page order, and its blocks of text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.step, self.skip, self.main = [-1], ["html"], ["html"], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, linked characters
        self._read(source)
        self._menus()
        n = len(self.parent)
        self.score, self.path = [0] * n, ["html"] * n
        for at, text, linked in self.blocks:
            if not self.skip[at]:
                self.score[at] += max(len(text) - linked, 0)
        for k in range(n - 1, 0, -1):
            self.score[self.parent[k]] += self.score[k]
        self.children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            self.path[k] = f"{self.path[self.parent[k]]}>{self.step[k]}" if self.depth_ok(k) else self.path[self.parent[k]]
            self.children[self.parent[k]].append(k)

    def depth_ok(self, k: int) -> bool:
        """Paths of more than 2 000 signs are not told apart: no real template nests so deep."""
        return len(self.path[self.parent[k]]) < 2000

    def _read(self, source: str) -> None:
        frames = [(0, "html", [], {})]  # element, tag, open inline tags as (tag, skipped, link), how many of each
        blocks_open: dict[str, int] = {}
        p_open, words, linked = [0], [], 0
        at, last = 0, source.rfind(">")

        def flush():
            nonlocal words, linked
            if words:
                text = " ".join("".join(words).split())
                if text:
                    self.blocks.append((frames[-1][0], text, linked))
                words, linked = [], 0

        def say(text: str):
            nonlocal linked
            element, _, inline, _ = frames[-1]
            if text and not self.skip[element] and not (inline and inline[-1][1]):
                text = html.unescape(text) if "&" in text else text
                words.append(text)
                if inline and inline[-1][2]:
                    linked += len(text.strip())

        def close(until: int):
            """Ends all open block-level elements down to a place in frames."""
            flush()
            while len(frames) > until:
                _, tag, _, _ = frames.pop()
                blocks_open[tag] -= 1
                if tag == "p":
                    p_open[-1] -= 1
                if tag in _P_SCOPE:
                    p_open.pop()

        def find(tags, stop=()) -> int:
            """The place of the innermost open element of tags, or 0."""
            for k in range(len(frames) - 1, 0, -1):
                if frames[k][1] in tags:
                    return k
                if frames[k][1] in stop:
                    return 0
            return 0

        while at < len(source):
            m = source.find("<", at)
            if m < 0:
                say(source[at:])
                break
            say(source[at:m])
            found = _TOKEN.match(source, m) if m <= last or source.startswith("<!--", m) else None
            if not found:
                if m > last and re.match(r"</?[A-Za-z!?]|<!", source[m : m + 3]):
                    break  # a tag that the end of the page cuts off
                say("<")
                at = m + 1
                continue
            at = found.end()
            tag = found["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "br":
                say(" ")
                continue
            if found["end"]:
                if tag in INLINE:
                    _, _, inline, count = frames[-1]
                    while count.get(tag):
                        name = inline.pop()[0]
                        count[name] -= 1
                        if name == tag:
                            break
                elif tag == "p":
                    flush()
                    if p_open[-1]:
                        close(find(("p",)))
                elif blocks_open.get(tag):
                    close(find((tag,)))
                continue
            attrs = {}
            for a in _ATTR.finditer(found["attrs"] or ""):
                if a["bare"]:
                    attrs.setdefault(a["bare"].lower(), "")
                else:
                    attrs.setdefault(a["name"].lower(), html.unescape(a["d"] or a["s"] or a["u"] or ""))
            named = (attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""))
            away = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) is not None
            if tag in INLINE:
                _, _, inline, count = frames[-1]
                skipped = bool(inline and inline[-1][1]) or away or any(map(is_beside, named))
                if tag not in VOID:
                    inline.append((tag, skipped, tag == "a" or bool(inline and inline[-1][2])))
                    count[tag] = count.get(tag, 0) + 1
                continue
            if p_open[-1]:
                close(find(("p",)))
            elif tag in _ENDS and any(blocks_open.get(t) for t in _ENDS[tag][0]):
                k = find(*_ENDS[tag])
                if k:
                    close(k)
            flush()
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"(?i)</{tag}(?=[\s/>])").search(source, at)
                at = end.start() if end else len(source)
            element, parent = len(self.parent), frames[-1][0]
            inner = frames[-1][2]
            own = away or tag in NEVER and not (tag == "header" and self._in_article(frames))
            own = own or any(map(is_beside, named)) and not (tag in ("html", "body", "main", "article") and not re.search(r"(?i)comment|reply|ad\b|promo|related", " ".join(named)))
            self.parent.append(parent)
            self.tag.append(tag)
            self.step.append(label(tag, named[0]))
            self.skip.append(self.skip[parent] or own or bool(inner and inner[-1][1]))
            self.main.append(tag in ("article", "main") or named[2] in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower())
            linked_here = [("a", bool(inner[-1][1]), True)] if inner and inner[-1][2] else []
            frames.append((element, tag, linked_here, {}))
            blocks_open[tag] = blocks_open.get(tag, 0) + 1
            if tag == "p":
                p_open[-1] += 1
            if tag in _P_SCOPE:
                p_open.append(0)
        flush()

    @staticmethod
    def _in_article(frames: list) -> bool:
        """The header of an article holds its title."""
        return any(f[1] == "article" for f in frames[-4:])

    def _menus(self) -> None:
        """Lists of three links or more and hardly anything else are menus."""
        lists: dict[int, list[int]] = {}
        for at, text, linked in self.blocks:
            k, steps = at, 0
            while k > 0 and self.tag[k] not in ("ul", "ol") and steps < 8:
                k, steps = self.parent[k], steps + 1
            if k > 0 and self.tag[k] in ("ul", "ol"):
                found = lists.setdefault(k, [0, 0, 0])
                found[0], found[1], found[2] = found[0] + (linked > 0), found[1] + linked, found[2] + len(text)
        for k, (n, linked, size) in lists.items():
            if n >= 3 and linked >= LINKED * size:
                self.skip[k] = True
        if lists:
            for k in range(1, len(self.parent)):
                self.skip[k] = self.skip[k] or self.skip[self.parent[k]]

    def container(self) -> int:
        """The element that holds the article, by this page alone."""
        whole = self.score[0]
        articles = [k for k in range(1, len(self.parent)) if self.main[k] and self.tag[k] != "main" and not self.skip[k] and self.score[k] >= ARTICLE * whole]
        if articles and whole:
            most = max(self.score[k] for k in articles)
            return max((k for k in articles if self.score[k] >= MOST * most), key=lambda k: (self.tag[k] == "article", self.score[k], -k))
        mains = [k for k in range(1, len(self.parent)) if self.main[k] and not self.skip[k] and self.score[k] >= ARTICLE * whole and whole]
        at = max(mains, key=lambda k: (self.score[k], -k)) if mains else 0
        while True:
            below = [k for k in self.children[at] if self.score[k] >= MOST * self.score[at] > 0 and self.tag[k] not in ("p", "li", "td", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6")]
            if not below:
                return at
            at = below[0]

    def led_to(self, paths: list[str]) -> int:
        """Of the elements with text that the paths lead to the one of the deepest path, or -1."""
        wanted = {p: (p.count(">"), -i) for i, p in enumerate(paths)}
        found = [k for k in range(len(self.parent)) if self.score[k] and not self.skip[k] and self.path[k] in wanted]
        return max(found, key=lambda k: (wanted[self.path[k]], self.score[k], -k)) if found else -1

    def text(self, element: int) -> str:
        """The blocks below an element."""
        inside = [False] * len(self.parent)
        inside[element] = True
        for k in range(element + 1, len(self.parent)):
            inside[k] = inside[self.parent[k]]
        return "\n\n".join(text for at, text, _ in self.blocks if inside[at] and not self.skip[at])


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def votes(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """For each host the paths that its pages propose: host, path, n_pages, score (readable characters)."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host is not null and html is not null")

    def run(batches):
        for batch in batches:
            for b in batch_pieces(batch, "html"):
                out = []
                for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                    page = Page(source)
                    at = page.container()
                    if page.score[at]:
                        out.append((host, page.path[at], page.score[at]))
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "path", "score"])

    return rows.mapInArrow(run, "host string, path string, score bigint").groupBy("host", "path").agg(F.count("*").alias("n_pages"), F.sum("score").alias("score"))


def winners(found: DataFrame) -> DataFrame:
    """Each host's winning paths, the most voted first: host, paths."""
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n_pages"), F.desc("score"), "path"))
    best = found.withColumn("place", place).where(F.col("place") <= PATHS)
    rows = best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "n_pages", "path"))).alias("rows"))  # PATHS rows a host
    return rows.select("host", F.expr(f"transform(filter(rows, r -> r.n_pages * {FEW} >= rows[0].n_pages), r -> r.path)").alias("paths"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with ``text`` (the main text), ``n_chars`` (its code points) and ``path`` (where it was found)."""
    won = materialise(winners(votes(pages, html_col, url_col)))
    size = won.agg(F.coalesce(F.sum(F.octet_length("host") + 64 + F.aggregate("paths", F.lit(0), lambda n, p: n + F.octet_length(p) + 32)), F.lit(0))).first()[0]
    won = won.withColumnsRenamed({"host": "__host", "paths": "__paths"})
    rows = pages.withColumn("__host", host_of(F.col(url_col))).join(F.broadcast(won) if size <= broadcast_bytes else won, "__host", "left").drop("__host")
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("path", T.StringType())]
    schema = beside(pages.schema, *added)
    names = schema.names[:-3]

    def run(batches):
        for batch in batches:
            for b in batch_pieces(batch, html_col):
                out = []
                for source, paths in zip(b.column(html_col).to_pylist(), b.column("__paths").to_pylist(), strict=True):
                    page = Page(source or "")
                    at = page.led_to(paths or [])
                    at = page.container() if at < 0 else at
                    out.append((page.text(at), page.path[at]))
                text = pa.array([t for t, _ in out], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), text, pc.utf8_length(text).cast(pa.int64()), pa.array([p for _, p in out], pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def op13_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
