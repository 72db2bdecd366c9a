"""Main text of web pages, with a style tree of each site.

Pages are parsed in one pass into nodes (elements that make blocks, each known
by the chain of tags, class and id names without digits above it) and blocks of
text.  The nodes of all pages of a host, merged by their chains, are the style
tree.  The importance of a node is the weighted mean of

* presentation: the entropy of the ways in which pages show its children, and
* content: how much the texts below it differ from page to page, summed over
  all its descendants (a text that all pages share counts 0, one that a single
  page has counts 1).

A branch is as important as its most important node, so importance is carried
from children to branches; branches under a threshold are notices, menus and
slogans of the site and are removed with all below them, inside marked articles
only if they show the same on practically all pages and have a class or id of
their own: headings and plain elements of an article always stay.  Copies of a
page count once.  Entropy cannot tell a menu or an advert that changes from page
to page from an article, so what HTML itself names (navigation, forms, footers,
...) and whole class, id or role names that mean nothing else go by that prior;
names that an article may use too (related, search, alert, ...), and any such
name of a paragraph, figure, quotation or table of an article, only raise the
threshold.  Areas are judged afterwards, by the text that is left: the marked
article of a page, else its main part, if it is at least ``least_share`` of that
text, else all of it.

Trees are built by grouped counts keyed by host, node and content, so a host
with a third of all pages is spread over tasks.  Branches removed are a short
list for each host (a site has few templates) and are joined to salted pages.

Levels below the DEPTH-th count as part of that level in the tree; no text is
lost by that.  Parsing takes time and memory in proportion to a page.

Definitions for odd input: a null or empty page, and a page without text, gives
the empty string; a null url, or one without host, belongs to the host '';
broken markup is closed as browsers do in simple cases, a "<" without any ">"
behind it is text; texts of any length are taken whole; repeated rows each get
their text; an empty table gives an empty result; other columns pass through
unless they clash with the names of the results, which win.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _words as W
from ._chunks import slices
from ._columns import DOC, bundle, col, unbundle
from ._ship import ship
from ._store import materialise

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Levels of the style tree; host rows are spread by so many salts.
DEPTH, SALTS = 32, 16
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "plaintext"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold the article.
NOISE_TAGS = set("script style noscript template head title nav footer aside form button select option optgroup textarea input iframe object embed applet svg math canvas audio video map menu dialog noembed noframes search datalist".split())
#: Names of a page's own head; inside an article they mark its title.
HEAD_NAMES = {"header", "masthead"}
#: Class, id and role names that say the same as noise elements, whatever else the name holds.
NOISE_NAMES = set(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted cookie cookies consent gdpr newsletter subscribe subscription popup modal lightbox sidebar sidenav nav navbar navigation topnav menu menus breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus replies respond toolbar widget widgets pagination pager paging login signin signup complementary contentinfo paywall outbrain taboola".split()
)
#: Names that articles use too: noise only where the site tree agrees more or less, or with one of FURNITURE beside them and nothing else.
WEAK_NAMES = set("related recommended recommendations promotion banner alert notice notices share sharing social search skip overlay dialog reply responses reactions discussion rail hidden".split())
#: What such a name may be put together with; any other part makes it a name of its own (ad-hoc, comment-on-law).
QUALIFIERS = set(
    "site page main top left right bottom global primary secondary local mobile desktop inner outer upper lower content area areas group item items header footer head foot post entry article blog news story reader readers user users google first second third small large wide sticky fixed floating inline slot unit zone holder body title text view count link wp td id js".split()
)
#: Elements of an article that are not noise for their names.
CONTENT = set("p h1 h2 h3 h4 h5 h6 hgroup figure figcaption blockquote pre table caption thead tbody tfoot tr td th".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "caption", "figcaption", "dt", "th"}
FURNITURE = set("bar bars block box button buttons container field form icon icons input link links list panel posts row section tab tabs wrapper".split())
_STRONG_PARTS = NOISE_NAMES | WEAK_NAMES | FURNITURE | QUALIFIERS
CLOSES_P = BLOCKS - {"head", "html", "body", "option", "optgroup", "li", "dd", "dt", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "select"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"table", "td", "th", "caption", "html", "button", "object"}




def _scan(source: str, place: list[int]) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start and end, name, whether it closes, and attributes of each tag from ``place`` on; comments and declarations have no name.

    The caller may move ``place`` on.  Takes time in proportion to the source.
    """
    size = len(source)
    failed: set[int] = set()  # quotes from which no tag is closed
    while True:
        at = source.find("<", place[0])
        if at < 0:
            return
        mark = source[at + 1 : at + 2]
        if mark in ("!", "?"):
            if source.startswith("<!--", at):
                ends = [x for x in (source.find("-->", at + 4), source.find("--!>", at + 4)) if x >= 0]
                stop = source.index(">", min(ends)) + 1 if ends else size
            else:
                stop = source.find(">", at) + 1 or size
            place[0] = stop
            yield at, stop, "", False, ""
            continue
        name = _TAG.match(source, at + 1)
        if not name:
            place[0] = at + 1
            continue
        first = source.find(">", name.end())
        if first < 0:  # no tag ends behind this place
            return
        k, seen, stop = name.end(), [], -1
        while stop < 0:
            hit = _STOP.search(source, k)
            if hit is None or hit.start() in failed:
                break
            if hit[0] == ">":
                stop = hit.start()
            else:
                seen.append(hit.start())
                k = source.find(hit[0], hit.end()) + 1
                if not k:
                    break
        if stop < 0:
            failed.update(seen)
            stop = first
        place[0] = stop + 1
        yield at, stop + 1, name[2].lower(), bool(name[1]), source[name.end() : stop]


class Page:
    """``nodes``: id, parent's place, area, whether a weak name; ``shows``: the labels of each node's children; ``blocks``: node's place and text.

    Area 2: in an article, 3: its headings and plain elements, 1: in the main part, 0: elsewhere.
    """

    def __init__(self, source: str):
        self.nodes: list[tuple[int, int, int, bool]] = [(0, -1, 0, False)]
        self.shows: list[set[str]] = [set()]
        self.place: dict[tuple[int, int, bool], int] = {(0, 0, False): 0}
        self.blocks: list[tuple[int, str]] = []
        #: tag, place of its node, is noise, area, is weak
        self.stack: list[tuple[str, int, bool, int, bool]] = []
        self.open_at: dict[str, list[int]] = {}
        self.text: list[str] = []
        self.noise = 0
        at, place = 0, [0]
        for start, stop, tag, closes, attributes in _scan(source, place):
            if start > at:
                self.take(source[at:start])
            at = stop
            if not tag:
                continue
            if closes:
                self.close(tag)
                continue
            self.open(tag, attributes)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                place[0] = end.start() if end else len(source)
                if tag not in NOISE_TAGS:
                    self.take(source[at : place[0]])
                at = place[0]
        self.take(source[at:])
        self.flush()

    def take(self, raw: str) -> None:
        if raw and not self.noise:
            self.text.append(html.unescape(raw) if "&" in raw else raw)

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.stack[-1][1] if self.stack else 0, text))
            self.text = []

    def push(self, tag: str, node: int, noisy: bool, area: int, weak: bool) -> None:
        self.open_at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node, noisy, area, weak))
        self.noise += noisy

    def pop_to(self, k: int) -> None:
        self.flush()
        while len(self.stack) > k:
            tag, _, noisy, _, _ = self.stack.pop()
            self.open_at[tag].pop()
            self.noise -= noisy

    def last(self, tags: set[str]) -> int:
        """The place in the stack of the innermost of some elements, -1 if none is open."""
        return max((self.open_at[t][-1] for t in tags if self.open_at.get(t)), default=-1)

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.take(" ")
            return
        _, above, _, area, weak = self.stack[-1] if self.stack else ("", 0, False, 0, False)
        noisy, named, label = tag in NOISE_TAGS, False, tag
        if attributes.strip(" /"):
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role") and tag not in ("html", "body"):
                    tokens = [[w.lower() for part in _NAME.findall(v) for w in _CAMEL.split(part)] for v in value.split()]
                    words = [w for token in tokens for w in token]
                    named |= bool(words)
                    noise = NOISE_NAMES - HEAD_NAMES if area == 2 else NOISE_NAMES
                    strong = any(not noise.isdisjoint(t) and _STRONG_PARTS.issuperset(t) for t in tokens)
                    strong |= any(len(set(t)) > 1 and not WEAK_NAMES.isdisjoint(t) and (WEAK_NAMES | FURNITURE).issuperset(t) for t in tokens)
                    if strong and area == 2 and tag in CONTENT:
                        strong, weak = False, True
                    noisy |= strong
                    weak |= not WEAK_NAMES.isdisjoint(words)
                    label += f".{'-'.join(words)}"
                    if name == "role" and "main" in words:
                        area = max(area, 1)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                    noisy = True
        if tag == "header" and area < 2:
            noisy = True
        if tag in VOID:
            if tag in BLOCKS:
                self.flush()
            return
        if tag not in BLOCKS and not noisy:
            self.shows[above].add(label)
            return
        if tag in CLOSES_P and (k := self.last({"p"})) > self.last(SCOPE):
            self.pop_to(k)
        if tag in SIBLINGS:
            same, stops = SIBLINGS[tag]
            stop = self.last(stops)
            cut = min((at[i] for t in same if (at := self.open_at.get(t)) and (i := bisect_right(at, stop)) < len(at)), default=-1)
            if cut >= 0:
                self.pop_to(cut)
        if tag in BLOCKS:
            self.flush()
        above = self.stack[-1][1] if self.stack else 0
        area = 2 if tag == "article" else max(area, 1) if tag == "main" else area
        plain = area == 2 and (tag in HEADINGS or not named)
        self.push(tag, self.node(above, label, 3 if plain else area, weak), noisy, area, weak)

    def node(self, above: int, label: str, area: int, weak: bool) -> int:
        self.shows[above].add(label)
        chain = self.nodes[above][0]
        if len(self.stack) >= DEPTH:
            if self.nodes[above][2:] == (area, weak):
                return above
        else:
            chain = int.from_bytes(hashlib.blake2b(f"{chain} {label}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        key = (chain, area, weak)
        at = self.place.get(key)
        if at is None:
            at = self.place[key] = len(self.nodes)
            self.nodes.append((chain, above, area, weak))
            self.shows.append(set())
        return at

    def close(self, tag: str) -> None:
        at = self.open_at.get(tag)
        if at:
            if tag in BLOCKS or at[-1] < len(self.stack) - 1:
                self.pop_to(at[-1])
            else:  # an inline element that is noise
                self.noise -= self.stack.pop()[2]
                at.pop()
        elif tag == "p":
            self.flush()


def extract_text(pages: DataFrame, page: str = "html", url: str = "url", threshold: float = 0.2, marked: float = 0.02, doubted: float = 0.7, weight: float = 0.9, min_pages: int = 4, least_share: float = 0.4) -> DataFrame:
    """Adds ``text`` and ``n_chars``; the source of the page is left out.

    ``threshold``: branches of less importance are removed; ``marked``: the
    same in article elements; ``doubted``: the same for weak names.
    ``weight``: the share of content in importance, beside presentation.
    ``min_pages``: nodes on fewer pages of a host are not judged.
    ``least_share``: of the text that is left, for an area to stand alone.
    """
    kept = [c for c in pages.columns if c not in {"text", "n_chars", page}]
    host = F.lower(F.coalesce(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    ship(pages.sparkSession)
    given = pages.select(bundle(kept), host.alias("__host"), col(page).alias("__page"))
    node = T.StructType([T.StructField("id", T.LongType()), T.StructField("up", T.IntegerType()), T.StructField("area", T.IntegerType()), T.StructField("weak", T.BooleanType()), T.StructField("style", T.LongType())])
    block = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("text", T.StringType())])
    schema = T.StructType([given.schema[DOC], given.schema["__host"], T.StructField("nodes", T.ArrayType(node)), T.StructField("blocks", T.ArrayType(block))])
    arrow = to_arrow_schema(schema)

    def short(x: set[str]) -> int:
        return int.from_bytes(hashlib.blake2b(" ".join(sorted(x)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for t in slices(batches, "__page", 4 << 20):
            nodes, blocks = [], []
            for x in t.column("__page").to_pylist():
                got = Page(x or "")
                nodes.append([{"id": i, "up": up, "area": a, "weak": w, "style": short(shown)} for (i, up, a, w), shown in zip(got.nodes, got.shows)])
                blocks.append([{"node": n, "text": x.encode("utf-8", "replace").decode()} for n, x in got.blocks])
            yield from pa.table([*(t.column(f.name).cast(f.type) for f in list(arrow)[:-2]), pa.array(nodes, arrow.field("nodes").type), pa.array(blocks, arrow.field("blocks").type)], schema=arrow).to_batches()
        W.trim()

    parsed, _ = materialise(given.mapInArrow(parse, schema).withColumn("page", F.xxhash64("nodes", "blocks")), "pages-parsed")
    by = ["__host", "id"]
    # the tree: each node once for each different page
    seen = parsed.select("__host", "page", F.explode("nodes").alias("n"), F.col("nodes").alias("all")).select("__host", "page", "n.*", F.when(F.col("n.up") >= 0, F.get("all", F.col("n.up"))["id"]).alias("above"))
    once = seen.groupBy(*by, "page").agg(F.max("area").alias("area"), F.max("weak").alias("weak"), F.min("style").alias("style"), F.min("above").alias("above"))
    shown = once.groupBy(*by, "style").agg(F.count("*").alias("c"), F.max("area").alias("area"), F.max("weak").alias("weak"), F.min("above").alias("above"))
    tree = shown.groupBy(*by).agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("c_log"), F.max("area").alias("area"), F.max("weak").alias("weak"), F.min("above").alias("above"))
    tree, _ = materialise(tree, "site-trees")
    text = parsed.select("__host", "page", F.explode("blocks").alias("b"), "nodes").select("__host", "page", F.get("nodes", F.col("b.node"))["id"].alias("id"), F.xxhash64("b.text").alias("content"))
    content = text.distinct().groupBy(*by, "content").agg(F.count("*").alias("c")).groupBy(*by).agg(F.count("*").alias("texts"), F.sum(F.log("c")).alias("t_log"))
    # each node's ancestors, by doubling: itself, then up
    own, _ = materialise(tree.join(content, by, "left").fillna(0, ["texts", "t_log"]), "site-nodes")
    up = own.where("above <> id").select("__host", "id", F.col("above").alias("top"), F.lit(1).alias("far"))
    lines = own.select("__host", "id", F.col("id").alias("top"), F.lit(0).alias("far")).unionByName(up)
    for far in (1, 2, 4, 8, 16):
        jump = lines.where(F.col("far") == far).select("__host", F.col("id").alias("top"), F.col("top").alias("next"))
        more = lines.where("far > 0").join(jump, ["__host", "top"]).select("__host", "id", F.col("next").alias("top"), (F.col("far") + far).alias("far"))
        more, _ = materialise(more, "site-lines")
        if more.isEmpty():
            break
        lines = lines.unionByName(more)
    below = lines.join(own.select(*by, "texts", "t_log"), by).groupBy("__host", F.col("top").alias("id")).agg(F.sum("texts").alias("texts"), F.sum("t_log").alias("t_log"))
    measure = F.log(F.greatest("pages", F.lit(2)))
    differs = F.when(F.col("texts") > 0, 1 - F.col("t_log") / F.col("texts") / measure).otherwise(F.lit(0.0))
    varies = (F.log("pages") - F.col("c_log") / F.col("pages")) / measure
    scored = own.drop("texts", "t_log").join(below, by).withColumn("importance", F.when(F.col("pages") >= min_pages, weight * differs + (1 - weight) * varies).otherwise(F.lit(1.0)))
    branch = lines.join(scored.select(*by, "importance"), by).groupBy("__host", F.col("top").alias("id")).agg(F.max("importance").alias("branch"))
    limit = F.when(F.col("area") == 3, F.lit(0.0)).when(F.col("weak"), F.lit(doubted)).when(F.col("area") == 2, F.lit(marked)).otherwise(F.lit(threshold))
    low = scored.join(branch, by).where(F.col("branch") < limit).groupBy("__host").agg(F.collect_set("id").alias("low"))
    low, _ = materialise(low.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "site-noise")
    salted = parsed.withColumn("__salt", F.pmod("page", F.lit(SALTS)).cast("int"))
    joined = salted.join(low, ["__host", "__salt"], "left").select(DOC, "nodes", "blocks", "low")
    final = T.StructType([given.schema[DOC], T.StructField("text", T.StringType())])
    final_arrow = to_arrow_schema(final)

    def choose(nodes: list[dict], blocks: list[dict], low: list[int] | None) -> str:
        noise, gone = set(low or ()), []
        for n in nodes:  # parents come before their children
            gone.append(n["id"] in noise or n["up"] >= 0 and gone[n["up"]])
        left = [(min(2, nodes[b["node"]]["area"]), b["text"]) for b in blocks if not gone[b["node"]]]
        every = sum(len(x) for _, x in left)
        for area in (2, 1):
            own = [x for a, x in left if a == area]
            if own and sum(map(len, own)) >= least_share * every:
                return " ".join(own)
        return " ".join(x for _, x in left)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.lean()
        for t in batches:
            texts = [choose(*x) for x in zip(t.column("nodes").to_pylist(), t.column("blocks").to_pylist(), t.column("low").to_pylist())]
            yield from pa.table([t.column(DOC).cast(final_arrow.field(0).type), pa.array(texts, pa.string())], schema=final_arrow).to_batches()
            W.trim()

    out = joined.mapInArrow(finish, final).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*unbundle(kept), "text", "n_chars")
