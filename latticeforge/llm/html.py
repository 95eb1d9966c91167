"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its elements, named by their path, and its blocks of text. Tokens of a host with the same
occurrence vector (how often in which page) form an equivalence class. A class that occurs in most pages is valid if
its tokens come in the same order in all of them; the largest valid class is the host's root, and other valid
classes are nested in it if all their tokens always lie between the same two of its tokens. Root and nested classes are
the template. Its blocks of text are the same on the host's pages and go; its elements that come once in a page bound
the slots, and a slot holds the blocks from one of them to the next. Slots are told apart by what they hold over all pages
of the host: one whose content does not vary, or is mostly links, or lies in elements that are no article, is none of the
article's; of the others those inside article elements are, if there are any. Blocks of the article's slots stay. Names of
elements break ties inside them, and tell the blocks of hosts with too few pages for a template.

Occurrence vectors are compared by an exclusive or of hashes of (page, count), which partial aggregation combines: no task holds a
host. What is known of a host, which is no longer than a few of its pages, is broadcast if its counted size is small; beyond that it
joins pages on host and a salt, so a host with a third of all pages is spread out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, table, tables

#: Least pages of a host to deduce a template from, least share of them that a class occurs in, least tokens of a class.
PAGES, SHARE, TOKENS, SALTS = 4, 0.6, 2, 64
#: Template tokens of all hosts that may be broadcast, 16 bytes each; more join on host and salt.
FEW = 200_000
#: A slot does not vary if its pages hold no more than this share of different contents.
SAME = 0.2
#: What a template says of its tokens: text that goes, and elements that begin another slot or one of the article.
TEXT, OTHER, ARTICLE = 0, 1, 2

# Element names and words of the HTML standard and of common page designs.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes math object audio video canvas select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form button dialog menu search label fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status tooltip".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices notification notifications alert alerts "
    "popup modal newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies respond disqus discussion related recommended recommendations recommend teaser teasers "
    "pagination pager paging search form copyright legal disclaimer skip skiplink breadcrumb breadcrumbs".split()
)
#: Names of parts of a page that wrappers of the whole page may bear too, as in "sidebar-left".
LAYOUT = frozenset("nav navbar navigation menu submenu masthead footer sidebar aside widget widgets banner overlay toolbar topbar bottombar offcanvas".split())
#: Words that do not change what others of a name say, as "box" in "ad-box"; pieces of one or two letters are such, too.
NEUTRAL = frozenset(
    "box boxes list lists item items wrap wrapper container area section block blocks posts post articles links link bar inner outer left right top bottom main content text header title heading module panel group row col column columns "
    "button buttons icon icons page site global primary secondary small large mobile desktop slot unit message messages view holder body".split()
)
#: Advertising, which no paragraph or inline element of an article is either.
ADS = frozenset("ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos".split())
CONTENT = frozenset("article content post entry story".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("ul ol dl table html body article section div main td th".split())

TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>"']+|"[^"]*"|'[^']*')*+)>)""", re.S)
OPEN = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Numbers of posts and the like.
DIGITS = re.compile(r"\d{3,}")


class _Element:
    """away: surely no article text; layout: its names say so, but it may hold the article; holds: it is a container."""

    __slots__ = ("away", "holds", "layout", "name", "path")

    def __init__(self, name: str, path: str, away: bool, layout: bool, holds: bool) -> None:
        self.name, self.path, self.away, self.layout, self.holds = name, path, away, layout, holds


class Block:
    """A block of text: its length and that of its links, and what is around it."""

    __slots__ = ("article", "away", "layout", "links", "main", "text")

    def __init__(self, text: str, links: int, away: bool, layout: bool, article: bool, main: bool) -> None:
        self.text, self.links, self.away, self.layout, self.article, self.main = text, links, away, layout, article, main

    def flags(self) -> int:
        return 1 | self.away << 1 | self.layout << 2 | self.article << 3 | self.main << 4


def _judge(name: str, rest: str, inside: bool) -> tuple[str, bool, bool, bool]:
    """Class and id of an element; whether it is away, layout, and a container of an article.

    A class or id speaks for an element only if all of its words do: "related-posts" does, "related-work" does not.
    """
    away, layout, label, words, named = name in DROPPED or (name == "header" and not inside), False, "", set(), []
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            label += " " + DIGITS.sub("0", value)
            for one in value.split():
                named.append({p.lower() for p in PIECE.findall(one) if len(p) > 2 or p.lower() in ADS})
                words |= named[-1]
        elif key == "role":
            away |= value.strip().lower() in ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            away = True
    if name in PARAGRAPHS or name not in BLOCK:
        away |= any(w & ADS and w <= ADS | NEUTRAL for w in named)
    elif name not in ("html", "body", "main"):
        away |= any(w & NAMES and w <= NAMES | LAYOUT | NEUTRAL for w in named)
        layout = name != "article" and (any(w & LAYOUT and w <= LAYOUT | NAMES | NEUTRAL for w in named) or ("header" in words and name == "div" and not inside))
    holds = not away and (name in ("article", "main") or (name in ("div", "section") and not layout and bool(words & CONTENT)))
    return label, away, layout, holds


class _Page:
    """The elements that are open, and the tokens found so far; every step takes a time that does not depend on the depth."""

    def __init__(self) -> None:
        self.tokens: list[tuple[str, Block | None]] = []
        self.stack: list[_Element] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.layouts: list[_Element] = []
        self.away = self.inside = self.articles = self.mains = self.in_links = 0
        self.parts: list[str] = []
        self.skipped: list[str] = []
        self.links = 0

    def add(self, text: str) -> None:
        if self.away:
            self.skipped.append(text)
        else:
            self.parts.append(text)
        if self.in_links:
            self.links += len(text)

    def path(self) -> str:
        return self.stack[-1].path if self.stack else ""

    def flush(self) -> None:
        layout = any(e.layout for e in self.layouts[-1:])
        for parts, away in ((self.parts, False), (self.skipped, True)):
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                self.tokens.append((f"T{self.path()}\n{text}", Block(text, min(self.links, len(text)), away, layout, self.articles > 0, self.mains > 0)))
        self.links = 0

    def push(self, e: _Element) -> None:
        if e.holds:  # what holds the article is no menu, whatever its names
            for other in self.layouts:
                other.layout = False
            self.layouts.clear()
        self.where.setdefault(e.name, []).append(len(self.stack))
        if e.name in BLOCK:
            self.blocks.append(len(self.stack))
        if e.layout:
            self.layouts.append(e)
        self.stack.append(e)
        self._count(e, 1)

    def _count(self, e: _Element, n: int) -> None:
        self.away += n * e.away
        self.inside += n * e.holds
        self.articles += n * (e.holds and e.name == "article")
        self.mains += n * (e.holds and e.name == "main")
        self.in_links += n * (e.name == "a")

    def pop(self, at: int) -> None:
        while len(self.stack) > at:
            e = self.stack.pop()
            self.where[e.name].pop()
            if e.name in BLOCK:
                self.blocks.pop()
                self.tokens.append((f"/{e.path}", None))
            if self.layouts and self.layouts[-1] is e:
                self.layouts.pop()
            self._count(e, -1)

    def last(self, names: frozenset[str] | set[str]) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=-1)

    def close(self, names: set[str], walls: frozenset[str]) -> None:
        at = self.last(names)
        if at >= 0 and at > self.last(walls - names):
            self.flush()
            self.pop(at)

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        elif name in VOID:
            self.add(" ")
        at = self.last({name})
        if at >= 0 and (name in BLOCK or not self.blocks or self.blocks[-1] < at):
            self.pop(at)

    def start(self, name: str, rest: str) -> None:
        if name in BLOCK:
            self.flush()
            self.close({"p"}, WALLS)
            if name in CLOSES:
                self.close(CLOSES[name], frozenset({"ul", "ol", "dl", "table", "select"}) if name not in ("td", "th") else frozenset({"table", "tr"}))
        elif name in VOID:
            self.add(" ")
        label, away, layout, holds = _judge(name, rest, self.inside > 0)
        path = f"{self.path()}>{name}{label}"
        if len(path) > 400:
            path = xxhash.xxh3_64_hexdigest(path)
        if name in BLOCK:
            self.tokens.append((f"E{path}", None))
        if name not in VOID:
            self.push(_Element(name, path, away, layout, holds))


def parse(html: str | None) -> list[tuple[str, Block | None]]:
    """Tokens in page order: a name, and the block of text if it is one."""
    html, page = html or "", _Page()
    at, size = 0, len(html)
    while at < size:
        low = html.find("<", at)
        if low < 0:
            page.add(html[at:])
            break
        if low > at:
            page.add(html[at:low])
        m = TAG.match(html, low) or OPEN.match(html, low)
        if m is None:
            page.add("<")
            at = low + 1
            continue
        at = m.end()
        if m.re is TAG:
            name, ends, rest = (m["name"] or "").lower(), bool(m["end"]), m["rest"] or ""
        else:  # a quote that is never closed
            found = re.match(r"<(/?)([a-zA-Z][^\s/>]*)", m[0])
            name, ends, rest = found[2].lower(), bool(found[1]), ""
        if not name:
            continue
        if ends:
            page.end(name)
        elif name in RAW:
            if not rest.endswith("/") or name in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                stop = html.find(">", end.start()) if end else -1
                at = stop + 1 if end and stop >= 0 else size
            page.add(" ")
        else:
            page.start(name, rest)
    page.flush()
    return page.tokens


def token_hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(html: str | None, template: dict[int, int] | None = None) -> str:
    """The article's blocks, one a line; ``template`` says of hashes of tokens what they are: TEXT, OTHER or ARTICLE."""
    template = template or {}
    left: list[Block] = []
    chosen: list[Block] = []
    slot = None
    for token, block in parse(html):
        known = template.get(token_hash(token)) if template else None
        if block is None:
            slot = slot if known is None else known
        elif known != TEXT and not block.away:
            if slot == ARTICLE:
                chosen.append(block)
            if not block.layout:
                left.append(block)
    kept = chosen or left
    for container in ("article", "main"):
        own = [b for b in kept if getattr(b, container)]
        if own:
            kept = own
            break
    return "\n".join(b.text for b in kept)


_TOKENS = "h long, page long, t array<long>, f array<int>, c array<int>, l array<int>, u array<long>, k array<int>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: the host's key, the page's, hashes of its tokens, flags, lengths and lengths of links; different tokens and their counts."""
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()), pa.list_(pa.int32()))
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found = parse(html)
            hashes = [token_hash(t) for t, _ in found]
            times = Counter(hashes)
            per_token = ([b.flags() if b else 0 for _, b in found], [len(b.text) if b else 0 for _, b in found], [b.links if b else 0 for _, b in found])
            rows.append((host, token_hash(html or ""), hashes, *per_token, list(times), list(times.values())))
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_names(_TOKENS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _scan(out: str, each: Callable[[dict], Iterator[tuple]]):
    """A scan of pages that turns a row into the rows of integers that ``each`` gives."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for row in batch.to_pylist() for x in each(row)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(_names(out))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_names(out))

    return scan


def _orders(row: dict) -> Iterator[tuple]:
    """(h, class, order): the order in which the tokens of a class first come in a page."""
    of, orders = dict(zip(row["tokens"], row["classes"], strict=True)), {}
    for t in dict.fromkeys(row["t"]):
        if t in of:
            orders.setdefault(of[t], []).append(t)
    for c, order in orders.items():
        yield row["h"], c, token_hash(repr(order))


def _gaps(row: dict) -> Iterator[tuple]:
    """(h, class, low, high): the gaps of the root class in which tokens of a class first come in a page."""
    of, gap, low, high = dict(zip(row["tokens"], row["classes"], strict=True)), 0, {}, {}
    for t in dict.fromkeys(row["t"]):
        c = of.get(t)
        if c is not None:
            low.setdefault(c, gap)
            high[c] = gap
            gap += c == row["root"]
    for c in low:
        yield row["h"], c, low[c], high[c]


def _contents(row: dict) -> Iterator[tuple]:
    """(h, slot, content, chars, links, away, layout, article, main) of the slots of a page that hold text."""
    bounds, slot, found = set(row["tokens"]), None, {}
    for t, flags, chars, links in zip(row["t"], row["f"], row["c"], row["l"], strict=True):
        if not flags:
            slot = t if t in bounds else slot
        elif slot is not None and t not in bounds:
            hashes, sums = found.setdefault(slot, ([], [0] * 6))
            hashes.append(t)
            for i, part in enumerate((chars, links, *(chars if flags >> bit & 1 else 0 for bit in (1, 2, 3, 4)))):
                sums[i] += part
    for slot, (hashes, sums) in found.items():
        yield row["h"], slot, token_hash(repr(hashes)), *sums


def _with_hosts(rows: DataFrame, hosts: DataFrame, tokens: str, salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` with what is known of their hosts; ``tokens`` is the array whose length tells the size of that."""
    if (hosts.agg(F.sum(F.size(tokens))).first()[0] or 0) <= FEW:
        return rows.join(F.broadcast(hosts), "h", how)
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], how).drop("salt")


def templates(pages: DataFrame, least_pages: int = PAGES, share: float = SHARE, least_tokens: int = TOKENS) -> DataFrame:
    """(h, token, kind): the template of each host. ``pages`` has columns h, the host's key, and html."""
    with tables(pages.sparkSession) as keep:
        rows = keep(pages.select("h", "html").mapInArrow(_tokens, _TOKENS).dropDuplicates(["h", "page"]))
        sizes = rows.groupBy("h").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
        # Occurrence vectors: equal numbers of pages and equal combined hashes stand for equal vectors.
        each = rows.select("h", "page", F.explode(F.arrays_zip("u", "k")).alias("x")).select("h", "page", F.col("x.u").alias("token"), F.col("x.k").alias("times"))
        vectors = each.groupBy("h", "token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("page", "times")).alias("v"), F.max("times").alias("times"))
        vectors = vectors.join(sizes, "h").where(F.col("n") >= F.greatest(F.lit(least_pages), F.ceil(F.col("pages") * share)))
        vectors = keep(vectors.select("h", "token", "n", "times", F.xxhash64("n", "v").alias("class")))
        classes = vectors.groupBy("h", "class").agg(F.count("*").alias("size"), F.max("n").alias("in_pages")).where(F.col("size") >= least_tokens)
        members = keep(vectors.join(classes, ["h", "class"]).select("h", "token", "times", "class", "size", "in_pages"))
        grouped = lambda x, *more: x.groupBy("h", *more).agg(F.collect_list(F.struct("token", "class")).alias("x")).select("h", *more, F.col("x.token").alias("tokens"), F.col("x.class").alias("classes"))
        salt = F.col("page")
        # Valid: the tokens come in the same order in every page.
        orders = _with_hosts(rows.select("h", "page", "t"), grouped(members), "tokens", salt).mapInArrow(_scan("h, class, order", _orders), "h long, class long, order long")
        valid = orders.groupBy("h", "class").agg(F.min("order").alias("low"), F.max("order").alias("high")).where("low = high").select("h", "class")
        valid = keep(members.join(valid, ["h", "class"]))
        # Root: the valid class of the most pages, then tokens. Nested: all tokens in one gap of the root, in every page.
        root = valid.groupBy("h").agg(F.max_by("class", F.struct("in_pages", "size", "class")).alias("root"))
        gaps = _with_hosts(rows.select("h", "page", "t"), grouped(valid.join(root, "h"), "root"), "tokens", salt).mapInArrow(_scan("h, class, low, high", _gaps), "h long, class long, low long, high long")
        nested = gaps.groupBy("h", "class").agg(F.min("low").alias("low"), F.max("high").alias("high")).join(root, "h").where("class = root or low = high").select("h", "class")
        found = keep(valid.join(nested, ["h", "class"]).select("h", "token", "times"))
        texts = rows.select("h", F.explode(F.transform(F.filter(F.arrays_zip("t", "f"), lambda x: x["f"] > 0), lambda x: x["t"])).alias("token"))
        texts = texts.join(found.select("h", "token"), ["h", "token"], "left_semi").distinct().withColumn("is_text", F.lit(True))
        found = keep(found.join(texts, ["h", "token"], "left").select("h", "token", "times", F.coalesce("is_text", F.lit(False)).alias("is_text")))
        # Slots: what they hold over all pages.
        bounds = found.where("is_text or times = 1").groupBy("h").agg(F.collect_list("token").alias("tokens"))
        schema = "h long, slot long, content long, chars long, links long, away long, layout long, article long, main long"
        held = _with_hosts(rows.select("h", "page", "t", "f", "c", "l"), bounds, "tokens", salt).mapInArrow(_scan(schema, _contents), schema)
        sums = [F.sum(c).alias(c) for c in ("chars", "links", "away", "layout", "article", "main")]
        slots = held.groupBy("h", "slot", "content").agg(F.count("*").alias("n"), *sums).groupBy("h", "slot").agg(F.sum("n").alias("n"), F.count("*").alias("different"), *[F.sum(c).alias(c) for c in ("chars", "links", "away", "layout", "article", "main")])
        most = lambda c: 2 * F.col(c) > F.col("chars")
        same = (F.col("n") >= least_pages) & (F.col("different") <= SAME * F.col("n"))
        slots = keep(slots.select("h", "slot", (~(most("away") | most("links") | same)).alias("may"), *[most(c).alias(c) for c in ("layout", "article", "main")]))
        any_of = slots.where("may").groupBy("h").agg(F.max("article").alias("any_article"), F.max("main").alias("any_main"))
        is_article = F.when(F.col("any_article"), F.col("article")).when(F.col("any_main"), F.col("main")).otherwise(~F.col("layout"))
        chosen = slots.where("may").join(any_of, "h").where(is_article).select("h", F.col("slot").alias("token"), F.lit(ARTICLE).alias("kind"))
        kind = F.when(F.col("is_text"), TEXT).otherwise(F.coalesce("kind", F.lit(OTHER)))
        return cut(found.where("is_text or times = 1").join(chosen, ["h", "token"], "left").select("h", "token", kind.alias("kind")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = (dict(zip(t or (), k or (), strict=True)) for t, k in zip(batch.column("tokens").to_pylist(), batch.column("kinds").to_pylist(), strict=True))
        texts = [main_text(h, t) for h, t in zip(batch.column("html").to_pylist(), known, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row (page_id, url, text, n_chars) per row of ``pages``, which has page_id, url and html.

    Null and empty html give an empty text. Pages without a host, by a null or odd url, form one host of their own.
    Copies of a page count once when templates are deduced; repeated rows each give a row. Other columns are not
    read. Hosts of fewer than ``PAGES`` different pages have no template; their blocks are told by elements alone.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.xxhash64(host).alias("h"))
    found = templates(rows).groupBy("h").agg(F.collect_list(F.struct("token", "kind")).alias("x"))
    found = cut(found.select("h", F.col("x.token").alias("tokens"), F.col("x.kind").alias("kinds")))
    joined = _with_hosts(rows, found, "tokens", F.xxhash64("html", "page_id"), "left")
    return joined.select("page_id", "url", "html", "tokens", "kinds").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
