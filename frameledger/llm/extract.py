"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree of styles: a node is a path of tags and classes. Nodes with text have a content entropy
(how far their texts are spread over the pages), all nodes a presentation entropy (which child sequences, and for texts which lengths,
they have), and a text's node inherits the presentation of the branch that it stands in. From these comes a node's importance; what tags,
classes and roles say is a small part of it. Inner nodes are as important as the texts below them, and a branch of low importance goes whole.

Each page is parsed once: its texts and their paths are written, and both the tree and the result are made from that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, store, table
from .urlfilter import host_of

#: Tags that don't end a block (fixed values of HTML's phrasing elements).
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text whatever their class.
_NOISE_TAGS = frozenset("script style noscript template head title nav footer aside form button select option textarea fieldset iframe object embed svg canvas dialog menu menuitem map audio video".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class names and ids that name such elements.
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer comment comments disqus respond reply replies share sharing social related login signin signup search".split()
)
_MAIN_NAMES = frozenset("article content main post entry story".split())
#: A start tag of the key closes these open elements, unless one of the fences stands between.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCES = frozenset("ul ol dl table select body html article section div".split())

#: What a path's tags, classes and roles say: it holds no article, it is outside of the page's article, nothing, it is in an article.
NOISE, OUTSIDE, PLAIN, MAIN = range(4)
#: What names add to an importance that lies between 0 and 1: less than entropies can, in both directions. A page that names no
#: article has plain texts only, of which any may be one, so they need less to stay.
SHIFT = {NOISE: -0.05, OUTSIDE: -0.05, PLAIN: 0.2, MAIN: 0.05}
#: Importance under which a branch is low; what a node has as long as too few pages show it.
LOW_IMPORTANCE = 0.68
#: Share of the content's entropy in a node's importance; the rest is the presentation's.
CONTENT_SHARE = 0.5
#: Pages of a host at which its own tree counts as much as the tree of all hosts.
PRIOR_PAGES = 4.0
#: Pages that the lack of evidence counts as.
NEUTRAL_PAGES = 1.0
#: Branches above a text's own node that are judged with it. The page as a whole is none.
BRANCHES = 3
_ROOTS = frozenset(("", "html", "body"))


class _Node:
    __slots__ = ("tag", "path", "noise", "main", "above", "children")

    def __init__(self, tag: str, path: int, noise: bool, main: bool, above: _Node | None = None):
        self.tag, self.path, self.noise, self.main, self.above = tag, path, noise, main, above
        self.children: list[str] = []

    def branches(self) -> list[_Node]:
        """The nearest nodes above it that are blocks, but for the page's own."""
        found, node = [], self.above
        while node is not None and len(found) < BRANCHES:
            tag = node.tag.lstrip(".")
            if tag in _ROOTS:
                break
            if tag not in _INLINE:
                found.append(node)
            node = node.above
        return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _speaks(value: str | None) -> tuple[bool, bool]:
    """Whether a class or id names something that is no article, and whether it names one."""
    noise = main = False
    for name in (value or "").lower().split():
        parts = set(re.split(r"[^a-z0-9]+", name))
        own = not parts.isdisjoint(_MAIN_NAMES)
        noise |= not (parts - {"header"} if own else parts).isdisjoint(_NOISE_NAMES)  # the header of a post has its title
        main |= own
    return noise, main


class Page(HTMLParser):
    """The blocks of a page: (text, path, presentation). A path stands for its tags, its classes and what they say.

    Memory and time are linear in the page, however deep it nests: a path is a hash of its own tag and its parent's path.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, _Node, int]] = []
        self.stack = [_Node("", 0, False, False)]
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.has_main = False
        self.feed(html)
        self.close()
        self._end_block()

    @property
    def blocks(self) -> list[tuple[str, list[int], list[int], int]]:
        """(text, paths, presentations, lean): first of the text's own node, then of the branches above it.

        Where the page has an article, what stands outside of all is none of it. A text's presentation is its length, by powers of two, besides the children.
        """
        out = []
        for text, node, lean in self.found:
            if lean == PLAIN and self.has_main and not node.main:
                lean = OUTSIDE
            above = node.branches()
            own = f"{min(8, (text.count(' ') + 1).bit_length())} {','.join(node.children)}"
            paths = [xxhash.xxh3_64_intdigest(bytes([lean]), node.path), *[x.path for x in above]]
            shapes = [own, *[",".join(x.children) for x in above]]
            out.append((text, [_signed(p) for p in paths], [_signed(xxhash.xxh3_64_intdigest(x)) for x in shapes], lean))
        return out

    def _end_block(self) -> None:
        words = "".join(self.text).split()
        self.text.clear()
        if words:
            top = self.stack[-1]
            lean = NOISE if top.noise else MAIN if top.main and not top.tag.startswith(".") else PLAIN
            self.has_main |= lean == MAIN
            self.found.append((" ".join(words), top, lean))

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            if self.stack[-1].tag.lstrip(".") not in _INLINE:
                self._end_block()
            self.open[self.stack.pop().tag.lstrip(".")] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            if tag not in _INLINE:
                self._end_block()
            return
        if tag not in _INLINE:
            self._end_block()
            closes = _CLOSES.get(tag, ())
            if self.open.get("p") or any(self.open.get(t) for t in closes):
                for depth in range(len(self.stack) - 1, 0, -1):
                    open_ = self.stack[depth].tag.lstrip(".")
                    if open_ == "p" or open_ in closes:
                        self._close_to(depth)
                        if tag not in ("tr", "td", "th"):
                            break
                    elif open_ in _FENCES:
                        break
        top = self.stack[-1]
        noise, main, label, own = top.noise or tag in _NOISE_TAGS or (tag == "header" and not top.main), top.main, "", top.tag.startswith(".")
        strong = tag in ("article", "main")
        if attrs:
            given = dict(attrs)
            (bad, good), (bad_id, good_id) = _speaks(given.get("class")), _speaks(given.get("id"))
            role = (given.get("role") or "").lower()
            style = re.sub(r"\s", "", given.get("style") or "").lower()
            if bad or bad_id or role in _NOISE_ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style:
                noise = noise or (tag not in ("html", "body") and not strong)
            strong = strong or role in ("main", "article")
            label = "." + ".".join(sorted((given.get("class") or "").split()))
            if main and label != "." and tag not in _INLINE:
                own = True  # a branch of an article with a class of its own speaks for itself
            if not strong and tag not in _INLINE and tag not in ("html", "body") and (good or good_id) and not main:
                main, own = True, False
        if tag == "header" and main:
            own = True
        if strong:
            main, own = True, False
        top.children.append(tag + label)
        said = f"{tag}{label} {noise:d}{main:d}{own:d}"
        self.stack.append(_Node("." * own + tag, xxhash.xxh3_64_intdigest(said, top.path), noise, main, top))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag.lstrip(".") == tag:
                self._close_to(depth)
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)


PARSED = "digest long, template long, texts array<string>, paths array<long>, chains array<array<long>>, shapes array<array<long>>, leans array<int>"
PARSED_AT_ONCE_CHARS = 4 << 20


def parse_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, site, digest, template, texts, paths, chains, shapes, leans): the blocks of each page in order.

    ``site`` stands for the host, ``digest`` for the whole page and ``template`` for the set of its paths; a chain is a text's path with
    those of the branches above it.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            first, size, cols = 0, 0, [[] for _ in range(7)]

            def flush(end: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.list_(pa.list_(pa.int64()))] * 2, pa.list_(pa.int32())]
                made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                for c in cols:
                    c.clear()
                return pa.RecordBatch.from_arrays([*[batch.column(i).slice(first, end - first) for i in range(3)], *made], names=["id", "url", "site", "digest", "template", "texts", "paths", "chains", "shapes", "leans"])

            for i in range(batch.num_rows):
                html = batch.column(3)[i].as_py()
                blocks = Page(html).blocks
                paths = [b[1][0] for b in blocks]
                template = xxhash.xxh3_64_intdigest(",".join(map(str, sorted(set(paths)))))
                values = (_signed(xxhash.xxh3_64_intdigest(html)), _signed(template), [b[0] for b in blocks], paths, [b[1] for b in blocks], [b[2] for b in blocks], [b[3] for b in blocks])
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
                size += len(html)
                if size > PARSED_AT_ONCE_CHARS:
                    yield flush(i + 1)
                    first, size = i + 1, 0
            yield flush(batch.num_rows)

    types = dict(pages.dtypes)
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(F.coalesce(host_of(F.col(url_col)), F.lit(""))).alias("site"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return named.mapInArrow(run, f"id {types[id_col]}, url {types[url_col]}, site long, {PARSED}")


def _measured(features: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """(by..., m, shape, content): with m distinct pages on a node, how even its presentations are, and how little its texts are spread.

    A feature on c of m pages has the entropy log c / log m; content is 1 less its mean. Both are null on one page.
    """
    sums = features.groupBy(*by).agg(
        F.sum(F.when(F.col("kind") == 0, F.col("c"))).alias("shown"),
        F.sum(F.when(F.col("kind") == 0, F.col("c") * F.log("c"))).alias("logs"),
        F.sum(F.when(F.col("kind") == 1, F.log("c"))).alias("spread"),
        F.count_if(F.col("kind") == 1).alias("texts"),
    )
    several, log_m = F.col("m") > 1, F.log("m")
    shape = F.when(several, F.least(F.lit(1.0), (F.log("shown") - F.col("logs") / F.col("shown")) / log_m))
    content = F.when(several & (F.col("texts") > 0), F.lit(1.0) - F.col("spread") / (F.col("texts") * log_m))
    return sums.join(pages, by).select(*by, "m", shape.alias("shape"), content.alias("content"))


def importance(parsed: DataFrame) -> DataFrame:
    """(site, path, m, importance): the style tree's nodes, those that hold text and the branches above them.

    A text node's importance is its content's and its presentation's, the latter being the largest of its own and of its branches'. The tree of
    all hosts has the same measures; a host's own counts the more the more pages it has (``PRIOR_PAGES``), and with few pages in all
    both give way to ``LOW_IMPORTANCE``. A branch has the mean importance of the texts below it, by their characters, and a text the mean of its own
    and its nearest branch's; what names say of the texts is added to each (``SHIFT``). Equal pages count once, so copies of an article don't make it
    look like a menu.
    """
    spark = parsed.sparkSession
    each = parsed.select("site", "digest", F.explode(F.arrays_zip("chains", "shapes", "texts", "leans")).alias("b"))
    shown = each.select("site", "digest", F.explode(F.arrays_zip(F.col("b.chains").alias("path"), F.col("b.shapes").alias("feature"))).alias("n")).select("site", "digest", F.col("n.path").alias("path"), F.lit(0).alias("kind"), F.col("n.feature").alias("feature"))
    said = each.select("site", "digest", F.col("b.chains")[0].alias("path"), F.lit(1).alias("kind"), F.xxhash64("b.texts").alias("feature"))
    rows = shown.unionByName(said).distinct()
    counts = store(rows.groupBy("site", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c")), fresh_path(spark, "features"))
    # a page has as many presentations of a path as it has nodes there that differ, so pages are counted by themselves
    pages = store(shown.select("site", "digest", "path").distinct().groupBy("site", "path").agg(F.count(F.lit(1)).alias("m")), fresh_path(spark, "shown"))
    own = _measured(counts, pages, ["site", "path"])
    every = _measured(counts.groupBy("path", "kind", "feature").agg(F.sum("c").alias("c")), pages.groupBy("path").agg(F.sum("m").alias("m")), ["path"])
    every = every.select("path", *[F.col(c).alias(f"all_{c}") for c in ("m", "shape", "content")])
    measures = store(own.join(every, "path"), fresh_path(spark, "measures"))
    texts = each.groupBy("site", F.col("b.chains")[0].alias("path")).agg(F.first("b.chains").alias("chain"), F.max("b.leans").alias("lean"), F.sum(F.char_length("b.texts")).alias("chars"))
    # the largest presentation of a text's node and its branches
    chained = texts.select("site", F.col("path").alias("of"), F.explode("chain").alias("path")).join(measures.select("site", "path", "shape", "all_shape"), ["site", "path"])
    shapes = chained.groupBy("site", "of").agg(F.max("shape").alias("branch"), F.max("all_shape").alias("all_branch")).withColumnRenamed("of", "path")
    found = texts.join(measures.select("site", "path", "m", "content", "all_m", "all_content"), ["site", "path"]).join(shapes, ["site", "path"])

    def value(content: Column, branch: Column) -> Column:
        return F.lit(CONTENT_SHARE) * content + F.lit(1 - CONTENT_SHARE) * branch

    here, there = F.col("m") - 1, F.lit(PRIOR_PAGES) * (F.col("all_m") - 1) / (F.col("all_m") - 1 + F.lit(PRIOR_PAGES))
    seen = here * F.coalesce(value(F.col("content"), F.col("branch")), F.lit(0.0)) + there * F.coalesce(value(F.col("all_content"), F.col("all_branch")), F.lit(0.0))
    mixed = (seen + F.lit(NEUTRAL_PAGES * LOW_IMPORTANCE)) / (here + there + F.lit(NEUTRAL_PAGES))
    shift = F.element_at(F.create_map(*[F.lit(x) for k, v in SHIFT.items() for x in (k, v)]), F.col("lean"))
    leaves = store(found.select("site", "path", "chain", "chars", "m", mixed.alias("own"), shift.alias("shift")), fresh_path(spark, "leaves"))
    below = leaves.select("site", "chars", "own", "shift", F.explode(F.slice("chain", 2, BRANCHES)).alias("path"))
    branches = below.groupBy("site", "path").agg(*[(F.sum(F.col(c) * F.col("chars")) / F.sum("chars")).alias(c) for c in ("own", "shift")])
    nearest = branches.select("site", F.col("path").alias("near"), F.col("own").alias("around"))
    lifted = leaves.withColumn("near", F.get("chain", F.lit(1))).join(nearest, ["site", "near"], "left")
    lifted = lifted.select("site", "path", "m", ((F.col("own") + F.coalesce("around", "own")) / 2 + F.col("shift")).alias("importance"))
    branches = branches.select("site", "path", (F.col("own") + F.col("shift")).alias("importance"))
    return lifted.unionByName(branches.join(pages, ["site", "path"]).select("site", "path", "m", "importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", low: float = LOW_IMPORTANCE) -> DataFrame:
    """Per page (``id_col``, ``url_col``, text, n_chars).

    A null or empty html gives an empty text, and so does a page of low paths only. Pages whose url is null or has no host count as one host.
    Whole pages are read, whatever their length. Repeated rows and null ids are kept; further columns
    are ignored; no rows give no rows.

    A text goes with its own node or with any branch above it that is low. What is low is joined to the sets of paths that a host's pages have,
    of which there are few, and these to the pages.
    """
    spark = pages.sparkSession
    parsed = store(parse_pages(pages, id_col, url_col, html_col), fresh_path(spark, "parsed"), "zstd")
    # a mean of equal values may end a last digit below them
    lows = importance(parsed).where(F.col("importance") < low - 1e-9).select("site", "path")
    templates = parsed.groupBy("site", "template").agg(F.first(F.array_distinct("chains")).alias("chains")).select("site", "template", F.explode("chains").alias("chain"))
    nodes = templates.select("site", "template", F.col("chain")[0].alias("text"), F.explode("chain").alias("path"))
    pruned = store(nodes.join(lows, ["site", "path"]).groupBy("site", "template").agg(F.collect_set("text").alias("low")), fresh_path(spark, "low"))
    joined = parsed.select("id", "url", "site", "template", "texts", "paths").join(pruned, ["site", "template"], "left")
    kept = F.filter(F.arrays_zip("texts", "paths"), lambda b: F.col("low").isNull() | ~F.array_contains("low", b["paths"]))
    text = F.array_join(F.transform(kept, lambda b: b["texts"]), "\n")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
