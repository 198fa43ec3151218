"""HTML extraction with site style trees.

The DOMs of a host are merged by path (tags and class names from the root).  What a node of the merged tree is worth follows from
what the host's pages put there.  Content: a node whose texts recur on many pages is worth little, to the base of
the number of pages.  Presentation: so is a node that always holds the same sequence of children, by the entropy of its sequences.  A block
of a page counts as its own node's content and the presentation of the branch that it stands in.

Few pages say little, so the tree's worth is averaged with a prior from the markup, the more in favour of the tree the more pages
have the node, up to a largest weight.  Blocks below the least importance are removed, inside articles as well.  Elements that
are never shown (scripts, styles, templates, hidden ones) are removed outright.  The weights are such that the tree can remove what
markup takes for an article's part, but can't save what markup names as noise (0.6 at best, the bound being 0.65), so names are read narrowly: see
_names().
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, numbered, table
from .url_filter import host_of

#: A block below this importance is removed.
IMPORTANCE = 0.65
#: Weight of a branch's content against its presentation, to the power of the number of its sequences of children.
GAMMA = 0.9
#: Largest weight of the tree against the markup, and for paragraphs, headings and the like without classes in an article.
WEIGHT, PLAIN_WEIGHT = 0.6, 0.3
#: Pages from which on the tree has half its largest weight.
PAGES = 8.0
#: Importance by markup alone: of what is named as no part of the article, of what stands beside an article, of an article's
#: parts, of all else.
NOISE, BESIDE, ARTICLE, OTHER = 0.0, 0.1, 1.0, 0.85
#: Tree nodes that are broadcast (about 10 MB); more are joined by shuffling the nodes of pages.
BROADCAST_NODES = 200_000

# The HTML vocabulary that the extraction goes by.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = set("nav footer aside form button select dialog menu fieldset datalist".split())
PLAIN = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split())
NOISE_WORDS = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside ad ads adv advert adverts advertisement advertisements adsense adslot sponsor sponsored "
    "promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login social share sharing "
    "related recommended recommendations comment comments disqus reply replies respond form search widget toolbar pagination pager copyright disclaimer alert paywall skip".split()
)
#: Not the article where they stand outside of it; inside, they may hold its title.
HEADERS = {"header"}
#: What may be marked up as an article without being the page's.
ASIDES = set("comment comments reply ad advert sponsored related".split())

#: Words that name a place or a piece of what the word before them names, and words that make of a noise word something else.
PIECES = set("container wrapper wrap box list block section area bar link links widget item items inner outer content header title unit slot region panel button buttons icon icons top bottom left right main group row col column holder zone count form posts articles stories news products videos".split())
NOT_THERE = set("has have no not with without is hide hides free less".split())

# Quotes hold a > only if they end; else, by the second form, the tag ends at the first >.  Nothing is read twice within a form.
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES = {k: (set(a.split()), set(b.split())) for k, (a, b) in _CLOSES.items()}


class Node:
    """hidden, noise and article hold for what is inside as well; block is the nearest element that isn't inline."""

    __slots__ = ("tag", "parent", "block", "key", "hidden", "noise", "article", "plain", "children", "texts")

    def __init__(self, tag: str, parent: Node | None, key: int, hidden: bool, noise: bool, article: int, plain: bool):
        self.tag, self.parent, self.key, self.hidden, self.noise, self.article, self.plain = tag, parent, key, hidden, noise, article, plain
        self.block: Node = parent.block if parent is not None and tag in INLINE and not noise and not hidden else self
        self.children: list[int] = []
        self.texts = 0


def _attributes(raw: str) -> dict[str, str]:
    return {n.lower(): a or b or c or "" for n, a, b, c in _ATTR.findall(raw)} if raw.strip(" /\n\t\r\f") else {}


def _names(value: str, words: set[str]) -> bool:
    """Whether one of a class list's or an id's names names one of the words: as a whole, as its last word, or before a word for a piece of it.
    "has-sidebar", "ad-free", "related-work" and "social-science" don't."""
    for name in value.split():
        parts = [w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", name) if w]
        if not parts or NOT_THERE.intersection(parts):
            continue
        last = len(parts) - 1
        while last > 0 and parts[last] in PIECES and parts[last] not in words:
            last -= 1
        if parts[last] in words:
            return True
    return False


def _is_hidden(tag: str, at: dict[str, str]) -> bool:
    if tag in RAW or tag == "head" or at and ("hidden" in at or at.get("aria-hidden", "").lower() == "true"):
        return True
    return bool(at) and "style" in at and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at["style"], re.I))


def _is_noise(tag: str, at: dict[str, str], inside: bool) -> bool:
    if tag in NOISE_TAGS or at and at.get("role", "").lower() in NOISE_ROLES:
        return True
    names = f"{at.get('class', '')} {at.get('id', '')}" if at else ""
    if tag in ("html", "body", "main") or tag == "article" and not _names(names, ASIDES):
        return False
    return _names(names, NOISE_WORDS) or not inside and (tag == "header" or _names(names, HEADERS))


def parse(source: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The elements in page order, the root first, and the text blocks, each with the element that it stands in.

    A block ends where an element that isn't inline begins or ends.  Unclosed elements end with their parent, and
    paragraphs and list items where the next begins.  Comments, doctypes and what raw elements hold give no text.  No step
    depends on how deep elements are nested, so markup of any depth is read in time in proportion to its length.
    """
    keys: dict[tuple[int, str, str], int] = {}
    root = Node("#root", None, 0, False, False, 0, False)
    stack, nodes, blocks, run = [root], [root], [], []
    open_tags: dict[str, int] = {}

    def flush() -> None:
        if run:
            text = " ".join(html_lib.unescape("".join(run)).split())
            run.clear()
            if text and not stack[-1].hidden:
                owner = stack[-1].block
                owner.texts += 1
                blocks.append((owner, text))

    def cut(size: int) -> None:
        while len(stack) > size:
            open_tags[stack.pop().tag] -= 1

    at, last = 0, source.rfind(">")
    while True:
        m = _TAG.search(source, at) if at <= last else None
        if m is None:
            rest = source[at:]
            run.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
            break
        run.append(source[at : m.start()])
        at = m.end()
        close, tag, raw = m.group(1) or m.group(4), (m.group(2) or m.group(5) or "").lower(), m.group(3) or m.group(6) or ""
        if not tag:
            continue
        if close:
            if open_tags.get(tag):
                size = len(stack) - 1
                while stack[size].tag != tag:
                    size -= 1
                if tag not in INLINE and tag not in RAW or tag in INLINE and stack[size].block is stack[size]:
                    flush()
                cut(size)
            elif tag == "p":
                flush()
            continue
        if tag in INLINE:
            if tag == "br":
                run.append(" ")
        elif tag not in RAW:
            flush()
            ends, scope = _CLOSES.get(tag, ({"p"}, None))
            if any(open_tags.get(e) for e in ends):
                for i in range(len(stack) - 1, 0, -1):
                    here = stack[i].tag
                    if here in ends:
                        cut(i)
                        break
                    if here in scope if scope else here not in INLINE:
                        break
        if tag in VOID:
            continue
        up = stack[-1]
        attrs = _attributes(raw)
        hidden = up.hidden or _is_hidden(tag, attrs)
        noise = up.noise or _is_noise(tag, attrs, up.article > 0)
        if tag in INLINE and noise and not up.noise and any(x.strip() for x in run):
            noise = False  # inside a running text it is part of it
        if tag in INLINE and not (noise and not up.noise) and not (hidden and not up.hidden):
            if not raw.rstrip().endswith("/"):
                n = Node(tag, up, up.key, up.hidden, up.noise, up.article, up.plain)
                n.block = up.block
                stack.append(n)
                open_tags[tag] = open_tags.get(tag, 0) + 1
            continue
        if tag in INLINE:
            flush()
        parent = up.block
        classes = " ".join(sorted(re.sub(r"\d+", "", attrs.get("class", "")).split()))
        mark = (parent.key, tag, classes)
        key = keys.get(mark)
        if key is None:
            key = keys[mark] = xxhash.xxh64_intdigest("\n".join(map(str, mark))) >> 1
        article = up.article or int(tag in ("article", "main") or attrs.get("role", "").lower() == "main" or "articlebody" in attrs.get("itemprop", "").lower())
        node = Node(tag, parent, key, hidden, noise, article, tag in PLAIN and not classes and (not parent.article or parent.plain or parent.tag in ("article", "main")))
        if not hidden:
            parent.children.append(key)
            nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            at = end.start() if end else len(source)
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return nodes, blocks


def style_rows(source: str) -> set[tuple[int, bool, int]]:
    """What a page adds to its host's style tree: (node, leaf, feature) without repetitions.  A leaf's features are its
    texts, an element's is the sequence of its children."""
    nodes, blocks = parse(source)
    rows = {(n.key, False, xxhash.xxh64_intdigest(",".join(map(str, n.children))) >> 1) for n in nodes}
    rows.update((n.key, True, xxhash.xxh64_intdigest(text) >> 1) for n, text in blocks)
    return rows


#: A tree: by node, content importance, presentation importance, sequences of children and pages.  None: not known.
Tree = dict[int, tuple[float | None, float, int, int]]


def _branch(n: Node) -> Node:
    """The nearest element around a block that has several parts."""
    while n.parent is not None and len(n.children) + n.texts < 2:
        n = n.parent
    return n


def importance(n: Node, tree: Tree, beside: bool, around: Node | None = None) -> float:
    """Of a block in element n; beside: the page has an article and the block isn't in it."""
    prior = NOISE if n.noise else BESIDE if beside else ARTICLE if n.article else OTHER
    content, _, _, pages = tree.get(n.key, (None, 0.0, 0, 0))
    if content is None or not pages:
        return prior
    _, presentation, kinds, _ = tree.get((around or _branch(n)).key, (None, 0.0, 0, 0))
    share = GAMMA**kinds
    weight = (PLAIN_WEIGHT if n.article and n.plain and not n.noise else WEIGHT) * pages / (pages + PAGES)
    return (1 - weight) * prior + weight * ((1 - share) * presentation + share * content)


def extract(source: str | None, tree: Tree | None = None, least: float = IMPORTANCE) -> str:
    """Main text: the blocks of at least the least importance in page order, one line each.  Without a tree, by markup alone."""
    if not source:
        return ""
    _, blocks = parse(source)
    has = any(n.article and not n.noise for n, _ in blocks)
    known: dict[int, bool] = {}
    kept = []
    for n, text in blocks:
        stays = known.get(id(n))
        if stays is None:
            stays = known[id(n)] = importance(n, tree or {}, has and not n.article) >= least
        if stays:
            kept.append(text)
    return "\n".join(kept)


def style_trees(pages: DataFrame) -> DataFrame:
    """pages: host, html.  host, node, content, presentation, kinds, on: one row per node of a host's tree.

    Content: 1 - mean over the node's texts of log_m(pages with the text), for m pages of the host (1 for a single page).
    Presentation: the entropy to base m of its sequences of children.  All comes from sums that tasks combine before
    the shuffle, so a host with a third of all pages is no larger than its tree.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, found = [], []
            for host, source in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
                if source:
                    new = list(style_rows(source))
                    found += new
                    hosts += [host] * len(new)
            node, leaf, feature = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch({"host": pa.array(hosts, pa.string()), "node": pa.array(node, pa.int64()), "leaf": pa.array(leaf, pa.bool_()), "feature": pa.array(feature, pa.int64())})

    k = pages.select("host", "html").mapInArrow(rows, "host string, node long, leaf boolean, feature long").groupBy("host", "node", "leaf", "feature").agg(F.count("*").alias("k"))
    m = pages.groupBy("host").agg(F.greatest(F.count("html"), F.lit(1)).alias("m"))
    leaf, log = F.col("leaf"), F.ln("k")
    of = lambda f, when: f(F.when(when, F.col("k")))
    per = k.groupBy("host", "node").agg(
        F.avg(F.when(leaf, log)).alias("mean"), F.count_if(~leaf).cast("int").alias("kinds"), of(F.sum, ~leaf).alias("on"), F.sum(F.when(~leaf, F.col("k") * log)).alias("klogk")
    )
    base = F.when(F.col("m") > 1, F.ln("m"))
    content = F.when(F.col("mean").isNotNull(), F.coalesce(1 - F.col("mean") / base, F.lit(1.0)))
    presentation = F.coalesce((F.ln("on") - F.col("klogk") / F.col("on")) / base, F.lit(0.0))
    # a node that a page has several times has more sequences than pages
    return per.join(m, "host").select("host", "node", content.alias("content"), F.least(presentation, F.lit(1.0)).alias("presentation"), "kinds", F.least("on", "m").cast("int").alias("on"))


def _with_trees(pages: DataFrame, trees: DataFrame, shared: bool) -> DataFrame:
    """pages with nodes, the array of its host's tree nodes (all if shared, else those that the page has).

    Trees of up to BROADCAST_NODES nodes are broadcast.  Of more, every page is joined to the nodes that it has, so no row
    holds more than a page's own nodes; a hot host's nodes are split by Spark's skew join.
    """
    node = F.struct("node", "content", "presentation", "kinds", "on").alias("n")
    if shared:
        return pages.join(F.broadcast(trees.groupBy("host").agg(F.collect_list(node).alias("nodes"))), "host", "left")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({n.key for n in parse(s)[0]}) if s else [] for s in b["html"].to_pylist()]
            yield pa.record_batch({"_page": b["_page"], "host": b["host"], "own": pa.array(found, pa.list_(pa.int64()))})

    numbered_pages = numbered(pages, "_page")
    has = numbered_pages.select("_page", "host", "html").mapInArrow(own, "_page long, host string, own array<long>").select("_page", "host", F.explode("own").alias("node"))
    nodes = has.join(trees, ["host", "node"]).groupBy("_page").agg(F.collect_list(node).alias("nodes"))
    return numbered_pages.join(nodes, "_page", "left")


def extract_pages(pages: DataFrame, least: float = IMPORTANCE) -> DataFrame:
    """pages (page_id, url, html): page_id, url, text, n_chars for every row.

    A null or empty html gives an empty text; a null url belongs to the empty host; repeated rows are extracted one by one and
    count as pages of their host; on a host of one page the markup decides; an empty table gives an empty result; other
    columns are left out.  Texts of any length and depth are taken whole.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    p = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    trees = style_trees(p).checkpoint()  # pages are parsed for it once
    shared = trees.count() <= BROADCAST_NODES
    out = _with_trees(p, trees, shared).select("page_id", "url", "html", "host", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Tree] = {}
        for b in batches:
            texts = []
            for host, source, nodes in zip(b["host"].to_pylist(), b["html"].to_pylist(), b["nodes"], strict=True):
                tree = made.get(host) if shared else None
                if tree is None:
                    if len(made) > 1000:
                        made.clear()
                    tree = made[host] = {n["node"]: (n["content"], n["presentation"], n["kinds"], n["on"]) for n in nodes.as_py() or []}
                texts.append(extract(source, tree, least))
            yield pa.record_batch({"page_id": b["page_id"], "url": b["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kind = dict(pages.dtypes)["page_id"]
    return out.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
