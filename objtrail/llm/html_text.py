"""Main text of web pages by wrapper induction.

Pages of one host share templates.  Every page is parsed once into a folded DOM
tree (runs of like siblings are one node) and its blocks of text.  The commonest
trees of a host are its layouts; each page's tree is aligned with them by simple
tree matching, which gives its blocks their places.  A text that stands at one place
on a share of all the host's different articles is template; what varies is content.
Where no layout has a region, its path of labels is the place.

What HTML itself says about a region (navigation, forms, asides, scripts) is left
out before that, and an ``article`` or ``main`` element, where there is one, bounds
the content.  Class names are weak votes: they leave out a region only when all
words of a name say so, and never one that holds an article or most of the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from objtrail.llm.shared import Scratch, small_or_shuffled, store

BROADCAST_BYTES = 16 << 20
BROADCAST_HOSTS = 200_000
#: layouts of a host that pages are aligned with, and the longest tree that can be one
LAYOUTS = 4
LAYOUT_BYTES = 1 << 16
#: share of a host's different articles, and number of them, on which a template block stands
SHARE = 0.2
MIN_PAGES = 3
#: the same for an article's own sentences, which a few articles of a host may share
PROSE_SHARE = 0.5
PROSE_PAGES = 4
#: pairs of children that matching may compare; larger trees stand at their paths of labels
PAIRS = 1_000_000
#: alignments of trees of up to so many characters that a task remembers
_CACHED = 2000
_CACHED_CHARS = 4096

# fixed values: element names by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
SKIPPED = frozenset(
    "head nav footer aside script style textarea title noscript template iframe svg canvas button select dialog menu object audio video".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
LIMITS = frozenset("ul ol dl table article section main div body aside nav".split())
CLOSING_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: elements whose text, inside an article, is prose
PROSE = frozenset("article main section p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption".split())
BOUNDS = frozenset(["article", "main"])
# fixed values: words of class, id or role that mark what is not the article
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sidebar aside widget widgets footer masthead
    cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup
    login comment comments commentlist disqus reply replies respond share sharing social related
    recommended recommendations complementary contentinfo""".split()
)
#: words that say so outside an article only; inside, they may name its parts
PAGE_ONLY_WORDS = frozenset("header banner notice notices alert search skip discussion".split())
#: words that stand beside others in a name and say nothing
PLAIN_WORDS = frozenset("box block container wrap wrapper inner outer area section list item bar top bottom left right main site page".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")


def _says_noise(names: list[str], inside: bool) -> bool:
    """Whether one of an element's names consists of noise words, plain words aside."""
    for name in names:
        words = {w.lower() for w in _NAME_PART.findall(name)} - PLAIN_WORDS
        if words and all(w in NOISE_WORDS or (not inside and w in PAGE_ONLY_WORDS) for w in words):
            return True
    return False


class Node:
    """An element; ``parts`` holds child nodes and texts in page order."""

    __slots__ = ("block_inside", "holds_bound", "label", "noise", "parent", "parts", "tag", "weak")

    def __init__(self, tag: str, attributes: str, inside: bool, parent: Node | None) -> None:
        self.tag, self.parts, self.parent = tag, [], parent
        names = []
        if "=" in attributes:
            names = [x for _, a, b, c in _ATTRIBUTE.findall(attributes) for x in (a or b or c).split()]
        self.label = f"{tag} {_DIGITS.sub('#', ' '.join(sorted(names)))}" if names else tag
        #: left out for what it is, unless it holds an article; for its name, unless it holds most of the text
        self.noise = tag in SKIPPED or (tag == "header" and not inside)
        self.weak = False
        if not self.noise and tag not in ("html", "body") and tag not in BOUNDS:
            self.weak = tag == "form" or (bool(names) and _says_noise(names, inside))
            self.weak = self.weak or (attributes != "" and _HIDDEN.search(attributes) is not None)
        self.holds_bound = self.block_inside = False


def parse(page: str) -> Node:
    """A DOM tree; unclosed, misnested and truncated markup is tolerated."""
    root = Node("#root", "", False, None)
    stack, at, end, bounds = [root], 0, len(page), 0
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            stack[-1].parts.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            stack[-1].parts.append(html.unescape(page[at : found.start()]))
        at = found.end()
        tag = found.group(3)
        if tag is None:
            if found.group(1):
                stack[-1].parts.append(found.group(1))
            continue
        tag = tag.lower()
        if found.group(2):
            depth = len(stack) - 1
            while depth and stack[depth].tag != tag:
                depth -= 1
            if depth:
                bounds -= sum(n.tag in BOUNDS for n in stack[depth:])
                del stack[depth:]
            elif tag == "br":
                stack[-1].parts.append(Node("br", "", False, stack[-1]))
            continue
        if tag in CLOSING_P:
            _close(stack, frozenset(["p"]), LIMITS)
        elif tag in CLOSES:
            _close(stack, CLOSES[tag], LIMITS)
        node = Node(tag, found.group(4), bounds > 0, stack[-1])
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag not in INLINE:
            above = stack[-1]
            while above is not None and not above.block_inside:
                above.block_inside = True
                above = above.parent
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag == "title":
                node.parts.append(html.unescape(page[at : close.start() if close else end]))
            at = close.end() if close else end
            continue
        stack.append(node)
        if tag in BOUNDS:
            bounds += 1
            above = node.parent
            while above is not None and not above.holds_bound:
                above.holds_bound = True
                above = above.parent
    _settle(root)
    return root


def _close(stack: list[Node], tags: frozenset[str], limits: frozenset[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            del stack[depth:]
            return
        if stack[depth].tag in limits:
            return


def _settle(root: Node) -> None:
    """Decide which elements are left out: by their kind first, then by their names."""
    order, sizes = [root], {}
    for node in order:
        if not (node.noise and not node.holds_bound):
            order.extend(p for p in node.parts if not isinstance(p, str))
    for node in reversed(order):
        own = 0
        if not (node.noise and not node.holds_bound):
            own = sum(len(p.strip()) if isinstance(p, str) else sizes[id(p)] for p in node.parts)
        sizes[id(node)] = own
    shown = sizes[id(root)]
    for node in order:
        weak = node.weak and 2 * sizes[id(node)] <= shown
        node.noise = (node.noise or weak) and not node.holds_bound


class Block:
    """A stretch of text without block boundaries: its text and where it stands."""

    __slots__ = ("inside", "menu", "noise", "prose", "region", "text")

    def __init__(self, text: str, region: int, inside: bool, noise: bool, menu: bool, prose: bool) -> None:
        self.text, self.region, self.inside, self.noise, self.menu, self.prose = text, region, inside, noise, menu, prose


class Outline:
    """A page's folded tree (labels and parents of its regions, in page order) and its blocks."""

    __slots__ = ("blocks", "headline", "labels", "parents")

    def __init__(self) -> None:
        self.labels, self.parents = ["#root"], [-1]
        self.blocks: list[Block] = []
        self.headline = ""

    def tree(self) -> str:
        return "\x1e".join(f"{p}\x1f{x}" for p, x in zip(self.parents, self.labels, strict=True))


def read_tree(text: str) -> tuple[list[str], list[int]]:
    """Labels and parents of a tree written by ``Outline.tree``."""
    rows = [row.split("\x1f", 1) for row in text.split("\x1e")]
    return [label for _, label in rows], [int(parent) for parent, _ in rows]


def outline(root: Node) -> Outline:
    """The folded tree and all blocks of a page, in page order."""
    page = Outline()
    last_child: list[int] = [-1]
    run: list[str] = []
    linked = 0
    titles: list[str] = []

    def flush(region: int, tag: str, inside: bool, noise: bool) -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            links = "".join("".join(run).split())
            menu = tag == "li" and linked >= len(links)
            page.blocks.append(Block(text, region, inside, noise, menu, tag in PROSE))
            if tag == "h1" and not noise:
                titles.append(text)
        run.clear()
        linked = 0

    def inline(top: Node) -> None:
        """Add an inline element's text."""
        nonlocal linked
        work = [(top, 0, top.tag == "a")]
        while work:
            node, k, link = work.pop()
            while k < len(node.parts):
                part = node.parts[k]
                k += 1
                if isinstance(part, str):
                    run.append(part)
                    if link:
                        linked += len("".join(part.split()))
                elif part.tag == "br":
                    run.append(" ")
                elif part.tag in INLINE and not part.noise:
                    work.append((node, k, link))
                    work.append((part, 0, link or part.tag == "a"))
                    break

    # an explicit stack, for deep pages: [node, region, inside, noise, next part]
    work: list[list] = [[root, 0, False, False, 0]]
    while work:
        frame = work[-1]
        node, region, inside, noise, k = frame
        if k >= len(node.parts):
            flush(region, node.tag, inside, noise)
            work.pop()
            continue
        frame[4] = k + 1
        part = node.parts[k]
        if isinstance(part, str):
            if node.tag != "title":
                run.append(part)
            elif not page.headline:
                page.headline = " ".join(part.split())
        elif part.tag in VOID:
            run.append(" " if part.tag == "br" else "")
        elif part.tag in INLINE and part.noise:
            continue
        elif part.tag in INLINE and not part.block_inside:
            inline(part)
        else:
            flush(region, node.tag, inside, noise)
            last = last_child[region]
            if last < 0 or page.labels[last] != part.label:
                last = len(page.labels)
                page.labels.append(part.label)
                page.parents.append(region)
                last_child[region] = last
                last_child.append(-1)
            work.append([part, last, inside or part.tag in BOUNDS, noise or part.noise, 0])
    page.headline = "\n".join([*titles[:1], page.headline])
    if not page.headline.strip():
        page.headline = "\n".join(b.text for b in page.blocks if not b.noise)
    return page


def _children(parents: list[int]) -> list[list[int]]:
    found: list[list[int]] = [[] for _ in parents]
    for k, parent in enumerate(parents):
        if parent >= 0:
            found[parent].append(k)
    return found


def simple_tree_matching(
    a: tuple[list[str], list[int]], b: tuple[list[str], list[int]]
) -> tuple[int, list[tuple[int, int]]] | None:
    """Size of the largest order-preserving matching of two trees (labels, parents) from
    their roots, and its pairs of nodes; None beyond ``PAIRS`` pairs of children.

    Comparable pairs are listed from the roots down and scored from the leaves up, so
    trees may be of any depth.
    """
    labels_a, labels_b = a[0], b[0]
    if labels_a[0] != labels_b[0]:
        return 0, []
    below_a, below_b = _children(a[1]), _children(b[1])
    order, compared = [(0, 0)], 0
    for x, y in order:
        compared += len(below_a[x]) * len(below_b[y])
        if compared > PAIRS:
            return None
        mine: dict[str, list[int]] = {}
        for child in below_b[y]:
            mine.setdefault(labels_b[child], []).append(child)
        order.extend((c, d) for c in below_a[x] for d in mine.get(labels_a[c], ()))
    score: dict[tuple[int, int], int] = {}

    def table(x: int, y: int) -> list[list[int]]:
        rows, columns = below_a[x], below_b[y]
        best = [[0] * (len(columns) + 1)]
        for c in rows:
            above, row = best[-1], [0]
            for j, d in enumerate(columns):
                row.append(max(above[j + 1], row[j], above[j] + score.get((c, d), 0)))
            best.append(row)
        return best

    for x, y in reversed(order):
        score[x, y] = 1 + (table(x, y)[-1][-1] if below_a[x] and below_b[y] else 0)
    pairs = [(0, 0)]
    for x, y in pairs:
        best, i, j = table(x, y), len(below_a[x]), len(below_b[y])
        while i and j:
            c, d = below_a[x][i - 1], below_b[y][j - 1]
            if (c, d) in score and best[i][j] == best[i - 1][j - 1] + score[c, d]:
                pairs.append((c, d))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return score[0, 0], pairs


def _digest(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def places(tree: tuple[list[str], list[int]], layouts: list[tuple[list[str], list[int]]]) -> list[list[str]]:
    """Places of a tree's regions: the aligned regions of the layouts, or the path of
    labels where no layout has one."""
    found: list[list[str]] = [[] for _ in tree[0]]
    for k, layout in enumerate(layouts):
        matched = simple_tree_matching(tree, layout)
        for x, y in matched[1] if matched else ():
            found[x].append(f"{k} {y}")
    paths = [0]
    for label, parent in zip(tree[0][1:], tree[1][1:], strict=True):
        paths.append(_digest(str(paths[parent]), label))
    return [at or [f"/{path}"] for at, path in zip(found, paths, strict=True)]


class Aligner:
    """Places of trees in their host's layouts; equal trees of a host are aligned once."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int], list[list[str]]] = {}

    def of(self, tree: str, layouts: list[str]) -> list[list[str]]:
        key = (tree, _digest(*layouts))
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= _CACHED:
                self.known.clear()
            found = places(read_tree(tree), [read_tree(x) for x in layouts])
            if len(tree) <= _CACHED_CHARS:
                self.known[key] = found
        return found


def block_places(at: list[list[str]], region: int, text: str) -> list[int]:
    """Digests of a block's places together with its text."""
    return [_digest(place, text) for place in at[region]]


def _chosen(blocks: list[Block], template: list[bool], everywhere: list[bool]) -> list[str]:
    """The article's blocks: not left out, not template."""
    bounded = any(b.inside and not b.noise for b in blocks)
    kept = []
    for block, common, sure in zip(blocks, template, everywhere, strict=True):
        if block.noise or (bounded and not block.inside) or (block.menu and not bounded) or sure:
            continue
        # a few articles of a host may share a sentence: that is content
        if common and not (bounded and block.prose):
            continue
        kept.append(block.text)
    return kept


def extract(page: str, references: list[Outline]) -> list[str]:
    """The article's blocks of one page, given some other pages of its host.

    A block is template if all references that are no copies of the page repeat it at
    an aligned place; an article's own sentences stay.
    """
    own = outline(parse(page))
    tree = (own.labels, own.parents)
    votes = []
    shown = {b.text for b in own.blocks if not b.noise}
    for other in references:
        theirs = {b.text for b in other.blocks if not b.noise}
        if shown <= theirs or shown >= theirs:  # no slot varies
            continue
        texts: dict[int, set[str]] = {}
        for b in other.blocks:
            texts.setdefault(b.region, set()).add(b.text)
        matched = simple_tree_matching(tree, (other.labels, other.parents))
        aligned = dict(matched[1]) if matched else {}
        votes.append([b.text in texts.get(aligned.get(b.region, -1), ()) for b in own.blocks])
    template = [bool(votes) and all(v) for v in zip(*votes, strict=True)] if votes else [False] * len(own.blocks)
    return _chosen(own.blocks, template, [False] * len(own.blocks))


_BLOCKS = pa.list_(
    pa.struct(
        [("text", pa.string()), ("region", pa.int32()), ("inside", pa.bool_()), ("noise", pa.bool_()), ("menu", pa.bool_()), ("prose", pa.bool_())]
    )
)
_BLOCKS_SQL = "array<struct<text:string,region:int,inside:boolean,noise:boolean,menu:boolean,prose:boolean>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, host, tree, article (digest of the headline) and blocks of pages; a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            trees, articles, blocks = [], [], []
            for body in part.column(3).to_pylist():
                page = outline(parse(body))
                trees.append(page.tree())
                articles.append(_digest(page.headline))
                blocks.append([{n: getattr(b, n) for n in Block.__slots__} for b in page.blocks])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(trees, pa.string()), pa.array(articles, pa.int64()), pa.array(blocks, _BLOCKS)],
                names=["page_id", "url", "host", "tree", "article", "blocks"],
            )


def _count_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, article and place digest, one row a place; a null place for a page without blocks."""
    aligner = Aligner()
    for batch in batches:
        hosts, articles, found = [], [], []
        for host, tree, article, blocks, layouts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            at = aligner.of(tree, layouts or [])
            here = {d for b in blocks if not b["noise"] for d in block_places(at, b["region"], b["text"])}
            for place in sorted(here) or [None]:
                hosts.append(host)
                articles.append(article)
                found.append(place)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(articles, pa.int64()), pa.array(found, pa.int64())],
            names=["host", "article", "place"],
        )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner = Aligner()
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            kept = []
            for tree, rows, layouts, recurring, common in zip(*(part.column(i).to_pylist() for i in range(2, 7)), strict=True):
                blocks = [Block(**b) for b in rows]
                template = everywhere = [False] * len(blocks)
                if recurring:
                    at = aligner.of(tree, layouts or [])
                    some, most = frozenset(recurring), frozenset(common or ())
                    digests = [block_places(at, b.region, b.text) for b in blocks]
                    template = [not some.isdisjoint(d) for d in digests]
                    everywhere = [not most.isdisjoint(d) for d in digests]
                kept.append(_chosen(blocks, template, everywhere))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(kept, pa.list_(pa.string())), pa.array([" ".join(x) for x in kept], pa.string())],
                names=["page_id", "url", "blocks", "text"],
            )


def _layouts(parsed: DataFrame) -> DataFrame:
    """host and its layouts: the commonest of its trees in each of ``LAYOUTS`` classes by digest."""
    shapes = (
        parsed.where(F.octet_length("tree") <= LAYOUT_BYTES)
        .groupBy("host", "tree")
        .agg(F.count("*").alias("n"))
        .withColumn("digest", F.xxhash64("tree"))
    )
    entry = F.struct("n", "digest", "tree")
    best = [F.max(F.when(F.pmod("digest", F.lit(LAYOUTS)) == k, entry)).alias(f"l{k}") for k in range(LAYOUTS)]
    found = shapes.groupBy("host").agg(*best)
    return found.select("host", F.array_compact(F.array(*[F.col(f"l{k}.tree") for k in range(LAYOUTS)])).alias("layouts"))


def _joined(rows: DataFrame, small: DataFrame, weight: int) -> DataFrame:
    return rows.join(F.broadcast(small) if weight <= BROADCAST_BYTES else small, "host", "left")


def page_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, url, blocks (array<string>) and text of every page.

    Null or empty html gives no blocks and an empty text; a null or odd url has
    the empty host, whose pages share layouts like any other's.  A block's text and
    place are counted over all articles of the host: pages of one headline (h1 and
    title, or all blocks where there is neither) are versions of one article and count once, so an
    article repeated on its host stays whole.  Repeated rows give repeated results,
    an empty table an empty one; other columns are ignored.

    Each page is parsed once.  Layouts of a host, at most ``LAYOUTS``, and its recurring
    digests, no more than ``1 / SHARE`` pages hold, are broadcast when their counted
    bytes are within ``BROADCAST_BYTES``, else joined by a shuffle that the adaptive
    planner splits at a host with very many pages.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        host.alias("host"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    scratch = Scratch()
    parsed = store(
        rows.mapInArrow(_parsed, f"page_id long, url string, host string, tree string, article long, blocks {_BLOCKS_SQL}"), "parsed"
    )
    layouts = scratch.store(_layouts(parsed), "layouts")
    weight = layouts.agg(F.sum(F.aggregate("layouts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))).alias("n")).first().n or 0
    # (1) on how many different articles each text stands at its place
    filled = parsed.where(F.size("blocks") > 0).select("host", "tree", "article", "blocks")
    placed = _joined(filled, layouts, weight).select("host", "tree", "article", "blocks", "layouts")
    placed = scratch.store(
        placed.mapInArrow(_count_places, "host string, article long, place long").distinct(), "places"
    )
    pages_of = placed.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    pages_of = scratch.store(pages_of, "pages")
    pages_of = small_or_shuffled(pages_of, pages_of.count(), BROADCAST_HOSTS)
    enough = F.greatest(F.lit(2), F.least(F.lit(MIN_PAGES), "n_pages"), SHARE * F.col("n_pages"))
    many = F.greatest(F.lit(PROSE_PAGES), PROSE_SHARE * F.col("n_pages"))
    recurring = (
        placed.where(F.col("place").isNotNull())
        .groupBy("host", "place")
        .agg(F.count("*").alias("n"))
        .join(pages_of, "host")
        .where(F.col("n") >= enough)
        .groupBy("host")
        .agg(
            F.collect_list("place").alias("recurring"),
            F.collect_list(F.when(F.col("n") >= many, F.col("place"))).alias("common"),
        )
    )
    # (2) each page without its recurring blocks
    wrappers = store(layouts.join(recurring, "host", "left"), "wrappers")
    held = wrappers.agg(F.sum(F.coalesce(F.size("recurring"), F.lit(0)) + F.coalesce(F.size("common"), F.lit(0))).alias("n")).first().n or 0
    scratch.drop()
    joined = _joined(parsed.drop("article"), wrappers, weight + 8 * held)
    return joined.select("page_id", "url", "tree", "blocks", "layouts", "recurring", "common").mapInArrow(
        _extracted, "page_id long, url string, blocks array<string>, text string"
    )
