"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose nodes are style paths (tags with their class and id, from the root), over
every presentation and content node. A node's importance weighs two normalised entropies over the host's distinct pages: of
what its branch holds (1 if every page has its own text there, 0 if all have the same) and of how it looks, the row of its
children. A few pages say little, so a branch's importance on its host is weighed against its importance in the tree of all
hosts as p pages against EVIDENCE, and that likewise against what an element's kind and name make likely (LIKELY). The more
pages, the less names matter; no number of pages is a threshold.

A branch is judged by its share of the most important one's. The site's main branch is the deepest of the important ones that
hold half of the host's texts. Inside of it only branches of LOW importance go; outside of it all below GOOD go, and those that
a name declares to be something else. So an advert that always looks alike stays only if no page shares its text, and a passage
that many articles share stays: plain text elements are judged by the branch that holds them, never by their own repeats.

Readers' comments differ on each page, so no entropy can tell them from text: a block whose name says comments and that holds a
list of blocks alike has its importance cut (COMMENTS). Names of inline elements mean nothing. What HTML itself sets apart from
the text (navigation, footers, asides, forms, scripts) never counts as text.
"""

from __future__ import annotations

import html as entities
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages that weigh as much as what is known without them.
EVIDENCE = 20
#: Branches one in another, but for article and main; what is deeper, as in pages that close nothing, belongs to the deepest of these.
MOST_DEPTH = 64
#: Shares of the most important branch's importance: below LOW a branch goes anywhere, below GOOD outside of the main branch.
LOW = 0.3
GOOD = 0.8
#: Weight of how a branch looks against what it holds.
LOOKS = 0.2
#: Importance without any page, by what a branch's element and name declare it to be, and of readers' comments with any number.
PLAIN, PART_OF_PAGE, ADVERT, TALK, TALKS, ARTICLE = range(6)
LIKELY = {PLAIN: 0.7, PART_OF_PAGE: 0.5, ADVERT: 0.1, TALK: 0.5, TALKS: 0.1, ARTICLE: 1.0}
COMMENTS = 0.2
#: Importance that a main branch needs, which a plain element has by evidence only; no share is taken of less.
SURE = 0.75

#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split())
DROPPED = frozenset("nav footer aside form button select option input textarea menu dialog head noscript object iframe svg math canvas audio video map template datalist fieldset".split())
RAW = "script|style|textarea|title|noscript|iframe|noframes|xmp|template"
#: Parts of a class, id or role that declare what a branch is on the page, and parts that say where it is; a name declares
#: something only if it has no other parts.
ROLES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer footnav sidebar side rail widget widgets aside complementary contentinfo"
    " comment comments respond reply replies discussion disqus cookie cookies consent notice notices alert popup modal overlay dialog newsletter subscribe signup login search searchbox form share sharing social follow related recommended pagination pager toolbar skip copyright legal".split()
)
PLACES = frozenset("site page top bottom left right upper lower main box wrap wrapper container area list block section bar thread item items links posts inner outer bottom fixed".split())
#: Of the parts, those that declare adverts and readers' comments.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored".split())
TALKING = frozenset("comment comments respond reply replies discussion disqus".split())
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")
HOST = re.compile(r"^[^:/?#]*://(?:[^/?#@]*@)?([^/:?#]+)")


def host_of(url: str | None) -> str:
    """Lower-case host; empty if there is none."""
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


def _hash(*parts) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


class Block:
    """A run of text: what counts of it, all of it, its branches from the root, where in these an article or main begins (-1: nowhere)."""

    __slots__ = ("text", "whole", "branches", "main", "named")

    def __init__(self, text: str, whole: str, branches: tuple[int, ...], main: int, named: bool):
        self.text, self.whole, self.branches, self.main, self.named = text, whole, branches, main, named


def declared(name: str) -> int:
    """What a name declares its element to be: PLAIN, PART_OF_PAGE, ADVERT or TALK."""
    parts = [w.lower() for w in PART.findall(name)]
    if not parts or not all(w in ROLES or w in PLACES for w in parts):
        return PLAIN
    return ADVERT if any(w in ADVERTS for w in parts) else TALK if any(w in TALKING for w in parts) else PART_OF_PAGE if any(w in ROLES for w in parts) else PLAIN


def _marks(attributes: str) -> tuple[str, int]:
    """Style (classes and ids, digits as 0) and the strongest declaration among its names and role."""
    if "=" not in attributes:
        return "", PLAIN
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in MARK.finditer(attributes)]
    style = ".".join(sorted(x for k, v in found if k != "role" for x in v.split()))
    return re.sub(r"\d+", "0", style), max((declared(x) for _, v in found for x in v.split()), default=PLAIN)


class _Open:
    """An open element: chain holds the branches from the root to it, begins the place in these of the first article or main,
    kinds the styles of its block-level children, alike whether one of these came twice, in it or below it."""

    __slots__ = ("tag", "path", "branch", "drop", "named", "article", "chain", "begins", "looks", "kinds", "alike")

    def __init__(self, tag, path, branch, drop, named, article, chain, begins):
        self.tag, self.path, self.branch, self.drop, self.named, self.article, self.chain, self.begins = tag, path, branch, drop, named, article, chain, begins
        self.looks, self.kinds, self.alike = 0, set(), False


#: Start tags that end an open element of the second kind.
CLOSES = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}


def parse(page: str, names: bool = True) -> tuple[list[Block], dict[int, list]]:
    """Text blocks in page order, white space made single and character references decoded; and by branch (style path) its
    depth, what its element and name declare (if ``names`` are heeded), and how each of its elements looks (the row of its
    block-level children)."""
    stack: list[_Open] = [_Open("", 0, False, False, False, False, (), -1)]
    blocks: list[Block] = []
    text: list[tuple[str, bool]] = []
    looks: dict[int, list] = {}
    opened: dict[str, int] = {}

    def flush():
        if text:
            whole = " ".join("".join(x for x, _ in text).split())
            if whole:
                own = " ".join("".join(x for x, dropped in text if not dropped).split()) if any(dropped for _, dropped in text) else whole
                blocks.append(Block(own, whole, stack[-1].chain, stack[-1].begins, stack[-1].named))
            text.clear()

    def pop(k: int) -> None:
        for j in range(len(stack) - 1, k - 1, -1):
            o = stack[j]
            opened[o.tag] -= 1
            stack[j - 1].alike = stack[j - 1].alike or o.alike
            if o.branch:
                about = looks[o.path]
                about[2].append(o.looks)
                about[1] = TALKS if o.alike and about[1] == TALK else about[1]
        del stack[k:]

    def close(tag: str) -> None:
        if not opened.get(tag):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                if any(o.tag not in INLINE for o in stack[k:]):
                    flush()
                pop(k)
                return
            if stack[k].tag in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
                return  # a stray end tag closes nothing outside of its region

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append((entities.unescape(page[at : m.start()]), stack[-1].drop))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            close(tag)
            continue
        if tag in VOID or m[4].endswith("/") and tag not in CONTENT:
            if tag in ("br", "hr"):
                text.append((" ", False))
            continue
        if tag == "p" or tag in CLOSES and any(o.tag == CLOSES[tag] for o in stack[-3:]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == CLOSES[tag]:
                    flush()
                    pop(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag not in INLINE:
            flush()
        top = stack[-1]
        style, name = _marks(m[4])
        root, inline = tag in ("html", "body"), tag in INLINE
        name = name if names and not root and not inline else PLAIN
        drop = top.drop or tag in DROPPED or tag == "header" and not top.article
        main = tag in ("article", "main") and not drop
        named = not main and (top.named or name != PLAIN and top.begins < 0)
        path = _hash(top.path, tag, style)
        branch = not root and not inline and (bool(style) or tag not in CONTENT) and (main or len(top.chain) < MOST_DEPTH)
        if branch and path not in looks:
            looks[path] = [len(top.chain), name if name != PLAIN else ARTICLE if main and names else PLAIN, []]
        begins = len(top.chain) if main and top.begins < 0 else top.begins
        if not inline:
            top.looks = zlib.crc32(path.to_bytes(8, "little", signed=True), top.looks)
            if path in top.kinds and (style or tag in ("li", "article")):
                top.alike = True
                if branch and looks[path][1] == TALK:
                    looks[path][1] = TALKS
            top.kinds.add(path)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(_Open(tag, path, branch, drop, named, top.article or tag == "article", (*top.chain, path) if branch else top.chain, begins))
    if at < len(page):
        text.append((entities.unescape(page[at:]), stack[-1].drop))
    flush()
    pop(1)
    return blocks, looks


class Tree:
    """What a site's tree says of a page's branches: those of low and of good importance, and the main branch: the host's own, or
    where a page hasn't got it the usual one."""

    __slots__ = ("low", "good", "mains")

    def __init__(self, low=(), good=(), mains=()):
        self.low, self.good, self.mains = frozenset(low), frozenset(good), [m for m in mains if m is not None]

    @classmethod
    def alone(cls, page: str, names: bool = True) -> "Tree":
        """The tree of a site of one page."""
        blocks, looks = parse(page, names)
        texts: dict[int, set] = {}
        for block in blocks:
            for path in block.branches:
                texts.setdefault(path, set()).add(block.whole)
        value = {}
        for path in texts:
            kind = looks[path][1]
            value[path] = LIKELY[kind]
            for _ in ("all hosts", "this one"):
                value[path] = ((COMMENTS if kind == TALKS else 1.0) + EVIDENCE * value[path]) / (1 + EVIDENCE)
        best, most = max([SURE, *value.values()]), max(map(len, texts.values()), default=0)
        share = {path: v / best for path, v in value.items()}
        main = max(((looks[p][0], len(texts[p]), p) for p, x in share.items() if x >= GOOD and value[p] >= SURE and 2 * len(texts[p]) >= most), default=None)
        return cls([p for p, x in share.items() if x < LOW], [p for p, x in share.items() if x >= GOOD], [main[2]] if main else [])


def main_text(page: str, tree: Tree | None = None, names: bool = True) -> str:
    """The text of the blocks that stay by a site's tree; without one by the tree of the page alone.

    names: whether names of classes, ids and roles, and article and main elements, count at all.
    """
    tree = Tree.alone(page, names) if tree is None else tree
    blocks = [b for b in parse(page, names)[0] if b.text and not any(x in tree.low for x in b.branches)]
    main = next((m for m in tree.mains if any(m in b.branches for b in blocks)), None)
    if main is None:
        return " ".join([b.text for b in blocks if all(x in tree.good for x in b.branches)] or [b.text for b in blocks])
    above = {x for b in blocks if main in b.branches for x in b.branches[: b.branches.index(main)]}

    def stays(b: Block) -> bool:
        own = [x for x in b.branches if x not in above]
        return main in own or bool(own) and not b.named and all(x in tree.good for x in own)

    return " ".join(b.text for b in blocks if stays(b))


def _entropy(kind: int) -> Column:
    """Normalised entropy of the values of a kind: 1 for a single one."""
    m, s = F.col(f"m{kind}"), F.col(f"s{kind}")
    return F.when(m > 1, 1 - s / (m * F.log(m))).otherwise(1.0)


def importance(counts: DataFrame, *key: str) -> DataFrame:
    """key, pages, importance, texts (distinct ones), depth and kind (what is declared) of every branch with text; counts: key,
    kind, value and c.

    kind 0: a text of the branch; 1: how the branch looks on a page; 2: its depth and what it is declared to be.
    """
    sums = [x for k in (0, 1) for x in (F.sum(F.when(F.col("kind") == k, F.col("c"))).alias(f"m{k}"), F.sum(F.when(F.col("kind") == k, F.col("c") * F.log("c"))).alias(f"s{k}"))]
    total = counts.groupBy(*key).agg(*sums, F.count_if(F.col("kind") == 0).alias("texts"), F.max(F.when(F.col("kind") == 2, F.col("value"))).alias("about"))
    value = ((1 - LOOKS) * _entropy(0) + LOOKS * _entropy(1)) * F.when(F.col("about") % 8 == TALKS, COMMENTS).otherwise(1.0)
    return total.where("m0 > 0").select(*key, F.col("m1").alias("pages"), value.alias("importance"), "texts", F.floor(F.col("about") / 8).alias("depth"), (F.col("about") % 8).alias("declared"))


def weighed(before: Column | float) -> Column:
    """The importance that some pages show, against what is known without them."""
    return (F.col("pages") * F.col("importance") + EVIDENCE * before) / (F.col("pages") + EVIDENCE)


def cells(pages: DataFrame, names: bool = True) -> DataFrame:
    """Distinct host, path, kind, value and copy: what the branches of each page hold and look like, and what is said of them.

    Pages of the same texts, but for those that HTML sets apart, are copies; see importance() for the kinds.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = set()
            for url, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if raw:
                    host = host_of(url)
                    blocks, looks = parse(raw.decode("utf-8", "replace"), names)
                    copy = _hash(*sorted({x.text for x in blocks if x.text}))
                    rows.update((host, path, 0, _hash(x.whole), copy) for x in blocks for path in x.branches)
                    rows.update((host, path, 1, _hash(*sorted(rows_)), copy) for path, (_, _, rows_) in looks.items())
                    rows.update((host, path, 2, depth * 8 + kind, 0) for path, (depth, kind, _) in looks.items())
            got = list(zip(*rows)) or [[], [], [], [], []]
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(g, t) for g, t in zip(got, types)], ["host", "path", "kind", "value", "copy"])

    return pages.select("url", F.col("html").cast("binary").alias("html")).mapInArrow(run, "host string, path long, kind int, value long, copy long").distinct()


def site_trees(pages: DataFrame, names: bool = True) -> DataFrame:
    """host, low and good (paths of branches judged so), own and usual (paths of the main branch of the host and of all hosts).

    Copies count once, so importance is about the host's distinct articles.
    Rows are made distinct and summed before they are shuffled; a large host is no group anywhere.
    """

    counts = common.cut(pages.sparkSession, cells(pages, names).groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("c")), "counts")
    likely = F.element_at(F.create_map(*[F.lit(x) for pair in LIKELY.items() for x in pair]), F.col("declared").cast("int"))
    every = importance(counts.groupBy("path", "kind", "value").agg(F.sum("c").alias("c")), "path").withColumn("value", weighed(likely))
    every = common.cut(pages.sparkSession, every, "every")
    top = F.broadcast(every.agg(F.greatest(F.max("value"), F.lit(SURE)).alias("best"), F.max("texts").alias("most")))
    usual = F.broadcast(every.join(top).withColumn("share", F.col("value") / F.col("best")).agg(_main().alias("usual")))
    own = importance(counts, "host", "path").join(every.select("path", F.col("value").alias("anywhere")), "path").withColumn("value", weighed(F.col("anywhere")))
    best = own.groupBy("host").agg(F.greatest(F.max("value"), F.lit(SURE)).alias("best"), F.max("texts").alias("most"))
    rows = own.join(best, "host").withColumn("share", F.col("value") / F.col("best"))
    paths = lambda which: F.collect_set(F.when(which, F.col("path")))
    trees = rows.groupBy("host").agg(paths(F.col("share") < LOW).alias("low"), paths(F.col("share") >= GOOD).alias("good"), _main().alias("own"))
    return trees.join(usual).select("host", "low", "good", "own", "usual")


def _main() -> Column:
    """The deepest of the important branches that hold half as many texts as the fullest."""
    return F.max(F.when((F.col("share") >= GOOD) & (F.col("value") >= SURE) & (2 * F.col("texts") >= F.col("most")), F.struct("depth", "texts", "path")))["path"]


def extract(spark: SparkSession, pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages`` (page_id, url, html; more columns are not read).

    names: whether names of classes, ids and roles, and article and main elements, are a prior.

    Null or empty html has empty text. A page whose url names no host is merged with the others of that kind. Repeated rows
    and rows with null page_id have a row each. No rows: no rows.
    """
    common.bounded_batches(spark)
    trees = common.cut(spark, site_trees(pages, names), "trees").withColumnRenamed("host", "of")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, trees = [], {}
            hosts = b.column(7).to_pylist()
            for k, raw in enumerate(b.column(2).to_pylist()):
                if raw and hosts[k] not in trees:
                    low, good, own, usual = (b.column(c)[k].as_py() for c in (3, 4, 5, 6))
                    trees[hosts[k]] = Tree(low or (), good or (), (own, usual))
                texts.append(main_text(raw.decode("utf-8", "replace"), trees[hosts[k]], names) if raw else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    host = F.coalesce(F.lower(F.nullif(F.regexp_extract("url", HOST.pattern, 1), F.lit(""))), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html"), host.alias("host"))
    return rows.join(trees, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "low", "good", "own", "usual", "host").mapInArrow(run, "page_id long, url string, text string, n_chars long")
