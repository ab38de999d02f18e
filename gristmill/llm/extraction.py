"""Main-text extraction by wrapper induction.

A page's tree is read into an outline: its block elements outside of the parts that HTML itself names as no content, each with its lines
(text up to the next block border). For each host a wrapper is induced from all of its pages:
1. The page of lower-quartile length gives the host's reference outline. Each page is aligned to it by simple tree matching, which names
   its lines: by the reference node that they align with, else by their label path.
2. A line that the same node has with the same text on enough of the host's pages is template; all others are slots. Pages that share
   their first or their longest line (of those that differ from the reference's) are copies and count once, so that a text found on many pages stays text.
3. On each page the lines that differ from the reference's same node are its slots; their text, without links, settles which element holds
   the content, and the host's pages vote by its length.
The counts are grouped sums over all pages; no host is gathered in one task. Every page is then read whole by its host's wrapper: the
lines of the content element without the template. A page in which the wrapper's element is missing, or a host of one page, gets the same
choice from its own slots.

Reference outlines and wrappers are broadcast if their bytes allow it (summed first), else joined by host, with salts for hosts that hold many pages.

Defined cases: null or empty html gives an empty text; broken html is read as browsers do, missing end tags are supplied and an
unfinished tag ends the page; a null url is a host of its own; repeated rows give their texts each; a page without any content element
gives its body's text; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Generator, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut, join_left, small_batches

#: A line is template if at least so many pages, and this share of the host's pages, have it.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.6
#: The same inside of an element that HTML names as the article, where a common passage may stand on many pages.
INSIDE_PAGES, INSIDE_SHARE = 10, 0.9
#: An element holds the content if it has this share of the slots' text; one that HTML names as the article, if it has this one.
CONTENT_SHARE, NAMED_SHARE = 0.8, 0.5
#: References or wrappers up to these bytes are broadcast; beyond, they are joined by host.
BROADCAST_BYTES = 8 << 20
#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body caption html legend summary tbody td tfoot th thead tr li dd dt".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = frozenset("ul ol dl table select article section div main aside nav body html blockquote form".split())
#: Elements, roles and names of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments.
ASIDE = frozenset("nav footer aside form script style noscript template iframe svg canvas button select textarea input head title menu audio video map".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert menu menubar form".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|"
    r"footer|masthead|comments?|commentlist|replies|respond|disqus)(?:$|[\s_-])",
    re.I,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:page-?|site-?)?header(?:$|[\s_-])", re.I)
#: Elements that hold lines, not content as a whole.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr dt dd pre figcaption caption blockquote".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_SPACE, _DIGITS = re.compile(r"\s+"), re.compile(r"\d{2,}")


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "children")

    def __init__(self, tag: str, names: str = "", role: str = "", hidden: bool = False):
        self.tag, self.names, self.role, self.hidden = tag, names, role, hidden
        self.children: list[Node | str] = []


class _Open:
    """The stack of open elements; where each tag was opened last is known, so that no search runs over the stack."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def close(self, tag: str, scoped: bool) -> None:
        found = self.at.get(tag)
        if not found or scoped and found[-1] < self.scopes[-1]:
            return
        upto = found[-1]
        while len(self.stack) > upto:
            gone = self.stack.pop()
            self.at[gone.tag].pop()
            if gone.tag in SCOPE:
                self.scopes.pop()


def parse(source: str) -> Node:
    """A tree of any text, whatever is missing in it, in time linear in the text."""
    root, at, n = Node("#root"), 0, len(source)
    on = _Open(root)
    while at < n:
        i = source.find("<", at)
        if i < 0:
            on.stack[-1].children.append(source[at:])
            break
        mark = source[i + 1 : i + 2]
        closing = mark == "/"
        name = _NAME.match(source, i + 1 + closing)
        if name is None and not closing and mark not in ("!", "?"):  # a sign, no tag
            on.stack[-1].children.append(source[at : i + 1])
            at = i + 1
            continue
        if i > at:
            on.stack[-1].children.append(source[at:i])
        if name is None or closing:
            ends = ("-->", 4) if source.startswith("<!--", i) else ("]]>", 9) if source.startswith("<![CDATA[", i) else (">", 1)
            end = source.find(ends[0], i + ends[1])
            at = n if end < 0 else end + len(ends[0])
            if name is not None:
                on.close(name[0].lower(), False)
            continue
        tag, rest = name[0].lower(), _REST.match(source, name.end())
        at = rest.end() + 1
        if at > n or source[at - 1] != ">":  # the page ends inside a tag
            break
        given = {a.lower(): b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(rest[0])} if rest[0] else {}
        if tag in ENDS_P:
            on.close("p", True)
        for other in CLOSED_BY.get(tag, ()):
            on.close(other, True)
        names = " ".join(x for x in (given.get("class", ""), given.get("id", "")) if x)
        node = Node(tag, names, given.get("role", "").lower(), "hidden" in given or given.get("aria-hidden", "").lower() == "true")
        on.stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_ENDS[tag].search(source, at)
            node.children.append(source[at : end.start()] if end else source[at:])
            at = end.end() if end else n
        elif tag not in VOID and not rest[0].rstrip().endswith("/"):
            on.push(node)
    return root


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("article", "main")


def is_aside(node: Node, inside_article: bool) -> bool:
    if node.tag in ASIDE or node.hidden or node.role in ASIDE_ROLES:
        return True
    if node.tag == "header":
        return not inside_article
    if not node.names or node.tag in ("html", "body", "article", "main"):
        return False
    return bool(ASIDE_NAMES.search(node.names) or not inside_article and HEADER_NAMES.search(node.names))


class Block:
    """A block element in an outline: label, hash of the labels from the top, depth, whether it is or stands in an article, and what is below."""

    __slots__ = ("label", "path", "depth", "article", "inside", "children", "shape", "size", "name", "known", "w")

    def __init__(self, label: str, above: Block | None, article: bool = False):
        self.label, self.depth, self.article = label, above.depth + 1 if above else 0, article
        self.path = hashed(str(above.path), label) if above else 0
        self.inside = article or above is not None and above.inside
        self.children: list[Block] = []
        self.shape, self.size, self.name, self.known, self.w = 0, 1, str(self.path), frozenset(), 0


def hashed(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def _sum_up(blocks: list[Block]) -> None:
    """Shapes and sizes. `blocks` come in page order."""
    for b in reversed(blocks):
        b.shape = hash((b.label, *[c.shape for c in b.children]))
        b.size += sum(c.size for c in b.children)


def outline(root: Node) -> tuple[list[Block], list[tuple[Block, str, int]]]:
    """The blocks in page order, and the lines: block, text, letters inside of links."""
    top = Block("", None)
    blocks, lines, line, linked = [top], [], [], [0]

    def flush(block: Block) -> None:
        if line:
            text = _SPACE.sub(" ", "".join(line)).strip()
            if text:
                lines.append((block, text, linked[0]))
        line.clear()
        linked[0] = 0

    # an explicit stack: trees may be deeper than Python's own
    todo: list = [(root, top, False, False, 0)]
    while todo:
        what, block, inside, link, leaving = todo.pop()
        if isinstance(what, str):
            line.append(entities.unescape(what) if "&" in what else what)
            linked[0] += len(what) if link else 0
            continue
        if leaving:
            flush(block)
            continue
        if is_aside(what, inside):
            flush(block) if what.tag in BLOCKS else line.append(" ")
            continue
        if what.tag in ("br", "hr"):
            line.append(" ")
            continue
        inside = inside or is_article(what)
        link = link or what.tag == "a"
        if what.tag in BLOCKS:
            flush(block)
            names = _DIGITS.sub("#", what.names)
            below = Block(f"{what.tag}.{names if len(names) < 80 else hashed(names)}" if names else what.tag, block, is_article(what))
            block.children.append(below)
            blocks.append(below)
            todo.append((what, below, inside, link, 1))
            block = below
        todo.extend((c, block, inside, link, 0) for c in reversed(what.children))
    flush(top)
    _sum_up(blocks)
    return blocks, lines


# Simple tree matching.


def _matching(a: Block, b: Block, found: dict) -> Generator[tuple[Block, Block], int, None]:
    """Scores the order-keeping top-down mapping of two blocks of one label; asks for the scores of children by `yield`.

    Children of equal shape at both ends are mapped to each other, which no better mapping can beat; between them a table is filled.
    """
    x, y = a.children, b.children
    i, j = 0, 0
    while i < len(x) and i < len(y) and x[i].shape == y[i].shape:
        i += 1
    while j < len(x) - i and j < len(y) - i and x[len(x) - 1 - j].shape == y[len(y) - 1 - j].shape:
        j += 1
    mapped = [(x[k], y[k]) for k in range(i)] + [(x[len(x) - k], y[len(y) - k]) for k in range(j, 0, -1)]
    score = 1 + sum(p.size for p, _ in mapped)
    x, y = x[i : len(x) - j], y[i : len(y) - j]
    if x and y:
        own: dict[tuple[int, int], int] = {}
        rows = [[0] * (len(y) + 1)]
        for p in x:
            above, row = rows[-1], [0]
            for k, q in enumerate(y, 1):
                best = above[k] if above[k] > row[k - 1] else row[k - 1]
                if p.label == q.label:
                    s = p.size if p.shape == q.shape else (yield p, q)
                    own[len(rows), k] = s
                    if above[k - 1] + s > best:
                        best = above[k - 1] + s
                row.append(best)
            rows.append(row)
        score += rows[-1][-1]
        i, j = len(x), len(y)
        while i and j:
            if (s := own.get((i, j))) and rows[i][j] == rows[i - 1][j - 1] + s:
                mapped.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    found[id(a), id(b)] = score, mapped


def match(a: Block, b: Block) -> list[tuple[Block, Block]]:
    """The greatest order-keeping top-down mapping of blocks of equal labels. Runs on a stack of its own."""
    if a.label != b.label:
        return []
    found: dict[tuple[int, int], tuple[int, list]] = {}
    running, answer = [((id(a), id(b)), _matching(a, b, found))], None
    while running:
        key, work = running[-1]
        try:
            p, q = work.send(answer)
            answer = None
            if (id(p), id(q)) in found:
                answer = found[id(p), id(q)][0]
            else:
                running.append(((id(p), id(q)), _matching(p, q, found)))
        except StopIteration:
            running.pop()
            answer = found[key][0]
    pairs, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        pairs.append((p, q))
        todo += found[id(p), id(q)][1] if (id(p), id(q)) in found else zip(p.children, q.children, strict=True)
    return pairs


def skeleton(source: str) -> str:
    """A page's blocks in page order: label, number of children, and the hashes of the lines."""
    blocks, lines = outline(parse(source))
    own: dict[int, list[int]] = {}
    for b, text, _ in lines:
        own.setdefault(id(b), []).append(hashed(text))
    return json.dumps([[b.label, len(b.children), own.get(id(b), [])] for b in blocks], ensure_ascii=False)


def from_skeleton(text: str) -> Block:
    blocks, open_ = [], []
    for i, (label, n, lines) in enumerate(json.loads(text)):
        b = Block(label, None)
        b.name, b.known = f"={i}", frozenset(lines)
        blocks.append(b)
        if open_:
            open_[-1][0].children.append(b)
            open_[-1][1] -= 1
        open_.append([b, n])
        while open_ and not open_[-1][1]:
            open_.pop()
    _sum_up(blocks)
    return blocks[0]


#: A line of a page: its block, text, weight, and the hashes of its node and text.
Line = tuple[Block, str, int, int, int]


def aligned(source: str, reference: Block | None) -> tuple[list[Block], list[Line]]:
    """A page's blocks and lines, named by the reference. A line weighs its letters; one that is mostly link weighs nothing."""
    blocks, lines = outline(parse(source))
    if reference is not None:
        for a, b in match(reference, blocks[0]):
            b.name, b.known = a.name, a.known
    return blocks, [(b, text, 0 if 2 * linked > len(text) else len(text), hashed(b.name), hashed(text)) for b, text, linked in lines]


def choose(blocks: list[Block], slots: list[Line]) -> tuple[int, int] | None:
    """Path and weight of the element that holds the content: of those that HTML names as articles the greatest, if it holds most of the slots'
    text; else the deepest that does."""
    for b in blocks:
        b.w = 0
    for b, _, w, _, _ in slots:
        b.w += w
    for b in reversed(blocks):
        b.w += sum(c.w for c in b.children)
    total, by_path = blocks[0].w, {}
    for b in blocks:
        w, *_ = by_path.get(b.path, (0,))
        by_path[b.path] = (w + b.w, b.depth, b.article, b.label.split(".")[0] in LEAVES)
    if not total:
        return None
    named = [(w, depth, path) for path, (w, depth, article, _) in by_path.items() if article and w >= NAMED_SHARE * total]
    if named:
        w, _, path = max(named)
        return path, w
    _, w, path = max((depth, w, path) for path, (w, depth, _, leaf) in by_path.items() if not leaf and w >= CONTENT_SHARE * total)
    return path, w


def extract(source: str | None, wrapper: dict | None, reference: Block | None = None) -> str:
    """wrapper: content (a path or None) and template (pairs of node and line)."""
    if not source:
        return ""
    blocks, lines = aligned(source, reference)
    slots = [x for x in lines if (x[3], x[4]) not in wrapper["template"]] if wrapper else lines
    content = wrapper["content"] if wrapper else None
    if content is None or all(b.path != content for b in blocks):
        content, _ = choose(blocks, slots) or (blocks[0].path, 0)
    held = {id(b) for b in blocks if b.path == content}
    for b in blocks:  # in page order, so what is above comes first
        if id(b) in held:
            held.update(map(id, b.children))
    return " ".join(text for b, text, *_ in slots if id(b) in held)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _host(urls: pd.Series) -> pd.Series:
    return urls.map(host_of, na_action=None)


class _Known:
    """What was read from some texts, remembered in a worker up to a bound."""

    def __init__(self, read):
        self.read, self.known = read, {}

    def of(self, text: str | None):
        if text is not None and text not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            self.known[text] = self.read(text)
        return self.known[text] if text is not None else None


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"host": batch.column("host"), "reference": [skeleton(h) for h in batch.column("html").to_pylist()]})


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its distinct lines (node, line, whether in an article), and the content's path and weight by the lines that differ from
    the reference's. first, longest: the hashes of the first and the longest of these (of all, if none differs) that is no link."""
    references = _Known(from_skeleton)
    for batch in batches:
        out = []
        for host, source, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "reference")), strict=True):
            blocks, lines = aligned(source, references.of(reference))
            if not lines:
                continue
            slots = [x for x in lines if x[4] not in x[0].known]
            own = [x for x in slots if x[2]] or lines
            same = (own[0][4], max(own, key=lambda x: len(x[1]))[4])
            out += [(host, None, None, node, line, inside, *same) for node, line, inside in dict.fromkeys((x[3], x[4], x[0].inside) for x in lines)]
            if (content := choose(blocks, slots)) is not None:
                out.append((host, *content, None, None, None, *same))
        kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["host", "path", "w", "node", "line", "inside", "first", "longest"])


def _with(rows: DataFrame, found: DataFrame, size: Column) -> DataFrame:
    """`rows` with the columns that `found` has for their host. Where these are too large to broadcast, hosts of very many pages are salted."""
    if (found.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), "host", "left")
    return join_left(rows, found, ["host"])


def references(pages: DataFrame) -> DataFrame:
    """host, reference: the skeleton of a page whose length is the host's lower quartile. pages: page_id, host, html."""
    pages = pages.where("html <> ''").withColumn("n", F.length("html"))
    sizes = cut(pages.select("host", "n", "page_id"))
    typical = sizes.groupBy("host").agg(F.percentile_approx("n", 0.25, 1000).alias("n"))
    chosen = cut(_with(sizes, typical.withColumnRenamed("n", "q"), F.length("host") + 16).where("n = q").groupBy("host", "q").agg(F.min("page_id").alias("id")))
    one = _with(pages, chosen, F.length("host") + 32).where((F.col("n") == F.col("q")) & F.col("page_id").eqNullSafe(F.col("id"))).groupBy("host").agg(F.min("html").alias("html"))
    return cut(one.mapInArrow(_skeletons, "host string, reference string"))


def wrappers(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """host, reference, content (a path), template (the hashes of node and line, in turn). pages: page_id, host, html."""
    rows = _with(pages.where("html <> ''").select("page_id", "host", "html"), refs, F.length("reference"))
    rows = cut(rows.mapInArrow(_lines, "host string, path long, w long, node long, line long, inside boolean, first long, longest long"))
    lines, copies = rows.where("line IS NOT NULL"), F.least(F.count_distinct("first"), F.count_distinct("longest")).alias("n")
    number = rows.select("host", "first", "longest").distinct().groupBy("host").agg(copies).withColumnRenamed("n", "pages")
    least = F.when(F.col("inside"), F.greatest(F.lit(INSIDE_PAGES), F.col("pages") * INSIDE_SHARE)).otherwise(F.greatest(F.lit(TEMPLATE_PAGES), F.col("pages") * TEMPLATE_SHARE))
    key = ["host", "node", "line", "inside"]
    often = lines.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= TEMPLATE_PAGES).join(number, "host").where(F.col("n") >= least).drop("n")
    often = cut(often)
    often = F.broadcast(often) if 64 * often.count() <= BROADCAST_BYTES else often
    distinct = lines.join(often, key).select(*key, "pages", "first", "longest").distinct().groupBy(*key, "pages").agg(copies).where(F.col("n") >= least)
    template = distinct.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("node", "line"))).alias("template"))
    content = rows.where("path IS NOT NULL").groupBy("host", "path").agg(F.sum("w").alias("w")).groupBy("host").agg(F.max_by("path", F.struct("w", "path")).alias("content"))
    flat = F.flatten(F.transform("template", lambda x: F.array(x["node"], x["line"])))
    return cut(refs.join(content, "host", "left").join(template, "host", "left").select("host", "reference", "content", F.coalesce(flat, F.array().cast("array<long>")).alias("template")))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of `pages` (page_id, url, html)."""
    host = F.pandas_udf(_host, "string")
    rows = small_batches(pages).select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host("url"))
    found = wrappers(rows, references(rows))
    found = found.select("host", F.to_json(F.struct("content", "template", "reference")).alias("wrapper"))
    joined = _with(rows, found, F.length("wrapper"))

    def read(text: str) -> tuple[dict, Block]:
        own = json.loads(text)
        t = own["template"]
        return {"content": own.get("content"), "template": set(zip(t[::2], t[1::2], strict=True))}, from_skeleton(own["reference"])

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = _Known(read)
        for sources, names in batches:
            yield pd.Series([extract(source, *(known.of(name) or (None, None))) for source, name in zip(sources, names, strict=True)], dtype=object)

    text = F.pandas_udf(run, "string")("html", "wrapper")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
