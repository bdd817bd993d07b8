"""Main text of web pages by wrapper induction: trees of same-host pages are aligned, what is constant there is template."""

from __future__ import annotations

import functools
import heapq
import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, arrow_rows, fresh, load

#: Trees are at most so deep (deeper elements are taken as part of the one above), templates keep so many children of a node and nodes in all.
DEPTH, KIDS, NODES = 48, 40, 400
#: Pages that a place must be seen on before its unchanging text counts as template.
SUPPORT = 5
#: Hosts that a task holds at a time, templates that one merge takes, bytes of all wrappers up to which they are broadcast.
HELD, FAN_IN, BROADCAST = 512, 16, 32 << 20
#: Share of a page's text that a box must hold to be searched further for the main one; share of link text from which a box is a menu.
MAIN, LINKED = 0.75, 0.6

# Elements of HTML by how they are laid out, and what their names, classes and roles say.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style xmp iframe noembed noframes title textarea".split())
_BLOCK = set(
    "html head body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup"
    " legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
_HIDDEN = set("audio button canvas datalist noscript object select svg template video".split())
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BOX = {"html", "body", "div", "section", "center", "table", "tbody", "tr", "td", "main", "article", "details", "fieldset"}
_NOISE_TAG = {"head", "nav", "aside", "footer", "form", "menu", "dialog", "search"}
_NOISE_WORD = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion promotions sponsor sponsored sponsors menu navbar nav navigation navi breadcrumb breadcrumbs"
    " sidebar sidebars aside rail footer foot footers masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal overlay newsletter subscribe signup login"
    " comment comments disqus respond reply replies share sharing social related recommended recommendations pagination pager widget widgets search form hidden complementary contentinfo skip".split()
)
#: Words of a class may be run together: these at either end of one say the same.
_NOISE_END = ("comment", "comments", "sidebar", "cookie", "cookies", "newsletter", "advert", "navbar", "footer", "breadcrumb", "breadcrumbs", "menubar")
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "body": ({"head"}, set()),
}
_WALLS = {"td", "th", "table", "caption"}
#: A comment, a declaration, or a tag: its slash, name, attributes. Quotes count after an equals sign only; a tag that the page ends in has no end.
_MARK = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(?:>|\Z)""", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in _RAW}
_ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_LETTERS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element that is laid out as a block. kids holds Nodes and, for each run of text between them, [text, letters in links]."""

    __slots__ = ("kind", "kids", "group")

    def __init__(self, kind: str):
        self.kind, self.kids, self.group = kind, [], None


def _kind(tag: str, attributes: str) -> str:
    """tag, or tag.class#id with digits as 0, so that numbered boxes are alike; a hidden element is marked."""
    if not attributes.strip():
        return tag
    found, more = {}, ""
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), _HUMP.sub("-", m[2] or m[3] or m[4] or "").lower())
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        more = " hidden"
    words = " ".join(found[k] for k in ("class", "id", "role", "itemprop") if found.get(k))
    return (f"{tag} {' '.join(re.sub(r'[0-9]+', '0', words).split())[:80]}" if words else tag) + more


@functools.lru_cache(1 << 12)
def is_noise(kind: str) -> bool:
    """Whether an element of this kind is no part of an article: by its tag, or a word of its class, id or role."""
    tag, _, words = kind.partition(" ")
    if tag in _NOISE_TAG:
        return True
    if not words or tag in ("html", "body"):
        return False
    return any(w in _NOISE_WORD or w.startswith(_NOISE_END) or w.endswith(_NOISE_END) for w in _LETTERS.findall(words))


def is_header(kind: str) -> bool:
    tag, _, words = kind.partition(" ")
    return tag == "header" or "header" in _LETTERS.findall(words)


def is_article(kind: str) -> bool:
    tag, _, words = kind.partition(" ")
    return tag in ("article", "main") or bool(words) and bool({"articlebody", "main"} & set(words.split()))


def parse(page: str) -> Node:
    """The tree of a page's blocks. Unclosed and misplaced tags are mended much as browsers do; text in scripts, styles, buttons and the like
    is left out; inline markup is dissolved into its block's text. A tag or comment that the page breaks off in is no text; an attribute's
    quote that is never closed ends with its tag."""
    root = Node("html")
    stack: list[tuple[str, Node]] = [("html", root)]
    texts: list[str] = []
    linked, link_at = 0, 0  # letters in links of the run; depth at which a link is open, 0 for none
    skip, nested = "", 0  # an inline element that is left out, and how often it is open

    def end_run() -> None:
        nonlocal linked
        if texts:
            if text := " ".join("".join(texts).split()):
                stack[-1][1].kids.append([text, min(linked, len(text))])
            texts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal link_at, skip
        end_run()
        del stack[depth:]
        if link_at > len(stack):
            link_at = 0
        skip = ""

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not skip:
            piece = html.unescape(piece) if "&" in piece else piece
            texts.append(piece)
            if link_at:
                linked += len(" ".join(piece.split()))

    at, size = 0, len(page)
    while at < size:
        m = _MARK.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in _BLOCK:
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag or tag in _HEADING and stack[depth][0] in _HEADING:
                        if tag not in ("html", "body"):
                            pop_to(depth)
                        break
                    if stack[depth][0] in _WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", *_WALLS):
                        break
                if tag == "p":
                    end_run()
                continue
            if tag == "html" or tag == "body" and any(t == "body" for t, _ in stack):
                continue
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in _WALLS:
                    break
            if tag in _HEADING and stack[-1][0] in _HEADING:
                pop_to(len(stack) - 1)
            ended, walls = _CLOSED_BY.get(tag, ((), ()))
            for depth in range(len(stack) - 1, 0, -1) if ended else ():
                if stack[depth][0] in ended:
                    pop_to(depth)
                    break
                if stack[depth][0] in walls:
                    break
            if stack[-1][0] == "head" and tag != "head":
                pop_to(len(stack) - 1)
            end_run()
            skip = ""
            if len(stack) > DEPTH:
                stack.append((tag, stack[-1][1]))
            else:
                node = Node(_kind(tag, m[3]))
                stack[-1][1].kids.append(node)
                stack.append((tag, node))
            continue
        if skip:
            if tag == skip and not m[3].rstrip().endswith("/"):
                nested += -1 if closing else 1
                if not nested:
                    skip = ""
            continue
        if tag in ("br", "hr"):
            if tag == "hr":
                end_run()
            else:
                texts.append(" ")
        elif closing:
            if tag == "a":
                link_at = 0
        elif tag not in _VOID and not (m[3].rstrip().endswith("/") and tag in _HIDDEN):
            if tag in _HIDDEN or m[3].strip() and is_noise(_kind(tag, m[3])):
                skip, nested = tag, 1
            elif tag == "a":
                link_at = len(stack)
    end_run()
    return root


class Place:
    """A node of a template: pages that have it, their text's hash while it has not varied (0: none yet, None: it varies), letters and letters in links."""

    __slots__ = ("kind", "pages", "same", "chars", "links", "kids", "size")

    def __init__(self, kind, pages=1, same=0, chars=0, links=0, kids=None):
        self.kind, self.pages, self.same, self.chars, self.links, self.kids = kind, pages, same, chars, links, kids or []
        self.size = 1 + sum(k.size for k in self.kids)

    def dump(self):
        return [self.kind, self.pages, self.same, self.chars, self.links, [k.dump() for k in self.kids]]

    @staticmethod
    def load(x) -> Place:
        return Place(x[0], x[1], x[2], x[3], x[4], [Place.load(k) for k in x[5]])


def tree_match(a: Place, b: Place, known: dict) -> int:
    """Simple tree matching: nodes of the largest common top-down tree that keeps the order of children."""
    if a.kind != b.kind:
        return 0
    if not a.kids or not b.kids:
        return 1
    if (key := (id(a), id(b))) not in known:
        known[key] = 1 + _table(a.kids, b.kids, known)[-1][-1]
    return known[key]


def _table(a: list[Place], b: list[Place], known: dict) -> list[list[int]]:
    """best[i][j]: the most nodes that the first i trees of a and the first j of b have in common, in order."""
    best = [[0] * (len(b) + 1)]
    for x in a:
        above, row = best[-1], [0]
        for j, y in enumerate(b):
            m = max(above[j + 1], row[j])
            if x.kind == y.kind:
                m = max(m, above[j] + tree_match(x, y, known))
            row.append(m)
        best.append(row)
    return best


def align(a: list[Place], b: list[Place], known: dict) -> Iterator[tuple[Place | None, Place | None]]:
    """Pairs of matched trees, and trees without a partner, in an order that keeps both."""
    if len(a) == len(b) and all(x.kind == y.kind for x, y in zip(a, b, strict=True)):
        return zip(a, b, strict=True)
    best, i, j, out = _table(a, b, known), len(a), len(b), []
    while i or j:
        if i and best[i][j] == best[i - 1][j]:
            i -= 1
            out.append((a[i], None))
        elif j and best[i][j] == best[i][j - 1]:
            j -= 1
            out.append((None, b[j]))
        else:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
    return reversed(out)


def merge(a: Place, b: Place, known: dict | None = None, same_page: bool = False) -> Place:
    """The template of both trees' pages. same_page: both are of one page (repeated siblings), whose texts go together."""
    known = {} if known is None else known
    kids: list[Place] = []
    for x, y in align(a.kids, b.kids, known):
        kids.append(merge(x, y, known, same_page) if x and y else x or y)
    if same_page:
        pages, same = max(a.pages, b.pages), zlib.crc32(f"{a.same},{b.same}".encode()) if a.same or b.same else 0
    else:
        pages, same = a.pages + b.pages, b.same if a.same == 0 else a.same if b.same in (0, a.same) else None
    return Place(a.kind, pages, same, a.chars + b.chars, a.links + b.links, kids)


def prune(place: Place) -> Place:
    """At most KIDS children a node and NODES nodes; those on the fewest pages go. A page's nodes without a place are judged by their kind alone."""
    if place.size <= NODES and len(place.kids) <= KIDS and all(k.size <= KIDS for k in place.kids):
        return place
    left, waiting, kept = NODES, [(-place.pages, 0, place)], set()
    count = 0
    while waiting and left:
        _, _, p = heapq.heappop(waiting)
        kept.add(id(p))
        left -= 1
        for k in sorted(p.kids, key=lambda k: -k.pages)[:KIDS]:
            count += 1
            heapq.heappush(waiting, (-k.pages, count, k))

    def cut(p: Place) -> Place:
        return Place(p.kind, p.pages, p.same, p.chars, p.links, [cut(k) for k in p.kids if id(k) in kept])

    return cut(place)


def fold(node: Node) -> Place:
    """A page's own template: neighbours of one kind are one place. Each node remembers its place."""
    text, links, kids, groups = [], 0, [], []
    for kid in node.kids:
        if isinstance(kid, Node):
            place = fold(kid)
            if groups and kids[-1].kind == place.kind:
                groups[-1].append(kid)
                kids[-1] = merge(kids[-1], place, None, True)
            else:
                kids.append(place)
                groups.append([kid])
        else:
            text.append(kid[0])
            links += kid[1]
    for place, group in zip(kids, groups, strict=True):
        for kid in group:
            kid.group = place
    joined = " ".join(text)
    return Place(node.kind, 1, zlib.crc32(joined.encode()) or 1 if joined else 0, len(joined), links, kids)


def _left_out(template: Place) -> set[int]:
    """Places that are no part of an article by what they are. A box that is so by its words only, and yet holds an article, is none (its words name what it
    has beside it); where there is no article element, headers at the top of the page are."""
    out: set[int] = set()

    def walk(p: Place) -> bool:
        inner = [walk(k) for k in p.kids]
        noise = is_noise(p.kind)
        found = any(inner) or not noise and is_article(p.kind)
        if noise and not (any(inner) and p.kind.partition(" ")[0] not in _NOISE_TAG):
            out.add(id(p))
            return False
        return found

    if not walk(template):
        out |= {id(k) for top in (template, *(k for k in template.kids if k.kind.partition(" ")[0] == "body")) for k in top.kids if is_header(k.kind)}
    return out


def _weights(place: Place, constants: bool, out: dict, none: set[int]) -> tuple[int, int]:
    """Letters, and letters in links, of what may be content below each place."""
    if id(place) in none:
        out[id(place)] = (0, 0)
        return 0, 0
    chars, links = (0, 0) if constants and _constant(place) else (place.chars, place.links)
    for k in place.kids:
        c, n = _weights(k, constants, out, none)
        chars, links = chars + c, links + n
    out[id(place)] = (chars, links)
    return chars, links


def _constant(place: Place) -> bool:
    return place.pages >= SUPPORT and bool(place.same)


def decide(template: Place) -> list:
    """The wrapper: [kind, rule, kids], rule being '+' content, '*' content but for elements whose text is links, '-' none of it, '=' only what is below,
    'c' constant text inside content.

    Varying text inside an article or main element is content; without one, that of the smallest box with MAIN of the varying text, and
    headings beside it, menus by their share of links left out. Where nothing varies, constant text is all there is and counts."""
    weights: dict[int, tuple[int, int]] = {}
    constants = True
    none = _left_out(template)
    if not _weights(template, True, weights, none)[0]:
        constants = False
        _weights(template, False, weights, none)
    marked: list[Place] = []

    def articles(p: Place) -> None:
        if id(p) in none or not weights[id(p)][0]:
            return
        if is_article(p.kind):
            inner = len(marked)
            for k in p.kids:
                if p.kind.startswith("main"):
                    articles(k)
            if len(marked) == inner:
                marked.append(p)
            return
        for k in p.kids:
            articles(k)

    articles(template)
    explicit, regions = bool(marked), {id(p) for p in marked}
    if not explicit:
        p = template
        while p.chars < weights[id(p)][0] * (1 - MAIN):
            best = max(p.kids, key=lambda k: weights[id(k)][0], default=None)
            if best is None or best.kind.partition(" ")[0] not in _BOX or weights[id(best)][0] < MAIN * weights[id(p)][0]:
                break
            regions |= {id(k) for k in p.kids if k is not best and k.kind.partition(" ")[0] in _HEADING}
            p = best
        regions.add(id(p))

    def rule(p: Place, inside: bool) -> list:
        inside |= id(p) in regions
        chars, links = weights[id(p)]
        if id(p) in none or not explicit and inside and id(p) not in regions and chars and links > LINKED * chars:
            return [p.kind, "-", []]
        mark = "=" if not inside else "c" if constants and _constant(p) else "+" if explicit else "*"
        return [p.kind, mark, [rule(k, inside) for k in p.kids]]

    return rule(template, False)


class _Rule:
    """A wrapper's node as the matching needs it."""

    __slots__ = ("kind", "mark", "kids")

    def __init__(self, x):
        self.kind, self.mark, self.kids = x[0], x[1], [_Rule(k) for k in x[2]]


def blocks(root: Node, wrapper: list | None) -> list[str]:
    """Texts of the page's content blocks in page order: the page's tree is matched with the wrapper, nodes without a partner follow
    the node above them and their own kind. Without a wrapper the page is judged by itself."""
    folded = fold(root)
    rules = _Rule(wrapper or decide(folded))
    marks: dict[int, str] = {}
    known: dict = {}

    def spread(p: Place, mark: str) -> None:
        marks[id(p)] = mark = "-" if is_noise(p.kind) else "+" if is_article(p.kind) else mark
        for k in p.kids if mark != "-" else ():
            spread(k, mark)

    def match(p: Place, r: _Rule) -> None:
        marks[id(p)] = r.mark
        for x, y in align(p.kids, r.kids, known) if r.mark != "-" else ():
            if x and y:
                match(x, y)
            elif x:
                spread(x, "+" if r.mark == "c" else r.mark)

    match(folded, rules)
    out: list[str] = []
    todo: list = [(root, marks[id(folded)])]
    while todo:
        node, mark = todo.pop()
        if isinstance(node, list):
            if mark == "+":
                out.append(node[0])
        elif mark != "-":
            own = "+" if mark in "+*" and not (mark == "*" and _is_menu(node)) else "="
            for kid in reversed(node.kids):
                todo.append((kid, own if isinstance(kid, list) else marks.get(id(kid.group), mark)))
    return out


def _is_menu(node: Node) -> bool:
    runs = [k for k in node.kids if isinstance(k, list)]
    return sum(k[1] for k in runs) > LINKED * sum(len(k[0]) for k in runs)


def extract(page: str | None, wrapper: list | None) -> str:
    """Main text: content blocks joined by line feeds. Where the host's wrapper finds nothing on a page, the page is judged by itself."""
    root = parse(page or "")
    found = blocks(root, wrapper)
    return "\n".join(found if found or wrapper is None else blocks(root, None))


def host_of(url: Column) -> Column:
    """The host of a url in lower case; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


PARTIAL = "host string, part long, template string"
_PARTIAL = pa.schema([("host", pa.string()), ("part", pa.int64()), ("template", pa.string())])


def partial_templates(pages: DataFrame) -> DataFrame:
    """PARTIAL: each task's template of each host, from (host, html); bounded by NODES a host and HELD hosts at a time (the rarest go out early)."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def out(hosts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": hosts, "part": [part] * len(hosts), "template": [json.dumps(held.pop(h).dump()) for h in hosts]}, _PARTIAL)

        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                host, tree = host.as_py(), fold(parse(page.as_py() or ""))
                held[host] = prune(merge(held[host], tree)) if host in held else prune(tree)
            if len(held) > HELD:
                yield out(sorted(held, key=lambda h: held[h].pages)[: len(held) - HELD // 2])
        if held:
            yield out(list(held))

    return pages.select("host", "html").mapInArrow(induce, PARTIAL)


def merged_templates(partial: DataFrame, ws: Workspace) -> DataFrame:
    """(host, wrapper): templates of a host are merged FAN_IN tasks at a time until one is left, which is decided on."""

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["part"].to_pylist(), table["template"].to_pylist(), strict=True))
        whole = Place.load(json.loads(rows[0][1]))
        for _, template in rows[1:]:
            whole = prune(merge(whole, Place.load(json.loads(template))))
        return pa.table({"host": [table["host"][0].as_py()], "part": [rows[0][0] // FAN_IN], "template": [json.dumps(whole.dump())]}, _PARTIAL)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrappers = [json.dumps(decide(Place.load(json.loads(t)))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wrappers, pa.string())], ["host", "wrapper"])

    parts, level = (partial.agg(F.max("part")).first()[0] or 0) + 1, 0
    while True:
        group = F.floor(F.col("part") / FAN_IN).cast("long")
        partial = ws.stage(partial.groupBy("host", group.alias("group")).applyInArrow(join, PARTIAL), f"templates-{level}")
        parts, level = -(-parts // FAN_IN), level + 1
        if parts <= 1:
            return ws.stage(partial.where(F.col("host") != "").select("host", "template").mapInArrow(wrap, "host string, wrapper string"), "wrappers")


EXTRACTED = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, batch_rows: int = 256) -> DataFrame:
    """EXTRACTED: the main text of each row of pages (page_id, url, html).

    A null html is empty and gives an empty text; pages without a host are judged by themselves. Copies of a page do not make its text a template
    as long as other pages of the host differ there, or nothing on the host varies. Equal rows give equal rows, null identifiers and urls stay null,
    other columns are ignored. Very long pages are parsed whole; deep nesting is flattened, no text is cut. No pages give no rows."""
    ws = Workspace(pages.sparkSession, "wrappers")
    source = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    with arrow_rows(pages.sparkSession, batch_rows):
        wrappers = merged_templates(ws.stage(partial_templates(source), "partial"), ws)
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    joined = source.join(F.broadcast(wrappers) if size <= BROADCAST else wrappers, "host", "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2), batch.column(3), strict=True):
                if (key := wrapper.as_py()) is not None and key not in known:
                    if len(known) >= HELD:
                        known.clear()
                    known[key] = json.loads(key)
                texts.append(extract(page.as_py(), known.get(key)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    with arrow_rows(pages.sparkSession, batch_rows):
        return ws.stage(joined.select(F.col("page_id").cast("long"), "url", "html", "wrapper").mapInArrow(apply, EXTRACTED), "texts")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(load(spark, sf_dir, "pages"))
