"""Main text of web pages by wrapper induction.

Pages are parsed to trees. Trees of one host, summarised (runs of equal siblings
as one node, texts as hashes and lengths), are aligned in neighbouring pairs by
simple tree matching: matched nodes with equal text are template, those with
other text are slots. The container with most slot text is the host's wrapper,
where elements marked as article or main part go before others, and leaves with
the same text at the same place in all pairs are its template. On each page the
wrapper tells where the article stands (the whole of a marked element around that
place), and template leaves go. Only pages that their host's wrapper does not
fit, or whose host has no two different pages to align, go by marks alone, and by
the densest container without any.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originlake.llm.text import cut, drop

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|[!?][^>]*(?:>|\Z))""", re.S
)
_CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript xmp iframe noembed noframes".split())
#: Elements that are never part of an article's text.
OUTSIDE = set(
    "head nav footer aside form script style title textarea noscript iframe button select option dialog template svg menu".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
#: Elements that a class, id or role may tell to stand beside the article; headings and paragraphs never do.
BOXES = set("div section ul ol dl table details figure center fieldset".split())
HEADS = set("html body h1 h2 h3 h4 h5 h6".split())
#: Classes, ids and roles, as whole tokens, that tell so of anything but headings; and of the elements above only.
ADVERTS = set("ad ads advert adverts advertisement advertising ad-box ad-slot ad-banner sponsored sponsored-content cookie-notice cookie-banner cookie-consent".split())
BESIDE = set(
    "ad ads advert adverts advertisement advertising ad-box ad-container ad-slot ad-banner banner sponsor sponsored sponsored-content"
    " promo promotion cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent consent gdpr notice notices site-notice alert"
    " sidebar side-bar left-sidebar right-sidebar menu menubar main-menu nav navbar nav-bar main-nav navigation breadcrumb breadcrumbs"
    " header masthead page-header site-header banner-header footer page-footer site-footer article-footer"
    " comment comments comment-list comments-area comment-section user-comments reader-comments respond discussion disqus_thread"
    " share sharing share-buttons share-bar social social-share social-buttons social-links related related-posts related-articles"
    " related-links related-content more-articles newsletter newsletter-signup subscribe subscription signup sign-up login popup modal"
    " pagination pager search search-form search-box".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Levels of a tree; what is nested deeper counts as content of the element at that level, its blocks still apart.
DEPTH = 256
#: Pairs of nodes that tree matching may look at for two lists of children; beyond, equal ones are paired first, then
#: those of a kind in order. This steers the choice of wrapper and template only.
CELLS = 100_000
#: Aligned pairs of pages, at least, before text that is the same on all counts as template.
PAIRS = 4
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
#: Pages of one alignment group at most, about.
GROUP = 64
#: Largest size at which a row for each host is broadcast; beyond, they are joined.
BROADCAST_BYTES = 32 << 20


class Node:
    __slots__ = ("tag", "key", "kids", "outside", "main")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids = tag, []
        names, tokens, self.main = [], set(), tag in ("article", "main")
        if attrs and "=" in attrs:
            for m in _CLASS.finditer(attrs):
                value = (m[2] or m[3] or m[4] or "").lower()
                names += _WORDS.findall(value)
                tokens.update(value.split())
                self.main |= m[1].lower() == "role" and value == "main"
        self.key = ".".join([tag, *sorted(set(names))[:4]]) + "!" * self.main
        beside = not self.main and (tag in BOXES and not BESIDE.isdisjoint(tokens) or tag not in HEADS and not ADVERTS.isdisjoint(tokens))
        self.outside = tag in OUTSIDE or beside or (tag == "header")


def parse(text: str) -> Node:
    """A tree of a page as browsers would read it, near enough: implied ends, unclosed elements, raw text.

    Linear in the page: end tags of which none is open are known by counts.
    """
    root = Node("#root")
    stack, solid = [root], [0]  # open elements, and where those that are no inline ones stand
    count: Counter[str] = Counter()
    at = 0

    def close(k: int) -> None:
        for i in range(len(stack) - 1, k - 1, -1):
            n = stack[i]
            count[n.tag] -= 1
            if n.kids is stack[i - 1].kids and n.tag not in INLINE:  # too deep for a level of its own
                n.kids.append(Node("#end"))
        del stack[k:]
        while solid[-1] >= k:
            solid.pop()

    while True:
        m = _TAG.search(text, at)
        piece = text[at : m.start() if m else len(text)]
        if piece:
            stack[-1].kids.append(piece)
        if not m:
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if count[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag not in INLINE and solid[-1] and (stack[solid[-1]].tag == "p" or stack[solid[-1]].tag in CLOSES.get(tag, ())):
            close(solid[-1])
        node = Node(tag, m[3])
        if len(stack) >= DEPTH and not node.outside and tag not in RAW and tag not in VOID:
            node.kids = stack[-1].kids
            if tag not in INLINE:
                node.kids.append(Node("#end"))
        else:
            stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(text, at)
            node.kids.append(text[at : end.start() if end else len(text)])
            over = text.find(">", end.end()) if end else -1
            at = over + 1 if over >= 0 else len(text)
            continue
        if tag not in INLINE:
            solid.append(len(stack))
        stack.append(node)
        count[tag] += 1


def blocks(node: Node, inside: bool = False) -> list[str]:
    """Texts of a subtree's blocks in page order: references decoded, white space as one space, parts beside it left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := " ".join(entities.unescape("".join(line)).split()):
                out.append(text)
            line.clear()

    def walk(n: Node) -> None:
        for kid in n.kids:
            if isinstance(kid, str):
                line.append(kid)
            elif kid.tag == "br":
                line.append(" ")
            elif kid.outside and not (kid.tag == "header" and kid.key == "header" and inside):
                flush() if kid.tag not in INLINE else None
            elif kid.tag in INLINE:
                walk(kid)
            else:
                flush()
                walk(kid)
                flush()

    walk(node)
    flush()
    return out


def _mass(node: Node) -> int:
    return sum(len(k.strip()) if isinstance(k, str) else 0 if k.outside else _mass(k) for k in node.kids)


def _marked(node: Node) -> Node | None:
    """The largest element that is marked as the article or main part, the innermost of nested ones."""
    best, size = None, -1
    todo = [node]
    while todo:
        n = todo.pop()
        for k in n.kids:
            if not isinstance(k, str) and not k.outside:
                todo.append(k)
        if n.main:
            m = _mass(n) * 2 + (n.tag == "article")
            if m > size or m == size:
                best, size = n, m
    if best is not None and best.tag != "article":
        inner = [k for k in _inner(best) if k.tag == "article"]
        if inner:
            return max(inner, key=_mass)
    return best


def _inner(node: Node) -> Iterator[Node]:
    for k in node.kids:
        if not isinstance(k, str) and not k.outside:
            yield k
            yield from _inner(k)


def _said(node: Node) -> tuple[str, list[Node]]:
    """An element's own text, that of inline ones in it included, and the blocks in it."""
    text, kids = [], []
    todo = [iter(node.kids)]
    while todo:
        for k in todo[-1]:
            if isinstance(k, str):
                if k.strip():
                    text.append(k.strip())
            elif not k.outside:
                if k.tag in INLINE:
                    todo.append(iter(k.kids))
                    break
                if k.tag != "#end":
                    kids.append(k)
        else:
            todo.pop()
    return " ".join(text), kids


def _mark(text: str) -> int:
    return zlib.crc32(" ".join(text.split()).encode("utf-8", "replace"))


def summary(node: Node) -> list:
    """[key, text hash, text length, children, leaf hashes]: inline text folded in, runs of equal leaves as one."""
    own, blocks_in = _said(node)
    kids: list[list] = []
    for k in blocks_in:
        s = summary(k)
        if kids and not s[3] and not kids[-1][3] and kids[-1][0] == s[0]:
            last = kids[-1]
            last[1], last[2] = zlib.crc32(str(s[1]).encode(), last[1]), last[2] + s[2]
            last[4] += s[4]
        else:
            kids.append(s)
    return [node.key, _mark(own), len(own), kids, [] if kids or not own else [_mark(own)]]


def leaves(node: Node, path: str | None = None) -> Iterator[tuple[str, int, Node]]:
    """(path, hash, element) of the elements with text and no blocks in them, as ``summary`` has them."""
    path = path or node.key
    own, kids = _said(node)
    if own and not kids:
        yield path, _mark(own), node
    for k in kids:
        yield from leaves(k, f"{path}/{k.key}")


def _whole(t: list) -> int:
    """Hash of a summarised tree."""
    return zlib.crc32(repr((t[0], t[1], t[2], [_whole(k) for k in t[3]])).encode())


def _rising(places: list[int]) -> list[int]:
    """Indexes of a longest rising run among the places."""
    ends: list[int] = []  # by length, the index that ends the lowest run
    low: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(low, p)
        before[i] = ends[k - 1] if k else -1
        low[k : k + 1], ends[k : k + 1] = [p], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _paired(x: list[list], y: list[list]) -> list[tuple[list, list]]:
    """Order-keeping pairs of two long lists of children: subtrees that stand once in each, and between them equal keys."""
    hx, hy = [_whole(k) for k in x], [_whole(k) for k in y]
    nx, ny = Counter(hx), Counter(hy)
    place = {h: j for j, h in enumerate(hy) if ny[h] == 1}
    both = [(a, place[h]) for a, h in enumerate(hx) if nx[h] == 1 and h in place]
    out, i, j = [], 0, 0
    for a, b in [*(both[k] for k in _rising([b for _, b in both])), (len(x), len(y))]:
        while i < a and j < b:
            if x[i][0] == y[j][0]:
                out.append((x[i], y[j]))
                i, j = i + 1, j + 1
            elif a - i > b - j:
                i += 1
            else:
                j += 1
        if a < len(x):
            out.append((x[a], y[b]))
        i, j = a + 1, b + 1
    return out


def _nodes(trees: list[list]) -> int:
    return sum(1 + _nodes(t[3]) for t in trees)


def match(a: list, b: list) -> tuple[int, list[tuple[list, list]]]:
    """Simple tree matching: size of the largest order-keeping match of two trees with equal roots, and its pairs.

    Equal children at both ends of the lists are matched to each other first, which loses nothing of the size.
    """
    if a[0] != b[0]:
        return 0, []
    x, y = a[3], b[3]
    size, found = 1, [(a, b)]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    for k, l in [*zip(x[:head], y[:head], strict=True), *zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]:
        w, pairs = match(k, l) if k[3] else (1, [(k, l)])
        size, found = size + w, found + pairs
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if _nodes(x) * _nodes(y) > CELLS:
        for k, l in _paired(x, y):
            w, pairs = match(k, l)
            size += w
            found += pairs
        return size, found
    best: list[list[tuple[int, tuple]]] = [[(0, ())] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            top = max(best[i - 1][j], best[i][j - 1], key=lambda t: t[0])
            w, pairs = match(x[i - 1], y[j - 1])
            if w and best[i - 1][j - 1][0] + w > top[0]:
                top = (best[i - 1][j - 1][0] + w, (best[i - 1][j - 1], pairs))
            best[i][j] = top
    more = best[-1][-1][1]
    while more:
        found += more[1]
        more = more[0][1]
    return size + best[-1][-1][0], found


def _varying(root: list, same: dict[int, list]) -> dict[str, list[int]]:
    """By path, the chain of elements from the root (as their ids) that hold all elements there with text of this page.

    Text of a page is what has no equal counterpart in ``same``.
    """
    out: dict[str, list[int]] = {}

    def walk(n: list, path: str, chain: list[int]) -> bool:
        other = same.get(id(n))
        mine = other is None or (n[1], n[2]) != (other[1], other[2])
        found = n[2] > 0 and mine
        chain = [*chain, id(n)]
        for k in n[3]:
            found |= walk(k, f"{path}/{k[0]}", chain)
        if found:
            had = out.get(path, chain)
            out[path] = [x for x, y in zip(had, chain, strict=False) if x == y]
        return found

    walk(root, root[0], [])
    return out


def holders(a: list, b: list, pairs: list[tuple[list, list]]) -> dict[str, str]:
    """For paths at which several elements of one page hold text of that page: the path of their lowest common container."""
    out: dict[str, str] = {}
    for root, same in ((a, {id(x): y for x, y in pairs}), (b, {id(y): x for x, y in pairs})):
        for path, chain in _varying(root, same).items():
            steps = path.split("/")
            if len(chain) < len(steps):
                out[path] = min(out.get(path, path), "/".join(steps[: len(chain)]), key=len)
    return out


def slots(a: list, b: list, pairs: list[tuple[list, list]] | None = None) -> dict[str, int]:
    """Slot text of each container: what matched children hold where their texts differ, by the container's path."""
    out: dict[str, int] = {}
    paths = {id(a): a[0]}
    pairs = match(a, b)[1] if pairs is None else pairs
    same = {id(x): y for x, y in pairs}

    def walk(n: list) -> None:
        for k in n[3]:
            paths[id(k)] = f"{paths[id(n)]}/{k[0]}"
            other = same.get(id(k))
            if other is not None and (k[1], k[2]) != (other[1], other[2]):
                out[paths[id(n)]] = out.get(paths[id(n)], 0) + k[2] + other[2]
            walk(k)

    walk(a)
    return out


def constants(a: list, pairs: list[tuple[list, list]]) -> set[tuple[str, int]]:
    """(path, hash) of leaves that both of two aligned trees have at matched places."""
    same = {id(x): y for x, y in pairs}
    out = set()
    todo = [(a, a[0])]
    while todo:
        n, path = todo.pop()
        if id(n) in same:
            out |= {(path, h) for h in set(n[4]) & set(same[id(n)][4])}
        todo += [(k, f"{path}/{k[0]}") for k in n[3]]
    return out


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' trees in short."""
    for b in batches:
        trees = [json.dumps(summary(parse(text.as_py() or "")), separators=(",", ":")).encode() for text in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("salt"), pa.array(trees, pa.binary())], names=["host", "salt", "tree"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted trees to what each group tells by host and path, each page with the one before it, if their texts differ.

    Rows have slot text (mass), holders' depths (depth), leaves that are the same in all of the group's pairs (leaf),
    or, without a path, the number of pairs (mass).
    """
    last, alike, pairs_in = None, set(), 0
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def table(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "path", "mass", "depth", "leaf"])

    def told() -> list:
        return [(last[0], None, pairs_in, None, None), *((last[0], p, None, None, h) for p, h in sorted(alike))] if pairs_in else []

    for b in batches:
        rows = []
        for host, salt, tree in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if last is not None and last[:2] != (host, salt):
                rows += told()
                alike, pairs_in = set(), 0
            elif last is not None and last[2] != tree:
                x, y = json.loads(last[2]), json.loads(tree)
                pairs = match(x, y)[1]
                rows += [(host, p, n, None, None) for p, n in slots(x, y, pairs).items()]
                rows += [(host, p, 0, h.count("/") + 1, None) for p, h in holders(x, y, pairs).items()]
                both = constants(x, pairs)
                alike = both & alike if pairs_in else both
                pairs_in += 1
            last = (host, salt, tree)
        yield table(rows)
    yield table(told() if last is not None else [])


def _sized(hosts: DataFrame) -> DataFrame:
    """A written table with a row for each host, marked for broadcast if it is small."""
    texts = sum((F.coalesce(F.length(c), F.lit(0)) for c, t in hosts.dtypes if t == "string"), F.lit(32))
    return F.broadcast(hosts) if (hosts.agg(F.sum(texts)).first()[0] or 0) <= BROADCAST_BYTES else hosts


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper, template): for hosts with at least two different pages, the container path with most slot text.

    Paths within marked elements go before others. Where several elements at that path hold text of one page, the
    wrapper is the container of all of them. ``template``: "path hash" of leaves that are the same in all of at least
    PAIRS aligned pairs.

    ``pages`` has host, salt (a hash of the page) and html. Hosts go in groups of about GROUP pages, so no host is
    one task's; only tree summaries are shuffled.
    """
    trees = cut(pages.select("host", "salt", "html").mapInArrow(_summaries, "host string, salt bigint, tree binary"))
    n = cut(trees.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("s")))
    dealt = trees.join(_sized(n), "host").select("host", F.pmod("salt", "s").alias("part"), "tree")
    aligned = cut(
        dealt.repartition("host", "part").sortWithinPartitions("host", "part", "tree")
        .mapInArrow(_align, "host string, path string, mass bigint, depth bigint, leaf bigint")
    )
    total = aligned.where("path is not null and leaf is null").groupBy("host", "path").agg(F.sum("mass").alias("m"), F.min("depth").alias("depth"))
    best = total.where("m > 0").groupBy("host").agg(F.max(F.struct(F.col("path").contains("!").alias("marked"), "m", "path", "depth")).alias("w"))
    whole = F.when(F.col("w.depth").isNull(), F.col("w.path")).otherwise(F.expr("substring_index(w.path, '/', cast(w.depth as int))"))
    groups = aligned.where("path is null").groupBy("host").agg(F.count(F.lit(1)).alias("groups"), F.sum("mass").alias("pairs"))
    same = aligned.where("leaf is not null").groupBy("host", "path", "leaf").agg(F.count(F.lit(1)).alias("n"))
    fixed = same.join(groups.where(F.col("pairs") >= PAIRS), "host").where("n = groups").groupBy("host").agg(
        F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(" ", "path", "leaf")))).alias("template")
    )
    out = cut(best.select("host", whole.alias("wrapper")).join(fixed, "host", "left"))
    drop(trees, n, aligned)
    return out


def _at(node: Node, path: str) -> Node | None:
    """The element at a wrapper's path (with the largest text, of several), or the innermost marked one around it."""
    steps = path.split("/")
    found = [(node, None)] if steps[0] == node.key else []
    for step in steps[1:]:
        found = [(k, k if k.main else marked) for n, marked in found for k in _blocks_of(n) if k.key == step]
    if len(found) > 1:
        found = [max(found, key=lambda f: _mass(f[0]))]
    return next((marked or n for n, marked in found), None)


def _blocks_of(node: Node) -> Iterator[Node]:
    for k in node.kids:
        if isinstance(k, str) or k.outside:
            continue
        if k.tag in INLINE:
            yield from _blocks_of(k)
        else:
            yield k


def _densest(node: Node) -> Node:
    """The container whose own blocks of text hold most."""
    best, size = node, 0
    for n in [node, *_inner(node)]:
        own = sum(_mass(k) for k in _blocks_of(n) if not any(True for _ in _blocks_of(k)))
        if own > size:
            best, size = n, own
    return best


def main_text(text: str | None, wrapper: str | None = None, template: frozenset[str] = frozenset()) -> str:
    """Text of the article, which stands where ``wrapper`` (its host's) tells, checked by the page's own marks.

    Leaves of ``template`` go, unless nothing else is there.
    """
    tree = parse(text or "")
    part = _at(tree, wrapper) if wrapper is not None else None
    if part is None or not part.main:
        marked = _marked(tree)
        part = marked if marked is not None else part if part is not None else _densest(tree)
    if template and (fixed := [n for p, h, n in leaves(tree) if f"{p} {h}" in template and n is not part]):
        for n in fixed:
            n.outside = True
        if own := blocks(part, True):
            return "\n".join(own)
        for n in fixed:
            n.outside = False
    return "\n".join(blocks(part, True))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null html has an empty text; a null url counts as a host of its own; repeated rows repeat; other columns are ignored.
    Elements nested deeper than DEPTH keep their text and its blocks, as part of the element at that level.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    keyed = rows.withColumn("host", host_of(F.col("url")))
    wrappers = induce(keyed.withColumn("salt", F.xxhash64("page_id", "url")))
    keyed = keyed.join(_sized(wrappers), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = {t: frozenset(t.split("\n")) if t else frozenset() for t in set(b.column("template").to_pylist())}
            out = [main_text(h.as_py(), w.as_py(), known[t.as_py()]) for h, w, t in zip(*(b.column(c) for c in ("html", "wrapper", "template")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return keyed.select("page_id", "url", "html", "wrapper", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
