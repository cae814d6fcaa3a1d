"""HTML extraction by union-free wrappers, one inferred for each host.

Method.  A page is a token stream of tags and texts.  Pages of one host are
aligned into one wrapper: at each level the children of wrapper and page are
matched in order; children that one side lacks become optional, runs of like
children become one repeated group, and texts that differ become slots.  Each
task folds the pages it reads, wrapper by host; wrappers of a host then fold
into one, so a host with a third of all pages sends one wrapper a task.

The wrapper says which of its slots hold the article: those of the main
containers that it has, else those of the part with most variable text.  Parts
whose name or class marks a menu, header, footer, sidebar, notice, advert, form
or comments are left out, as are texts that stay the same on all pages outside a
main container.  Words that an article may bear too ("legal", "share") yield to
evidence: such a part stays if it holds over half of the host's variable text.
Extraction follows a page along its host's wrapper.

Defined results.  Null and empty html give the empty text; pages of any length
and depth are read whole, each character a bounded number of times.  Of parts
with equally much text the outer is taken.  Columns beyond page_id, url and html
are never read.  A null or broken
URL belongs to the host "".  A host of one page has a wrapper without evidence
of constancy; names and text size then decide.  Repeated pages count each.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Generator, Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialize

_ATTRIBUTES = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|iframe|svg|select|object)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?/][^<>]*+>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never the article's.
NOISE_TAGS = frozenset("nav header footer aside form button menu dialog title head fieldset option input".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist reply replies disqus discussion cookie cookies consent gdpr notice notices alert notification "
    "menu nav navbar navigation sidebar sidebars widget widgets related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay footer header masthead "
    "copyright legal disclaimer pagination pager toolbar sponsor sponsored sponsors promo promotion promoted skip teaser trending complementary contentinfo search searchbox".split()
)
#: Noise words that an article may bear too; they yield to the evidence of the host's text.
WEAK_WORDS = frozenset(
    "notice notices alert banner related recommended share sharing social header masthead legal disclaimer copyright promo promotion promoted sponsor sponsors skip teaser trending overlay modal popup search complementary widget widgets".split()
)
MAIN_WORDS = frozenset("main content article post entry story maincontent articlebody postcontent entrycontent articlecontent postbody".split())
#: Open elements that the start of an element ends, for those whose end tags may be left out.
_CELLS = frozenset(("td", "th"))
_GROUPS = frozenset(("thead", "tbody", "tfoot", "caption", "colgroup"))
CLOSES = {
    "li": frozenset(("li",)), "option": frozenset(("option",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "td": _CELLS, "th": _CELLS, "tr": _CELLS | {"tr", "caption", "colgroup"}, **{g: _CELLS | {"tr"} | _GROUPS for g in _GROUPS},
}


def _run(walk: Callable[..., Generator], *start):
    """Result of a walk that yields the arguments of the calls it makes; pages nest as deep as they like, so calls wait in a list."""
    waiting, got = [walk(*start)], None
    while True:
        try:
            call = waiting[-1].send(got)
        except StopIteration as done:
            waiting.pop()
            got = done.value
            if not waiting:
                return got
        else:
            waiting.append(walk(*call))
            got = None


class Node:
    """An element: its signature, its children in order and its texts among them."""

    __slots__ = ("tag", "sig", "parts", "hidden")

    def __init__(self, tag: str, sig: str, hidden: bool = False):
        self.tag, self.sig, self.hidden = tag, sig, hidden
        self.parts: list = []


def parse(html: str) -> Node:
    """The tree of a page, however its tags are left open."""
    root = Node("#", "#")
    stack, at = [root], 0
    held: dict[str, int] = {}  # open elements by tag
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1) if held.get(tag) else ():
                if stack[i].tag == tag:
                    for node in stack[i:]:
                        held[node.tag] -= 1
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # a stray closing tag does not close blocks
            continue
        attributes = m[4]
        words = sorted({w for x in _NAMES.finditer(attributes) for w in (x[2] or x[3] or x[4] or "").lower().split()}) if attributes else []
        node = Node(tag, f"{tag}.{' '.join(re.sub(r'[0-9]+', '0', w) for w in words)}" if words else tag, bool(attributes and _HIDDEN.search(attributes)))
        if tag not in INLINE and tag not in VOID:
            while stack[-1].tag in INLINE or stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ()):
                held[stack.pop().tag] -= 1  # a block ends open inline elements and paragraphs
        stack[-1].parts.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            held[tag] = held.get(tag, 0) + 1
    if at < len(html):
        stack[-1].parts.append(html[at:])
    return root


# A wrapper is [signature, optional, repeated, pages, text, fixed, children]: ``text`` is the
# largest size of the element's own text, ``fixed`` its hash while all pages agree, else None.


def _alone(node: Node) -> list:
    own = " ".join(" ".join(p for p in node.parts if isinstance(p, str)).split())
    return [node.sig, 0, 0, 1, len(own), xxhash.xxh3_64_intdigest(own) >> 1 if own else 0, []]


def _of_node(node: Node) -> list:
    stack = [(node, _alone(node), iter(node.parts))]
    while True:
        node, out, parts = stack[-1]
        for p in parts:
            if isinstance(p, Node) and (p.tag in INLINE or p.tag not in VOID):
                stack.append((p, _alone(p), iter(p.parts)))
                break
        else:
            stack.pop()
            if not stack:
                return out
            above = stack[-1][1]
            if node.tag in INLINE:
                above[4] += out[4]
                above[5] = (above[5] * 31 + out[5]) & ((1 << 62) - 1)
                for kid in out[6]:
                    _append(above[6], kid)
            else:
                _append(above[6], out)


def _append(kids: list[list], kid: list) -> None:
    """Add a child; one like the last folds into a repeated group."""
    if kids and kids[-1][0] == kid[0]:
        kids[-1] = align(kids[-1], kid, pages=kids[-1][3])
        kids[-1][2] = 1
    else:
        kids.append(kid)


def align(a: list, b: list, pages: int | None = None) -> list:
    """One wrapper for both: matched children align, others become optional."""
    return _run(_aligning, a, b, pages)


def _aligning(a: list, b: list, pages: int | None) -> Generator:
    kids: list[list] = []
    left, right = a[6], b[6]
    i = j = 0
    for x, y in [*matched([k[0] for k in left], [k[0] for k in right]), (len(left), len(right))]:
        alone = [[k[0], 1, *k[2:]] for k in (*left[i:x], *right[j:y])]
        if x < len(left):
            kid = yield left[x], right[y], None
            kid[2] = left[x][2] | right[y][2]
            alone.append(kid)
        i, j = x + 1, y + 1
        for kid in alone:
            if kids and kids[-1][0] == kid[0]:
                kid = yield kids[-1], kid, max(kids[-1][3], kid[3])
                kid[2] = 1
                kids[-1] = kid
            else:
                kids.append(kid)
    same = a[5] if a[5] == b[5] else None
    return [a[0], a[1] | b[1], a[2] | b[2], pages or a[3] + b[3], max(a[4], b[4]), same, kids]


def matched(left: list[str], right: list[str], cells: int = 1 << 20) -> list[tuple[int, int]]:
    """Places of a common subsequence: equal ends, and a longest one between them.

    Where that would take over ``cells`` comparisons, each takes the next like it.
    """
    n, m = len(left), len(right)
    head = next((i for i in range(min(n, m)) if left[i] != right[i]), min(n, m))
    tail = next((i for i in range(min(n, m) - head) if left[n - 1 - i] != right[m - 1 - i]), min(n, m) - head)
    a, b = left[head : n - tail], right[head : m - tail]
    middle: list[tuple[int, int]] = []
    if len(a) * len(b) <= cells:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)] if a and b else []
        for i in range(len(a) - 1, -1, -1) if best else ():
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while best and i < len(a) and j < len(b):
            if a[i] == b[j]:
                middle.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for i, x in enumerate(a):
            places.setdefault(x, []).append(i)
        at = 0
        for j, x in enumerate(b):
            own = places.get(x, [])
            k = bisect_left(own, at)
            if k < len(own):
                middle.append((own[k], j))
                at = own[k] + 1
    return [*((i, i) for i in range(head)), *((head + i, head + j) for i, j in middle), *((n - tail + i, m - tail + i) for i in range(tail))]


def dumps(wrapper: list) -> str:
    """The wrapper's elements in document order, each with its number of children: JSON of one level at any depth."""
    flat, stack = [], [wrapper]
    while stack:
        w = stack.pop()
        flat += [*w[:6], len(w[6])]
        stack += reversed(w[6])
    return json.dumps(flat)


def loads(text: str) -> list:
    flat, done = json.loads(text), []
    for i in range(len(flat) - 7, -1, -7):
        n = flat[i + 6]
        kids = done[len(done) - n :][::-1]
        del done[len(done) - n :]
        done.append([*flat[i : i + 6], kids])
    return done[0]


def _words(sig: str) -> tuple[str, set[str]]:
    tag, _, names = sig.partition(".")
    out = set()
    for name in names.split():
        out.add(name.replace("-", "").replace("_", ""))
        out.update(re.split(r"[-_]", name))
    return tag, out


def is_noise(sig: str) -> bool:
    tag, words = _words(sig)
    return tag in NOISE_TAGS or (bool(words & NOISE_WORDS) and tag not in ("html", "body", "article", "main"))


def yields(sig: str) -> bool:
    """Is it noise by weak words alone?"""
    tag, words = _words(sig)
    return tag not in NOISE_TAGS and words & NOISE_WORDS <= WEAK_WORDS


def is_main(sig: str) -> int:
    tag, words = _words(sig)
    return 3 if tag == "article" else 2 if tag == "main" else 1 if words & MAIN_WORDS and tag in ("div", "section", "td") else 0


#: Marks of a path.
ROOT, CONSTANT, KEPT = 1, 2, 4


def is_fixed(node: list, least_pages: int) -> bool:
    return node[5] is not None and node[3] >= least_pages and node[4] > 0


def kept_in_spite(wrapper: list, least_pages: int) -> set[int]:
    """Ids of elements with weak noise words that hold over half of the host's variable text."""
    sizes: dict[int, int] = {}

    def walk(node: list) -> Generator:
        if is_noise(node[0]) and not yields(node[0]):
            return 0
        size = 0 if is_fixed(node, least_pages) else node[4]
        for k in node[6]:
            size += yield (k,)
        if is_noise(node[0]):
            sizes[id(node)] = size
        return size

    whole = _run(walk, wrapper)
    return {i for i, size in sizes.items() if 2 * size > whole}


def article_paths(wrapper: list, least_pages: int = 3) -> list[list]:
    """Paths of the wrapper to roots of the article and to constant parts that it leaves out.

    Paths share their beginnings: an entry is [place of the path it continues
    (or -1), signature, marks].
    """
    places: dict[tuple[int, str], int] = {}
    tree: list[tuple[int, str, int]] = []
    found: dict[int, list[int]] = {}
    variable: dict[int, int] = {}
    constant: list[int] = []
    kept = kept_in_spite(wrapper, least_pages)
    marks: dict[int, int] = {}

    def place(above: int, sig: str) -> int:
        at = places.setdefault((above, sig), len(tree))
        if at == len(tree):
            tree.append((above, sig, tree[above][2] + 1 if above >= 0 else 1))
        return at

    def walk(node: list, above: int, inside: int) -> Generator:
        if is_noise(node[0]) and id(node) not in kept:
            return 0
        here = place(above, node[0])
        if id(node) in kept:
            marks[here] = KEPT
        rank = is_main(node[0])
        if rank > inside:
            found.setdefault(rank, []).append(here)
        fixed = is_fixed(node, least_pages)
        if fixed and not max(rank, inside):
            constant.append(here)
        size = 0 if fixed else node[4]
        below = 0
        for k in node[6]:
            below += yield k, here, max(rank, inside)
        paragraphs = sum(k[4] for k in node[6] if k[0].partition(".")[0] in ("p", "h1", "h2", "h3", "blockquote", "pre") and (id(k) in kept or not is_noise(k[0])))
        variable[here] = size + paragraphs
        return size + below

    _run(walk, wrapper, -1, 0)
    if found:
        roots = found[max(found)]
    else:
        for p in constant:
            marks[p] = marks.get(p, 0) | CONSTANT
        roots = [max(variable, key=lambda p: (variable[p], -tree[p][2])) if variable else place(-1, "#")]
    for p in roots:
        marks[p] = marks.get(p, 0) | ROOT
    needed: set[int] = set()
    for p in marks:
        while p >= 0 and p not in needed:
            needed.add(p)
            p = tree[p][0]
    new = {p: i for i, p in enumerate(sorted(needed))}
    return [[new.get(tree[p][0], -1), tree[p][1], marks.get(p, 0)] for p in new]


def extract(root: Node, paths: list[list]) -> str:
    """The article's text of a page, by its host's wrapper."""
    onward = {(above, sig): i for i, (above, sig, _) in enumerate(paths)}
    blocks: list[str] = []
    buffer: list[str] = []
    stack: list[tuple] = []

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                blocks.append(text)
            buffer.clear()

    def enter(node: Node, at: int, inside: bool) -> bool:
        inline = node.tag in INLINE
        if not inline:
            at = onward.get((at, node.sig), -2)  # -2: on none of the paths
        mark = paths[at][2] if at >= 0 else 0
        if node.hidden or (is_noise_cached(node.sig) and (inline or not mark & KEPT)):
            return False
        if not inline:
            flush()
        inside = inside or bool(mark & ROOT)
        stack.append((iter(node.parts), at, inside, inside and not mark & CONSTANT, inline))
        return True

    enter(root, -1, False)
    while stack:
        parts, at, inside, keep, inline = stack[-1]
        for p in parts:
            if isinstance(p, str):
                if keep:
                    buffer.append(p)
            elif p.tag in VOID:
                if p.tag in ("br", "hr"):
                    flush()
            elif enter(p, at, inside):
                break
        else:
            stack.pop()
            if not inline:
                flush()
    return " ".join(blocks)


_noise: dict[str, bool] = {}


def is_noise_cached(sig: str) -> bool:
    got = _noise.get(sig)
    if got is None:
        got = is_noise(sig)
        if len(_noise) < 100_000:
            _noise[sig] = got
    return got


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def infer_wrappers(pages: DataFrame, flush_hosts: int = 5000, groups: int = 64) -> DataFrame:
    """host, wrapper (JSON): all pages of a host, aligned."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not html:
                    continue
                host, own = host_of(url), _of_node(parse(html))
                held[host] = align(held[host], own) if host in held else own
                if len(held) >= flush_hosts:
                    yield send(held)
                    held = {}
        yield send(held)

    def send(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held = None, None
        for b in batches:
            for name, text in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                if name != host and held is not None:
                    yield send({host: held})
                    held = None
                held = loads(text) if held is None else align(held, loads(text))
                host = name
        if held is not None:
            yield send({host: held})

    shape = "host string, wrapper string"
    lean = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # a host's partial wrappers, one a task that read it, meet in groups first
    dealt = lean.mapInArrow(fold, shape).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups)))
    some = dealt.repartition("host", "group").sortWithinPartitions("host").mapInArrow(meet, shape)
    return materialize(some.repartition("host").sortWithinPartitions("host").mapInArrow(meet, shape), "wrappers")


def extract_articles(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Wrappers go to the tasks as a broadcast while all of them together have at
    most ``broadcast_bytes``; beyond that pages meet them in a join by host.
    """
    spark = pages.sparkSession
    wrappers = infer_wrappers(pages)
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    lean = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    shared = None
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r["host"]: article_paths(loads(r["wrapper"])) for r in wrappers.toLocalIterator()})
        lean = lean.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        host = F.udf(lambda u: host_of(u), "string")
        lean = lean.withColumn("host", host("url")).join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in batches:
            texts = []
            for url, html, wrapper in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if not html:
                    texts.append("")
                    continue
                if shared is not None:
                    paths = shared.value[host_of(url)]
                else:
                    if wrapper not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[wrapper] = article_paths(loads(wrapper))
                    paths = known[wrapper]
                root = parse(html)
                texts.append(extract(root, paths) or extract(root, article_paths(_of_node(root))))  # a page that lacks what its host's others have
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in lean.schema.fields}
    return lean.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
