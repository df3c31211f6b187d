"""Main text of web pages by wrapper induction.

Pages of one host are aligned with a reference page of that host by simple tree
matching, and all distinct pages vote on the reference's slots. A text slot that
nearly all pages fill with the same text is constant: template. What varies, and
what pages have beyond the reference, is weighed by its length on the part of the
reference in which it stands, and the wrapper's region is the smallest container
that holds nearly all that varies. A page's main text is what it has in the
aligned region, constant texts left out, and a varying top heading before it.
Menus, adverts and notices outside the region are template even if their words
vary, whatever their elements are called.

Word lists settle only what alignment leaves open: parts inside the region that
name themselves menus, forms, adverts or comments are left out. A host with fewer
than ``LEAST_PAGES`` distinct pages, a page without the region, and a page of
whose region only constant texts are left, are read by the word lists alone,
within their article element if they have one.

Defined results: a null or empty page gives an empty text; a page without a host
belongs to the host ''; repeated pages are extracted alike and vote once; broken
or cut markup is closed at the end of the page; pages may be nested and long at
will (trees are walked without recursion, and alignments beyond ``PAIRS`` pairs
take siblings in order instead of the best matching); an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, text_rows

#: Share of distinct aligned pages with the same text from which a slot is template, and the least number of pages that make a wrapper.
CONSTANT_SHARE = 0.9
LEAST_PAGES = 4
#: Share of what varies in a container from which one part of it is the region.
REGION_SHARE = 0.6
#: Node pairs of one alignment, and cells of one table of siblings, up to which the best matching is sought.
PAIRS, CELLS = 60_000, 40_000
#: Reference pages are broadcast up to so many bytes; beyond, pages and references are joined by host and salt, a salt for so many pages.
BROADCAST_BYTES = 32 << 20
#: Bytes of the counts of one voted node.
NODE_BYTES = 56
LEAST_SALTS, PAGES_A_SALT = 32, 50_000

# Fixed word lists of HTML and of common class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
    .split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form button select option input dialog menu svg canvas object audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROPPED_WORDS = frozenset(
    """ad ads advert advertisement advertising adsense sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie
    cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup share sharing social related recommended
    comment comments commentlist respond disqus reply replies footer masthead pagination pager skip toolbar login search""".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus reply replies".split())
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main
    menu nav ol p pre section summary table ul""".split())
CLOSED_BY_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
                     "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": (), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("ul ol dl table select body html article main section div".split())

TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)|[^>]*(?:>|\Z)))""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")




class Text:
    """A block's text: ``number`` is its place on a reference page."""

    __slots__ = ("text", "parent", "number")

    def __init__(self, text: str, parent: "Node"):
        self.text, self.parent, self.number = text, parent, -1


class Node:
    """A block element: label for alignment, whether it names itself a part to be left out, texts and nodes in order.

    ``named`` parts are left out by the lists; ``apart`` ones, named by element,
    role or as comments, don't count when a wrapper's region is sought either.
    """

    __slots__ = ("tag", "label", "named", "apart", "items", "parent", "number", "runs")

    def __init__(self, tag: str, label: str, named: bool, apart: bool, parent: "Node | None"):
        self.tag, self.label, self.named, self.apart, self.parent = tag, label, named, apart, parent
        self.items: list[Node | Text] = []
        self.number, self.runs = -1, None


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw else {}


class _Open:
    """The open elements, with how many there are of each tag."""

    def __init__(self, root: Node):
        self.stack, self.tags = [root], Counter()

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.tags[node.tag] += 1

    def close(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.tags[node.tag] -= 1
        del self.stack[depth:]

    def close_tag(self, tag: str, scopes: frozenset[str] = frozenset()) -> None:
        """Close the innermost element of a tag, unless one of ``scopes`` stands between."""
        if not self.tags[tag]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                return self.close(depth)
            if self.stack[depth].tag in scopes:
                return


P_SCOPES = frozenset(("table", "ul", "ol", "div"))


def parse(page: str | None) -> Node:
    """The page's block elements as a tree; inline markup is read through, texts are decoded and their white space folded."""
    root = Node("html", "html", False, False, None)
    opened, pending = _Open(root), []
    page = page or ""
    at, end = 0, len(page)

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                opened.stack[-1].items.append(Text(text, opened.stack[-1]))

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            pending.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            pending.append(entities.unescape(page[at : m.start()]))  # a reference ends where markup begins
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE and tag not in VOID:
                flush()
                opened.close_tag(tag)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if tag == "br":
                pending.append(" ")
            continue
        flush()
        if tag in ("html", "body"):
            if tag == "body":
                opened.close(1)
            continue
        if tag in CLOSES_P:
            opened.close_tag("p", P_SCOPES)
        for sibling in CLOSED_BY_SIBLING.get(tag, ()):
            opened.close_tag(sibling, SCOPES)
        attributes = _attributes(m[3])
        names = attributes.get("class", "") + " " + attributes.get("id", "")
        words = {w.lower() for w in WORDS.findall(names)}
        # an article's own header holds its title; a page's does not
        header = (tag == "header" or "header" in words) and not (opened.tags["article"] or opened.tags["main"])
        apart = tag in DROPPED or "hidden" in attributes or attributes.get("role", "") in DROPPED_ROLES or bool(words & COMMENT_WORDS)
        named = apart or header or bool(words & DROPPED_WORDS) and tag not in ("article", "main", "body")
        node = Node(tag, f"{tag}.{' '.join(sorted(names.split()))}" if names != " " else tag, named, apart, opened.stack[-1])
        opened.stack[-1].items.append(node)
        if tag not in VOID and not m[3].endswith("/>"):
            opened.push(node)
    flush()
    return root


def items(node: Node) -> Iterator[Node | Text]:
    """All nodes and texts below a node, and itself, in page order."""
    todo: list[Node | Text] = [node]
    while todo:
        item = todo.pop()
        yield item
        if isinstance(item, Node):
            todo += reversed(item.items)


def numbered(node: Node) -> list[Node | Text]:
    """Number a reference page's nodes and texts in order; the list of them."""
    found = list(items(node))
    for n, item in enumerate(found):
        item.number = n
    return found


# --- alignment -----------------------------------------------------------------


def _runs(node: Node) -> list[tuple[str, list]]:
    """Children as runs of equal labels: siblings of one label align in order, so matching goes over runs."""
    if node.runs is None:
        node.runs = []
        for item in node.items:
            label = "#" if isinstance(item, Text) else item.label
            if node.runs and node.runs[-1][0] == label:
                node.runs[-1][1].append(item)
            else:
                node.runs.append((label, [item]))
    return node.runs


def _pairs_below(a: Node, b: Node) -> list[tuple[Node, Node]] | None:
    """All node pairs that a matching of a and b can hold, each after the pair above it; None if they are too many."""
    found, todo = [], [(a, b)]
    while todo:
        pair = todo.pop()
        found.append(pair)
        x, y = _runs(pair[0]), _runs(pair[1])
        if len(found) > PAIRS or len(x) * len(y) > CELLS:
            return None
        by_label = defaultdict(list)
        for label, run in y:
            by_label[label].append(run)
        todo += [(p, q) for label, run in x if label != "#" for other in by_label[label] for p, q in zip(run, other)]
    return found


def _table(a: Node, b: Node, weight: dict[tuple[int, int], int]) -> list[list[int]]:
    """Most nodes and texts that runs up to i of a and up to j of b share in order, for all i and j."""
    x, y = _runs(a), _runs(b)
    table = [[0] * (len(y) + 1)]
    for i, (label, run) in enumerate(x, 1):
        above, row = table[i - 1], [0]
        for j, (other, run_b) in enumerate(y, 1):
            best = above[j] if above[j] > row[j - 1] else row[j - 1]
            if label == other:
                best = max(best, above[j - 1] + _run_weight(label, run, run_b, weight))
            row.append(best)
        table.append(row)
    return table


def _run_weight(label: str, x: list, y: list, weight: dict[tuple[int, int], int]) -> int:
    return min(len(x), len(y)) if label == "#" else sum([weight[id(p), id(q)] for p, q in zip(x, y)])


def _best_runs(a: Node, b: Node, weight: dict[tuple[int, int], int]) -> list[tuple[list, list]]:
    """The run pairs of a best matching."""
    table, x, y = _table(a, b, weight), _runs(a), _runs(b)
    i, j, found = len(x), len(y), []
    while i and j:
        label, run = x[i - 1]
        if label == y[j - 1][0] and table[i][j] == table[i - 1][j - 1] + _run_weight(label, run, y[j - 1][1], weight):
            found.append((run, y[j - 1][1]))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return found


def _runs_in_order(a: Node, b: Node) -> list[tuple[list, list]]:
    """Each run of a with the next run of b that has its label."""
    y = _runs(b)
    places = defaultdict(list)
    for j, (label, _) in enumerate(y):
        places[label].append(j)
    at, found = 0, []
    for label, run in _runs(a):
        k = bisect_left(places[label], at)
        if k < len(places[label]):
            at = places[label][k] + 1
            found.append((run, y[at - 1][1]))
    return found


def aligned(a: Node, b: Node) -> list[tuple[Node | Text, Node | Text]]:
    """Pairs of nodes and of texts that the simple tree matching of reference a and page b aligns."""
    below = _pairs_below(a, b)
    weight: dict[tuple[int, int], int] = {}
    for p, q in reversed(below or []):
        weight[id(p), id(q)] = 1 + _table(p, q, weight)[-1][-1]
    out: list[tuple[Node | Text, Node | Text]] = []
    todo = [(a, b)]
    while todo:
        pair = todo.pop()
        out.append(pair)
        for x, y in _runs_in_order(*pair) if below is None else _best_runs(*pair, weight):
            for p, q in zip(x, y):
                if isinstance(p, Text):
                    out.append((p, q))
                else:
                    todo.append((p, q))
    return out


# --- the wrapper of a host -------------------------------------------------------


def vote(reference: Node, size: int, page: Node, lists: bool = True) -> list[int]:
    """A page's vote on each node and text of the reference.

    A text: -1 if the page has the same there, else the length of what it has
    (0: nothing aligned). A node: the length of the texts in it that align with
    nothing; the root's is one more, which counts the pages.
    """
    votes = [0] * size
    partner: dict[int, int] = {}
    for p, q in aligned(reference, page):
        partner[id(q)] = p.number
        if isinstance(p, Text):
            votes[p.number] = -1 if p.text == q.text else len(q.text)
    votes[0] += 1
    owner: dict[int, tuple[int, bool]] = {}  # of a node: the aligned node that it is in, and whether it counts
    for item in items(page):
        above, counts = owner[id(item.parent)] if item.parent is not None else (0, True)
        mine = partner.get(id(item))
        if isinstance(item, Node):
            owner[id(item)] = (above if mine is None else mine, counts and not (lists and item.apart))
        elif not counts:
            if mine is not None and votes[mine] > 0:
                votes[mine] = 0
        elif mine is None:
            votes[above] += len(item.text)
    return votes


class Wrapper:
    """What the votes on a reference say: its constant texts, its region and the varying top headings outside."""

    def __init__(self, reference: Node, found: list[Node | Text], counts: dict[int, tuple[int, int, int]],
                 share: float = CONSTANT_SHARE, least: int = LEAST_PAGES):
        """counts: number -> (pages that voted, pages with the same text, length of what varies)."""
        self.reference, self.region = reference, None
        self.constant: set[int] = set()
        self.titles: set[int] = set()
        if counts.get(0, (0, 0, 0))[0] < least:
            return
        mass = [0] * len(found)
        for number, (n, same, varying) in counts.items():
            if isinstance(found[number], Text) and n >= least and same >= share * n:
                self.constant.add(number)
            else:
                mass[number] = varying - (n if number == 0 else 0)
        for item in reversed(found):
            if item.parent is not None:
                mass[item.parent.number] += mass[item.number]
        at = reference
        while True:
            inner = [c for c in at.items if isinstance(c, Node) and any(isinstance(x, Node) for x in c.items) and mass[c.number] >= REGION_SHARE * mass[at.number]]
            if not mass[at.number] or not inner:
                break
            at = inner[0]
        if mass[0]:
            self.region = at.number
            inside = {x.number for x in items(at)}
            self.titles = {x.number for x in found if isinstance(x, Text) and x.parent.tag == "h1" and x.number < at.number
                           and x.number not in inside and x.number not in self.constant and mass[x.number]}


def content(page: Node, wrapper: Wrapper | None = None, lists: bool = True) -> list[str]:
    """Blocks of the page's main text, in order."""
    if wrapper is None or wrapper.region is None:
        return content_by_lists(page) if lists else [t.text for t in items(page) if isinstance(t, Text)]
    partner = {id(q): p for p, q in aligned(wrapper.reference, page)}
    region = next((q for q in items(page) if isinstance(q, Node) and id(q) in partner and partner[id(q)].number == wrapper.region), None)
    if region is None:
        return content_by_lists(page) if lists else [t.text for t in items(page) if isinstance(t, Text)]
    inside: dict[int, bool] = {id(region): True}  # of a node: whether its texts are taken
    taken, constant = [], False
    for item in items(page):
        within = item.parent is not None and inside.get(id(item.parent), False)
        if isinstance(item, Node):
            inside.setdefault(id(item), within and not (lists and item.named))
            continue
        p = partner.get(id(item))
        if within or p is not None and p.number in wrapper.titles:
            if p is not None and p.number in wrapper.constant and p.text == item.text:
                constant = True
            else:
                taken.append(item.text)
    if not taken and constant and lists:
        return content_by_lists(page)
    return taken


def content_by_lists(page: Node) -> list[str]:
    """Blocks that are in no part that names itself, within article and main elements if there are any."""
    state: dict[int, tuple[bool, bool]] = {}  # of a node: left out, in an article
    kept = []
    for item in items(page):
        out, main = state[id(item.parent)] if item.parent is not None else (False, False)
        if isinstance(item, Node):
            out = out or item.named
            state[id(item)] = (out, main or item.tag in ("article", "main") and not out)
        elif not out:
            kept.append((item.text, main))
    return [t for t, main in kept if main] if any(main for _, main in kept) else [t for t, _ in kept]


def fingerprint(page: Node) -> str:
    """Digest of the part of the page that holds nearly all its text: pages that differ in menus and notices only have the same."""
    found = list(items(page))
    size: dict[int, int] = {}
    for item in reversed(found):
        size[id(item)] = size.get(id(item), 0) + (len(item.text) if isinstance(item, Text) else 0)
        if item.parent is not None:
            size[id(item.parent)] = size.get(id(item.parent), 0) + size[id(item)]
    at = page
    while True:
        inner = [c for c in at.items if isinstance(c, Node) and size[id(c)] >= REGION_SHARE * size[id(at)] > 0]
        if not inner:
            break
        at = inner[0]
    texts = [x.text for x in items(at) if isinstance(x, Text)]
    return hashlib.md5("\n".join(texts).encode("utf-8", "surrogatepass")).hexdigest()


class _References:
    """Parsed reference pages of the hosts that a task has met, a bounded number of them."""

    def __init__(self):
        self.kept: dict[str, tuple[Node, list]] = {}
        self.wrappers: dict[str, Wrapper] = {}

    def get(self, page: str) -> tuple[Node, list]:
        if page not in self.kept:
            if len(self.kept) >= 64:
                self.kept.clear()
                self.wrappers.clear()
            tree = parse(page)
            self.kept[page] = (tree, numbered(tree))
        return self.kept[page]

    def wrapper(self, host: str, page: str, counts: pa.Scalar) -> Wrapper:
        tree, found = self.get(page)
        if host not in self.wrappers:
            self.wrappers[host] = Wrapper(tree, found, {c["number"]: (c["n"], c["same"], c["varying"]) for c in counts.as_py()})
        return self.wrappers[host]


# --- columns ---------------------------------------------------------------------


def page_votes(pages: DataFrame) -> DataFrame:
    """host, mark (fingerprint) and the page's votes. pages: host, html, reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = _References()
        for batch in batches:
            marks, votes = [], []
            for page, ref in zip(batch.column(1), batch.column(2)):
                tree, (reference, found) = parse(page.as_py()), references.get(ref.as_py() or "")
                votes.append(vote(reference, len(found), tree))
                marks.append(fingerprint(tree))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.string()), pa.array(votes, pa.list_(pa.int32()))], names=["host", "mark", "votes"])

    return pages.select("host", "html", "reference").mapInArrow(run, "host string, mark string, votes array<int>")


def induce(pages: DataFrame) -> DataFrame:
    """host, counts: of each voted node and text of the reference its number, voters, equal texts and varying length.

    Pages with the same fingerprint vote once, so that copies of one page don't
    turn an article into a template. Votes are counted by partial aggregation.
    """
    once = page_votes(pages).groupBy("host", "mark").agg(F.min("votes").alias("votes"))
    each = once.select("host", F.posexplode("votes").alias("number", "vote")).filter("vote <> 0")
    counted = each.groupBy("host", "number").agg(
        F.count("*").alias("n"), F.count_if(F.col("vote") == -1).alias("same"), F.sum(F.greatest(F.col("vote").cast("long"), F.lit(0))).alias("varying"))
    return counted.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("number", "n", "same", "varying"))).alias("counts"))


def _with_host(pages: DataFrame, hosts: DataFrame, salts: int) -> DataFrame:
    """Pages with their host's columns; salts 0: hosts are small enough to be sent to all."""
    if not salts:
        return pages.join(F.broadcast(hosts), "host", "left")
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, host, text, n_chars of every page.

    One page a host is the reference. References are few and small as a rule;
    their total size is measured, with the counts of votes once there are any,
    and only within a fixed bound are they broadcast, which leaves the pages
    where they are read.
    """
    scratch = Scratch(pages.sparkSession, "wrapper")
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = text_rows(pick(pages, page_id=id_col, url=url_col, html=html_col)).select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    order = F.struct((F.length("html") < 200).alias("short"), F.xxhash64("url", "page_id", "html").alias("h"))
    references = scratch.save(rows.filter(F.col("html").isNotNull()).groupBy("host").agg(F.min_by("html", order).alias("reference"), F.count("*").alias("pages")))
    measured, most = references.agg(F.coalesce(F.sum(F.octet_length("reference") + F.octet_length("host")), F.lit(0)), F.coalesce(F.max("pages"), F.lit(0))).first()
    salts = 0 if measured <= BROADCAST_BYTES else max(LEAST_SALTS, -(-most // PAGES_A_SALT))
    references = references.drop("pages")
    wrappers = scratch.save(induce(_with_host(rows, references, salts)))
    hosts = scratch.save(references.join(wrappers, "host", "left"))
    counted = F.greatest(F.coalesce(F.size("counts"), F.lit(0)), F.lit(0)) * NODE_BYTES
    measured = hosts.agg(F.coalesce(F.sum(F.octet_length("reference") + F.octet_length("host") + counted), F.lit(0))).first()[0]
    salts = 0 if measured <= BROADCAST_BYTES else max(LEAST_SALTS, -(-most // PAGES_A_SALT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _References()
        for batch in batches:
            found = []
            for host, page, ref, counts in zip(*(batch.column(k) for k in range(2, 6))):
                wrapper = seen.wrapper(host.as_py(), ref.as_py(), counts) if counts.is_valid else None
                found.append("\n\n".join(content(parse(page.as_py()), wrapper)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "host", "text", "n_chars"])

    joined = _with_host(rows, hosts, salts).select("page_id", "url", "host", "html", "reference", "counts")
    return joined.mapInArrow(run, "page_id long, url string, host string, text string, n_chars long")
