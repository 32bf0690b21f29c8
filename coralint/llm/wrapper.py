"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a DOM tree whose children of equal kind are one node, so a list or a run of
paragraphs has one place. The commonest tree of a host is its reference; every other tree of the host
is aligned to it by simple tree matching, which gives each node of a page its slot. Over all pages
of the host a slot is judged: text that stands there on nearly all differing pages is template,
slots of menus, adverts, forms and comments, and of links outside the article, are boilerplate, and
the varying rest is content. Words in class names and forms are weak signs: an article resets those
around it, and those around most of a page template's varying text are overruled.
Pages are then read through their host's wrapper.

Scale: a page is parsed once and stored as blocks. Alignment runs on distinct pairs of reference and
tree, not on pages. Judging is a sum per (host, slot) and a count of distinct pages per (host, slot)
and (host, slot, text), both combined on the map side, so a host with a third of all pages is spread by slot and text. A
verdict is one row per host and slot; the verdicts on a tree's nodes are joined by slot and gathered
per host and tree, so a wrapper is as large as its tree, however varied the host. Pages join it by
broadcast while all wrappers together are small, else by host and tree, where adaptive skew join
splits a hot host. No group of pages is ever gathered.

Defined results: null, empty and markup-only html gives an empty text; a null url is the host "";
a slot on few pages has no constant text; copies of one page count once, as pages are told apart by
their title and texts; repeated rows are extracted each; of trees equally common on a host the
largest by text is the reference; other columns are not read, whatever their names; an empty table
gives an empty table. Parsing takes time linear in the page for tags and quotes that never close,
and children of one parent beyond some sixty on either side are aligned piece by piece between those of equal kind.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coralint.llm.common import small_batches, stored

# Text on at least this share of the differing pages that have its slot is template, from MIN_PAGES such pages on.
CONSTANT, MIN_PAGES = 0.9, 5
# Child lists whose lengths' product is beyond FULL are matched in pieces, runs of RUN at most.
FULL, RUN = 4096, 32
# A host's verdict on a slot goes to this many parts of its trees.
SALTS = 16
# Wrappers of all hosts up to this many bytes are broadcast; beyond, pages are shuffled to them.
BROADCAST_BYTES = 32 << 20

# Elements of the HTML standard by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul title".split()
)
SKIPPED = set("head script style noscript template svg canvas object embed iframe select textarea button audio video math".split())
BOILER_TAGS = set("nav footer aside dialog menu".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay sidebar sidebars rail widget widgets nav navbar navigation menu menus breadcrumb "
    "breadcrumbs pagination pager footer comment comments disqus replies respond related recommended share sharing social "
    "newsletter subscribe subscription login signup search".split()
)
HEADER_WORDS = {"header", "masthead", "topbar"}
# Sections of other articles or of comments, whose parts may be <article> too.
LISTED_WORDS = set("comment comments disqus replies respond related recommended".split())
# Class names that tell about a layout, not what an element is.
_STATE = re.compile(r"(?:has|no|with|without|hide)[-_]")
# Flags of a block: surely boilerplate, in the article, in a section of LISTED_WORDS; above them the
# number of elements around it that look like boilerplate by a word or are forms.
STRONG, MAIN, LISTED, DEPTH = 1, 2, 4, 8
CLOSES_P = BLOCK - {"title", "head", "body", "html", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dd", "dt", "legend", "summary", "figcaption"}
# What a start tag closes, and what it cannot close beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/><]*)|<[!?/][^>]*>?""", re.S)
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[^a-zA-Z]+")
_DIGITS = re.compile(r"\d+")


class _Ends:
    """Where a tag ends: at the first > outside quotes.

    A stop sign from which no end is found is remembered, so that unclosed tags cost linear time.
    """

    def __init__(self, text: str):
        self.text, self.failed = text, set()
        self.free = (0, -1)  # no stop sign between these places

    def stop(self, at: int) -> int:
        m = _STOP.search(self.text, at)
        return m.start() if m else len(self.text)

    def find(self, at: int) -> int:
        """Place of the > that ends the tag whose attributes begin at ``at``, or -1."""
        if not self.free[0] <= at <= self.free[1]:
            self.free = (at, self.stop(at))
        s, seen = self.free[1], []
        while s < len(self.text) and s not in self.failed:
            if self.text[s] == ">":
                return s
            seen.append(s)
            close = self.text.find(self.text[s], s + 1)
            if close < 0:
                break
            s = self.stop(close + 1)
        self.failed.update(seen)
        return -1


class _Page:
    """One pass over the tokens: the tree of kinds and the text blocks in page order."""

    def __init__(self):
        self.nodes: list[tuple[int, str]] = []  # (parent, kind)
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int, int]] = []  # (node, text, characters in links, flags)
        self.title = ""
        self.stack: list[tuple[str, int, bool, int, bool]] = []  # (tag, node, skipped, boiler, main)
        self.open: dict[str, int] = {}  # tags on the stack
        self.text: list[str] = []
        self.linked = self.links = 0

    def top(self):
        return self.stack[-1] if self.stack else ("", -1, False, 0, False)

    def node(self, parent: int, kind: str) -> int:
        key = (parent, kind)
        n = self.known.get(key)
        if n is None:
            n = self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return n

    def flush(self):
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, node, _, boiler, main = self.top()
                if node < 0:
                    node = self.node(-1, "body")
                self.blocks.append((node, text, min(self.linked, len(text)), boiler + MAIN * main))
            self.text, self.linked = [], 0

    def write(self, raw: str):
        if raw and not self.top()[2]:
            text = entities.unescape(raw) if "&" in raw else raw
            self.text.append(text)
            if self.links:
                self.linked += len(text.strip())

    def pop_to(self, at: int):
        self.flush()
        for tag, *_ in self.stack[at:]:
            self.links -= tag == "a"
            self.open[tag] -= 1
        del self.stack[at:]

    def close_open(self, tags: set, stop: set):
        if not any(self.open.get(t) for t in tags):
            return None
        for at in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[at][0]
            if tag in tags:
                return self.pop_to(at)
            if tag in stop:
                return None

    def start(self, tag: str, raw: str):
        if tag in CLOSES_P:
            self.close_open({"p"}, {"article", "td", "th", "button", "table", "body"})
        if tag in IMPLIED:
            self.close_open(*IMPLIED[tag])
        if tag == "br":
            return self.write(" ")
        if tag == "hr":
            return self.flush()
        if tag in VOID:
            return None
        _, parent, skipped, boiler, main = self.top()
        if tag in BLOCK:
            self.flush()
        attrs = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        node = parent
        if tag in BLOCK:
            kind = tag + ("." + _DIGITS.sub("0", " ".join(sorted(names.lower().split()))) if names else "")
            node = self.node(parent, kind)
        role = attrs.get("role")
        whole = tag == "main" or role == "main" or attrs.get("itemprop") == "articleBody"
        words = {w for name in names.lower().split() if not _STATE.match(name) for w in _WORDS.split(name)}
        if (whole or tag == "article" or role == "article") and "comment" not in words:
            if not main and not boiler & STRONG and (whole or not boiler & LISTED):
                boiler, main = 0, True  # what is round the article says nothing about it
        elif tag not in ("html", "body"):
            if tag in BOILER_TAGS or role in BOILER_ROLES or tag == "header" and not main:
                boiler |= STRONG
            elif tag == "form" or role == "form" or words & BOILER_WORDS or words & HEADER_WORDS and not main:
                boiler = (boiler | LISTED if words & LISTED_WORDS else boiler) + DEPTH
        skipped = skipped or tag in SKIPPED or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        self.links += tag == "a"
        self.open[tag] = self.open.get(tag, 0) + 1
        self.stack.append((tag, node, skipped, boiler, main))

    def end(self, tag: str):
        if tag == "br":
            return self.write(" ")
        if not self.open.get(tag):
            return None
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                if tag in BLOCK or tag in SKIPPED or any(t in BLOCK for t, *_ in self.stack[at:]):
                    return self.pop_to(at)
                self.links -= tag == "a"  # inline: only this element ends
                self.open[tag] -= 1
                inner = self.stack[at + 1 :]
                del self.stack[at:]
                self.stack.extend(inner)
                return None
        return None

    def read(self, text: str) -> _Page:
        at, n, ends = 0, len(text), _Ends(text)
        while at < n:
            m = _TOKEN.search(text, at)
            if not m:
                self.write(text[at:])
                break
            self.write(text[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            end = ends.find(at)
            if end < 0:  # never closed: an end tag runs to the next >, a start tag is text
                if m[1]:
                    at = text.find(">", at) + 1 or n
                else:
                    self.write(m[0])
                continue
            raw, at = text[at:end], end + 1
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                body = text[at : close.start() if close else n]
                at = close.end() if close else n
                if tag == "title" and not self.title:
                    self.title = " ".join(entities.unescape(body).split())
                continue
            self.start(tag, raw)
            if raw.endswith("/") and tag not in BLOCK and tag not in VOID:
                self.end(tag)
        self.flush()
        return self


def parse(text: str) -> _Page:
    return _Page().read(text)


# ------------------------------------------------------------------ simple tree matching


def _children(nodes) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(len(nodes) + 1)]
    for i, (parent, _) in enumerate(nodes):
        out[parent].append(i)  # the roots' parent is -1, the last list
    return out


def _pairs(mine, theirs, score):
    """Heaviest order-preserving matching of two child lists: (weight, matched pairs)."""
    rows = [[0.0] * (len(theirs) + 1) for _ in range(len(mine) + 1)]
    for i, x in enumerate(mine):
        for j, y in enumerate(theirs):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + score.get((x, y), 0.0))
    i, j, out = len(mine), len(theirs), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            out.append((mine[i - 1], theirs[j - 1]))
            i, j = i - 1, j - 1
    return rows[-1][-1], out


def _rising(places):
    """The longest subsequence of (i, j) pairs, ordered by i, whose j rise."""
    tails, ends, back = [], [], []
    for n, (_, j) in enumerate(places):
        at = bisect_left(tails, j)
        tails[at : at + 1], ends[at : at + 1] = [j], [n]
        back.append(ends[at - 1] if at else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(places[n])
        n = back[n]
    return out[::-1]


def _parts(tree, reference, mine, theirs):
    """Pieces of two child lists, in order, that are matched each within itself.

    Lists of ordinary length are one piece. Long ones are cut at children of equal kind, and what
    stands between two cuts into runs of RUN, so that the work grows with the lists, not their product.
    """
    if not mine or not theirs:
        return []
    if len(mine) * len(theirs) <= FULL:
        return [(mine, theirs)]
    place = {reference[y][1]: j for j, y in enumerate(theirs)}
    common = [(i, place[tree[x][1]]) for i, x in enumerate(mine) if tree[x][1] in place]
    out, a, b = [], 0, 0
    for i, j in [*_rising(common), (len(mine), len(theirs))]:
        rows, cols = mine[a:i], theirs[b:j]
        runs = -(-max(len(rows), len(cols)) // RUN)
        cut = lambda part, n: part[len(part) * n // runs : len(part) * (n + 1) // runs]  # noqa: B023, E731
        out.extend((cut(rows, n), cut(cols, n)) for n in range(runs))
        out.append((mine[i : i + 1], theirs[j : j + 1]))
        a, b = i + 1, j + 1
    return out


def align(tree, reference) -> list[int]:
    """For each node of ``tree`` the matched node of ``reference``, or -1.

    Nodes match if their tags are equal; equal classes and ids weigh more. Without recursion, as
    trees may be deep: pairs are listed from the roots down, weighed upwards, and chosen downwards.
    """
    if tree == reference:
        return list(range(len(tree)))
    kids, others = _children(tree), _children(reference)
    tags, known = ([kind.partition(".")[0] for _, kind in t] for t in (tree, reference))
    todo, parts = [(-1, -1)], {}
    for x, y in todo:
        parts[x, y] = _parts(tree, reference, kids[x], others[y])
        todo.extend((i, j) for rows, cols in parts[x, y] for i in rows for j in cols if tags[i] == known[j])
    score: dict[tuple[int, int], float] = {}
    chosen = {}
    for x, y in reversed(todo):
        matched = [_pairs(rows, cols, score) for rows, cols in parts[x, y]]
        chosen[x, y] = [pair for _, pairs in matched for pair in pairs]
        own = 0 if x < 0 else 2.0 if tree[x][1] == reference[y][1] else 0.5
        score[x, y] = own + sum(weight for weight, _ in matched)
    out, open_ = [-1] * len(tree), [(-1, -1)]
    for pair in open_:
        for i, j in chosen[pair]:
            out[i] = j
            open_.append((i, j))
    return out


def _paths(nodes) -> list[str]:
    """A hash of each node's path; paths themselves would be as long as the tree is deep."""
    out: list[str] = []
    for parent, kind in nodes:
        out.append(xxhash.xxh3_128_hexdigest(f"{out[parent] if parent >= 0 else ''}/{kind}"))
    return out


# ------------------------------------------------------------------ jobs


def _parse_batches(batches):
    for batch in batches:
        trees, keys, columns = [], [], [[] for _ in range(5)]
        for text in batch.column(2):
            page = parse(text.as_py() or "")
            trees.append(json.dumps(page.nodes))
            body = [b[1] for b in page.blocks]
            keys.append(xxhash.xxh64_intdigest("\n".join([page.title, *body])) - (1 << 63))
            for column, values in zip(columns, (
                [b[0] for b in page.blocks], body, [xxhash.xxh64_intdigest(t) - (1 << 63) for t in body],
                [b[2] for b in page.blocks], [b[3] for b in page.blocks],
            )):
                column.append(values)
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(trees, pa.string()), pa.array(keys, pa.int64()),
             *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds))],
            ["id", "url", "tree", "page", "node", "text", "hash", "linked", "flags"],
        )


def _align_batches(batches):
    for batch in batches:
        slots = []
        for tree, reference in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            nodes, fixed = ([tuple(x) for x in json.loads(t)] for t in (tree, reference))
            own, known = _paths(nodes), _paths(fixed)
            slots.append([known[m] if m >= 0 else "+" + own[i] for i, m in enumerate(align(nodes, fixed))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.string()))], ["host", "key", "slots"]
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page; blocks of the text are two newlines apart."""
    small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html_col).mapInArrow(
        _parse_batches,
        f"id {kind}, url string, tree string, page long, node array<int>, text array<string>, hash array<long>, "
        "linked array<int>, flags array<int>",
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    parsed = stored(parsed.withColumn("host", host).withColumn("key", F.md5("tree")), "page-blocks")

    trees = parsed.groupBy("host", "key", "tree").agg(F.count(F.lit(1)).alias("pages"))
    reference = trees.groupBy("host").agg(F.max_by("tree", F.struct("pages", "tree")).alias("reference"))
    slots = stored(
        trees.select("host", "key", "tree")
        .join(reference, "host")
        .select("host", "key", "tree", "reference")
        .mapInArrow(_align_batches, "host string, key string, slots array<string>"),
        "page-slots",
    )
    sizes = F.transform("text", F.char_length).alias("size")
    placed = parsed.select("host", "key", "page", "node", "hash", "linked", "flags", sizes).join(slots, ["host", "key"])
    blocks = placed.select(
        "host",
        F.inline(
            F.transform(
                F.arrays_zip("node", "linked", "flags", "size"),
                lambda b: F.struct(
                    F.col("slots")[b["node"]].alias("slot"), b["size"].alias("size"), b["linked"].alias("linked"), b["flags"].alias("flags"),
                ),
            )
        ),
    )
    weigh = lambda c: F.sum(F.when(c, F.col("size")).otherwise(F.lit(0)))
    judged = blocks.groupBy("host", "slot").agg(
        F.sum("size").alias("size"),
        F.sum("linked").alias("linked"),
        weigh(F.col("flags").bitwiseAND(STRONG) > 0).alias("boiler"),
        weigh(F.col("flags").bitwiseAND(MAIN) > 0).alias("main"),
        weigh(F.col("flags").bitwiseAND(LISTED) > 0).alias("listed"),
        F.sum(F.col("size") * F.floor(F.col("flags") / DEPTH)).alias("depths"),
    )
    # Copies of a page count once. A slot's pages are those that have text there; they count at hash null.
    texts = F.array_distinct(F.arrays_zip("slot", "hash", "size"))
    none = [F.lit(None).cast("long").alias("hash"), F.lit(None).cast("int").alias("size")]
    owned = F.transform(F.array_distinct("slot"), lambda s: F.struct(s.alias("slot"), *none))
    counts = (
        placed.select("host", "page", F.transform("node", lambda n: F.col("slots")[n]).alias("slot"), "hash", "size")
        .select("host", "page", F.inline(F.concat(texts, owned)))
        .distinct()
        .groupBy("host", "slot", "hash", "size")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    owners = counts.groupBy("host", "slot").agg(
        F.max(F.when(F.col("hash").isNull(), F.col("n"))).alias("owners"), F.sum(F.col("n") * F.col("size")).alias("chars")
    )
    # A slot's constant texts are at most as many as a page's blocks, as each stands on nearly all its pages.
    constant = (
        counts.filter(F.col("n") >= CONSTANT * MIN_PAGES)
        .join(owners.filter(F.col("owners") >= MIN_PAGES).drop("chars"), ["host", "slot"])
        .filter(F.col("n") >= CONSTANT * F.col("owners"))
        .groupBy("host", "slot")
        .agg(F.collect_list("hash").alias("constant"), F.sum(F.col("n") * F.col("size")).alias("fixed"))
    )
    half = lambda c: F.col(c) * 2 >= F.col("size")
    verdicts = (
        judged.filter((half("main") | ~half("linked")) & ~half("boiler"))
        .join(owners, ["host", "slot"])
        .join(constant, ["host", "slot"], "left")
        .select(
            "host",
            "slot",
            F.struct(
                half("main").alias("main"),
                half("listed").alias("listed"),
                F.round(F.col("depths") / F.col("size")).cast("int").alias("depth"),
                ((F.col("chars") - F.coalesce("fixed", F.lit(0))) / F.col("owners")).alias("varying"),
            ).alias("verdict"),
            "constant",
        )
    )
    # Verdicts reach the nodes of each tree by slot; salted by tree, as most trees of a host share its slots.
    nodes = slots.select("host", "key", F.posexplode("slots").alias("node", "slot"))
    salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gathered = (
        nodes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        .join(salted, ["host", "slot", "salt"], "left")
        .groupBy("host", "key")
        .agg(F.array_sort(F.collect_list(F.struct("node", "verdict", "constant"))).alias("nodes"))
    )
    # Each page template decides for itself: a host may have old pages without article or main.
    # Words are overruled by text: flags that most of the varying text has are of its layout.
    judgements = F.filter(F.transform("nodes", lambda n: n["verdict"]), lambda v: v.isNotNull() & (v["varying"] > 0))
    chars = lambda c: F.aggregate(c, F.lit(0.0), lambda n, v: n + v["varying"])
    reached = F.aggregate(
        F.array_sort(F.transform("varied", lambda v: F.struct(v["depth"].alias("depth"), v["varying"].alias("varying")))),
        F.struct(F.lit(0.0).alias("chars"), F.lit(0).alias("depth")),
        lambda a, v: F.when(a["chars"] * 2 >= F.col("all"), a).otherwise(F.struct((a["chars"] + v["varying"]).alias("chars"), v["depth"].alias("depth"))),
    )["depth"]
    chosen = (
        gathered.withColumn("varied", judgements)
        .withColumn("inside", F.exists("varied", lambda v: v["main"]))
        .withColumn("varied", F.filter("varied", lambda v: v["main"] | ~F.col("inside")))
        .withColumn("listed", ~F.exists("varied", lambda v: ~v["listed"]))
        .withColumn("varied", F.filter("varied", lambda v: F.col("listed") | ~v["listed"]))
        .withColumn("all", chars("varied"))
        .withColumn("depth", reached)
    )
    fits = lambda v: (v["main"] | ~F.col("inside")) & (F.col("listed") | ~v["listed"]) & (v["depth"] <= F.col("depth"))
    keep = lambda n: F.coalesce(fits(n["verdict"]), F.lit(False))
    wrappers = stored(
        chosen.select(
            "host", "key", F.transform("nodes", lambda n: F.struct(keep(n).alias("keep"), n["constant"].alias("constant"))).alias("nodes")
        ),
        "page-wrappers",
    )
    # Texts move only if the wrappers of all hosts are too many to be sent to every executor.
    marks = F.aggregate("nodes", F.lit(0).cast("long"), lambda n, x: n + 16 + F.coalesce(F.size(x["constant"]), F.lit(0)) * 8)
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("key") + marks)).first()[0]
    side = F.broadcast(wrappers) if (size or 0) <= BROADCAST_BYTES else wrappers
    read = parsed.select("id", "url", "host", "key", "node", "text", "hash").join(side, ["host", "key"], "left")
    own = lambda b: F.col("nodes")[b["node"]]
    kept = F.filter(
        F.arrays_zip("node", "text", "hash"),
        lambda b: own(b)["keep"] & ~F.coalesce(F.array_contains(own(b)["constant"], b["hash"]), F.lit(False)),
    )
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return read.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.coalesce(text, F.lit("")).alias("text"))
