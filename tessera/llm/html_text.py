"""Main text of web pages: differences from the pages nearest by URL.

A page is read into text blocks; scripts, styles, forms and the elements that HTML itself defines
as menus, headers, footers and sidebars are left out. The blocks of every page are compared with
those of the pages next to it in its host's order of URLs, NEAR on either side:

* Lines that a longest common subsequence aligns with a neighbour's are the site's and are
  deleted; lines within an article only if they are aligned with all neighbours'.
* Lines of one kind of part (element and classes) that are aligned clearly more often than the
  lines of articles are the site's too, on all pages: adverts that change from page to page.
* What no neighbour can show (reader comments, adverts and notices of a page without neighbours)
  goes by a class, id or role that says so (MARKS).
"""

from __future__ import annotations

import html
import re
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_enough, written
from .url_filter import parts

#: Contents of most pages, broadcast before the join; rows up to which other tables are broadcast, and their lines in all.
HEAD, KINDS, LINES = 256, 100_000, 10_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^>\"'])*)(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"(class|id|role|aria-label|hidden|style)\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>]+))", re.I)

#: Elements that are never part of the main text, elements that begin and end a block, and those without content.
LEFT_OUT = set("head title nav header footer aside form menu dialog button fieldset".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN, ROOTS = {"article", "main"}, {"html", "body"}
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display:\s*none", re.I)
#: Classes, ids and roles of parts that aren't the main text, each a whole token, on blocks only.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list commentlist complementary "
    "contentinfo cookie-banner cookie-consent cookie-notice cookies disqus_thread footer masthead menu navbar navigation newsletter notice notices "
    "pagination popup related-posts reply replies respond share-buttons sidebar sponsored subscribe".split()
)
#: Neighbours on either side.
NEAR = 3
#: A kind of part is the site's if this share of its lines is aligned and TIMES the share of articles' lines, with so many standard errors to spare, and if this share of its lines at most is distinct.
LEAST, TIMES, ERRORS, DISTINCT = 0.05, 3.0, 3.0, 0.5


def blocks(page: str, marks: frozenset[str] = MARKS) -> list[tuple[str, bool, str]]:
    """Text blocks in page order, as (text, within the article, kind of part: innermost element and classes)."""
    out: list[tuple[str, bool, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements and their kinds
    skip = skip_name = None  # depth of the part that is left out, and its element
    main, at = 0, 0

    def flush() -> None:
        line = " ".join("".join(text).split())
        if line:
            out.append((line, main > 0, next((kind for _, kind in reversed(stack) if kind), "body")))
        text.clear()

    for m in TOKEN.finditer(page):
        if skip is None and m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if name in BLOCKS and skip is None:
                flush()
            if any(name == n for n, _ in stack):
                while stack:
                    top, _ = stack.pop()
                    main -= top in MAIN and skip is None
                    if skip is not None and len(stack) <= skip:
                        skip = None
                    if top == name:
                        break
            continue
        block = name in BLOCKS
        if block and skip is None:
            flush()
        if name in VOID or m["attrs"].endswith("/"):
            if name == "br" and skip is None:
                text.append(" ")
            continue
        named = {w for k, a, b, c in ATTR.findall(m["attrs"]) if k.lower() in ("class", "id", "role") for w in (a or b or c).lower().split()} if block else set()
        marked = bool(named & marks) and name not in ROOTS
        if skip is not None and name in MAIN and skip_name not in MAIN and not marked:
            skip = None  # an unclosed part can't hold the article
        left_out = (name in LEFT_OUT and not (name == "header" and main)) or marked or (name in BLOCKS and HIDDEN.search(m["attrs"]) is not None)
        if skip is None and left_out:
            flush()
            skip, skip_name = len(stack), name
        stack.append((name, (" ".join([name, *sorted(named)]) if block else "")))
        main += name in MAIN and skip is None
    if skip is None:
        text.append(html.unescape(page[at:]))
    flush()
    return out


def aligned(a: list[int], b: list[int]) -> list[int]:
    """Positions of a in a longest common subsequence of a and b.

    Bit-parallel, len(b) bits for each of a; only every so-manieth row is kept, and the rows
    between two of them are made again on the way back: len(b) times the root of len(a) bits.
    """
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full, stride = (1 << len(b)) - 1, isqrt(len(a)) + 1

    def rows(v: int, lo: int, hi: int) -> list[int]:
        """Rows lo to hi, v being row lo. A 0 at bit j of row i says that b[j] lengthens the subsequence of a[:i]."""
        out = [v]
        for x in a[lo:hi]:
            u = v & where.get(x, 0)
            v = ((v + u) | (v - u)) & full
            out.append(v)
        return out

    kept = [full]
    for lo in range(0, len(a), stride):
        kept.append(rows(kept[-1], lo, min(lo + stride, len(a)))[-1])
    found, j = [], len(b)
    for k in range(len(kept) - 2, -1, -1):
        lo = k * stride
        some = rows(kept[k], lo, min(lo + stride, len(a)))
        i = len(some) - 1
        while i and j:
            if some[i] >> (j - 1) & 1:
                j -= 1
            elif not some[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                found.append(lo + i - 1)
                i, j = i - 1, j - 1
    return found[::-1]


def votes(own: list[int], others: list[list[int]]) -> list[int]:
    """How many of others, the neighbours' lines, each own line is aligned with."""
    out = [0] * len(own)
    for other in others:
        common = set(own) & set(other)  # other lines are in no common subsequence
        at = [k for k, x in enumerate(own) if x in common]
        for k in aligned([own[k] for k in at], [x for x in other if x in common]):
            out[at[k]] += 1
    return out


def site_lines(found: list[int], inside: list[bool], by_kind: list[bool], neighbours: int) -> list[int]:
    """Positions of the site's lines, from the votes found for them and whether their kind of part is the site's.

    A page doesn't lose its whole text: if nothing would be left, only lines go that all neighbours
    have, and if that leaves nothing either, its article stays, or else all lines.
    """
    every, least = range(len(found)), max(neighbours, 1)
    for gone in (
        [k for k in every if by_kind[k] or found[k] >= (least if inside[k] else 1)],
        [k for k in every if found[k] >= least],
        [k for k in every if not inside[k]],
    ):
        if len(gone) < len(found):
            return gone
    return []


def _parsed(pages: DataFrame, html_col: str, keep: dict[str, str], marks: frozenset[str]) -> DataFrame:
    """keep's columns, ``lines``, their ``hashes``, whether they lie ``inside`` an article, and their ``kinds`` of part."""

    def run(batches):
        for b in batches:
            found = [blocks(t.as_py() or "", marks) for t in b.column("__html")]
            yield pa.RecordBatch.from_arrays([
                *[b.column(k) for k in keep],
                pa.array([[text for text, _, _ in page] for page in found], pa.list_(pa.string())),
                pa.array([[xxhash.xxh3_64_intdigest(f"{kind}\n{text}") - (1 << 63) for text, _, kind in page] for page in found], pa.list_(pa.int64())),
                pa.array([[main for _, main, _ in page] for page in found], pa.list_(pa.bool_())),
                pa.array([[kind for _, _, kind in page] for page in found], pa.list_(pa.string())),
            ], [*keep, "lines", "hashes", "inside", "kinds"])

    schema = ", ".join(f"{k} {v}" for k, v in keep.items()) + ", lines array<string>, hashes array<bigint>, inside array<boolean>, kinds array<string>"
    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)


def neighbours(lines: DataFrame, near: int = NEAR) -> DataFrame:
    """(key, hashes, inside, kinds, n_pages, others): every content of a host once, with the line hashes of the ``near`` ones before and after it.

    The order is host, path, full URL and page id; copies, of equal line hashes, stand where the
    first of them does. It is range-partitioned, so that a host with a third of all pages is many
    partitions; what stands at their edges comes from a table with one row for each partition.
    """
    order = ["host", "path", "url", "page_id", "key"]
    rest = ["hashes", "inside", "kinds"]
    first = F.min(F.struct("path", "url", "page_id")).alias("at")
    one = lines.groupBy("host", "key").agg(first, *[F.min(c).alias(c) for c in rest], F.count("*").alias("n_pages")).select("host", "at.*", "key", *rest, "n_pages")
    dealt = written(one.repartitionByRange(*order).select("*", F.spark_partition_id().alias("pid")), "contents")
    w = Window.partitionBy("pid").orderBy(*order)
    me, at = F.struct("host", "hashes"), F.struct(*order)
    inner = dealt.select("host", "key", *rest, "n_pages", "pid", F.row_number().over(w).alias("rn"), (F.count("*").over(Window.partitionBy("pid")) + 1 - F.row_number().over(w)).alias("left"),
                         *[f(me, k).over(w).alias(f"{n}{k}") for k in range(1, near + 1) for n, f in (("before", F.lag), ("after", F.lead))])
    # The first and the last ``near`` contents of each partition; no partition is empty, so ``near`` of them hold enough.
    ends = dealt.select("pid", at.alias("at"), me.alias("me"), F.row_number().over(w).alias("rn"), F.row_number().over(Window.partitionBy("pid").orderBy(*[F.col(c).desc() for c in order])).alias("left"))
    some = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) <= near, F.struct("at", "me"))))
    edges = ends.where((F.col("rn") <= near) | (F.col("left") <= near)).groupBy("pid").agg(some("rn").alias("head"), some("left").alias("tail"))
    by_pid = Window.partitionBy(F.lit(0)).orderBy("pid")
    edges = edges.select("pid", F.flatten(F.collect_list("tail").over(by_pid.rowsBetween(-near, -1)))["me"].alias("earlier"), F.flatten(F.collect_list("head").over(by_pid.rowsBetween(1, near)))["me"].alias("later"))
    got = inner.join(edges, "pid")
    # Neighbour k is in the partition, or else so many places into what lies beyond its edge.
    before = [F.coalesce(f"before{k}", F.get("earlier", F.size("earlier") - (k - F.col("rn") + 1).cast("int"))) for k in range(1, near + 1)]
    after = [F.coalesce(f"after{k}", F.get("later", (k - F.col("left")).cast("int"))) for k in range(1, near + 1)]
    others = F.transform(F.filter(F.array(*before, *after), lambda x: x["host"] == F.col("host")), lambda x: x["hashes"])
    return got.select("key", *rest, "n_pages", others.alias("others"))


def site_kinds(counts: DataFrame) -> DataFrame:
    """(kind) of the parts whose lines are aligned clearly more often than those of articles, and mostly repeat; only parts with a class or id.

    counts: (kind, inside, hash, n, aligned), n lines that have neighbours. Without a line in an article
    the rate of all lines stands for theirs; it is never taken as 0.
    """
    total = counts.agg(*[F.sum(F.when(c, F.col(x))).alias(f"{x}_{name}") for name, c in (("main", F.col("inside")), ("all", F.lit(True))) for x in ("n", "aligned")])
    rate = lambda name: (F.coalesce(f"aligned_{name}", F.lit(0)) + 1) / (F.coalesce(f"n_{name}", F.lit(0)) + 100)
    base = total.select(F.when(F.coalesce("n_main", F.lit(0)) > 0, rate("main")).otherwise(rate("all")).alias("base"))  # one row
    each = counts.where(~F.col("inside") & F.col("kind").contains(" ")).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("aligned").alias("aligned"), F.count("*").alias("texts")).crossJoin(F.broadcast(base))
    expected = F.greatest(TIMES * F.col("base"), F.lit(LEAST)) * F.col("n")
    return each.where((F.col("aligned") - expected > ERRORS * F.sqrt(expected)) & (F.col("texts") <= DISTINCT * F.col("n"))).select("kind")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html_col: str = "html", marks: frozenset[str] = MARKS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; empty text for null or empty html.

    Pages of a host with equal lines are one when neighbours are looked for, and get equal texts;
    pages without host are neighbours of each other. Repeated rows stay, extra columns are ignored.
    """
    host, path = parts(F.col(url))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    kind = base.schema["page_id"].dataType.simpleString()
    # Of a content, host and lines with their places: 128 bits.
    content = F.substring(F.sha2(F.concat_ws("\n", "host", F.array_join(F.col("hashes").cast("array<string>"), " "), F.array_join(F.col("inside").cast("array<string>"), " ")), 256), 1, 32)
    # Read twice, before and after the comparison: to write all texts in between costs more disk than pages take.
    parsed = _parsed(base, "html", {"page_id": kind, "url": "string", "host": "string", "path": "string"}, marks).withColumn("key", content)
    near = neighbours(parsed.where(F.size("hashes") > 0).select("host", "path", "url", "page_id", "key", "hashes", "inside", "kinds"))

    def difference(batches):
        for b in batches:
            found = [votes(own, others) for own, others in zip(b.column("hashes").to_pylist(), b.column("others").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in same], pa.array(found, pa.list_(pa.int32()))], [*same, "votes"])

    same = ["key", "n_pages", "hashes", "inside", "kinds", "neighbours"]
    compared = near.withColumn("neighbours", F.size("others")).mapInArrow(difference, "key string, n_pages long, hashes array<long>, inside array<boolean>, kinds array<string>, neighbours int, votes array<int>")
    compared = written(compared, "votes")
    line = F.explode(F.arrays_zip("kinds", "inside", "hashes", "votes")).alias("x")
    counts = compared.where("neighbours > 0").select(line).groupBy(F.col("x.kinds").alias("kind"), F.col("x.inside").alias("inside"), F.col("x.hashes").alias("hash")).agg(F.count("*").alias("n"), F.count_if(F.col("x.votes") > 0).alias("aligned"))
    site = written(site_kinds(counts), "site-kinds")
    # Kinds of each content that are the site's; few kinds are broadcast, many are joined.
    mine = compared.select("key", F.explode(F.array_distinct("kinds")).alias("kind")).join(F.broadcast(site) if small_enough(site, KINDS) else site, "kind")
    mine = mine.groupBy("key").agg(F.collect_set("kind").alias("site"))

    def decide(batches):
        for b in batches:
            masks = []
            for found, inside, kinds, n, site in zip(*[b.column(c).to_pylist() for c in ("votes", "inside", "kinds", "neighbours", "site")], strict=True):
                site = set(site or ())
                gone = set(site_lines(found, inside, [k in site and not i for k, i in zip(kinds, inside, strict=True)], n))
                masks.append([k in gone for k in range(len(found))])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_pages"), pa.array(masks, pa.list_(pa.bool_()))], ["key", "n_pages", "gone"])

    found = written(compared.join(mine, "key", "left").mapInArrow(decide, "key string, n_pages long, gone array<boolean>"), "site-lines")
    # What most pages share is broadcast: of any other content there is less than 1 / HEAD of the pages.
    head = found.where("n_pages > 1").orderBy(F.desc("n_pages"), "key").limit(HEAD).select("key", F.col("gone").alias("hot"))
    rest = found.where(F.array_contains("gone", True)).join(F.broadcast(head.select("key")), "key", "left_anti").select("key", "gone")
    page = parsed.select("page_id", "url", "lines", "key").join(F.broadcast(head), "key", "left")
    many = rest.agg(F.count("*").alias("n"), F.sum(F.size("gone")).alias("lines")).first()
    if many["n"] <= KINDS and (many["lines"] or 0) <= LINES:
        rest = F.broadcast(rest)
    else:
        # These pages and empty ones have no partner in rest; their keys are salted, so that they don't meet in one task.
        page = page.withColumn("key", F.when(F.col("hot").isNull() & (F.size("lines") > 0), F.col("key")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    # A content that is in head isn't in rest.
    page = page.join(rest, "key", "left").withColumn("gone", F.coalesce("hot", "gone"))
    text = F.array_join(F.filter("lines", lambda x, k: ~F.coalesce(F.get("gone", k), F.lit(False))), "\n")
    return page.select("page_id", "url", text.alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))
