"""Near-duplicate documents: BagMinHash signatures, banding, and verified multiset overlap.

A document is the multiset of its windows of SHINGLE words. Each element's weight, an
integer number of units, is covered by intervals that double in length; each interval has
a Poisson process, fixed by the element and the interval, whose points carry a component
of the signature and a level within the interval. A component's value is the earliest
point at a level that the weight reaches, so two documents agree in a component with a
probability that is their weighted Jaccard similarity. Points are made in the order of
time and only while they can still be the earliest, which is a few for each element.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_with_id, small_enough, written
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of ROWS components each: a pair of similarity 0.8 shares none with probability 3e-6.
BANDS, ROWS = 42, 6
#: Elements and documents of one task's piece of a group, and rows up to which ids are broadcast.
PIECE, PIECE_DOCS, BROADCAST = 1_000_000, 256, 1_000_000

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _WordHashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], cache: dict[bytes, int], width: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of width words; a text with fewer words is one shingle of them all."""
    h = np.fromiter((cache[w] for w in words), U, len(words))
    if not len(h):
        return h
    n = max(len(h) - width + 1, 1)
    out = np.full(n, len(h) if len(h) < width else width, U)
    for k in range(min(width, len(h))):
        out = _mix(out * U(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def bag_minhash(key: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """(docs, size) signatures of 16 bits. key: hash of each element; weight: its units in document doc."""
    first, sig = np.full(docs * size, np.inf), np.zeros(docs * size, np.uint16)
    level = np.ceil(np.log2(np.maximum(weight, 1))).astype(int)  # intervals (0, 1], (1, 2], (2, 4], ... up to the weight
    parts = [(np.flatnonzero(level >= k), k) for k in range(int(level.max(initial=0)) + 1)]
    at = np.concatenate([p for p, _ in parts]) if len(key) else np.empty(0, int)
    k = np.concatenate([np.full(len(p), k) for p, k in parts]) if len(key) else np.empty(0, int)
    low = np.where(k > 0, 1 << np.maximum(k - 1, 0), 0)
    length = np.where(k > 0, low, 1)
    seed, most, owner = _mix(key[at] + k.astype(U) * U(0xD1B54A32D192ED03)), weight[at], doc[at]
    partial = low + length > most
    time = np.zeros(len(at))
    limit = np.full(docs, np.inf)
    step = 0
    while len(seed):
        step += 1
        a = _mix(seed + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log1p(-(a >> U(11)).astype(np.float64) * 2.0**-53) / length
        on = time < limit[owner]
        if not on.all():
            seed, most, owner, partial, time, low, length, a = (x[on] for x in (seed, most, owner, partial, time, low, length, a))
        b = _mix(a ^ U(0x632BE59BD9B4E019))
        use = slice(None)
        if partial.any():
            mark = low + ((b >> U(16) & U(0xFFFFFF)).astype(np.float64) * 2.0**-24 * length).astype(np.int64)
            use = mark < most
        cell = (owner * size + ((b >> U(40)) * U(size) >> U(24)).astype(np.int64))[use]
        t = time[use]
        np.minimum.at(first, cell, t)
        won = first[cell] == t
        sig[cell[won]] = (b[use] & U(0xFFFF)).astype(np.uint16)[won]
        touched = np.unique(owner)
        limit[touched] = first.reshape(docs, size)[touched].max(1)
    return sig.reshape(docs, size)


def _signatures(rows: DataFrame, text: str) -> DataFrame:
    """(rid, sha, w, sig) of the rows whose text has a word; sha: digest of the words, w: shingles."""

    def run(batches):
        cache = _WordHashes()
        for b in batches:
            rid, texts, start = b.column("rid").to_pylist(), b.column("t"), 0
            while start < len(rid):
                keys, weights, docs, out, total = [], [], [], [], 0
                while start < len(rid) and total < 400_000 and len(out) < 4096:
                    words = (texts[start].as_py() or "").encode().split()
                    if words:
                        k, n = np.unique(shingles(words, cache), return_counts=True)
                        keys.append(k)
                        weights.append(n)
                        docs.append(np.full(len(k), len(out)))
                        out.append((rid[start], hashlib.sha256(b" ".join(words)).digest()[:16], int(n.sum())))
                        total += len(k)
                    start += 1
                if out:
                    sig = bag_minhash(np.concatenate(keys), np.concatenate(weights), np.concatenate(docs), len(out))
                    yield pa.RecordBatch.from_pydict({"rid": pa.array([o[0] for o in out], pa.int64()), "sha": pa.array([o[1] for o in out], pa.binary()), "w": pa.array([o[2] for o in out], pa.int64()), "sig": pa.array([s.tobytes() for s in sig], pa.binary())})

    return rows.select("rid", F.col(f"row.{text}").alias("t")).mapInArrow(run, "rid long, sha binary, w long, sig binary")


def similar(bags: list[np.ndarray], split: int, least: float = SIMILARITY) -> np.ndarray:
    """Labels that join all documents linked by weighted Jaccard similarities of at least ``least``.

    bags: hashes of each document's shingles, repeats included. With split > 0, only pairs with
    one document before it and one from it on count.
    """
    n = len(bags)
    keys = []
    for s in bags:  # the i-th repeat of a shingle is an element of its own: multisets become sets
        s = np.sort(s)
        new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.empty(0, bool)
        index = np.arange(len(s))
        keys.append(_mix(s + (index - np.maximum.accumulate(np.where(new, index, 0))).astype(U) * U(0xA24BAED4963EE407)))
    size = np.array([len(k) for k in keys])
    owner = np.repeat(np.arange(n), size)
    _, col, df = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    common = np.zeros((n, n), np.float32)
    rare = (df[col] > 1) & (df[col] <= 16)
    r_col, r_own = col[rare], owner[rare]
    for lag in range(1, 16):
        same = r_col[lag:] == r_col[:-lag] if len(r_col) > lag else np.empty(0, bool)
        if not same.any():
            break
        i, j = r_own[:-lag][same], r_own[lag:][same]
        common += np.bincount(i * n + j, minlength=n * n).reshape(n, n).astype(np.float32)
    common += common.T
    often = np.flatnonzero(df > 16)
    place = np.full(len(df), -1)
    place[often] = np.arange(len(often))
    o_col, o_own = place[col], owner
    o_own, o_col = o_own[o_col >= 0], o_col[o_col >= 0]
    width = max(64, min(4096, 20_000_000 // n))
    for lo in range(0, len(often), width):
        on = (o_col >= lo) & (o_col < lo + width)
        m = np.zeros((n, min(width, len(often) - lo)), np.float32)
        m[o_own[on], o_col[on] - lo] = 1
        common += m @ m.T
    linked = common >= least * (size[:, None] + size[None] - common) - 1e-4
    if split:
        linked[:split, :split] = linked[split:, split:] = False
    label = np.full(n, -1)
    for root in range(n):
        if label[root] < 0:
            label[root], edge = root, [root]
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(0) & (label < 0))
                label[edge] = root
    return label


def _links(rows: DataFrame, text: str, dealt: DataFrame, least: float) -> DataFrame:
    """(a, b): links found within each task (root, i, j) of dealt (root, i, j, side, rid), at most one
    for each of its documents. Where both sides occur, only pairs of different sides count."""
    t = rows.select("rid", F.col(f"row.{text}").alias("t"))
    dealt = t.join(F.broadcast(dealt) if small_enough(dealt, BROADCAST // 4) else dealt, "rid").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "rid")

    def run(batches):
        cache = _WordHashes()

        def links(ids, side, bags):
            label = similar(bags, side.count(0) if 0 < sum(side) < len(side) else 0, least)
            pairs = [(ids[k], ids[x]) for x, k in enumerate(label) if x != k]
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

        last, ids, side, bags = None, [], [], []
        for b in batches:
            for root, i, j, s, rid, t in zip(*[b.column(c) for c in ("root", "i", "j", "side", "rid", "t")], strict=True):
                key = root.as_py(), i.as_py(), j.as_py()
                if key != last and ids:
                    yield links(ids, side, bags)
                    ids, side, bags = [], [], []
                last = key
                ids.append(rid.as_py())
                side.append(s.as_py())
                bags.append(shingles((t.as_py() or "").encode().split(), cache))
        if ids:
            yield links(ids, side, bags)

    return dealt.mapInArrow(run, "a long, b long")


def _pieces() -> Column:
    """Pieces of the rows of a group that fit in a task."""
    return F.greatest(F.ceil(F.sum("w") / PIECE), F.ceil(F.count("*") / PIECE_DOCS)).cast("int")


def _dealt(node: str, pieces: str) -> Column:
    return F.pmod(F.xxhash64(node), F.col(pieces)).cast("int")


def _verified(rows: DataFrame, text: str, groups: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(a, b): links between documents of a group (node, root), each with its similarity checked, that
    connect all which any pairs of the group do.

    A group whose elements don't fit in a task is dealt into pieces by hash. First each piece is
    compared within itself and with the group's first document, which joins the copies of a text
    that was varied a little: work in proportion to the group. Then the documents outside the
    group's largest class so far are compared with all its documents, piece by piece; pairs within
    that class add nothing.
    """
    g = groups.union(groups.select("root", "root").distinct()).toDF("node", "root").distinct()
    # Written: a join by the root of a very large group can then be split, and nothing is made twice.
    g = written(g.join(reps.select(F.col("rep").alias("node"), "w"), "node"), "nodes")
    total = written(g.groupBy("root").agg(_pieces().alias("pieces")), "totals")
    g = written(g.join(total, "root").withColumn("p", _dealt("node", "pieces")), "placed")
    whole, none = F.sequence(F.lit(0), F.col("pieces") - 1), F.lit(-1)
    places = F.when(F.col("node") == F.col("root"), whole).otherwise(F.array("p"))
    first = _links(rows, text, written(g.select("root", F.explode(places).alias("i"), none.alias("j"), F.lit(0).alias("side"), F.col("node").alias("rid")), "pieces"), least)
    several = g.where("pieces > 1")
    if several.isEmpty():
        return first
    first = written(first, "first-links")
    classed = several.join(components(first).toDF("node", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    classed = written(classed, "classed")
    sizes = classed.groupBy("root", "class").agg(F.count("*").alias("n"))
    largest = written(sizes.groupBy("root").agg(F.max_by("class", F.struct("n", "class")).alias("largest")), "largest")
    outside = written(classed.join(largest, "root").where("class != largest").select("root", "node", "w", "pieces"), "outside")
    parts = written(outside.groupBy("root").agg(_pieces().alias("parts")), "parts")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    all_rows = several.join(parts, "root").select("root", F.col("p").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"), F.col("node").alias("rid"))
    others = outside.join(parts, "root").select("root", F.explode(whole).alias("i"), _dealt("node", "parts").alias("j"), F.lit(1).alias("side"), F.col("node").alias("rid"))
    return first.unionByName(_links(rows, text, written(all_rows.unionByName(others), "cross-pieces"), least))


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The rows with ids, as rows_with_id() gives them, and (rid, id, class_id, class_size, kept) of each.

    A class holds all documents that chains of similarities of at least ``least`` connect; class_id
    is its smallest id (null ids come last) and that row is kept; rows with the same id go by row
    id. Documents of fewer than five words are one shingle. Texts without words are classes of
    their own. Exact copies are one node from the start, however many they are.
    """
    rows = rows_with_id(docs)
    signed = written(_signatures(rows, text), "signatures")
    reps = written(signed.groupBy("sha").agg(F.min("rid").alias("rep"), F.first("w").alias("w"), F.first("sig").alias("sig")), "reps")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.expr("sig").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS)), i))
    bands = reps.select("rep", F.explode(band).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    # All documents of a bucket are in one group, whether or not they resemble its first one.
    groups = components(bands.join(buckets, "key").where("rep != a").select("a", F.col("rep").alias("b")).distinct())
    links = _verified(rows, text, groups, reps, least)
    final = components(links)
    members = rows.select("rid", F.col(f"row.{id_col}").alias("id")).join(signed.select("rid", "sha"), "rid", "left").join(reps.select("sha", "rep"), "sha", "left")
    rooted = written(members.join(final.toDF("rep", "root"), "rep", "left").select("rid", "id", F.coalesce("root", "rep", "rid").alias("root")), "rooted")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    heads = written(rooted.groupBy("root").agg(F.min(order).alias("head"), F.count("*").alias("class_size")), "heads")
    return rows, rooted.join(heads, "root").select("rid", "id", F.col("head.id").alias("class_id"), "class_size", (F.col("head.rid") == F.col("rid")).alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class; all columns unchanged."""
    rows, c = classes(docs, text, id_col, least)
    dropped = written(c.where(~F.col("kept")).select("rid"), "dropped")
    return rows.join(F.broadcast(dropped) if small_enough(dropped, BROADCAST) else dropped, "rid", "left_anti").select("row.*")
