"""Removal of repeated passages by a distributed merge sort of sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a
smaller id. Each such string has one anchor: the leftmost of its GRAM-byte substrings with
the least hash. Equal strings have equal anchors at equal offsets, so only the suffixes
that begin at anchors need sorting, about one in sixteen.

1. Chunks of documents exchange Golomb-coded hashes of their anchors' substrings and learn
   which occur in another document.
2. The suffixes at those anchors, cut after the last string they serve, are sorted in each
   chunk, equal ones with equal contexts merged to the smallest id. Splitters, quantiles of
   a sample of anchors, cut each chunk's order into runs, which are sent front-coded: owners
   hold consecutive ranges of one order over all chunks.
3. Owners combine the sorted runs in a loser tree that keeps each run's common prefix with
   the last suffix put out and never compares those bytes again. Suffixes that share the
   anchor's substring are neighbours then, and their strings are matched.
4. An anchor's substring that fills ranges of its own is too frequent for one owner. Its
   strings are grouped by all their bytes instead, each sent once by a chunk.
5. Chunks learn which strings of each suffix have a smaller id, and cut their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import sum_before
from . import golomb
from .common import written

LENGTH, GRAM = 50, 20
#: Bytes of a chunk, and hashes of an owner in the first exchange.
CHUNK, PER_OWNER = 4_000_000, 500_000
#: Bytes for each string sampled for the splitters, and the most ranges: their splitters, GRAM bytes
#: each, go to every task (20 MB at most, reached at 4 TB; beyond that ranges grow with the input).
SAMPLE, MOST_RANGES = 8192, 1 << 20
POSITION_BITS, TILE = 28, 1 << 15
U = np.uint64


def _choices(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all strings of LENGTH bytes in b: the anchor's position; and the hashes of all substrings."""
    b = b.astype(U) + U(1)
    p = 0x9E3779B97F4A7C15
    power = lambda n: U(pow(p, n, 1 << 64))
    h = {1: b}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * power(n) + h[n][n:]
    g = h[16][: len(b) - GRAM + 1] * power(4) + h[4][16 : 16 + len(b) - GRAM + 1]
    g = (g ^ (g >> U(31))) * U(0xBF58476D1CE4E5B9)
    g = (g ^ (g >> U(29))) * U(0x94D049BB133111EB)
    g ^= g >> U(32)
    m = (g >> U(POSITION_BITS) << U(POSITION_BITS)) | np.arange(len(g), dtype=U)
    span, width = LENGTH - GRAM + 1, 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    return (m & U((1 << POSITION_BITS) - 1)).astype(np.int64), g


def anchors(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents data[start:end]: each anchor's position, the first and last of the strings it
    serves (their positions), and a fingerprint of its substring (BITS bits, evenly spread: anchors
    have small hashes, so by the hash itself the owner of the least would get 16 times its part).

    Bytes are taken TILE strings at a time, whose arrays stay in the processor's cache; of a tile
    only its anchors are kept, so that no array has a number for every byte.
    """
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    inside = np.zeros(len(data) + 1, np.int8)
    long = end - start >= LENGTH
    inside[start[long]] += 1  # documents don't overlap: no position stands twice in either line
    inside[end[long] - LENGTH + 1] -= 1
    inside = np.cumsum(inside, dtype=np.int8, out=inside).view(bool)
    at, firsts, lasts, hashes, before = [], [], [], [], -1
    for lo in range(0, len(data) - LENGTH + 1, TILE):
        choice, g = _choices(data[lo : lo + TILE + LENGTH - 1])
        use = np.flatnonzero(inside[lo : lo + len(choice)])
        if not len(use):
            continue
        choice = choice[use]
        new = np.flatnonzero(np.r_[True, choice[1:] != choice[:-1]])
        last = use[np.r_[new[1:], len(use)] - 1] + lo
        if choice[0] + lo == before:  # the tile before ends with strings of this anchor
            lasts[-1][-1], new, last = last[0], new[1:], last[1:]
        if len(new):
            at.append(choice[new] + lo)
            firsts.append(use[new] + lo)
            lasts.append(last)
            hashes.append((g[choice[new]] * U(0xD6E8FEB86659FD93) >> U(64 - golomb.BITS)).astype(np.int64))
            before = at[-1][-1]
    return tuple(np.concatenate(x) if x else none for x in (at, firsts, lasts, hashes))


class Chunk:
    """Documents of one group, in an order that is the same whenever it is built."""

    def __init__(self, group: pa.Table):
        texts = [t or b"" for t in group.column("t").to_pylist()]
        ids, copies = group.column("id").to_pylist(), group.column("copies").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0, texts[k]))
        self.ids, self.texts, self.copies = [ids[k] for k in order], [texts[k] for k in order], [copies[k] for k in order]
        self.order = np.array([(1 << 63) - 1 if i is None else i for i in self.ids], np.int64)  # null ids are the largest
        self.raw = b"".join(self.texts)
        size = np.array([len(t) for t in self.texts], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.at, self.first, self.last, self.hash = anchors(np.frombuffer(self.raw, np.uint8), self.start, self.end)
        self.doc = np.searchsorted(self.end, self.at, side="right")

    def shared(self, owners: int, bitmaps: dict[int, bytes]) -> np.ndarray:
        return np.flatnonzero(golomb.flags(self.hash, owners, bitmaps)) if len(self.hash) else np.empty(0, np.int64)

    def grams(self, some: np.ndarray) -> np.ndarray:
        """The substrings of some anchors."""
        if not len(some):
            return np.empty(0, f"S{GRAM}")
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.raw, np.uint8), GRAM)
        return windows[self.at[some]].view(f"S{GRAM}").ravel()

    def ranges(self, some: np.ndarray, splits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(range, those of some anchors that belong to it), so that one range's records are held at a time."""
        owner = np.searchsorted(splits, self.grams(some), side="right")
        order = np.argsort(owner, kind="stable")
        to, start = np.unique(owner[order], return_index=True)
        yield from zip(to.tolist(), np.split(some[order], start[1:]), strict=False)

    def records(self, some: np.ndarray) -> tuple[dict[tuple[bytes, bytes], int], np.ndarray]:
        """Distinct (suffix, left context) of some anchors, each with the anchor of the smallest id,
        and that anchor for each of them."""
        best: dict[tuple[bytes, bytes], int] = {}
        where = zip(self.at[some].tolist(), self.first[some].tolist(), self.last[some].tolist(), some.tolist(), strict=True)
        # Documents stand in the order of their ids.
        own = [best.setdefault((self.raw[a : last + LENGTH], self.raw[first:a]), k) for a, first, last, k in where]
        return best, np.array(own, np.int64)

    def strings(self, best: dict[tuple[bytes, bytes], int]) -> dict[bytes, int]:
        """The strings of those records, with their smallest order."""
        least: dict[bytes, int] = {}
        for (suffix, left), k in best.items():
            whole, order = left + suffix, int(self.order[self.doc[k]])
            for q in range(len(whole) - LENGTH + 1):
                s = whole[q : q + LENGTH]
                if least.setdefault(s, order) > order:
                    least[s] = order
        return least

    def removed(self, some: np.ndarray, best: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The bytes that go. best: for each of some anchors the one whose record stands for it;
        bits: for each anchor, of its strings those that a smaller id of another chunk has."""
        # How many removed strings cover a byte, as differences: LENGTH at most, and one begins or ends at a byte.
        covered = np.zeros(len(self.raw) + 1, np.int8)
        if len(some):
            # What the smallest id of this chunk has, larger ids lose; the rest is as the owner says.
            larger = self.order[self.doc[some]] > self.order[self.doc[best]]
            first, count, bits = self.first[some], self.last[some] - self.first[some] + 1, bits[best]
            for q in range(int(count.max())):
                gone = first[(q < count) & (larger | (bits >> q & 1 > 0))] + q
                covered[gone] += 1
                covered[gone + LENGTH] -= 1
        return np.cumsum(covered, dtype=np.int8, out=covered)[:-1] > 0


def front_coded(records: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Sorted (suffix, left, order, number), each suffix without the prefix it shares with the one before."""
    out, before = [], b""
    for suffix, left, order, number in records:
        n = 0
        for x, y in zip(suffix, before, strict=False):
            if x != y:
                break
            n += 1
        before = suffix
        out.append(bytes((n, len(suffix) - n, len(left))) + suffix[n:] + left + order.to_bytes(8, "little", signed=True) + number.to_bytes(4, "little"))
    return b"".join(out)


def decoded(blob: bytes) -> Iterator[tuple[bytes, int, bytes, int, int]]:
    """(suffix, length of the prefix shared with the one before, left, order, number)."""
    i, suffix = 0, b""
    while i < len(blob):
        n, rest, left = blob[i], blob[i + 1], blob[i + 2]
        i += 3
        suffix = suffix[:n] + blob[i : i + rest]
        i += rest
        yield suffix, n, blob[i : i + left], int.from_bytes(blob[i + left : i + left + 8], "little", signed=True), int.from_bytes(blob[i + left + 8 : i + left + 12], "little")
        i += left + 12


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, int, tuple]]:
    """All runs' records in the order of their suffixes, as (run, prefix shared with the record before, record).

    A loser tree; known[r] is what run r's head shares with the record that last beat it or was
    put out. The head that shares more is the smaller; only at a tie are bytes compared, from there on.
    """
    k = len(runs)
    heads = [next(r, None) for r in runs]
    known = [0] * k

    def beats(x: int, y: int) -> bool:
        """Whether head x comes before head y; the loser learns what it shares with the winner."""
        if heads[x] is None or heads[y] is None:
            return heads[y] is None
        if known[x] != known[y]:
            return known[x] > known[y]
        a, b, n = heads[x][0], heads[y][0], known[x]
        end = min(len(a), len(b))
        while n < end and a[n] == b[n]:
            n += 1
        first = len(a) <= len(b) if n == end else a[n] < b[n]
        known[y if first else x] = n
        return first

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        x, y = build(2 * node), build(2 * node + 1)
        if beats(x, y):
            losers[node] = y
            return x
        losers[node] = x
        return y

    winner = build(1) if k > 1 else 0
    while k and heads[winner] is not None:
        yield winner, known[winner], heads[winner]
        heads[winner] = head = next(runs[winner], None)
        known[winner] = head[1] if head else 0
        node = (winner + k) // 2
        while node:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def matched(group: list[tuple[int, bytes, bytes, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(sender, number, bits) of a group's records (sender, suffix, left, order, number) with strings
    that a smaller order has: bit q for the string that begins q bytes into left + suffix."""
    if len(group) < 2:
        return
    # Of equal records only the one of the smallest order can have strings that are first here.
    least_of: dict[tuple[bytes, bytes], int] = {}
    for _, suffix, left, order, _ in group:
        if least_of.setdefault((left, suffix), order) > order:
            least_of[left, suffix] = order
    bits_of: dict[tuple[bytes, bytes], int] = {}
    if len(least_of) > 1:
        least: dict[bytes, int] = {}
        for (left, suffix), order in least_of.items():
            whole = left + suffix
            for q in range(len(whole) - LENGTH + 1):
                s = whole[q : q + LENGTH]
                if least.setdefault(s, order) > order:
                    least[s] = order
        for key, order in least_of.items():
            whole = key[0] + key[1]
            bits_of[key] = sum(1 << q for q in range(len(whole) - LENGTH + 1) if least[whole[q : q + LENGTH]] < order)
    for sender, suffix, left, order, number in group:
        first = order == least_of[left, suffix]
        bits = bits_of.get((left, suffix), 0) if first else (1 << len(left) + len(suffix) - LENGTH + 1) - 1
        if bits:
            yield sender, number, bits


def splitters(rows: DataFrame, ranges: int) -> tuple[np.ndarray, set[bytes]]:
    """Anchors' substrings that cut their order into about equal ranges, and those of them that fill
    two ranges or more alone. rows: (sender, t). One string in SAMPLE bytes is looked at, a string of
    one sender once, so that copies, which a chunk merges, don't count. Only balance depends on them.
    """
    last, first = F.octet_length("t") - LENGTH, F.pmod(F.xxhash64("t"), F.lit(SAMPLE)).cast("int")
    at = F.when(first <= last, F.sequence(first, last, F.lit(SAMPLE)))
    windows = rows.select("sender", "t", F.explode(at).alias("p")).select("sender", F.col("t").substr(F.col("p") + 1, F.lit(LENGTH)).alias("w")).distinct()

    def substrings(batches):
        for b in batches:
            raw = b"".join(b.column("w").to_pylist())
            start = np.arange(0, len(raw), LENGTH)
            at, *_ = anchors(np.frombuffer(raw, np.uint8), start, start + LENGTH)
            yield pa.RecordBatch.from_pydict({"gram": pa.array([raw[a : a + GRAM] for a in at.tolist()], pa.binary())})

    counted = sum_before(windows.select("w").mapInArrow(substrings, "gram binary").groupBy("gram").agg(F.count("*").alias("n")), ["gram"], "n", "before")
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 1
    filled = F.expr(f"((before + n) * {ranges}) div {total} - (before * {ranges}) div {total}")
    cuts = sorted((bytes(r["gram"]), r["k"]) for r in counted.select("gram", filled.alias("k")).where("k > 0").collect())  # at most one for each range
    return np.array([g for g, _ in cuts], f"S{GRAM}"), {g for g, k in cuts if k > 1}


def cut(docs: DataFrame, text: str = "text", id_col: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    kept: the bytes that remain, as binary (a cut may split a character). Null counts as empty.
    Null ids count as larger than all others; rows with the same id take nothing from each other.
    Texts under LENGTH bytes keep all. What is removed is judged on the input as it was. Ids are
    integers. Other columns are not read.
    """
    size, no_id = F.octet_length(F.col(text).cast("binary")), F.count(F.when(F.col(id_col).isNull(), 1))
    total, nulls = docs.agg(F.coalesce(F.sum(size), F.lit(0)), no_id).first()
    chunks, owners = max(1, -(-total // CHUNK)), max(1, -(-total // 16 // PER_OWNER))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), F.lit(1).cast("long").alias("copies"))
    if nulls:
        # Nothing tells copies without an id apart: they would all be in one chunk. They get one row.
        rows = rows.where("id is not null").union(rows.where("id is null").groupBy("id", "t").agg(F.count("*").alias("copies")))
    base = rows.withColumn("sender", F.pmod(F.xxhash64("id", "t"), F.lit(chunks)))
    splits, frequent = splitters(base, min(chunks, MOST_RANGES)) if chunks > 1 else (np.empty(0, f"S{GRAM}"), set())
    often = np.array(sorted(frequent), f"S{GRAM}")

    def send(key, group):
        c = Chunk(group)
        # A hash counts once for each document: an anchor repeated within one document takes nothing.
        pair = np.unique(np.stack([c.hash, c.order[c.doc]]), axis=1)[0] if len(c.hash) else c.hash
        got = golomb.parcels(pair, owners)
        return pa.table({"sender": pa.array([key[0].as_py()] * len(got), pa.int64()), "owner": pa.array([g[0] for g in got], pa.int32()), "coded": pa.array([g[1] for g in got], pa.binary()), "several": pa.array([g[2] for g in got], pa.binary())})

    bitmaps = golomb.answers(base.groupBy("sender").applyInArrow(send, "sender long, owner int, coded binary, several binary"), owners)

    def runs(key, group, bits):
        c = Chunk(group)
        some = c.shared(owners, dict(zip(bits.column("owner").to_pylist(), bits.column("bitmap").to_pylist(), strict=True)))
        to, coded = [], []
        for owner, part in c.ranges(some, splits):
            run = sorted((suffix, left, int(c.order[c.doc[k]]), k) for (suffix, left), k in c.records(part)[0].items() if suffix[:GRAM] not in frequent)
            if run:
                to.append(owner)
                coded.append(front_coded(run))
        return pa.table({"sender": pa.array([key[0].as_py()] * len(to), pa.int64()), "owner": pa.array(to, pa.int32()), "run": pa.array(coded, pa.binary())})

    sent = base.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInArrow(runs, "sender long, owner int, run binary")

    def merge(group):
        senders = group.column("sender").to_pylist()
        out, same = [], []
        for run, shared, (suffix, _, left, order, number) in merged([decoded(b) for b in group.column("run").to_pylist()]):
            if shared < GRAM:
                out += matched(same)
                same = []
            same.append((senders[run], suffix, left, order, number))
        out += matched(same)
        return pa.table({"sender": pa.array([o[0] for o in out], pa.int64()), "number": pa.array([o[1] for o in out], pa.int32()), "bits": pa.array([o[2] for o in out], pa.int64())})

    replies = sent.groupBy("owner").applyInArrow(merge, "sender long, number int, bits long")
    null = lambda kind: F.lit(None).cast(kind)
    known = bitmaps.select("sender", "owner", "bitmap", null("int").alias("number"), null("long").alias("bits"), null("binary").alias("string"))
    known = known.union(replies.select("sender", null("int"), null("binary"), "number", "bits", null("binary")))
    if frequent:

        def strings(key, group, bits):
            c = Chunk(group)
            some = c.shared(owners, dict(zip(bits.column("owner").to_pylist(), bits.column("bitmap").to_pylist(), strict=True)))
            least = c.strings(c.records(some[np.isin(c.grams(some), often)])[0])
            return pa.table({"sender": pa.array([key[0].as_py()] * len(least), pa.int64()), "string": pa.array(list(least), pa.binary()), "least": pa.array(list(least.values()), pa.int64())})

        own = written(base.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInArrow(strings, "sender long, string binary, least long"), "strings")
        first = own.groupBy("string").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1")
        known = known.union(own.join(first, "string").where("first < least").select("sender", null("int"), null("binary"), null("int"), F.col("first"), "string"))

    def apply(key, group, known):
        c = Chunk(group)
        is_reply = known.column("number").is_valid()
        sent_back = known.filter(known.column("bitmap").is_valid())
        bitmaps = dict(zip(sent_back.column("owner").to_pylist(), sent_back.column("bitmap").to_pylist(), strict=True))
        got = known.filter(is_reply)
        bits = np.zeros(len(c.at) + 1, np.int64)
        bits[got.column("number").to_numpy()] = got.column("bits").to_numpy()
        some = c.shared(owners, bitmaps)
        best = np.arange(len(c.at))
        for _, part in c.ranges(some, splits):
            best[part] = c.records(part)[1]
        if frequent:
            distinct = c.records(some[np.isin(c.grams(some), often)])[0]
            least, told = c.strings(distinct), known.filter(known.column("string").is_valid())
            least.update(zip(told.column("string").to_pylist(), told.column("bits").to_pylist(), strict=True))
            for (suffix, left), k in distinct.items():
                whole = left + suffix
                bits[k] = sum(1 << q for q in range(len(whole) - LENGTH + 1) if least[whole[q : q + LENGTH]] < c.order[c.doc[k]])
        removed = c.removed(some, best[some], bits)
        data, rows = np.frombuffer(c.raw, np.uint8), []
        for i, s, e, copies in zip(c.ids, c.start.tolist(), c.end.tolist(), c.copies, strict=True):
            r = removed[s:e]
            kept = data[s:e][~r].tobytes()
            rows.append((i, e - s, int(r.sum()), int(np.count_nonzero(r[1:] & ~r[:-1]) + (len(r) > 0 and r[0])), hashlib.sha256(kept).hexdigest(), copies, kept if keep_text else None))
        cols = {"doc_id": pa.array([r[0] for r in rows], pa.int64())} | {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in ((1, "n_bytes"), (2, "n_removed"), (3, "n_spans"))} | {"kept_sha256": pa.array([r[4] for r in rows], pa.string()), "copies": pa.array([r[5] for r in rows], pa.int64())}
        return pa.table(cols | ({"kept": pa.array([r[6] for r in rows], pa.binary())} if keep_text else {}))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, copies long" + (", kept binary" if keep_text else "")
    out = base.groupBy("sender").cogroup(known.groupBy("sender")).applyInArrow(apply, schema)
    if nulls:
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.drop("copies")
