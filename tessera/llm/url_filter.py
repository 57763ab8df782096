"""URL filter: rules by host and path, and a ratio of character language models for the rest.

Two variable-order Markov models of characters, one of accepted and one of rejected URLs,
give the log-likelihood of a URL. Their difference, divided by the URL's length, is
compared with a threshold that is calibrated on labelled URLs which trained neither.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Longest n-gram, and the strength with which a shorter context backs a longer one.
ORDER, STRENGTH = 6, 2.0
#: Bits of a character in a packed n-gram (256 byte values, the start and the end), keys that are broadcast before a join, and the unit of scores: sums of whole units don't depend on their order.
BITS, HEAD, UNIT = 9, 4096, float(1 << 32)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str = "/"


#: The production rules.
RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.host + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _windows(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every character, the end included, with the ORDER - 1 before it, packed in a long; and each one's URL."""
    if not urls:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = np.array([len(u) + 1 for u in urls])
    text = np.frombuffer(b"".join(bytes(ORDER - 1) + u + b"\0" for u in urls), np.uint8).astype(np.int64)
    ends = np.cumsum(n + ORDER - 1)
    text[ends - 1] = 257
    text[((ends - n - ORDER + 1)[:, None] + np.arange(ORDER - 1)).ravel()] = 256
    owner = np.repeat(np.arange(len(urls)), n)
    at = np.arange(len(owner)) + (owner + 1) * (ORDER - 1)
    return reduce(np.bitwise_or, [text[at - k] << BITS * k for k in range(ORDER)]), owner


def _keys(w: Column) -> Column:
    """The n-grams that end a window and their contexts, each order's; the number of the kind stands above the characters."""
    gram = lambda k: w.bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))
    kind = lambda t, x: x.bitwiseOR(F.lit(t << BITS * ORDER))
    return F.array(*[kind(k, gram(k)) for k in range(ORDER)], *[kind(ORDER + k, F.shiftright(gram(k), BITS)) for k in range(ORDER)])


def _looked_up(rows: DataFrame, found: DataFrame, key: str, heat: str) -> DataFrame:
    """rows joined with found, which has every key once and in heat its number of rows.

    The HEAD keys of most rows are broadcast. Any other has less than 1 / HEAD of the rows.
    """
    head = found.orderBy(F.desc(heat), key).limit(HEAD).drop(heat)
    rest = rows.join(F.broadcast(head.select(key)), key, "left_anti").join(found.drop(heat), key)
    return rows.join(F.broadcast(head), key).unionByName(rest)


def _counted(addresses: DataFrame, sums: list[str]) -> DataFrame:
    """(w, sums): each window's occurrences in all addresses, weighted by these columns; each batch's sums before the shuffle."""

    def run(batches):
        for b in batches:
            w, owner = _windows(b.column("u").to_pylist())
            w, at = np.unique(w, return_inverse=True)
            by = [np.bincount(at, b.column(c).to_numpy()[owner], len(w)).astype(np.int64) for c in sums]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), *[pa.array(x) for x in by]], ["w", *sums])

    kinds = ", ".join(f"{c} long" for c in sums)
    return addresses.select("u", *sums).mapInArrow(run, f"w long, {kinds}").groupBy("w").agg(*[F.sum(c).alias(c) for c in sums])


@dataclass(frozen=True)
class UrlModel:
    """counts (key, rejected, accepted): exact, one row for each n-gram and each context that was seen."""

    counts: DataFrame
    threshold: float = 0.0

    def ratio(self, urls: list[str]) -> np.ndarray:
        """Length-normalised log-likelihood under the accepted minus that under the rejected."""
        if not urls:
            return np.empty(0)
        rows = self.counts.sparkSession.createDataFrame([(u.encode(),) for u in urls], "u binary")
        got = {bytes(r["u"]): r["ratio"] for r in _scored(_addresses(rows.withColumn("ok", F.lit(None).cast("boolean"))), self.counts).collect()}
        return np.array([got[u.encode()] for u in urls])


def _addresses(rows: DataFrame) -> DataFrame:
    """Each address (u) once, with its rows of each class and of all, and whether it is kept aside for calibration."""
    ok = F.col("ok")
    each = rows.groupBy("u").agg(F.count_if(~ok).alias("rejected"), F.count_if(ok).alias("accepted"), F.count("*").alias("n_rows"))
    return written(each.select(F.monotonically_increasing_id().alias("uid"), "*", (F.pmod(F.xxhash64("u"), F.lit(5)) == 0).alias("aside")), "addresses")


def _learnt(addresses: DataFrame) -> DataFrame | None:
    """A model's counts from all labelled addresses that aren't kept aside; None unless both classes occur."""
    seen = _counted(addresses.where("not aside and rejected + accepted > 0"), ["rejected", "accepted"])
    each = seen.select(F.explode(_keys(F.col("w"))).alias("key"), "rejected", "accepted")
    counts = written(each.groupBy("key").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted")), "grams")
    return counts if counts.where((F.col("key") == ORDER << BITS * ORDER) & (F.col("rejected") > 0) & (F.col("accepted") > 0)).count() else None


def _scored(addresses: DataFrame, counts: DataFrame) -> DataFrame:
    """addresses with ratio.

    What a character adds depends only on its window. It is found once for each window, from
    the counts of the window's n-grams and contexts, and then added up for each address.
    """
    windows = written(_counted(addresses.withColumn("n", F.lit(1).cast("long")), ["n"]), "windows")
    each = windows.select("w", "n", F.explode(_keys(F.col("w"))).alias("key"))
    known = each.groupBy("key").agg(F.count("*").alias("heat")).join(counts, "key", "left")
    known = written(known.select("key", "heat", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rejected", "accepted")]), "known")
    x = F.sort_array(F.collect_list(F.struct("key", "rejected", "accepted")))  # by kind
    found = _looked_up(each, known, "key", "heat").groupBy("w", "n").agg(x.alias("x"))

    def log(c: str) -> Column:
        p = F.lit(1 / 256)
        for k in range(ORDER):
            p = (F.get("x", F.lit(k))[c] + STRENGTH * p) / (F.get("x", F.lit(ORDER + k))[c] + STRENGTH)
        return F.log(p)

    scores = written(found.select("w", "n", F.round((log("accepted") - log("rejected")) * UNIT).cast("long").alias("units")), "scores")

    def run(batches):
        for b in batches:
            w, owner = _windows(b.column("u").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(b.column("uid").to_numpy()[owner]), pa.array(w, pa.int64())], ["uid", "w"])

    each = addresses.select("uid", "u").mapInArrow(run, "uid long, w long")
    sums = _looked_up(each, scores, "w", "n").groupBy("uid").agg(F.sum("units").alias("units"))
    return written(addresses.join(sums, "uid").withColumn("ratio", F.col("units") / UNIT / (F.length("u") + 1)).drop("units"), "ratios")


def _address(url: Column) -> Column:
    """What the models read: all after the scheme, A-Z lower-cased; empty for null."""
    return F.translate(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""), UPPER, LOWER)


def train(labelled: DataFrame, url: str = "url", verdict: str = "verdict") -> UrlModel | None:
    """Count the n-grams of all labelled URLs; null verdicts are skipped.

    A fifth of the URLs, chosen by their hash, only calibrates the threshold: the one with the
    least mean of the two classes' error rates. None unless both classes occur.
    """
    rows = labelled.where(F.col(verdict).isin("allow", "block")).select(_address(F.col(url)).cast("binary").alias("u"), (F.col(verdict) == "allow").alias("ok"))
    addresses = _addresses(rows)
    counts = _learnt(addresses)
    return None if counts is None else UrlModel(counts, _threshold(_scored(addresses.where("aside"), counts)))


def _threshold(scored: DataFrame) -> float:
    """The ratio that parts the labelled addresses kept aside best."""
    bins = scored.where("aside and rejected + accepted > 0").groupBy(F.least(F.greatest(F.round(F.col("ratio") * 100), F.lit(-500)), F.lit(500)).cast("int").alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).orderBy("bin").collect()
    a, r = np.array([x["a"] for x in bins], float), np.array([x["r"] for x in bins], float)
    if not a.sum() or not r.sum():
        return 0.0
    wrong = [(a[:i].sum() / a.sum() + r[i:].sum() / r.sum(), i) for i in range(len(bins) + 1)]
    at = min(wrong)[1]
    # Any threshold between the bins on both sides of the split is as good: 0 if it lies there, else the middle.
    low = (bins[at - 1]["bin"] + 0.5) / 100 if at else -np.inf
    high = (bins[at]["bin"] - 0.5) / 100 if at < len(bins) else np.inf
    return float(0.0 if low <= 0 <= high else high if low == -np.inf else low if high == np.inf else (low + high) / 2)


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) of every row.

    The rules' own verdicts are the labels that the models learn from; rows that no rule
    fits get the models' verdict. Null URLs and those without :// have empty host and path,
    no rule, and are judged as empty addresses or as they are. Repeated rows get equal verdicts.
    Without both kinds of labels everything else is allowed.
    """
    host, path = parts(F.col(url))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), _address(F.col(url)).cast("binary").alias("u"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", "u", rule.alias("rule"), verdict.alias("by_rule"))
    addresses = _addresses(base.select("u", (F.col("by_rule") == "allow").alias("ok")))
    counts = _learnt(addresses)
    if counts is None:
        return base.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("ratio"))
    scored = _scored(addresses, counts)
    judged = _looked_up(base, scored.select("u", "n_rows", "ratio"), "u", "n_rows")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("ratio") >= _threshold(scored), "allow").otherwise("block")).alias("verdict"), "ratio")
