"""Toxicity: maximum-scoring segments of token log-odds, calibrated as extreme values.

1. The numbers of toxic and clean labelled texts that have a token give its log-odds, with
   an informative Dirichlet prior: PRIOR times what both classes have of it. A token scores
   the bound of its log-odds that is nearer to 0; not significant ones score GAP, a small cost.
2. A linear-time scan (Ruzzo and Tompa) over a text's token scores finds all disjoint
   maximal segments.
3. Maximal segment scores of clean texts of n tokens follow an extreme-value law: its rate
   and K are fitted on the tail that clean labelled texts show which gave no counts. A segment's E-value is
   K n exp(-rate S); those below E_MAX are significant. A text's evidence is the sum over
   its significant segments of -log10 E, and a logistic curve, fitted on the same rows,
   turns it into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TOKEN = re.compile(r"[^\W_]+")
PRIOR, GAP, Z_MIN, Z_BOUND, E_MAX = 0.05, -0.08, 2.5, 1.0, 0.1
#: Bound: labelled ids of each class, by the smallest hash, that are learnt from.
PER_CLASS = 30_000
#: Bins of evidence, in its logarithm's units, in which the calibration rows are counted.
BINS = 64


def segments(at: list[int], score: list[float], gap: float = GAP) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments, as (score, first token, last token).

    at: positions of the tokens whose score isn't gap, in order; score: their scores.
    One pass; each candidate is stacked and merged at most once.
    """
    stack: list[tuple[int, int, float, float]] = []  # first, last, total before it, total with it
    total, before = 0.0, -1
    for p, s in zip(at, score, strict=True):
        total += gap * (p - before - 1)
        before = p
        if s <= 0:
            total += s
            continue
        first, last, left, right = p, p, total, total + s
        total = right
        while True:
            # The nearest candidate to the left that begins at a lower total.
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, last, left, right))
    return [(right - left, first, last) for first, last, left, right in stack]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    rate: float
    k: float
    slope: float
    offset: float

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Significant passages as (first token, last token, E-value), and the number of tokens."""
        get, at, score = self.weights.get, [], []
        tokens = TOKEN.findall(text.lower())
        for i, w in enumerate(tokens):
            s = get(w)
            if s is not None:
                at.append(i)
                score.append(s)
        found = []
        for s, first, last in segments(at, score):
            e = self.k * len(tokens) * np.exp(-self.rate * s)
            if e < E_MAX:
                found.append((first, last, max(float(e), 1e-300)))
        return found, len(tokens)

    def evidence(self, text: str) -> float:
        return -sum(np.log10(e) for _, _, e in self.passages(text)[0])

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.offset, -30, 30)))


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """(token, toxic, clean): texts that have the token, over all rows, summed in each task before they are shuffled."""

    def run(batches):
        for b in batches:
            n = Counter(), Counter()
            for t, y in zip(b.column("__text"), b.column("__y").to_pylist(), strict=True):
                n[y].update(set(TOKEN.findall((t.as_py() or "").lower())))
            keys = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_pydict({"token": pa.array(keys, pa.string()), "toxic": pa.array([n[1][k] for k in keys], pa.int64()), "clean": pa.array([n[0][k] for k in keys], pa.int64())})

    per_batch = docs.select(F.col(text).alias("__text"), F.col("__y")).mapInArrow(run, "token string, toxic long, clean long")
    return per_batch.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def token_weights(docs: DataFrame, text: str = "text", prior: float = PRIOR, z_min: float = Z_MIN) -> dict[str, float]:
    """Log-odds of all tokens that tell classes apart, from rows with ``__y`` 0 or 1; they are in the texts of a bounded sample."""
    counts = _counts(docs, text).persist()
    n = counts.agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).first()
    a, b = float(n["a"] or 0), float(n["b"] or 0)
    if not a or not b:
        counts.unpersist()
        return {}
    p, all_p = F.lit(prior) * (F.col("toxic") + F.col("clean")), prior * (a + b)
    up, down = F.col("toxic") + p, F.col("clean") + p
    delta, error = F.log(up / (a + all_p - up)) - F.log(down / (b + all_p - down)), F.sqrt(1 / up + 1 / down)
    scored = counts.select("token", (delta - F.signum(delta) * F.least(Z_BOUND * error, F.abs(delta))).alias("d"), (delta / error).alias("z"))
    kept = scored.where(F.abs("z") >= z_min).collect()
    counts.unpersist()
    return {r["token"]: float(r["d"]) for r in kept}


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """docs with ``__y``, for the per_class labelled rows of either class with the smallest hash.

    The sample of ids has at most 2 * per_class rows, whatever the tables' sizes, and so is
    broadcast. An id with several labels counts as toxic if one of them says so.
    """
    of = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("__y"))
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic"))
    ids = [of.where(F.col("__y") == y).orderBy(key, "doc_id").limit(per_class) for y in (0, 1)]
    return docs.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> ToxicityModel | None:
    """Counts from three quarters of the sampled rows, calibration on the rest; None without both classes.

    Null and empty texts have no tokens. Rows that repeat an id count as often as they stand;
    what reaches the driver are tokens, sums and counts, however many they are.
    """
    rows = sample(docs.select("doc_id", F.col(text).alias("text")), labels)
    calibration = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(4)) == 3
    weights = token_weights(rows.where(~calibration))
    if not weights:
        return None

    def run(batches):
        for b in batches:
            best, n = [], []
            for t in b.column("text"):
                tokens = TOKEN.findall((t.as_py() or "").lower())
                hits = [(i, weights[w]) for i, w in enumerate(tokens) if w in weights]
                best.append(max((s for s, _, _ in segments([i for i, _ in hits], [s for _, s in hits])), default=0.0))
                n.append(len(tokens))
            yield pa.RecordBatch.from_pydict({"best": pa.array(best, pa.float64()), "n": pa.array(n, pa.int64())})

    held = rows.where(calibration).select("text", "__y").cache()
    clean = held.where("__y = 0").mapInArrow(run, "best double, n long")
    c = clean.agg(F.count_if(F.col("best") > 0).alias("hits"), F.sum(F.greatest(F.col("best"), F.lit(0.0))).alias("scores"), F.sum(F.greatest(F.col("n"), F.lit(1))).alias("tokens")).first()
    rate, k = _extreme_value(c["hits"], c["scores"] or 0.0, c["tokens"] or 0)
    fitted = ToxicityModel(weights, rate, k, 1.0, 0.0)

    def evidence(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"y": b.column("__y"), "x": pa.array([float(np.log1p(fitted.evidence(t.as_py() or ""))) for t in b.column("text")], pa.float64())})

    binned = held.mapInArrow(evidence, "y int, x double").groupBy("y", F.floor(F.col("x") * BINS).alias("bin")).agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    bins = binned.orderBy("y", "bin").collect()  # a few thousand: x is a logarithm
    held.unpersist()
    slope, offset = _logistic(np.array([b["x"] for b in bins]), np.array([b["y"] for b in bins], float), np.array([b["n"] for b in bins], float))
    return ToxicityModel(weights, rate, k, slope, offset)


def _extreme_value(hits: int, scores: float, tokens: int) -> tuple[float, float]:
    """Rate and K of P(S > x) = 1 - exp(-K n exp(-rate x)), from the clean texts with any positive
    segment: the rate from their mean score (one more of score 1 is added), K from their number."""
    return (hits + 1) / (scores + 1), (hits + 0.5) / max(tokens, 1)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small ridge; n: rows that a point stands for."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (n * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, passages) of every row's whole text.

    passages: first and last token and E-value of each significant toxic passage. Null and
    empty texts have none and get the score of no evidence; without a model scores are 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tokens of a bounded sample of rows
    passage = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("e_value", pa.float64())]))

    def run(batches):
        model = shared.value
        for b in batches:
            found = [model.passages(t.as_py() or "")[0] if model else [] for t in b.column("__text")]
            evidence = np.array([-sum(np.log10(e) for _, _, e in f) for f in found])
            p = model.probability(evidence) if model else np.zeros(len(found))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("__id"), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32)),
                "passages": pa.array([[{"first": i, "last": j, "e_value": e} for i, j, e in f] for f in found], passage),
                **({"held_out": b.column("__held")} if "__held" in b.schema.names else {}),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    held = "__held_out" in docs.columns
    schema = f"doc_id {kind}, score double, predicted int, passages array<struct<first:int,last:int,e_value:double>>" + (", held_out boolean" if held else "")
    return docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"), *([F.col("__held_out").alias("__held")] if held else [])).mapInArrow(run, schema)
