"""Language identification: a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over a window of WINDOW bytes, each
filter's maximum over the window feeds a softmax over the languages. A text is cut into
consecutive windows, all of them scored; the languages' log-probabilities are averaged,
weighted by the bytes in a window.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: Bounds of the training sample, by the smallest hash: documents for each language and in all. Their whole texts are learnt from.
PER_LANGUAGE, AT_MOST = 300, 3000
#: Batches that training takes at least; every window of the sample is used as often as any other, once or more.
STEPS = 800


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All consecutive windows of all texts as rows of bytes padded by zeros; each row's text and its length."""
    owner, parts = [], []
    for k, t in enumerate(texts):
        for at in range(0, len(t), size):
            owner.append(k)
            parts.append(t[at : at + size])
    length = np.array([len(p) for p in parts], np.int32)
    rows = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in parts), np.uint8).reshape(-1, size)
    return rows, np.array(owner, np.int64), length


@dataclass
class ByteConvNet:
    """Filters of each width, zero-padded to the largest, form one matrix: one product for each position."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    mask: np.ndarray
    langs: list[str]

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> ByteConvNet:
        rng, most, n = np.random.default_rng(seed), max(WIDTHS), FILTERS * len(WIDTHS)
        mask = np.zeros((most, EMBED, n), np.float32)
        for k, w in enumerate(WIDTHS):
            mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        mask = mask.reshape(most * EMBED, n)
        conv = rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask
        return cls(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), conv, np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32), mask, langs)

    def patches(self, rows: np.ndarray) -> np.ndarray:
        """(windows, positions, width * EMBED): the embedded bytes under the filters at each position."""
        e, w = self.embed[rows], max(WIDTHS)
        n, size, d = e.shape
        return np.lib.stride_tricks.as_strided(e, (n, size - w + 1, w * d), (e.strides[0], e.strides[1], e.strides[2])).reshape(-1, w * d)

    def forward(self, rows: np.ndarray):
        p = self.patches(rows)
        z = (p @ self.conv).reshape(len(rows), -1, self.conv.shape[1])
        at = z.argmax(1)
        top = np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.bias
        pooled = np.maximum(top, 0)
        return p, at, top, pooled, _log_softmax(pooled @ self.out + self.out_bias)

    def log_probs(self, rows: np.ndarray, batch: int = 256) -> np.ndarray:
        out = np.empty((len(rows), len(self.langs)), np.float32)
        for i in range(0, len(rows), batch):
            z = (self.patches(rows[i : i + batch]) @ self.conv).reshape(len(rows[i : i + batch]), -1, self.conv.shape[1]).max(1)
            out[i : i + batch] = _log_softmax(np.maximum(z + self.bias, 0) @ self.out + self.out_bias)
        return out

    def fit(self, rows: np.ndarray, label: np.ndarray, length: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteConvNet:
        """Adam on the cross-entropy; the classes weigh alike, and windows of a class by their bytes.
        Gradients flow through the positions of the maxima only."""
        rng, w, d = np.random.default_rng(seed), max(WIDTHS), EMBED
        weight = length / np.maximum(np.bincount(label, length, len(self.langs)), 1)[label]
        epochs = max(1, -(-steps * batch // len(rows)))
        names = ("embed", "conv", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, y = rows[pick], label[pick]
                p, at, top, pooled, lp = self.forward(x)
                g = np.exp(lp)
                g[np.arange(len(y)), y] -= 1
                g *= (weight[pick] / weight[pick].sum())[:, None]
                gp = (g @ self.out.T) * (top > 0)
                span = x.shape[1] - w + 1
                flat = np.arange(len(x))[:, None] * span + at
                got = p[flat]  # (windows, filters, w * d)
                g_conv = np.einsum("nf,nfk->kf", gp, got) * self.mask
                g_got = gp[:, :, None] * self.conv.T[None]
                g_embed = np.zeros_like(self.embed)
                byte = np.concatenate([np.take_along_axis(x, at + j, 1).ravel() for j in range(w)])
                order_b = np.argsort(byte, kind="stable")
                byte = byte[order_b]
                first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
                g_embed[byte[first]] = np.add.reduceat(np.concatenate([g_got[:, :, j * d : (j + 1) * d].reshape(-1, d) for j in range(w)])[order_b], first)
                step += 1
                for k, gr in zip(names, (g_embed, g_conv, gp.sum(0), pooled.T @ g, g.sum(0)), strict=True):
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.99 * v[k] + 0.01 * gr * gr
                    setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
        return self


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", order_by: str = "doc_id", per_language: int = PER_LANGUAGE, at_most: int = AT_MOST) -> ByteConvNet | None:
    """Fit on a bounded sample: of each language the labelled rows of the per_language smallest
    hashes, at_most rows in all, whole texts. Rows with a null text or language, or no letter,
    teach nothing; None if no row is left. Rows that repeat count as often as they stand.

    Which hashes are small is found from ids and languages alone: rows are counted by language and
    by the bits of their hash, so only about twice per_language rows of a language are ranked.
    """
    k = F.shiftrightunsigned(F.xxhash64(F.col(order_by).cast("string"), F.lit("lang")), 1)
    keyed = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), k.alias("k"), F.col(text).alias("t")).withColumn("bits", F.length(F.bin("k")))
    up_to = Window.partitionBy("l").orderBy("bits")
    counts = keyed.groupBy("l", "bits").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(up_to))
    most = F.coalesce(F.min(F.when(F.col("n") >= per_language, F.col("bits"))), F.max("bits"))
    # One row for each language, at_most of them, the most frequent first.
    bound = counts.groupBy("l").agg(most.alias("most"), F.max("n").alias("n")).orderBy(F.col("n").desc(), "l").limit(at_most).select("l", "most")
    near = keyed.join(F.broadcast(bound), "l").where((F.col("bits") <= F.col("most")) & F.col("t").rlike(r"\p{L}")).select("l", "k", "t")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("k", "t"))).where(F.col("r") <= per_language)
    sample = ranked.orderBy("r", "l").limit(at_most).collect()
    if not sample:
        return None
    langs = sorted({s["l"] for s in sample})
    x, owner, length = windows([s["t"].encode() for s in sample])
    y = np.array([langs.index(s["l"]) for s in sample])[owner]
    return ByteConvNet.fresh(langs).fit(x, y, length)


def predict(docs: DataFrame, net: ByteConvNet | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` and 0 where the text is null or has no letter.

    Whole texts are scored, window by window. Nothing but the text decides: repeated rows are
    judged alike, and other columns, whatever their names, are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few kB, whatever the corpus

    def run(batches):
        net = model.value
        for b in batches:
            texts = [t.encode() if t and ok and net else b"" for t, ok in zip(b.column("__text").to_pylist(), b.column("__letters").to_pylist(), strict=True)]
            total = np.zeros((len(texts), len(net.langs) if net else 1))
            start = 0
            while start < len(texts) and net:  # so many texts at a time that the windows stay few
                end, size = start, 0
                while end < len(texts) and (end == start or size < 2_000_000):
                    size += len(texts[end])
                    end += 1
                x, owner, length = windows(texts[start:end])
                if len(x):
                    lp = net.log_probs(x) * length[:, None]
                    for c in range(lp.shape[1]):
                        total[start:end, c] += np.bincount(owner, lp[:, c], end - start)
                start = end
            size = np.array([max(len(t), 1) for t in texts])
            p = np.exp(_log_softmax(total / size[:, None]))
            best = p.argmax(1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("__id"),
                "lang_pred": pa.array([net.langs[k] if t else "und" for k, t in zip(best, texts, strict=True)], pa.string()),
                "score": pa.array(np.where([len(t) > 0 for t in texts], p.max(1), 0.0), pa.float64()),
                **({"held_out": b.column("__held")} if "__held" in b.schema.names else {}),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    held = "__held_out" in docs.columns
    cols = [F.col(id_col).alias("__id"), F.col(text).alias("__text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters")]
    return docs.select(*cols, *([F.col("__held_out").alias("__held")] if held else [])).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double" + (", held_out boolean" if held else ""))
