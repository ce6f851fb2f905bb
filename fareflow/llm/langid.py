"""Language identification by a byte convolutional network.

A window of ``window`` bytes goes through filters of several widths over its one-hot bytes, a rectifier, a maximum over all
places of the window, and a softmax over the languages. Since a filter on one-hot bytes is a sum of table rows, a layer
is a few look-ups a byte. Training (Adam, in numpy) takes windows of at most ``train_rows`` labelled documents of each
language, those with the smallest hash of their id, a stretch of ``max_chars`` of each; where languages are so many that this makes
more than ``train_rows_in_all``, each lends fewer. Every language that a document is labelled with can be predicted.

Prediction covers every text whole: fixed-length windows side by side, the last one shifted back to end with the text and
weighted by the bytes it adds, batched over texts; a text's logits are the weighted mean of its windows'. Letters are
lower-cased for both, and digits and marks become blanks, so junk around words doesn't matter.

A map over bounded Arrow batches. The sample takes two passes over ids and languages and one over texts, whatever the number of
languages. ``und`` with score 0 for null texts and texts without a letter; a model without any training text knows no language
and says ``und`` throughout. Repeated rows are predicted alike; an empty table gives an empty result; columns other than id and text
are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_mod, durable, slices, table

_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> np.ndarray:
    """Lower-cased UTF-8 bytes; ASCII that is no letter is a blank."""
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN), np.uint8)


class Network:
    """Tables: for each width w, (w, 256, filters); then a linear layer on the maxima."""

    def __init__(self, languages: list[str], widths: tuple[int, ...], filters: int, window: int, seed: int):
        rng = np.random.default_rng(seed)
        self.languages, self.widths, self.filters, self.window = languages, widths, filters, window
        self.tables = [(0.3 * rng.standard_normal((w, 256, filters))).astype(np.float32) for w in widths]
        self.out = np.zeros((len(widths) * filters + 1, len(languages)), np.float32)

    def maxima(self, x: np.ndarray, places: bool = False):
        """x: (windows, window) bytes, 0 beyond the text. The filters' maxima, rectified; on demand where they are."""
        best, where = [], []
        for w, t in zip(self.widths, self.tables):
            n = x.shape[1] - w + 1
            h = t[0][x[:, :n]]
            for k in range(1, w):
                h += t[k][x[:, k : n + k]]
            if places:
                at = h.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(h, at[:, None], 1)[:, 0])
            else:
                best.append(h.max(axis=1))
        best = np.maximum(np.hstack(best), 0)
        return (best, where) if places else best

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.maxima(x) @ self.out[:-1] + self.out[-1]

    def windows(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and weight of each window of a text."""
        n = len(b)
        if n <= self.window:
            return np.zeros(1, np.int64), np.ones(1)
        starts = np.arange(0, n, self.window)
        added = np.minimum(self.window, n - starts)
        return np.minimum(starts, n - self.window), added / n

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known:
            return labels, scores
        parts, of, weight = [], [], []
        for i in known:
            b = plain(texts[i])
            starts, w = self.windows(b)
            if len(b) < self.window:
                b = np.pad(b, (0, self.window - len(b)))
            parts.append(np.lib.stride_tricks.sliding_window_view(b, self.window)[starts])
            of.append(np.full(len(starts), i))
            weight.append(w)
        x, of, weight = np.concatenate(parts), np.concatenate(of), np.concatenate(weight)
        total = np.zeros((len(texts), len(self.languages)))
        for k in range(0, len(x), batch):
            np.add.at(total, of[k : k + batch], self.logits(x[k : k + batch]) * weight[k : k + batch, None])
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i in known:
            best = int(p[i].argmax())
            labels[i], scores[i] = self.languages[best], float(p[i, best])
        return labels, scores

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> None:
        """Softmax cross-entropy by Adam; only the place of a filter's maximum gets a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.out]
        first, second, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                xb, m = x[rows], len(rows)
                h, where = self.maxima(xb, places=True)
                z = h @ self.out[:-1] + self.out[-1]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(m), y[rows]] -= 1
                p /= m
                back = (p @ self.out[:-1].T) * (h > 0)
                grads = []
                for i, w in enumerate(self.widths):
                    g, own = np.zeros_like(self.tables[i]), back[:, i * self.filters : (i + 1) * self.filters]
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(xb, where[i] + k, 1), np.arange(self.filters)), own)
                    grads.append(g)
                grads.append(np.vstack([h.T @ p, p.sum(axis=0)]) + 1e-4 * self.out)
                turn += 1
                for q, g, a, b in zip(params, grads, first, second):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-8)


def train(texts: list[str], labels: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, window: int = 256, per_text: int = 4, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 17) -> Network:
    net = Network(sorted(set(labels)), widths, filters, window, seed)
    rng, x, y = np.random.default_rng(seed), [], []
    for text, label in zip(texts, labels):
        b = plain(text or "")
        if not len(b) or not _LETTER.search(text):
            continue
        for start in rng.integers(0, max(1, len(b) - window + 1), min(per_text, 1 + len(b) // window)):
            # now and then a short window, as short texts will be met too
            size = window if rng.random() < 0.7 else int(rng.integers(8, window))
            part = b[start : start + size]
            x.append(np.pad(part, (0, window - len(part))))
            y.append(net.languages.index(label))
    if x:
        net.fit(np.stack(x), np.array(y), epochs, batch, rate, seed)
    return net


def labelled_sample(docs: DataFrame, may_learn: Column | None, train_rows: int, train_rows_in_all: int, max_chars: int) -> tuple[list[str], list[str]]:
    """Texts and languages: of each language the documents with the smallest hash of their id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = known if may_learn is None else known.where(may_learn)
    ids = known.select("lang", "doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id"), 1).alias("h"))
    # About how many there are of each language says which hashes are worth ranking: twice as many as are wanted, and some.
    sizes = durable(ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")))
    languages = sizes.count()
    each = max(1, min(train_rows, train_rows_in_all // max(1, languages)))
    near = ids.join(F.broadcast(sizes) if languages <= 10_000 else sizes, "lang").where(F.col("h") <= F.least(F.lit(1.0), (2 * each + 64) / F.col("n")) * F.lit(float(1 << 63))).dropDuplicates(["lang", "doc_id"])
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    few = near.withColumn("place", place).where(F.col("place") <= each).select("lang", "doc_id")  # train_rows_in_all rows at most, or one a language
    # a text lends a stretch of max_chars, from anywhere in it
    at = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.greatest(F.lit(1), F.length("text") - max_chars)).cast("int") + 1
    got = known.where("text is not null").join(F.broadcast(few), ["lang", "doc_id"]).select("lang", "doc_id", F.substring("text", at, F.lit(max_chars)).alias("t")).collect()
    got = sorted((r["lang"], r["doc_id"], r["t"]) for r in got)
    return [t for *_, t in got], [lang for lang, *_ in got]


def fitted(docs: DataFrame, may_learn: Column | None = None, train_rows: int = 600, train_rows_in_all: int = 60_000, max_chars: int = 2000) -> Network:
    return train(*labelled_sample(docs.select("doc_id", "text", "lang"), may_learn, train_rows, train_rows_in_all, max_chars))


def identify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in slices(batches, text_col, 1 << 20):
            labels, scores = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(labels), pa.array(scores)], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fitted(docs, crc32_mod("doc_id", 5) != 0)
    return identify(docs, network).select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
