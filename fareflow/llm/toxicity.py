"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

*Kernel.* Words are strings of letters behind a boundary mark; marks of punctuation inside a word are dropped and runs
of three or more single letters are joined, so ``i.d.i.o.t`` and ``i d i o t`` read as one word. The kernel counts
common subsequences of three symbols, each weighing ``decay`` to the power of the symbols it skips, up to a span of
``span``, and is normalized: inserted letters cost a word little of its likeness.

*Landmarks.* Words of two letters or more that toxic training documents hold at a much higher rate than others. A sentence's
feature for a landmark is the largest third power of the kernel (a kernel again) between the landmark and one of the
sentence's words, taken as 0 where the kernel is below ``least``; the Nyström map multiplies by the inverse root of the landmarks' own kernel matrix.
``least`` lies below the kernel of a word of four letters with one more put inside (0.56). The third power of such a kernel says little, so
a word that is a landmark with letters put between its own, one for each four, has the landmark's features, unless a clean training document
holds that word (*scrum* is not *scum*).

*Machine.* A linear support vector machine (squared hinge, solved by Newton steps) on sentences. Labels are the documents',
and every sentence with a feature takes its document's: since no landmark is a common word, nearly all sentences of a toxic
document stay out of it. A document scores by its three worst sentences or by its worst one alone, through a logistic curve
each; the higher score counts, so one clear insult is enough.

*Pruning.* The largest landmark weight of each three-symbol code gives an upper bound of any landmark's kernel with a word
from sums alone, for all words at once in numpy; only words whose bound reaches ``least`` are looked at closely, first by the same bound for groups of similar landmarks, and the
others' features are exactly zero. So nearly all text costs a few table look-ups a character.

Training takes at most ``train_positive`` and ``train_negative`` labelled documents (those with the smallest hash of their
id, none above ``max_text_bytes``, and of each kind as many as ``max_bytes`` hold), a bound that doesn't grow with the input; scoring covers
every document, whole. It is a map over bounded Arrow
batches. Null and empty texts score what a text without any suspicious word scores. Without labels of both kinds, or
without any word that tells them apart, every score is 0. Where labels repeat, the larger one counts. Repeated rows score alike; an
empty table gives an empty result. ``score_documents`` looks at id and text alone; ``without_toxic`` leaves all columns as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_mod, slices, table

SKIP = 255
#: Sentences that a document's score looks at.
WORST = 3
#: Landmarks that a word is held against at once before it is held against each.
GROUP = 8
_WORD = re.compile(r"[^\W\d_]+")


def _symbols() -> np.ndarray:
    """Code points to 0 (blank), 1 to 26 (a to z), 27 to 58 (other letters), 59 (digits) or SKIP."""
    to = np.full(0x250, SKIP, np.uint8)
    for c in range(0x250):
        x = chr(c)
        if x.isspace():
            to[c] = 0
        elif "a" <= x <= "z":
            to[c] = c - 96
        elif x.isalpha():
            to[c] = 27 + c % 32
        elif x.isdigit():
            to[c] = 59
    return to


SYMBOLS = _symbols()


def symbols(low: str) -> np.ndarray:
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = SYMBOLS[np.minimum(points, 0x24F)]
    if len(points) and points.max() >= 0x250:
        far = points >= 0x250
        out[far] = np.where((points[far] >= 0x2000) & (points[far] < 0x2E80), SKIP, 27 + points[far] % 32)
    return out


class Kernel:
    def __init__(self, span: int = 6, decay: float = 0.6):
        self.steps = [(a, b, np.float32(decay ** (b - 2))) for b in range(2, span) for a in range(1, b)]

    def norm_floor(self, lengths: np.ndarray) -> np.ndarray:
        """No word of this length (mark included) has a smaller norm."""
        return np.sqrt(sum(float(w) ** 2 * np.maximum(lengths - b, 0) for _, b, w in self.steps))

    def features(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, values) of a word, with values of norm one."""
        w = word.astype(np.int64)
        codes = [w[: len(w) - b] << 12 | w[a : len(w) - b + a] << 6 | w[b:] for a, b, _ in self.steps if len(w) > b]
        if not codes:
            return np.empty(0, np.int64), np.empty(0)
        values = [np.full(max(0, len(w) - b), v) for _, b, v in self.steps]
        codes, at = np.unique(np.concatenate(codes), return_inverse=True)
        phi = np.bincount(at, weights=np.concatenate(values))
        return codes, phi / np.sqrt(phi @ phi)


def spelled(word: str) -> bytes:
    """A word as the scan sees it: behind a boundary mark."""
    s = symbols(word)
    return b"\0" + s[s != SKIP].tobytes()


def gapped(word: bytes, mark: bytes) -> bool:
    """Whether word is mark with letters put between its own, one for each four at most."""
    if not 0 < len(word) - len(mark) <= (len(mark) - 1) // 4 or word[1] != mark[1] or word[-1] != mark[-1]:
        return False
    rest = iter(word[:-1])
    return all(c in rest for c in mark[:-1])


class Landmarks:
    """Landmark words as columns over the codes that any of them has. clean: words that don't count as landmarks with letters put inside."""

    def __init__(self, words: list[str], kernel: Kernel, least: float, power: int, clean: frozenset[bytes] = frozenset()):
        self.kernel, self.least, self.power, self.clean = kernel, least, power, clean
        self.words = [spelled(w) for w in words]
        found = [kernel.features(np.frombuffer(w, np.uint8)) for w in self.words]
        used = np.unique(np.concatenate([c for c, _ in found]))
        self.row = np.full(1 << 18, -1, np.int32)
        self.row[used] = np.arange(len(used))
        self.weights = np.zeros((len(used), len(words)), np.float32)
        for j, (codes, values) in enumerate(found):
            self.weights[self.row[codes], j] = values
        self.most = np.zeros(1 << 18, np.float32)
        self.most[used] = self.weights.max(axis=1)
        # Neighbours in the alphabet share most codes, so the largest weights in a group of them bound each one's kernel closely.
        order = sorted(range(len(words)), key=words.__getitem__)
        self.group_most = np.stack([self.weights[:, order[g : g + GROUP]].max(axis=1) for g in range(0, len(order), GROUP)], axis=1)
        own = self.weights.T @ self.weights
        self.own = np.where(own >= least, own**power, 0)
        self.memo: dict[bytes, np.ndarray | None] = {}

    def gram(self) -> np.ndarray:
        """The landmarks' features for each other: the same function as any word's."""
        return self.own.astype(float)

    def look(self, words: list[bytes]) -> None:
        """Put into memo what each new word has: the kernel with each landmark to the power, 0 where the kernel is below least;
        None if all are 0."""
        if len(self.memo) > 200_000:
            self.memo.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        for lo in range(0, len(new), 1024):
            part = new[lo : lo + 1024]
            s = np.frombuffer(b"".join(part), np.uint8).astype(np.int64)
            of = np.repeat(np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part)))
            keys, values = [], []
            for a, b, w in self.kernel.steps:
                n = max(0, len(s) - b)
                inside = np.flatnonzero(of[:n] == of[b:])
                keys.append(of[inside] << 18 | s[inside] << 12 | s[inside + a] << 6 | s[inside + b])
                values.append(np.full(len(inside), w))
            keys, at = np.unique(np.concatenate(keys), return_inverse=True)
            phi, own = np.bincount(at, weights=np.concatenate(values)), keys >> 18
            norm = np.sqrt(np.bincount(own, weights=phi * phi, minlength=len(part)))
            row = self.row[keys & (1 << 18) - 1]
            phi, own, row = phi[row >= 0], own[row >= 0], row[row >= 0]
            self.memo.update(dict.fromkeys(part))
            if not len(own):
                continue
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            bound = np.add.reduceat(phi[:, None].astype(np.float32) * self.group_most[row], starts, axis=0).max(axis=1) / norm[own[starts]]
            near = np.repeat(bound >= self.least - 1e-4, np.diff(starts, append=len(own)))
            phi, own, row = phi[near], own[near], row[near]
            if not len(own):
                continue
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            k = np.add.reduceat(phi[:, None].astype(np.float32) * self.weights[row], starts, axis=0) / norm[own[starts]][:, None].astype(np.float32)
            for i, v in zip(own[starts].tolist(), k):
                if v.max() >= self.least:
                    x = np.where(v >= self.least, v**self.power, 0)
                    for j in np.flatnonzero(v >= self.least) if part[i] not in self.clean else ():
                        if gapped(part[i], self.words[j]):
                            x = np.maximum(x, self.own[j])
                    self.memo[part[i]] = x

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, features) of every sentence with a feature that isn't zero."""
        lows = [(t or "").lower() for t in texts]
        # A line break ends each text; the marks of sentence ends count before a blank.
        of = np.repeat(np.arange(len(lows)), np.fromiter((len(t) + 1 for t in lows), np.int64, len(lows)))
        whole = "\n".join([*lows, ""])
        points = symbols(whole)
        raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = (raw == 46) | (raw == 33) | (raw == 63)
        stops = raw == 10
        stops[1:] |= ends[:-1] & (points[1:] == 0)
        keep = points != SKIP
        sentence = np.cumsum(stops)[keep]
        s, of = points[keep], of[keep]
        if not len(s):
            return np.empty(0, np.int64), np.empty((0, self.weights.shape[1]), np.float32)
        first = np.ones(len(s), bool)
        first[1:] = of[1:] != of[:-1]
        # Each word starts at its blank; the first word of a text gets one.
        at = np.flatnonzero(first)
        s, of, sentence = np.insert(s, at, 0), np.insert(of, at, of[at]), np.insert(sentence, at, sentence[at])
        starts = np.flatnonzero(s == 0)
        single = np.diff(starts, append=len(s)) == 2
        if single.any():
            single &= np.append(False, of[starts][1:] == of[starts][:-1])
            run = single.copy()
            run[1:] &= single[:-1]
            run[2:] &= single[:-2]
            run[:2] = False
            member = run.copy()
            member[:-1] |= run[1:]
            member[:-2] |= run[2:]
            gone = starts[1:][member[1:] & member[:-1]]
            s, of, sentence = np.delete(s, gone), np.delete(of, gone), np.delete(sentence, gone)
            starts = np.flatnonzero(s == 0)
        word = np.cumsum(s == 0, dtype=np.int32) - 1
        wide, total = s.astype(np.int32), np.zeros(len(s), np.float32)
        for b in sorted({b for _, b, _ in self.kernel.steps}):
            n = len(s) - b
            if n <= 0:
                break
            ends_code = wide[:n] << 12 | wide[b:]
            part = np.zeros(n, np.float32)
            for a, _, w in (x for x in self.kernel.steps if x[1] == b):
                part += self.most[ends_code | wide[a : n + a] << 6]
            total[:n] += np.where(word[:n] == word[b:], part * w, 0)
        lengths = np.diff(starts, append=len(s))
        bound = np.add.reduceat(total, starts) >= self.least * self.kernel.norm_floor(lengths)
        rows: dict[int, np.ndarray] = {}
        where: dict[int, int] = {}
        suspects = np.flatnonzero(bound & (lengths > 2)).tolist()
        words = [s[starts[i] : starts[i] + lengths[i]].tobytes() for i in suspects]
        self.look(words)
        for i, w in zip(suspects, words):
            if (k := self.memo[w]) is not None:
                x = int(sentence[min(starts[i] + 1, len(s) - 1)])
                rows[x] = np.maximum(rows[x], k) if x in rows else k
                where[x] = int(of[starts[i]])
        if not rows:
            return np.empty(0, np.int64), np.empty((0, self.weights.shape[1]), np.float32)
        return np.array([where[x] for x in rows]), np.stack(list(rows.values()))


def inverse_root(gram: np.ndarray) -> np.ndarray:
    """The Nyström map. Cut at least, the landmarks' matrix has small eigenvalues about 0 and below: their directions are left out."""
    values, vectors = np.linalg.eigh(gram)
    return vectors * np.where(values > 1e-3, np.maximum(values, 1e-3) ** -0.5, 0) @ vectors.T


def l2_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, turns: int = 30) -> tuple[np.ndarray, float]:
    """Squared hinge loss with weights, by Newton steps on the active rows. y: -1 or 1."""
    x = np.column_stack([x, np.ones(len(x))])
    v, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(turns):
        on = y * (x @ v) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(a.T @ x[on] + np.diag(keep), a.T @ y[on])
        if np.abs(new - v).max() < 1e-6:
            break
        v = new
    return v[:-1], float(v[-1])


def logistic(f: np.ndarray, y: np.ndarray, turns: int = 50) -> np.ndarray:
    """Slopes and shift of the probability of y = 1; targets drawn in a little, as usual."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([f, np.ones(len(f))])
    curve = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(curve)), x.T @ (t - p) - 1e-2 * curve)
        curve = curve + np.clip(step, -5, 5)
    return curve


def choose_landmarks(texts: list[str], y: np.ndarray, most: int) -> list[str]:
    """Words that toxic texts hold at a much higher rate, surest first."""
    def words(text: str | None) -> set[str]:
        return {w for w in _WORD.findall((text or "").lower()) if len(w) >= 2}

    in_pos, in_neg = Counter(), Counter()
    for text in (t for t, label in zip(texts, y) if label):
        in_pos.update(words(text))
    in_pos = Counter({w: n for w, n in in_pos.items() if n >= 2 and len(spelled(w)) > 2})
    for text in (t for t, label in zip(texts, y) if not label):
        in_neg.update(words(text) & in_pos.keys())
    p, n = max(1, int(y.sum())), max(1, int((1 - y).sum()))

    def gain(a: int, b: int) -> float:
        """The likelihood ratio between one rate for each class and one for both."""
        both = (a + b) / (p + n)

        def part(k, m, r):
            return (k * math.log(k / m / r) if k else 0) + ((m - k) * math.log((m - k) / m / (1 - r)) if k < m else 0)

        return part(a, p, both) + part(b, n, both) if 0 < both < 1 else 0.0

    toxic = sorted(((gain(a, in_neg[g]), g) for g, a in in_pos.items() if a >= 2 and a * n > 3 * in_neg[g] * p), reverse=True)
    return [g for v, g in toxic[:most] if v > 8]


def clean_likes(landmarks: list[str], texts: list[str]) -> frozenset[bytes]:
    """Words of clean texts that are a landmark with letters put inside."""
    by_ends: dict[tuple[int, int], list[bytes]] = {}
    for mark in map(spelled, landmarks):
        by_ends.setdefault((mark[1], mark[-1]), []).append(mark)
    words: set[bytes] = set()
    for text in texts:
        for w in set(_WORD.findall((text or "").lower())):
            if not w.isascii() or (ord(w[0]) - 96, ord(w[-1]) - 96) in by_ends:
                words.add(spelled(w))
    return frozenset(w for w in words if len(w) > 1 and any(gapped(w, m) for m in by_ends.get((w[1], w[-1]), ())))


class Model:
    def __init__(self, landmarks: Landmarks | None, v: np.ndarray | None = None, bias: float = 0.0, curve: np.ndarray | None = None):
        self.landmarks, self.v, self.bias, self.curve, self.single = landmarks, v, bias, curve, np.zeros(2)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The margins of each text's worst sentences, worst first."""
        f = np.full((len(texts), WORST), self.bias)
        if self.landmarks:
            at, x = self.landmarks.sentences(texts)
            m = np.maximum(x @ self.v, 0) + self.bias
            order = np.lexsort((-m, at))
            at, m = at[order], m[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            f[at[place < WORST], place[place < WORST]] = m[place < WORST]
        return f

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(texts))
        f = self.margins(texts)
        both = np.maximum(f @ self.curve[:-1] + self.curve[-1], f[:, 0] * self.single[0] + self.single[1])
        return 1 / (1 + np.exp(-np.clip(both, -30, 30)))


def train(texts: list[str], labels: list[int], landmarks: int = 128, least: float = 0.55, power: int = 3, ridge: float = 0.3) -> Model:
    y = np.array(labels, float)
    if not 0 < y.sum() < len(y):
        return Model(None)
    words = choose_landmarks(texts, y, landmarks)
    if not words:
        return Model(None)
    marks = Landmarks(words, Kernel(), least, power, clean_likes(words, [t for t, label in zip(texts, y) if not label]))
    nystrom = inverse_root(marks.gram())
    parts = [(lo, *marks.sentences(texts[lo : lo + 32])) for lo in range(0, len(texts), 32)]
    at, x = np.concatenate([lo + a for lo, a, _ in parts]), np.concatenate([x for _, _, x in parts]) @ nystrom
    bare = np.setdiff1d(np.arange(len(texts)), at)  # texts without any suspicious sentence count as one without features
    xs, ys = np.vstack([x, np.zeros((len(bare), x.shape[1]))]), np.concatenate([y[at], y[bare]])
    balance = np.where(ys == 1, ((1 - ys).sum() / max(1.0, ys.sum())) ** 0.5, 1.0)
    w, b = l2_svm(xs, 2 * ys - 1, balance, ridge)
    model = Model(marks, (nystrom @ w).astype(np.float32), b)
    f = np.concatenate([model.margins(texts[lo : lo + 32]) for lo in range(0, len(texts), 32)])
    model.curve, model.single = logistic(f, y), logistic(f[:, :1], y)
    marks.memo.clear()
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, may_learn: Column | None, train_positive: int, train_negative: int, max_text_bytes: int, max_bytes: int) -> tuple[list[str], list[int]]:
    """Texts and labels, chosen by hash among the labelled documents: a bounded number and size of each kind."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known if may_learn is None else known.where(may_learn)
    known = known.groupBy(F.col("doc_id").alias("_ff_id")).agg(F.max("toxic").alias("_ff_y"))
    order = [F.xxhash64(F.lit(3), "_ff_id"), F.col("_ff_id")]
    few = known.where("_ff_y = 1").orderBy(*order).limit(train_positive).unionAll(known.where("_ff_y = 0").orderBy(*order).limit(train_negative))
    # few has train_positive + train_negative rows at most
    texts = docs.where(F.octet_length("text") <= max_text_bytes).join(F.broadcast(few), F.col("doc_id") == F.col("_ff_id"))
    rows = texts.groupBy("_ff_id").agg(F.min("text").alias("t"), F.max("_ff_y").alias("y"))
    upto = F.sum(F.octet_length("t")).over(W.partitionBy("y").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select("_ff_id", "t", "y")
    got = sorted(rows.toLocalIterator(prefetchPartitions=False), key=lambda r: r["_ff_id"])
    return [r["t"] for r in got], [int(r["y"]) for r in got]


def fitted(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, train_positive: int = 1200, train_negative: int = 2800, max_text_bytes: int = 1 << 20, max_bytes: int = 32 << 20) -> Model:
    return train(*labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), may_learn, train_positive, train_negative, max_text_bytes, max_bytes))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, text_col, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(shared.value.score(batch.column(text_col).to_pylist()))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs that score below limit, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, text_col, 1 << 20):
            yield batch.filter(pa.array(shared.value.score(batch.column(text_col).to_pylist()) < limit))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fitted(docs, labels, crc32_mod("doc_id", 3) != 1)
    found = score_documents(docs, model)
    return found.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
