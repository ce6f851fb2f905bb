"""SimHash near-duplicates by vantage-point trees.

A fingerprint has 64 bits; two link when at most ``radius`` bits differ, and linked ones form components.

*Partition.* The 64 bits are cut into blocks, each with a reach of its own such that fingerprints within ``radius`` of each
other lie within the reach of at least one block: reaches and the number of blocks sum up to more than ``radius`` (``cover``:
reaches 1, 0, 0, 0 for radius 4). Each block has a vantage-point tree over the Hamming distance of its bits: a node has a
vantage point and a boundary, near ones inside and far ones outside. Vantage points are fingerprints of a bounded sample
(``sample`` rows with the smallest hash): a node takes the one of three, and the boundary, that leave the fewest pairs in its
two halves: the median where nothing overlaps. Nodes deeper than the sample reaches take seeded points and the middle distance.

*Prune.* By the triangle inequality a partner within the reach of x can lie on the other side of a node only if x's distance to
the vantage point is within the reach of the boundary. So x goes to its own side alone, or, when it is outside but within reach
of the boundary, also to the inside: any pair within reach then meets in some leaf (of two points that a node parts, the outer
one follows the inner). Trees of reach 0 have no overlap.

*Query.* A leaf's fingerprints, and those that overlap into it, are compared exactly (popcounts in numpy blocks), and only a
spanning forest of the links found leaves the task: at most one edge for each fingerprint. The edges' connected
components (large and small stars) are the result.

Scale: exact copies collapse to one fingerprint before anything else. Trees are a few thousand nodes. Depth follows the number n
of distinct fingerprints without a bound, and so do the widths of the blocks; the rows that trees hold grow like n to the
power 1.2 or so (a tree of reach 1 over 31 bits repeats about a seventh of its rows at each level). A leaf with more than ``per_cell``
members (a large group of near copies) is cut into salted parts which meet pair by pair in separate tasks, so no task ever holds
more than two parts. Links and components never reach the driver.

Similar copies (``without_near_duplicates``) are groups by the exact Jaccard similarity of five-word shingles; see ``_similar_rows``.

Null and empty texts, and texts of blanks, have fingerprint zero and link like any other. Repeated rows keep their
rows. Rows without doc_id get the component of their fingerprint. An empty table gives an empty result. Columns other than id and
text are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, slices, table
from .components import components, meet

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Candidates for similar copies: words of 64 bits, their shingle, the radius and the least exact similarity.
WIDE, WIDE_SHINGLE, WIDE_RADIUS, ALIKE = 4, 5, 62, 0.8
#: The part of all bits that differ in the mean at that similarity of sets of one size: the angle with cosine 2s / (1 + s), in half turns.
WIDE_APART = math.acos(2 * ALIKE / (1 + ALIKE)) / math.pi


def _shingle_hashes(text: str | None, shingle: int, step: int = 1 << 16):
    """XXH64 of the shingles of a text, in arrays of at most step."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    starts, ends, of = at[:n].tolist(), (at[min(shingle, len(words)) :][:n] - 1).tolist(), xxhash.xxh64_intdigest
    for k in range(0, n, step):
        yield np.array([of(joined[a:b], SEED) for a, b in zip(starts[k : k + step], ends[k : k + step])], "<u8")


def _majority(hashes: list[np.ndarray]) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    n, set_bits = 0, np.zeros(64, np.int64)
    for h in hashes:
        n += len(h)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return _majority(_shingle_hashes(text, shingle))


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *_shingle_hashes(text, shingle)]))


def wide_fingerprint(held: np.ndarray, words: int) -> list[int] | None:
    """``words`` fingerprints of 64 bits from seeded mixtures of each shingle's hash; None for a text without words."""
    parts = [held[k : k + (1 << 16)] for k in range(0, len(held), 1 << 16)]
    return [_majority(_mix(h ^ np.uint64(w + 1 << 56)) for h in parts) for w in range(words)] if parts else None


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in slices(batches, text_col):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(text_col).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fp)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    """A seeded number for each x (the finalizer of splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


# Trees

#: Places of a block's bits in the fingerprint, and its reach.
Block = tuple[tuple[int, ...], int]


def cover(radius: int, n: int, per_cell: int = 8192) -> list[Block]:
    """Blocks of 64 bits such that two fingerprints within radius are within the reach of at least one. Blocks of reach 0 are as narrow
    as n fingerprints allow with leaves below per_cell, which leaves the most bits to those of a larger reach."""
    k = min(4, radius + 1)
    reach = [(radius + 1 - k) // k + (i < (radius + 1 - k) % k) for i in range(k)]
    exact = reach.count(0)
    narrow = 64 // k if exact in (0, k) else max(11, min(17, 2 * math.ceil((math.log2(max(2, n / (0.6 * per_cell))) - 1) / 2) + 1))
    wide = (64 - exact * narrow) // (k - exact) if exact < k else 0
    out, at = [], 0
    for i, r in enumerate(reach):
        bits = (wide if r else narrow) if i < k - 1 else 64 - at
        out.append((tuple(range(at, at + bits)), r))
        at += bits
    return out


def seeded_cover(apart: float, n: int, bits_in_all: int, missed: float = 4e-5, per_leaf: int = 512) -> list[Block]:
    """Blocks of reach 0 at seeded places. Two fingerprints of which a part ``apart`` of all bits differs have none of the blocks equal
    with a probability of ``missed``. Blocks get wider with n, so that leaves stay small, and more."""
    bits = max(10, math.ceil(math.log2(max(2, n / per_leaf))))
    number = math.ceil(math.log(missed) / math.log1p(-((1 - apart) ** bits)))
    rng, out = np.random.default_rng(SEED), []
    while len(out) < number:
        places = rng.permutation(bits_in_all).tolist()
        out += [(tuple(places[k : k + bits]), 0) for k in range(0, bits_in_all - bits + 1, bits)]
    return out[:number]


def gather(fps: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """The bits at some places of fingerprints (rows, words) as one number."""
    one, out = np.uint64(1), np.zeros(len(fps), np.uint64)
    for i, p in enumerate(places):
        out |= (fps[:, p >> 6] >> np.uint64(p & 63) & one) << np.uint64(i)
    return out


class Tree:
    """A vantage-point tree over the Hamming distance of ``bits`` bits for n values. sample: some of them.

    A node becomes a leaf when it is expected to hold ``wanted`` values or fewer: by the shares of the sample that went down its path, and
    by those of random values beyond the sample. Without overlap all leaves are at one depth; where the block's values are too few
    for that, the tree is so deep that each leaf has one of them.
    """

    def __init__(self, number: int, bits: int, reach: int, n: int, wanted: int, sample: np.ndarray, least: int = 32, choices: int = 3, most_levels: int = 40):
        self.number, self.bits, self.reach, self.n, self.wanted = number, bits, reach, n, wanted
        self.depth = most_levels
        if not reach:
            even = max(1, math.ceil(math.log2(max(2, n / wanted))))
            self.depth = even if even <= bits - 2 else 2 * bits
        middle = (bits - 1) // 2
        chance = np.cumsum([math.comb(bits, d) / 2**bits for d in range(bits + 1)])
        #: Boundary of seeded nodes and the shares of random values that go inside and outside.
        self.middle = (middle, chance[min(bits, middle + reach)], 1 - chance[middle])
        self.levels: list[tuple[np.ndarray, ...]] = []
        rows, nodes, share = np.arange(len(sample)), np.zeros(len(sample), np.int64), np.ones(len(sample))
        for level in range(self.depth):
            k = 1 << level
            if k * least > len(sample):
                break
            held = np.bincount(nodes, minlength=k)
            order = np.argsort(nodes, kind="stable")
            first = np.cumsum(held) - held
            points, bounds, fin, fout = self._seeded(level, np.arange(k))
            best, some = np.full(k, np.inf), held >= least
            for c in range(choices):
                point = points.copy()
                point[some] = sample[rows[order[(first + c * held // choices)[some]]]]
                near = np.bincount(nodes * (bits + 1) + np.bitwise_count(sample[rows] ^ point[nodes]), minlength=k * (bits + 1)).reshape(k, bits + 1).cumsum(axis=1).astype(float)
                near /= np.maximum(near[:, -1:], 1)
                inside, outside = near[:, np.minimum(np.arange(bits) + reach, bits)], 1 - near[:, :bits]
                cost = inside**2 + outside**2
                bound = cost.argmin(axis=1)
                at = np.arange(k), bound
                better = some & (cost[at] < best)
                for new, old in ((point, points), (bound, bounds), (inside[at], fin), (outside[at], fout), (cost[at], best)):
                    old[better] = new[better]
            self.levels.append((points, bounds, fin, fout))
            rows, nodes, share = self._step(sample, rows, nodes, share, level)

    def _seeded(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
        points = _mix(nodes.astype(np.uint64) + np.uint64((self.number << 48) + (1 << level))) & np.uint64((1 << self.bits) - 1)
        return points, *[np.full(len(nodes), x) for x in self.middle]

    def _step(self, block: np.ndarray, rows: np.ndarray, nodes: np.ndarray, share: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points, bounds, fin, fout = (x[nodes] for x in self.levels[level]) if level < len(self.levels) else self._seeded(level, nodes)
        d = np.bitwise_count(block[rows] ^ points)
        outside = d > bounds
        nodes = nodes * 2 + outside
        if not self.reach:
            return rows, nodes, share
        also = np.flatnonzero(outside & (d <= bounds + self.reach))
        share = np.concatenate([share * np.where(outside, fout, fin), (share * fin)[also]])
        return np.concatenate([rows, rows[also]]), np.concatenate([nodes, nodes[also] - 1]), share

    def leaves(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): every leaf to which a value of the block goes."""
        rows, nodes, share = np.arange(len(block)), np.zeros(len(block), np.int64), np.ones(len(block))
        out = []
        for level in range(self.depth):
            if self.reach:
                small = share * self.n <= self.wanted
                out.append((rows[small], nodes[small] | 1 << level))
                rows, nodes, share = rows[~small], nodes[~small], share[~small]
            rows, nodes, share = self._step(block, rows, nodes, share, level)
        rows, nodes = zip(*out, (rows, nodes | 1 << self.depth))
        return np.concatenate(rows), np.concatenate(nodes)


def plant(blocks: list[Block], n: int, sample: np.ndarray, per_leaf: int = 256) -> list[Tree]:
    """A tree for each block, deep enough for n fingerprints: leaves of about per_leaf, or eight times as many where rows overlap.
    sample: fingerprints (rows, words)."""
    return [Tree(i, len(places), reach, n, per_leaf * (8 if reach else 1), gather(sample, places)) for i, (places, reach) in enumerate(blocks)]


# Links


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest row of each group) after joining rows i with rows j."""
    while True:
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return label
        np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt


def _spanning(keys: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the smallest key of its group. Leaves of different trees with the same members then give the same edges."""
    least = keys.copy()
    np.minimum.at(least, label, keys)
    least = least[label]
    moved = keys != least
    return keys[moved], least[moved]


def _pairs(fps: np.ndarray, radius: int, left: int | None, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the pairs within radius, each pair once; left: only those between fps[:left] and fps[left:]."""
    for k in range(0, len(fps) if left is None else left, step):
        rows = np.arange(k, min(k + step, len(fps) if left is None else left))
        cols = np.arange(k if left is None else left, len(fps))
        some = np.zeros((len(rows), len(cols)), np.uint8)
        for w in range(min(3, fps.shape[1])):
            some += np.bitwise_count(fps[rows, None, w] ^ fps[cols, w])
        i, j = np.nonzero(some <= radius)
        i, j = rows[i], cols[j]
        good = i < j
        if fps.shape[1] > 3:
            good &= np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64) <= radius
        yield i[good], j[good]


def forest(keys: np.ndarray, fps: np.ndarray, radius: int, left: int | None = None, alike: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): keys of a spanning forest of the links among fps, (rows, words); left as in ``_pairs``. alike: the last word is a size, and
    linked sizes differ by this factor at most."""
    fps, sizes = (fps, None) if alike is None else (fps[:, :-1], fps[:, -1].astype(float))
    label = np.arange(len(fps))
    for i, j in _pairs(fps, radius, left):
        if sizes is not None:
            near = np.minimum(sizes[i], sizes[j]) >= alike * np.maximum(sizes[i], sizes[j]) - 1e-9
            i, j = i[near], j[near]
        label = _joined(label, i, j)
    return _spanning(keys, label)


def cells(batches, at: str, part: str) -> Iterator[pa.Table]:
    """The rows of one cell after another, from batches sorted by at and part. The last bit of part tells a cell's two sides."""
    kept: list[pa.RecordBatch] = []
    here = None
    for batch in batches:
        if not batch.num_rows:
            continue
        where = np.stack([batch.column(at).to_numpy(), batch.column(part).to_numpy() >> 1])
        cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for p, q in zip(cuts, cuts[1:]):
            now = tuple(where[:, p].tolist())
            if here is not None and now != here:
                yield pa.Table.from_batches(kept)
                kept = []
            here = now
            kept.append(batch.slice(p, q - p))
    if kept:
        yield pa.Table.from_batches(kept)


def _side(cell: pa.Table, part: str) -> int | None:
    """How many rows the first of the cell's two parts has; None where the cell is one part."""
    parts = cell[part].to_numpy()
    x, y = parts[0] >> 32, (parts[0] & 0xFFFFFFFF) >> 1
    return None if x == y else int((parts & 1 == 0).sum())


def _dealt(rows: DataFrame, at: str, key: str, heavy: DataFrame) -> DataFrame:
    """rows by cell (at, part): a group of heavy (at, parts) is cut into so many salted parts, and each pair of parts is a cell."""
    part: Column = F.lit(0).cast("long")
    many = heavy.count()
    if many:
        n = F.coalesce("parts", F.lit(1))
        salt = F.pmod(F.xxhash64(F.lit(11), key), n).cast("long")
        names = rows.columns
        rows = rows.join(F.broadcast(heavy) if many <= 10_000 else heavy, at, "left").withColumn("_salt", salt).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
        part = F.shiftleft(F.least("_salt", "_other"), 32) + F.shiftleft(F.greatest("_salt", "_other"), 1) + (F.col("_salt") > F.col("_other")).cast("long")
        rows = rows.select(*names, part.alias("part"))
    else:
        rows = rows.withColumn("part", part)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, F.col(at), F.shiftright("part", 1)).sortWithinPartitions(at, "part")


def _edges(found: Iterator[tuple[np.ndarray, np.ndarray]], some: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of a, b from many small pieces."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def batch():
        a, b = (np.concatenate(v) for v in zip(*kept))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for piece in found:
        kept.append(piece)
        if len(kept) == some:
            yield batch()
            kept.clear()
    if kept:
        yield batch()


def links(distinct: DataFrame, radius: int = RADIUS, blocks=None, per_leaf: int = 256, per_cell: int = 8192, words: tuple[str, ...] = ("fp",), extra: tuple[str, ...] = (), choose=forest, sample: int = 16384) -> DataFrame:
    """a, b: keys (the first column of distinct) of links that connect its fingerprints (words) as all links within radius would, as far as
    two of them meet in a leaf. blocks: from the number of fingerprints to blocks; choose: which links to give of a cell, whose extra
    columns it sees as more words."""
    n = distinct.count()
    carried = (*words, *extra)
    keyed = distinct.select(F.col(distinct.columns[0]).alias("key"), *carried)

    def matrix(t, names=carried) -> np.ndarray:
        return np.stack([t.column(c).to_numpy().astype(np.int64, copy=False).view(np.uint64) for c in names], axis=1)

    few = distinct.select(*words).orderBy(F.xxhash64(F.lit(SEED), *words)).limit(sample).toArrow()
    trees = plant(found := blocks(n) if blocks else cover(radius, n, per_cell), n, matrix(few, words), per_leaf)
    planted = distinct.sparkSession.sparkContext.broadcast((found, trees))

    def placed(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, cell) of every tree; a cell's upper bits are the tree's number."""
        fps = matrix(batch, words)
        for (places, _), tree in zip(*planted.value):
            rows, leaf = tree.leaves(gather(fps, places))
            yield rows, leaf | tree.number << 48

    def shard(batches):
        for batch in batches:
            for rows, cell in placed(batch):
                yield pa.RecordBatch.from_arrays([pa.array(cell), *[batch.column(c).take(pa.array(rows)) for c in ("key", *carried)]], ["cell", "key", *carried])

    # A cell above per_cell has more than this in some task; all others together have at most half of per_cell in tasks where they are fewer.
    tasks = max(1, distinct.rdd.getNumPartitions())
    few_enough = per_cell // (2 * tasks)

    def count(batches):
        cell, size = np.empty(0, np.int64), np.empty(0, np.int64)

        def told(least):
            return pa.RecordBatch.from_arrays([pa.array(cell[size > least]), pa.array(size[size > least])], ["cell", "size"])

        for batch in batches:
            new = [c for _, c in placed(batch)]
            cell, at = np.unique(np.concatenate([cell, *new]), return_inverse=True)
            size = np.bincount(at, weights=np.concatenate([size, *[np.ones(len(c), np.int64) for c in new]]), minlength=len(cell)).astype(np.int64)
            if len(cell) > 1 << 21:  # more than a task should hold: all that was counted so far
                yield told(0)
                cell, size = cell[:0], size[:0]
        yield told(few_enough)

    def search(batches):
        def each():
            for cell in cells(batches, "cell", "part"):
                yield choose(cell["key"].to_numpy(), matrix(cell), radius, _side(cell, "part"))

        yield from _edges(each())

    sizes = distinct.select(*words).mapInArrow(count, "cell long, size long").groupBy("cell").agg((F.sum("size") + few_enough * tasks).alias("size")).where(F.col("size") > per_cell)
    heavy = durable(sizes.select("cell", F.ceil(F.col("size") / (per_cell // 2)).cast("int").alias("parts")))
    sharded = keyed.mapInArrow(shard, "cell long, key long, " + ", ".join(f"{c} long" for c in carried))
    return _dealt(sharded, "cell", "key", heavy).mapInArrow(search, "a long, b long")


def group(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, **options) -> DataFrame:
    """prints (id, fp) with component_id, the smallest id that links reach."""
    of_fp = durable(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("rows")))
    stars = components(links(of_fp.select("fp"), radius, **options), split=True).select(F.col("node").alias("fp"), "root")
    rooted = durable(of_fp.join(stars, "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    total = rooted.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    of_fp = durable(meet(rooted, least, "root", total[0]).select("fp", "component_id", F.col("rows").alias("n")))
    return meet(prints, of_fp, "fp", total[1])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, **options) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits), component_id."""
    found = group(durable(fingerprints(docs, id_col, text_col, shingle)), id_col, radius, **options)
    return found.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similar copies


def shared(sets: list[np.ndarray], often: int = 64, step: int = 1 << 21) -> np.ndarray:
    """How many elements each two of the sets have in common, above the diagonal: products of 0/1 columns for elements that many sets
    have, pairs counted one by one for the others."""
    m = len(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, first = of[np.argsort(at, kind="stable")], np.cumsum(n) - n
    out = np.zeros((m, m), np.float32)
    many = np.flatnonzero(n > often)
    for k in range(0, len(many), 2048):
        ids = many[k : k + 2048]
        x = np.zeros((m, len(ids)), np.float32)
        for c, e in enumerate(ids.tolist()):
            x[rows[first[e] : first[e] + n[e]], c] = 1
        out += x @ x.T
    flat, kept = out.reshape(-1), []
    for c in np.unique(n[(n > 1) & (n <= often)]).tolist():
        ids = np.flatnonzero(n == c)
        i, j = np.triu_indices(c, 1)
        for k in range(0, len(ids), max(1, step // len(i))):
            members = rows[first[ids[k : k + max(1, step // len(i))], None] + np.arange(c)]
            kept.append((members[:, i] * m + members[:, j]).reshape(-1))
            if sum(map(len, kept)) >= step:
                flat += np.bincount(np.concatenate(kept), minlength=m * m)
                kept.clear()
    if kept:
        flat += np.bincount(np.concatenate(kept), minlength=m * m)
    return np.triu(out, 1)


def alike(keys: np.ndarray, sets: list[np.ndarray], least: float, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): keys of a spanning forest of the links among sets whose Jaccard similarity is least or more; left as in ``_pairs``."""
    both, size = shared(sets), np.array([len(s) for s in sets], float)
    i, j = np.nonzero(both if left is None else np.pad(both[:left, left:], ((0, 0), (left, 0))))
    n = both[i, j].astype(float)
    good = n >= least * (size[i] + size[j] - n) - 1e-9
    return _spanning(keys, _joined(np.arange(len(sets)), i[good], j[good]))


def _similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = ALIKE, radius: int = WIDE_RADIUS, per_leaf: int = 256, per_cell: int = 8192, cluster_rows: int = 1024, cluster_shingles: int = 1 << 22) -> DataFrame:
    """id, t (the text's hash), root, component_id of documents that links of an exact Jaccard similarity of five-word shingles of ``least`` or more connect.

    1. Fingerprints of 256 bits name candidates: at 0.8 about 39 bits differ (deviation 6), so the radius of 62 is nearly four deviations away,
       and two such texts meet in a leaf of at least one tree with a probability of all but 4 in 100,000. Candidates connect to clusters.
    2. The shingles of the texts in clusters (few texts have candidates) are made anew and sent to their cluster's task once. There all
       pairs are compared exactly. A cluster of more than ``cluster_rows`` texts or ``cluster_shingles`` shingles is cut into salted
       parts, and each pair of parts is a task, so no task holds more than two parts.
    """
    names = [f"w{w}" for w in range(WIDE)]

    def run(batches):
        for batch in slices(batches, text_col):
            sets = [shingle_set(t) for t in batch.column(text_col).to_pylist()]
            wide = [wide_fingerprint(s, WIDE) for s in sets]
            words = [pa.array([None if v is None else v[w] - (v[w] >> 63 << 64) for v in wide], pa.int64()) for w in range(WIDE)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(node), *words, pa.array([len(s) for s in sets], pa.int64()), batch.column("_ff_t")], [id_col, "node", *names, "size", "t"])

    def held(batches):
        seen: set[int] = set()  # copies of a text in a task are looked at once
        for batch in slices(batches, text_col):
            keep = []
            for n in batch.column("node").to_pylist():
                keep.append(n not in seen)
                seen.add(n)
            batch = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("cluster"), pa.array([shingle_set(t).tobytes() for t in batch.column(text_col).to_pylist()], pa.binary())], ["node", "cluster", "held"])

    def compare(batches):
        def each():
            for cell in cells(batches, "cluster", "part"):
                yield alike(cell["node"].to_numpy(), [np.frombuffer(x, "<u8") for x in cell["held"].to_pylist()], least, _side(cell, "part"))

        yield from _edges(each())

    kind = docs.schema[id_col].dataType.simpleString()
    # A text's row in docs is found again by its hash.
    hashed = docs.select(id_col, text_col).withColumn("_ff_t", F.xxhash64(text_col))
    prints = durable(hashed.mapInArrow(run, f"{id_col} {kind}, node long, " + ", ".join(f"{n} long" for n in names) + ", size long, t long"))
    both = durable(prints.groupBy("node", *names, "size").agg(F.min(id_col).alias("least"), F.min("t").alias("t")))
    wide = both.where("w0 is not null").select("node", *names, "size")
    blocks = partial(seeded_cover, WIDE_APART, bits_in_all=64 * WIDE, per_leaf=2 * per_leaf)
    near = links(wide, radius, blocks, per_leaf, per_cell, tuple(names), ("size",), partial(forest, alike=least))
    stars = durable(components(near))
    clusters = stars.select("node", F.col("root").alias("cluster")).unionAll(stars.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    wanted = durable(clusters.join(both.select("node", "size", "t"), "node"))
    parts = F.greatest(F.ceil(F.count("*") / cluster_rows), F.ceil(F.sum("size") / cluster_shingles)).cast("int")
    heavy = durable(wanted.groupBy("cluster").agg(parts.alias("parts")).where("parts > 1"))
    slim = wanted.select("node", "cluster", F.col("t").alias("_ff_w"))
    texts = hashed.join(F.broadcast(slim) if slim.count() <= 1_000_000 else slim, F.col("_ff_t") == F.col("_ff_w")).select("node", "cluster", text_col)
    sets = texts.mapInArrow(held, "node long, cluster long, held binary").dropDuplicates(["node"])
    stars = durable(components(_dealt(sets, "cluster", "node", heavy).mapInArrow(compare, "a long, b long")))
    rooted = both.join(stars, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = durable(rooted.join(firsts, "root").select("node", "root", "component_id"))
    return prints.select(id_col, "t", "node").join(of_node, "node").select(id_col, "t", "root", "component_id")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, component_id of the groups of ``_similar_rows``."""
    return _similar_rows(docs, id_col, text_col, **options).select(id_col, "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of ``similar_groups``: that with its smallest id, and of rows that share it the one whose text has the
    smallest hash. Rows without an id all stay, having no identity to go by."""
    found = _similar_rows(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull())
    kept = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).alias("i"), "t")).alias("k")).select(F.col("k.i").alias("_ff_id"), F.col("k.t").alias("_ff_t"))
    first = F.row_number().over(W.partitionBy("_ff_id", "_ff_t").orderBy(F.lit(0)))
    named = docs.join(kept, (F.col(id_col) == F.col("_ff_id")) & (F.xxhash64(text_col) == F.col("_ff_t"))).withColumn("_ff_n", first).where("_ff_n = 1")
    return named.drop("_ff_n", "_ff_id", "_ff_t").unionByName(docs.where(F.col(id_col).isNull()))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
