"""Approximate nearest neighbours by an adaptive dimension scan.

*Space.* The measure is the inner product. Scaling by the largest norm and adding one component that fills every vector up
to length one turns it into Euclidean distance (the query gets a zero there), and a seeded random rotation spreads
what a vector holds evenly over its components.

*Lists.* Centroids come from a bounded sample (``train_rows`` rows with the smallest hash, a documented bound); every row
is then assigned to its nearest centroid. A query probes the ``probe_share`` of all lists that is nearest to it, and more until
they hold ten times the rows asked for. (Vectors without clusters, as in the test tables, need a large share; clustered ones do
with far less.) The sample also gives each query a first bound: its k-th nearest of all rows in probed lists is no farther than the 2k-th of
the sample's, which leaves the test enough to keep k.

*Scan.* Within probed lists the rotated vectors are read in blocks of ``block`` columns. After each block a hypothesis test
compares a candidate's partial distance with the distance of the k-th best so far: if the partial sum over d of D
columns exceeds d/D times that distance by more than the factor (1 + epsilon / sqrt(d)) squared, the candidate would hardly
end below it and is abandoned. Survivors are scored in double precision on the original vectors, and these scores alone
rank the results.

Scale: lists are put side by side into cells of about ``cell_rows`` rows (more where there are more than 4096 cells; a longer list is cut
by hash). Each row is sent to its cell once; a query is sent once to each cell that has a list it probes, and streams past the
cell's rows in batches. Cells return k rows a query at most, and a query's rows from all of its cells are ranked together.
What is broadcast (rotation, centroids, list counts, sample) is bounded by ``max_lists`` and ``train_rows``.

Vectors that are null, all zero, or with null or non-finite components take no part, nor do rows without vec_id. Vectors are compared
with those of their own length; each length has an index of its own. Rows that repeat a query's vec_id are its own and no
candidates of it; a query row that repeats is asked once. Ties go to the smaller vec_id. An empty table gives an empty result.
Columns other than id and vector are not looked at, but for what is_query names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import durable, table

FOUND = "query_id long, vec_id long, score double"


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), flat.dtype)


def k_means(x: np.ndarray, k: int, seed: int, turns: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), k, replace=False)]
    for _ in range(turns):
        own = np.argmax(x @ at.T - 0.5 * (at * at).sum(1), axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return at


class Space:
    """Vectors and queries as points on the unit sphere, rotated."""

    def __init__(self, dim: int, longest: float, seed: int):
        turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim + 1, dim + 1)))
        self.turn, self.longest = turn, longest

    def vectors(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64) / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))
        return np.column_stack([x, rest]) @ self.turn

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        q = q / np.maximum(np.abs(q).max(axis=1), 1e-300)[:, None]
        return np.column_stack([q / np.sqrt((q * q).sum(1))[:, None], np.zeros(len(q))]) @ self.turn


def scan(pq: np.ndarray, q: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, px: np.ndarray, x: np.ndarray, ids: np.ndarray, probed: np.ndarray, k: int, block: int, epsilon: float, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_ids, ids, scores) of each query's k best rows of x. pq, px: queries and rows as points; probed: (query, row), whether it counts;
    bound: a squared distance beyond which nothing matters to a query. Rows must come in order of ids."""
    width, m, bound = px.shape[1], len(q), bound.astype(np.float32)
    best_s, best_i = np.full((m, 0), -np.inf), np.empty((m, 0), np.int64)
    cuts = [(a, min(a + block, width)) for a in range(0, width, block)]
    allowed = {b: np.float32(b / width * (1 + epsilon / np.sqrt(b)) ** 2 if b < width else 1.0001) for _, b in cuts}
    for lo in range(0, len(x), step):
        part = px[lo : lo + step]
        stay = probed[:, lo : lo + step] & (ids[None, lo : lo + step] != query_ids[:, None])
        so_far = np.zeros(stay.shape, np.float32)
        rows = cols = None
        for a, b in cuts:
            if rows is None:  # many pairs are in: one product of matrices for all
                so_far += (pq[:, a:b] ** 2).sum(1)[:, None] + (part[:, a:b] ** 2).sum(1) - 2 * (pq[:, a:b] @ part[:, a:b].T)
                stay &= so_far <= (bound * allowed[b])[:, None] + np.float32(1e-5)
                if b == width or np.count_nonzero(stay) <= 0.1 * stay.size:
                    rows, cols = np.nonzero(stay)
                    so_far = so_far[rows, cols]
            else:
                gap = pq[rows, a:b] - part[cols, a:b]
                so_far = so_far + np.einsum("ij,ij->i", gap, gap)
                near = so_far <= bound[rows] * allowed[b] + np.float32(1e-5)
                rows, cols, so_far = rows[near], cols[near], so_far[near]
        if not len(rows):
            continue
        scores = np.einsum("ij,ij->i", q[rows].astype(np.float64), x[lo + cols].astype(np.float64))
        # Each query's new scores beside its best ones; rows are in order of ids, so a stable sort keeps ties right.
        n = np.bincount(rows, minlength=m)
        wide = int(n.max(initial=0))
        new_s, new_i = np.full((m, wide), -np.inf), np.full((m, wide), -1, np.int64)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        new_s[rows, place], new_i[rows, place] = scores, lo + cols
        all_s, all_i = np.hstack([best_s, new_s]), np.hstack([best_i, new_i])
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
        best_s, best_i = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
        if best_s.shape[1] == k:
            has = best_i[:, -1] >= 0
            far = px[np.where(has, best_i[:, -1], 0)] - pq
            bound = np.where(has, np.minimum(bound, np.einsum("ij,ij->i", far, far)), bound)
    real = best_i >= 0
    return np.repeat(query_ids, real.sum(1)), ids[best_i[real]], best_s[real]


class Cells:
    """Lists side by side: the first cell of each list, and how many cells it has to itself. Lists that share a cell are neighbours by number."""

    def __init__(self, held: np.ndarray, cell_rows: int):
        size = max(cell_rows, -(-int(held.sum()) // 4096))
        self.chunks = np.maximum(1, -(-held // size))
        self.first, at, room = np.zeros(len(held), np.int64), -1, 0
        for i, n in enumerate(held.tolist()):
            if n > room or self.chunks[i] > 1:
                at, room = at + 1, size
            self.first[i] = at
            at, room = at + int(self.chunks[i]) - 1, 0 if self.chunks[i] > 1 else room - n
        self.number = at + 1
        #: The lists from starts[c] up to the next start share cell c (or the first cell of a cut list).
        self.cells, self.starts = np.unique(self.first, return_index=True)

    def of_rows(self, lists: np.ndarray, ids: np.ndarray) -> np.ndarray:
        dealt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return self.first[lists] + dealt % self.chunks[lists]


def _search(rows: DataFrame, dim: int, n: int, longest: float, k: int, probe_share: float, max_lists: int, train_rows: int, block: int, epsilon: float, cell_rows: int, seed: int) -> DataFrame:
    """FOUND: candidates of every query, k a cell at most. rows: id, v (all of length dim), asked."""
    spark, kind = rows.sparkSession, rows.schema["v"].dataType.simpleString()
    space = Space(dim, longest, seed)
    lists = max(1, min(max_lists, round(n**0.5)))
    few = rows.select("id", "v", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h", "v").limit(min(train_rows, max(64 * lists, 256))).select("id", "v").toArrow()
    points = space.vectors(matrix(few["v"]))
    lists = min(lists, len(points))
    centres = k_means(points, lists, seed)
    half = 0.5 * (centres * centres).sum(1)
    listed = np.argmax(points @ centres.T - half, axis=1)
    known = spark.sparkContext.broadcast((space, centres, half, few["id"].to_numpy(), listed, points.astype(np.float32)))

    def assign(batches):
        space, centres, half, *_ = known.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                own = np.argmax(space.vectors(matrix(part.column(1))) @ centres.T - half, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *part.columns], ["list", "id", "v", "asked"])

    indexed = durable(rows.select("id", "v", "asked").mapInArrow(assign, f"list int, id long, v {kind}, asked boolean"))
    held = np.zeros(lists, np.int64)
    for at, count in indexed.groupBy("list").count().collect():  # max_lists rows at most
        held[at] = count
    grid = Cells(held, cell_rows)
    dealt = f"cell int, asks int, id long, v {kind}, list int, lists binary, bound float"

    def place(batches):
        for batch in batches:
            at, ids = batch.column(0).to_numpy(), batch.column(1)
            cell, none = grid.of_rows(at, ids.to_numpy()).astype(np.int32), batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(none, np.int32)), ids, batch.column(2), batch.column(0), pa.nulls(none, pa.binary()), pa.nulls(none, pa.float32())], ["cell", "asks", "id", "v", "list", "lists", "bound"])

    def probe(batches):
        space, centres, half, some_ids, some_lists, some = known.value
        length = (some * some).sum(1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                ids, points = part.column(0).to_numpy(), space.queries(matrix(part.column(1)))
                order = np.argsort(half - points @ centres.T, axis=1, kind="stable")
                enough = np.cumsum(held[order], axis=1) - held[order] < 10 * k
                probed = np.zeros((len(ids), lists), bool)
                np.put_along_axis(probed, order, enough | (np.arange(lists) < np.ceil(probe_share * lists)), axis=1)
                bound = np.full(len(ids), np.inf, np.float32)
                if len(some) > 2 * k:
                    apart = length - 2 * (points.astype(np.float32) @ some.T) + np.float32(1)
                    apart[(ids[:, None] == some_ids) | ~probed[:, some_lists]] = np.inf
                    bound = np.partition(apart, 2 * k - 1, axis=1)[:, 2 * k - 1]
                for c, (first, start) in enumerate(zip(grid.cells.tolist(), grid.starts.tolist())):
                    here = probed[:, start : grid.starts[c + 1] if c + 1 < len(grid.starts) else lists]
                    asks = np.flatnonzero(here.any(axis=1))
                    masks = pa.array([m.tobytes() for m in np.packbits(here[asks], axis=1)], pa.binary())
                    took = part.take(pa.array(asks))
                    for cell in range(first, first + int(grid.chunks[start])):
                        fill = lambda x: pa.array(np.full(len(asks), x, np.int32))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([fill(cell), fill(1), took.column(0), took.column(1), fill(start), masks, pa.array(bound[asks])], ["cell", "asks", "id", "v", "list", "lists", "bound"])

    asked = indexed.where("asked").dropDuplicates(["id"]).select("id", "v")
    both = indexed.select("list", "id", "v").mapInArrow(place, dealt).unionAll(asked.mapInArrow(probe, dealt))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * grid.number, 4096))
    both = both.repartition(tasks, "cell").sortWithinPartitions("cell", "asks", "id")

    def look(batches):
        """A cell's rows come first, in order of ids, then its queries."""
        space, rows_of, cell = known.value[0], [], None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                at = part.column(0).to_numpy() * 2 + part.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
                for p, q in zip(cuts, cuts[1:]):
                    now, some = int(at[p]), part.slice(p, q - p)
                    if now >> 1 != cell:
                        rows_of, data, cell = [], None, now >> 1
                    if not now & 1:
                        rows_of.append(some)
                        continue
                    if data is None and rows_of:
                        t = pa.Table.from_batches(rows_of)
                        x = matrix(t["v"])
                        data, rows_of = (space.vectors(x).astype(np.float32), x, t["id"].to_numpy(), t["list"].to_numpy()), []
                    if data is None:
                        continue
                    px, x, ids, own = data
                    start, asking = some.column(4)[0].as_py(), matrix(some.column(3))
                    masks = np.stack([np.frombuffer(m, np.uint8) for m in some.column(5).to_pylist()])
                    probed = np.unpackbits(masks, axis=1)[:, own - start].view(bool)
                    who, what, score = scan(space.queries(asking).astype(np.float32), asking, some.column(2).to_numpy(), some.column(6).to_numpy(), px, x, ids, probed, k, block, epsilon)
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(what), pa.array(score)], ["query_id", "vec_id", "score"])

    return both.mapInArrow(look, FOUND)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", probe_share: float = 0.75, max_lists: int = 4096, train_rows: int = 65536, block: int = 16, epsilon: float = 1.5, cell_rows: int = 4096, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds."""
    sound = F.forall(vec_col, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(vec_col, lambda v: v != 0)
    kept = vectors.schema[vec_col].dataType
    vector = F.col(vec_col) if isinstance(kept, ArrayType) and isinstance(kept.elementType, FloatType) else F.col(vec_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), is_query.alias("asked"))
    square = F.aggregate("v", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    facts = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*"), F.max(F.sqrt(square)), F.max("asked")).collect()  # a row for each length that occurs
    parts = [_search(rows.where(F.size("v") == dim), dim, n, longest, k, probe_share, max_lists, train_rows, block, epsilon, cell_rows, seed) for dim, n, longest, asked in facts if asked]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.unionAll, parts).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0)
