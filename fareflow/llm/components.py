"""Connected components by alternating large and small stars, all in DataFrames.

Each turn links every node's larger neighbours to its smallest one (large star), then its smaller neighbours and
itself to the smallest (small star); the edges end as stars around each component's smallest node, in a number of
turns that grows with the logarithm of the longest path. It goes on until a turn changes nothing. A node of any degree
is only ever summed (minima are taken before the shuffle) or met by its one minimum in a join whose long side adaptive
execution may split. Each turn is written to the checkpoint folder; the driver sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def meet(rows: DataFrame, found: DataFrame, key: str, total: int | None, most: int = 10_000) -> DataFrame:
    """rows joined with found, which has a row for each key and in column n how many of the rows, total or fewer in all, have it.

    Rows of a hot key, one with more than a ``most``-th of the rows (and more than 1,000), stay where they are: there are fewer than
    ``most`` such keys, and these are broadcast. All other rows are shuffled by their key. Without total all are.
    """
    if total is None:
        return rows.join(found.drop("n"), key)
    bound = max(1000, total // most)
    hot = found.where(F.col("n") > bound).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.where(F.col("n") <= bound).drop("n"), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def components(edges: DataFrame, split: bool = False) -> DataFrame:
    """edges: a, b (long). Returns node, root: a row for each node that isn't its component's smallest. split: nodes of very many edges don't
    go to one task each, at the price of plans twice as long, which the driver holds."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before or mark[0] == 0:
            break
        before = mark
        total = 2 * mark[0] if split else None
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = meet(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = meet(large, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = durable(small.distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
