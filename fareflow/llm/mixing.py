"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by source and exact size (words). The counts, not the documents, are what the fit works on.
2. Each source gets a share of ``ratio`` times all words by its weight (weights repeat over the sources in code-point
   order, null last). A target stops at ``cap`` times the source's words; the excess is shared again by weight until
   no target is above its stop.
3. A source takes all of its documents as often as its target holds its words (0, 1 or 2 times). For what is left of
   the budget it takes the same part of every size, then sizes in seeded order, then a bounded-knapsack dynamic program
   over the remaining counts fits the last words exactly wherever some subset of them does.
4. How many documents of a size to take becomes a cut: the first n of that size in the order of a seeded hash of id and
   text, and among rows that agree in both, of a seeded row number.

Scale: texts are read and counted once; what the caller keeps of a row is written with its size and hash, and all else
works on that. The dynamic program sees one row for each size of a source, which the longest document bounds, and its budget is
``dp_words`` at most. The cut of a size is found by counting its documents in at most 1024 ranges of the hash at a time
(summed before the shuffle), then in those of the one range that holds it, until that range has few documents, which
are ranked; so neither a hot size nor a great many equal rows meet in one task. Sources are put in order by
ranges as well. The plan (a row for each source and size) is broadcast only when its bytes were counted and are
within ``broadcast_bytes``; a longer one is left to a shuffled join.

Null text has size 0; documents of size 0 are never taken. Rows that agree in id and text are taken as often as
needed, each on its own. A source without words has target 0. An empty table gives an empty result. ``mix`` replaces
columns named like its own (whatever their case); ``mixed_documents`` changes no column.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, durable, table, without

SEED = 20240229
LAST = (1 << 63) - 1


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill(sizes: list[int], free: list[int], goal: int) -> list[int]:
    """How many of each size make goal, or as much of it as can be made: the first way found in this order. Memory: a number for each sum up to goal."""
    reach, via = np.zeros(goal + 1, bool), np.zeros(goal + 1, np.int64)
    reach[0] = True
    pieces: list[tuple[int, int]] = []  # a piece is 1, 2, 4, ... documents of a size
    common = gcd(*[s for s, f in zip(sizes, free) if f])
    best = goal // common * common if common else 0
    for i, (size, left) in enumerate(zip(sizes, free)):
        n = 1
        while left > 0 and n * size <= goal and not reach[best]:
            n = min(n, left)
            new = np.flatnonzero(reach[: goal + 1 - n * size] & ~reach[n * size :]) + n * size
            if len(new):
                reach[new], via[new] = True, len(pieces)
                pieces.append((i, n))
            left -= n
            n *= 2
    take, at = [0] * len(sizes), int(np.flatnonzero(reach)[-1])
    while at:  # a sum was reached from one that earlier pieces had reached
        i, n = pieces[via[at]]
        take[i] += n
        at -= n * sizes[i]
    return take


def fit(sizes: list[int], counts: list[int], budget: int, dp_words: int, seed: int) -> list[int]:
    """How many documents of each size to take, so that their words come as near to the budget as can be found."""
    total = sum(s * c for s, c in zip(sizes, counts))
    take = [0] * len(sizes)
    if budget <= 0 or total == 0:
        return take
    take = [c * min(budget, total) // total if s else 0 for s, c in zip(sizes, counts)]
    left = budget - sum(s * t for s, t in zip(sizes, take))
    order = [i for i, s in enumerate(sizes) if s > 0]
    random.Random(seed).shuffle(order)
    for i in order:
        if left > dp_words:
            more = min(counts[i] - take[i], left // sizes[i])
            take[i] += more
            left -= more * sizes[i]
    if 0 < left <= dp_words:
        for i, more in zip(order, fill([sizes[i] for i in order], [counts[i] - take[i] for i in order], left)):
            take[i] += more
            left -= more * sizes[i]
    if left > 0:  # one more document, if that is nearer than none
        over = [(sizes[i], i) for i in order if take[i] < counts[i] and sizes[i] - left < left]
        if over:
            take[min(over)[1]] += 1
    return take


def in_order(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df with place (from 1) in an order of all rows and running sums up to each row, by ranges: no task holds all rows."""
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = durable(dealt.withColumn("_part", F.spark_partition_id()).withColumns(sums | {"place": F.lit(1).cast("long")}))
    names = ["place", *sums]
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in names]).select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in names])
    upto = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(starts), "_part").withColumns({f"_at_{c}": F.sum(c).over(upto) + F.col(f"_{c}") for c in names})
    return out.withColumns({c: F.col(f"_at_{c}") for c in names}).drop("_part", *[f"_{c}" for c in names], *[f"_at_{c}" for c in names])


def targets(sources: DataFrame, weights: tuple[int, ...], ratio: float, cap: float) -> DataFrame:
    """source, source_size, target of sources: source, source_size. One row a source, each a document count's sum.

    Words for each unit of weight rise to a level; a source stops rising at its stop. In the order of their stops by weight, the sources
    that stop are those at whose own level all sources together still take no more than the budget.
    """
    placed = in_order(sources, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sized = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("stop"))
    whole = sized.agg((F.sum("source_size") * float(ratio)).alias("budget"), F.sum("weight").alias("all_weight"))
    own = F.col("stop") / F.col("weight")
    rising = in_order(sized, [own, F.col("source").asc_nulls_last()], {"stops": F.col("stop"), "weights": F.col("weight")}).crossJoin(F.broadcast(whole))  # one row
    rising = durable(rising.withColumn("stopped", F.col("stops") + own * (F.col("all_weight") - F.col("weights")) <= F.col("budget")))
    level = rising.agg(((F.max("budget") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("stop"))), F.lit(0.0))) / F.nullif(F.sum(F.when(~F.col("stopped"), F.col("weight"))), F.lit(0.0))).alias("level"))
    target = F.when(F.col("stopped"), F.col("stop")).otherwise(F.least(F.col("weight") * F.col("level"), F.col("stop")))
    return rising.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))  # one row


def _here(source: str = "_s", size: str = "_z") -> Column:
    return F.col("_ff_source").eqNullSafe(F.col(source)) & (F.col("_ff_size") == F.col(size))


def _cuts(units: DataFrame, part: DataFrame, per_range: int, small) -> DataFrame:
    """_s, _z, _c, _d: of each size's documents those up to (hash, row) = (_c, _d) are taken. part: _s, _z, take, n; units: its documents.

    The range that holds the cut: hashes from lo to hi, or, where one hash fills a range, its rows' numbers from lo to hi.
    """
    x = F.when(F.col("tied").isNull(), F.col("_ff_hash")).otherwise(F.col("_ff_row"))
    inside = _here() & (F.col("tied").isNull() | (F.col("_ff_hash") == F.col("tied"))) & x.between(F.col("lo"), F.col("hi"))
    state = part.select("_s", "_z", F.col("take").alias("need"), F.col("n").alias("held"), F.lit(0).cast("long").alias("lo"), F.lit(LAST).alias("hi"), F.lit(None).cast("long").alias("tied"))
    many = F.col("held") > 4 * per_range
    while (big := state.where(many)).count():
        pieces = F.least(F.lit(1024), F.ceil(F.col("held") / per_range))
        piece = F.floor((x - F.col("lo")).cast("double") / ((F.col("hi") - F.col("lo")).cast("double") + 1) * pieces)
        keys = ["_s", "_z", "need", "tied"]
        per = units.join(small(big), inside).groupBy(*keys, piece.alias("piece")).agg(F.count("*").alias("held"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        upto = F.sum("held").over(W.partitionBy("_s", "_z").orderBy("piece").rowsBetween(W.unboundedPreceding, 0))
        edge = per.withColumn("before", upto - F.col("held")).where((F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("held")))
        one = F.col("lo") == F.col("hi")
        tie = one & F.col("tied").isNull()
        found = edge.select(
            "_s", "_z", (F.col("need") - F.col("before")).alias("need"), F.when(one & ~tie, F.lit(0)).otherwise(F.col("held")).alias("held"),
            F.when(tie, F.lit(0)).otherwise(F.col("lo")).alias("lo"), F.when(tie, F.lit(LAST)).otherwise(F.col("hi")).alias("hi"), F.when(tie, F.col("lo")).otherwise(F.col("tied")).alias("tied"),
        )
        state = durable(state.where(~many).unionByName(found))
    ranked = units.join(small(state), inside).withColumn("place", F.row_number().over(W.partitionBy("_s", "_z").orderBy("_ff_hash", "_ff_row")))
    last = F.max(F.struct("_ff_hash", "_ff_row"))
    return ranked.where("place <= need").groupBy("_s", "_z").agg(last.alias("last")).select("_s", "_z", F.col("last._ff_hash").alias("_c"), F.col("last._ff_row").alias("_d"))


def _decided(docs: DataFrame, keep: Sequence[str], source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, cap: float = 2.0, dp_words: int = 1 << 16, per_range: int = 512, broadcast_bytes: int = 16 << 20, seed: int = SEED) -> DataFrame:
    """The columns in keep, and _ff_size, _ff_total (of the source), _ff_target and _ff_copies."""
    content = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 1)
    number = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 1)
    rows = durable(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(source_col).alias("_ff_source"), words_in(F.col(text_col)).alias("_ff_size"), content.alias("_ff_hash"), number.alias("_ff_row")))
    counts = durable(rows.groupBy(F.col("_ff_source").alias("source"), F.col("_ff_size").alias("size")).agg(F.count("*").alias("n")))
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, ratio, cap)

    def plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(int(cap), int(target // total)) if total else 0
        name = pdf["source"].iloc[0]
        own = seed if name is None else seed ^ sum(name.encode())
        take = fit(pdf["size"].tolist(), pdf["n"].tolist(), round(target) - whole * total, dp_words, own)
        return pdf.assign(whole=whole, take=np.minimum(take, pdf["n"]))

    joined = counts.join(goals.withColumnRenamed("source", "_g"), F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    plan = durable(joined.groupBy("source").applyInPandas(plan_source, "source string, size long, n long, source_size long, target double, whole int, take long"))
    bytes_in = plan.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 80)).first()[0] or 0
    small = (lambda df: F.broadcast(df)) if bytes_in <= broadcast_bytes else (lambda df: df)
    part = plan.where((F.col("take") > 0) & (F.col("take") < F.col("n"))).select(F.col("source").alias("_s"), F.col("size").alias("_z"), "take", "n")
    units = durable(rows.join(small(part), _here()).select("_ff_source", "_ff_size", "_ff_hash", "_ff_row"))
    cuts = _cuts(units, part, per_range, small)
    full = plan.join(cuts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    every = F.col("take") >= F.col("n")
    full = full.select(F.col("source").alias("_ff_p"), F.col("size").alias("_ff_q"), F.col("source_size").alias("_ff_total"), F.col("target").alias("_ff_target"), F.col("whole").alias("_ff_whole"), *[F.when(every, F.lit(LAST)).otherwise(F.col(c)).alias(f"_ff{c}") for c in ("_c", "_d")])
    first = (F.col("_ff_hash") < F.col("_ff_c")) | ((F.col("_ff_hash") == F.col("_ff_c")) & (F.col("_ff_row") <= F.col("_ff_d")))
    copies = F.when(F.col("_ff_size") > 0, F.col("_ff_whole") + F.coalesce(first.cast("int"), F.lit(0))).otherwise(0)
    picked = rows.join(small(full), _here("_ff_p", "_ff_q"))
    return picked.select(*[F.col(f"`{c}`") for c in keep], "_ff_size", "_ff_total", "_ff_target", copies.alias("_ff_copies"))


def mix(docs: DataFrame, keep: Sequence[str] | None = None, **options) -> DataFrame:
    """docs (its columns named in keep, by default all) with size, source_size, target, taken (words) and copies (times that the document is taken)."""
    added = {"size": "_ff_size", "source_size": "_ff_total", "target": "_ff_target", "taken": F.col("_ff_size") * F.col("_ff_copies"), "copies": "_ff_copies"}
    names = without(docs, *added).columns if keep is None else list(keep)
    return _decided(docs, names, **options).select(*[F.col(f"`{c}`") for c in names], *[(F.col(v) if isinstance(v, str) else v).alias(c) for c, v in added.items()])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns unchanged."""
    out = _decided(docs, docs.columns, **options)
    return out.withColumn("_ff_copy", F.explode(F.array_repeat(F.lit(0), F.col("_ff_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
