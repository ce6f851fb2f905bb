"""Points in polygons with built-in functions.

Polygons come as a vertex table: zone_id, ring_no (place in the ring, from 0), x, y. Each becomes one row with its ring and bounding box. Points
meet polygons by grid cells of the boxes, an equi-join, and are then tested by ray casting. Points exactly on an edge count as
inside on left and lower edges only, so adjoining zones don't both have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def polygons(vertices: DataFrame) -> DataFrame:
    ring = F.sort_array(F.collect_list(F.struct("ring_no", "x", "y")))
    return vertices.groupBy("zone_id").agg(ring.alias("ring"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def _inside(px, py):
    """An odd number of edges to the right. Edges join each vertex with the next and the last with the first."""
    n = F.size("ring")

    def crosses(v, i):
        w = F.element_at("ring", ((i + 1) % n + 1).cast("int"))
        spans = (v["y"] > py) != (w["y"] > py)
        return F.when(spans, (px < (w["x"] - v["x"]) * (py - v["y"]) / F.nullif(w["y"] - v["y"], F.lit(0.0)) + v["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.transform("ring", crosses), F.lit(0), lambda a, c: a + F.coalesce(c, F.lit(0))) % 2 == 1


def zone_of(points: DataFrame, shapes: DataFrame, x: str = "x", y: str = "y", cell: float = 0.05) -> DataFrame:
    """points with zone_id, null outside all polygons; of overlapping ones the smallest id. points need a unique id column."""
    ix, iy = F.floor(F.col(x) / cell), F.floor(F.col(y) / cell)
    boxes = shapes.withColumn("_i", F.explode(F.sequence(F.floor(F.col("min_x") / cell), F.floor(F.col("max_x") / cell)))).withColumn("_j", F.explode(F.sequence(F.floor(F.col("min_y") / cell), F.floor(F.col("max_y") / cell))))
    met = points.select("id", F.col(x).alias("_x"), F.col(y).alias("_y"), ix.alias("_i"), iy.alias("_j")).join(boxes, ["_i", "_j"])
    found = met.where(_inside(F.col("_x"), F.col("_y"))).groupBy("id").agg(F.min("zone_id").alias("zone_id"))
    return points.join(found, "id", "left")
