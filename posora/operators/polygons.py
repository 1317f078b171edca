"""Areas, convex clipping and overlaps of polygons as array expressions, and a join of polygons that overlap.

A polygon is array<array<double>>, its corners [x, y] in order, either way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posora.functions.arrays import let

#: Points this near an edge, by cross product, are inside; lines this near parallel have no crossing.
NEAR = 1e-9


def _next(polygon: Column) -> Column:
    """The corners shifted by one, so that corner i meets corner i + 1."""
    return F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))


def signed_area(polygon: Column) -> Column:
    """Half the sum of cross products: above 0 where corners turn left. Fewer than three corners give 0 or nearly so; null gives null."""
    cross = let(polygon, lambda v: F.zip_with(v, _next(v), lambda p, q: p[0] * q[1] - q[0] * p[1]))
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) / 2


def area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon))


def _crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the line through a and b meets that through c and d; b where they are parallel."""
    down = (a[0] - b[0]) * (c[1] - d[1]) - (a[1] - b[1]) * (c[0] - d[0])
    ab, cd = a[0] * b[1] - a[1] * b[0], c[0] * d[1] - c[1] * d[0]
    at = F.array((ab * (c[0] - d[0]) - (a[0] - b[0]) * cd) / down, (ab * (c[1] - d[1]) - (a[1] - b[1]) * cd) / down)
    return F.when(F.abs(down) < NEAR, b).otherwise(at)


def clipped(subject: Column, clip: Column) -> Column:
    """The part of ``subject`` inside the convex ``clip``, half plane by half plane; no corners where they don't meet."""
    turn = F.when(signed_area(clip) < 0, -1.0).otherwise(1.0)
    edges = let(turn, lambda t: F.zip_with(clip, _next(clip), lambda c, d: F.struct(c.alias("c"), d.alias("d"), t.alias("turn"))))

    def half_plane(polygon: Column, e: Column) -> Column:
        c, d = e["c"], e["d"]

        def inside(p: Column) -> Column:
            return ((d[0] - c[0]) * (p[1] - c[1]) - (d[1] - c[1]) * (p[0] - c[0])) * e["turn"] >= -NEAR

        before = F.concat(F.slice(polygon, F.greatest(F.size(polygon), F.lit(1)), 1), F.slice(polygon, 1, F.greatest(F.size(polygon) - 1, F.lit(0))))

        def corner(p: Column, q: Column) -> Column:
            """What the step from corner p to corner q leaves."""
            none = F.array().cast("array<array<double>>")
            return F.when(inside(q), F.when(inside(p), F.array(q)).otherwise(F.array(_crossing(p, q, c, d), q))).otherwise(F.when(inside(p), F.array(_crossing(p, q, c, d))).otherwise(none))

        return F.flatten(F.zip_with(before, polygon, corner))

    return F.aggregate(edges, subject, half_plane)


def overlap(a: Column, b: Column) -> Column:
    """struct<intersection, iou, fraction_a, fraction_b> of two convex polygons; shares of nothing are 0."""
    part = let(clipped(a, b), lambda p: F.when(F.size(p) >= 3, area(p)).otherwise(0.0))
    return let(F.struct(area(a).alias("a"), area(b).alias("b"), part.alias("i")), lambda v: F.struct(
        v["i"].alias("intersection"),
        F.when(v["a"] + v["b"] - v["i"] > 0, v["i"] / (v["a"] + v["b"] - v["i"])).otherwise(0.0).alias("iou"),
        F.when(v["a"] > 0, v["i"] / v["a"]).otherwise(0.0).alias("fraction_a"),
        F.when(v["b"] > 0, v["i"] / v["b"]).otherwise(0.0).alias("fraction_b"),
    ))


def _bounds(polygon: Column) -> Column:
    def of(axis: int, pick) -> Column:
        return pick(F.transform(polygon, lambda p: p[axis]))

    return F.struct(of(0, F.array_min).alias("x1"), of(1, F.array_min).alias("y1"), of(0, F.array_max).alias("x2"), of(1, F.array_max).alias("y2"))


def overlapping(left: DataFrame, right: DataFrame, cell: float, scene: str | None = None, id_col: str = "id", polygon_col: str = "polygon") -> DataFrame:
    """(scene, left_id, right_id, intersection, iou, fraction_a, fraction_b) of all pairs that share some area.

    Polygons of one scene are dealt to the grid cells of side ``cell`` that their bounds
    touch; a pair meets in the cell of the greater of its two lower left corners alone, so
    each is clipped once and nothing has to be made distinct. Rows with a null id, scene or polygon, or fewer than three corners, have no pairs.
    ``cell`` should be about as large as the polygons: a polygon is dealt to as many cells as it covers.
    """
    at = [scene] if scene else []

    def dealt(rows: DataFrame, side: str) -> DataFrame:
        r = rows.select(*(F.col(c).alias("_scene") for c in at), F.col(id_col).alias(f"{side}_id"), F.col(polygon_col).alias(f"{side}_polygon"))
        r = r.dropna().filter(F.size(f"{side}_polygon") >= 3).withColumn(f"{side}_bounds", _bounds(F.col(f"{side}_polygon")))

        def cells(low: str, high: str) -> Column:
            return F.sequence(F.floor(F.col(f"{side}_bounds.{low}") / cell), F.floor(F.col(f"{side}_bounds.{high}") / cell))

        return r.withColumn("_cx", F.explode(cells("x1", "x2"))).withColumn("_cy", F.explode(cells("y1", "y2")))

    met = dealt(left, "left").join(dealt(right, "right"), [*(["_scene"] if at else []), "_cx", "_cy"])
    x = F.greatest("left_bounds.x1", "right_bounds.x1")
    y = F.greatest("left_bounds.y1", "right_bounds.y1")
    touch = (x <= F.least("left_bounds.x2", "right_bounds.x2")) & (y <= F.least("left_bounds.y2", "right_bounds.y2"))
    own = met.filter(touch & (F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy")))
    pairs = own.withColumn("o", overlap(F.col("left_polygon"), F.col("right_polygon"))).filter("o.intersection > 0")
    return pairs.select(*(F.col("_scene").alias(c) for c in at), "left_id", "right_id", "o.*")


def detection_errors(pairs: DataFrame, group_of: DataFrame, scene: str) -> DataFrame:
    """(scene, merge_errors, cross_merges, split_errors) over ``pairs`` of regions (left) and predictions (right).

    A prediction that covers 0.6 of two regions or more merges them, across groups if these differ; a region is split if two
    predictions or more cover 0.2 of it and lie in it by half. ``group_of`` has (scene, left_id, group_id). Scenes without pairs have no row.
    """
    covered = pairs.filter("fraction_a >= 0.6").join(group_of, [scene, "left_id"])
    merges = covered.groupBy(scene, "right_id").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups")).filter("n >= 2")
    merged = merges.groupBy(scene).agg(F.count("*").alias("merge_errors"), F.count_if(F.col("groups") >= 2).alias("cross_merges"))
    parts = pairs.filter("fraction_a >= 0.2 AND fraction_b >= 0.5").groupBy(scene, "left_id").agg(F.count("*").alias("n")).filter("n >= 2")
    split = parts.groupBy(scene).agg(F.count("*").alias("split_errors"))
    every = pairs.select(scene).distinct().join(merged, scene, "left").join(split, scene, "left")
    return every.select(scene, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("merge_errors", "cross_merges", "split_errors")))
