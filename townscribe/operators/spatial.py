"""Joins of points with places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

NEAR_POINT_M = 8_047.0
NEAR_BOUNDARY_M = 3_219.0
#: Degrees of a cell in which polygons are looked for.
NEAR_CELL = NEAR_BOUNDARY_M / geo.METRES_A_DEGREE * 4
#: Boxes that every point may be held against.
BOXES = 10_000


def _cells(rows: DataFrame, box: Column, reach_m: float, cell: float) -> DataFrame:
    """``rows`` once for each cell of a degree grid that their box, widened by ``reach_m``, touches: with _row, _col and the widened _box."""
    reach = reach_m / geo.METRES_A_DEGREE
    rows = rows.withColumn("_box", box).where("_box.min_lat is not null and _box.min_lon is not null")
    # a degree of longitude is short towards the poles
    farthest = F.radians(F.greatest(F.abs("_box.min_lat"), F.abs("_box.max_lat")) + reach)
    wide = reach / F.greatest(F.cos(farthest), F.lit(math.cos(math.radians(89))))
    at = lambda c, by: F.col(f"_box.{c}") + by
    rows = rows.withColumn("_box", F.struct(at("min_lon", -wide).alias("min_lon"), at("min_lat", -reach).alias("min_lat"), at("max_lon", wide).alias("max_lon"), at("max_lat", reach).alias("max_lat")))
    steps = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"_box.{low}") / cell), F.floor(F.col(f"_box.{high}") / cell)))
    return rows.withColumn("_row", steps("min_lat", "max_lat")).withColumn("_col", steps("min_lon", "max_lon"))


def _met(rows: DataFrame, queries: DataFrame, cell: float) -> DataFrame:
    """Pairs of a query and a row in whose widened box it lies."""
    q = queries.withColumns({"_qrow": F.floor(F.col("q_lat") / cell), "_qcol": F.floor(F.col("q_lon") / cell)})
    in_box = F.col("q_lat").between(F.col("_box.min_lat"), F.col("_box.max_lat")) & F.col("q_lon").between(F.col("_box.min_lon"), F.col("_box.max_lon"))
    return rows.join(q, (F.col("_row") == F.col("_qrow")) & (F.col("_col") == F.col("_qcol")) & in_box)


def _shaped() -> Column:
    return F.coalesce(F.size("polygons") > 0, F.lit(False))


def _forms(places: DataFrame) -> DataFrame:
    """``places`` with _form, a digest of what is measured: the polygons, or the point where there are none."""
    return places.withColumn("_form", F.sha2(F.when(_shaped(), F.to_json("polygons")).otherwise(F.to_json(F.struct("lat", "lon"))), 256))


def _spots(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Query points as (query_id, q_lat, q_lon), and each place where some lie, once."""
    q = points.select("query_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
    return q, q.select("q_lat", "q_lon").dropna().distinct()


def containing(points: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, place_id): the places (place_id, polygons) in whose polygons, their edges included, query points (query_id, lat, lon) lie.

    Each polygon is tested once for each place where points lie, however many points lie there and
    places have that polygon; only what is found is joined with them.
    """
    q, spots = _spots(points)
    places = places.where(_shaped()).select("place_id", "polygons", F.sha2(F.to_json("polygons"), 256).alias("_form"))
    outlines = places.groupBy("_form").agg(F.any_value("polygons").alias("polygons"))
    # a metre more than the box, for points on its edge
    met = _met(_cells(outlines, geo.bbox(F.col("polygons")), 1.0, NEAR_CELL), spots, NEAR_CELL)
    # exploded, as a plain filter would be taken into the join and run before its boxes are compared
    inside = F.explode_outer(F.array(geo.in_any(F.col("q_lon"), F.col("q_lat"), F.col("polygons"))))
    hits = met.select("q_lat", "q_lon", "_form", inside.alias("inside")).where("inside").select("q_lat", "q_lon", "_form")
    return hits.join(places.select("place_id", "_form"), "_form").join(q, ["q_lat", "q_lon"]).select("query_id", "place_id")


def nearby(points: DataFrame, places: DataFrame, limit: int | None = None, near_point_m: float = NEAR_POINT_M, near_boundary_m: float = NEAR_BOUNDARY_M) -> DataFrame:
    """Places around query points (query_id, lat, lon), best first.

    ``places`` has place_id, name, lat, lon, polygons.  Inside a polygon (smallest first) beats
    near a boundary beats near a point.  Queries meet places on cells of a degree grid, points
    within their reach and polygons within theirs, never on all pairs.  Points are measured by
    one formula; polygons by their edges, and their box and area are columns before the join.

    Queries at one point and places of one form are measured and ranked once.  With a limit, forms
    that as many others beat are left before their places are looked up, and of a form's places,
    which only their names rank, no more than the limit are.
    """
    q, spots = _spots(points)
    places = _forms(places)
    spot = F.struct(F.col("lon").alias("min_lon"), F.col("lat").alias("min_lat"), F.col("lon").alias("max_lon"), F.col("lat").alias("max_lat"))
    cell = near_point_m / geo.METRES_A_DEGREE * 2
    dots = places.where(~_shaped()).groupBy("_form").agg(F.any_value("lat").alias("lat"), F.any_value("lon").alias("lon"))
    plain = _met(_cells(dots, spot, near_point_m, cell), spots, cell)
    metres = geo.haversine_m(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))
    plain = plain.select("q_lat", "q_lon", "_form", F.lit("nearby_point").alias("kind"), F.lit(2).alias("priority"), F.lit(0.0).alias("area_m2"), metres.alias("distance_m")).where(F.col("distance_m") <= near_point_m)

    cell = near_boundary_m / geo.METRES_A_DEGREE * 4
    area = F.array_min(F.transform("polygons", geo.polygon_area_m2))
    edges = F.flatten(F.transform(F.flatten("polygons"), geo.edges))
    outlined = places.where(_shaped()).groupBy("_form").agg(F.any_value("polygons").alias("polygons")).withColumns({"area": area, "edges": edges})
    found = _met(_cells(outlined, geo.bbox(F.col("polygons")), near_boundary_m, cell), spots, cell)
    # only points in the box (a metre more than it) can be inside; the others are measured from each edge, a row an edge;
    # outer, or its filter for empty arrays would be taken into the join and run before the boxes are compared
    margin = F.lit((near_boundary_m - 1.0) / geo.METRES_A_DEGREE)
    boxed = F.col("q_lat").between(F.col("_box.min_lat") + margin, F.col("_box.max_lat") - margin) & F.col("q_lon").between(F.col("_box.min_lon") + margin, F.col("_box.max_lon") - margin)
    inside = boxed & geo.in_any(F.col("q_lon"), F.col("q_lat"), F.col("polygons"))
    edge = F.explode_outer(F.when(inside, F.array(F.lit(None).cast(geo.EDGE))).otherwise(F.col("edges")))
    away = F.when(F.col("e").isNull(), F.lit(-1.0)).otherwise(geo.segment_distance_m(F.col("q_lon"), F.col("q_lat"), F.col("e")))
    found = found.select("q_lat", "q_lon", "_form", "area", edge.alias("e")).groupBy("q_lat", "q_lon", "_form").agg(F.any_value("area").alias("area"), F.min(away).alias("edge")).where(F.col("edge") <= near_boundary_m)
    at = lambda yes, no: F.when(F.col("edge") < 0, yes).otherwise(no)
    found = found.select("q_lat", "q_lon", "_form", at(F.lit("inside_boundary"), F.lit("near_boundary")).alias("kind"), at(F.lit(0), F.lit(1)).alias("priority"), at(F.col("area"), F.lit(0.0)).alias("area_m2"), at(F.lit(0.0), F.col("edge")).alias("distance_m"))
    met, named = found.unionAll(plain), places.select("_form", "place_id", "name")
    best, w = ["priority", "area_m2", "distance_m"], Window.partitionBy("q_lat", "q_lon")
    if limit is not None:
        met = met.withColumn("_n", F.rank().over(w.orderBy(*best))).where(F.col("_n") <= limit).drop("_n")
        named = named.withColumn("_n", F.row_number().over(Window.partitionBy("_form").orderBy(F.lower("name"), "place_id"))).where(F.col("_n") <= limit).drop("_n")
    out = met.join(named, "_form").withColumn("rank", F.row_number().over(w.orderBy(*best, F.lower("name"), "place_id")))
    out = out if limit is None else out.where(F.col("rank") <= limit)
    return q.join(out, ["q_lat", "q_lon"]).select("query_id", "place_id", "name", "kind", "area_m2", "distance_m", "rank")


def bbox_places(points: DataFrame, boxes: DataFrame, pad: float = 0.05) -> DataFrame:
    """(point_id, claimed, place): the claimed place if the point is in its box, the only matching box, or unknown.

    ``points`` has point_id, lat, lon, claimed; ``boxes`` (place, box) is a table of places known
    beforehand, some tens of rows: more than BOXES are refused, as every point looks at each.
    """
    if boxes.limit(BOXES + 1).count() > BOXES:
        raise ValueError(f"more than {BOXES} boxes")
    b = boxes.select(F.col("place").alias("_place"), F.col("box").alias("_box"))
    hits = points.join(F.broadcast(b), geo.in_bbox(F.col("lon"), F.col("lat"), F.col("_box"), pad), "left").groupBy("point_id", "claimed").agg(F.collect_set("_place").alias("_in"))
    place = F.when(F.array_contains("_in", F.coalesce("claimed", F.lit(""))), F.col("claimed")).when(F.size("_in") == 1, F.get("_in", F.lit(0))).otherwise("unknown")
    return hits.select("point_id", "claimed", place.alias("place"))
