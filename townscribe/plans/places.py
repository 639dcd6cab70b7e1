"""Geometry over squares laid around customers' made-up coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial
from ..sources.tables import table
from .registry import query

LAT, LON = "35 + (c_custkey % 50) * 0.01", "-78 + (c_nationkey % 25) * 0.01"


def squares(spark: SparkSession, d: str) -> DataFrame:
    """place_id, name, lat, lon, polygons: every third customer has a square around it."""
    lat, lon, half = F.expr(LAT), F.expr(LON), F.expr("0.001 * (1 + c_custkey % 4)")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), half.cast("double").alias("h"))
    p = lambda dx, dy: F.struct((F.col("lon") + dx * F.col("h")).alias("lon"), (F.col("lat") + dy * F.col("h")).alias("lat"))
    ring = F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1), p(-1, -1))
    return c.withColumn("polygons", F.when(F.col("place_id") % 3 == 0, F.array(F.array(ring))).otherwise(F.array().cast(f"array<array<array<{geo.POINT}>>>"))).drop("h")


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), (35 + (F.col("s_suppkey") % 50) * 0.01 + 0.0004).alias("lat"), (-78 + (F.col("s_nationkey") % 25) * 0.01 + 0.0003).alias("lon"))


SQL_NEAR = f"""
with p as (select c_custkey as place_id, c_name as name, cast({LAT} as double) as lat, cast({LON} as double) as lon, 0.001 * (1 + c_custkey % 4) as h, c_custkey % 3 = 0 as sq from customer),
q as (select s_suppkey as query_id, 35 + (s_suppkey % 50) * 0.01 + 0.0004 as qlat, -78 + (s_nationkey % 25) * 0.01 + 0.0003 as qlon from supplier)
select query_id, place_id from p join q on sq and abs(qlat - lat) < h and abs(qlon - lon) < h
"""


@query("point_in_polygon", SQL_NEAR)
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.containing(points(spark, d), squares(spark, d))


M = "(6371000.0 * pi() / 180)"
# the square's sides, its shoelace sum in the order of its edges, and its area
SQUARE = f"""
s as (select c_custkey as place_id, c_name as name, cast({LAT} as double) as lat, cast({LON} as double) as lon, cast(0.001 * (1 + c_custkey % 4) as double) as h, c_custkey % 3 = 0 as sq from customer),
b as (select *, lon - h as x1, lon + h as x2, lat - h as y1, lat + h as y2 from s),
a as (select *, abs(((((((x1 * y1) - x2 * y1) + x2 * y2) - x2 * y1) + x2 * y2) - x1 * y2) + x1 * y1 - x1 * y2) / 2 * ({M} * {M} * cos(radians((y1 + y1 + y2 + y2 + y1) / 5))) as area from b)
"""


@query(
    "nearby_places",
    f"""
with {SQUARE},
q as (select s_suppkey as query_id, cast(35 + (s_suppkey % 50) * 0.01 + 0.0004 as double) as qlat, cast(-78 + (s_nationkey % 25) * 0.01 + 0.0003 as double) as qlon from supplier),
j as (select *, sq and qlat between y1 and y2 and qlon between x1 and x2 as inside,
  case when sq then sqrt(pow(greatest(x1 - qlon, 0, qlon - x2) * {M} * cos(radians(qlat)), 2) + pow(greatest(y1 - qlat, 0, qlat - y2) * {M}, 2))
  else 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lat - qlat) / 2), 2) + cos(radians(qlat)) * cos(radians(lat)) * pow(sin(radians(lon - qlon) / 2), 2)))) end as metres from a, q),
f as (select query_id, place_id, name, case when inside then 'inside_boundary' when sq then 'near_boundary' else 'nearby_point' end as kind, case when inside then area else 0.0 end as area_m2, case when inside then 0.0 else metres end as distance_m
  from j where inside or (sq and metres <= 3219) or (not sq and metres <= 8047)),
r as (select *, row_number() over (partition by query_id order by kind, area_m2, distance_m, lower(name), place_id) as rank from (select * replace (kind as kind) from f))
select query_id, place_id, name, kind, round(area_m2, 3) as area_m2, round(distance_m, 3) as distance_m, cast(rank as integer) as rank from r where rank <= 5
""",
)
def nearby_places(spark: SparkSession, d: str) -> DataFrame:
    """The five best places around each point: inside, near a boundary, near a point."""
    return spatial.nearby(points(spark, d), squares(spark, d), 5).withColumns({c: F.round(c, 3) for c in ("area_m2", "distance_m")})


@query(
    "haversine",
    f"""
with p as (select c_custkey as id, cast({LAT} as double) as lat, cast({LON} as double) as lon from customer)
select id, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(35.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(35.0)) * pow(sin(radians(-78.0 - lon) / 2), 2)))), 3) as metres from p
""",
)
def haversine(spark: SparkSession, d: str) -> DataFrame:
    s = squares(spark, d)
    return s.select(F.col("place_id").alias("id"), F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(35.0), F.lit(-78.0)), 3).alias("metres"))


@query(
    "polygon_measures",
    f"""
with {SQUARE}, e as (select *, greatest(x1 + 78, 0, -78 - x2) * {M} * cos(radians(35.0)) as dx, greatest(y1 - 35, 0, 35 - y2) * {M} as dy,
  least((-78 - x1) * {M} * cos(radians(35.0)), (x2 + 78) * {M} * cos(radians(35.0)), (35 - y1) * {M}, (y2 - 35) * {M}) as within from a where sq)
select place_id, round(area, 3) as area_m2, round((y1 + y2) / 2, 6) as centre_lat, round((x1 + x2 + x2 + x1 + x1) / 5, 6) as mean_lon, round(case when dx = 0 and dy = 0 then abs(within) else sqrt(dx * dx + dy * dy) end, 3) as boundary_m from e
""",
)
def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    s = squares(spark, d).where(F.size("polygons") > 0)
    one = F.get(F.get("polygons", F.lit(0)), F.lit(0))
    return s.select("place_id", F.round(geo.polygon_area_m2(F.get("polygons", F.lit(0))), 3).alias("area_m2"), F.round(geo.bbox_centre(F.col("polygons"))["lat"], 6).alias("centre_lat"), F.round(geo.vertex_mean(one)["lon"], 6).alias("mean_lon"), F.round(geo.boundary_distance_m(F.lit(-78.0), F.lit(35.0), F.col("polygons")), 3).alias("boundary_m"))


@query(
    "bbox_places",
    f"""
with p as (select c_custkey as id, cast({LAT} as double) as lat, case when c_custkey % 2 = 0 then 'south' else 'north' end as claimed from customer),
b as (select * from (values ('south', 35.0, 35.2), ('middle', 35.15, 35.3), ('north', 35.35, 35.5)) t(place, lo, hi)),
h as (select id, claimed, list(place) filter (where lat between lo - 0.012 and hi + 0.012) as places from p, b group by 1, 2)
select id as point_id, claimed, case when list_contains(places, claimed) then claimed when len(places) = 1 then places[1] else 'unknown' end as place from h
""",
)
def bbox_places(spark: SparkSession, d: str) -> DataFrame:
    s = squares(spark, d).select(F.col("place_id").alias("point_id"), "lat", "lon", F.when(F.col("place_id") % 2 == 0, "south").otherwise("north").alias("claimed"))
    boxes = spark.createDataFrame([("south", (-180.0, 35.0, 180.0, 35.2)), ("middle", (-180.0, 35.15, 180.0, 35.3)), ("north", (-180.0, 35.35, 180.0, 35.5))], "place string, box struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>")
    return spatial.bbox_places(s, boxes, pad=0.012)


@query("location_quality", "select c_custkey as id, case when c_custkey % 3 = 0 then 'polygon' when c_custkey % 5 <> 0 and c_custkey % 7 <> 0 then 'address' when c_custkey % 7 <> 0 and c_custkey % 11 <> 0 then 'zip_centroid' else 'city_only' end as quality from customer")
def location_quality(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    q = geo.location_quality(k % 3 == 0, F.when(k % 5 != 0, F.lit("1 Main St")), F.when(k % 7 != 0, F.lit(35.0)), F.when(k % 11 != 0, F.lit("27601")))
    return table(spark, d, "customer").select(k.alias("id"), q.alias("quality"))


@query("pin_refit", f"with {SQUARE} select place_id, round(case when place_id % 2 = 0 then (y1 + y2) / 2 else lat end, 6) as lat, round(case when place_id % 2 = 0 then (x1 + x2) / 2 else lon end, 6) as lon from a where sq")
def pin_refit(spark: SparkSession, d: str) -> DataFrame:
    s = squares(spark, d).where(F.size("polygons") > 0)
    moved = geo.moved_pin(F.col("lat") + F.when(F.col("place_id") % 2 == 0, 0.05).otherwise(0.0), F.col("lon"), F.col("polygons"))
    return s.select("place_id", moved.alias("m")).select("place_id", F.round("m.lat", 6).alias("lat"), F.round("m.lon", 6).alias("lon"))
