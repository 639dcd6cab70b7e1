"""Geometry over array columns: rings are array<struct<lon, lat>>, polygons arrays of rings (first the outer one).

Everything is a higher-order expression, so a join's cheap bounding-box condition runs first
and the exact test is evaluated only on its survivors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
DEGREE_KM = 111.32
METRES_A_DEGREE = EARTH_M * math.pi / 180
POINT = "struct<lon:double,lat:double>"
EDGE = f"struct<a:{POINT},b:{POINT}>"


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a plane of 111.32 km a degree, longitude shrunk by latitude."""
    return F.sqrt(F.pow((lat2 - lat1) * DEGREE_KM, 2) + F.pow((lon2 - lon1) * DEGREE_KM * F.cos(F.radians(lat1)), 2))


def polygons(geojson: Column) -> Column:
    """Polygons of a GeoJSON Polygon or MultiPolygon; empty if any ring is unsound."""
    kind = F.get_json_object(geojson, "$.type")
    one = F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<double>>>")
    many = F.from_json(F.get_json_object(geojson, "$.coordinates"), "array<array<array<array<double>>>>")
    raw = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    rings = F.transform(raw, lambda p: F.transform(p, normal_ring))
    sound = F.forall(rings, lambda p: p.isNotNull() & F.forall(p, lambda r: r.isNotNull()))
    return F.when(raw.isNotNull() & F.coalesce(sound, F.lit(False)), F.filter(rings, lambda p: F.size(p) > 0)).otherwise(F.array().cast(f"array<array<array<{POINT}>>>"))


def normal_ring(ring: Column) -> Column:
    """A closed ring of at least four points without consecutive repeats; null if it is unsound."""
    ok = F.forall(ring, lambda c: (F.size(c) >= 2) & F.coalesce(F.get(c, F.lit(0)).between(-180, 180) & F.get(c, F.lit(1)).between(-90, 90), F.lit(False)))
    points = F.transform(ring, lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat")))
    points = F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))
    closed = F.when(F.get(points, F.lit(0)) != F.element_at(points, -1), F.concat(points, F.array(F.get(points, F.lit(0))))).otherwise(points)
    return F.when(ok & (F.size(points) >= 3), F.when(F.size(closed) >= 4, closed))


def edges(ring: Column) -> Column:
    """A ring's edges as structs a, b."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))


def on_segment(lon: Column, lat: Column, e: Column, eps: float = 1e-12) -> Column:
    ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
    length = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    cross = (lon - ax) * (by - ay) - (lat - ay) * (bx - ax)
    along = (lon - ax) * (bx - ax) + (lat - ay) * (by - ay)
    return F.when(length <= eps * eps, F.pow(lon - ax, 2) + F.pow(lat - ay, 2) <= eps * eps).otherwise((F.abs(cross) <= eps) & (along >= -eps) & (along - length <= eps))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule; the boundary is inside."""
    es = edges(ring)
    crosses = lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / F.when(e["b"]["lat"] == e["a"]["lat"], F.lit(1e-15)).otherwise(e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"])
    return F.exists(es, lambda e: on_segment(lon, lat, e)) | (F.size(F.filter(es, crosses)) % 2 == 1)


def in_polygon(lon: Column, lat: Column, polygon: Column) -> Column:
    """In the outer ring, and in (or on) no hole."""
    return F.coalesce(in_ring(lon, lat, F.get(polygon, F.lit(0))) & ~F.exists(F.slice(polygon, 2, 1_000_000), lambda r: in_ring(lon, lat, r)), F.lit(False))


def in_any(lon: Column, lat: Column, many: Column) -> Column:
    return F.exists(many, lambda p: in_polygon(lon, lat, p))


def segment_distance_m(lon: Column, lat: Column, e: Column) -> Column:
    """Metres from a point to an edge on a local plane around the point."""
    kx, ky = METRES_A_DEGREE * F.cos(F.radians(lat)), F.lit(METRES_A_DEGREE)
    ax, ay, bx, by = (e["a"]["lon"] - lon) * kx, (e["a"]["lat"] - lat) * ky, (e["b"]["lon"] - lon) * kx, (e["b"]["lat"] - lat) * ky
    dx, dy = bx - ax, by - ay
    t = F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def boundary_distance_m(lon: Column, lat: Column, many: Column) -> Column:
    """Metres to the nearest edge of any ring."""
    return F.array_min(F.transform(F.flatten(F.transform(F.flatten(many), edges)), lambda e: segment_distance_m(lon, lat, e)))


def ring_area_m2(ring: Column) -> Column:
    """Shoelace area, longitude scaled by the ring's own mean latitude."""
    n = F.size(ring)
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / n
    k = METRES_A_DEGREE * METRES_A_DEGREE * F.cos(F.radians(mean))
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])) / 2 * k


def polygon_area_m2(polygon: Column) -> Column:
    holes = F.aggregate(F.slice(polygon, 2, 1_000_000), F.lit(0.0), lambda s, r: s + ring_area_m2(r))
    return F.greatest(F.lit(0.0), ring_area_m2(F.get(polygon, F.lit(0))) - holes)


def bbox(many: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) over all vertices."""
    pts = F.flatten(F.flatten(many))
    lon, lat = F.transform(pts, lambda p: p["lon"]), F.transform(pts, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))


def bbox_centre(many: Column) -> Column:
    b = bbox(many)
    return F.struct(((b["min_lon"] + b["max_lon"]) / 2).alias("lon"), ((b["min_lat"] + b["max_lat"]) / 2).alias("lat"))


def vertex_mean(ring: Column) -> Column:
    """Mean of a ring's vertices, the closing one counted too."""
    n = F.size(ring)
    return F.struct((F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lon"]) / n).alias("lon"), (F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / n).alias("lat"))


def in_bbox(lon: Column, lat: Column, b: Column, pad: float = 0.05) -> Column:
    return lon.between(b["min_lon"] - pad, b["max_lon"] + pad) & lat.between(b["min_lat"] - pad, b["max_lat"] + pad)


def location_quality(has_polygon: Column, street: Column, lat: Column, postal: Column) -> Column:
    return F.when(has_polygon, "polygon").when((F.coalesce(street, F.lit("")) != "") & lat.isNotNull(), "address").when((F.coalesce(postal, F.lit("")) != "") & lat.isNotNull(), "zip_centroid").otherwise("city_only")


# From the best known place to the least.
QUALITY = ["polygon", "address", "zip_centroid", "place_centroid", "city_only", "unknown"]


def quality_rank(quality: Column) -> Column:
    """0 for the best; unknown words rank last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(q) for q in QUALITY)), quality), F.lit(0)) - 1, F.lit(len(QUALITY)))


def moved_pin(lat: Column, lon: Column, many: Column, limit_km: float = 1.5) -> Column:
    """A pin at the polygon's centre if it lies further than ``limit_km`` from it, else where it is."""
    c = bbox_centre(many)
    far = planar_km(lat, lon, c["lat"], c["lon"]) > limit_km
    return F.when(far, c).otherwise(F.struct(lon.alias("lon"), lat.alias("lat")))


def audited_quality(has_boundary: Column, street: Column, postal_code: Column, lat: Column, city: Column) -> Column:
    """How well a location is known when it is audited: a ZIP counts with a latitude only, and nothing at all is null."""
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(has_boundary, "polygon").when(there(street), "address").when(there(postal_code) & lat.isNotNull(), "zip_centroid").when(there(city), "city_only")
