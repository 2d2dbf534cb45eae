"""Geometry as Column expressions. Points are (lon, lat) in degrees; a ring is array<array<double>> of [lon, lat]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewise import config as C


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * C.EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def tile_id(lat, lon) -> Column:
    return F.format_string("%.5f_%.5f", lat, lon)


def tile_bbox(lat, lon, half: float = C.HALF_WINDOW) -> Column:
    """west, south, east, north."""
    return F.array(lon - half, lat - half, lon + half, lat + half)


def in_bbox(lat, lon, bbox=C.METRO_BBOX) -> Column:
    s, w, n, e = bbox
    return lat.between(s, n) & lon.between(w, e)


def on_grid(lat, lon, bbox=C.METRO_BBOX, tol: float = 5e-5) -> Column:
    """Whether a point is a centre of the grid that starts in bbox; tol is in cells."""
    off = lambda x, start, stride: F.abs((x - (start + stride / 2)) / stride - F.rint((x - (start + stride / 2)) / stride))
    return (off(lat, bbox[0], C.STRIDE_LAT) < tol) & (off(lon, bbox[1], C.STRIDE_LON) < tol)


def _before(ring) -> Column:
    """ring, each place holding the vertex before it."""
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))


def in_ring(lon, lat, ring) -> Column:
    """Even-odd rule with strict comparison on latitude."""
    cross = F.zip_with(ring, _before(ring), lambda a, b: ((a[1] > lat) != (b[1] > lat)) & (lon < (b[0] - a[0]) * (lat - a[1]) / (b[1] - a[1] + F.lit(1e-12)) + a[0]))
    return F.size(F.filter(cross, lambda x: x)) % 2 == 1


def in_polygons(lon, lat, polygons, holes: str = "exclude") -> Column:
    """polygons: array of polygons, each an outer ring and its holes.

    holes: "exclude" (a point in a hole is outside), "ignore" (outer rings alone), "any_ring" (any ring counts).
    """
    if holes == "ignore":
        return F.exists(polygons, lambda p: in_ring(lon, lat, p[0]))
    if holes == "any_ring":
        return F.exists(F.flatten(polygons), lambda r: in_ring(lon, lat, r))
    return F.exists(polygons, lambda p: in_ring(lon, lat, p[0]) & ~F.exists(F.slice(p, 2, F.size(p)), lambda r: in_ring(lon, lat, r)))


def bbox_of(polygons) -> Column:
    """struct(west, south, east, north) over all rings."""
    points = F.flatten(F.flatten(polygons))
    lon, lat = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def bbox_overlap(a, b) -> Column:
    """Overlap in square degrees of two struct(west, south, east, north), 0 where they don't meet."""
    w = F.least(a["east"], b["east"]) - F.greatest(a["west"], b["west"])
    h = F.least(a["north"], b["north"]) - F.greatest(a["south"], b["south"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def _shoelace(ring, sx, sy) -> Column:
    pairs = F.zip_with(_before(ring), ring, lambda a, b: a[0] * sx * (b[1] * sy) - b[0] * sx * (a[1] * sy))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)) / 2


def mean_lat(ring) -> Column:
    """The sum carries what each addition rounds off, so the mean doesn't depend on the order of the vertices."""

    def add(a, p):
        s, x, t = a["s"], p[1], a["s"] + p[1]
        off = F.when(F.abs(s) >= F.abs(x), (s - t) + x).otherwise((x - t) + s)
        return F.struct(t.alias("s"), (a["c"] + off).alias("c"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    return F.aggregate(ring, start, add, lambda a: a["s"] + a["c"]) / F.size(ring)


def ring_area_m2(ring) -> Column:
    """On a local flat grid at the ring's mean latitude (the closing vertex counts twice); 0 for fewer than 4 points."""
    sx = F.lit(C.METRES_PER_DEGREE) * F.cos(F.radians(mean_lat(ring)))
    return F.when(F.size(ring) < 4, 0.0).otherwise(_shoelace(ring, sx, F.lit(C.METRES_PER_DEGREE)))


def polygon_area_km2(polygon) -> Column:
    """Outer ring less its holes, all at the outer ring's mean latitude."""
    deg = F.lit(C.EARTH_KM) * F.radians(F.lit(1.0))
    sx = deg * F.cos(F.radians(mean_lat(polygon[0])))
    areas = F.transform(polygon, lambda r: _shoelace(r, sx, deg))
    return F.greatest(F.lit(0.0), areas[0] - F.aggregate(F.slice(areas, 2, F.size(areas)), F.lit(0.0), lambda s, x: s + x))


def ring_centroid(ring) -> Column:
    """Mean of the vertices, the closing one included: struct(lon, lat)."""
    return F.struct((F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[0]) / F.size(ring)).alias("lon"), mean_lat(ring).alias("lat"))


def closed(ring) -> Column:
    return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def cell_ring(lat, lon, half_lat: float = C.STRIDE_LAT / 2, half_lon: float = C.STRIDE_LON / 2) -> Column:
    """The closed ring of a grid cell."""
    p = lambda dx, dy: F.array(lon + dx * half_lon, lat + dy * half_lat)
    return F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1), p(-1, -1))


def metres_per_pixel(lat, pixels: int, half: float = C.HALF_WINDOW) -> Column:
    return F.lit(2 * half * C.METRES_PER_DEGREE) * F.cos(F.radians(lat)) / pixels


def pixel_to_lonlat(x, y, lat, lon, pixels: int, half: float = C.HALF_WINDOW) -> tuple[Column, Column]:
    """Row 0 is the northern edge."""
    return lon - half + x / pixels * (2 * half), lat + half - y / pixels * (2 * half)


def lonlat_to_pixel(px_lon, px_lat, lat, lon, pixels: int, half: float = C.HALF_WINDOW) -> tuple[Column, Column]:
    return ((px_lon - (lon - half)) / (2 * half) * pixels).cast("int"), ((lat + half - px_lat) / (2 * half) * pixels).cast("int")


def padded_bbox(ring, pad_m: float = 60.0) -> Column:
    """A box that is square in metres, pad_m larger than the ring on each side and twice pad_m wide at least."""
    b = bbox_of(F.array(F.array(ring)))
    lat, lon = (b["south"] + b["north"]) / 2, (b["west"] + b["east"]) / 2
    m_lon = F.lit(C.METRES_PER_DEGREE_SITE) * F.cos(F.radians(lat))
    half = F.greatest(F.lit(pad_m), F.greatest((b["east"] - b["west"]) * m_lon, (b["north"] - b["south"]) * C.METRES_PER_DEGREE_SITE) / 2 + pad_m)
    return F.struct((lon - half / m_lon).alias("west"), (lat - half / C.METRES_PER_DEGREE_SITE).alias("south"), (lon + half / m_lon).alias("east"), (lat + half / C.METRES_PER_DEGREE_SITE).alias("north"))


def representative_point(polygons) -> Column:
    """Centre of the box of the polygon with the largest box: struct(lon, lat)."""
    boxes = F.transform(polygons, lambda p: bbox_of(F.array(p)))
    best = F.array_max(F.transform(boxes, lambda b: F.struct(((b["east"] - b["west"]) * (b["north"] - b["south"])).alias("a"), b.alias("b"))))["b"]
    return F.struct(((best["west"] + best["east"]) / 2).alias("lon"), ((best["south"] + best["north"]) / 2).alias("lat"))


def raster_tile(lat, lon) -> Column:
    """The name of the 3-degree land-cover tile that holds a point."""
    y, x = (F.floor(lat / 3) * 3).cast("int"), (F.floor(lon / 3) * 3).cast("int")
    return F.concat(F.when(y >= 0, "N").otherwise("S"), F.lpad(F.abs(y).cast("string"), 2, "0"), F.when(x >= 0, "E").otherwise("W"), F.lpad(F.abs(x).cast("string"), 3, "0"))


def export_url(base: str, lat, lon, pixels: int, half: float = C.HALF_WINDOW) -> Column:
    """URL of an imagery export for a tile, in EPSG:3857."""
    r = 6378137.0
    mx = lambda x: F.radians(x) * r
    my = lambda y: F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians(y) / 2)) * r
    box = F.format_string("%.3f,%.3f,%.3f,%.3f", mx(lon - half), my(lat - half), mx(lon + half), my(lat + half))
    return F.concat(F.lit(f"{base}?bbox="), F.url_encode(box), F.lit(f"&bboxSR=3857&imageSR=3857&size={pixels},{pixels}&format=jpg&f=image"))
