"""Geographic functions on columns: distance, geohash, boxes, point in polygon, map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.dates import bound

EARTH_RADIUS = 6_371_000.0
#: The digits of geohashes.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres along a great circle."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.asin(F.sqrt(h)) * (2 * EARTH_RADIUS)


def geohash(lat: Column, lng: Column, precision: int = 7) -> Column:
    """Closed form: both coordinates as integers of their bits, interleaved with longitude first."""
    bits = 5 * precision
    lng_bits, lat_bits = (bits + 1) // 2, bits // 2

    def cell(c: Column, low: float, span: float, n: int) -> Column:
        return F.least(F.floor((c - low) / span * 2**n), F.lit(2**n - 1)).cast("long")

    x, y = cell(lng, -180.0, 360.0, lng_bits), cell(lat, -90.0, 180.0, lat_bits)
    out = []
    for k in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5 * k, 5 * k + 5):  # bit b of the whole, from the highest
            source, at = (x, lng_bits - 1 - b // 2) if b % 2 == 0 else (y, lat_bits - 1 - b // 2)
            value = value * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1))
        out.append(F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1)))
    return F.when(lat.isNotNull() & lng.isNotNull(), F.concat(*out))


def quantised(c: Column, digits: int = 3) -> Column:
    """Fixed decimals, for cache keys."""
    return F.format_string(f"%.{digits}f", c)


def padded_bounds(points: DataFrame, lat: str = "lat", lng: str = "lng", share: float = 0.12, least: float = 0.05) -> DataFrame:
    """Bounds of all points, widened by a share of their span, by at least so many degrees."""
    b = points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).agg(F.min(lat).alias("a"), F.max(lat).alias("b"), F.min(lng).alias("c"), F.max(lng).alias("d"))
    pad = lambda lo, hi: F.greatest((F.col(hi) - F.col(lo)) * share, F.lit(least))
    return b.select((F.col("a") - pad("a", "b")).alias("south"), (F.col("b") + pad("a", "b")).alias("north"), (F.col("c") - pad("c", "d")).alias("west"), (F.col("d") + pad("c", "d")).alias("east"))


def position(c: Column, low: Column, high: Column, margin: float = 4.0) -> Column:
    """A coordinate as a percentage of its bounds, kept off the rim."""
    return F.least(F.greatest((c - low) / F.nullif(high - low, F.lit(0.0)) * 100, F.lit(margin)), F.lit(100 - margin))


RINGS = "array<array<array<double>>>"


def polygon_rings(geojson: Column) -> Column:
    """All rings of a Polygon or MultiPolygon, Feature or bare, as arrays of [lng, lat]."""
    shape = F.coalesce(F.get_json_object(geojson, "$.geometry"), geojson)
    kind = F.get_json_object(shape, "$.type")
    text = F.get_json_object(shape, "$.coordinates")
    return F.when(kind == "Polygon", F.from_json(text, RINGS)).when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<{RINGS}>")))


def in_rings(lng: Column, lat: Column, rings: Column) -> Column:
    """Even-odd ray casting over all rings: holes are outside."""

    def crossings(ring: Column) -> Column:
        ends = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def crosses(e: Column) -> Column:
            ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
            return ((ay > lat) != (by > lat)) & (lng < (bx - ax) * (lat - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

        return F.size(F.filter(ends, lambda e: F.coalesce(crosses(e), F.lit(False))))

    total = F.aggregate(rings, F.lit(0), lambda n, ring: n + crossings(ring))
    return F.pmod(total, F.lit(2)) == 1


WORLD = 360.0  # a cell of depth d is a square of WORLD / 2^d degrees; all its bounds are exact
RIM = 1e-9  # cells are taken that much wider, so that rounding at their bounds changes nothing
DEEPEST = 24


def _cell_of(lng: Column, lat: Column, depth: Column) -> tuple[Column, Column]:
    size = F.lit(WORLD) / F.pow(F.lit(2.0), depth)
    return F.floor((lng + 180) / size).cast("long"), F.floor((lat + 180) / size).cast("long")


def _narrowed(cell: Column) -> Column:
    """A cell with only the edges that a ray to the right, from a point of it, may or may not cross.

    Edges beside, left of, above or below the cell go; those right of it that every such ray crosses are counted into
    ``parity``. ``local`` is how many may run through the cell; if none does, all its points lie on one side.
    """
    size = F.lit(WORLD) / F.pow(F.lit(2.0), cell["depth"])
    x0, y0 = cell["cx"] * size - 180 - RIM, cell["cy"] * size - 180 - RIM
    x1, y1 = x0 + size + 2 * RIM, y0 + size + 2 * RIM
    low, high = lambda e: F.least(e["ay"], e["by"]), lambda e: F.greatest(e["ay"], e["by"])
    left, right = lambda e: F.least(e["ax"], e["bx"]), lambda e: F.greatest(e["ax"], e["bx"])
    kept = F.filter(cell["edges"], lambda e: (high(e) > y0) & (low(e) <= y1) & (right(e) >= x0))
    passed = lambda e: (left(e) > x1) & (low(e) <= y0) & (high(e) > y1)
    return bound(
        kept,
        lambda es: F.struct(
            cell["depth"].alias("depth"),
            cell["cx"].alias("cx"),
            cell["cy"].alias("cy"),
            F.pmod(cell["parity"] + F.size(F.filter(es, passed)), F.lit(2)).alias("parity"),
            F.size(F.filter(es, lambda e: left(e) <= x1)).alias("local"),
            F.filter(es, lambda e: ~passed(e)).alias("edges"),
        ),
    )


def _inside(lng: Column, lat: Column, parity: Column, edges: Column) -> Column:
    """The even-odd rule of in_rings() on what a cell holds."""
    crosses = lambda e: ((e["ay"] > lat) != (e["by"] > lat)) & (lng < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    return F.pmod(parity + F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))), F.lit(2)) == 1


def cells_of_polygons(polygons: DataFrame, most_edges: int = 16, splits: int = 8) -> DataFrame:
    """polygons(code, rings, order) to their cells (code, order, depth, cx, cy, parity, edges): a quadtree per polygon.

    It begins with the at most four cells that hold the polygon; a cell through which more than ``most_edges`` edges run
    is split in four, ``splits`` times at most. Cells outside go, cells inside carry no edge and need no ray.
    """
    edge = lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))
    edges = F.flatten(F.transform("rings", lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), edge)))
    flat = F.flatten(F.col("rings"))
    xs, ys = F.transform(flat, lambda p: p[0]), F.transform(flat, lambda p: p[1])
    box = polygons.where(F.size(flat) > 0).select("code", "order", edges.alias("edges"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(WORLD / 2**DEEPEST))
    deep = box.withColumn("depth", F.least(F.greatest(F.floor(F.log2(F.lit(WORLD) / span)), F.lit(0)), F.lit(DEEPEST)).cast("int"))
    (cx0, cy0), (cx1, cy1) = _cell_of(F.col("x0"), F.col("y0"), F.col("depth")), _cell_of(F.col("x1"), F.col("y1"), F.col("depth"))
    roots = deep.withColumn("cx", F.explode(F.sequence(cx0, cx1))).withColumn("cy", F.explode(F.sequence(cy0, cy1)))
    root = F.struct("depth", "cx", "cy", F.lit(0).alias("parity"), F.lit(0).alias("local"), "edges")

    def split(cell: Column) -> Column:
        def child(k: int) -> Column:
            x, y = cell["cx"] * 2 + k % 2, cell["cy"] * 2 + k // 2
            return _narrowed(F.struct((cell["depth"] + 1).alias("depth"), x.alias("cx"), y.alias("cy"), cell["parity"].alias("parity"), cell["local"].alias("local"), cell["edges"].alias("edges")))

        full = (cell["local"] > most_edges) & (cell["depth"] < DEEPEST + 8)
        return F.when(full, F.array(*[child(k) for k in range(4)])).otherwise(F.array(cell))

    begun = F.array(_narrowed(root))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(splits)), begun, lambda cells, _: F.flatten(F.transform(cells, split)))
    cells = roots.select("code", "order", F.explode(made).alias("c")).select("code", "order", "c.*")
    size = F.lit(WORLD) / F.pow(F.lit(2.0), F.col("depth"))
    centre = _inside((F.col("cx") + 0.5) * size - 180, (F.col("cy") + 0.5) * size - 180, F.col("parity"), F.col("edges"))
    settled = F.when(F.col("local") > 0, F.col("parity")).otherwise(centre.cast("int"))
    kept = cells.where((F.col("local") > 0) | centre)
    return kept.select("code", "order", "depth", "cx", "cy", settled.alias("parity"), F.when(F.col("local") > 0, F.col("edges")).otherwise(F.slice("edges", 1, 0)).alias("edges"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, most_edges: int = 16) -> DataFrame:
    """points(id, lng, lat) x polygons(code, rings, order) -> (id, code): the first containing polygon in their order.

    Points meet the polygons' cells by key, at every depth that a cell has (a list of DEEPEST + 9 at most reaches the
    driver); a ray is cast only in cells that an edge runs through, against the few edges that they carry.
    """
    cells = cells_of_polygons(polygons, most_edges)
    depths = sorted(r["depth"] for r in cells.select("depth").distinct().collect())
    placed = points.select("id", "lng", "lat", F.explode(F.array(*map(F.lit, depths)).cast("array<int>")).alias("depth"))
    cx, cy = _cell_of(F.col("lng"), F.col("lat"), F.col("depth"))
    met = placed.withColumns({"cx": cx, "cy": cy}).join(cells, ["depth", "cx", "cy"])
    return met.where(_inside(F.col("lng"), F.col("lat"), F.col("parity"), F.col("edges"))).groupBy("id").agg(F.min_by("code", "order").alias("code"))


#: The ellipsoid and the unified national grid (false origin 1 000 000 / 2 000 000, scale 0.9996, 38 N 127.5 E).
GRS80_A, GRS80_F = 6_378_137.0, 1 / 298.257222101
GRID = {"lat0": 38.0, "lng0": 127.5, "k0": 0.9996, "x0": 1_000_000.0, "y0": 2_000_000.0}
#: The older central belt on Bessel's ellipsoid, its shift in metres, turn in seconds of arc and scale in millionths.
BESSEL_GRID = {"lat0": 38.0, "lng0": 127.0028902777778, "k0": 1.0, "x0": 200_000.0, "y0": 500_000.0, "a": 6_377_397.155, "f": 1 / 299.1528128}
BESSEL_SHIFT = {"move": (-115.80, 474.99, 674.11), "turn": (1.16, -2.31, -1.63), "scale": 6.43}
WGS84_F = 1 / 298.257223563


def grid_to_degrees(x: Column, y: Column, grid: dict[str, float] = GRID) -> Column:
    """STRUCT<lat, lng>: inverse transverse Mercator by the usual series (Snyder, 1987), to seven decimals."""
    lat, lng = _unprojected(x, y, grid)
    return F.struct(F.round(F.degrees(lat), 7).alias("lat"), F.round(F.degrees(lng), 7).alias("lng"))


def bessel_to_degrees(x: Column, y: Column) -> Column:
    """STRUCT<lat, lng> in today's datum of a position in the older grid: unprojected, made geocentric, moved, turned and
    scaled, and back by Bowring's formula; to seven decimals."""
    lat, lng = _unprojected(x, y, BESSEL_GRID)
    return F.get(F.transform(F.array(F.struct(lat.alias("lat"), lng.alias("lng"))), _shifted), F.lit(0))


def _shifted(p: Column) -> Column:
    e2 = BESSEL_GRID["f"] * (2 - BESSEL_GRID["f"])
    s, c = F.sin(p["lat"]), F.cos(p["lat"])
    n = F.lit(BESSEL_GRID["a"]) / F.sqrt(1 - F.pow(s, 2) * e2)
    u, v, w = n * c * F.cos(p["lng"]), n * c * F.sin(p["lng"]), n * (1 - e2) * s
    (dx, dy, dz), (rx, ry, rz) = BESSEL_SHIFT["move"], (math.radians(t / 3600) for t in BESSEL_SHIFT["turn"])
    m = 1 + BESSEL_SHIFT["scale"] * 1e-6
    moved = F.struct(((u - v * rz + w * ry) * m + dx).alias("x"), ((u * rz + v - w * rx) * m + dy).alias("y"), ((v * rx - u * ry + w) * m + dz).alias("z"))
    return F.get(F.transform(F.array(moved), _geodetic), F.lit(0))


def _geodetic(q: Column) -> Column:
    a, b = GRS80_A, GRS80_A * (1 - WGS84_F)
    e2, ep2 = WGS84_F * (2 - WGS84_F), (a * a - b * b) / (b * b)
    across = F.hypot(q["x"], q["y"])
    t = F.atan2(q["z"] * a, across * b)
    lat = F.atan2(q["z"] + F.pow(F.sin(t), 3) * (ep2 * b), across - F.pow(F.cos(t), 3) * (e2 * a))
    return F.struct(F.round(F.degrees(lat), 7).alias("lat"), F.round(F.degrees(F.atan2(q["y"], q["x"])), 7).alias("lng"))


def _unprojected(x: Column, y: Column, grid: dict[str, float]) -> tuple[Column, Column]:
    a, f = grid.get("a", GRS80_A), grid.get("f", GRS80_F)
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    p0 = math.radians(grid["lat0"])

    def arc(p: float) -> float:
        return a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))

    mu = (F.lit(arc(p0)) + (y - grid["y0"]) / grid["k0"]) / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p1 = mu + F.sin(mu * 2) * (3 * e1 / 2 - 27 * e1**3 / 32) + F.sin(mu * 4) * (21 * e1**2 / 16 - 55 * e1**4 / 32) + F.sin(mu * 6) * (151 * e1**3 / 96) + F.sin(mu * 8) * (1097 * e1**4 / 512)
    s, c, t = F.sin(p1), F.cos(p1), F.pow(F.tan(p1), 2)
    c1, w = F.pow(c, 2) * ep2, 1 - F.pow(s, 2) * e2
    n1, r1 = F.lit(a) / F.sqrt(w), F.lit(a * (1 - e2)) / F.pow(w, 1.5)
    d = (x - grid["x0"]) / (n1 * grid["k0"])
    lat = p1 - n1 * F.tan(p1) / r1 * (
        F.pow(d, 2) / 2 - (t * 3 + 5 + c1 * 10 - F.pow(c1, 2) * 4 - 9 * ep2) * F.pow(d, 4) / 24 + (t * 90 + 61 + c1 * 298 + F.pow(t, 2) * 45 - 252 * ep2 - F.pow(c1, 2) * 3) * F.pow(d, 6) / 720
    )
    lng = (d - (t * 2 + 1 + c1) * F.pow(d, 3) / 6 + (F.lit(5.0) - c1 * 2 + t * 28 - F.pow(c1, 2) * 3 + 8 * ep2 + F.pow(t, 2) * 24) * F.pow(d, 5) / 120) / c
    return lat, lng + math.radians(grid["lng0"])


def sane_point(lat: Column, lng: Column) -> Column:
    """A coordinate inside the country's box; 0 and NULL are none."""
    return F.coalesce((lat != 0) & (lng != 0) & lat.between(33.0, 39.5) & lng.between(124.0, 132.0), F.lit(False))


def geometry_box(geojson: Column) -> Column:
    """STRUCT of centre and bounds over all positions of a geometry, however deep; NULL without any."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    position = rf"\[\s*{number}\s*,\s*{number}"
    text = F.get_json_object(geojson, "$.coordinates")
    axis = lambda k: F.transform(F.regexp_extract_all(text, F.lit(position), F.lit(k)), lambda c: c.cast("double"))
    x, y = axis(1), axis(2)
    lo, hi = F.array_min, F.array_max
    box = F.struct(
        ((lo(y) + hi(y)) / 2).alias("center_lat"), ((lo(x) + hi(x)) / 2).alias("center_lng"), lo(x).alias("min_lng"), lo(y).alias("min_lat"), hi(x).alias("max_lng"), hi(y).alias("max_lat")
    )
    return F.when(F.size(F.coalesce(x, F.array().cast("array<double>"))) > 0, box)
