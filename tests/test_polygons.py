"""Points in polygons by adaptive cells, against the plain even-odd rule over all edges."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tallyloom.functions import geo


def star(r: random.Random, x: float, y: float, radius: float, corners: int, least: float = 0.3) -> list[list[float]]:
    ring = []
    for k in range(corners):
        a, d = 2 * math.pi * k / corners, radius * r.uniform(least, 1)
        ring.append([x + d * math.cos(a), y + d * math.sin(a)])
    return [*ring, ring[0]]


def plain(lng, lat, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > lat) != (by > lat) and lng < (bx - ax) * (lat - ay) / (by - ay) + ax:
                n += 1
    return n % 2 == 1


def test_against_the_plain_rule(spark):
    r = random.Random(8)
    polygons = []
    for k in range(25):
        x, y, radius = r.uniform(126, 129), r.uniform(34, 38), r.choice([0.001, 0.05, 0.5, 2])
        rings = [star(r, x, y, radius, r.choice([3, 7, 40, 600])), star(r, x, y, radius * 0.2, 9)]
        polygons.append((f"p{k}", k % 11, rings if k % 3 else rings[:1]))
    polygons.append(("square", 50, [[[126.5625, 36.0], [127.96875, 36.0], [127.96875, 37.40625], [126.5625, 37.40625], [126.5625, 36.0]]]))  # on cell bounds
    polygons.append(("empty", 51, []))
    polygons.append(("line", 52, [[[127.0, 36.0], [128.0, 36.0]]]))
    points = [(k, r.uniform(125.5, 129.5), r.uniform(33.5, 38.5)) for k in range(1500)]
    points += [(2000 + k, p[0] + r.uniform(-1e-4, 1e-4), p[1]) for k, (_, _, rings) in enumerate(polygons) for p in (rings or [[[127.0, 36.0]]])[0][:40:7]]
    points += [(3000, 126.5625, 36.0), (3001, 127.96875, 36.5), (3002, 127.265625, 36.703125)]
    order = {c: o for c, o, _ in polygons}
    want = {}
    for i, lng, lat in points:
        inside = [c for c, _, rings in polygons if plain(lng, lat, rings)]
        if inside:
            want[i] = min(order[c] for c in inside)
    p = spark.createDataFrame(points, "id int, lng double, lat double").dropDuplicates(["id"])
    known = {x.id for x in p.collect()}
    df = spark.createDataFrame(polygons, "code string, order int, rings array<array<array<double>>>")
    first = {i: (lng, lat) for i, lng, lat in points}
    for most in (1, 16, 10_000):
        got = {x.id: order[x.code] for x in geo.points_in_polygons(p.where("id < 2000 OR id >= 3000"), df, most).collect()}
        assert got == {i: o for i, o in want.items() if i < 2000 or i >= 3000}
    assert known == set(first)


def test_cells_carry_few_edges(spark):
    r = random.Random(1)
    rings = [star(r, 127.5, 36.5, 1.0, 4000, 0.995)]  # a wrinkled circle
    df = spark.createDataFrame([("big", 0, rings)], "code string, order int, rings array<array<array<double>>>")
    cells = geo.cells_of_polygons(df, 16).withColumn("n", F.size("edges")).persist()
    inner = cells.where("n = 0").count()
    assert inner > 20 and cells.where("n > 0").count() > 100
    assert cells.agg(F.max("n")).first()[0] < 500 and cells.agg(F.sum("n")).first()[0] < 12 * 4000  # not one ring per cell
    assert not geo.points_in_polygons(spark.createDataFrame([], "id int, lng double, lat double"), df).collect()
    cells.unpersist()
