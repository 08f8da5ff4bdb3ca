"""Points, polygons and neighbours, by grid cells and equi-joins.

Polygon layers: zone_id and rings (an array of rings: all parts and their holes), or ring where there
is only one.  A ring is an array of struct<x, y>, the last point joined to the first.  A point is inside
if its ray crosses an odd number of edges of all rings, so parts and holes need no telling apart.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from ..session import saved
from .population import ordered_ranks
from .zones import weighted_draw

LEAF = 16  # facilities that are compared one by one with the places that look at their leaf
TILE = 4  # tiles of a level in a tile of the next, in each direction
FEW = 10_000  # boxes that are sent to every task
HOT, LOT = 1000, 10_000  # keys with more than one in HOT of all rows, and LOT at least, are dealt out


def _crossed(x: Column, y: Column, ring: Column) -> Column:
    """How many edges of the ring lie to the right of the point."""
    edges = F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))
    return F.size(F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])))


def _inside(x: Column, y: Column, rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda n, ring: n + _crossed(x, y, ring)) % 2 == 1


def _rings(polygons: DataFrame) -> DataFrame:
    return polygons if "rings" in polygons.columns else polygons.withColumn("rings", F.array("ring"))


def _spans(rings: Column, axis: str) -> tuple[Column, Column]:
    values = F.transform(F.flatten(rings), lambda p: p[axis].cast("double"))
    return F.array_min(values), F.array_max(values)


def _covered(polygons: DataFrame, cell: float) -> DataFrame:
    """A row for each polygon and grid cell that the bounding box of one of its rings meets."""
    def cells(ring: Column) -> Column:
        span = lambda a: F.sequence(F.floor(_spans(F.array(ring), a)[0] / cell), F.floor(_spans(F.array(ring), a)[1] / cell))
        return F.flatten(F.transform(span("x"), lambda cx: F.transform(span("y"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))

    return polygons.withColumn("c", F.explode(F.array_distinct(F.flatten(F.transform("rings", cells))))).select("*", "c.cx", "c.cy").drop("c")


def point_in_zone(points: DataFrame, polygons: DataFrame, cell: float = 10_000.0) -> DataFrame:
    """The zone that holds each point (the smallest id where zones overlap); null outside.

    Points and polygons meet in grid cells; the exact test follows.
    """
    where = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    layer = _covered(_rings(polygons).select("zone_id", "rings"), cell)
    hit = where.join(layer, ["cx", "cy"]).filter(_inside(F.col("x"), F.col("y"), F.col("rings")))
    found = hit.groupBy("point_id").agg(F.min("zone_id").alias("zone_id"))
    return points.join(found, "point_id", "left")


def impute_quality_class(points: DataFrame, polygons: DataFrame, cell: float = 10_000.0) -> DataFrame:
    out = point_in_zone(points, polygons.withColumnRenamed("quality", "zone_id"), cell)
    return out.withColumn("ovgk", F.coalesce("zone_id", F.lit("None"))).drop("zone_id")


def centroids(polygons: DataFrame) -> DataFrame:
    """Centres of the polygons by the shoelace formula; holes run the other way round than parts."""
    def edges(ring: Column) -> Column:
        return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get(ring, (i + 1) % F.size(ring))["x"].alias("x1"), F.get(ring, (i + 1) % F.size(ring))["y"].alias("y1")))

    cross = lambda e: e["x0"] * e["y1"] - e["x1"] * e["y0"]
    total = lambda f: F.aggregate(F.transform("edges", f), F.lit(0.0), lambda a, b: a + b)
    area = total(cross) / 2
    out = _rings(polygons).withColumn("edges", F.flatten(F.transform("rings", edges)))
    return out.select("zone_id", (total(lambda e: (e["x0"] + e["x1"]) * cross(e)) / (area * 6)).alias("x"), (total(lambda e: (e["y0"] + e["y1"]) * cross(e)) / (area * 6)).alias("y"))


def nearest_centroid(points: DataFrame, centres: DataFrame) -> DataFrame:
    """The zone with the nearest centre (the smallest id of equals); null for a point without coordinates."""
    near = knn(points, centres.withColumnRenamed("zone_id", "facility_id"), 1).select("point_id", F.col("facility_id").alias("zone_id"))
    return points.join(near, "point_id", "left")


def border_points(zones: DataFrame, border: DataFrame) -> DataFrame:
    """The vertex of the border (polygons with rings) that is nearest to each zone's centre: zone_id, border_x, border_y."""
    vertices = _rings(border).select(F.explode(F.flatten("rings")).alias("p")).select(F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y")).distinct()
    vertices = vertices.withColumn("facility_id", F.struct("x", "y"))
    near = knn(zones.withColumnRenamed("zone_id", "point_id").select("point_id", "x", "y"), vertices, 1)
    return near.select(F.col("point_id").alias("zone_id"), F.col("facility_id.x").alias("border_x"), F.col("facility_id.y").alias("border_y"))


def _dealt(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` joined to ``table`` by ``keys``; keys with more than one in HOT of all rows (fewer than HOT keys) are
    dealt out by the columns ``by``, each part meeting a copy of the key's rows in the table."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("many"))
    total = rows.count()
    hot = saved(counts.filter(F.col("many") > max(total / HOT, LOT)).select(*keys, F.ceil(F.col("many") / max(total / HOT, LOT)).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows.join(table, keys)
    hot, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    rows = rows.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("parts")
    table = table.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return rows.join(table, [*keys, "part"]).drop("part")


def _packed(sides: DataFrame, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """Facilities with their leaf (sx, sy), and the boxes of the leaves and of ever larger tiles of leaves.

    Slabs of equal numbers by x are cut into leaves of equal numbers by y, so leaves follow the density,
    and a coordinate far from all others widens only the boxes that hold it.
    """
    slabs = max(1, round((n / LEAF) ** 0.5))
    size = -(-n // slabs)
    placed = ordered_ranks(sides, [], ["fx", "fy", "facility_id"], "rank").withColumn("sx", F.floor(F.col("rank") / size).cast("long"))
    inside = F.row_number().over(Window.partitionBy("sx").orderBy("fy", "fx", "facility_id")) - 1  # a slab has about sqrt(LEAF * n) facilities
    leaves = saved(placed.withColumn("sy", F.floor(inside / LEAF).cast("long")).select("sx", "sy", "facility_id", "fx", "fy"))
    lo, hi = (lambda c: [F.min(f"{c}{k}").alias(f"{k}0") for k in "xy"]), (lambda c: [F.max(f"{c}{k}").alias(f"{k}1") for k in "xy"])
    boxes = [saved(leaves.groupBy("sx", "sy").agg(*lo("f"), *hi("f"), F.count("*").alias("n")))]
    wide = max(slabs, -(-size // LEAF))
    while wide > 1:
        up = boxes[-1].groupBy(F.floor(F.col("sx") / TILE).alias("sx"), F.floor(F.col("sy") / TILE).alias("sy"))
        boxes.append(saved(up.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n"))))
        wide = -(-wide // TILE)
    return leaves, boxes


def knn(points: DataFrame, facilities: DataFrame, k: int) -> DataFrame:
    """The k nearest facilities of each point: point_id, facility_id, distance, rank.

    Facilities are packed into leaves of LEAF by their numbers, and these into tiles of tiles.  Places
    go down the tiles: of those that they still look at, the ones whose farthest corners are nearest and
    that hold k facilities give a bound, and tiles that begin beyond it are left out; so a place
    meets a few tiles on each level, and a few leaves at last, wherever it is.  Tiles that many places
    look at are dealt out.  Persons at one place are one place, and of facilities at one place the k
    smallest ids count.  Points and facilities without coordinates have no neighbours; without
    facilities the result is empty; equal distances go by id.
    """
    sides = facilities.select("facility_id", F.col("x").cast("double").alias("fx"), F.col("y").cast("double").alias("fy")).filter("fx is not null and fy is not null")
    for key in (F.pmod(F.xxhash64("facility_id"), F.lit(16)), F.lit(0)):  # the hot place, if there is one, in parts first
        first = Window.partitionBy("fx", "fy", "part").orderBy("facility_id")
        sides = sides.withColumn("part", key).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).drop("part", "r")
    sides = saved(sides)
    n = sides.count()
    located = points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    if not n:
        kind = facilities.schema["facility_id"].dataType.simpleString()
        return located.limit(0).selectExpr("point_id", f"cast(null as {kind}) facility_id", "cast(null as double) distance", "cast(null as int) rank")
    leaves, boxes = _packed(sides, n)
    square = lambda a: a * a
    beyond = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
    across = lambda c: F.greatest(F.abs(F.col(f"{c}0") - F.col(c)), F.abs(F.col(f"{c}1") - F.col(c)))
    place = Window.partitionBy("x", "y")
    look = located.select("x", "y").distinct().withColumn("sx", F.lit(0).cast("long")).withColumn("sy", F.lit(0).cast("long"))
    for tiles in reversed(boxes[:-1]):
        below = tiles.withColumnsRenamed({"sx": "cx", "sy": "cy"}).withColumn("sx", F.floor(F.col("cx") / TILE)).withColumn("sy", F.floor(F.col("cy") / TILE))
        look = saved(look)
        met = look.join(F.broadcast(below), ["sx", "sy"]) if below.count() <= FEW else _dealt(look, below, ["sx", "sy"], ["x", "y"])
        met = met.select("x", "y", F.col("cx").alias("sx"), F.col("cy").alias("sy"), "n", (square(beyond("x")) + square(beyond("y"))).alias("near"), (square(across("x")) + square(across("y"))).alias("far"))
        held = F.sum("n").over(place.orderBy("far", "sx", "sy").rowsBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(F.col("held") >= k, F.col("far"))).over(place)
        met = met.withColumn("held", held).withColumn("bound", bound)
        look = met.filter(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * (1 + 1e-12))).select("x", "y", "sx", "sy")
    met = _dealt(saved(look), leaves, ["sx", "sy"], ["x", "y"])
    ranked = met.select("x", "y", "facility_id", F.sqrt(square(F.col("x") - F.col("fx")) + square(F.col("y") - F.col("fy"))).alias("distance"))
    ranked = saved(ranked.withColumn("rank", F.row_number().over(place.orderBy("distance", "facility_id"))).filter(F.col("rank") <= k))
    return located.join(ranked, ["x", "y"]).select("point_id", "facility_id", "distance", "rank")


def density(points: DataFrame, population: DataFrame, radius: float, levels: int = 5) -> DataFrame:
    """How many of the population (x, y) are within the radius of each point; 0 for a point without coordinates.

    People are added up by place, and places by cells, from a 2**levels-th of the radius up to its half.
    A point looks at the cells around it from the largest down: of a cell whose places (their bounding
    box) are all within the circle it takes the number, one whose box the rim crosses it opens, and
    in the smallest of these it looks at places one by one.  So what it meets follows the rim and
    not the area.  Points at one place are one, and cells that many points look at are dealt out.
    """
    places = population.filter("x is not null and y is not null").groupBy(F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).agg(F.count("*").alias("n"))
    width = radius / 2**levels
    places = saved(places.withColumn("cx", F.floor(F.col("px") / width)).withColumn("cy", F.floor(F.col("py") / width)))
    cells = [saved(places.groupBy("cx", "cy").agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"), F.sum("n").alias("n")))]
    for _ in range(levels - 1):
        up = cells[-1].groupBy(F.floor(F.col("cx") / 2).alias("cx"), F.floor(F.col("cy") / 2).alias("cy"))
        cells.append(saved(up.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n"))))
    square = lambda a: a * a
    beyond = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
    across = lambda c: F.greatest(F.abs(F.col(f"{c}0") - F.col(c)), F.abs(F.col(f"{c}1") - F.col(c)))
    at = saved(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null").distinct())

    def opened(rows: DataFrame, x: Column, y: Column, steps: range) -> DataFrame:
        around = F.array(*(F.struct((x + a).alias("cx"), (y + b).alias("cy")) for a, b in product(steps, repeat=2)))
        return rows.select("x", "y", F.explode(around).alias("c")).select("x", "y", "c.cx", "c.cy")

    coarse = width * 2 ** (levels - 1)
    look, inside = opened(at, F.floor(F.col("x") / coarse), F.floor(F.col("y") / coarse), range(-3, 4)), []
    for level, table in enumerate(reversed(cells), 1):
        met = _dealt(look, table, ["cx", "cy"], ["x", "y"]).withColumn("far", square(across("x")) + square(across("y")))
        met = saved(met.filter(square(beyond("x")) + square(beyond("y")) <= radius * radius).select("x", "y", "cx", "cy", "n", (F.col("far") <= radius * radius).alias("whole")))
        inside.append(met.filter("whole").select("x", "y", "n"))
        rim = met.filter("not whole").select("x", "y", "cx", "cy")
        look = rim if level == levels else opened(rim, F.col("cx") * 2, F.col("cy") * 2, range(2))
    close = square(F.col("x") - F.col("px")) + square(F.col("y") - F.col("py")) <= radius * radius
    inside.append(_dealt(look, places, ["cx", "cy"], ["x", "y"]).filter(close).select("x", "y", "n"))
    counts = reduce(DataFrame.unionByName, inside).groupBy("x", "y").agg(F.sum("n").alias("density"))
    found = points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(counts, ["x", "y"]).select("point_id", "density")
    return points.join(found, "point_id", "left").withColumn("density", F.coalesce("density", F.lit(0)))


def cutout(df: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Rows with x, y inside one polygon; its bounding box first."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    boxed = df.filter(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys)))
    points = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring))
    return boxed.filter(_crossed(F.col("x"), F.col("y"), points) % 2 == 1)


def education_places(persons: DataFrame, facilities: DataFrame, k: int, seed: int) -> DataFrame:
    """One of the k nearest facilities, each with the same chance."""
    near = knn(persons, facilities, k)
    found = near.groupBy("point_id").agg(F.max("rank").alias("found"))
    pick = F.floor(uniform(seed, "education", F.col("point_id")) * F.col("found")) + 1
    return near.join(found, "point_id").filter(F.col("rank") == pick).select("point_id", "facility_id", "distance")


def _strips(edges: DataFrame, heights: DataFrame) -> DataFrame:
    """(zone_id, strip, y0, y1, x0, x1): each edge in each strip between neighbouring heights that it crosses."""
    order = Window.partitionBy("zone_id").orderBy("y")
    levels = heights.distinct().select("zone_id", "y", F.row_number().over(order).alias("level"), F.lead("y").over(order).alias("above"))
    at = lambda end: levels.select("zone_id", F.col("y").alias(f"y{end}"), F.col("level").alias(f"level_{end}"))
    crossed = edges.join(at("a"), ["zone_id", "ya"]).join(at("b"), ["zone_id", "yb"]).withColumn("strip", F.explode(F.sequence(F.col("level_a"), F.col("level_b") - 1)))
    crossed = crossed.join(levels.select("zone_id", F.col("level").alias("strip"), F.col("y").alias("y0"), F.col("above").alias("y1")), ["zone_id", "strip"])
    x = lambda y: F.when(y == F.col("yb"), F.col("xb")).otherwise(F.col("xa") + (y - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya")))
    return crossed.select("zone_id", "strip", "y0", "y1", x(F.col("y0")).alias("x0"), x(F.col("y1")).alias("x1"))


def trapezoids(polygons: DataFrame) -> DataFrame:
    """The zones' inner parts between horizontal lines: zone_id, strip, y0, y1, left0, left1, right0, right1 (x at y0 and at y1), area.

    The lines go through all points of the rings, and through the points where edges cross, so that
    between two of them edges only meet at the lines; the first and second edge from the left bound an inner part, then
    the third and fourth, as in the even-odd rule.  A zone's parts number its edges times the strips that
    these cross.
    """
    edge = lambda ring: F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))
    rows = _rings(polygons).select("zone_id", F.explode(F.flatten(F.transform("rings", edge))).alias("e"))
    rows = rows.select("zone_id", *(F.col(f"e.{end}.{axis}").cast("double").alias(f"{axis}{end}") for end in "ab" for axis in "xy")).filter("ya != yb")
    up = F.col("ya") < F.col("yb")
    edges = saved(rows.select("zone_id", *(F.when(up, F.col(f"{axis}{end}")).otherwise(F.col(f"{axis}{other}")).alias(f"{axis}{end}") for end, other in ("ab", "ba") for axis in "xy")))
    heights = edges.select("zone_id", F.explode(F.array("ya", "yb")).alias("y"))
    strips = saved(_strips(edges, heights))
    # Edges in the order of their lower ends whose upper ends are in another order cross within the strip.
    before = Window.partitionBy("zone_id", "strip").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    tangled = strips.withColumn("most", F.max("x1").over(before)).filter("most > x1").select("zone_id", "strip").distinct()
    knots = strips.join(tangled, ["zone_id", "strip"], "left_semi")
    if not knots.isEmpty():
        l, r = knots.select("zone_id", "strip", "y0", "y1", F.col("x0").alias("l0"), F.col("x1").alias("l1")), knots.select("zone_id", "strip", F.col("x0").alias("r0"), F.col("x1").alias("r1"))  # noqa: E741
        crossings = l.join(r, ["zone_id", "strip"]).filter("l0 < r0 and l1 > r1")
        part = (F.col("r0") - F.col("l0")) / (F.col("r0") - F.col("l0") + F.col("l1") - F.col("r1"))
        strips = _strips(edges, heights.unionByName(crossings.select("zone_id", (F.col("y0") + part * (F.col("y1") - F.col("y0"))).alias("y"))))
    order = Window.partitionBy("zone_id", "strip").orderBy(F.col("x0") + F.col("x1"), "x0")
    paired = strips.select("zone_id", "strip", "y0", "y1", F.col("x0").alias("left0"), F.col("x1").alias("left1"), F.lead("x0").over(order).alias("right0"), F.lead("x1").over(order).alias("right1"), (F.row_number().over(order) % 2).alias("odd"))
    wide = F.greatest(F.col("right0") - F.col("left0"), F.lit(0.0)) + F.greatest(F.col("right1") - F.col("left1"), F.lit(0.0))
    return paired.filter("odd = 1").drop("odd").withColumn("area", wide * (F.col("y1") - F.col("y0")) / 2).filter("area > 0")


def sample_points(polygons: DataFrame, counts: DataFrame, seed: int, unit_lot: int = 10_000) -> DataFrame:
    """``n`` points in each zone, equally likely everywhere: zone_id, unit (from 0), x, y.

    A first uniform of the unit falls into the zone's trapezoids by their areas, and what is left of it
    says how high in this one; a second one says how far from the left.  So every unit takes one draw,
    whatever the zone's shape, and the result does not depend on the partitions.  A zone's units are
    dealt out in lots, and meet its trapezoids in parts of the uniform.  Zones of which points are asked
    have to be in the layer and to have an area, else they are refused; a null or no count asks none.
    """
    asked = saved(counts.filter("n > 0").groupBy("zone_id").agg(F.sum("n").cast("long").alias("n")))
    unknown = asked.join(polygons.select("zone_id").distinct(), "zone_id", "left_anti").first()
    if unknown:
        raise ValueError(f"zone {unknown.zone_id} is not in the layer")
    pieces = saved(trapezoids(polygons.join(asked.select("zone_id"), "zone_id", "left_semi")))
    order = Window.partitionBy("zone_id").orderBy("strip", "left0", "left1", "right0")
    upto = F.sum("area").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("area").over(Window.partitionBy("zone_id"))
    pieces = pieces.withColumn("cdf", F.when(F.lead("strip").over(order).isNull(), F.lit(1.0)).otherwise(upto))
    pieces = pieces.withColumn("cdf_before", F.coalesce(F.lag("cdf").over(order), F.lit(0.0))).filter("cdf > cdf_before")
    known = pieces.groupBy("zone_id").agg(F.least(F.greatest(F.count("*"), F.lit(64)), F.lit(1 << 20)).alias("bins"))
    flat = asked.join(known, "zone_id", "left_anti").first()
    if flat:
        raise ValueError(f"zone {flat.zone_id} has no area")
    lots = asked.join(known, "zone_id").select("zone_id", "bins", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / unit_lot))).alias("lot"))
    first = F.col("lot") * unit_lot
    units = lots.repartition("zone_id", "lot").select("zone_id", "bins", F.explode(F.sequence(first, F.least(first + unit_lot, F.col("n")) - 1)).alias("unit"))
    draw = lambda salt: uniform(seed, salt, F.col("zone_id"), F.col("unit"), F.lit(0))
    met = weighted_draw(units.withColumn("u", draw("point-y")), F.col("u"), pieces.join(known, "zone_id"), ["zone_id", "bins"], F.col("bins"))
    met = met.withColumn("part", (F.col("u") - F.col("cdf_before")) / (F.col("cdf") - F.col("cdf_before")))
    low, high = (F.greatest(F.col(f"right{k}") - F.col(f"left{k}"), F.lit(0.0)) for k in (0, 1))
    # The share of the area below height t is (low * t + (high - low) * t * t / 2) / ((low + high) / 2).
    t = F.when(low == high, F.col("part")).otherwise((F.sqrt(low * low + F.col("part") * (high * high - low * low)) - low) / (high - low))
    met = met.withColumn("t", F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))
    left = F.col("left0") + F.col("t") * (F.col("left1") - F.col("left0"))
    x = left + draw("point-x") * (low + F.col("t") * (high - low))
    return met.select("zone_id", "unit", x.alias("x"), (F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))).alias("y"))
