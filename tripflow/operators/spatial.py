"""Zone outlines, point-in-zone joins, measures and dissolving."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from tripflow.sources.sinks import land


#: Outlines that a task takes apart at most.
ZONES_PER_TASK = 20_000


def spread(zones: DataFrame) -> DataFrame:
    """The rows dealt over tasks by their number, if they are many.

    Outlines are few bytes in a file and many cells or edges once taken apart; a file read by one or two tasks
    would leave all of that work, and its memory, to them.
    """
    tasks = math.ceil(zones.count() / ZONES_PER_TASK)
    return zones.repartition(max(tasks, zones.sparkSession.sparkContext.defaultParallelism)) if tasks > 1 else zones


# ---- parsing ----------------------------------------------------------------

def _points(ring: Column) -> Column:
    def point(text: Column) -> Column:
        xy = F.split(F.trim(text), "\\s+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    return F.transform(F.split(ring, ","), point)


def rings_from_wkt(wkt: Column) -> Column:
    """POLYGON or MULTIPOLYGON text -> array of polygons, each an array of rings of points."""
    ring = "\\([^()]*\\)"
    body = F.regexp_replace(wkt, "(?i)^\\s*(MULTI)?POLYGON\\s*", "")
    polygons = F.regexp_extract_all(body, F.lit(f"\\(\\s*({ring}(?:\\s*,\\s*{ring})*)\\s*\\)"), F.lit(1))
    return F.transform(
        polygons,
        lambda p: F.transform(F.regexp_extract_all(p, F.lit("\\(([^()]*)\\)"), F.lit(1)), _points),
    )


def rings_from_geojson(geometry: Column) -> Column:
    """GeoJSON Polygon or MultiPolygon text -> the same arrays."""
    kind = F.get_json_object(geometry, "$.type")
    coordinates = F.get_json_object(geometry, "$.coordinates")
    nested = F.when(kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))).otherwise(coordinates)
    parsed = F.from_json(nested, "array<array<array<array<double>>>>")
    return F.transform(
        parsed,
        lambda polygon: F.transform(
            polygon,
            lambda ring: F.transform(
                ring, lambda xy: F.struct(xy[0].alias("x"), xy[1].alias("y"))
            ),
        ),
    )


def _ring_edges(points: Column) -> Column:
    return F.zip_with(
        F.slice(points, F.lit(1), F.size(points) - 1),
        F.slice(points, F.lit(2), F.size(points) - 1),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def zone_rings(zones: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row per ring: polygon number, ring number (0 is the shell) and points."""
    others = [c for c in zones.columns if c != geometry]
    polygons = spread(zones).select(*others, F.posexplode(rings_from_wkt(F.col(geometry))).alias("polygon", "_rings"))
    return polygons.select(*others, "polygon", F.posexplode("_rings").alias("ring", "points"))


def zone_edges(zones: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row per outline edge."""
    rings = zone_rings(zones, geometry)
    others = [c for c in rings.columns if c != "points"]
    return rings.select(*others, F.posexplode(_ring_edges(F.col("points"))).alias("edge", "_e")).select(
        *others, "edge", "_e.*"
    )


# ---- point in zone ----------------------------------------------------------

def _crossed(edge: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point towards larger x crosses a non-horizontal edge."""
    at = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) / (edge["y2"] - edge["y1"]) + edge["x1"]
    return ((edge["y1"] > y) != (edge["y2"] > y)) & (x < at)


#: Zones are sorted into classes by extent, each a quarter of the one before; the last holds all smaller ones.
CLASSES = 6
#: Cells along the largest zone of a class.
CELLS_ACROSS = 8


def grid_cells(zones: DataFrame, geometry: str = "geometry", largest: float | None = None) -> DataFrame:
    """Zones cut into square cells of their class, at most (``CELLS_ACROSS`` + 1) squared for each zone.

    Columns of the zones, level (class), size, cell_x, cell_y, whole and edges. A cell that no edge touches lies wholly inside
    (``whole``) or is left out; a border cell carries the edges that can decide a point in it: a ray to the
    right is only crossed by edges that share the cell's rows and do not lie wholly to its left.
    ``largest`` is the greatest extent of a zone, by default that of these zones.
    """
    edges = F.flatten(F.flatten(F.transform(rings_from_wkt(F.col(geometry)), lambda p: F.transform(p, _ring_edges))))

    def bound(pick, axis: str) -> Column:
        values = F.transform(F.col("_edges"), lambda e: pick(e[f"{axis}1"], e[f"{axis}2"]))
        return F.array_min(values) if pick is F.least else F.array_max(values)

    boxed = spread(zones).withColumn("_edges", edges).where(F.size("_edges") > 0)
    boxed = boxed.withColumns({f"_{axis}{i}": bound(pick, axis) for axis in "xy" for i, pick in enumerate((F.least, F.greatest))})
    boxed = boxed.withColumn("_extent", F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))).where(F.col("_extent") > 0)
    top = F.lit(largest) if largest else boxed.agg(F.max("_extent")).scalar()
    level = F.least(F.floor(F.log2(top / F.col("_extent")) / 2), F.lit(CLASSES - 1))
    sized = boxed.withColumn("level", F.greatest(level, F.lit(0)).cast("int"))
    sized = sized.withColumn("size", top / F.pow(F.lit(4.0), "level") / CELLS_ACROSS)

    def cells(axis: str) -> Column:
        return F.explode(F.sequence(*[F.floor(F.col(f"_{axis}{i}") / F.col("size")) for i in (0, 1)]))

    gridded = sized.withColumn("cell_x", cells("x")).withColumn("cell_y", cells("y"))
    left, bottom = F.col("cell_x") * F.col("size"), F.col("cell_y") * F.col("size")
    # Half a thousandth of a cell more on each side, so that rounding moves no point out of a border cell.
    slack = F.col("size") / 2000

    def touches(e: Column) -> Column:
        return (
            (F.greatest(e["y1"], e["y2"]) >= bottom - slack)
            & (F.least(e["y1"], e["y2"]) <= bottom + F.col("size") + slack)
            & (F.greatest(e["x1"], e["x2"]) >= left - slack)
        )

    beside = F.filter("_edges", touches)
    crossed = F.exists(beside, lambda e: F.least(e["x1"], e["x2"]) <= left + F.col("size") + slack)
    middle = F.size(F.filter(beside, lambda e: _crossed(e, left + F.col("size") / 2, bottom + F.col("size") / 2))) % 2 == 1
    steep = F.filter(beside, lambda e: e["y1"] != e["y2"])
    others = [c for c in zones.columns if c != geometry]
    marked = gridded.withColumns({"_border": crossed, "_middle": middle}).where(F.col("_border") | F.col("_middle"))
    return marked.select(
        *others, "level", "size", "cell_x", "cell_y", (~F.col("_border")).alias("whole"), F.when(F.col("_border"), steep).otherwise(F.array()).alias("edges")
    )


def within(
    points: DataFrame,
    zones: DataFrame,
    x: str,
    y: str,
    how: str = "inner",
    geometry: str = "geometry",
) -> DataFrame:
    """Points with the columns of the zone they lie in.

    Left and lower borders belong to a zone, right and upper ones do not, so
    neighbours share no point; holes and multi-part zones follow from the parity of
    crossed edges. ``how="left"`` keeps points outside all zones.

    Points meet the cells of each class of zones in one equality join. The cells are written first: their
    file size, not a guess, decides whether they are broadcast, and the points keep their place then. Many zones in
    a cell travel as one row, so a point is never multiplied before it is tested.
    """
    others = [c for c in zones.columns if c != geometry]
    cells = land(grid_cells(zones, geometry), "zone-cells")
    sizes = {row["level"]: row["size"] for row in cells.groupBy("level").agg(F.first("size").alias("size")).collect()}
    zone_type = ArrayType(StructType([cells.schema[c] for c in others]))
    found = points.withColumn("_zones", F.array().cast(zone_type))
    px, py = F.col(x), F.col(y)
    for level, size in sorted(sizes.items()):
        one = F.struct("whole", "edges", F.struct(*others).alias("zone"))
        keyed = cells.where(F.col("level") == level).groupBy(F.col("cell_x").alias("_cx"), F.col("cell_y").alias("_cy"))
        keyed = land(keyed.agg(F.collect_list(one).alias("_cell")), "cells-by-place")
        place = (F.floor(px / size) == F.col("_cx")) & (F.floor(py / size) == F.col("_cy"))
        inside = F.filter(
            F.coalesce("_cell", F.array()),
            lambda c: c["whole"] | (F.size(F.filter(c["edges"], lambda e: _crossed(e, px, py))) % 2 == 1),
        )
        found = found.join(keyed, place, "left").withColumn("_zones", F.concat("_zones", F.transform(inside, lambda c: c["zone"])))
        found = found.drop("_cx", "_cy", "_cell")
    pick = F.inline if how == "inner" else F.inline_outer
    return found.select(*points.columns, pick("_zones").alias(*others))


def events_by_zone(points: DataFrame, zones: DataFrame, x: str, y: str) -> DataFrame:
    """Number of points per zone; zones without points show 0."""
    counts = (
        within(points, zones, x, y).groupBy("id").agg(F.count(F.lit(1)).alias("events"))
    )
    return zones.drop("geometry").join(counts, "id", "left").na.fill(0, subset=["events"])


# ---- measures ---------------------------------------------------------------

def _signed_area(points: Column) -> Column:
    doubled = F.transform(_ring_edges(points), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.aggregate(doubled, F.lit(0.0), lambda a, v: a + v) / 2


def _moment(points: Column, axis: str) -> Column:
    parts = F.transform(
        _ring_edges(points),
        lambda e: (e[f"{axis}1"] + e[f"{axis}2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]),
    )
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / 6


def ring_length(points: Column) -> Column:
    parts = F.transform(_ring_edges(points), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def geometry_stats(zones: DataFrame, geometry: str = "geometry", project=None) -> DataFrame:
    """Outline length, area and centroid of each zone in the plane.

    Holes count against the area whatever their direction. ``project`` maps a point
    (two columns) to plane coordinates before measuring.
    """
    others = [c for c in zones.columns if c != geometry]
    rings = zone_rings(zones, geometry)
    if project:
        rings = rings.withColumn("points", F.transform("points", lambda p: project(p["x"], p["y"])))
    measured = rings.withColumns(
        {
            "_area": _signed_area(F.col("points")),
            "_mx": _moment(F.col("points"), "x"),
            "_my": _moment(F.col("points"), "y"),
            "_len": ring_length(F.col("points")),
        }
    ).withColumn("_sign", F.signum("_area") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0))
    area = F.sum(F.col("_area") * F.col("_sign"))
    return measured.groupBy(*others).agg(
        F.sum("_len").alias("length"),
        area.alias("area"),
        (F.sum(F.col("_mx") * F.col("_sign")) / area).alias("centroid_x"),
        (F.sum(F.col("_my") * F.col("_sign")) / area).alias("centroid_y"),
    )


# ---- fixed values: New York Long Island state plane, US survey feet, GRS 80 ----
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257222101
PARALLELS = (41 + 2 / 60, 40 + 40 / 60)
ORIGIN = (-74.0, 40 + 10 / 60)
FALSE_EASTING_M = 300000.0
METRES_PER_FOOT = 1200 / 3937
# ---- end of fixed values ----------------------------------------------------

_E = math.sqrt(2 * FLATTENING - FLATTENING**2)


def _t(phi: float) -> float:
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _cone():
    def m(phi):
        return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)

    p1, p2, p0 = (math.radians(d) for d in (*PARALLELS, ORIGIN[1]))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(_t(p1)) - math.log(_t(p2)))
    f = m(p1) / (n * _t(p1) ** n)
    return n, f, SEMI_MAJOR_M * f * _t(p0) ** n


CONE_N, CONE_F, RHO_0 = _cone()


def to_state_plane(lon: Column, lat: Column) -> Column:
    """Longitude and latitude in degrees -> plane coordinates in feet."""
    phi = F.radians(lat)
    s = F.sin(phi) * _E
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    rho = F.pow(t, F.lit(CONE_N)) * (SEMI_MAJOR_M * CONE_F)
    theta = (F.radians(lon) - math.radians(ORIGIN[0])) * CONE_N
    return F.struct(
        ((rho * F.sin(theta) + FALSE_EASTING_M) / METRES_PER_FOOT).alias("x"),
        ((F.lit(RHO_0) - rho * F.cos(theta)) / METRES_PER_FOOT).alias("y"),
    )


def from_state_plane(x: Column, y: Column) -> Column:
    """Plane coordinates in feet -> longitude and latitude (series in the eccentricity)."""
    east = x * METRES_PER_FOOT - FALSE_EASTING_M
    north = F.lit(RHO_0) - y * METRES_PER_FOOT
    rho = F.hypot(east, north)
    chi = F.lit(math.pi / 2) - 2 * F.atan(F.pow(rho / (SEMI_MAJOR_M * CONE_F), F.lit(1 / CONE_N)))
    e2, e4, e6, e8 = _E**2, _E**4, _E**6, _E**8
    phi = (
        chi
        + F.sin(2 * chi) * (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360)
        + F.sin(4 * chi) * (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520)
        + F.sin(6 * chi) * (7 * e6 / 120 + 81 * e8 / 1120)
        + F.sin(8 * chi) * (4279 * e8 / 161280)
    )
    lam = F.atan2(east, north) / CONE_N + math.radians(ORIGIN[0])
    return F.struct(F.degrees(lam).alias("lon"), F.degrees(phi).alias("lat"))


FEET_PER_MILE = 5280.0


def zone_sizes(zones: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Length in miles, area in square miles and centroid in degrees of geographic zones."""
    stats = geometry_stats(zones, geometry, to_state_plane)
    centre = from_state_plane(F.col("centroid_x"), F.col("centroid_y"))
    return (
        stats.withColumn("_centre", centre)
        .withColumns(
            {
                "length_miles": F.col("length") / FEET_PER_MILE,
                "area_miles2": F.col("area") / FEET_PER_MILE**2,
                "lat": F.col("_centre.lat"),
                "lon": F.col("_centre.lon"),
            }
        )
        .drop("length", "area", "centroid_x", "centroid_y", "_centre")
    )


# ---- dissolving and output --------------------------------------------------

def undirected(edges: DataFrame) -> DataFrame:
    """Edges that run from the smaller to the larger end point."""
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    ends = {
        name: F.when(forward, F.col(name)).otherwise(F.col(other))
        for name, other in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))
    }
    others = [c for c in edges.columns if c not in ends]
    return edges.select(*others, *[c.alias(name) for name, c in ends.items()])


def dissolve(edges: DataFrame, by: str) -> DataFrame:
    """Outer edges of the zones of each group.

    An edge shared by two zones of a group cancels out, whichever way the two run
    along it. Exact where neighbours use the same corner points.
    """
    return (
        undirected(edges.select(by, "x1", "y1", "x2", "y2"))
        .groupBy(by, "x1", "y1", "x2", "y2")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") % 2 == 1)
        .drop("_n")
    )


def _outer_edges(zones: DataFrame, by: str, geometry: str) -> DataFrame:
    """Directed outline edges of each group with its inside on the left; shared edges run both ways and cancel out."""
    rings = zone_rings(zones.select(by, geometry), geometry)
    against = (_signed_area(F.col("points")) < 0) == (F.col("ring") == 0)
    turned = rings.withColumn("points", F.when(against, F.reverse("points")).otherwise(F.col("points")))
    edges = turned.select(by, F.inline(_ring_edges(F.col("points")))).where("x1 <> x2 OR y1 <> y2")
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    keys = [by, "x1", "y1", "x2", "y2"]
    kept = undirected(edges.withColumn("_way", F.when(forward, 1).otherwise(-1))).groupBy(*keys).agg(F.sum("_way").alias("_way"))
    ends = {name: F.when(F.col("_way") > 0, F.col(name)).otherwise(F.col(other)) for name, other in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    return kept.where(F.col("_way") != 0).select(by, *[c.alias(name) for name, c in ends.items()])


def _successors(edges: DataFrame, by: str) -> DataFrame:
    """The edge that follows each: of several at a corner the leftmost turn, so that touching rings stay apart."""
    names = {by: "_by", "edge": "next", "x1": "_x2", "y1": "_y2", "x2": "_x3", "y2": "_y3"}
    after = edges.select(*[F.col(c).alias(name) for c, name in names.items()])
    ux, uy, vx, vy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("_x3") - F.col("x2"), F.col("_y3") - F.col("y2")
    cross, dot = ux * vy - uy * vx, ux * vx + uy * vy
    turn = F.when((cross == 0) & (dot < 0), -math.pi).otherwise(F.atan2(cross, dot))
    meet = F.col(by).eqNullSafe(F.col("_by")) & (F.col("x2") == F.col("_x2")) & (F.col("y2") == F.col("_y2"))
    met = edges.join(after, meet)
    return met.groupBy("edge").agg(F.max_by("next", turn).alias("next"))


def dissolve_rings(zones: DataFrame, by: str, geometry: str = "geometry") -> DataFrame:
    """Closed rings around the zones of each group, holes with the shell they lie in.

    Columns: ``by``, polygon and ring (numbers from 0; ring 0 is the shell), points (first = last, shells
    counterclockwise, holes clockwise, from the lowest corner on) and the signed area. Exact where neighbours use
    the same corner points and zones do not overlap.

    Rings are put together from loose edges by pointer doubling: after ``k`` rounds every edge knows the lowest of
    the next ``2 ** k`` edges and how far ahead it is, so rounds grow with the logarithm of the longest ring. Each
    round is one join on the edge number; only a finished ring is gathered in a row.
    """
    written: list[str] = []
    edges = land(_outer_edges(zones, by, geometry).withColumn("edge", F.monotonically_increasing_id()), "outer-edges")
    follow = land(_successors(edges, by), "successors")
    if edges.count() != follow.select("next").distinct().count():
        raise ValueError(f"outlines of a {by} overlap or are not closed")
    corner = F.struct("x1", "y1", "x2", "y2")
    state = edges.join(follow, "edge").select("edge", "next", F.struct(corner.alias("low"), F.lit(0).cast("long").alias("ahead")).alias("head"))
    state, reach = land(state, "rings", written), 1
    while True:
        there = state.select(F.col("edge").alias("next"), F.col("next").alias("_next"), F.col("head").alias("_head"))
        further = F.struct(F.col("_head.low").alias("low"), (F.col("_head.ahead") + reach).alias("ahead"))
        state = state.join(there, "next").select(
            "edge", F.col("_next").alias("next"), F.least("head", further).alias("head"), (F.col("head.low") != F.least("head", further)["low"]).alias("moved")
        )
        state, reach = land(state, "rings", written), 2 * reach
        if state.where("moved").isEmpty():
            break
    placed = edges.join(state.select("edge", F.col("head.low").alias("low"), F.col("head.ahead").alias("ahead")), "edge")
    # The head has 0 edges to itself; the others follow it in descending distance.
    place = F.when(F.col("ahead") == 0, F.lit(-(1 << 62))).otherwise(-F.col("ahead"))
    corners = F.array_sort(F.collect_list(F.struct(place.alias("at"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("p"))))
    rings = placed.groupBy(by, "low").agg(F.transform(corners, lambda c: c["p"]).alias("_open"))
    rings = rings.withColumn("points", F.concat("_open", F.slice("_open", 1, 1))).drop("_open")
    rings = land(rings.withColumn("area", _signed_area(F.col("points"))), "closed-rings")
    return _numbered_rings(rings, by)


def _numbered_rings(rings: DataFrame, by: str) -> DataFrame:
    """Holes find the smallest shell around the middle of their first edge, by the point-in-zone join."""
    text = F.concat_ws(", ", F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))))
    shells = rings.where("area > 0").select(F.col(by).alias("_by"), F.col("low").alias("shell"), F.col("area").alias("_size"), F.concat(F.lit("POLYGON (("), text, F.lit("))")).alias("geometry"))
    first, second = F.col("points")[0], F.col("points")[1]
    holes = rings.where("area < 0").withColumns({"_mx": (first["x"] + second["x"]) / 2, "_my": (first["y"] + second["y"]) / 2})
    around = within(holes, shells, "_mx", "_my").where(F.col("_by").eqNullSafe(F.col(by)))
    held = around.groupBy(by, "low").agg(F.min_by("shell", "_size").alias("shell"), F.any_value("points").alias("points"), F.any_value("area").alias("area"))
    both = rings.where("area > 0").select(by, F.col("low").alias("shell"), "low", "points", "area").unionByName(held.select(by, "shell", "low", "points", "area"))
    polygon = F.dense_rank().over(Window.partitionBy(by).orderBy("shell")) - 1
    ring = F.row_number().over(Window.partitionBy(by, "shell").orderBy(F.col("area") < 0, "low")) - 1
    return both.select(by, polygon.alias("polygon"), ring.alias("ring"), "points", "area")


def geojson_features(zones: DataFrame, properties: list[str], geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature per zone as a text column."""
    coordinates = F.transform(
        rings_from_wkt(F.col(geometry)),
        lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )
    return zones.select(F.to_json(feature).alias("value"))
