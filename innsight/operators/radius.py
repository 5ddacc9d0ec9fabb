"""Hotels within a radius of one point, or of every point of a table."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions.constants import EARTH_RADIUS_KM, SEARCH_LIMIT
from innsight.functions.geo import box_around, distance_km
from innsight.operators.latest import first_rows
from innsight.operators.lookup import lookup, row_bytes
from innsight.sources.scratch import stage_table

CELLS_PER_RADIUS = 3
MARGIN = 1e-7  # of the earth radius; far above the rounding error of the distance
SPLIT = 64  # places in a cell beyond which it is split into eight
DEEPEST = 20  # splits of a cell; places that are still together are apart by metres
GRID = ["cx", "cy", "cz"]
GROUPS_PER_RADIUS = 6  # cells that gather points
GROUP = ["gx", "gy", "gz"]
SHORTLIST = 32  # times the limit; the points of a group with more hotels are searched singly
#: Points and groups a task holds. What they meet is made where they are.
POINTS_PER_TASK = 16384
GROUPS_PER_TASK = 256


def within_radius(hotels: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    """Hotels at most ``radius_km`` from the point, with ``distance_km``."""
    return (
        hotels.where(box_around(lat, lon, radius_km, "lat", "lon"))
        .withColumn("distance_km", distance_km(lat, lon, "lat", "lon"))
        .where(F.col("distance_km") <= radius_km)
    )


def best_first() -> list[Column]:
    return [F.col("star_rating").desc(), F.col("hotel_id")]


def top_within_radius(
    hotels: DataFrame, lat: float, lon: float, radius_km: float, limit: int = SEARCH_LIMIT
) -> DataFrame:
    """The best ``limit`` of them by stars; ties go to the lower id."""
    found = within_radius(hotels, lat, lon, radius_km)
    return found.orderBy(*best_first()).limit(limit)


def _unit_vector(lat: str, lon: str) -> dict[str, Column]:
    lat_r, lon_r = F.radians(F.col(lat)), F.radians(F.col(lon))
    return {
        "x": F.cos(lat_r) * F.cos(lon_r),
        "y": F.cos(lat_r) * F.sin(lon_r),
        "z": F.sin(lat_r),
    }


def _cells(edge: float) -> dict[str, Column]:
    """The cell of a place by its unit vector."""
    return {f"c{axis}": F.floor(F.col(axis) / F.lit(edge)).cast("long") for axis in ("x", "y", "z")}


def _touched(
    points: DataFrame, spans: dict[str, tuple[Column, Column]], chord: float, slack: float, edge: float
) -> DataFrame:
    """Every point with those grid cells of the given spans that its ball touches and
    that hold a part of the sphere; ``whole`` marks cells inside the ball completely.
    With a ``slack`` both hold for some, or for all, points at most so far away."""
    reach = chord + slack + MARGIN
    zero = {"near": F.lit(0.0), "far": F.lit(0.0), "inner": F.lit(0.0), "outer": F.lit(0.0)}
    cells = points.withColumns(zero)
    for axis in ("x", "y", "z"):
        place, cell = F.col(axis), F.col(f"c{axis}")
        low, high = cell * F.lit(edge), (cell + F.lit(1)) * F.lit(edge)
        gap = F.greatest(low - place, place - high, F.lit(0.0))
        span = F.greatest(F.abs(place - low), F.abs(high - place))
        # nearest and farthest distance of the cell from the sphere's centre
        to_zero = F.greatest(low, -high, F.lit(0.0))
        from_zero = F.greatest(F.abs(low), F.abs(high))
        cells = (
            cells.withColumn(f"c{axis}", F.explode(F.sequence(*spans[axis])))
            .withColumns(
                {
                    "near": F.col("near") + gap * gap,
                    "far": F.col("far") + span * span,
                    "inner": F.col("inner") + to_zero * to_zero,
                    "outer": F.col("outer") + from_zero * from_zero,
                }
            )
            .where(F.col("near") <= F.lit(reach * reach))
            .where(F.col("inner") <= F.lit(1.0 + 2 * MARGIN))
        )
    inside = max(chord - slack - MARGIN, 0.0)
    return (
        cells.where(F.col("outer") >= F.lit(1.0 - 2 * MARGIN))
        .withColumn("whole", F.col("far") <= F.lit(inside * inside))
        .select(*[c for c in points.columns if c not in GRID], *GRID, "whole")
    )


def _first_cells(points: DataFrame, chord: float, slack: float, edge: float) -> DataFrame:
    reach = F.lit(chord + slack + MARGIN)
    spans = {
        axis: tuple(
            F.floor((F.col(axis) + way * reach) / F.lit(edge)).cast("long") for way in (-1, 1)
        )
        for axis in ("x", "y", "z")
    }
    return _touched(points, spans, chord, slack, edge)


def _child_cells(cells: DataFrame, chord: float, slack: float, edge: float) -> DataFrame:
    """The same for the eight parts of each cell."""
    spans = {axis: (F.col(f"c{axis}") * 2, F.col(f"c{axis}") * 2 + 1) for axis in ("x", "y", "z")}
    return _touched(cells.drop("whole"), spans, chord, slack, edge)


def _cell_counts(places: DataFrame) -> DataFrame:
    """Rows and different places of each cell."""
    by_place = places.groupBy(*GRID, "lat", "lon").agg(F.count(F.lit(1)).alias("rows"))
    return by_place.groupBy(*GRID).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("places"))


def candidates_of_points(
    hotels: DataFrame,
    points: DataFrame,
    radius_km: float,
    limit: int = SEARCH_LIMIT,
    split: int = SPLIT,
) -> DataFrame:
    """For every point hotels that hold its best ``limit`` within the radius, few more:
    (point_id, point_lat, point_lon, hotel_id, star_rating, lat, lon, whole). Where
    ``whole`` is false the distance is still to be tested.

    Hotels and points meet on equal cells of a cubic grid around the unit sphere,
    where neither the poles nor the 180th meridian are special. Three facts keep
    dense places small without losing a result:

    * all hotels of a cell inside the circle qualify, so only the cell's best
      ``limit`` can be among the point's best;
    * hotels at one place qualify together, so the same holds for a place in a
      cell that the circle cuts;
    * a cell of more than ``split`` places is split into eight, these again, and
      so on. The circle cuts only the cells along its edge, of which the small ones
      hold few places; the cells within it are whole.

    The cells are a tree that is deep only where places are many. It is walked level
    by level, a join each; two counts a level are all the driver learns.
    """
    placed = points.select("point_id", "point_lat", "point_lon").withColumns(_unit_vector("point_lat", "point_lon"))
    return _met(hotels, placed, ["point_id"], _chord(radius_km), 0.0, limit, split).drop("x", "y", "z")


def _chord(radius_km: float) -> float:
    """The straight distance, in a unit sphere, of two places a radius apart."""
    return 2.0 * math.sin(min(radius_km / EARTH_RADIUS_KM, math.pi) / 2.0)


def _met(
    hotels: DataFrame, balls: DataFrame, key: list[str], chord: float, slack: float, limit: int, split: int | None
) -> DataFrame:
    """The same for balls around any (x, y, z), named by ``key``; without ``split`` no cell
    is split."""
    edge = max(chord / CELLS_PER_RADIUS, 1e-5)
    placed = hotels.select("hotel_id", "star_rating", "lat", "lon").withColumns(_unit_vector("lat", "lon"))
    places = placed.withColumns(_cells(edge))
    cells = _first_cells(balls, chord, slack, edge)
    shown = [*balls.columns, "hotel_id", "star_rating", "lat", "lon", "whole"]
    found = []
    for level in range(DEEPEST + 1):
        counts = _cell_counts(places)
        rows, most = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("places"), F.lit(0))).first()
        size = rows * row_bytes(places)  # bounds all that is drawn from them
        last = level == DEEPEST or split is None or most <= split
        own = places
        if not last:
            dense = stage_table(counts.where(F.col("places") > split).select(*GRID), "dense-cells")
            own = lookup(places, dense, GRID, "left_anti", salt=["hotel_id"], at_most_bytes=size)
        by_cell = first_rows(places.drop("x", "y", "z"), GRID, best_first(), limit)
        by_place = first_rows(own.drop("x", "y", "z"), [*GRID, "lat", "lon"], best_first(), limit)
        whole, cut = cells.where("whole"), cells.where("NOT whole")
        for some, rest in ((whole, by_cell), (cut, by_place)):
            met = lookup(some, rest, GRID, "inner", salt=key, at_most_bytes=size)
            found.append(met.select(*shown))
        if last:
            break
        edge /= 2
        inner = lookup(places, dense, GRID, "left_semi", salt=["hotel_id"], at_most_bytes=size)
        places = stage_table(inner.withColumns(_cells(edge)), "places")
        parents = lookup(cut, dense, GRID, "left_semi", salt=key, at_most_bytes=size)
        cells = stage_table(_child_cells(parents, chord, slack, edge), "cells")
    return reduce(DataFrame.unionByName, found)


def _spread(rows: DataFrame, keys: list[str], per_task: int) -> DataFrame:
    """The rows dealt to as many tasks as their number asks for, whatever their bytes."""
    return rows.repartition(max(1, math.ceil(rows.count() / per_task)), *keys)


def grouped(points: DataFrame, radius_km: float) -> DataFrame:
    """The points with the cell that gathers them, a part of the radius wide."""
    edge = max(_chord(radius_km) / GROUPS_PER_RADIUS, 1e-5)
    placed = points.select("point_id", "point_lat", "point_lon").withColumns(_unit_vector("point_lat", "point_lon"))
    cells = {f"g{name[1]}": cell for name, cell in _cells(edge).items()}
    return placed.withColumns(cells).drop("x", "y", "z")


def shortlists(hotels: DataFrame, groups: DataFrame, radius_km: float, limit: int = SEARCH_LIMIT) -> DataFrame:
    """For every group (gx, gy, gz) the hotels that can be among the best ``limit`` of any
    point in it: (gx, gy, gz, hotel_id, star_rating, lat, lon).

    Hotels near enough to the group's centre are within the radius of all its points.
    Once ``limit`` of these are better than a hotel, it is no result of any. So where
    hotels lie evenly a list holds little more than ``limit``, however many there are,
    and each hotel meets a number of groups that their size alone decides.
    """
    chord = _chord(radius_km)
    edge = max(chord / GROUPS_PER_RADIUS, 1e-5)
    slack = edge * math.sqrt(3.0) / 2.0
    reach, inside = chord + slack + MARGIN, chord - slack - MARGIN
    centre = {axis: (F.col(f"g{axis}") + F.lit(0.5)) * F.lit(edge) for axis in ("x", "y", "z")}
    balls = _spread(groups, GROUP, GROUPS_PER_TASK).withColumns(centre)
    met = _met(hotels, balls, GROUP, chord, slack, limit, None)
    place = _unit_vector("lat", "lon")
    apart = reduce(Column.__add__, [(F.col(axis) - place[axis]) * (F.col(axis) - place[axis]) for axis in place])
    sure = F.col("whole") | (F.col("apart") <= F.lit(inside * inside)) if inside > 0 else F.lit(False)
    near = met.withColumn("apart", apart).where(F.col("whole") | (F.col("apart") <= F.lit(reach * reach)))
    better = Window.partitionBy(*GROUP).orderBy(*best_first()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(sure.cast("int")).over(better), F.lit(0))
    listed = near.withColumn("ahead", ahead).where(F.col("ahead") < F.lit(limit))
    return listed.select(*GROUP, "hotel_id", "star_rating", "lat", "lon")


def top_within_radius_of_points(
    hotels: DataFrame,
    points: DataFrame,
    radius_km: float,
    limit: int = SEARCH_LIMIT,
    split: int = SPLIT,
) -> DataFrame:
    """For every point (point_id, point_lat, point_lon) its best ``limit`` hotels
    within the radius: (point_id, result_rank, hotel_id, star_rating, distance_km).

    Points are gathered by cells, each of which has a short list of hotels (see
    ``shortlists``). Where a town at the circle's edge makes a list long, the points are
    searched singly (see ``candidates_of_points``).
    """
    placed = _spread(grouped(points, radius_km), ["point_id"], POINTS_PER_TASK)
    groups = stage_table(grouped(points, radius_km).select(*GROUP).dropna().distinct(), "groups")
    listed = stage_table(shortlists(hotels, groups, radius_km, limit), "shortlists")
    sizes = listed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("rows"))
    long = F.col("rows") > F.lit(SHORTLIST * limit)
    rows, dense = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_if(long)).first()
    size = rows * row_bytes(listed)
    within = distance_km("point_lat", "point_lon", "lat", "lon") <= F.lit(radius_km)
    near = listed
    if dense:
        crowded = stage_table(sizes.where(long).select(*GROUP), "crowded")
        near = lookup(listed, crowded, GROUP, "left_anti", salt=["hotel_id"])
    found = lookup(placed, near, GROUP, "inner", salt=["point_id"], at_most_bytes=size).where(within)
    if dense:
        single = lookup(placed, crowded, GROUP, "left_semi", salt=["point_id"]).drop(*GROUP)
        met = candidates_of_points(hotels, single, radius_km, limit, split).where(F.col("whole") | within)
        found = found.drop(*GROUP).unionByName(met.drop("whole"))
    ranked = first_rows(found, ["point_id"], best_first(), limit, rank="result_rank")
    distance = distance_km("point_lat", "point_lon", "lat", "lon")
    return ranked.select("point_id", "result_rank", "hotel_id", "star_rating", distance.alias("distance_km"))
