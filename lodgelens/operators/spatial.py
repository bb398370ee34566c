"""Spatial joins between point sets (J6-J11) and the density grid (Q15).

No theta join is ever planned: every distance predicate becomes an equi-join
on a grid cell plus an exact haversine filter.

* Grid: latitude is cut into bands of equal height, each band into as many
  equal cells round the globe as fit at its narrower edge, so cells are about
  square everywhere.  The cells that a circle can touch are enumerated band by
  band and wrap at +/-180 degrees; near a pole the whole ring of a band is
  taken.  No bound of the data is needed, so nothing is scanned before the
  plan exists.
* Radius counts: probes go to the tiles that their circle touches, points to
  their own, and a task goes through its tiles one after the other (``tiles``):
  in stripes of latitude, points surely inside are counted by binary searches,
  and only those at the circle's edge are looked at.  A circle's cost grows
  with the root of the points in it.  Probes with the same coordinates are one
  probe.
* Nearest neighbour: the nearest point of a probe's own tile bounds the
  distance, and the tiles within that bound are looked at next.  Probes of a
  tile without points go by levels: reference cells are known at several grid
  levels, each four times coarser.  A probe's finest level with a point in its
  neighbourhood (its local density) bounds the nearest distance; the occupied
  cells of the next finer level within that bound tighten it, and only cells
  that can still hold the nearest point are opened.  Equi-joins, no rounds, no
  cap on candidates, no probe unresolved.
* Exactness: tasks give back pairs that rounding could decide, and all but
  equal nearest points; Spark's own haversine decides.
* Skew: AQE skew-join splitting applies to the joins; a dense tile's points come
  to its task in parts of bounded size.
* Driver: every join is a sort-merge join by hint.  Reference tables compress
  to files far smaller than their rows, so Spark's own choice would build their
  hash tables on the driver.
* Plans: the bounds of a cell are made by a one-element explode, over which
  Spark moves no filter, so their long expressions stand once in a plan and are
  computed once.  Every plan is written out whenever a stage of it ends; a job
  that asks several questions gives ``stage`` (say, a checkpoint), which is put
  on the tables between the joins, and so has several small plans of each.
* Tasks: probes are few bytes but much work each, so they are dealt over a
  fixed number of tasks instead of the few that their bytes would give.

Probes with a null coordinate have no partner (count 0, distance null).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodgelens.functions.scalar import EARTH_RADIUS_KM, haversine_km
from lodgelens.operators import tiles

FINEST_KM, STEP = 0.02, 4  # cell side of the finest level of the nearest join, and how much coarser each next one is
LEVELS = math.ceil(math.log(math.pi * EARTH_RADIUS_KM / FINEST_KM, STEP)) + 1  # the coarsest neighbourhood holds the globe
TILE_LEVEL = 4  # the level of the nearest join's tiles: 5 km

Stage = Callable[[DataFrame], DataFrame]


def _lazy(df: DataFrame) -> DataFrame:
    return df


def degrees_of(km: float) -> float:
    return math.degrees(km / EARTH_RADIUS_KM)


# SQL fragments: ``d`` is the band height in degrees, ``y`` a band, ``x`` a cell of it.

def _ring(y: str, d: str) -> str:
    """Number of cells round the globe in a band."""
    return f"greatest(1L, cast(floor(360 * cos(radians(least(90D, greatest(abs({y} * {d}), abs(({y} + 1) * {d}))))) / {d}) as bigint))"


def _point_cell(d: str, lat: str, lon: str) -> tuple[str, str]:
    y = f"cast(floor({lat} / {d}) as bigint)"
    return y, f"pmod(cast(floor(pmod({lon} + 180D, 360D) / 360D * {_ring(y, d)}) as bigint), {_ring(y, d)})"


def _cells(d: str, rho: str, lat: str, lon: str) -> str:
    """Array of the cells (y, x, n = cells in the ring) within ``rho`` degrees
    of a point; 1e-9 degrees are added for rounding."""
    w = (f"if(abs({lat}) + {rho} >= 89.999999D, 180D, degrees(asin(least(1D, sin(radians({rho})) / cos(radians({lat}))))) + 1e-9D)")
    u = f"pmod({lon} + 180D, 360D)"
    lo, hi = f"cast(floor(({u} - b.w) / 360D * b.n) as bigint)", f"cast(floor(({u} + b.w) / 360D * b.n) as bigint)"
    bands = f"sequence(cast(floor(greatest(-90D, {lat} - {rho} - 1e-9D) / {d}) as bigint), cast(floor(least(90D, {lat} + {rho} + 1e-9D) / {d}) as bigint))"
    rings = f"transform({bands}, y -> named_struct('y', y, 'n', {_ring('y', d)}, 'w', {w}))"
    xs = f"if({hi} - {lo} + 1 >= b.n, sequence(0L, b.n - 1), sequence({lo}, {hi}))"
    return f"flatten(transform({rings}, b -> transform({xs}, r -> named_struct('y', b.y, 'x', pmod(r, b.n), 'n', b.n))))"


def _hav(lat1: str, lat2: str, dlon: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({dlon}) / 2), 2))"
    return f"({EARTH_RADIUS_KM}D * 2 * atan2(sqrt({a}), sqrt(1D - {a})))"


def _bounds(d: str, lat: str, lon: str) -> tuple[str, str]:
    """Lower and upper bound in km of the distance from a point to any point
    of cell c (y, x, n).  Within 90 degrees of longitude the farthest point is
    a corner on the farther meridian; beyond, the way over the nearer pole,
    at most half the globe, is the bound."""
    apart = f"abs(pmod({lon} + 180D - (c.x + 0.5D) / c.n * 360D + 180D, 360D) - 180D)"
    far, near = f"({apart} + 180D / c.n)", f"greatest(0D, {apart} - 180D / c.n)"
    south, north = f"greatest(-90D, c.y * {d})", f"least(90D, (c.y + 1) * {d})"
    over = f"radians(least(180D, 180D - {lat} - {south}, 180D + {lat} + {north})) * {EARTH_RADIUS_KM}D"
    high = f"if({far} > 90D, {over}, greatest({_hav(lat, south, far)}, {_hav(lat, north, far)}))"
    gap = f"radians(greatest(0D, c.y * {d} - {lat}, {lat} - (c.y + 1) * {d}))"
    side = f"asin(least(1D, cos(radians({lat})) * sin(radians(least(90D, {near})))))"
    return f"(greatest({gap}, {side}) * {EARTH_RADIUS_KM}D * (1 - 1e-9D) - 1e-9D)", f"({high} * (1 + 1e-9D) + 1e-9D)"


def _bounded(df: DataFrame, d: str, lat: str, lon: str) -> DataFrame:
    """With ``_b`` (low, high), the bounds of the distance to cell c."""
    low, high = _bounds(d, lat, lon)
    return df.withColumn("_b", F.expr(f"explode(array(named_struct('low', {low}, 'high', {high})))"))


def _valid(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def _places(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Distinct coordinates (_plat, _plon) of the probes, dealt over the tasks."""
    return _dealt(_valid(df, lat, lon).select(F.col(lat).cast("double").alias("_plat"), F.col(lon).cast("double").alias("_plon")).distinct())


def _dealt(places: DataFrame) -> DataFrame:
    """Places over a fixed number of tasks: what follows is much work for few
    bytes.  Dealt by a hash, as Spark drops a repartition by keys that the rows
    are already grouped by and merges the tasks again."""
    return places.repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_plat", "_plon"))


def _back(left: DataFrame, found: DataFrame, lat: str, lon: str) -> DataFrame:
    """The probes with what was found for their coordinates."""
    on = (F.col(lat).cast("double") == F.col("_plat")) & (F.col(lon).cast("double") == F.col("_plon"))
    return left.join(found.hint("merge"), on, "left").drop("_plat", "_plon")


def candidate_pairs(left: DataFrame, right: DataFrame, radius_km: float, *, lat="latitude", lon="longitude",
                    right_cols: list[str] | None = None) -> DataFrame:
    """All (left, right) pairs within ``radius_km`` (haversine, inclusive):
    left columns + ``right_cols`` + ``dist_km``.  Left rows go to the cells
    their circle touches, right rows to their own."""
    right_cols = right_cols or []
    overlap = set(right_cols) & set(left.columns)
    if overlap:
        raise ValueError(f"rename right columns first: {sorted(overlap)}")
    d, rho = f"{degrees_of(radius_km) * 1.001!r}D", f"{degrees_of(radius_km)!r}D"
    la, lo = f"cast({lat} as double)", f"cast({lon} as double)"
    y, x = _point_cell(d, la, lo)
    L = _valid(left, lat, lon).withColumn("_c", F.expr(f"explode({_cells(d, rho, la, lo)})"))
    Rt = _valid(right, lat, lon).select(F.col(lat).alias("_rlat"), F.col(lon).alias("_rlon"), *right_cols, F.expr(y).alias("_y"), F.expr(x).alias("_x"))
    dist = haversine_km(F.col(lat), F.col(lon), F.col("_rlat"), F.col("_rlon"))
    joined = L.join(Rt.hint("merge"), (F.col("_c.y") == F.col("_y")) & (F.col("_c.x") == F.col("_x")) & (dist <= F.lit(radius_km)))
    return joined.select(*left.columns, *right_cols, dist.alias("dist_km"))


def _within(radius_km: float) -> Column:
    """Whether (_rlat, _rlon) is within the radius of (_plat, _plon).  The
    haversine's inner term decides, which takes two sines; only where it is
    within 1e-9 of the limit the distance itself is compared."""
    half = math.pi / 360
    north, east = F.sin((F.col("_rlat") - F.col("_plat")) * half), F.sin((F.col("_rlon") - F.col("_plon")) * half)
    a = north * north + F.col("_pcos") * F.col("_rcos") * east * east
    limit = math.sin(min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2)) ** 2
    dist = haversine_km(F.col("_plat"), F.col("_plon"), F.col("_rlat"), F.col("_rlon"))
    return F.when(a > limit * (1 + 1e-9) + 1e-24, False).when(a < limit * (1 - 1e-9) - 1e-24, True).otherwise(dist <= radius_km)


# The pair table by cells (``_requests``, ``_in_circle``, ``_units``): no join uses it since the tiles, the tests still look at it.

def _requests(places: DataFrame, d: str, radii: list[float], near_km: float = 0.0) -> DataFrame:
    """(_plat, _plon, _k, _y, _x, _open, _mind): the cells each circle k can
    touch, and whether a cell has to be opened: because it isn't wholly inside
    the circle, or is within ``near_km`` of the probe."""
    circles = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(r)).alias("r"), F.lit(degrees_of(r)).alias("rho")) for k, r in enumerate(radii)])
    asked = places.withColumn("_q", F.explode(circles)).withColumn("c", F.expr(f"explode({_cells(d, '_q.rho', '_plat', '_plon')})"))
    opened = "_b.high > _q.r" + (f" or _b.low < {near_km!r}D" if near_km else "")
    return _bounded(asked, d, "_plat", "_plon").where("_b.low <= _q.r").select(
        "_plat", "_plon", F.cos(F.radians("_plat")).alias("_pcos"), F.col("_q.k").alias("_k"), F.col("c.y").alias("_y"), F.col("c.x").alias("_x"),
        F.expr(f"cast({opened} as int)").alias("_open"), F.col("_b.low").alias("_mind"))


def _in_circle(places: DataFrame, units: DataFrame, d: str, radii: list[float], near_km: float = 0.0) -> DataFrame:
    """Rows of ``units`` (keyed by _y, _x, _open, with point coordinates where
    opened) in each circle: the pair table of the radius joins."""
    q = _requests(places, d, radii, near_km)
    dist = F.when(F.col("_rlat").isNotNull(), haversine_km(F.col("_plat"), F.col("_plon"), F.col("_rlat"), F.col("_rlon")))
    inside = F.lit(False)
    for k, r in enumerate(radii):
        inside = F.when(F.col("_k") == k, _within(r)).otherwise(inside)
    return q.join(units.hint("merge"), ["_y", "_x", "_open"]).where((F.col("_open") == 0) | inside).withColumn("_dist", dist)


def _units(right: DataFrame, d: str, weights: dict[str, Column], lat: str, lon: str) -> DataFrame:
    """Points with their own cell to be opened, and one total per cell, from
    one pass over the rows (two grouping sets)."""
    y, x = _point_cell(d, "_rlat", "_rlon")
    rows = _valid(right, lat, lon).select(F.col(lat).cast("double").alias("_rlat"), F.col(lon).cast("double").alias("_rlon"),
                                          *[c.alias(n) for n, c in weights.items()]).withColumns({"_y": F.expr(y), "_x": F.expr(x)})
    units = rows.groupingSets([["_y", "_x", "_rlat", "_rlon"], ["_y", "_x"]], "_y", "_x", "_rlat", "_rlon").agg(
        *[F.count_if(n).alias(n) for n in weights], F.grouping("_rlat").alias("_whole"))
    return units.select("_rlat", "_rlon", F.cos(F.radians("_rlat")).alias("_rcos"), *weights, "_y", "_x", (1 - F.col("_whole")).alias("_open"))


def _tile(d: str, lat: str, lon: str) -> str:
    """The number of a point's tile."""
    y, x = _point_cell(d, lat, lon)
    return f"({y} * {1 << tiles.ROW_BITS}L + {x})"


def _reached(d: str, rho: str, lat: str, lon: str) -> str:
    """Array of the tiles within ``rho`` degrees of a point."""
    return f"transform({_cells(d, rho, lat, lon)}, c -> c.y * {1 << tiles.ROW_BITS}L + c.x)"


def _in_tiles(probes: DataFrame, points: DataFrame, kernel, schema: T.StructType) -> DataFrame:
    """The kernel's rows for probes and points (_tile, _lat, _lon, ...) that
    meet in a tile.  Rows are dealt by tile and sorted by one number, so a
    task reads tile after tile."""
    both = probes.withColumn("_t", F.col("_tile") * 2).unionByName(points.withColumn("_t", F.col("_tile") * 2 + 1), allowMissingColumns=True)
    dealt = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_tile"))
    return dealt.drop("_tile").sortWithinPartitions("_t").mapInArrow(kernel, schema)


def _counts(places: DataFrame, right: DataFrame, wanted: dict[str, tuple[float, Column | None]], lat: str, lon: str, fineness: int) -> DataFrame:
    """(_plat, _plon, counts) for the places that have points in a circle."""
    sizes = sorted({r for r, _ in wanted.values()})
    side = degrees_of(sizes[-1] * 8 / fineness)
    d, rho = f"{side!r}D", f"{degrees_of(sizes[-1])!r}D"
    asked = places.select(F.explode(F.expr(_reached(d, rho, "_plat", "_plon"))).alias("_tile"), F.col("_plat").alias("_lat"), F.col("_plon").alias("_lon"))
    weighed = {n: f"_w{i}" for i, (n, (_, c)) in enumerate(wanted.items()) if c is not None}
    held = _valid(right, lat, lon).select(F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"), *[
        F.coalesce(wanted[n][1], F.lit(False)).cast("tinyint").alias(w) for n, w in weighed.items()])
    held = held.select(F.expr(_tile(d, "_lat", "_lon")).alias("_tile"), "*")
    schema = T.StructType([T.StructField(n, t) for n, t in (("_plat", T.DoubleType()), ("_plon", T.DoubleType()), ("_k", T.IntegerType()), ("_rlat", T.DoubleType()),
                                                            ("_rlon", T.DoubleType()), *[(n, T.LongType()) for n in wanted])])
    kernel = tiles.counts(side, sizes, {n: sizes.index(r) for n, (r, _) in wanted.items()}, weighed, to_arrow_schema(schema))
    radius = F.element_at(F.array(*[F.lit(float(r)) for r in sizes]), F.col("_k") + 1)
    dist = haversine_km(F.col("_plat"), F.col("_plon"), F.col("_rlat"), F.col("_rlon"))
    sure = _in_tiles(asked, held, kernel, schema).where(F.col("_k").isNull() | (dist <= radius))
    return sure.groupBy("_plat", "_plon").agg(*[F.sum(n).alias(n) for n in wanted])


def radius_counts(left: DataFrame, right: DataFrame, radii: dict[str, float | tuple[float, Column]], *, left_id="id",
                  lat="latitude", lon="longitude", fineness: int = 4, stage: Stage = _lazy) -> DataFrame:
    """Per probe, the number of reference points within each radius,
    zero counts kept.  A radius may come with a condition on the reference
    rows; all radii and conditions share one pass over the tiles.
    ``fineness``: tiles per eight of the largest radius; more tiles are smaller
    tasks and get a probe's circle more often."""
    wanted = {n: v if isinstance(v, tuple) else (v, None) for n, v in radii.items()}
    sums = stage(_counts(stage(_places(left, lat, lon)), right, wanted, lat, lon, fineness))
    out = _back(left.select(left_id, lat, lon), sums, lat, lon)
    return out.select(left_id, *[F.coalesce(F.col(n), F.lit(0)).cast("int").alias(n) for n in wanted])


def radius_distinct_tokens(left: DataFrame, right: DataFrame, token_col: str, radius_km: float, out: str,
                           *, left_id="id", lat="latitude", lon="longitude", fineness: int = 4, stage: Stage = _lazy) -> DataFrame:
    """Number of distinct whitespace tokens of ``token_col`` over the
    reference points within the radius (empty and null texts add nothing).

    Probes of a cell are looked at together first: a token of a cell that lies
    within the radius of the whole probe cell is known for all its probes.
    Points are only opened for tokens that a probe cell doesn't know yet, so
    in a dense city hardly any are."""
    d = f"{degrees_of(radius_km / fineness)!r}D"
    toks = _valid(right, lat, lon).select(F.col(lat).cast("double").alias("_rlat"), F.col(lon).cast("double").alias("_rlon"),
                                          F.explode(F.split(F.trim(F.coalesce(F.col(token_col), F.lit(""))), r"\s+")).alias("_tok"))
    y, x = _point_cell(d, "_rlat", "_rlon")
    toks = stage(toks.where("_tok != ''").distinct().withColumns({"_y": F.expr(y), "_x": F.expr(x), "_rcos": F.cos(F.radians("_rlat"))}))
    y, x = _point_cell(d, "_plat", "_plon")
    places = stage(_places(left, lat, lon).withColumns({"_cy": F.expr(y), "_cx": F.expr(x), "_pcos": F.cos(F.radians("_plat"))}))

    # probe cells by their middle and the distance _m from it to their farthest point
    n = F.expr(_ring("_cy", d))
    cells = places.select("_cy", "_cx").distinct().repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_cy", "_cx"))
    mids = cells.select(
        "_cy", "_cx", F.expr(f"greatest(-90D, least(90D, (_cy + 0.5D) * {d}))").alias("_mlat"),
        ((F.col("_cx") + 0.5) / n * 360 - 180).alias("_mlon"), F.struct(F.col("_cy").alias("y"), F.col("_cx").alias("x"), n.alias("n")).alias("c"))
    mids = stage(_bounded(mids, d, "_mlat", "_mlon").select("_cy", "_cx", "_mlat", "_mlon", F.col("_b.high").alias("_m")))
    rho = F.least(F.degrees((F.col("_m") + radius_km) / EARTH_RADIUS_KM), F.lit(180.0))
    near = mids.withColumn("_rho", rho).withColumn("c", F.expr(f"explode({_cells(d, '_rho', '_mlat', '_mlon')})"))
    near = _bounded(near, d, "_mlat", "_mlon").where(F.col("_b.low") - F.col("_m") <= radius_km).select(
        "_cy", "_cx", F.col("c.y").alias("_y"), F.col("c.x").alias("_x"), (F.col("_b.high") + F.col("_m") <= radius_km).alias("_sure"))
    met = near.join(toks.select("_y", "_x", "_tok").distinct().hint("merge"), ["_y", "_x"])
    known = stage(met.where("_sure").select("_cy", "_cx", "_tok").distinct())
    unknown = met.where("not _sure").join(known.hint("merge"), ["_cy", "_cx", "_tok"], "left_anti").select("_cy", "_cx", "_y", "_x", "_tok")
    opened = places.join(unknown.hint("merge"), ["_cy", "_cx"]).join(toks.hint("merge"), ["_y", "_x", "_tok"]).where(_within(radius_km))
    more = stage(opened.groupBy("_plat", "_plon").agg(F.count_distinct("_tok").alias("_more")))
    sums = places.join(known.groupBy("_cy", "_cx").agg(F.count("*").alias("_known")).hint("merge"), ["_cy", "_cx"], "left")
    sums = sums.join(more.hint("merge"), ["_plat", "_plon"], "left").select(
        "_plat", "_plon", (F.coalesce("_known", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias(out))
    return _back(left.select(left_id, lat, lon), sums, lat, lon).select(left_id, F.coalesce(F.col(out), F.lit(0)).cast("int").alias(out))


def _nearest_places(places: DataFrame, right: DataFrame, payload: list[str], lat: str, lon: str, stage: Stage = _lazy) -> DataFrame:
    """(_plat, _plon, dist_km, payload) of the nearest right row; ties go to
    the smallest payload."""
    points = _valid(right, lat, lon).select(F.col(lat).cast("double").alias("_rlat"), F.col(lon).cast("double").alias("_rlon"), *payload)
    if payload:  # one row per place: its smallest payload
        points = points.groupBy("_rlat", "_rlon").agg(F.min(F.struct(*payload)).alias("_p"))
    else:
        points = points.distinct().withColumn("_p", F.struct(F.lit(0).alias("_")))
    points = stage(points)
    near = stage(_nearest_in_tiles(places, points, stage))
    rest = stage(places.select("_plat", "_plon").join(near.hint("merge"), ["_plat", "_plon"], "left_anti"))
    best = near.unionByName(_nearest_by_levels(rest, points, stage))
    return best.select("_plat", "_plon", F.col("_b.d").alias("dist_km"), *[F.col(f"_b._p.{c}").alias(c) for c in payload])


def _nearest_in_tiles(places: DataFrame, points: DataFrame, stage: Stage) -> DataFrame:
    """(_plat, _plon, _b (d, _p)) for the places whose own tile has a point:
    the nearest there bounds the distance, and only the other tiles within that
    bound are looked at."""
    side = degrees_of(FINEST_KM * STEP ** TILE_LEVEL)
    d = f"{side!r}D"
    held = points.select(F.expr(_tile(d, "_rlat", "_rlon")).alias("_tile"), F.col("_rlat").alias("_lat"), F.col("_rlon").alias("_lon"), "_p")
    schema = T.StructType([*[T.StructField(n, T.DoubleType()) for n in ("_plat", "_plon", "_rlat", "_rlon")], T.StructField("_p", points.schema["_p"].dataType)])
    dist = haversine_km(F.col("_plat"), F.col("_plon"), F.col("_rlat"), F.col("_rlon"))

    def met(asked: DataFrame, bound: str | None = None) -> DataFrame:
        found = _in_tiles(asked.withColumnsRenamed({"_plat": "_lat", "_plon": "_lon"}), held, tiles.nearest(side, bound), schema)
        return found.select("_plat", "_plon", F.struct(dist.alias("d"), "_p").alias("_b"))
    own = F.expr(_tile(d, "_plat", "_plon"))
    first = stage(met(places.select("_plat", "_plon", own.alias("_tile"))).groupBy("_plat", "_plon").agg(F.min("_b").alias("_b")))
    rho = F.degrees(F.col("_b.d") / EARTH_RADIUS_KM)
    asked = first.select("_plat", "_plon", F.col("_b.d").alias("_ub"), rho.alias("_rho"), own.alias("_own")).withColumn("_tile", F.explode(F.expr(_reached(d, "_rho", "_plat", "_plon"))))
    more = met(asked.where("_tile != _own").select("_plat", "_plon", "_tile", "_ub"), "_ub")
    return first.unionByName(more).groupBy("_plat", "_plon").agg(F.min("_b").alias("_b"))


def _nearest_by_levels(places: DataFrame, points: DataFrame, stage: Stage) -> DataFrame:
    """The same for any place, however far its nearest point, by grid levels."""
    heights = [degrees_of(FINEST_KM * STEP ** k) for k in range(LEVELS)]
    height = "element_at(array(" + ", ".join(f"{h!r}D" for h in heights) + "), _l + 1)"
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("_l"), F.lit(h).alias("_d")) for k, h in enumerate(heights)]))
    levels = points.withColumn("_v", every).select("*", "_v.*")
    y, x = _point_cell("_d", "_rlat", "_rlon")
    levels = levels.withColumns({"_y": F.expr(y), "_x": F.expr(x)})
    occupied = levels.select("_l", "_y", "_x").distinct()

    def held(asked: DataFrame) -> DataFrame:
        """The asked cells (struct c) that hold a point, with their bounds."""
        keyed = asked.withColumns({"_y": F.col("c.y"), "_x": F.col("c.x")})
        return _bounded(keyed.join(occupied.hint("merge"), ["_l", "_y", "_x"]).withColumn("_d", F.expr(height)), "_d", "_plat", "_plon")

    around = _dealt(places).withColumn("_v", every).select("_plat", "_plon", "_v.*")
    asked = around.select("_plat", "_plon", "_l", F.expr(f"explode({_cells('_d', '_d', '_plat', '_plon')})").alias("c"))
    first = stage(held(asked).groupBy("_plat", "_plon").agg(F.min(F.struct("_l", "_b.high")).alias("_f")))

    rho = F.least(F.degrees(F.col("_f.high") / EARTH_RADIUS_KM), F.lit(180.0))
    finer = _dealt(first).select("_plat", "_plon", F.greatest(F.col("_f._l") - 1, F.lit(0)).alias("_l"), rho.alias("_rho")).withColumn("_d", F.expr(height))
    asked = finer.select("_plat", "_plon", "_l", F.expr(f"explode({_cells('_d', '_rho', '_plat', '_plon')})").alias("c"))
    cells = held(asked).groupBy("_plat", "_plon", "_l").agg(
        F.min("_b.high").alias("_ub"), F.collect_list(F.struct("_y", "_x", "_b.low")).alias("_qs"))
    opened = cells.withColumn("_q", F.explode(F.filter("_qs", lambda q: q["low"] <= F.col("_ub")))).select("_plat", "_plon", "_l", "_q._y", "_q._x")

    dist = haversine_km(F.col("_plat"), F.col("_plon"), F.col("_rlat"), F.col("_rlon"))
    return opened.join(levels.select("_l", "_y", "_x", "_rlat", "_rlon", "_p").hint("merge"), ["_l", "_y", "_x"]).groupBy("_plat", "_plon").agg(
        F.min(F.struct(dist.alias("d"), "_p")).alias("_b"))


def nearest(left: DataFrame, right: DataFrame, *, right_id="ref_id", attrs: list[str] | None = None,
            left_id="id", lat="latitude", lon="longitude", stage: Stage = _lazy) -> DataFrame:
    """Distance to, id and attributes of the nearest reference point.

    Ties go to the smallest ``right_id``; probes with a null coordinate, or
    all when there is no reference point, get nulls."""
    found = stage(_nearest_places(stage(_places(left, lat, lon)), right, [right_id, *(attrs or [])], lat, lon, stage))
    return _back(left.select(left_id, lat, lon), found, lat, lon).drop(lat, lon)


def nearest_and_count(left: DataFrame, right: DataFrame, radius_km: float, out: str, *, left_id="id",
                      lat="latitude", lon="longitude", fineness: int = 4, stage: Stage = _lazy) -> DataFrame:
    """Distance to the nearest point and the number within the radius."""
    places = stage(_places(left, lat, lon))
    counted = stage(_counts(places, right, {out: (radius_km, None)}, lat, lon, fineness))
    found = stage(_nearest_places(places, right, [], lat, lon, stage))
    both = found.join(counted.hint("merge"), ["_plat", "_plon"], "left")
    return _back(left.select(left_id, lat, lon), both, lat, lon).select(left_id, "dist_km", F.coalesce(F.col(out), F.lit(0)).cast("int").alias(out))


def density_grid(df: DataFrame, value: str, cell_deg: float, lat="latitude", lon="longitude") -> DataFrame:
    """Q15: count, sum and mean of a value per map cell (partial aggregate)."""
    g = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(
        F.floor(F.col(lat) / cell_deg).cast("long").alias("cell_y"),
        F.floor(F.col(lon) / cell_deg).cast("long").alias("cell_x"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
