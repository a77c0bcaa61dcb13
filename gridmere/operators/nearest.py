"""
k nearest points, exactly, from an adaptive tree of cells and equi-joins.

The search runs over distinct positions, so any number of rows at one address
costs one search; rows get their answer back through an equi-join. No pair is
formed between a position and a point that could not be among its k nearest:

1. each right point is dealt to one leaf: a cell of about 2.4 km, or a smaller one if that
   holds more than `LEAF` points. In the order of a Z curve, the cells that a point
   shares with the point `LEAF` places on are those that have to be split, so one window
   per 2.4 km cell finds all leaves. A leaf knows the limits of its points;
2. leaves are counted in the cells above them, and in the 3x3 block around each of these. For
   a position the smallest block with at least k points bounds the distance of the k-th;
3. the frontier of a position starts with what this bound reaches, as cells four levels
   below those of the block, and goes on with the leaves in the cells that stay. Each
   time, the k-th smallest upper bound drops all whose lower bound is above it. A dense
   city far away so contributes the leaves on its near side only;
4. positions meet the points of the remaining leaves and keep the k nearest.

All of it is one plan; nothing is measured while it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmere.functions import sphere as S
from gridmere.operators.tables import not_null

BASE = 14  # cells of about 2.4 km
FINEST = 26  # cells of about 60 cm
LEAF = 16  # points of a leaf above the finest
STEP = 4  # levels between a block and the first frontier
_BOX = ["__south", "__north", "__west", "__east"]


def _cell(level: Column | int) -> list[Column]:
    """The cell at a level, from the cell numbers at the finest one."""
    up = F.lit(FINEST) - level
    return [S.coarser(F.col("__x"), up), S.coarser(F.col("__y"), up)]


def _z_order() -> Column:
    """The place of a finest cell on the Z curve through its 2.4 km cell."""

    def spread(c: Column) -> Column:
        c = c.bitwiseAND(F.lit((1 << (FINEST - BASE)) - 1))
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(F.col("__x")).bitwiseOR(F.shiftleft(spread(F.col("__y")), 1))


def with_leaves(points: DataFrame, lat: str, lon: str, by: list[str]) -> DataFrame:
    """The points with their leaf: its level `__v` and cell `__cx`, `__cy`."""
    x, y = S.cell_x(F.col(lon), FINEST), S.cell_y(F.col(lat), FINEST)
    cells = points.withColumns({"__x": x, "__y": y})
    cells = cells.withColumns({"__bx": _cell(BASE)[0], "__by": _cell(BASE)[1], "__z": _z_order()})
    base = Window.partitionBy(*by, "__bx", "__by").orderBy("__z")
    apart = F.col("__z").bitwiseXOR(F.lead("__z", LEAF).over(base))
    bits = F.when(apart == 0, 0).otherwise(F.length(F.bin(apart)))
    cells = cells.withColumn("__common", F.floor((2 * (FINEST - BASE) - bits) / 2))
    split = F.max("__common").over(base.rowsBetween(-LEAF, 0))
    level = F.least(F.lit(FINEST), F.coalesce(BASE + 2 * F.floor(split / 2 + 1), F.lit(BASE))).cast("int")
    cells = cells.withColumn("__v", level)
    return cells.withColumns({"__cx": _cell(F.col("__v"))[0], "__cy": _cell(F.col("__v"))[1]}).drop(
        "__bx", "__by", "__z", "__common"
    )


def _even(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last, F.lit(2)))


def _blocks(down: DataFrame, by: list[str], k: int) -> DataFrame:
    """Cells whose 3x3 block holds at least k points; the block of level 0 is everything."""
    step, whole = F.array(F.lit(-1), F.lit(0), F.lit(1)), F.array(F.lit(0))
    around = F.when(F.col("__l") == 0, whole).otherwise(step)
    counts = down.where("__own = 0").groupBy(*by, "__l", "__ax", "__ay").agg(F.sum("__n").alias("__n"))
    return (
        counts.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
        .select(
            *by, "__l", F.pmod(F.col("__ax") + F.col("__dx"), S.cells_around(F.col("__l"))).cast("long").alias("__ax"),
            (F.col("__ay") + F.col("__dy")).alias("__ay"), "__n",
        )
        .groupBy(*by, "__l", "__ax", "__ay").agg(F.sum("__n").alias("__n"))
        .where((F.col("__n") >= k) | (F.col("__l") == 0)).drop("__n")
    )


def _nearest_only(met: DataFrame, by: list[str], k: int) -> DataFrame:
    """Drops cells of the frontier that lie beyond the k-th smallest upper bound of their position."""
    here = S.Box("__a")
    there = S.Box("__c")
    met, there = S.add_box(met, "__c", *[F.col(c) for c in _BOX])
    met = met.withColumns({"__lo": S.hav_low(here, there), "__hi": S.hav_high(here, there)})
    met = met.where(F.col("__lo") <= F.col("__u")).drop(*there.columns)
    own = Window.partitionBy("lat", "lon", *by)
    if k == 1:
        enough = F.min("__hi").over(own)
    else:
        nearest_first = own.orderBy("__hi", "__m", "__mx", "__my").rowsBetween(Window.unboundedPreceding, 0)
        met = met.withColumn("__sum", F.sum("__n").over(nearest_first))
        enough = F.min(F.when(F.col("__sum") >= k, F.col("__hi"))).over(own)
    return (
        met.withColumn("__u", F.least(F.col("__u"), F.coalesce(enough, F.lit(1.0))))
        .where(F.col("__lo") <= F.col("__u")).drop("__lo", "__hi", "__sum", *_BOX)
    )


def _frontier(positions: DataFrame, leaves: DataFrame, by: list[str], k: int) -> DataFrame:
    """(lat, lon, category) with the leaves that can hold one of the k nearest points."""
    limits = [F.min("__south").alias("__south"), F.max("__north").alias("__north"), F.min("__west").alias("__west"), F.max("__east").alias("__east")]
    above = leaves.withColumn("__l", _even(F.lit(0), F.col("__v")))
    above = above.withColumns({"__ax": _cell(F.col("__l"))[0], "__ay": _cell(F.col("__l"))[1], "__m": F.least(F.col("__l") + STEP, F.col("__v"))})
    above = above.withColumns({"__mx": _cell(F.col("__m"))[0], "__my": _cell(F.col("__m"))[1]})
    cell = [*by, "__l", "__ax", "__ay", "__m", "__mx", "__my"]
    down = above.groupBy(*cell).agg(F.sum("__n").alias("__n"), *limits).withColumn("__own", F.lit(0))
    alone = above.where("__l = __v").select(*cell, "__n", *_BOX).withColumn("__own", F.lit(1))

    x, y = S.cell_x(F.col("lon"), FINEST), S.cell_y(F.col("lat"), FINEST)
    every = positions.withColumns({"__x": x, "__y": y}).withColumn("__l", _even(F.lit(0), F.lit(FINEST)))
    every = every.withColumns({"__ax": _cell(F.col("__l"))[0], "__ay": _cell(F.col("__l"))[1]})
    bound = (
        every.join(_blocks(down, by, k), ["__l", "__ax", "__ay"])
        .groupBy("lat", "lon", "__x", "__y", *by).agg(F.max("__l").alias("__b"))
    )
    bound, here = S.add_box(bound, "__a", F.col("lat"), F.col("lat"), F.col("lon"), F.col("lon"))
    bound, block = S.add_cell_box(
        bound, "__k", *_cell(F.col("__b")), F.lit(360.0) / S.cells_around(F.col("__b")), reach=1
    )
    reach = F.when(F.col("__b") == 0, F.lit(1.0)).otherwise(S.hav_high(here, block))
    bound = bound.withColumn("__u", reach).drop(*block.columns, "__x", "__y")
    # leaves above the level of the block are met at their own
    levels = F.when(F.col("__b") > BASE, F.sequence(F.lit(BASE), F.col("__b"), F.lit(2))).otherwise(F.array("__b"))
    bound = bound.withColumn("__l", F.explode(levels)).withColumn("__own", (F.col("__l") < F.col("__b")).cast("int"))
    reached = S.explode_cells_within(bound.drop("__b"), here, F.col("__u"), F.col("__l"), "__ax", "__ay")
    met = reached.join(down.unionByName(alone), [*by, "__l", "__ax", "__ay", "__own"]).drop("__l", "__ax", "__ay", "__own")
    met = _nearest_only(met, by, k).drop("__n")
    found = above.select(
        *by, F.col("__l").alias("__m"), F.col("__ax").alias("__mx"), F.col("__ay").alias("__my"), "__v", "__cx", "__cy", "__n", *_BOX
    )
    met = met.join(found, [*by, "__m", "__mx", "__my"]).withColumns({"__m": F.col("__v"), "__mx": F.col("__cx"), "__my": F.col("__cy")})
    return _nearest_only(met, by, k).select("lat", "lon", *by, "__v", "__cx", "__cy")


def nearest_k(
    left: DataFrame,
    right: DataFrame,
    k: int = 1,
    lat: str = "lat",
    lon: str = "lon",
    right_lat: str = "lat",
    right_lon: str = "lon",
    right_id: str = "fid",
    by: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """
    One row per distinct left position (and per category in `by`) and neighbour:
    lat, lon, rank 1..k, the point's id, `keep` columns and km. Equal distances are
    ordered by id. Fewer than k points give as many rows as there are.
    """
    by, keep = by or [], keep or []
    points = right.where(not_null(right_lat, right_lon)).select(
        *by, F.col(right_id).alias("__id"), *[F.col(c).alias(f"__keep_{c}") for c in keep],
        F.col(right_lat).cast("double").alias("__lat"), F.col(right_lon).cast("double").alias("__lon"),
    )
    # More than k points at one position cannot all be among the k nearest.
    copies = Window.partitionBy(*by, "__lat", "__lon").orderBy("__id")
    points = points.withColumn("__c", F.row_number().over(copies)).where(F.col("__c") <= k).drop("__c")
    points = with_leaves(points, "__lat", "__lon", by)
    leaves = points.groupBy(*by, "__v", "__cx", "__cy").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__lat").alias("__south"), F.max("__lat").alias("__north"),
        F.min("__lon").alias("__west"), F.max("__lon").alias("__east"), F.min("__x").alias("__x"), F.min("__y").alias("__y"),
    )
    positions = left.where(not_null(lat, lon)).select(F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
    candidates = _frontier(positions, leaves, by, k)
    h = S.hav(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))
    pairs = candidates.join(points.drop("__x", "__y"), [*by, "__v", "__cx", "__cy"]).withColumn("__h", h)
    kept = [f"__keep_{c}" for c in keep]
    if k == 1:
        best = pairs.groupBy("lat", "lon", *by).agg(
            F.min(F.struct("__h", "__id", *kept)).alias("__b")
        )
        found = best.select(
            "lat", "lon", *by, F.lit(1).alias("rank"), F.col("__b.__id").alias("__id"),
            F.col("__b.__h").alias("__h"), *[F.col(f"__b.{c}").alias(c) for c in kept],
        )
    else:
        w = Window.partitionBy("lat", "lon", *by).orderBy("__h", "__id")
        found = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select(
        "lat", "lon", *by, "rank", F.col("__id").alias(right_id),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
        S.hav_to_km(F.col("__h")).alias("km"),
    )


def with_nearest_km(
    left: DataFrame,
    right: DataFrame,
    name: str,
    lat: str = "lat",
    lon: str = "lon",
    right_lat: str = "lat",
    right_lon: str = "lon",
    right_id: str = "fid",
) -> DataFrame:
    """
    Every left row with the distance to the nearest right point; null without
    coordinates or without points.
    """
    near = nearest_k(left, right, 1, lat, lon, right_lat, right_lon, right_id).select(
        F.col("lat").alias("__la"), F.col("lon").alias("__lo"), F.col("km").alias(name)
    )
    on = (F.col(lat) == F.col("__la")) & (F.col(lon) == F.col("__lo"))
    return left.join(near, on, "left").drop("__la", "__lo")


def with_nearest_km_by(
    left: DataFrame,
    right: DataFrame,
    category: str,
    categories: list[str],
    name: str = "nearest_{}_km",
    lat: str = "lat",
    lon: str = "lon",
    right_lat: str = "lat",
    right_lon: str = "lon",
    right_id: str = "fid",
) -> DataFrame:
    """One distance column per category, from one search over all categories."""
    near = nearest_k(left, right, 1, lat, lon, right_lat, right_lon, right_id, by=[category])
    wide = near.groupBy(F.col("lat").alias("__la"), F.col("lon").alias("__lo")).agg(
        *[
            F.min(F.when(F.col(category) == c, F.col("km"))).alias(name.format(c))
            for c in categories
        ]
    )
    on = (F.col(lat) == F.col("__la")) & (F.col(lon) == F.col("__lo"))
    return left.join(wide, on, "left").drop("__la", "__lo")
