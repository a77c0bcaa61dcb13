"""Same-name points within a radius: the pairs, and one point per connected group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmere import fixed
from gridmere.functions import sphere as S
from gridmere.operators.tables import keep_first, not_null
from gridmere.session import materialise

_DEGREE_KM = math.radians(1) * fixed.EARTH_RADIUS_KM
#: Edges that a task ties at once.
_EDGES = 250_000


def _level(size_km: float, at_most: bool) -> int:
    """The level whose cells are at most (or at least) this large."""
    exact = math.log2(360.0 / (size_km / _DEGREE_KM))
    return max(2, min(24, math.ceil(exact) if at_most else math.floor(exact)))


def pairs_within(
    points: DataFrame, point_id: str, name: str, radius_km: float,
    lat: str = "lat", lon: str = "lon",
) -> DataFrame:
    """All pairs a < b with the same name and at most this far apart: name, a, b, km."""
    level = _level(radius_km, at_most=False)
    limit = S.km_to_hav(radius_km)
    pts = points.where(not_null(name, lat, lon)).select(
        F.col(name), F.col(point_id).alias("__id"), F.col(lat).alias("__lat"), F.col(lon).alias("__lon")
    )
    homes = pts.select(
        name, F.col("__id").alias("a"), F.col("__lat").alias("__la"), F.col("__lon").alias("__lo"),
        S.cell_x(F.col("__lon"), level).alias("__cx"), S.cell_y(F.col("__lat"), level).alias("__cy"),
    )
    boxed, box = S.add_box(
        pts, "__p", F.col("__lat"), F.col("__lat"), F.col("__lon"), F.col("__lon")
    )
    reach = S.explode_cells_within(boxed, box, F.lit(limit), F.lit(level), "__cx", "__cy").select(
        name, F.col("__id").alias("b"), "__lat", "__lon", "__cx", "__cy"
    )
    h = S.hav(F.col("__la"), F.col("__lo"), F.col("__lat"), F.col("__lon"))
    return (
        homes.join(reach, [name, "__cx", "__cy"], "inner")
        .where((F.col("a") < F.col("b")) & (h <= limit))
        .select(name, "a", "b", S.hav_to_km(h).alias("km"))
    )


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets that the links a-b connect; every label is the least member of its set."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _stars(edges: DataFrame) -> DataFrame:
    """The edges (u, v) of each portion of `_EDGES` as stars: its nodes with the least that they reach within it."""

    def star(own: pa.Table) -> pa.RecordBatch:
        ends = [own.column(c).to_numpy() for c in ("u", "v")]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        labels = merge_labels(np.arange(len(nodes)), *np.split(at, 2))
        tied = np.flatnonzero(labels != np.arange(len(nodes)))
        kinds = own.schema.types
        made = [pa.array(x, kind) for x, kind in zip((nodes[tied], nodes[labels[tied]]), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(made, ["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for batch in batches:
            own.append(batch)
            size += batch.num_rows
            if size >= _EDGES:
                yield star(pa.Table.from_batches(own))
                own, size = [], 0
        if size:
            yield star(pa.Table.from_batches(own))

    return edges.mapInArrow(work, ", ".join(f"{c} {kind}" for c, kind in edges.dtypes))


def connected_groups(edges: DataFrame) -> DataFrame:
    """
    (node, group) for every node of an edge list (a, b); the group is its least node.

    Each task first ties the edges it reads, in portions of a bounded size, which settles a table that is one
    portion. Larger ones alternate two steps until nothing changes: each node's larger neighbours are tied
    to its least neighbour, then its smaller ones are. Both take a minimum per node and
    join it back, so a node with very many neighbours is never gathered in one place,
    and long chains shrink by a constant factor per round.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    e = materialise(edges.where(F.col("a") != F.col("b")).select(a, b).distinct(), "links")

    def fingerprint(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    tasks = -(-e.count() // _EDGES)
    e = materialise(_stars(e.coalesce(max(1, tasks))), "links")
    seen = fingerprint(e) if tasks > 1 else None
    while tasks > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = (
            tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(tied.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        e = materialise(small, "links")
        now = fingerprint(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("group", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(roots)


def merge_same_name(
    points: DataFrame, point_id: str, name: str, radius_km: float = fixed.SAME_STOP_KM,
    lat: str = "lat", lon: str = "lon",
) -> DataFrame:
    """
    One point per group of same-name points linked by steps of at most the radius, at
    their mean position: name, lat, lon, records.

    Points are first collapsed into cells too small to hold two points farther apart
    than the radius, so copies and crowds cost one node. Two cells whose points are
    surely within the radius, or surely not, are settled from the limits of their
    points; only the others compare points, and only those near enough to the other
    cell.
    """
    level = _level(radius_km / math.sqrt(2) * 0.999, at_most=True)
    limit = S.km_to_hav(radius_km)
    unique = keep_first(
        points.where(not_null(name, lat, lon)), [point_id], [F.col(lat), F.col(lon), F.col(name)]
    )
    pts = unique.select(
        F.col(name).alias("__name"), F.col(lat).alias("__lat"), F.col(lon).alias("__lon"),
        S.cell_x(F.col(lon), level).alias("__cx"), S.cell_y(F.col(lat), level).alias("__cy"),
    ).withColumn("node", F.concat_ws("/", "__cx", "__cy", "__name"))
    nodes = pts.groupBy("__name", "__cx", "__cy", "node").agg(
        F.min("__lat").alias("s"), F.max("__lat").alias("n"),
        F.min("__lon").alias("w"), F.max("__lon").alias("e"),
        F.count(F.lit(1)).alias("records"),
        F.sum("__lat").alias("sum_lat"), F.sum("__lon").alias("sum_lon"),
    )
    boxed, here = S.add_box(nodes, "__a", F.col("s"), F.col("n"), F.col("w"), F.col("e"))
    other, there = S.add_box(nodes, "__b", F.col("s"), F.col("n"), F.col("w"), F.col("e"))
    reach = S.explode_cells_within(
        boxed.drop("__cx", "__cy"), here, F.lit(limit), F.lit(level), "__cx", "__cy"
    ).select("__name", "__cx", "__cy", F.col("node").alias("a"), *here.columns)
    near = (
        reach.join(
            other.select("__name", "__cx", "__cy", F.col("node").alias("b"), *there.columns),
            ["__name", "__cx", "__cy"], "inner",
        )
        .where((F.col("a") < F.col("b")) & (S.hav_low(here, there) <= limit))
        .withColumn("sure", S.hav_high(here, there) <= limit)
    )
    unsure = near.where(~F.col("sure"))
    one = pts.select(F.col("node").alias("a"), F.col("__lat").alias("la"), F.col("__lon").alias("lo")).distinct()
    two = pts.select(F.col("node").alias("b"), F.col("__lat").alias("lb"), F.col("__lon").alias("lp")).distinct()
    left, spot = S.add_box(unsure.join(one, "a"), "__p", F.col("la"), F.col("la"), F.col("lo"), F.col("lo"))
    left = left.where(S.hav_low(spot, there) <= limit).select("a", "b", "la", "lo", *here.columns)
    right, spot = S.add_box(left.join(two, "b"), "__q", F.col("lb"), F.col("lb"), F.col("lp"), F.col("lp"))
    touching = right.where(S.hav_low(here, spot) <= limit).where(
        S.hav(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")) <= limit
    )
    edges = near.where("sure").select("a", "b").unionByName(touching.select("a", "b").distinct())
    groups = connected_groups(edges)
    return (
        nodes.join(groups, "node", "left")
        .groupBy("__name", F.coalesce("group", "node").alias("__g"))
        .agg(
            F.sum("sum_lat").alias("__la"), F.sum("sum_lon").alias("__lo"),
            F.sum("records").alias("records"),
        )
        .select(
            F.col("__name").alias(name), (F.col("__la") / F.col("records")).alias(lat),
            (F.col("__lo") / F.col("records")).alias(lon), "records",
        )
    )
