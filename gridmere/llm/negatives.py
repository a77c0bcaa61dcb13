"""
Hard negatives of anchor vectors by Fagin's threshold algorithm.

The vectors become integers and are dealt evenly into shards of bounded size. A shard keeps
one list per dimension, sorted by that component. For an anchor each list is read from its
rewarding end, which the sign of the anchor's component tells; every row met is scored at
once from its whole vector. The products at the places read so far add up to a threshold
that no unread row can exceed, so reading ends once it falls strictly below the last score
wanted of every window. Two searches are needed, as the windows depend on the positives:
the best of the same label, then the best of other labels within each positive's window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmere.session import materialise

#: Components are whole numbers of this size at most, so that sums of products stay in a long.
_LIMIT = 1 << 26
#: Sums of products below this are exact in doubles.
_EXACT = 1 << 53

_VECTOR = "id long, label long, vector array<int>"


def usable_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256,
) -> DataFrame:
    """
    (id, label, vector): rows with an id, a label and a vector whose components are all
    there and finite, each as the floor of `scale` times it. Components beyond 2^26 count as that.
    """
    whole = F.transform(
        F.col(vector), lambda x: F.greatest(
            F.least(F.floor(x.cast("double") * scale), F.lit(float(_LIMIT))), F.lit(float(-_LIMIT))
        ).cast("int"),
    )

    def unusable(x: Column) -> Column:
        wide = x.cast("double")
        return wide.isNull() | F.isnan(wide) | (F.abs(wide) == float("inf"))

    return rows.where(
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
        & ~F.exists(F.col(vector), unusable)
    ).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("vector")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows; those shorter than the longest end in zeros."""
    flat = column.combine_chunks()
    lengths = flat.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
    out = np.zeros((len(flat), width), "i8")
    out[np.arange(width) < lengths[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max([1, *(int(pa.compute.max(pa.compute.list_value_length(c)).as_py() or 0) for c in columns)])


class SortedLists:
    """The candidates of a shard, with one list of them per dimension in ascending order."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.lists = np.argsort(vectors.T, axis=1, kind="stable").astype("i4")
        self.sorted = np.take_along_axis(vectors.T, self.lists, axis=1)
        self.largest = int(np.abs(vectors).max(initial=0))
        self.real = vectors.astype("f8")

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Random access: the exact inner products of these rows."""
        if self.largest * int(np.abs(anchor).sum()) < _EXACT:
            return (self.real[rows] @ anchor.astype("f8")).astype("i8")
        return self.vectors[rows] @ anchor

    def search(
        self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """
        For each window of scores (least, most) the rows of its k best scores, and the scores;
        rows that tie with the kth are all given. `allowed` says which rows take part.
        """
        n = len(self.vectors)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, "i8"), np.zeros(0, "i8")
        depth, step = 0, max(16, n // 32)
        while True:
            reach = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.lists[up, n - reach : n - depth]] = True
            fresh[self.lists[down, depth:reach]] = True
            if not len(up) + len(down):
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen & allowed)
            seen |= fresh
            rows, scores = np.append(rows, new), np.append(scores, self.scores(new, anchor))
            threshold = int(
                (anchor[up] * self.sorted[up, n - reach]).sum() + (anchor[down] * self.sorted[down, reach - 1]).sum()
            )
            found, done = [], True
            for least, most in windows:
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                last = least
                if len(inside) > k:
                    last = int(np.partition(scores[inside], len(inside) - k)[len(inside) - k])
                    inside = inside[scores[inside] >= last]
                elif len(inside) == k:
                    last = int(scores[inside].min())
                done &= threshold < last
                found.append((rows[inside], scores[inside]))
            if done or reach == n or not len(up) + len(down):
                return found
            depth, step = reach, reach


def _against_all(
    anchors: DataFrame, rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    shards: int, blocks: int,
) -> DataFrame:
    """Every block of anchors with every shard of rows, each pair of them in one group."""
    pairs = shards * blocks
    left = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys, parts = ["shard", "block"], min(2 * pairs, 100_000)
    return (
        left.repartition(parts, *keys).groupBy(*keys)
        .cogroup(right.repartition(parts, *keys).groupBy(*keys))
        .applyInArrow(work, schema)
    )


def _walk(
    left: pa.Table, right: pa.Table, windows: Callable[[dict], list[tuple[int, int]]], same: bool, k: int
) -> Iterator[tuple[dict, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, window, ids, labels, scores) of what the shard has for each anchor and window."""
    if not (left.num_rows and right.num_rows):
        return
    width = _width(left.column("vector"), right.column("vector"))
    lists = SortedLists(_matrix(right.column("vector"), width))
    ids, labels = (right.column(c).to_numpy() for c in ("id", "label"))
    vectors = _matrix(left.column("vector"), width)
    for i, anchor in enumerate(left.drop(["vector"]).to_pylist()):
        if same:
            allowed = (labels == anchor["label"]) & (ids != anchor["id"])
        else:
            allowed = labels != anchor["label"]
        for place, (at, scores) in enumerate(lists.search(vectors[i], allowed, windows(anchor), k)):
            best = np.lexsort((ids[at], -scores))[:k]
            yield anchor, place, ids[at[best]], labels[at[best]], scores[best]


def _best(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, is_anchor: Column | None = None, relabel: Column | None = None, positives: int = 5,
    negatives: int = 10, window: tuple[int, int] = (30, 90), shard_rows: int = 16_384, block_anchors: int = 4096,
) -> DataFrame:
    """
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor its best `positives` rows of the same label, and for each of these the best
    `negatives` rows of other labels whose score is between `window` hundredths of the positive's.

    `is_anchor` and `relabel` are columns over id and label: which rows are anchors, and their
    labels (all rows, and the labels as they are, if not given). Higher scores come first, ties by smaller id.
    Rows without id, label or vector, or with a missing or infinite component, take no part. A
    shorter vector counts as ending in zeros. Rows that repeat are candidates as often as they occur and
    come back as often; a row never is a positive of an anchor with its id; equal anchors are one.
    Anchors without a positive, and positives without a negative, give no rows.

    Each search deals (anchors / block_anchors) x (rows / shard_rows) groups of bounded size.
    """
    own = usable_vectors(rows, vec_id, vector, label, scale)
    if relabel is not None:
        own = own.withColumn("label", relabel.cast("long"))
    spark = rows.sparkSession
    own = materialise(own.withColumn("at", F.monotonically_increasing_id()), "vectors")
    count = own.count()
    most = max(1, -(-count // 1024))
    shards = max(1, -(-count // shard_rows), min(most, 2 * spark.sparkContext.defaultParallelism))
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int")).drop("at")

    anchors = own.where(is_anchor) if is_anchor is not None else own
    anchors = anchors.select("id", "label", "vector").distinct().withColumn("key", F.xxhash64("id", "label", "vector"))
    anchors = materialise(anchors, "anchors")
    blocks = max(1, -(-anchors.count() // block_anchors))
    anchors = anchors.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor_id", "key", "id", "score")}
        every = [(-(1 << 62), 1 << 62)]
        for anchor, _, ids, _, scores in _walk(left, right, lambda _: every, True, positives):
            out["anchor_id"] += [anchor["id"]] * len(ids)
            out["key"] += [anchor["key"]] * len(ids)
            out["id"] += ids.tolist()
            out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    schema = "anchor_id long, key long, id long, score long"
    found = _against_all(anchors, dealt, same_label, schema, shards, blocks)
    chosen = materialise(_best(found, ["anchor_id", "key"], positives, "place"), "positives")
    windows = chosen.groupBy("anchor_id", "key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("wanted")
    )
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "id"), ["id", "key"])
    low, high = window

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor_id", "key", "place", "id", "score")}

        def limits(anchor: dict) -> list[tuple[int, int]]:
            return [(-((-low * p) // 100), high * p // 100) for p in anchor["wanted"]]

        for anchor, place, ids, _, scores in _walk(left, right, limits, False, negatives):
            out["anchor_id"] += [anchor["id"]] * len(ids)
            out["key"] += [anchor["key"]] * len(ids)
            out["place"] += [place + 1] * len(ids)
            out["id"] += ids.tolist()
            out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    schema = "anchor_id long, key long, place long, id long, score long"
    found = _against_all(asked, dealt, within, schema, shards, blocks)
    mined = _best(found, ["anchor_id", "key", "place"], negatives, "rank").withColumnRenamed("id", "negative_id")
    named = chosen.select(
        "anchor_id", "key", F.col("place").cast("long").alias("place"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return mined.join(named, ["anchor_id", "key", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        F.col("score").alias("negative_score"),
    )


def oracle_sql() -> str:
    """The registered query, for DuckDB."""
    return """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
                   CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
            FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ),
        positive AS (
            SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored
            WHERE label = anchor_label
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
         AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """
