"""
A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

A uniformly random permutation sends from each group of rows to each shard a number of rows
that is hypergeometric. Those numbers are drawn first: the capacities of all shards are
split between two halves of the groups, and so on down to single groups. Rows are then permuted
inside their group, cut at the drawn numbers, exchanged, and permuted again inside
their shard. Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmere.session import materialise

_ROWS_PER_GROUP = 1 << 18


def _bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _uniform(*key: Column | int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    columns = [F.lit(k) if isinstance(k, int) else k for k in key]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _hypergeometric(n: Column, good: Column, total: Column, u: Column) -> Column:
    """
    How many of `n` rows drawn from `total` are among its `good` ones, by inversion of u. Outcomes
    are tried from the most likely one outwards, up to 9 standard deviations and 40; weights
    follow from their ratios, so no factorial is needed, and what is beyond is less than 1e-17.
    """

    def draw(x: Column) -> Column:
        n, good, total, mode = (x[k].cast("double") for k in ("n", "good", "total", "mode"))

        def up(k: Column) -> Column:
            return (good - k) * (n - k) / ((k + 1) * (total - good - n + k + 1))

        def down(k: Column) -> Column:
            return k * (total - good - n + k) / ((good - k + 1) * (n - k + 1))

        spread = F.sqrt(n * good / F.greatest(total, F.lit(1.0)))
        steps = F.sequence(F.lit(1), (9 * spread + 40).cast("int"))
        one = F.lit(1.0)

        def weigh(a: Column, i: Column) -> Column:
            more, less = a["up"] * up(mode + i - 1), a["down"] * down(mode - i + 1)
            return F.struct(
                more.alias("up"), less.alias("down"), (a["sum"] + more + less).alias("sum")
            )

        start = F.struct(one.alias("up"), one.alias("down"), one.alias("sum"))
        mass = F.aggregate(steps, start, weigh, lambda a: a["sum"])

        def walk(a: Column, i: Column) -> Column:
            more, less = a["up"] * up(mode + i - 1), a["down"] * down(mode - i + 1)
            after_more, after_both = a["left"] - more, a["left"] - more - less
            here = (
                F.when(a["found"].isNotNull(), a["found"])
                .when(after_more < 0, mode + i)
                .when(after_both < 0, mode - i)
            )
            return F.struct(
                more.alias("up"), less.alias("down"), after_both.alias("left"), here.alias("found")
            )

        first = x["u"] * mass - 1
        begin = F.struct(
            one.alias("up"), one.alias("down"), first.alias("left"),
            F.when(first < 0, mode).alias("found"),
        )
        return F.coalesce(F.aggregate(steps, begin, walk, lambda a: a["found"]), mode).cast("long")

    mode = F.floor((n + 1) * ((good + 1) / (total + 2)))
    mode = F.greatest(F.least(mode, n, good), n + good - total, F.lit(0))
    given = F.struct(
        n.alias("n"), good.alias("good"), total.alias("total"), mode.alias("mode"), u.alias("u")
    )
    return F.when((n == 0) | (good == 0), F.lit(0)).when(n == total, good).otherwise(_bound(given, draw))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _split(room: Column, n: Column, node: Column, seed: int) -> Column:
    """How much of each shard's room goes to the first n rows of all that fill it."""
    start = F.struct(
        n.alias("n"), _sum(room).alias("total"), F.array().cast("array<bigint>").alias("taken")
    )

    def take(a: Column, s: Column) -> Column:
        good = F.get(room, s)
        drawn = _hypergeometric(a["n"], good, a["total"], _uniform(seed, node, s))
        return _bound(
            drawn,
            lambda k: F.struct(
                (a["n"] - k).alias("n"), (a["total"] - good).alias("total"),
                F.concat(a["taken"], F.array(k)).alias("taken"),
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, take, lambda a: a["taken"])


def communication_matrix(counts: DataFrame, levels: int, sizes: list[int], seed: int = 7) -> DataFrame:
    """
    (group, taken): for each of 2^levels groups, how many of its rows go to each shard, drawn
    as a uniform shuffle would. `counts` has the rows of each group as (group, n); groups
    that it doesn't name are empty.
    """
    spark = counts.sparkSession
    groups = spark.range(1 << levels).select(F.col("id").cast("int").alias("group"))
    full = groups.join(counts, "group", "left").select("group", F.coalesce("n", F.lit(0)).alias("n"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("group", "n"))), lambda x: x["n"])
    nodes = full.agg(in_order.alias("counts")).select(
        F.lit(1).cast("long").alias("node"), "counts",
        F.array(*[F.lit(s).cast("long") for s in sizes]).alias("room"),
    )
    for level in range(levels):
        half = 1 << (levels - level - 1)
        first, rest = F.slice("counts", 1, half), F.slice("counts", half + 1, half)
        nodes = nodes.select("node", "room", first.alias("first"), rest.alias("rest")).withColumn(
            "taken", _split(F.col("room"), _sum(F.col("first")), F.col("node"), seed)
        )
        left = F.zip_with("room", "taken", lambda a, b: a - b)
        nodes = nodes.select(
            F.explode(
                F.array(
                    F.struct((2 * F.col("node")).alias("node"), F.col("first").alias("counts"), F.col("taken").alias("room")),
                    F.struct((2 * F.col("node") + 1).alias("node"), F.col("rest").alias("counts"), left.alias("room")),
                )
            ).alias("x")
        ).select("x.*")
        if level == 5:
            nodes = nodes.repartition("node")
    return nodes.select(
        (F.col("node") - (1 << levels)).cast("int").alias("group"), F.col("room").alias("taken")
    )


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """
    `docs`, all columns as they are, with `__shard` (0 to shards - 1) and `__slot` (gapless from 0
    in each shard): a uniform shuffle whose shards differ by one row at most.

    Every row counts, whatever it holds: null keys, empty texts and repeated rows are dealt
    like any other, and a frequent value isn't kept together. An empty table gives no rows.
    Rows are dealt to groups by a hash of a row number that is written out once, so
    that a retried task deals them alike.
    """
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows", "zstd")
    n = rows.count()
    levels = max(6, math.ceil(math.log2(max(1, n) / _ROWS_PER_GROUP)))
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    dealt = rows.withColumn(
        "__group", F.pmod(F.xxhash64(F.lit(seed), "__row"), F.lit(1 << levels)).cast("int")
    )
    counts = dealt.groupBy(F.col("__group").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    matrix = materialise(communication_matrix(counts, levels, sizes, seed), "matrix")
    ends = F.transform(
        F.sequence(F.lit(1), F.size("taken")), lambda i: _sum(F.slice("taken", F.lit(1), i))
    )
    cuts = matrix.select(F.col("group").alias("__group"), ends.alias("__ends"))

    in_group = Window.partitionBy("__group").orderBy(F.xxhash64(F.lit(seed + 1), "__row"), "__row")
    ranked = dealt.withColumn("__rank", F.row_number().over(in_group)).join(cuts, "__group")
    shard = F.size(F.filter("__ends", lambda end: end < F.col("__rank"))).cast("int")

    blocks = 4 + n // (shards * _ROWS_PER_GROUP)
    sent = ranked.withColumn("__shard", shard).withColumn(
        "__block", F.pmod(F.xxhash64(F.lit(seed + 2), "__row"), F.lit(blocks)).cast("int")
    )
    own = ["__shard", "__block"]
    before = Window.partitionBy("__shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    places = sent.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).select(
        *own, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    in_block = Window.partitionBy(*own).orderBy(F.xxhash64(F.lit(seed + 3), "__row"), "__row")
    numbered = sent.withColumn("__place", F.row_number().over(in_block)).join(places, own)
    return numbered.select(
        *docs.columns, "__shard", (F.col("__before") + F.col("__place") - 1).alias("__slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 7) -> None:
    """Writes the shuffled rows as one folder per shard, each file in slot order."""
    shuffled = shuffle_into_shards(docs, shards, seed)
    blocks = shuffled.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    blocks.write.partitionBy("__shard").parquet(path)
