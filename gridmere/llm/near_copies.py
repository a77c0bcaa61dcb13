"""
Near copies by the exact Jaccard similarity of their runs of five words.

The first links are those of SimHash: each group of near fingerprints (see `simhash`), of the same runs of
five words, is compared with its least member. Three of 64 bits reach most copies alike at 0.97 or more and few
at 0.8, so other candidates share a band of min-hashes: with 20 bands of 5 hashes, two texts alike at 0.8 meet
under a band with probability 0.9996. Under each key the members are compared with pivots, members of
different groups, eight times as many in each round as in the one before, until all members
are in one group or were pivots themselves; so no candidate is left out, and no two members of a group
are compared for nothing. An odd sketch of each text, 1,024 bits that tell of how many of its runs fall to
each whether they are odd, bounds from below how many runs only one of two texts has; pairs that it shows
to be unlike go within the join. Each other comparison is of the whole texts, a pivot's being sent once for many.

Texts are numbered by their places in the table, so a set of them is one bit a text (see `marked`), and neither
the texts that are compared nor those that stay are found by a shuffle of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmere.llm.common import per_batch, texts
from gridmere.llm.encoder import encoder
from gridmere.llm.hubs import beside_hubs
from gridmere.llm.passages import WORDS, tokens
from gridmere.llm.simhash import fingerprint, grouped
from gridmere.operators.clusters import connected_groups
from gridmere.session import materialise

_BANDS, _HASHES = 20, 5
_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, _BANDS * _HASHES, dtype="u8") * np.uint64(2) + np.uint64(1)
_BLOCK = 2048
_MORE = 8
_ODD_BITS = 1024
#: Texts of at most so many runs are told apart by their odd sketches, longer ones by their min-hashes too.
_SHORT = 1024
_NUMBER = "__number"
#: Texts whose runs are held at once.
_TEXTS = 512


def shingles(text: str) -> np.ndarray:
    """The distinct runs of five words as sorted hashes; a shorter text is one run."""
    own = tokens(text)
    if not len(own):
        own = np.array([xxhash.xxh64_intdigest(b" ".join(text.lower().encode().split()))], "u8")
    return np.unique(own)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def minima(own: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), np.iinfo("u8").max)
    for at in range(0, len(own), _BLOCK):
        hashes = own[at : at + _BLOCK, None] * _FACTORS
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, hashes.min(axis=0))
    return least


def bands(own: np.ndarray) -> np.ndarray:
    """One hash of the min-hashes of each band."""
    return _bands(minima(own))


def _bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(_BANDS, _HASHES)
    made = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]
    return np.array(made, "u8").view("<i8")


def odd_sketch(own: np.ndarray) -> np.ndarray:
    """
    Of the distinct hashes that fall to each bit, whether they are odd in number, as longs. What two texts share
    cancels out: their sketches differ in at most as many bits as there are hashes that only one of them has.
    """
    bits = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _ODD_BITS.bit_length() + 1)
    odd = np.bincount(bits.astype("i8"), minlength=_ODD_BITS) & 1
    return np.packbits(odd.astype("u1")).view("<i8")


def _can_be_alike(least: float) -> Column:
    """Whether the numbers of runs and the odd sketches of a pair let it be alike at `least`; no such pair is lost."""
    differing = sum(
        F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("pivot_odd")[i])) for i in range(_ODD_BITS // 64)
    )
    sizes = F.least("n", "pivot_n") >= F.lit(least) * F.greatest("n", "pivot_n")
    return sizes & ((1 + least) * differing <= (1 - least) * (F.col("n") + F.col("pivot_n")) + 0.001)


def _likely(met: DataFrame, least: float) -> DataFrame:
    """
    Without the pairs that cannot be alike at `least`, and without those of longer texts that agree
    in fewer min-hashes than pairs alike at `least` do, but for one in 2,000.
    """
    enough = int(len(_FACTORS) * least - 3.3 * (len(_FACTORS) * least * (1 - least)) ** 0.5)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = batch.column("marks").to_pylist(), batch.column("pivot_marks").to_pylist()
        short = np.array([a is None or b is None for a, b in zip(*marks, strict=True)])
        one, two = (
            np.frombuffer(b"".join(m or bytes(len(_FACTORS)) for m in some), "u1").reshape(-1, len(_FACTORS))
            for some in marks
        )
        return batch.select(["node", "pivot"]).filter(pa.array(short | ((one == two).sum(axis=1) >= enough)))

    met = met.where(_can_be_alike(least)).select("node", "pivot", "marks", "pivot_marks")
    return per_batch(met, work, "node long, pivot long")


def marked(df: DataFrame, numbers: DataFrame, number: str, within: bool = True) -> DataFrame:
    """
    The rows of `df` whose `number` stands in the column of that name in `numbers`, or those where it doesn't. The
    set is joined as bitmaps of 32,768 numbers each: for numbers by place in a table, about a bit a row.
    """
    at, bit = F.bitmap_bucket_number(number), F.bitmap_bit_position(number)
    bits = numbers.groupBy(at.alias("__at")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    both = df.join(materialise(bits, "bits"), at == F.col("__at"), "inner" if within else "left")
    return both.where(there if within else ~F.coalesce(there, F.lit(False))).drop("__at", "__bits")


def _alike(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """The pairs (member, hub) whose texts are alike at `least`, as (a, b)."""

    def compare(one: np.ndarray, two: np.ndarray, pair: dict) -> Iterator[tuple]:
        if (similarity := jaccard(one, two)) >= least:
            yield (similarity,)

    found = beside_hubs(pairs, bodies, shingles, compare, pa.schema([("similarity", pa.float64())]))
    return found.select(F.col("member").alias("a"), F.col("hub").alias("b"))


def near_copies(
    docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """
    (doc_id, component_id): one row per row of `docs`, with the least doc_id that chains of texts
    alike at `similarity` reach. Texts with the same runs of words are one node, so copies cost
    nothing. Null and blank texts are alike; rows without a doc_id take part, but can't
    give a component its id.
    """
    rows = materialise(
        texts(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "texts", "zstd"
    )
    return _grouped(rows, similarity).select("doc_id", "component_id")


def _grouped(rows: DataFrame, similarity: float) -> DataFrame:
    """(row, doc_id, component_id) of a written table (row, doc_id, text), where `row` numbers its rows."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder.cache_clear()  # the tables that a packing left in this worker take more room than all of this
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        least = [minima(s) for s in sets]
        sums = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"), batch.column("doc_id"), pa.array(sums, pa.binary()),
                pa.array([_bands(x) for x in least], pa.list_(pa.int64())),
                pa.array(
                    [x.astype("u1").tobytes() if len(s) > _SHORT else None for s, x in zip(sets, least, strict=True)],
                    pa.binary(),
                ),
                pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64())),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([fingerprint(t.as_py(), WORDS) for t in batch.column("text")], "<u8").view("<i8")),
            ],
            ["row", "doc_id", "content", "bands", "marks", "odd", "n", "print"],
        )

    own = materialise(
        per_batch(
            rows, measure,
            "row long, doc_id long, content binary, bands array<bigint>, marks binary, odd array<bigint>, n long, "
            "print long", _TEXTS,
        ),
        "bands",
    )
    nodes = materialise(
        own.groupBy("content").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")), "nodes"
    )
    single = marked(own, nodes.select(F.col("node").alias("row")), "row")
    keyed = single.select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    marks = single.select(F.col("row").alias("node"), "marks", "odd", "n")
    keyed = materialise(keyed.join(shared, "key", "left_semi").join(marks, "node"), "keys")
    prints = single.select(F.col("row").alias("doc_id"), "print")
    near = grouped(prints).where("doc_id <> component_id")
    tried = materialise(near.select(F.col("doc_id").alias("member"), F.col("component_id").alias("hub")), "near")
    wanted = keyed.select("node").unionByName(tried.select(F.col("member").alias("node")))
    wanted = wanted.unionByName(tried.select(F.col("hub").alias("node")))
    bodies = materialise(marked(rows.select(F.col("row").alias("node"), "text"), wanted, "node"), "bodies", "zstd")

    found = materialise(_alike(tried, bodies, similarity), "alike")
    hubs = found.select(F.col("b").alias("node"), F.col("b").alias("group")).distinct()
    groups = found.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(hubs)
    n_pivots = 1
    while True:
        placed = keyed.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
        ends = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"))
        mixed = ends.where("low <> high").select("key")
        alive = materialise(placed.join(mixed, "key", "left_semi"), "alive")
        if alive.isEmpty():
            break
        order = F.xxhash64(F.lit(n_pivots), "node")
        best = F.min_by(F.struct("node", "marks", "odd", "n"), order).alias("best")
        one = alive.groupBy("key", F.col("group").alias("of")).agg(best).select(
            "key", "of", F.col("best.node").alias("pivot"), F.col("best.marks").alias("pivot_marks"),
            F.col("best.odd").alias("pivot_odd"), F.col("best.n").alias("pivot_n"),
        )
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(n_pivots), "pivot"), "pivot"))
        pivots = materialise(one.withColumn("place", place).where(F.col("place") <= n_pivots).drop("place"), "pivots")
        met = _likely(alive.join(pivots, "key").where(F.col("group") != F.col("of")), similarity)
        both = F.least("node", "pivot").alias("low"), F.greatest("node", "pivot").alias("high")
        new = met.groupBy(*both).agg(F.min("pivot").alias("hub")).select(
            F.when(F.col("hub") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("member"), "hub"
        )
        swapped = tried.select(F.col("hub").alias("member"), F.col("member").alias("hub"))
        pairs = materialise(new.join(tried.unionByName(swapped), ["member", "hub"], "left_anti"), "pairs")
        keyed = alive.join(pivots.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti")
        keyed = keyed.select("key", "node", "marks", "odd", "n")
        n_pivots *= _MORE
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs)
        found = materialise(_alike(pairs, bodies, similarity), "alike")
        if found.isEmpty():
            continue
        known = groups.select(F.col("node").alias("a"), F.col("group").alias("b"))
        groups = materialise(connected_groups(known.unionByName(found)), "groups")
    named = nodes.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = named.groupBy("group").agg(F.min("first_id").alias("component_id"))
    member = named.join(least, "group").select("content", "component_id")
    return own.select("row", "doc_id", "content").join(member, "content").select("row", "doc_id", "component_id")


def one_of_each(
    docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """
    `docs`, all columns as they are, with the least doc_id of each group of near copies.

    Of rows that repeat a doc_id one stays. Rows without a doc_id link others but can't be
    named, so they stay.
    """
    numbered = materialise(docs.withColumn(_NUMBER, F.monotonically_increasing_id()), "numbered", "zstd")
    rows = texts(numbered, doc_id, text, F.col(_NUMBER).alias("row"))
    found = materialise(_grouped(rows, similarity).where("doc_id IS NOT NULL"), "groups")
    ids = found.groupBy("doc_id").agg(
        F.min("row").alias("first"), F.max(F.col("doc_id") != F.col("component_id")).alias("out")
    )
    gone = found.join(ids.where(F.col("out")), "doc_id", "left_semi").select(F.col("row").alias(_NUMBER))
    again = found.join(ids, "doc_id").where("NOT out AND row <> first").select(F.col("row").alias(_NUMBER))
    return marked(numbered, gone.unionByName(again), _NUMBER, within=False).drop(_NUMBER)
