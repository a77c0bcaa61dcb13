"""
SimHash near-duplicates: documents whose 64-bit fingerprints differ in few bits.

Fingerprints are searched by a hierarchical index in Gray order. In that order neighbours
share long runs of equal bits; a node of the index holds the bits on which all its
fingerprints agree, and only those its parent doesn't hold yet. A search adds up
differing bits from the root down and leaves a whole group as soon as they are too many.

To spread the search over a cluster, fingerprints are dealt by parts of their bits: with three
differences, at least two of five parts are equal, so each linked pair meets under one of ten
keys. A key with too many fingerprints is dealt again by the bits it leaves free,
which bounds every index: three such steps leave 14 free bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmere.llm.common import per_batch, texts
from gridmere.operators.clusters import connected_groups, merge_labels
from gridmere.session import materialise

_ALL = (1 << 64) - 1
_BLOCK = 1 << 16
_FAN = 8
_WIDEST = 1 << 21


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """
    The fingerprint of a text: of the XXH64 values of its word shingles, repeats included, a bit
    is set if it is set in more than half. Without a word it is zero.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    total = len(words) - size + 1
    ones = np.zeros(64, "i8")
    for at in range(0, total, _BLOCK):
        some = words[at : at + _BLOCK + size - 1]
        joined = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some])
        starts = [0, *ends[: len(some) - size].tolist()]
        stops = (ends[size - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], "<u8")
        bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, print): the fingerprint of every whole text, as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], "<u8")
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(made.view("<i8"))], ["doc_id", "print"]
        )

    return per_batch(texts(docs, doc_id, text), work, "doc_id long, print long")


def _finer(mask: int, parts: int, equal: int) -> list[int]:
    """The masks that fix `equal` of the `parts` parts of the bits that this one leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [len(free) * i // parts for i in range(parts + 1)]
    groups = [sum(1 << b for b in free[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
    return [mask | sum(some) for some in combinations(groups, equal)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _gray_rank(bits: Column) -> Column:
    """The place of a code in Gray order: each bit becomes the parity of it and all above."""
    for shift in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


class GrayIndex:
    """
    Index of runs of fingerprints, each run sorted by Gray rank and with a root of its own.

    levels[0] are the fingerprints, levels[-1] the roots. Per node: the bits known of all that
    is below it, their values, its first child and the end of its children, and the end of
    the fingerprints below it.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.codes, self.lengths = codes, lengths
        n = len(codes)
        known, bits, ends = np.full(n, _ALL, "u8"), codes, np.arange(1, n + 1)
        self.levels = [(known, bits, None, None, ends)]
        count = lengths
        while (count > 1).any():
            first = np.cumsum(count) - count
            above = -(-count // _FAN)
            run = np.repeat(np.arange(len(count)), above)
            place = np.arange(len(run)) - np.repeat(np.cumsum(above) - above, above)
            start = first[run] + _FAN * place
            stop = np.append(start[1:], len(known))
            spread = np.bitwise_or.reduceat(bits ^ np.repeat(bits[start], stop - start), start)
            known = np.bitwise_and.reduceat(known, start) & ~spread
            bits, ends, count = bits[start] & known, ends[stop - 1], above
            self.levels.append((known, bits, start, stop, ends))

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs a < b of the same run with at most this many differing bits, in portions."""
        size = np.repeat(self.lengths, self.lengths)
        root = np.repeat(np.arange(len(self.lengths)), self.lengths)
        portion = (np.cumsum(size) - 1) // _WIDEST
        for cut in np.split(np.arange(len(size)), np.flatnonzero(np.diff(portion)) + 1):
            query, node = cut, root[cut]
            differing = np.zeros(len(query), "i8")
            seen = np.zeros(len(query), "u8")
            for level in range(len(self.levels) - 1, -1, -1):
                known, bits, start, stop, ends = self.levels[level]
                own = known[node] & ~seen
                differing = differing + np.bitwise_count((self.codes[query] ^ bits[node]) & own)
                keep = (differing <= most) & (ends[node] > query + 1)
                query, node, differing = query[keep], node[keep], differing[keep]
                if level and len(query):
                    children = stop[node] - start[node]
                    seen = np.repeat(known[node], children)
                    offset = np.arange(len(seen)) - np.repeat(np.cumsum(children) - children, children)
                    query, differing = np.repeat(query, children), np.repeat(differing, children)
                    node = np.repeat(start[node], children) + offset
                elif not level:
                    later = node > query
                    yield query[later], node[later]
                else:
                    break


def _chains(codes: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to connect what is connected: each fingerprint with the first of its set."""
    labels = np.arange(len(codes))
    for a, b in GrayIndex(codes, lengths).links(most):
        labels = merge_labels(labels, a, b)
    tied = np.flatnonzero(labels != np.arange(len(codes)))
    return codes[tied], codes[labels[tied]]


def _search(keyed: DataFrame, differences: int) -> DataFrame:
    """The links (a, b) found under each key, reduced to a chain per connected set."""

    def linked(table: pa.Table) -> pa.RecordBatch | None:
        mask, value = (table.column(c).to_numpy() for c in ("mask", "value"))
        codes = table.column("print").to_numpy().view("<u8")
        new = np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
        lengths = np.diff(np.append(np.flatnonzero(new), len(new)))
        several = np.repeat(lengths > 1, lengths)
        if not several.any():
            return None
        a, b = _chains(codes[several], lengths[lengths > 1], differences)
        return pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            table = (pa.concat_tables([rest, own]) if rest is not None else own).combine_chunks()
            mask, value = (table.column(c).to_numpy() for c in ("mask", "value"))
            last = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = table.slice(cut)
            if cut and (made := linked(table.slice(0, cut))) is not None:
                yield made
        if rest is not None and (made := linked(rest)) is not None:
            yield made

    return (
        keyed.repartition("mask", "value")
        .sortWithinPartitions("mask", "value", "rank")
        .select("mask", "value", "print")
        .mapInArrow(work, "a long, b long")
    )


def near_links(prints: DataFrame, differences: int = 3, most: int = 8192) -> DataFrame:
    """
    Links (a, b) between the distinct fingerprints of the column `print` that connect the same
    fingerprints as all pairs with at most `differences` differing bits do.

    Keys with more than `most` fingerprints are dealt again by their free bits; nothing is
    left out.
    """
    spark = prints.sparkSession
    parts, equal = differences + 2, 2
    ranked = prints.select("print", _gray_rank(F.col("print")).alias("rank"))
    masks = _finer(0, parts, equal)
    keyed = ranked.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])))
    keyed = keyed.withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
    found = []
    while max(64 - m.bit_count() for m in masks) > most.bit_length() - 1:
        crowded = materialise(
            keyed.groupBy("mask", "value").count().where(F.col("count") > most).select("mask", "value"),
            "crowded",
        )
        if crowded.isEmpty():
            break
        found.append(_search(keyed.join(crowded, ["mask", "value"], "left_anti"), differences))
        steps = [(m, f) for m in masks for f in _finer(m, parts, equal)]
        masks = sorted({f for _, f in steps})
        finer = spark.createDataFrame([(_signed(m), _signed(f)) for m, f in steps], "mask long, finer long")
        keyed = (
            keyed.join(crowded, ["mask", "value"], "left_semi")
            .join(F.broadcast(finer), "mask")  # at most 100 or 1,000 rows, whatever the data
            .select("print", "rank", F.col("finer").alias("mask"))
            .distinct()
            .withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
        )
    found.append(_search(keyed, differences))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(
    docs: DataFrame, differences: int = 3, shingle: int = 3,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """
    (doc_id, fingerprint as 16 hexadecimal digits, component_id): one row per row of `docs`,
    with the least doc_id that chains of near fingerprints reach.

    Null and empty texts, and texts of blanks, have fingerprint zero and are linked like all
    others. Rows without a doc_id are kept and take part, but can't give a component its id,
    which is null if no member has one. Repeated rows come back as often. Other columns are
    ignored. Equal fingerprints are one entry of the index, so groups of copies cost nothing.
    """
    return grouped(materialise(fingerprints(docs, shingle, doc_id, text), "prints"), differences)


def grouped(own: DataFrame, differences: int = 3) -> DataFrame:
    """The same for a written table of `fingerprints`."""
    distinct = materialise(own.groupBy("print").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = connected_groups(near_links(distinct, differences))
    named = distinct.join(groups.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "group", F.coalesce("group", "print")
    )
    least = named.groupBy("group").agg(F.min("first_id").alias("component_id"))
    member = named.join(least, "group").select("print", "component_id")
    return own.join(member, "print", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the least doc_id of each group of near fingerprints; see `keep_least`."""
    return keep_least(docs, materialise(near_duplicates(docs, doc_id=doc_id, text=text), "groups"), doc_id)


def keep_least(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """
    `docs`, all columns as they are, with the least doc_id of each group of near duplicates, given
    as (doc_id, component_id) with one row per row of `docs`.

    Of rows that repeat a doc_id one stays. Rows without a doc_id link others but can't be
    named, so they stay.
    """
    others = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(doc_id))
    left = docs.join(others.distinct(), doc_id, "left_anti")
    repeated = materialise(
        found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(
            F.col("doc_id").alias(doc_id)
        ),
        "repeated",
    )
    if repeated.isEmpty():
        return left
    once = left.join(repeated, doc_id, "left_semi").dropDuplicates([doc_id])
    return left.join(repeated, doc_id, "left_anti").unionByName(once)
