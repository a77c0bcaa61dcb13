"""
Benchmark decontamination: documents that hold a test item, give or take a few words.

An item of m words may differ in k of them (inserted, deleted or changed). Cut into k + 1
pieces, at least one piece must stand unchanged in any such passage. So documents are
searched for exact pieces, and only the surroundings of a hit are compared in full, by Myers'
bit-parallel edit distance over words. The items are the query set: they are bounded in blocks,
and each block is held against every document where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmere.llm.common import per_batch, texts

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased."""
    return _WORD.findall(text.lower())


def myers(pattern: list, text: list) -> tuple[int, int]:
    """
    The least edit distance between the pattern and any run of the text, and the first end
    of such a run (0 for the empty one). Columns of the table are bit vectors of their steps.
    """
    m = len(pattern)
    ones = (1 << m) - 1
    where: dict = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score = ones, 0, m
    best, at = m, 0
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = down | ~(diagonal | up) & ones
        fall = up & diagonal
        if rise >> (m - 1) & 1:
            score += 1
        elif fall >> (m - 1) & 1:
            score -= 1
        rise, fall = rise << 1 & ones, fall << 1 & ones
        up = fall | ~(diagonal | rise) & ones
        down = rise & diagonal
        if score < best:
            best, at = score, j
    return best, at


class ItemIndex:
    """The pieces of a block of items, by length and hash."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.items: list[tuple[int, np.ndarray, int]] = []
        self.ids: dict[str, int] = {}
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            if not own:
                continue
            budget = int(len(own) * share)
            cuts = [len(own) * i // (budget + 1) for i in range(budget + 2)]
            codes = np.array(own, "u8")
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(b - a, []).append((int(self._hashes(codes[a:b], b - a)[0]), len(self.items), a))
            self.items.append((item_id, codes, budget))
        self.pieces = {}
        for length, own in pieces.items():
            own.sort()
            hashes = np.array([h for h, _, _ in own], "u8")
            self.pieces[length] = (hashes, [(i, a) for _, i, a in own])

    @staticmethod
    def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
        """A hash of each run of `length` codes."""
        n = len(codes) - length + 1
        total = np.zeros(n, "u8")
        for j in range(length):
            total = total * _BASE + codes[j : j + n]
            total ^= total >> np.uint64(29)
        return total

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, end word) of the best passage for each item held."""
        get = self.ids.get
        codes = np.array([get(w, 0) for w in words(text)], "u8")
        if not codes.any():
            return []
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int, int]] = {}
        for length, (hashes, own) in self.pieces.items():
            if len(codes) < length:
                continue
            unknown = np.cumsum(np.append(0, codes == 0))
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            seen = self._hashes(codes, length)[at]
            first = np.searchsorted(hashes, seen, "left")
            last = np.searchsorted(hashes, seen, "right")
            for place, a, b in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                for i, offset in own[a:b]:
                    if (i, place - offset) not in tried:
                        tried.add((i, place - offset))
                        self._verify(codes, i, place - offset, best)
        return [(self.items[i][0], *found) for i, found in sorted(best.items())]

    def _verify(self, codes: np.ndarray, i: int, begin: int, best: dict) -> None:
        _, pattern, budget = self.items[i]
        low = max(0, begin - budget)
        near = codes[low : max(0, begin + len(pattern) + budget)].tolist()
        own = pattern.tolist()
        distance, end = myers(own, near)
        if distance <= budget:
            _, back = myers(own[::-1], near[:end][::-1])
            found = (distance, low + end - back, low + end)
            best[i] = min(best.get(i, found), found)


def _blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of about this many characters, whatever their number."""
    own = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text"))
    own = own.where(F.col("text").isNotNull())
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    number = 1 + total // block_chars
    block: Column = F.pmod(F.xxhash64("item_id", "text"), F.lit(number))
    for i in range(number):
        yield [tuple(r) for r in own.where(block == i).collect()]


def contaminations(
    docs: DataFrame, items: DataFrame, share: float = 0.2, block_chars: int = 8 << 20,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """
    (doc_id, item_id, distance, start_word, end_word): the best passage of each item in each
    document that holds it with at most `share` of the item's words edited, rounded down.

    Null texts, texts without words and items without words match nothing. Rows are
    searched one by one: repeated rows report each, and a null doc_id stays null. An item
    that occurs twice in a document is reported once, at its best passage, the first of equals.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, start_word int, end_word int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, item_id, item_text, block_chars):
        index = spark.sparkContext.broadcast(ItemIndex(block, share))

        def work(batch: pa.RecordBatch, index=index) -> pa.RecordBatch | None:
            rows = [
                (d, *found)
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                for found in index.value.find(t.as_py())
            ]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            names = [c.split()[0] for c in schema.split(", ")]
            return rows and pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
            ) or None

        out = out.unionByName(per_batch(texts(docs, doc_id, text), work, schema))
    return out


def without_contaminated(
    docs: DataFrame, items: DataFrame, share: float = 0.2, block_chars: int = 8 << 20,
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text holds none of the items."""
    for block in _blocks(items, item_id, item_text, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, share))

        def work(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            clean = [not index.value.find(t.as_py() or "") for t in batch.column(text)]
            return batch.filter(pa.array(clean, pa.bool_()))

        docs = per_batch(docs, work, docs.schema)
    return docs
