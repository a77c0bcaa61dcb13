"""
Reversible line dedup: an index of line keys that documents can join and leave.

The exact part is two tables: references (one row per document and key) and counts (documents
and largest doc_id per key). In front of them stand cuckoo filters, one per shard of the key
space, of the keys found in enough documents to be dropped. A document's lines are first looked
up there; only the few that a filter may hold reach the exact counts. Filters forget,
so a deletion takes out just the keys that fall below the limit, and dedup is undone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmere.llm.common import per_batch, texts
from gridmere.llm.cuckoo import CuckooFilter
from gridmere.session import materialise

_KEY = ["k1", "k2"]
_FILTERS = "shard int, cells binary, stash binary, n long"


def _key(line: bytes, least: int) -> bytes | None:
    """The digest of a line's key, or none if the key is shorter than `least` code points."""
    key = line.strip().lower()
    if len(key) < least or not (key.isascii() or len(key.decode()) >= least):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys_of(text: str, least: int) -> list[bytes]:
    found = {_key(line, least) for line in text.encode().split(b"\n")}
    found.discard(None)
    return list(found)


def _key_rows(doc_ids: pa.Array, keys: list[list[bytes]], shards: dict | None) -> pa.RecordBatch:
    """(doc_id, k1, k2) rows; with `shards`, only of keys that their shard's filter may hold."""
    pairs = np.frombuffer(b"".join(k for own in keys for k in own), "<i8").reshape(-1, 2)
    rows = np.repeat(np.arange(len(keys)), [len(own) for own in keys])
    if shards is not None:
        held = np.zeros(len(pairs), bool)
        shard = pairs[:, 1] % shards["number"]
        for s in np.unique(shard):
            if (own := shards["filters"].get(int(s))) is not None:
                at = np.flatnonzero(shard == s)
                held[at] = own.has(pairs[at, 0])
        pairs, rows = pairs[held], rows[held]
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(rows)), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())],
        ["doc_id", *_KEY],
    )


def line_keys(docs: DataFrame, least: int, shards=None) -> DataFrame:
    """(doc_id, k1, k2): the distinct keys of each document, as 128-bit digests."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [_keys_of(t.as_py(), least) for t in batch.column("text")]
        return _key_rows(batch.column("doc_id"), keys, shards.value if shards else None)

    return per_batch(docs, work, "doc_id long, k1 long, k2 long")


@dataclass(frozen=True)
class LineIndex:
    """
    One state of the index; `insert` and `delete` give the next and leave this one as it is.

    A document is a row: repeated rows count as often. A null doc_id counts as less than
    all others. Null and empty texts have one empty line, which is never a key.
    `filter_bytes` bounds the filters that are sent to all tasks; beyond it, every key is
    looked up in the exact counts instead, with the same result.
    """

    spark: SparkSession
    min_docs: int = 5
    min_chars: int = 40
    keys_per_shard: int = 100_000
    filter_bytes: int = 64 << 20
    references: DataFrame | None = None
    counts: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int = 0

    def _counted(self, references: DataFrame) -> DataFrame:
        return references.groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")
        )

    def _frequent(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n_docs") >= self.min_docs)

    def _with_filters(self, counts: DataFrame) -> LineIndex:
        """Filters built anew from the exact counts, in as many shards as the keys call for."""
        keys = self._frequent(counts).select(*_KEY)
        shards = 1 + keys.count() // self.keys_per_shard

        def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.sized(2 * len(own))
            made.add(own["k1"].to_numpy())
            return pd.DataFrame([(key[0], *made.to_bytes(), len(own))], columns=["shard", "cells", "stash", "n"])

        sharded = keys.withColumn("shard", F.pmod("k2", F.lit(shards)).cast("int"))
        filters = materialise(sharded.groupBy("shard").applyInPandas(build, _FILTERS), "filters")
        return replace(self, counts=counts, filters=filters, shards=shards)

    def _changed(self, counts: DataFrame, added: DataFrame, removed: DataFrame) -> LineIndex:
        """The filters of the shards in which keys crossed the limit, brought up to date."""
        sign = added.select(*_KEY, F.lit(1).alias("sign")).unionByName(
            removed.select(*_KEY, F.lit(-1).alias("sign"))
        )
        sharded = sign.withColumn("shard", F.pmod("k2", F.lit(self.shards)).cast("int"))

        def update(key: tuple, own: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            plus = own.loc[own["sign"] > 0, "k1"].to_numpy("i8")
            minus = own.loc[own["sign"] < 0, "k1"].to_numpy("i8")
            n = int(old["n"].sum())
            if len(old):
                made = CuckooFilter.from_bytes(old["cells"].iloc[0], old["stash"].iloc[0])
            else:
                made = CuckooFilter.sized(2 * len(plus))
            made.remove(minus)
            made.add(plus)
            n += len(plus) - len(minus)
            return pd.DataFrame([(key[0], *made.to_bytes(), n)], columns=["shard", "cells", "stash", "n"])

        both = sharded.groupBy("shard").cogroup(self.filters.groupBy("shard"))
        filters = materialise(both.applyInPandas(update, _FILTERS), "filters")
        full = filters.where((F.length("stash") > 1024) | (F.col("n") > 2 * self.keys_per_shard))
        if not full.isEmpty():
            return self._with_filters(counts)
        return replace(self, counts=counts, filters=filters)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """With these documents. A document must be deleted before it comes again."""
        new = materialise(line_keys(texts(docs, doc_id, text), self.min_chars), "references")
        if self.counts is None:
            counts = materialise(self._counted(new), "counts")
            return replace(self, references=new)._with_filters(counts)
        both = self.counts.unionByName(self._counted(new)).groupBy(*_KEY)
        counts = materialise(
            both.agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")), "counts"
        )
        added = self._frequent(counts).join(self._frequent(self.counts), _KEY, "left_anti")
        index = replace(self, references=self.references.unionByName(new))
        return index._changed(counts, added, self._frequent(self.counts).limit(0))

    def delete(self, doc_ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """Without the documents of these ids; ids that the index does not hold change nothing."""
        gone = doc_ids.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
        references = materialise(self.references.join(gone, "doc_id", "left_anti"), "references")
        touched = self.references.join(gone, "doc_id", "left_semi").select(*_KEY).distinct()
        recounted = self._counted(references.join(touched, _KEY, "left_semi"))
        counts = materialise(
            self.counts.join(touched, _KEY, "left_anti").unionByName(recounted), "counts"
        )
        removed = self._frequent(self.counts).join(self._frequent(counts), _KEY, "left_anti")
        index = replace(self, references=references)
        return index._changed(counts, self._frequent(counts).limit(0), removed)

    def _sent_filters(self):
        """The filters for all tasks, or none if they are larger than the bound."""
        size = self.filters.agg(F.sum(F.length("cells") + F.length("stash"))).first()[0] or 0
        if size > self.filter_bytes:
            return None
        own = {
            r["shard"]: CuckooFilter.from_bytes(bytes(r["cells"]), bytes(r["stash"]))
            for r in self.filters.collect()
        }
        return self.spark.sparkContext.broadcast({"number": self.shards, "filters": own})

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """
        `docs` with the text that stays, and how many lines each had and lost as `__n_lines` and
        `__n_dropped`. A frequent key's lines stay only in the largest doc_id that holds it;
        all of them do there. Other columns pass through. A null text comes back empty.
        """
        least = self.min_chars
        maybe = line_keys(texts(docs, doc_id, text), least, self._sent_filters())
        lost = (
            maybe.join(self._frequent(self.counts), _KEY)
            .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
            .groupBy("doc_id").agg(F.collect_set(F.struct(*_KEY)).alias("__lost"))
            .select(F.col("doc_id").alias("__doc"), "__lost")
        )
        joined = docs.join(lost, F.col(doc_id).cast("long").eqNullSafe(F.col("__doc")), "left").select(
            *[docs[c] for c in docs.columns], "__lost"
        )
        schema = T.StructType(
            [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema]
            + [T.StructField("__n_lines", T.LongType()), T.StructField("__n_dropped", T.LongType())]
        )

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, n_lines, n_lost = [], [], []
            for t, lost in zip(batch.column(text), batch.column("__lost"), strict=True):
                lines = (t.as_py() or "").encode().split(b"\n")
                left = lines
                if lost.is_valid:
                    gone = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in lost.as_py()}
                    left = [line for line in lines if _key(line, least) not in gone]
                kept.append(b"\n".join(left).decode())
                n_lines.append(len(lines))
                n_lost.append(len(lines) - len(left))
            place = batch.schema.get_field_index(text)
            out = batch.remove_column(batch.schema.get_field_index("__lost"))
            out = out.set_column(place, text, pc.cast(pa.array(kept, pa.string()), pa.string()))
            return out.append_column("__n_lines", pa.array(n_lines, pa.int64())).append_column(
                "__n_dropped", pa.array(n_lost, pa.int64())
            )

        return per_batch(joined, work, schema)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """An index of these documents, applied to themselves; see `LineIndex`."""
    return LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs).apply(docs)
