"""
Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Pieces are dealt evenly to partitions. Each packs its own by best-fit decreasing and
works out a lower bound on its number of sequences from dual-feasible functions. Where count
and bound agree, no other packing of the partition is smaller; it only gives up its least
filled sequence, as all partitions together can still save on their last ones. Where they
differ, it gives up every sequence that is not full. Documents given up are dealt anew to
fewer partitions, which mixes those of different partitions, and packed again.

Only lengths are packed. The ids of the pieces are written once beside them, and joined to
their places afterwards, so that whole sequences are written and read back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmere.llm.common import per_batch, texts
from gridmere.llm.encoder import encoder
from gridmere.session import materialise

_PIECES = "doc_id long, piece int, start long, length long, ids binary"
_SEQUENCE_BITS, _PARTITION_BITS = 28, 24


def token_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """
    The pieces of every document: its ids and `end_id`, cut from the back into pieces of
    `capacity` ids if there are more, so that only the first piece may be shorter. Null texts
    are empty and give one piece with the end id alone. The ids are unsigned, the least byte first, of as
    many bytes as the vocabulary needs (`encoder(vocabulary).width`).
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = encoder(vocabulary)
        end = np.asarray([end_id], code.kind).tobytes()
        made = [ids + end for ids in code.encode_all(t.as_py() for t in batch.column("text"))]
        total = np.array([len(m) // code.width for m in made])
        count = -(-total // capacity)
        first = total - (count - 1) * capacity
        doc = np.repeat(np.arange(len(made)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        length = np.where(piece == 0, first[doc], capacity)
        start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
        edges = np.append(0, np.cumsum(length * code.width))
        if edges[-1] >= 1 << 31:
            raise ValueError("a batch of documents has too many tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        ids = pa.Array.from_buffers(
            pa.binary(), len(doc), [None, pa.py_buffer(edges.astype("i4").tobytes()), pa.py_buffer(b"".join(made))]
        )
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": start,
            "length": length, "ids": ids,
        })

    return per_batch(texts(docs, doc_id, text), cut, _PIECES)


def sequence_bound(counts: np.ndarray, capacity: int) -> int:
    """
    The least number of sequences that any packing of these pieces needs: counts[n] pieces of
    n ids. It is the largest of the bounds by the sum, by the functions that round large pieces
    up to a whole sequence and small ones down to nothing, and by the rounding functions
    u(k) for k up to 50. All sums are of integers.
    """
    size = np.arange(len(counts), dtype="i8")
    weight = counts * size
    best = -(-int(weight.sum()) // capacity)
    whole, mass = np.cumsum(counts), np.cumsum(weight)
    for least in range(1, capacity // 2 + 1):
        top = capacity - least
        sure = int(whole[-1] - whole[min(top, len(counts) - 1)])
        middle = int(mass[min(top, len(counts) - 1)] - mass[least - 1])
        best = max(best, sure - (-middle // capacity))
    for k in range(1, 51):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """
    The sequence and the offset of each piece. Every piece goes, longest first, where the
    least room is left that still holds it; a bit set of the rooms in use finds that place.
    """
    where, offset = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = used >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            seq = open_at[room].pop()
            if not open_at[room]:
                used &= ~(1 << room)
        else:
            room, seq, n = capacity, n, n + 1
        where[i], offset[i] = seq, capacity - room
        if left := room - need:
            open_at[left].append(seq)
            used |= 1 << left
    return where, offset


def _pack_round(pieces: DataFrame, capacity: int, number: int, last: bool) -> DataFrame:
    """Packs each partition on its own and marks what it gives up for the next round."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own).combine_chunks()
        lengths = table.column("length").to_numpy()
        where, offset = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(where, weights=lengths).astype("i8")
        bound = sequence_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        if last:
            loose = np.zeros(len(filled), bool)
        elif len(filled) == bound:
            loose = np.arange(len(filled)) == filled.argmin()
            loose &= filled < capacity
        else:
            loose = filled < capacity
        base = (number << _PARTITION_BITS | TaskContext.get().partitionId()) << _SEQUENCE_BITS
        made = table.append_column("sequence_id", pa.array(where + base, pa.int64()))
        made = made.append_column("offset", pa.array(offset, pa.int64()))
        yield from made.append_column("given_up", pa.array(loose[where])).to_batches(10_000)

    own = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes)
    return pieces.mapInArrow(pack, f"{own}, sequence_id long, offset long, given_up boolean")


def pack_pieces(
    pieces: DataFrame, capacity: int = 2048, rounds: int = 3, pieces_per_task: int = 50_000
) -> DataFrame:
    """
    Every piece with its sequence_id and its offset there (gapless from 0), as few sequences
    as the rounds reach. Repeated rows are packed each; an empty table gives no rows. Rows
    are dealt round by round without a key, so equal or frequent ids cannot crowd one
    partition. A partition holds about `pieces_per_task` pieces, twice as many in each
    round after the first.
    """
    todo = materialise(pieces, "pieces")
    full = F.col("length") == capacity
    done = [
        todo.where(full).select(
            "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    ]
    todo = todo.where(~full)
    for number in range(1, rounds + 1):
        n = todo.count()
        if not n:
            break
        dealt = todo.repartition(-(-n // (pieces_per_task << number - 1)))
        placed = materialise(_pack_round(dealt, capacity, number, number == rounds), "packed")
        done.append(placed.where(~F.col("given_up")).drop("given_up"))
        todo = placed.where("given_up").drop("given_up", "sequence_id", "offset")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packing_report(placed: DataFrame, capacity: int = 2048) -> dict[str, int]:
    """Sequences used, and the lower bound for any packing of the same pieces."""
    counts = np.zeros(capacity + 1, "i8")
    for row in placed.groupBy("length").count().collect():  # at most one row per length
        counts[row["length"]] = row["count"]
    used = placed.agg(F.count_distinct("sequence_id")).first()[0]
    return {"sequences": used, "bound": sequence_bound(counts, capacity)}


def pack_sequences(
    pieces: DataFrame, capacity: int = 2048, rounds: int = 3, pieces_per_task: int = 50_000
) -> DataFrame:
    """
    (sequence_id, ids, pieces): the sequences that `token_pieces` are packed into, each with all
    its ids, and what lies in it as structs (offset, doc_id, piece, start, length) in the order of
    their offsets. Pieces are told apart by a row number that is written out with their ids, so
    repeated rows are in the sequences as often. Whole pieces of `capacity` ids are sequences as they are.
    """
    own = materialise(pieces.withColumn("row", F.monotonically_increasing_id()), "ids", "zstd")
    full = F.col("length") == capacity
    names = ["doc_id", "piece", "start", "length"]
    alone = own.where(full).select(
        (-1 - F.col("row")).alias("sequence_id"), "ids",
        F.array(F.struct(F.lit(0).cast("long").alias("offset"), *names)).alias("pieces"),
    )
    placed = pack_pieces(own.where(~full).select("row", "length"), capacity, rounds, pieces_per_task)
    parts = (
        own.where(~full).join(placed.select("row", "sequence_id", "offset"), "row").groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", *names, "ids"))).alias("parts"))
    )
    shared = parts.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"),
        F.transform("parts", lambda part: F.struct(*[part[c].alias(c) for c in ("offset", *names)])).alias("pieces"),
    )
    return alone.unionByName(shared)


def write_sequences(
    docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, path: str | None = None
) -> DataFrame:
    """
    Tokenizes and packs whole documents and writes the sequences, to `path` or else to a stage
    table; gives what was written. See `token_pieces` and `pack_sequences`.
    """
    made = pack_sequences(token_pieces(docs, vocabulary, end_id, capacity), capacity)
    if path is None:
        return materialise(made, "sequences", "zstd")
    made.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def placed_pieces(sequences: DataFrame, width: int) -> DataFrame:
    """
    The pieces of written sequences, whose ids have `width` bytes, with the checksum of the ids
    that lie at their offsets, as unsigned integers of four bytes.
    """

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces, ids = batch.column("pieces"), batch.column("ids")
        own = dict(zip(("offset", "doc_id", "piece", "start", "length"), pieces.flatten().flatten(), strict=True))
        count = pieces.value_lengths().to_numpy(zero_copy_only=False)
        edges = np.frombuffer(ids.buffers()[1], "i4")[ids.offset : ids.offset + len(ids) + 1].astype("i8")
        wide = np.frombuffer(ids.buffers()[2], f"<u{width}", (edges[-1] - edges[0]) // width, edges[0]).astype("<u4")
        begin = np.repeat((edges[:-1] - edges[0]) // width, count) + own["offset"].to_numpy()
        stop, data = begin + own["length"].to_numpy(), memoryview(wide).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        sequence = np.repeat(batch.column("sequence_id").to_numpy(), count)
        return pa.RecordBatch.from_pydict({
            **{c: own[c] for c in ("doc_id", "piece", "start", "length")}, "ids_crc32": pa.array(crc, pa.int64()),
            "sequence_id": sequence, "offset": own["offset"],
        })

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return per_batch(sequences.select("sequence_id", "ids", "pieces"), read, schema)


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048
) -> DataFrame:
    """The pieces of whole documents, as they lie in the sequences of `write_sequences`."""
    return placed_pieces(write_sequences(docs, vocabulary, end_id, capacity), encoder(vocabulary).width)
