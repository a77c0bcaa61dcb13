"""
Token files: flat unsigned integers in document order, with 64-bit document offsets.

A table of documents becomes parts by ranges of doc_id. Each part is three flat little-endian
files: `.bin` (ids, 2 or 4 bytes each), `.idx` (unsigned 64-bit place of each document in the
part, and the end) and `.doc` (signed 64-bit doc_id). The manifest, a small Parquet table
with one row per part, holds the base of each part: the ids in all parts before it, by a
prefix sum. A document's global place is its part's base plus its offset.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmere.llm.common import texts
from gridmere.llm.encoder import encoder
from gridmere.session import new_path, shared_folder

#: Stands for a null doc_id in `.doc` files.
NO_ID = -(1 << 63)
_MANIFEST = "part int, name string, n_docs long, n_tokens long, width int"


def write_token_files(
    docs: DataFrame, vocabulary: str, end_id: int | None, folder: str | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> str:
    """
    Writes the ids of every whole text, each followed by `end_id`, in ascending doc_id order
    and returns the folder.

    Null texts count as empty. A null doc_id comes first and is read back as null. Rows with
    equal doc_id follow each other by text; equal rows are all written. An empty table gives
    a manifest without rows. Other columns are ignored.

    Each attempt of a task writes files of its own and the manifest names those of the
    attempt that succeeded, so that retried or doubled tasks leave nothing but unused files.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    files = f"{folder}/files"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, fs, root = f"part-{part:06d}-{uuid.uuid4().hex}", *pafs.FileSystem.from_uri(files)
        code, total, out = encoder(vocabulary), 0, None
        end = b"" if end_id is None else np.asarray([end_id], code.kind).tobytes()
        places, ids = [np.zeros(1, "<u8")], []
        for batch in batches:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.bin")
            lengths = np.empty(batch.num_rows, "<u8")
            for i, made in enumerate(code.encode_all(t.as_py() for t in batch.column("text"))):
                lengths[i] = (len(made) + len(end)) // code.width
                out.write(made + end)
            places.append(total + np.cumsum(lengths, dtype="<u8"))
            total = int(places[-1][-1])
            ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        for end_name, arrays, kind in (("idx", places, "<u8"), ("doc", ids, "<i8")):
            with fs.open_output_stream(f"{root}/{name}.{end_name}") as f:
                f.write(np.concatenate(arrays).astype(kind).tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "name": [name],
            "n_docs": pa.array([sum(map(len, ids))], pa.int64()),
            "n_tokens": pa.array([total], pa.int64()), "width": pa.array([code.width], pa.int32()),
        })

    parts = (
        texts(docs, doc_id, text)
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, _MANIFEST)
    )
    parts.write.parquet(f"{folder}/parts")
    written = spark.read.parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(
        f"{folder}/manifest"
    )
    return folder


def _open(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The flat file as an array: mapped if the store is a file system, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """
    One row per document of the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked
    for, the ids.
    """
    files = f"{folder}/files"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(files)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row['name']}"
                docs = _open(fs, f"{path}.doc", "<i8")
                places = _open(fs, f"{path}.idx", "<u8").astype("i8")
                ids = _open(fs, f"{path}.bin", f"<u{row['width']}") if row["n_tokens"] else np.zeros(0, "<u4")
                for at in range(0, len(docs), 4096):
                    some = docs[at : at + 4096]
                    cut = places[at : at + 4097]
                    own = [ids[a:b].astype("<u4") for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    made = {
                        "doc_id": pa.array(np.asarray(some), pa.int64(), mask=some == NO_ID),
                        "start": pa.array(row["base"] + cut[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(cut), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    }
                    if with_ids:
                        made["ids"] = pa.array([x.tolist() for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(made)

    manifest = spark.read.parquet(f"{folder}/manifest")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def token_rows(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes the files below the shared folder and reads every document back."""
    shared_folder(docs.sparkSession)
    return read_token_files(docs.sparkSession, write_token_files(docs, vocabulary, end_id))
