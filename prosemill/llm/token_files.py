"""Token ids as Arrow stream files of equal-length sequences.

Each file holds consecutive documents in ascending id order.  Its record
batches carry two fixed-size lists, ``ids`` and ``mask``, of ``length``
elements a row, so sequence *i* lies at a computed place: a reader fetches the
one batch that holds it, from a local file through a memory map without a copy.
A second stream beside it gives each document's place.  Only the last row of a
file is padded (mask false).  The number of files follows from the bytes of the
texts (``FILE_BYTES`` each), whatever the session's settings are.

Defined results: a null text is an empty one and has the end id alone; a null
document id sorts first; repeated rows are each written; rows of one id (or of
none) are ordered by a hash of their texts and may fill any number of files; an empty table gives no file; other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, stage
from .tokens import encoder, vocabulary_path

#: Sequences of one record batch.
BATCH_ROWS = 128
#: Documents encoded at once.
DOCS_AT_ONCE = 1_000
#: Bytes of text of a file.
FILE_BYTES = 24 << 20

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(vocab_size: int, length: int) -> pa.Schema:
    """Ids take two bytes where the vocabulary allows it."""
    kind = pa.uint16() if vocab_size <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a run of ids into rows of ``length`` and writes whole record batches."""

    def __init__(self, sink, schema: pa.Schema, length: int):
        self._length, self._schema = length, schema
        self._dtype = schema.field("ids").type.value_type.to_pandas_dtype()
        self._out = pa.ipc.new_stream(sink, schema)
        self._held: list[np.ndarray] = []
        self._n = 0

    def add(self, ids: np.ndarray) -> None:
        self._held.append(ids.astype(self._dtype))
        self._n += len(ids)
        if self._n >= BATCH_ROWS * self._length:
            self._flush(self._n // (BATCH_ROWS * self._length) * BATCH_ROWS)

    def _flush(self, rows: int) -> None:
        flat = np.concatenate(self._held) if self._held else np.empty(0, self._dtype)
        n = rows * self._length
        full, rest = flat[:n], flat[n:]
        mask = np.ones(n, bool)
        if len(full) < n:
            mask[len(full) :] = False
            full = np.concatenate([full, np.zeros(n - len(full), self._dtype)])
        step = BATCH_ROWS * self._length
        for i in range(0, n, step):
            lists = [
                pa.FixedSizeListArray.from_arrays(pa.array(x[i : i + step]), self._length) for x in (full, mask)
            ]
            self._out.write_batch(pa.record_batch(lists, schema=self._schema))
        self._held, self._n = [rest], len(rest)

    def close(self) -> None:
        if self._n:
            self._flush(-(-self._n // self._length))
        self._out.close()


class SequenceReader:
    """Random access to a file of sequences; local files are memory-mapped, of others one batch at a time is fetched."""

    def __init__(self, uri: str):
        self._file = open_file(uri)
        self._schema = pa.ipc.read_schema(pa.ipc.read_message(self._file))
        self._first = self._file.tell()
        self.length = self._schema.field("ids").type.list_size
        self._held = (-1, None, None)
        # All batches but the last have one size, so the first one's tells where each begins.
        self._batch(0)
        self._step = self._file.tell() - self._first

    def _batch(self, i: int) -> tuple[np.ndarray, pa.RecordBatch]:
        if self._held[0] != i:
            self._file.seek(self._first + i * (self._step if i else 0))
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(self._file), self._schema)
            self._held = (i, batch.column(0).flatten().to_numpy(zero_copy_only=True), batch)
        return self._held[1:]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``, neither of them copied."""
        number, row = divmod(i, BATCH_ROWS)
        view, batch = self._batch(number)
        return view[row * self.length : (row + 1) * self.length], batch.column(1)[row].values

    def run(self, start: int, n: int) -> np.ndarray:
        """The ``n`` ids from ``start`` on, across rows and batches."""
        step = BATCH_ROWS * self.length
        parts = []
        while n > 0:
            number, at = divmod(start, step)
            part = self._batch(number)[0][at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def open_file(uri: str) -> pa.NativeFile:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)


@dataclass
class TokenFiles:
    """Files in ascending order, with the ids that stand before each."""

    path: str
    parts: DataFrame  # part, docs, tokens, base

    def documents(self) -> DataFrame:
        """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files."""
        folder = self.path

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for part, base in zip(frame["part"], frame["base"], strict=True):
                    ids = SequenceReader(f"{folder}/part-{part:06d}.arrows")
                    for batch in pa.ipc.open_stream(open_file(f"{folder}/part-{part:06d}.index.arrows")):
                        starts, counts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                        crcs = [
                            zlib.crc32(ids.run(s, n).astype("<u4").tobytes())
                            for s, n in zip(starts, counts, strict=True)
                        ]
                        yield pd.DataFrame(
                            {
                                "doc_id": pd.array(batch.column(0).to_pylist(), dtype="Int64"),
                                "start": np.array(starts, np.int64) + base,
                                "n_tokens": np.array(counts, np.int64),
                                "ids_crc32": np.array(crcs, np.int64),
                            }
                        )

        n = max(1, self.parts.count())
        return self.parts.repartition(n, "part").mapInPandas(
            read, "doc_id long, start long, n_tokens long, ids_crc32 long"
        )


def write_token_files(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
    length: int = 2048,
    file_bytes: int = FILE_BYTES,
    path: str | None = None,
) -> TokenFiles:
    """Encode every whole text, end each with ``end_id`` and write the files.

    One range shuffle puts the documents in order; each task then streams its
    range into one pair of files, which a rename makes visible, so a task that
    runs again replaces them with equal ones.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    folder = path or fresh_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode = encoder(vocabulary)
        fs, where = pa.fs.FileSystem.from_uri(folder)
        trial = f"{where}/_attempt-{task.taskAttemptId()}"
        name = f"part-{task.partitionId():06d}"
        writer = None
        place = n_docs = 0
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(i, DOCS_AT_ONCE)
                if writer is None:
                    fs.create_dir(trial)
                    sink = fs.open_output_stream(f"{trial}/{name}.arrows")
                    index_sink = fs.open_output_stream(f"{trial}/{name}.index.arrows")
                    writer = SequenceWriter(sink, sequence_schema(encode.vocab_size, length), length)
                    index = pa.ipc.new_stream(index_sink, INDEX)
                end = np.array([end_id], "<u4").tobytes()
                got = [x + end for x in encode.encode(some.column(1).to_pylist())]
                counts = np.array([len(x) // 4 for x in got], np.int64)
                starts = place + np.cumsum(counts) - counts
                writer.add(np.frombuffer(b"".join(got), "<u4"))
                index.write_batch(pa.record_batch([some.column(0), pa.array(starts), pa.array(counts)], schema=INDEX))
                place += int(counts.sum())
                n_docs += some.num_rows
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            for end in ("arrows", "index.arrows"):
                fs.move(f"{trial}/{name}.{end}", f"{where}/{name}.{end}")
            fs.delete_dir(trial)
            yield pa.record_batch(
                [pa.array([task.partitionId()], pa.int64()), pa.array([n_docs]), pa.array([place])],
                names=["part", "docs", "tokens"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows of one id are spread by their texts, and equal rows by the input's partitions.
    texts = texts.withColumns({"hash": F.xxhash64("text"), "origin": F.spark_partition_id()})
    ordered = texts.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "hash", "origin")
    ordered = ordered.sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    parts = stage(ordered.mapInArrow(write, "part long, docs long, tokens long"), "token-parts")
    # A row a file.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return TokenFiles(folder, parts.withColumn("base", F.coalesce(before, F.lit(0))))
