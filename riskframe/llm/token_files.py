"""Token files in the Arrow IPC file format with fixed-size-list batches.

Documents are range-partitioned by id; every task encodes its run of documents
in ascending order and writes two files to a shared folder: ``seq-N.arrow``,
record batches of ``ids`` (fixed-size lists of ``length`` tokens, as wide as the
vocabulary needs) and ``mask`` (fixed-size lists of booleans; false pads the
last sequence), and ``doc-N.arrow`` with doc_id and n_tokens per document. A
token's place in the stream gives its batch, row and column by division, so a
memory-mapped file gives any sequence without copying. A manifest row per file
pair, written with the job's output, names the files of the attempt that
counts; files of lost attempts are never read.

Defined cases: a null or empty text is the end id alone; rows with a null id come
first; rows with the same id are ordered by a hash of the text and kept; an
empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import byte_slices, scratch_path, text_or_empty, written
from riskframe.llm.tokens import encoder

ROWS_A_BATCH = 128


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a Hadoop-style path and the path inside it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class _SequenceWriter:
    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        kind = pa.from_numpy_dtype(dtype.newbyteorder("="))
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = ipc.new_file(sink, self.schema)
        self.left: list[np.ndarray] = []
        self.held = self.tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.left.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        step = ROWS_A_BATCH * self.length
        if self.held >= step:
            flat = np.concatenate(self.left)
            whole = len(flat) // step * step
            for k in range(0, whole, step):
                self._write(flat[k:k + step], step)
            self.left, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, valid: int) -> None:
        mask = np.arange(len(flat)) < valid
        self.out.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.left, np.empty(0, self.dtype)])
        if len(flat):
            pad = -len(flat) % self.length
            self._write(np.concatenate([flat, np.zeros(pad, self.dtype)]), len(flat))
        self.out.close()


def write_token_files(df: DataFrame, tokenizer: str, folder: str | None = None, length: int = 2048, end_id: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns the manifest: part, seq_path, doc_path, n_docs,
    n_tokens, part ascending with the ids."""
    folder = folder or scratch_path(df.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        at = TaskContext.get()
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name = f"{at.partitionId():06d}-{at.taskAttemptId()}.arrow"
        end, n_docs, seq, doc = np.array([end_id], enc.dtype), 0, None, None
        for batch in batches:
            for part in byte_slices(batch, 1):
                if seq is None:
                    seq_sink = store.open_output_stream(f"{root}/seq-{name}")
                    doc_sink = store.open_output_stream(f"{root}/doc-{name}")
                    seq = _SequenceWriter(seq_sink, length, enc.dtype)
                    doc = ipc.new_file(doc_sink, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))
                sizes = []
                for ids in enc.encode_many(part.column(1).to_pylist()):
                    seq.add(np.concatenate([ids, end]))
                    sizes.append(len(ids) + 1)
                doc.write_batch(pa.record_batch([part.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"]))
                n_docs += len(sizes)
        if seq is not None:
            for w, sink in ((seq, seq_sink), (doc, doc_sink)):
                w.close()
                sink.close()
            yield pa.record_batch([[at.partitionId()], [f"{folder}/seq-{name}"], [f"{folder}/doc-{name}"], [n_docs],
                                   [seq.tokens]], ["part", "seq_path", "doc_path", "n_docs", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # the text's hash and the input partition spread the rows of one repeated id
    keys = [F.col("doc_id"), F.xxhash64("text"), F.spark_partition_id()]
    ordered = (rows.select("doc_id", "text", keys[1].alias("h"), keys[2].alias("p"))
               .repartitionByRange("doc_id", "h", "p").sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    return written(ordered.mapInArrow(
        write, "part long, seq_path string, doc_path string, n_docs long, n_tokens long"), "manifest")


def open_file(uri: str) -> ipc.RecordBatchFileReader:
    """A local file is memory-mapped, another is read through its store."""
    store, path = filesystem(uri)
    return ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


class TokenFile:
    """Random access to the token stream of one sequence file."""

    def __init__(self, uri: str):
        self.reader = open_file(uri)
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.flat = -1, np.empty(0)

    def valid(self) -> int:
        return sum(int(np.count_nonzero(self.reader.get_batch(k).column("mask").values.to_numpy(zero_copy_only=False)))
                   for k in range(self.reader.num_record_batches))

    def batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.reader.get_batch(k).column("ids").values.to_numpy()
        return self.flat

    def runs(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n tokens from ``start`` on, as views into the batches."""
        step = ROWS_A_BATCH * self.length
        while n:
            k, at = divmod(start, step)
            run = self.batch(k)[at:at + n]
            yield run
            start, n = start + len(run), n - len(run)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents as the files hold them: doc_id, start (tokens of all documents
    before), n_tokens, ids_crc32. One row per file is summed in order (the
    manifest is as long as the number of files); the files are read by tasks."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, docs, at = TokenFile(row["seq_path"]), open_file(row["doc_path"]), 0
                if tokens.valid() != row["n_tokens"]:
                    raise ValueError(f"{row['seq_path']} does not hold the tokens of its manifest row")
                for k in range(docs.num_record_batches):
                    part = docs.get_batch(k)
                    starts, crcs = [], []
                    for n in part.column("n_tokens").to_pylist():
                        crc = 0
                        for run in tokens.runs(at, n):
                            crc = zlib.crc32(run.astype("<u4"), crc)
                        starts.append(row["first"] + at)
                        crcs.append(crc)
                        at += n
                    yield pa.record_batch([part.column("doc_id"), pa.array(starts, pa.int64()),
                                           part.column("n_tokens"), pa.array(crcs, pa.int64())],
                                          ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (files.select("seq_path", "doc_path", "n_tokens", "first").repartition(max(1, manifest.count()), "seq_path")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))
