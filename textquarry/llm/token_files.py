"""Token-id files (operator 9): independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds the ids of a range of documents, in ascending doc_id, as little-endian unsigned 32-bit integers. Its parts:

* data frames: each a zstandard frame of its own of about ``FRAME_IDS`` ids, cut at a document's end where one is near;
* an index, in a skippable frame: doc_id and number of ids of each document;
* the seek table, in the skippable frame that the seekable zstandard format defines: compressed size, size and the low
  32 bits of XXH64 of each data frame, then the number of frames, a descriptor and a magic number at the very end.

Any zstandard decoder reads the data frames as one stream and skips the rest. ``Reader`` decompresses only the frames
that hold the requested documents, and checks each against the table.

A task writes under a name with its attempt; only names that a finished task reports are read, so a retried or
repeated task leaves no half file behind in the result. What tasks report is a table in the shared folder.

Cases: a null or empty text is the end id alone; a null doc_id comes first; rows with the same doc_id follow each other
by text; an empty table writes no file. A text of any length is one row of work, but many frames. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm import arrays as A
from textquarry.llm import bpe
from textquarry.llm.common import fresh_path, parts, pieces_for, table, tidy, written

END_ID = 0
FRAME_IDS = 1 << 16
LEVEL = 3
#: Bytes of text in work at a time, and files whose running total one task takes.
SLICE_BYTES, SPAN = 1 << 20, 4096
#: Fixed values of the format: magic numbers of skippable frames (index, seek table) and of the table's end, and its descriptor (checksums present).
INDEX_MAGIC, SEEK_MAGIC, END_MAGIC, DESCRIPTOR = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


class Writer:
    """Writes one file from documents in order."""

    def __init__(self, sink):
        self.sink, self.held, self.n_held, self.frames = sink, [], 0, []
        self.doc_ids: list = []
        self.counts: list[int] = []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        for at in range(0, len(ids), FRAME_IDS):
            piece = ids[at : at + FRAME_IDS]
            if self.n_held and self.n_held + len(piece) > FRAME_IDS:
                self._frame()
            self.held.append(piece.astype("<u4").tobytes())
            self.n_held += len(piece)

    def _frame(self) -> None:
        data = b"".join(self.held)
        packed = self.compressor.compress(data)
        self.sink.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64(data).intdigest() & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.n_held:
            self._frame()
        index = io.BytesIO()
        rows = pa.table({"doc_id": pa.array(self.doc_ids, pa.int64()), "n": pa.array(self.counts, pa.int64())})
        with pa.ipc.new_stream(index, rows.schema) as stream:
            stream.write_table(rows)
        packed = self.compressor.compress(index.getvalue())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        entries = b"".join(struct.pack("<III", *x) for x in self.frames)
        # The index frame precedes the table; its place follows from the sizes of the data frames.
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), DESCRIPTOR, END_MAGIC))
        self.sink.close()


class Reader:
    """Reads a file through its seek table. ``opened``: frames decompressed so far."""

    def __init__(self, source):
        self.source, self.opened = source, 0
        size = source.size()
        n_frames, descriptor, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != END_MAGIC or descriptor != DESCRIPTOR:
            raise ValueError("no seek table with checksums at the end of the file")
        table_at = size - 9 - 12 * n_frames
        entries = np.frombuffer(self._bytes(table_at, 12 * n_frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.checks = entries[:, :2], entries[:, 2]
        self.at = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        self.first_id = np.concatenate([[0], np.cumsum(self.sizes[:, 1] // 4)])
        magic, length = struct.unpack("<II", self._bytes(int(self.at[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no index of documents before the seek table")
        self.decompressor = zstandard.ZstdDecompressor()
        index = pa.ipc.open_stream(self.decompressor.decompress(self._bytes(int(self.at[-1]) + 8, length))).read_all()
        self.doc_ids, self.counts = index.column("doc_id").combine_chunks(), index.column("n").to_numpy()
        self.doc_at = np.concatenate([[0], np.cumsum(self.counts)])

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        data = self.decompressor.decompress(self._bytes(int(self.at[k]), int(self.sizes[k, 0])), max_output_size=int(self.sizes[k, 1]))
        self.opened += 1
        if xxhash.xxh64(data).intdigest() & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(data, "<u4")

    def _span(self, start: int, stop: int, held: dict[int, np.ndarray]) -> np.ndarray:
        first = int(np.searchsorted(self.first_id, start, side="right")) - 1
        last = int(np.searchsorted(self.first_id, stop, side="left"))
        for k in [k for k in held if k < first]:
            del held[k]
        for k in range(first, last):
            if k not in held:
                held[k] = self.frame(k)
        joined = np.concatenate([held[k] for k in range(first, last)]) if last - first > 1 else held[first]
        return joined[start - self.first_id[first] : stop - self.first_id[first]]

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, number of ids before it in this file, its ids), of the wanted documents or all."""
        held: dict[int, np.ndarray] = {}
        for k, doc_id in enumerate(self.doc_ids.to_pylist()):
            if wanted is None or doc_id in wanted:
                yield doc_id, int(self.doc_at[k]), self._span(int(self.doc_at[k]), int(self.doc_at[k + 1]), held)


def _file_system(path: str):
    return pyarrow.fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def open_file(path: str) -> Reader:
    system, at = _file_system(path)
    return Reader(system.open_input_file(at))


def batch_ids(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, by the byte-level tokenizer at ``path``, with the end id."""
    data, offsets = A.texts(column)
    met = bpe.pieces(path, bpe.BytePieces, bpe.byte_cuts)
    slots, piece_offsets, other = met.look_up(data, offsets)
    odd = (bpe.odd_rows(data, offsets) | other).tolist()
    counts = met.count[slots]
    flat = met.flat[A.ragged(met.start[slots], counts)]
    at = np.concatenate([[0], np.cumsum(counts)])[piece_offsets].tolist()
    for k, whole in enumerate(odd):
        ids = met.tok.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False).ids if whole else flat[at[k] : at[k + 1]]
        yield np.append(ids, END_ID).astype(np.uint32)


def write(docs: DataFrame, folder: str, path: str, n_files: int | None = None) -> DataFrame:
    """Write all documents to files in ``folder``; (part, path, n, before) of each: its ids and those in files before it.

    The list of files is a table of the shared folder and never comes to the driver. Running totals are taken within spans
    of ``SPAN`` files and then over the spans' totals, so no task sees more than that many files or spans.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer, name, total = TaskContext.get(), None, "", 0
        for batch in parts(batches, "text", SLICE_BYTES):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch_ids(batch.column("text"), path), strict=True):
                if writer is None:
                    system, at = _file_system(folder)
                    system.create_dir(at, recursive=True)
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.ids.zst"
                    writer = Writer(system.open_output_stream(f"{at}/{name}", compression=None))
                writer.add(doc_id, ids)
                total += len(ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "path": [f"{folder}/{name}"], "n": [total]})

    n = n_files or pieces_for(docs, "text")
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(run, "part long, path string, n long"), "token-files").withColumn("span", F.floor(F.col("part") / SPAN))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = files.groupBy("span").agg(F.sum("n").alias("n")).select("span", earlier(Window.orderBy("span")).alias("spans_before"))
    listed = files.withColumn("before", earlier(Window.partitionBy("span").orderBy("part"))).join(spans, "span")
    return listed.select("part", "path", "n", (F.col("before") + F.col("spans_before")).alias("before"))


def read(files: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents in files as ``write`` lists them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                rows = [(doc_id, before + at, len(ids), zlib.crc32(ids.tobytes())) for doc_id, at, ids in open_file(path).documents(wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([],) * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A file a task: files are listed in one small table, which is dealt out by their number.
    dealt = files.select("path", "before", "part").repartition(max(1, files.count()), "part")
    return dealt.select("path", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), fresh_path(spark, "token-ids"), bpe.public_path("byte_bpe_50k.json")))
