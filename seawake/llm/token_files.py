"""Token files: ids in the fewest bits that a vocabulary needs, with block offsets.

A file holds, in this order, blocks of ``BLOCK`` ids packed little-endian and padded to whole
bytes; the doc_id and the first id of each document; the byte offset of each block; and
a footer of fixed size. Any range of ids is read from its blocks alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seawake.llm import tokens
from seawake.llm.common import batch, map_arrow, slices, tidy_shuffles
from seawake.session import stored, work_path

BLOCK = 8192
FOOTER = "<QQQQII8s"  # ids, documents, where the documents and the offsets begin, bits, ids per block, mark
MARK = b"IDBLOCK1"
NO_DOC = -(2**63)
BLOCKS_AT_ONCE = 128
MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, lowest first, padded with zeros to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    table = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(table.astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits)
    return flat.reshape(n, bits) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _open(uri: str):
    fs, path = pa.fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    return fs, path


class Writer:
    """Writes one file; ids come document by document."""

    def __init__(self, uri: str, bits: int) -> None:
        fs, path = _open(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.bits = fs.open_output_stream(path), bits
        self.held, self.n_held, self.n_ids, self.at = [], 0, 0, 0
        self.docs, self.starts, self.offsets = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_DOC if doc_id is None else doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK * BLOCKS_AT_ONCE:
            self._flush(False)

    def _flush(self, end: bool) -> None:
        every = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(every) if end else len(every) // BLOCK * BLOCK
        for lo in range(0, whole, BLOCK):
            data = pack_bits(every[lo : min(lo + BLOCK, whole)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held = [every[whole:]]
        self.n_held = len(every) - whole

    def close(self) -> None:
        self._flush(True)
        docs_at = self.at
        self.out.write(np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        offsets_at = docs_at + 16 * len(self.docs)
        self.out.write(struct.pack(FOOTER, self.n_ids, len(self.docs), docs_at, offsets_at, self.bits, BLOCK, MARK))
        self.out.close()


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        footer = self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER))
        self.n_ids, self.n_docs, docs_at, offsets_at, self.bits, self.block, mark = struct.unpack(FOOTER, footer)
        if mark != MARK:
            raise ValueError(f"not a token file: {uri}")
        table = self.file.read_at(16 * self.n_docs, docs_at)
        self.docs = np.frombuffer(table, "<i8", self.n_docs)
        self.starts = np.append(np.frombuffer(table, "<u8", self.n_docs, 8 * self.n_docs).astype(np.int64), self.n_ids)
        self.offsets = np.frombuffer(self.file.read_at(size - struct.calcsize(FOOTER) - offsets_at, offsets_at), "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``, read from their blocks."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        lo, hi = start // self.block, -(-stop // self.block)
        data = self.file.read_at(int(self.offsets[hi] - self.offsets[lo]), int(self.offsets[lo]))
        first = int(self.offsets[lo])
        parts = [
            unpack_bits(data[self.offsets[k] - first : self.offsets[k + 1] - first], self.bits, min(self.block, self.n_ids - k * self.block))
            for k in range(lo, hi)
        ]
        return np.concatenate(parts)[start - lo * self.block : stop - lo * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Writes the ids of all texts, ``end_id`` after each, in ascending order of doc_id below
    ``folder``, which all executors share; returns the table of files (part, path, n_docs, n_ids).

    A task that runs again writes a file of another name; the table has the files of the
    attempts that counted, and only those are read.
    """
    bits = bits_for(vocabulary)

    def write(batches):
        context = TaskContext.get()
        part, path, writer = context.partitionId(), f"{folder.rstrip('/')}/part-{context.partitionId():06d}-{context.taskAttemptId()}.tok", None
        for b, texts in slices(batches):
            writer = writer or Writer(path, bits)
            for doc_id, ids in zip(b.column(0).to_pylist(), tokens.encode(texts, tokenizer), strict=True):
                writer.add(doc_id, np.append(np.frombuffer(ids, np.uint32), np.uint32(end_id)))
        if writer:
            writer.close()
            yield batch(MANIFEST, [part], [path], [len(writer.docs)], [writer.n_ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    with tidy_shuffles(docs.sparkSession):
        return stored(map_arrow(ordered, write, MANIFEST), "token-files")


def _digests(reader: Reader, base: int) -> Iterator[pa.RecordBatch]:
    """Per document its place and the checksum of its ids, read a run of blocks at a time."""
    step, crcs, crc, k = reader.block * BLOCKS_AT_ONCE, [], 0, 0
    for lo in range(0, reader.n_ids, step):
        hi = min(lo + step, reader.n_ids)
        data, at = memoryview(reader.ids(lo, hi).tobytes()), lo
        while at < hi:
            end = min(hi, int(reader.starts[k + 1]))
            crc = zlib.crc32(data[4 * (at - lo) : 4 * (end - lo)], crc)
            at = end
            if end == reader.starts[k + 1]:
                crcs.append(crc)
                crc, k = 0, k + 1
    ids = [None if d == NO_DOC else d for d in reader.docs.tolist()]
    if ids:
        yield batch(DOCS, ids, base + reader.starts[:-1], np.diff(reader.starts), crcs)


def read_token_files(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all documents, from the files of the table;
    ``start`` counts the ids of all documents before, over all files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                yield from _digests(reader, base)
                reader.close()

    spread = placed.select("path", "base").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return map_arrow(spread, read, DOCS)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, folder: str | None = None) -> DataFrame:
    """Writes token files and reads back ``(doc_id, start, n_tokens, ids_crc32)`` per row of
    ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has the one id ``end_id``. Rows without doc_id come first;
    repeated rows follow one another. An empty table gives no files and no rows.
    """
    folder = folder or work_path(docs.sparkSession, "ids")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id, vocabulary))
