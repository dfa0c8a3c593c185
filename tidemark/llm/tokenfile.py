"""Token-id files with fixed-width bit packing.

A file holds whole documents in ascending order of doc_id. Every id takes the fewest bits that the
vocabulary needs, most significant bit first, in blocks of ``BLOCK`` ids that begin at a byte. The layout,
with little-endian integers:

    header   magic 'TMIDS1\\0\\0', bits u32, block u32, documents u64, ids u64
    blocks   the packed ids
    offsets  u64 for each block, from the start of the file
    index    doc_id i64 and number of ids u64 for each document
    trailer  u64 place of the offsets, u64 number of blocks

Any run of ids can be read with one seek, and numpy unpacks a block at a time.

Defined results: a null or empty text is a document with the end id alone; rows that share a doc_id stay
separate documents in a fixed order; rows without a doc_id come first, with doc_id -2^63
in the file and null in the result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_folder, open_fs, slices, texts_of, vocabulary, written
from .tokens import encoder, with_end

MAGIC, HEAD, TAIL, BLOCK = b"TMIDS1\0\0", struct.Struct("<8sIIQQ"), struct.Struct("<QQ"), 1 << 16
NO_ID = -(1 << 63)


def width(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits((ids.astype(np.uint32)[:, None] >> shifts & 1).astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, bits: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` ids behind the first ``skip`` ones."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n, skip * bits // 8).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=(skip + n) * bits)[skip * bits :].reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class Writer:
    """Streams documents into a file; memory holds one block and the index."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        if bits * block % 8:
            raise ValueError("a block must end at a whole byte")
        self.out, self.bits, self.block = stream, bits, block
        self.rest = np.zeros(0, "<u4")
        self.offsets, self.index, self.docs, self.at, self.total = [], [], 0, HEAD.size, 0
        self.out.write(bytes(HEAD.size))

    def add(self, doc_ids: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and all their ids one after the other."""
        self.index.append(np.stack([np.array(doc_ids, "<i8"), sizes.astype("<i8")], axis=1))
        self.docs += len(doc_ids)
        self.total += len(ids)
        rest = np.concatenate([self.rest, ids])
        full = len(rest) // self.block * self.block
        for i in range(0, full, self.block):
            self._put(rest[i : i + self.block])
        self.rest = rest[full:].copy()

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> bytes:
        """Writes the tables and returns the header, which belongs at the start."""
        if len(self.rest):
            self._put(self.rest)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        for part in self.index:
            self.out.write(part.tobytes())
        self.out.write(TAIL.pack(self.at, len(self.offsets)))
        return HEAD.pack(MAGIC, self.bits, self.block, self.docs, self.total)


class Reader:
    """Reads a file by block; ``stream`` is any seekable binary file."""

    def __init__(self, stream):
        self.f = stream
        self.f.seek(0)
        magic, self.bits, self.block, n_docs, self.total = HEAD.unpack(self.f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.f.seek(-TAIL.size, 2)
        at, n_blocks = TAIL.unpack(self.f.read(TAIL.size))
        self.f.seek(at)
        self.offsets = np.frombuffer(self.f.read(8 * n_blocks), "<u8")
        self.end = at
        self.index = np.frombuffer(self.f.read(16 * n_docs), "<i8").reshape(-1, 2)
        self.starts = np.concatenate([[0], np.cumsum(self.index[:, 1])])

    def ids(self, start: int, n: int) -> np.ndarray:
        """Any ``n`` ids from ``start`` on."""
        parts = []
        while n > 0:
            b, skip = divmod(start, self.block)
            take = min(n, self.block - skip)
            self.f.seek(int(self.offsets[b]))
            stop = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.end
            parts.append(unpack(self.f.read(stop - int(self.offsets[b])), self.bits, take, skip))
            start, n = start + take, n - take
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, k: int) -> tuple[int, np.ndarray]:
        return int(self.index[k, 0]), self.ids(int(self.starts[k]), int(self.index[k, 1]))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start in the file, ids), block by block."""
        buffer, base, b = np.zeros(0, "<u4"), 0, 0
        for (doc_id, n), start in zip(self.index.tolist(), self.starts.tolist(), strict=False):
            while base + len(buffer) < start + n:
                more = self.ids(b * self.block, min(self.block, self.total - b * self.block))
                buffer, base, b = np.concatenate([buffer[start - base :], more]), start, b + 1
            yield doc_id, start, buffer[start - base : start - base + n]


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes the texts in ascending doc_id order, one file a partition, and returns the manifest
    (part, file, n_docs, n_ids), itself kept as a table beside the files.

    Rows are dealt by range of doc_id, and by a hash of the text where many share one. A task that runs
    twice writes two files; the manifest has the one of the attempt that counted.
    """
    spark = docs.sparkSession
    path = path or vocabulary("byte_bpe_50k.json")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, store, out, enc = TaskContext.get().partitionId(), None, None, encoder(path)
        for b in slices(batches, "text"):
            if out is None:
                fs, at = open_fs(folder)
                fs.create_dir(at, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                store = fs.open_output_stream(f"{at}/{name}.body")
                out = Writer(store, width(enc.tokenizer.get_vocab_size()))
            ids, sizes = with_end(*enc.encode(b.column("text")), end_id)
            out.add([NO_ID if i is None else i for i in b.column("doc_id").to_pylist()], sizes, ids)
        if out is not None:
            head = out.close()
            store.close()
            _finish(fs, f"{at}/{name}", head)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([out.docs], pa.int64()), pa.array([out.total], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    rows = texts_of(docs, id_col, text_col)
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return written(dealt.mapInArrow(run, "part long, file string, n_docs long, n_ids long"), "token-manifest")


def _finish(fs, at: str, head: bytes) -> None:
    """Puts the header in place: in situ on a local disk, else by copying the body behind it."""
    from pyarrow.fs import LocalFileSystem

    if isinstance(fs, LocalFileSystem):
        with open(f"{at}.body", "r+b") as f:
            f.write(head)
        fs.move(f"{at}.body", at)
        return
    with fs.open_input_stream(f"{at}.body") as f, fs.open_output_stream(at) as g:
        f.read(len(head))
        g.write(head)
        while data := f.read(8 << 20):
            g.write(data)
    fs.delete_file(f"{at}.body")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from the files.

    Only the manifest, one row a file, is summed up over all files. The files are dealt over as many tasks
    as there are files, a number that adaptive execution leaves alone.
    """
    from pyspark.sql.window import Window

    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                fs, at = open_fs(file)
                rows: list[tuple] = []
                with fs.open_input_file(at) as f:
                    for doc_id, start, ids in Reader(f).documents():
                        rows.append((None if doc_id == NO_ID else doc_id, base + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    spread = based.repartition(max(1, manifest.count()), "file")
    return spread.select("file", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' files to the shared folder and reads them back."""
    return read_files(write_files(docs, new_folder(docs.sparkSession, "token-files"), path, end_id, id_col, text_col))
