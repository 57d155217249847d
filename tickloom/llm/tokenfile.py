"""Token files: independent zstandard frames, a document index, and a trailing seek table with checksums.

Layout: zstandard frames, each of whole documents; a skippable frame with the index (a checksum; document ids, ids of
each document, documents of each frame); a skippable frame with the seek table. Ids are little-endian unsigned 32-bit.
The seek table follows the public zstandard seekable format (version 0.1.0), so other readers can use it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents_of, records, shared_dir, stored
from tickloom.llm.tokens import encoded_batches

# Fixed values of the zstandard seekable format
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: A frame is closed once it holds this many bytes; a longer document has a frame of its own.
FRAME_BYTES = 1 << 18
END = np.zeros(1, "<u4").tobytes()


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes documents to an open binary file; one frame is in memory at a time, and 12 bytes a document."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.size = self.in_frame = 0
        self.doc_ids, self.lengths, self.docs_of_frame, self.table = [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.pending and self.size + len(ids) > self.frame_bytes:
            self._flush()
        self.pending.append(ids)
        self.size += len(ids)
        self.doc_ids.append(-(1 << 63) if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)

    def _flush(self) -> None:
        data = b"".join(self.pending)
        if len(data) >= 1 << 32:
            raise ValueError("a document of 4 GiB of ids doesn't fit into a frame of the seekable format")
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.table.append((len(frame), len(data), _checksum(data)))
        self.docs_of_frame.append(len(self.pending))
        self.pending, self.size = [], 0

    def close(self) -> None:
        if self.pending:
            self._flush()
        body = struct.pack("<II", len(self.doc_ids), len(self.docs_of_frame)) + b"".join(
            np.array(x, kind).tobytes() for x, kind in ((self.doc_ids, "<i8"), (self.lengths, "<u4"), (self.docs_of_frame, "<u4"))
        )
        body = self.compressor.compress(body)
        body = struct.pack("<I", _checksum(body)) + body
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        self.table.append((len(body) + 8, 0, 0))
        entries = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(entries)) + entries)
        self.out.close()


class Reader:
    """Reads a token file: the tail once, then only the frames that are asked for."""

    def __init__(self, file):
        import zstandard

        self.file, self.decompressor = file, zstandard.ZstdDecompressor()
        size = file.seek(0, 2)
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        file.seek(int(self.begins[n - 1]) + 8)
        body = file.read(int(self.table[n - 1, 0]) - 8)
        if _checksum(body[4:]) != struct.unpack("<I", body[:4])[0]:
            raise ValueError("the index is damaged")
        body = self.decompressor.decompress(body[4:])
        docs, frames = struct.unpack("<II", body[:8])
        self.doc_ids = np.frombuffer(body, "<i8", docs, 8)
        self.lengths = np.frombuffer(body, "<u4", docs, 8 + 8 * docs).astype(np.int64)
        self.first_doc = np.concatenate(([0], np.cumsum(np.frombuffer(body, "<u4", frames, 8 + 12 * docs).astype(np.int64))))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.begins[k]))
        data = self.decompressor.decompress(self.file.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if len(data) != self.table[k, 1] or _checksum(data) != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def document(self, number: int) -> bytes:
        """The ids of one document by its number in the file; decompresses its frame alone."""
        k = int(np.searchsorted(self.first_doc, number, "right")) - 1
        at = 4 * int(self.starts[number] - self.starts[self.first_doc[k]])
        return self.frame(k)[at : at + 4 * int(self.lengths[number])]

    def find(self, doc_id: int) -> list[bytes]:
        """The ids of all documents with this id."""
        lo, hi = np.searchsorted(self.doc_ids, doc_id), np.searchsorted(self.doc_ids, doc_id, "right")
        return [self.document(i) for i in range(lo, hi)]

    def __iter__(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, ids) of all documents in order."""
        for k in range(len(self.first_doc) - 1):
            data, begin = self.frame(k), int(self.starts[self.first_doc[k]])
            for i in range(int(self.first_doc[k]), int(self.first_doc[k + 1])):
                at = 4 * (int(self.starts[i]) - begin)
                doc_id = int(self.doc_ids[i])
                yield None if doc_id == -(1 << 63) else doc_id, int(self.starts[i]), data[at : at + 4 * int(self.lengths[i])]


def open_shared(uri: str, write: bool = False):
    """A file of the shared folder as a binary stream, through the file systems that Arrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if write:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_file(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Writes docs in ascending doc_id order (nulls first) and returns the manifest: part, path, n_docs, n_tokens, start.

    Documents are dealt out by ranges of (doc_id, hash of the text), so a doc_id that many rows share is spread too.
    Each attempt of a task writes a file of a name of its own, and only files of attempts that succeeded are in the
    manifest. start: ids in the files before. Parts without documents have no file.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = documents_of(docs).withColumn("_h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        part, writer, path = TaskContext.get().partitionId(), None, ""
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, ids in encoded_batches(batch, tokenizer_path):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tokens.zst"
                    writer = Writer(open_shared(path, write=True))
                writer.add(doc_ids[i], ids + END)
        if writer is not None:
            writer.close()
            yield records(schema, {"part": [part], "path": [path], "n_docs": [len(writer.lengths)], "n_tokens": [sum(writer.lengths)]})

    manifest = stored(dealt.mapInArrow(write, "part int, path string, n_docs long, n_tokens long"))
    # one row a file; the running sum is over those alone
    return manifest.withColumn("start", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files of the manifest, one task a file."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open_shared(path) as file:
                    rows = [(d, start + s, len(x) // 4, zlib.crc32(x)) for d, s, x in Reader(file)]
                for at in range(0, len(rows), 50_000):
                    yield records(schema, dict(zip(schema.names, zip(*rows[at : at + 50_000]))))

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Writes the files, reads them back, and returns one row for each document: doc_id, start, n_tokens, ids_crc32.

    Null text: the end id alone. Repeated rows and repeated ids: each is written, ties by a hash of the text. Empty
    table: no files, no rows. Other columns are dropped.
    """
    return read_token_files(write_token_files(docs, tokenizer_path, folder))
