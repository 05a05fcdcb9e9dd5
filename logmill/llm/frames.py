"""Token-id files: independent Zstandard frames, a trailing seek table, a checksum per frame.

A shard holds documents in ascending ``doc_id`` order (nulls first, equal ids in
input order).  Layout: one frame per document with its ids as little-endian
unsigned 32-bit integers; a skippable frame with the document ids; a skippable
frame in the public seekable format (per frame: compressed size, size, low 32
bits of xxh64 of the content; then frame count, flags, magic number).  A reader
seeks to the table at the end and decompresses only the frames asked for.

A task writes a range of ids and begins another shard after ``SHARD_BYTES`` of frames;
there are as many ranges as shuffle partitions, and one for every ``RANGE_BYTES`` of
text at least.  Shards are written once, under names that an attempt makes up; the
manifest names those that count, so a retried or speculative task leaves at most an
unreferenced file.  A shard is read by one task.

Null text: only the end id.  A very long text is one frame, encoded whole by its task.
Columns but doc_id and text are not looked at.  An empty input gives no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmill.llm.arrays import slices
from logmill.llm.storage import file_system, materialize, new_folder
from logmill.llm.tokenize import ENCODE_BYTES, END_ID, word_encoder

SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Bytes of frames after which a shard ends, and of text for each range of ids.
SHARD_BYTES, RANGE_BYTES = 256 << 20, 512 << 20


def _checksum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """Appends one frame per document to a binary stream; ``close`` adds both tables."""

    def __init__(self, stream, level: int = 1):
        import zstandard

        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=level).compress
        #: Three numbers a frame; ids (0 for null) and whether they are known.
        self.table, self.ids, self.known = array("I"), array("q"), bytearray()
        self.tokens = self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4", copy=False).tobytes()
        frame = self.compress(raw)
        self.stream.write(frame)
        self.table.extend((len(frame), len(raw), _checksum(raw)))
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.tokens += len(ids)
        self.size += len(frame)

    def close(self) -> None:
        body = np.array(self.ids, "<i8").tobytes() + bytes(self.known)
        self.stream.write(struct.pack("<II", SKIPPABLE_IDS, len(body)) + body)
        entries = np.array(self.table, "<u4").tobytes()
        self.stream.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + 9) + entries)
        self.stream.write(struct.pack("<IBI", len(self.ids), CHECKSUM_FLAG, SEEK_MAGIC))
        self.stream.close()


class FrameReader:
    """Random access to the documents of a shard, by position or by id."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{uri}: no seek table with checksums at its end")
        start = size - 9 - 12 * n
        self.table = np.frombuffer(self.file.read_at(12 * n, start), "<u4").reshape(n, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        body = self.file.read_at(9 * n, start - 8 - 9 * n)
        ids, known = np.frombuffer(body[: 8 * n], "<i8"), np.frombuffer(body[8 * n :], np.uint8)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.expand = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.table)

    @property
    def lengths(self) -> np.ndarray:
        """Ids per document, from the table alone."""
        return self.table[:, 1].astype(np.int64) // 4

    def raw(self, i: int) -> bytes:
        packed, size, check = (int(x) for x in self.table[i])
        out = self.expand(self.file.read_at(packed, int(self.offsets[i])), max_output_size=max(size, 1))
        if len(out) != size or _checksum(out) != check:
            raise ValueError(f"frame {i} is damaged")
        return out

    def read(self, i: int) -> np.ndarray:
        return np.frombuffer(self.raw(i), "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this id."""
        return [self.read(i) for i, d in enumerate(self.doc_ids) if d == doc_id]

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Shard:
    path: str
    docs: int
    tokens: int
    #: ids of all documents in the shards before this one
    start: int


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> list[Shard]:
    """Tokenise all of ``docs`` (doc_id, text) into shards; the list has a row per file, not per document."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-frames")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ordered = (
        docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), F.col("_row"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("_row"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, path, number = word_encoder(tokenizer), None, "", TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"number": [number], "path": [path], "docs": [len(out.ids)], "tokens": [out.tokens]})

        for batch in batches:
            for part in slices(batch, size=ENCODE_BYTES):
                ids, bounds = encoder.encode(part.column("text"), END_ID)
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
                    fs, local = file_system(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = FrameWriter(fs.open_output_stream(local, compression=None))
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    out.add(doc_id, ids[bounds[i] : bounds[i + 1]])
                if out.size >= shard_bytes:
                    yield done()
                    out, number = None, number + 1
        if out is not None:
            yield done()

    manifest = materialize(ordered.mapInArrow(write, "number long, path string, docs long, tokens long"), "frame-manifest")
    shards, start = [], 0
    for r in manifest.orderBy("number").collect():
        shards.append(Shard(r["path"], r["docs"], r["tokens"], start))
        start += r["tokens"]
    return shards


def read_shards(spark, shards: list[Shard]) -> DataFrame:
    """Read every document of the files back: doc_id, start, n_tokens, ids_crc32 and the ids as bytes."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    rows = [(i, s.path, s.start) for i, s in enumerate(shards)]
    listed = spark.createDataFrame(rows, "number int, path string, start long").repartitionById(len(rows), "number")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = FrameReader(row["path"])
                starts = row["start"] + np.concatenate(([0], np.cumsum(reader.lengths)))
                step = 2048
                for a in range(0, len(reader), step):
                    b = min(a + step, len(reader))
                    raw = [reader.raw(i) for i in range(a, b)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(reader.doc_ids[a:b], pa.int64()),
                            "start": pa.array(starts[a:b]),
                            "n_tokens": pa.array(reader.lengths[a:b]),
                            "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                            "ids": pa.array(raw, pa.binary()),
                        }
                    )
                reader.close()

    return listed.mapInArrow(read, schema)
