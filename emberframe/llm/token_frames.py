"""Token ids as independent zstandard frames with a trailing seek table.

A shard file is a sequence of frames, one per document, each the document's ids as little-endian unsigned 32-bit
integers. Two skippable frames follow: the documents' ids, then the seek table of the public seekable format, with the
compressed size, the plain size and a checksum (lower half of XXH64) for each frame. Any zstandard decoder reads the file
as the plain ids of all its documents; a reader that knows the table fetches and decodes only the frames it is asked for.

Documents are dealt to shards by ranges of doc_id and sorted within them. Tasks write shards straight to the shared
folder under names of their own and report them in a manifest; files of lost or repeated attempts are in no manifest.

Defined results. A null or empty text is its end id alone. A null doc_id sorts first and stays null. Rows with equal
doc_id are ordered by text. An empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberframe.llm.tokens import encoder
from emberframe.session import cut, shuffle_partitions, work_dir

SHARD_BYTES = 32_000_000  #: a shard file is closed when its frames reach this size
END_ID = 2
LEVEL = 1
# fixed values of the public zstandard and seekable formats
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "part long, number long, path string, documents long, tokens long, bytes long, first_id long, last_id long"


class ShardWriter:
    """One shard file."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.tokens.zst"
        store, name = fs.FileSystem.from_uri(self.path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(name, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.ids: list[int | None] = []
        self.table: list[tuple[int, int, int]] = []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.packer.compress(ids)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.size += len(frame)
        self.tokens += len(ids) // 4

    def close(self) -> None:
        n = len(self.ids)
        # each id as a flag (1: there) and a 64-bit integer
        ids = b"".join(struct.pack("<Bq", i is not None, i or 0) for i in self.ids) + struct.pack("<I", n)
        table = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", n, CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()


class ShardReader:
    """Random access to a shard file: only its tail and the frames asked for are read."""

    def __init__(self, path: str) -> None:
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        table_at = end - 9 - 12 * n
        ids_at = table_at - 8 - 4 - 9 * n
        self.table = list(struct.iter_unpack("<III", self.file.read_at(12 * n, table_at)))
        self.ids = [i if there else None for there, i in struct.iter_unpack("<Bq", self.file.read_at(9 * n, ids_at))]
        self.starts = [0]
        for size, _, _ in self.table:
            self.starts.append(self.starts[-1] + size)
        self.unpacker = zstandard.ZstdDecompressor()

    def _checked(self, i: int, frame: bytes) -> bytes:
        ids = self.unpacker.decompress(frame, max_output_size=self.table[i][1]) if self.table[i][1] else b""
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.table[i][2]:
            raise ValueError(f"frame {i} is damaged")
        return ids

    def frame(self, i: int) -> bytes:
        return self._checked(i, self.file.read_at(self.table[i][0], self.starts[i]))

    def documents(self, wanted: Iterable[int | None]) -> Iterator[tuple[int | None, bytes]]:
        wanted = set(wanted)
        return ((doc_id, self.frame(i)) for i, doc_id in enumerate(self.ids) if doc_id in wanted)

    def all(self) -> Iterator[tuple[int | None, bytes]]:
        """Every document, with one read per MB or so."""
        at = 0
        while at < len(self.ids):
            to = at + 1
            while to < len(self.ids) and self.starts[to + 1] - self.starts[at] < 1 << 20:
                to += 1
            block = self.file.read_at(self.starts[to] - self.starts[at], self.starts[at])
            for i in range(at, to):
                yield self.ids[i], self._checked(i, block[self.starts[i] - self.starts[at] : self.starts[i + 1] - self.starts[at]])
            at = to


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    encode, end, part = encoder(vocabulary).encode, struct.pack("<I", end_id), TaskContext.get().partitionId()
    shard, done = None, []

    def close() -> None:
        shard.close()
        done.append({"part": part, "number": len(done), "path": shard.path, "documents": len(shard.ids), "tokens": shard.tokens, "bytes": shard.size, "first_id": shard.ids[0], "last_id": shard.ids[-1]})

    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
            shard = shard or ShardWriter(folder)
            shard.add(doc_id, ids + end)
            if shard.size >= shard_bytes:
                close()
                shard = None
    if shard:
        close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in MANIFEST.split(", ")]))


def write_frames(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; the manifest: part, number, path, documents, tokens, bytes, first_id, last_id. In order of part and number it is in order of doc_id."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "token-frames")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = given.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(dealt.mapInArrow(partial(_write, folder=folder, vocabulary=vocabulary, end_id=end_id, shard_bytes=shard_bytes), MANIFEST))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out = []
            for doc_id, ids in ShardReader(path).all():
                out.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids) // 4, "ids_crc32": zlib.crc32(ids)})
                start += len(ids) // 4
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))


def read_digests(manifest: DataFrame) -> DataFrame:
    """Reads every frame back: doc_id, start (ids before the document's), n_tokens, ids_crc32."""
    # one short row per shard file goes through this window
    before = F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(manifest.select("path", F.coalesce(before, F.lit(0)).alias("start")))
    dealt = starts.repartition(shuffle_partitions(manifest.sparkSession), "path")
    return dealt.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = list(ShardReader(path).documents(wanted))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([ids for _, ids in found], pa.binary())], names=["doc_id", "ids"])


def read_documents(manifest: DataFrame, wanted: list[int | None]) -> DataFrame:
    """doc_id and ids of the documents asked for: only shards whose range of ids holds one are opened, and their frames alone decompressed."""
    asked = F.lit(wanted).cast("array<long>") if wanted else F.array().cast("array<long>")
    # missing ids come first, so a shard that begins without one may hold ids from the smallest on
    here = F.filter(asked, lambda w: F.when(w.isNull(), F.col("first_id").isNull()).otherwise((F.coalesce(F.col("first_id"), w) <= w) & (w <= F.col("last_id"))))
    return manifest.select("path", here.alias("wanted")).where(F.size("wanted") > 0).mapInArrow(_fetch, "doc_id long, ids binary")


def token_frames(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes, writes, and reads the files back."""
    return read_digests(write_frames(docs, vocabulary))
