"""Token shards: one array of ids per file with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents (ascending doc_id), a 16- or 32-bit little-endian
array, then three sections and a fixed footer:

* boundaries: the start of every document and the end of the last, as an Elias-Fano sequence;
* doc ids: the distances of the ids from the first one, as an Elias-Fano sequence;
* null bits: the number of leading documents without an id is in the footer.

An Elias-Fano sequence of n values up to u takes about 2 + log2(u / n) bits a value. ``select`` finds
value i from a sample of every 256th one bit and counts from there; readers select the bounds and doc ids of a block of
documents at a time, so no table of 64-bit offsets exists.

Tasks write a shard under a name of their own and rename it, so a task that runs again after a lost
executor replaces equal bytes. Ids are streamed: a task holds one slice of texts at a time.

Null or empty text: the end id alone. Null doc_id: first. Repeated ids: one entry for each row, in the order of
their texts. Other columns are not read. An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import cut, documents, slices
from reviewlake.llm.tokens import highest_id, library_encoder
from reviewlake.session import shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
MAGIC = b"EFTOK001"
FOOTER = "<QQQqQQ8s"  # documents, tokens, null ids, first id, bytes of both sections, magic
HEAD = "<QBQQ"  # values, low bits, bytes of the low and of the high part
SAMPLE = 256
SLICE_BYTES = 2_500_000
READ_DOCS = 4 * SAMPLE
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class EliasFano:
    """A non-decreasing sequence of integers from 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).cumsum(dtype=np.int64)
        wanted = np.arange(0, n, SAMPLE) + 1
        self.samples = np.searchsorted(ones, wanted).astype(np.uint32)  # byte of every 256th one
        self.before = (ones[self.samples] - np.bitwise_count(high[self.samples])).astype(np.int64) if n else np.zeros(0, np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        bits = np.zeros(n + (top >> low_bits) + 1, dtype=np.uint8)
        bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, low, high = struct.unpack_from(HEAD, data)
        body = np.frombuffer(data, dtype=np.uint8, offset=struct.calcsize(HEAD))
        return cls(n, low_bits, body[:low], body[low : low + high])

    def to_bytes(self) -> bytes:
        return struct.pack(HEAD, self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, ones = int(self.samples[i // SAMPLE]), int(self.before[i // SAMPLE])
        while ones + (count := int(self.high[byte]).bit_count()) <= i:
            ones += count
            byte += 1
        inside = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[i - ones]
        at = i * self.low_bits
        piece = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little")
        return ((byte * 8 + int(inside) - i) << self.low_bits) | (piece >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select_block(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1, unsigned 64-bit, from the bytes between two samples."""
        if i >= j:
            return np.zeros(0, np.uint64)
        sample, after = i // SAMPLE, -(-j // SAMPLE)
        begin = int(self.samples[sample])
        end = int(self.samples[after]) + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little"))
        ones = ones[i - int(self.before[sample]) :][: j - i] + 8 * begin
        out = (ones - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        first, last = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first]
        for k, column in enumerate(bits.reshape(j - i, self.low_bits).T):
            out |= column.astype(np.uint64) << np.uint64(k)
        return out


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def write_shards(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_bytes: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards below ``folder``; one row for each shard, in doc_id order.

    ``folder`` must be reachable from all executors. ``id_bytes`` is 2 or 4, by default as the vocabulary needs.
    """
    id_bytes = id_bytes or (2 if max(highest_id(vocabulary), end_id) < 2**16 else 4)
    kind = f"<u{id_bytes}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        ids: list[int | None] = []
        lengths: list[int] = []
        out, files, root, temporary = None, None, "", ""
        shard = TaskContext.get().partitionId()
        for batch in slices(batches, 1, SLICE_BYTES):
            if out is None:
                files, root = _file_system(folder)
                files.create_dir(root, recursive=True)
                temporary = f"{root}/.{shard}-{uuid.uuid4().hex}"
                out = files.open_output_stream(temporary)
            tokens, bounds = encoder.encode(batch.column(1))
            if max(int(tokens.max(initial=0)), end_id) >> 8 * id_bytes:
                raise ValueError(f"an id does not fit {id_bytes} bytes")
            out.write(np.insert(tokens, bounds[1:], np.uint32(end_id)).astype(kind).tobytes())
            ids += batch.column(0).to_pylist()
            lengths += (np.diff(bounds) + 1).tolist()
        if out is None:
            return
        known = np.array([x for x in ids if x is not None], dtype=np.int64)
        first = int(known[0]) if len(known) else 0
        starts = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
        names = EliasFano.of(known.astype(np.uint64) - np.uint64(first % 2**64)).to_bytes()
        total = sum(lengths)
        out.write(starts + names + struct.pack(FOOTER, len(ids), total, len(ids) - len(known), first, len(starts), len(names), MAGIC))
        out.close()
        path = f"{root}/shard-{shard:06d}.tok{id_bytes}"
        if files.get_file_info(path).is_file:
            files.delete_file(path)
        files.move(temporary, path)
        name = f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [len(ids)], "n_tokens": [total]})

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(write, MANIFEST), "token-manifest")


class Shard:
    """Random access to one shard file."""

    def __init__(self, path: str):
        files, inner = _file_system(path)
        self.file = files.open_input_file(inner)
        self.id_bytes = int(path[-1])
        footer = struct.calcsize(FOOTER)
        self.n_docs, self.n_tokens, nulls, first, starts, names, magic = struct.unpack(
            FOOTER, self.file.read_at(footer, self.file.size() - footer)
        )
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        at = self.n_tokens * self.id_bytes
        self.starts = EliasFano.from_bytes(self.file.read_at(starts, at))
        self.names = EliasFano.from_bytes(self.file.read_at(names, at + starts))
        self.nulls, self.first = nulls, np.uint64(first % 2**64)

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Ids of documents i to j - 1; those without one come first."""
        named = self.names.select_block(max(0, i - self.nulls), max(0, j - self.nulls))
        return [None] * (min(j, self.nulls) - min(i, self.nulls)) + (named + self.first).astype(np.int64).tolist()

    def ids(self, start: int, stop: int) -> np.ndarray:
        data = self.file.read_at((stop - start) * self.id_bytes, start * self.id_bytes)
        return np.frombuffer(data, dtype=f"<u{self.id_bytes}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, found by two selects."""
        return self.ids(self.starts.select(i), self.starts.select(i + 1))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), ids."""
    n = max(1, manifest.count())
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))  # one row for each file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(path)
                i = 0
                while i < shard.n_docs:
                    bounds = shard.starts.select_block(i, min(i + READ_DOCS, shard.n_docs) + 1).astype(np.int64)
                    n = max(1, int(np.searchsorted(bounds, bounds[0] + SLICE_BYTES // 4, "right")) - 1)
                    ids = shard.ids(bounds[0], bounds[n])
                    arrays = pa.ListArray.from_arrays(pa.array(bounds[: n + 1] - bounds[0], pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(i, i + n), pa.int64()), pa.array(bounds[:n] + base), arrays], ["doc_id", "start", "ids"])
                    i += n

    return placed.repartition(n).mapInArrow(read, "doc_id long, start long, ids array<int>")


def op6_elias_fano_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(documents(spark, sf_dir), shared_dir(spark, "token-shards"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ids, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_shards(shards).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
