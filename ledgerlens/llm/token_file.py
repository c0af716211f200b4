"""Token ids as bit-plane-shuffled, compressed chunks.

Documents are put in ascending id order, tokenised, and their ids (each with an
end id) are laid end to end.  The stream of a partition is cut into chunks of
``CHUNK_IDS`` ids.  A chunk is transposed into byte planes (all lowest bytes,
then all second bytes, ...) or bit planes, planes are compressed one by one
with zstandard, and planes of zeros are left out.

Layout of a chunk (little-endian): magic ``LLTP``, version u8, plane kind u8
(0 byte, 1 bit), number of planes u16, number of ids u32, then per plane u32
compressed length (0: all zeros), then the planes.

Files are written by Spark's own writer (one row per chunk, a binary column),
so commits are atomic, lost executors are repeated and any store that Spark
reaches will do.  The other columns are the chunk index: partition, number,
first id of the chunk in its partition, and the documents that begin in it with
their first id and length.

Defined cases: a null or empty text has the end id only; a document may span
chunks; equal ids keep their rows, ordered by text hash; null ids come first;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_or_empty
from ledgerlens.llm.tokenize import encoder, text_runs

CHUNK_IDS = 1 << 16
LEVEL = 3
MAGIC, VERSION = b"LLTP", 1
BYTE_PLANES, BIT_PLANES = 0, 1
_HEAD = struct.Struct("<4sBBHI")


def encode_chunk(ids: np.ndarray, kind: int = BYTE_PLANES, level: int = LEVEL) -> bytes:
    """One chunk of unsigned 32-bit ids."""
    import zstandard

    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTE_PLANES:
        planes = list(raw.T)
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(plane, bitorder="little") for plane in bits.T]
    compress = zstandard.ZstdCompressor(level=level).compress
    packed = [compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in planes]
    return b"".join([_HEAD.pack(MAGIC, VERSION, kind, len(packed), len(ids)),
                     struct.pack(f"<{len(packed)}I", *map(len, packed)), *packed])


def decode_chunk(chunk: bytes) -> np.ndarray:
    import zstandard

    magic, version, kind, n_planes, n = _HEAD.unpack_from(chunk)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token chunk of a known version")
    sizes = struct.unpack_from(f"<{n_planes}I", chunk, _HEAD.size)
    at = _HEAD.size + 4 * n_planes
    width = n if kind == BYTE_PLANES else -(-n // 8)
    planes = np.zeros((n_planes, width), np.uint8)
    expand = zstandard.ZstdDecompressor().decompress
    for plane, size in zip(planes, sizes, strict=True):
        if size:
            plane[:] = np.frombuffer(expand(chunk[at : at + size], max_output_size=width), np.uint8)
        at += size
    if kind == BIT_PLANES:
        bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
        planes = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2,
                     chunk_ids: int = CHUNK_IDS, kind: int = BYTE_PLANES) -> None:
    """Write the chunks of all documents under ``path``."""
    tail = np.array([end_id], dtype="<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def write(batches):
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path).encode_batch
        pending, number, first, total = bytearray(), 0, 0, 0
        docs_here: list[tuple] = []

        def chunk(data: bytes):
            nonlocal number, first, docs_here
            ids = np.frombuffer(data, dtype="<u4")
            end = first + len(ids)
            begun = [d for d in docs_here if d[1] < end]
            docs_here = docs_here[len(begun):]
            keys, starts, lengths = zip(*begun) if begun else ((), (), ())
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([list(keys)], pa.list_(key_type)),
                 pa.array([list(starts)], pa.list_(pa.int64())), pa.array([list(lengths)], pa.list_(pa.int64())),
                 pa.array([encode_chunk(ids, kind)], pa.binary())],
                names=["part", "chunk", "first_id", "n_ids", "doc_ids", "doc_starts", "doc_lengths", "data"])
            number, first = number + 1, end
            return row

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in text_runs(texts):
                for key, found in zip(keys[lo:hi], encode(texts[lo:hi]), strict=True):
                    n = len(found) // 4 + 1
                    docs_here.append((key, total, n))
                    pending += found
                    pending += tail
                    total += n
                done = 0
                while len(pending) - done >= 4 * chunk_ids:
                    yield chunk(bytes(pending[done : done + 4 * chunk_ids]))
                    done += 4 * chunk_ids
                del pending[:done]
        if pending:
            yield chunk(bytes(pending))

    schema = (f"part int, chunk int, first_id long, n_ids long, doc_ids array<{id_type}>, "
              "doc_starts array<long>, doc_lengths array<long>, data binary")
    ordered = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    (ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
     .mapInArrow(write, schema).write.option("compression", "none").parquet(path))


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the file: every column but the data."""
    return spark.read.parquet(path).drop("data")


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``, little-endian unsigned
    32-bit bytes) of every document, decoded from the chunks; ``start`` counts
    the ids of all documents before it."""
    chunks = spark.read.parquet(path)
    id_type = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    # One row per partition of the file: its first id in the whole order.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def read(batches):
        part, held, held_at, waiting = None, b"", 0, []
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(i)[row].as_py() for i, c in enumerate(batch.schema.names)}
                if r["part"] != part:
                    part, held, held_at, waiting = r["part"], b"", 0, []
                held += decode_chunk(r["data"]).tobytes()
                waiting += zip(r["doc_ids"], r["doc_starts"], r["doc_lengths"], strict=True)
                end, out = held_at + len(held) // 4, []
                for key, start, n in waiting:
                    if start + n > end:
                        break
                    ids = held[4 * (start - held_at) : 4 * (start - held_at + n)]
                    out.append((key, start, n, zlib.crc32(ids), ids if with_ids else None))
                waiting = waiting[len(out):]
                keep = waiting[0][1] if waiting else end
                held, held_at = held[4 * (keep - held_at):], keep
                if out:
                    keys, *others = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(out), pa.int32()), pa.array(keys, batch.schema.field("doc_ids").type.value_type),
                         *(pa.array(x, pa.int64()) for x in others[:3]), pa.array(others[3], pa.binary())],
                        names=["part", "doc_id", "local", "n_tokens", "ids_crc32", "ids"])

    decoded = (chunks.select("part", "chunk", "doc_ids", "doc_starts", "doc_lengths", "data")
               .repartition("part").sortWithinPartitions("part", "chunk")
               .mapInArrow(read, f"part int, doc_id {id_type}, local long, n_tokens long, ids_crc32 long, ids binary"))
    return decoded.join(parts, "part").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
