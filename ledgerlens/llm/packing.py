"""Best-fit packing with certified bin counts.

Documents are tokenised, an end id is appended, and only documents longer than
a sequence are cut (the first piece takes the remainder).  Pieces are dealt to
partitions by hash; each partition runs best-fit decreasing, and a lower bound
from dual-feasible functions tells whether its number of sequences is proven
minimal.  Partitions with a gap give up their sequences that have room, proven
ones only their emptiest; the pieces so freed meet those of other partitions
and are packed again by best-fit decreasing.  A round that doesn't lower the
total is dropped and ends the exchange.

Defined cases: a null or empty text is a document of the end id alone; rows
that repeat each other are packed each by itself; null ids are allowed; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import staged, text_or_empty
from ledgerlens.llm.tokenize import encoder, small_batches, text_runs

CAPACITY = 2048
#: Pieces that one task packs.
PARTITION_PIECES = 8192
#: Share of a sequence that must be free for it to be given up.
FREE_SHARE = 0.02
ROUNDS = 4
#: Sequence ids: round, partition and number, in these bits.
PARTITION_BITS, NUMBER_BITS = 28, 28


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
              with_ids: bool = False) -> DataFrame:
    """``piece_id, doc_id, piece, start, length, ids_crc32`` (and ``ids``, bytes)
    of every piece, written once; ``piece_id`` is unique."""
    tail = np.array([end_id], dtype="<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encode = encoder(tokenizer_path).encode_batch
        for batch in small_batches(batches, 1):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in text_runs(texts):
                rows, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                for k, found in enumerate(encode(texts[lo:hi]), start=lo):
                    found += tail
                    n = len(found) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        rows.append(k)
                        part = found[4 * a : 4 * b]
                        for name, value in (("piece", i), ("start", a), ("length", b - a),
                                            ("ids_crc32", zlib.crc32(part)), ("ids", part)):
                            out[name].append(value)
                arrays = [ids.take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32()),
                          *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(out["ids"], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    found = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, schema)
    return staged(found.withColumn("piece_id", F.monotonically_increasing_id()), "pack-pieces")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the largest bound that a family of
    dual-feasible functions gives, evaluated on the counts per length."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    size = np.flatnonzero(counts)
    number = counts[size].astype(np.int64)
    best = -(-int(size @ number) // capacity)
    # Below a threshold lengths count nothing, above its complement a whole bin.
    for low in np.unique(np.minimum(size, capacity - size)):
        if 0 < low <= capacity // 2:
            value = np.where(size > capacity - low, capacity, np.where(size < low, 0, size))
            best = max(best, -(-int(value @ number) // capacity))
    # Rounding to multiples of a k-th of the capacity; exact multiples stay.
    for k in range(1, 33):
        up = (k + 1) * size
        value = np.where(up % capacity == 0, size * k, up // capacity * capacity)
        best = max(best, -(-int(value @ number) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length, and the free room of each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # room sizes that some bin has, ascending
    free: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        at = bisect_left(rooms, length)
        if at == len(rooms):
            number, room = len(free), capacity
            free.append(capacity)
        else:
            room = rooms[at]
            number = with_room[room].pop()
            if not with_room[room]:
                rooms.pop(at)
        bins[i], offsets[i] = number, capacity - room
        free[number] = left = room - length
        if left:
            if not with_room[left]:
                insort(rooms, left)
            with_room[left].append(number)
    return bins, offsets, free


def _packer(turn: int, capacity: int, free_share: float):
    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        proven = len(free) == lower_bound(lengths, capacity)
        room = np.array(free)
        given = (room == room.max()) & (room > 0) if proven else room >= max(1, free_share * capacity)
        base = (turn << (PARTITION_BITS + NUMBER_BITS)) + (table["part"][0].as_py() << NUMBER_BITS)
        out = table.drop_columns(["part"])
        for name, values in (("sequence_id", base + bins), ("offset", offsets), ("proven", np.full(len(bins), proven)),
                             ("freed", given[bins])):
            out = out.append_column(name, pa.array(values))
        return out

    return pack


def pack_round(pieces: DataFrame, turn: int, capacity: int, partition_pieces: int, free_share: float) -> DataFrame:
    parts = max(1, -(-pieces.count() // partition_pieces))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "piece_id"), F.lit(parts)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    packed = dealt.groupBy("part").applyInArrow(
        _packer(turn, capacity, free_share),
        f"{schema}, sequence_id long, offset long, proven boolean, freed boolean")
    return staged(packed, f"pack-round-{turn}")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS,
                partition_pieces: int = PARTITION_PIECES, free_share: float = FREE_SHARE) -> DataFrame:
    """``pieces`` (with ``piece_id`` and ``length``) and their ``sequence_id``,
    ``offset`` and ``proven`` (was its partition's count proven minimal)."""
    columns = pieces.columns
    packed = pack_round(pieces, 0, capacity, partition_pieces, free_share)
    settled = []
    for turn in range(1, rounds):
        pool = packed.filter("freed").select(*columns)
        again = pack_round(pool, turn, capacity, partition_pieces, free_share)
        before = packed.filter("freed AND offset = 0").count()
        after = again.filter("offset = 0").count()
        if after >= before:
            break
        settled.append(packed.filter("NOT freed"))
        packed = again
    result = packed
    for part in settled:
        result = result.unionByName(part)
    return result.drop("freed")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
                   with_ids: bool = False, **options) -> DataFrame:
    """Tokenise and pack: one row per piece with its place; see the module."""
    return pack_pieces(pieces_of(docs, tokenizer_path, end_id, capacity, with_ids), capacity, **options)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence, from pieces packed
    with their ids; a group is one sequence of at most ``capacity`` ids."""

    def join(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("offset")
        ids = np.frombuffer(b"".join(ordered["ids"].to_pylist()), dtype="<u4").astype(np.int64)
        return pa.table({"sequence_id": ordered["sequence_id"].slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int64()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(
        join, "sequence_id long, ids array<long>")
