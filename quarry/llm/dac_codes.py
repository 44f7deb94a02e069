"""Token storage as directly addressable codes.

Every id is split into chunks of eight bits. Level 0 holds the lowest chunk of every
id, and a bitmap beside it tells which ids go on to the next level; a rank
directory (ones before each run of 512 bits) turns an id's place on one level into
its place on the next, so any token is read without decoding what stands before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import arrays as A
from quarry.llm.ordering import range_offsets
from quarry.llm.tokens import encoded_rows

MAGIC = b"DAC1"
RANK_BITS = 512
#: Ids in one stored block, more only for a longer document.
BLOCK_IDS = 1 << 20
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def dac_encode(ids: np.ndarray) -> bytes:
    """Serialise unsigned 32-bit ids. Layout: magic, level count, then per level the
    number of chunks, the chunks, the bitmap padded to whole rank runs, and one
    32-bit count per run (all little-endian)."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        per_run = _POPCOUNT[bits].reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_run)]).astype("<u4")
        levels.append((rest.astype(np.uint8), bits, ranks))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [MAGIC, struct.pack("<I", len(levels))]
    for chunk, bits, ranks in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class DacReader:
    """Random access to a stored block."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        (n_levels,) = struct.unpack_from("<I", blob, 4)
        at, self.levels = 8, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            n_bits = -(-(-(-n // 8)) // (RANK_BITS // 8)) * (RANK_BITS // 8)
            chunk = np.frombuffer(blob, np.uint8, n, at)
            bits = np.frombuffer(blob, np.uint8, n_bits, at + n)
            n_ranks = n_bits * 8 // RANK_BITS + 1
            ranks = np.frombuffer(blob, "<u4", n_ranks, at + n + n_bits)
            at += n + n_bits + 4 * n_ranks
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i: the directory's count and at most one run of bits."""
        run = i // RANK_BITS
        lo, byte = run * (RANK_BITS // 8), i // 8
        n = int(ranks[run]) + int(_POPCOUNT[bits[lo:byte]].sum())
        if i % 8:
            n += int(_POPCOUNT[int(bits[byte]) & ((1 << (i % 8)) - 1)])
        return n

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1, touching only their own chunks on every level."""
        if not 0 <= start <= stop <= len(self):
            raise IndexError((start, stop))
        out = np.zeros(stop - start, dtype=np.uint32)
        where = np.arange(stop - start)
        for level, (chunk, bits, ranks) in enumerate(self.levels):
            if start == stop:
                break
            out[where] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * level)
            lo = start // 8
            more = np.unpackbits(bits[lo:-(-stop // 8)], bitorder="little")[start - 8 * lo:stop - 8 * lo]
            where = where[more.astype(bool)]
            start, stop = self._rank(bits, ranks, start), self._rank(bits, ranks, stop)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


BLOCK_SCHEMA = ("range_no int, range_start bigint, doc_ids array<bigint>, "
                "doc_lengths array<bigint>, codes binary")


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id",
                 text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token blocks in ascending order of ``key``: rows are dealt by key ranges and
    sorted inside, each task encodes its range in order and closes a block after
    ``block_ids`` ids. ``range_start`` is the block's first id counted inside its range.

    A null text counts as empty (its only id is ``end_id``); a null key comes first;
    rows with equal keys follow each other by text; an empty table gives no block;
    other columns are not read.
    """
    rows = (docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("body"))
            .repartitionByRange("key").sortWithinPartitions("key", "body")
            .select(F.spark_partition_id().alias("range_no"), "key", "body"))

    def encode(batches):
        done, held, parts, keys, lengths, range_no = 0, 0, [], [], [], None

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([range_no], pa.int32()), pa.array([done], pa.int64()),
                 pa.array([keys], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                 pa.array([dac_encode(np.concatenate(parts))], pa.binary())],
                names=["range_no", "range_start", "doc_ids", "doc_lengths", "codes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            range_no = batch.column(0)[0].as_py()
            batch_keys = batch.column(1).to_pylist()
            for first, ids, limits in encoded_rows(vocabulary, A.string_column(batch, "body")):
                for r in range(len(limits) - 1):
                    own = np.append(ids[limits[r]:limits[r + 1]], np.uint32(end_id))
                    parts.append(own)
                    keys.append(batch_keys[first + r])
                    lengths.append(len(own))
                    held += len(own)
                    if held >= block_ids:
                        yield block()
                        done, held, parts, keys, lengths = done + held, 0, [], [], []
        if parts:
            yield block()

    return rows.mapInArrow(encode, BLOCK_SCHEMA)


READ_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per stored document its place in the corpus, its number of ids and their
    CRC-32 (as little-endian unsigned 32-bit integers), read through the codes."""
    sizes = blocks.select("range_no", F.aggregate("doc_lengths", F.lit(0).cast("bigint"),
                                                  lambda a, x: a + x).alias("n_ids"))
    # one row per range: bounded by the number of partitions
    before = F.broadcast(range_offsets(sizes, "n_ids"))
    rows = blocks.join(before, "range_no").select(
        (F.col("before") + F.col("range_start")).alias("start"), "doc_ids", "doc_lengths", "codes")

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, keys, lengths, codes in zip(*(c.to_pylist() for c in batch.columns)):
                reader = DacReader(codes)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(reader.slice(int(e) - n, int(e)).astype("<u4").tobytes())
                       for n, e in zip(lengths, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(start + ends - lengths, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(decode, READ_SCHEMA)
