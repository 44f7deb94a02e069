"""Hierarchical packing of token streams into windows of several lengths.

Documents are routed to tiers (context lengths, longest first). A document's whole
longest windows stand alone; what is left of it opens a window of the smallest
tier that holds it, and the gap is filled from shorter leftovers: the longest that
fits, else one cut to size. Only the last window of a packing block can stay open;
it is cut into shorter tiers, so that less than the shortest tier is padded.

A task packs the rows it has read, in blocks of bounded size: no shuffle, and no
window spans two tasks. The pieces are written; then the windows of each tier are
numbered over all tasks (one row per tier and task tells where a task begins) and grouped
into steps of equal token counts, padding included.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import arrays as A
from quarry.llm.scratch import written
from quarry.llm.tokens import encoded_rows, encoders

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 1 << 16
#: Ids packed together in a task, more only for a longer document.
BLOCK_IDS = 1 << 20
#: Text encoded at a time in a task.
TEXT_BYTES = 1 << 19

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, tier int, step_group bigint")


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows for documents of the given lengths: (tier, [(document, start, length)]).
    Every window but the last is full."""
    longest = tiers[0]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for doc, n in enumerate(lengths):
        for start in range(0, n - longest + 1, longest):
            windows.append((longest, [(doc, start, longest)]))
        if n % longest:
            pool.append((n % longest, doc, n - n % longest))
    pool.sort()
    while pool:
        n, doc, start = pool.pop()
        tier = min(t for t in tiers if t >= n)
        pieces, gap = [(doc, start, n)], tier - n
        while gap and pool:
            at = bisect_right(pool, (gap, len(lengths), 0)) - 1
            if at >= 0:
                m, doc, start = pool.pop(at)
            else:
                m, doc, start = pool.pop(0)  # the shortest is still too long: cut it
                insort(pool, (m - gap, doc, start + gap))
                m = gap
            pieces.append((doc, start, m))
            gap -= m
        if gap:
            windows += _cut_open_window(pieces, tiers)
        else:
            windows.append((tier, pieces))
    return windows


def _cut_open_window(pieces, tiers):
    """The tokens of a window that cannot be filled, as full windows of shorter tiers
    and at most one open window."""
    left, out = sum(p[2] for p in pieces), []
    pieces = list(pieces)
    while left:
        size = next((t for t in tiers if t <= left), left)
        window, room = [], size
        while room:
            doc, start, n = pieces.pop(0)
            if n > room:
                pieces.insert(0, (doc, start + room, n - room))
                n = room
            window.append((doc, start, n))
            room -= n
        out.append((size if size in tiers else tiers[0], window))
        left -= size
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text",
         tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
         block_ids: int = BLOCK_IDS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents' id streams (ids of the text, then ``end_id``) laid out
    in sequences. ``offset`` is gapless from 0 in each sequence; a sequence shorter
    than its ``tier`` is padded to the longest. ``with_ids`` adds the ids (unsigned
    32-bit little-endian).

    A null text counts as empty (one id); a null key stays null; repeated rows are
    separate documents; an empty table gives no row; other columns are not read.
    """
    if sorted(tiers, reverse=True) != list(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two, longest first")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("body"))
    names = [c.split()[0] for c in PIECES.split(", ")] + (["ids"] if with_ids else [])

    def pack_block(keys, streams, base, per_tier):
        pieces = {c: [] for c in names}
        lengths = [len(s) for s in streams]
        for tier, window in plan_windows(lengths, tiers):
            per_tier[tier] = per_tier.get(tier, 0) + 1
            step = per_tier[tier] - 1  # numbered over all tasks below
            offset = 0
            for doc, start, n in window:
                raw = streams[doc][start:start + n].astype("<u4").tobytes()
                for c, v in zip(names, (keys[doc], start, n, zlib.crc32(raw), lengths[doc], base,
                                        offset, tier, step, raw)):
                    pieces[c].append(v)
                offset += n
            base += 1
        kinds = {"tier": pa.int32(), "ids": pa.binary()}
        return base, pa.RecordBatch.from_arrays(
            [pa.array(pieces[c], kinds.get(c, pa.int64())) for c in names], names=names)

    def run(batches):
        base, per_tier = TaskContext.get().partitionId() << 32, {}
        keys, streams, held = [], [], 0
        for batch in batches:
            batch_keys = batch.column(0).to_pylist()
            for first, ids, limits in encoded_rows(vocabulary, A.string_column(batch, "body"), TEXT_BYTES):
                for r in range(len(limits) - 1):
                    keys.append(batch_keys[first + r])
                    streams.append(np.append(ids[limits[r]:limits[r + 1]], np.uint32(end_id)))
                    held += len(streams[-1])
                    if held >= block_ids:
                        base, out = pack_block(keys, streams, base, per_tier)
                        yield out
                        keys, streams, held = [], [], 0
        if streams:
            base, out = pack_block(keys, streams, base, per_tier)
            yield out

    pieces = written(rows.mapInArrow(A.tidy(run, encoders), PIECES + (", ids binary" if with_ids else "")), "packed-pieces")
    task = F.shiftright("sequence_id", 32)
    sizes = pieces.groupBy("tier", task.alias("task")).agg((F.max("step_group") + 1).alias("windows"))
    before = F.sum("windows").over(Window.partitionBy("tier").orderBy("task")) - F.col("windows")
    begins = sizes.select(F.col("tier").alias("of_tier"), "task", before.alias("before"))
    found = pieces.join(F.broadcast(begins), (F.col("tier") == F.col("of_tier")) & (task == F.col("task")))
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    return found.withColumn("step_group", F.floor((F.col("before") + F.col("step_group")) / per_step)).select(*names)
