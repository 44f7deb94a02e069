"""Removal of word windows that repeat across documents, behind a count-min prefilter.

A window is 13 consecutive words. Its anchor is the least hash among its nine 5-grams,
so equal windows have equal anchors and neighbouring windows mostly share one. Every
task sketches the anchors of its rows (two hash rows, saturating at two), the
partition sketches are merged shard by shard, and the merged sketch overestimates in
how many places a window starts: a window whose anchor is counted once is unique.
A second pass groups the other windows by a 64-bit hash of their word sequence; none
that repeats is lost, and two different sequences meet with odds of 2**-64 a pair. The sketch grows with the input up to MAX_CELLS; beyond, more
windows reach the exact pass and the result stays the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import arrays as A
from quarry.llm.scratch import written

WINDOW = 13
ANCHOR_WORDS = 5
SKETCH_ROWS = 2
SHARD_BITS = 22
#: Cells per sketch row at most; broadcast as one bit each (2 * 64 MB).
MAX_CELLS_LOG2 = 29
#: Anchors a task sketches before it sends them on.
FLUSH_ANCHORS = 1 << 21
_U = A.U64


def window_hashes(chunk: A.Chunk):
    """(words, window hashes, window limits, anchors) of a chunk."""
    words = A.split_words(chunk)
    hashes = A.span_hashes(chunk.data, words.start, words.end)
    windows, first = A.shingle_hashes(hashes, words.row_first, WINDOW)
    anchors = np.zeros(0, _U)
    if len(windows):
        n = len(hashes) - ANCHOR_WORDS + 1
        run = np.zeros(n, dtype=_U)
        for i in range(ANCHOR_WORDS):
            run = run * _U(A._BASE) + hashes[i:i + n]
        run, span = A.mix(run), 1
        while span * 2 <= WINDOW - ANCHOR_WORDS + 1:  # least of ever longer stretches
            run = np.minimum(run[:-span], run[span:])
            span *= 2
        left = WINDOW - ANCHOR_WORDS + 1 - span
        if left:
            run = np.minimum(run[:-left], run[left:])
        at = np.repeat(words.row_first[:-1] - first[:-1], np.diff(first)) + np.arange(first[-1])
        anchors = run[at]
    return words, windows, first, anchors


def _runs(anchors: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a stretch of windows with one anchor begins inside a row."""
    begins = np.ones(len(anchors), bool)
    begins[1:] = anchors[1:] != anchors[:-1]
    begins[first[:-1][np.diff(first) > 0]] = True
    return np.flatnonzero(begins)


def _cells(anchors: np.ndarray, row: int, log2: int) -> np.ndarray:
    return A.mix(anchors + _U(row + 1) * _U(0x9E3779B97F4A7C15)) >> _U(64 - log2)


def _packed(offsets: np.ndarray) -> bytes:
    """Ascending offsets as differences, byte plane by byte plane (compresses well)."""
    return np.diff(offsets, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u4").ravel(), dtype=np.int64)


def partition_sketches(rows: DataFrame, log2: int) -> DataFrame:
    """(sketch_row, shard, once, more): the cells a task has met once, and more often."""
    shard_bits = min(SHARD_BITS, log2)

    def run(batches):
        def sketch(parts):
            anchors = np.concatenate(parts)
            for row in range(SKETCH_ROWS):
                cells, counts = np.unique(_cells(anchors, row, log2), return_counts=True)
                shard = (cells >> _U(shard_bits)).astype(np.int64)
                at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                stops = np.append(at[1:], len(cells))
                offsets = (cells & _U((1 << shard_bits) - 1)).astype(np.int64)
                once = [_packed(offsets[a:b][counts[a:b] == 1]) for a, b in zip(at, stops)]
                more = [_packed(offsets[a:b][counts[a:b] > 1]) for a, b in zip(at, stops)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(at), pa.int32()), pa.array(shard[at].tolist(), pa.int32()),
                     pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                    names=["sketch_row", "shard", "once", "more"])

        parts, held = [], 0
        for batch in batches:
            for chunk in A.chunks(A.string_column(batch, "body")):
                _, _, first, anchors = window_hashes(chunk)
                if len(anchors):
                    parts.append(anchors[_runs(anchors, first)])
                    held += len(parts[-1])
                if held >= FLUSH_ANCHORS:
                    yield from sketch(parts)
                    parts, held = [], 0
        if parts:
            yield from sketch(parts)

    return rows.mapInArrow(run, "sketch_row int, shard int, once binary, more binary")


def merged_sketch(sketches: DataFrame, log2: int) -> DataFrame:
    """(sketch_row, shard, bits): one bit per cell, set if the summed count is two or more.
    A task holds the counters of one shard at a time, whatever comes in for it."""
    shard_bits = min(SHARD_BITS, log2)

    def run(batches):
        place, seen, twice = None, None, None

        def bits():
            return pa.RecordBatch.from_arrays(
                [pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()),
                 pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())],
                names=["sketch_row", "shard", "bits"])

        for batch in batches:
            for row, shard, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if (row, shard) != place:
                    if place is not None:
                        yield bits()
                    place = (row, shard)
                    seen, twice = np.zeros(1 << shard_bits, bool), np.zeros(1 << shard_bits, bool)
                at = _unpacked(once)
                twice[at[seen[at]]] = True
                seen[at] = True
                at = _unpacked(more)
                seen[at] = twice[at] = True
        if place is not None:
            yield bits()

    return (sketches.repartition("sketch_row", "shard").sortWithinPartitions("sketch_row", "shard")
            .mapInArrow(run, "sketch_row int, shard int, bits binary"))


def load_sketch(merged: DataFrame, log2: int) -> list[np.ndarray]:
    """The sketch as bit arrays: SKETCH_ROWS * 2**log2 / 8 bytes, at most 128 MB."""
    shard_bytes = max(1, (1 << min(SHARD_BITS, log2)) // 8)
    out = [np.zeros(max(1, (1 << log2) // 8), np.uint8) for _ in range(SKETCH_ROWS)]
    for r in merged.toLocalIterator():
        out[r.sketch_row][r.shard * shard_bytes:(r.shard + 1) * shard_bytes] = np.frombuffer(r.bits, np.uint8)
    return out


def repeated_windows(rows: DataFrame, sketch, log2: int) -> DataFrame:
    """(window, doc_id) of windows that the sketch does not know to be unique, once per
    document and chunk."""
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in A.chunks(A.string_column(batch, "body")):
                _, windows, first, anchors = window_hashes(chunk)
                if not len(windows):
                    continue
                at = _runs(anchors, first)
                passes = np.ones(len(at), bool)
                for row, bits in enumerate(sketch.value):
                    cell = _cells(anchors[at], row, log2)
                    byte = bits[(cell >> _U(3)).astype(np.int64)]
                    passes &= ((byte >> (cell & _U(7)).astype(np.uint8)) & 1).astype(bool)
                taken = np.repeat(passes, np.diff(np.append(at, len(anchors))))
                row_of, found = A.row_ids(first)[taken], windows[taken]
                order = np.lexsort((found, row_of))
                row_of, found = row_of[order], found[order]
                new = np.ones(len(found), bool)  # not the window before it in the same document
                new[1:] = (found[1:] != found[:-1]) | (row_of[1:] != row_of[:-1])
                row_of, found = row_of[new], found[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(keys[chunk.first_row + row_of], pa.int64())],
                    names=["window", "doc_id"])
    return rows.mapInArrow(run, "window bigint, doc_id bigint")


def later_windows(found: DataFrame) -> DataFrame:
    """(doc_id, window) of the found windows that also start in a document with a smaller
    key. A window found more often than a shuffle partition's share is hot: there are fewer
    of those than partitions, so they are broadcast with their least key and their rows
    are marked where they lie; only the rows of other windows are shuffled by window."""
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, found.count() // partitions)
    repeated = (found.groupBy("window").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
                .filter("n > 1 AND first IS NOT NULL"))  # all uses read both columns: one shared exchange
    hot = F.broadcast(repeated.filter(F.col("n") > share).select("window", "first"))
    others = repeated.filter(F.col("n") <= share).select("window", "first")
    pairs = found.join(hot, "window").unionByName(
        found.join(hot, "window", "left_anti").join(others, "window"))
    return pairs.filter("doc_id > first").select("doc_id", "window")


def sketch_size(n_bytes: int) -> int:
    """log2 of the cells of a sketch row: about four cells for each expected anchor (a
    fifth of the words, of some six bytes), within bounds."""
    return min(MAX_CELLS_LOG2, max(10, int(np.ceil(np.log2(max(1, n_bytes / 6 / 5 * 4))))))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_text (the words that no
    repeated window covers, joined by one space). A window is repeated if its word
    sequence also starts in a document with a smaller key, judged on the input.

    Null and empty texts have no words. Rows with equal keys are not smaller than each
    other, so they do not remove one another; rows with a null key remove nothing and
    keep all their words. An empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("body"))
    keyed = rows.filter("key IS NOT NULL")
    log2 = sketch_size(keyed.agg(F.sum(F.octet_length("body"))).first()[0] or 0)
    merged = written(merged_sketch(partition_sketches(keyed, log2), log2), "window-sketch")
    sketch = spark.sparkContext.broadcast(load_sketch(merged, log2))
    found = written(repeated_windows(keyed, sketch, log2), "window-candidates")
    marks = (later_windows(found).groupBy("doc_id")
             .agg(F.collect_set("window").alias("windows")))  # of one document
    marked = rows.join(marks, rows.key == marks.doc_id, "left").select("key", "body", "windows")

    def run(batches):
        for batch in batches:
            body, keys, lists = A.string_column(batch, "body"), batch.column(0), batch.column(2)
            for chunk in A.chunks(body):
                yield _kept(chunk, keys.slice(chunk.first_row, chunk.rows),
                            lists.slice(chunk.first_row, chunk.rows))

    return marked.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def _kept(chunk: A.Chunk, keys: pa.Array, lists: pa.Array) -> pa.RecordBatch:
    words, windows, first, _ = window_hashes(chunk)
    n = len(words)
    hit = np.zeros(len(windows), bool)
    for r in np.flatnonzero(np.asarray(lists.is_valid())):
        own = np.sort(lists[int(r)].values.to_numpy(zero_copy_only=False).view(_U))
        mine = windows[first[r]:first[r + 1]]
        hit[first[r]:first[r + 1]] = own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine
    rows = A.row_ids(first)
    start = np.flatnonzero(hit) - first[rows[hit]] + words.row_first[rows[hit]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + WINDOW, -1)
    keep = np.cumsum(edge)[:n] == 0
    counts = np.diff(words.row_first)
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    kept = np.diff(kept_before[words.row_first])
    # kept words with the byte after each turned into a space, but for a row's last one
    last = np.zeros(n, bool)
    ends = kept_before[words.row_first[1:]][kept > 0] - 1
    last[np.flatnonzero(keep)[ends]] = True
    edge = np.zeros(len(chunk.data) + 2, np.int32)
    edge[words.start[keep]] += 1
    stop = words.end[keep] + ~last[keep]
    np.add.at(edge, stop, -1)
    taken = np.cumsum(edge)[:len(chunk.data)] > 0
    data = chunk.data.copy()
    data[words.end[keep & ~last]] = 32
    sizes = np.concatenate([[0], np.cumsum(taken)])[chunk.limits]
    text = pa.LargeStringArray.from_buffers(chunk.rows, pa.py_buffer(sizes.astype(np.int64)),
                                            pa.py_buffer(data[taken].tobytes()))
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(counts, pa.int64()), pa.array(counts - kept, pa.int64()), text.cast(pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_text"])
