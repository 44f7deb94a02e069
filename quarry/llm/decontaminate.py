"""Benchmark decontamination by SimHash windows and exact verification.

Items are sorted into window lengths (a ladder of ratio 1.15, the longest that the item
fills). Every document is fingerprinted at these lengths: a 64-bit SimHash of the words
of each window, from running sums of the words' hash bits, at starts a fraction of the
window apart. Item fingerprints are indexed by four 16-bit blocks with all block values
within a quarter of the radius, so any fingerprint within the radius agrees with some
table entry. A fingerprint within the radius is likely, not certain, for a similar
stretch, so each item is indexed by shingles too: a stretch that reaches the threshold
shares at least that part of the item's shingles, hence one of any set that holds more
than the rest; the item's rarest such set is looked up at every word. Windows and shingles
found are verified: around them the best item-sized stretch is sought, and its 5-word
shingles, weighted by their counts, are compared with the item's by generalised Jaccard
similarity.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import arrays as A

SHINGLE = 5
THRESHOLD = 0.75
RADIUS = 15
LADDER = 1.15
#: Starts of windows are at most this share of their length apart.
STRIDE_SHARE = 8
BLOCKS, BLOCK_BITS = 4, 16
LEAD_BITS = 20
#: The benchmark is a query set sent to every task; larger ones are refused.
MAX_ITEMS = 100_000
MAX_ITEM_BYTES = 256 << 20
CHUNK_BYTES = 1 << 20
_U = A.U64


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Hash bits as +1 and -1, one row per word."""
    return (np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            .astype(np.int8) * 2 - 1)


def _sum_type(longest: int):
    """The smallest integers whose differences are exact for windows of so many words."""
    return next(t for t in (np.int8, np.int16, np.int32) if longest <= np.iinfo(t).max)


def _running(hashes: np.ndarray, kind) -> np.ndarray:
    sums = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(_bits(hashes), axis=0, dtype=kind, out=sums[1:])
    return sums


def simhash_windows(sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """SimHashes of the windows from running sums of :func:`_bits` (modulo the range of
    their type, which is exact for the windows that :func:`_sum_type` names it for)."""
    total = np.take(sums, start + length, axis=0)
    total -= np.take(sums, start, axis=0)
    return np.packbits(total > 0, axis=1, bitorder="little").view("<u8").ravel()


def _word_hashes(chunk: A.Chunk):
    folded = A.Chunk(chunk.first_row, A.fold_ascii(chunk.data), chunk.limits)
    words = A.split_words(folded)
    return words, A.span_hashes(folded.data, words.start, words.end)


def _shingles(hashes: np.ndarray) -> np.ndarray:
    k = min(SHINGLE, len(hashes))
    return A.shingle_hashes(hashes, np.array([0, len(hashes)]), k)[0]


class ItemIndex:
    """Fingerprints of the benchmark items by window length, with block tables."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.hashes, self.shingles, self.counts = [], [], [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words, hashes = _word_hashes(A.Chunk(0, raw, np.array([0, len(raw)])))
            if len(hashes):
                self.ids.append(item_id)
                self.hashes.append(hashes)
                self.shingles.append(np.sort(_shingles(hashes)))
                self.counts.append(Counter(self.shingles[-1].tolist()))
        self.lengths = np.array([len(h) for h in self.hashes], np.int64)
        self.marks = np.sort(np.concatenate([np.zeros(1, _U)] + [
            s + A.mix(np.array([i], _U)) for i, s in enumerate(self.shingles)]))
        ladder = [1, 2, 3, 4, 5]
        while ladder[-1] < self.lengths.max(initial=0):
            ladder.append(max(ladder[-1] + 1, int(ladder[-1] * LADDER)))
        self.classes: dict[int, tuple] = {}
        by_length: dict[int, list[int]] = {}
        for i, h in enumerate(self.hashes):
            by_length.setdefault(max(x for x in ladder if x <= len(h)), []).append(i)
        near = [0]
        for flips in range(1, RADIUS // BLOCKS + 1):
            near += [sum(1 << b for b in c) for c in combinations(range(BLOCK_BITS), flips)]
        near = np.array(near, np.int64)
        for length, members in by_length.items():
            prints = []
            for i in members:
                sums = _running(self.hashes[i][:length], _sum_type(length))
                prints.append(simhash_windows(sums, np.zeros(1, np.int64), length)[0])
            prints = np.array(prints, _U)
            tables = []
            for b in range(BLOCKS):
                block = ((prints >> _U(16 * b)) & _U(0xFFFF)).astype(np.int64)
                value = (block[:, None] ^ near[None, :]).ravel()
                owner = np.repeat(np.arange(len(members)), len(near))
                order = np.argsort(value, kind="stable")
                first = np.searchsorted(value[order], np.arange(65537))
                # which values occur is a table of its own: 64 KB, and few windows need the others
                tables.append((np.diff(first) > 0, first, owner[order]))
            self.classes[length] = (np.array(members), prints, tables)
        self._index_shingles()
        #: Leading bits of all items' shingles: most words of a text start none of them.
        self.any_lead = np.zeros(1 << LEAD_BITS, bool)
        for own in self.shingles:
            self.any_lead[own >> _U(64 - LEAD_BITS)] = True

    def _index_shingles(self) -> None:
        """Of each item the shingles that fewest items hold, more than a share of
        1 - THRESHOLD with their counts (items of fewer than five words have windows of
        exactly their length)."""
        holders = Counter(g for c in self.counts for g in c)
        rare, owner = [], []
        for i, counts in enumerate(self.counts):
            if self.lengths[i] < SHINGLE:
                continue
            left = (1 - THRESHOLD) * len(self.shingles[i])
            for g in sorted(counts, key=lambda g: (holders[g], g)):
                if left < 0:
                    break
                rare.append(g)
                owner.append(i)
                left -= counts[g]
        rare, owner = np.array(rare, _U), np.array(owner, np.int64)
        order = np.argsort(rare, kind="stable")
        self.rare, self.rare_owner = rare[order], owner[order]
        #: Which leading bits of a shingle's hash occur: most words are ruled out by them.
        self.rare_lead = np.zeros(1 << LEAD_BITS, bool)
        self.rare_lead[self.rare >> _U(64 - LEAD_BITS)] = True

    def shingle_candidates(self, grams: np.ndarray, row_first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, start, slack) of all stretches that hold an indexed shingle."""
        at = np.flatnonzero(self.rare_lead[grams >> _U(64 - LEAD_BITS)])
        first = np.searchsorted(self.rare, grams[at], side="left")
        n = np.searchsorted(self.rare, grams[at], side="right") - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        item = self.rare_owner[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        row = np.searchsorted(row_first, at, side="right") - 1
        inside = at + SHINGLE <= row_first[row + 1]
        at, row, item = at[inside], row[inside], item[inside]
        # one candidate for all shingles of an item's length of words
        length = self.lengths[item]
        start = row_first[row] + (at - row_first[row]) // length * length
        row, item, start = np.unique(np.stack([row, item, start]), axis=1)
        return row, item, start, self.lengths[item]

    def candidates(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs whose fingerprints are within the radius."""
        members, own, tables = self.classes[length]
        found = []
        blocks = np.ascontiguousarray(prints.astype("<u8", copy=False).view("<u2").reshape(-1, BLOCKS).T)
        for block, (occurs, first, owner) in zip(blocks, tables):
            at = np.flatnonzero(occurs[block])
            if not len(at):
                continue
            value = block[at].astype(np.int64)
            n = first[value + 1] - first[value]
            window = np.repeat(at, n)
            item = owner[np.repeat(first[value] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            close = np.bitwise_count(prints[window] ^ own[item]) <= RADIUS
            found.append(window[close] * len(members) + item[close])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found))
        return pairs // len(members), members[pairs % len(members)]

    def matches(self, chunk: A.Chunk) -> list[tuple[int, int, int, float]]:
        """(row, item, first word, similarity): the best stretch of each item in each row."""
        words, hashes = _word_hashes(chunk)
        n = len(hashes)
        if not n or not self.classes:
            return []
        sums = _running(hashes, _sum_type(max(self.classes)))
        row_first, counts = words.row_first, np.diff(words.row_first)
        found = []
        for length in self.classes:
            stride = max(1, length // STRIDE_SHARE)
            # starts 0, stride, 2 * stride, ... and the last possible one, row by row; a
            # shorter row is one window
            room = np.maximum(counts - length, 0)
            per_row = np.where(counts > 0, -(-room // stride) + 1, 0)
            total = int(per_row.sum())
            rows = np.repeat(np.arange(len(counts)), per_row)
            step = np.arange(total) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            start = row_first[rows] + np.minimum(step * stride, room[rows])
            span = np.minimum(length, counts[rows])
            window, item = self.candidates(length, simhash_windows(sums, start, span))
            found.append(np.stack([rows[window], item, start[window], np.full(len(window), stride)]))
        grams = (A.shingle_hashes(hashes, np.array([0, n]), SHINGLE)[0] if n >= SHINGLE
                 else np.zeros(0, _U))
        found.append(np.stack(self.shingle_candidates(grams, row_first)))
        rows, item, start, slack = np.concatenate(found, axis=1)
        may = self._enough_in_common(grams, row_first, rows, item, start, slack)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for row, i, at, stride in zip(*(x[may].tolist() for x in (rows, item, start, slack))):
            similarity, at = self._verify(hashes, int(row_first[row]), int(row_first[row + 1]), at, i, stride)
            if similarity >= THRESHOLD and similarity > best.get((row, i), (0.0, 0))[0]:
                best[row, i] = (similarity, at - int(row_first[row]))
        return [(row, i, at, s) for (row, i), (s, at) in sorted(best.items())]

    def _enough_in_common(self, grams, row_first, rows, item, start, slack) -> np.ndarray:
        """Candidates around which enough shingles of the item stand to reach the threshold
        (all of them at once; items of fewer than five words pass)."""
        if not len(rows) or not len(grams):
            return np.ones(len(rows), bool)
        lo = np.maximum(row_first[rows], start - slack)
        hi = np.minimum(row_first[rows + 1], start + slack + self.lengths[item]) - SHINGLE + 1
        n = np.maximum(np.minimum(hi, len(grams)) - lo, 0)
        needed, small = THRESHOLD * (self.lengths[item] - SHINGLE + 1), self.lengths[item] < SHINGLE
        # a bound first: shingles of any item, counted once for the chunk
        known = np.concatenate([[0], np.cumsum(self.any_lead[grams >> _U(64 - LEAD_BITS)])])
        lo = np.minimum(lo, len(grams))
        may = np.flatnonzero((known[lo + n] - known[lo] >= needed) & ~small)
        lo, n, item = lo[may], n[may], item[may]
        ends = np.cumsum(n)
        at = np.repeat(lo - (ends - n), n) + np.arange(n.sum())
        mark = grams[at] + A.mix(item.astype(_U))[np.repeat(np.arange(len(item)), n)]
        inside = self.marks[np.minimum(np.searchsorted(self.marks, mark), len(self.marks) - 1)] == mark
        hits = np.diff(np.concatenate([[0], np.cumsum(inside)])[np.concatenate([[0], ends])])
        small[may] = hits >= needed[may]
        return small

    def _verify(self, hashes, lo, hi, start, item, slack) -> tuple[float, int]:
        """Similarity and first word of the best item-sized stretch that starts within
        ``slack`` words of ``start``, inside words lo..hi."""
        n = len(self.hashes[item])
        a, b = max(lo, start - slack), min(hi, start + slack + n)
        k = min(SHINGLE, n)
        if b - a < k:
            return 0.0, start
        grams = A.shingle_hashes(hashes[a:b], np.array([0, b - a]), k)[0]
        own = self.shingles[item]
        inside = own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams
        size = min(n - k + 1, len(grams))
        running = np.concatenate([[0], np.cumsum(inside)])
        hits = running[size:] - running[:-size]
        if hits.max() < THRESHOLD * len(own):
            return 0.0, start
        shared = grams[inside]
        if len(np.unique(shared)) < len(shared):  # a repeated one counts as often as in the item
            hits = self._in_common(grams, inside, size, self.counts[item])
        at = int(np.argmax(hits))
        low = int(hits[at])
        return low / (len(own) + size - low), a + at

    @staticmethod
    def _in_common(grams, inside, size, counts) -> np.ndarray:
        """Shingles in common with the item, with counts, of every stretch of that size."""
        mine, low, out = Counter(), 0, []
        grams, inside = grams.tolist(), inside.tolist()
        for i, g in enumerate(grams):
            if inside[i]:
                mine[g] += 1
                low += mine[g] <= counts[g]
            if i >= size and inside[i - size]:
                gone = grams[i - size]
                low -= mine[gone] <= counts[gone]
                mine[gone] -= 1
            if i >= size - 1:
                out.append(low)
        return np.array(out)


def item_index(items: DataFrame, key: str = "item_id", text: str = "text") -> ItemIndex:
    """The index of a benchmark table, whose size is checked before it is fetched."""
    rows = items.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    if n > MAX_ITEMS or (size or 0) > MAX_ITEM_BYTES:
        raise ValueError(f"{n} benchmark items of {size} bytes: split the query set")
    return ItemIndex([(r.k, r.t) for r in rows.collect()])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, similarity) for every document that holds a stretch
    similar (0.75 or more) to a benchmark item, with the best such stretch.

    Letters A-Z are folded. Null and empty texts or items match nothing; an item of
    fewer than five words is one shingle; repeated rows are reported each; a null key
    stays null; an empty table on either side gives no row; other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(item_index(items))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("body"))

    def run(batches):
        found = index.value
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for chunk in A.chunks(A.string_column(batch, "body"), CHUNK_BYTES):
                hits = found.matches(chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[chunk.first_row + h[0]] for h in hits], pa.int64()),
                     pa.array([found.ids[h[1]] for h in hits], pa.int64()),
                     pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.float64())],
                    names=["doc_id", "item_id", "first_word", "similarity"])

    return rows.mapInArrow(A.tidy(run), "doc_id bigint, item_id bigint, first_word bigint, similarity double")


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that :func:`leaks` reports; decided row
    by row where the row is read, so nothing is shuffled."""
    index = docs.sparkSession.sparkContext.broadcast(item_index(items))

    def run(batches):
        found = index.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for chunk in A.chunks(A.string_column(batch, text), CHUNK_BYTES):
                for hit in found.matches(chunk):
                    keep[chunk.first_row + hit[0]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(A.tidy(run), docs.schema)
