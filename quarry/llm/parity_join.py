"""Exact n-gram Jaccard join on parity sketches.

A document is its set of distinct word 5-grams. If two sets reach the threshold,
their symmetric difference is at most d = floor(n * (1 - t) / t) for either size n.

* Sizes fall into bands (64, 256, 1024, ... shingles). In a band every shingle hash
  belongs to one of G blocks, and a block is sketched by the XOR of its shingles'
  hashes: each shingle of the symmetric difference changes one block, so at most d
  blocks differ. A document that could have a partner in the next band is sketched
  for it too.
* By the pigeonhole principle, with blocks put in an order that depends on their
  content alone, two linked documents share one of their first d + 1 blocks.
  Blocks with many shingles come first and blocks that hold a frequent shingle
  last, so that passages shared by many documents seldom bring strangers together.
* Equal sets are links at once, and the least document stands for all of them.
* Documents with an equal block are compared with its first document (star). A star
  leaves those groups undecided whose members are not all in one component. Each member meets
  the hub of other components that shares most groups with it, which gathers near copies of one
  text without all their pairs. Members of groups that are undecided after that
  meet by the pigeonhole principle a second time, now on single shingles, rarest first: of
  two linked sets of n <= m, the least common shingle is one of the first n / 7 + 1 of the
  smaller and the first m / 4 + 1 of the larger. Documents on one template whose
  remainders differ so never form pairs, however many they are.
* A candidate whose parity sketches have too large a Hamming distance (a lower bound of
  the symmetric difference) is no link. Sketches hold two bits or more per shingle, so
  that only pairs close to the threshold are left.
* Those are verified by exact intersection of shingle sets. Which texts that takes is
  told by a bitmap of their keys, so that no text is shuffled.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import arrays as A
from quarry.llm.components import components, extended, named
from quarry.llm.scratch import written

WORDS_PER_SHINGLE = 5
THRESHOLD = Fraction(3, 4)
FIRST_EDGE = 64
#: Bits of the parity sketch of a small set; larger sets have a power of two, 2 to 4 a shingle.
SKETCH_BITS = 1024
#: Bits of the bitmap of keys whose sets are wanted: 8 MB. Where it fills up, more sets
#: than wanted are built, and the joins drop them.
KEY_BITS = 1 << 26
#: Frequent shingles kept for the order of blocks; any choice gives the same links.
FREQUENT_SHINGLES = 1 << 16
#: A shingle is frequent if it is in so large a share of the texts of some chunk.
FREQUENT_SHARE = 0.01

#: Cells of the counts by which undecided documents' shingles are ordered: 8 MB, whatever the
#: input. Any counts give the same links. A task's counts move in rows of so many cells.
COUNT_CELLS = 1 << 20
CELLS_A_ROW = 1 << 10

#: How often undecided documents meet another hub of their groups before all that are left
#: meet each other. Any number gives the same components.
HUB_ROUNDS = 1

#: Text a worker handles at a time: with its hashes about 60 bytes for each of them.
CHUNK_BYTES = 1 << 20

_U = A.U64


def shingle_sets(chunk: A.Chunk, k: int = WORDS_PER_SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row, ASCII letters folded; with fewer
    than ``k`` words the whole sequence is the one shingle, without words none."""
    folded = A.Chunk(chunk.first_row, A.fold_ascii(chunk.data), chunk.limits)
    words = A.split_words(folded)
    hashes = A.span_hashes(folded.data, words.start, words.end)
    grams, first = A.shingle_hashes(hashes, words.row_first, k)
    counts = np.diff(words.row_first)
    sets = []
    for r in range(chunk.rows):
        if counts[r] >= k:
            s = np.sort(grams[first[r]:first[r + 1]])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif counts[r]:
            own = hashes[words.row_first[r]:words.row_first[r + 1]]
            run = _U(0)
            with np.errstate(over="ignore"):
                for h in own:
                    run = run * _U(A._BASE) + h
            s = A.mix(A.mix(np.array([run], _U)) ^ _U(counts[r]))
        else:
            s = np.zeros(0, _U)
        sets.append(s)
    return sets


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities, SKETCH_BITS or 2 to 4 a shingle: every shingle flips one bit."""
    bits = max(SKETCH_BITS, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else SKETCH_BITS
    place = (A.mix(shingles ^ _U(0x5851F42D4C957F2D)) & _U(bits - 1)).astype(np.int64)
    parity = np.bincount(place, minlength=bits).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view("<i8")


def largest_difference(n: int, t: Fraction = THRESHOLD) -> int:
    return int(n * (1 - t) / t)


def largest_loss(n: int, t: Fraction = THRESHOLD) -> int:
    """How many of n shingles a linked set can lack."""
    return int(n * (1 - t))


def _bands(n: int, t: Fraction) -> list[tuple[int, int]]:
    """(band number, number of blocks) to sketch a set of n shingles for; 0 blocks: each
    shingle is a block."""
    band, edge = 0, FIRST_EDGE
    while n >= edge:
        band, edge = band + 1, edge * 4
    found = [(band, edge)]
    if n >= edge * t:
        found.append((band + 1, edge * 4))
    return [(b, 0 if b == 0 else e * 3 // 4) for b, e in found]


def block_signatures(shingles: np.ndarray, frequent: np.ndarray, t: Fraction = THRESHOLD) -> np.ndarray:
    """Signatures of the first d + 1 blocks of each band of a sorted shingle set;
    ``frequent`` marks shingles that are common in the corpus."""
    n, out = len(shingles), []
    if not n:
        return np.zeros(0, _U)
    own = A.mix(shingles ^ _U(0xA0761D6478BD642F))
    for band, blocks in _bands(n, t):
        if blocks:
            block = ((shingles >> _U(32)) * _U(blocks)) >> _U(32)  # ascending, as shingles are
            at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            parity = np.bitwise_xor.reduceat(own, at)
            size = np.diff(np.append(at, n))
            common = np.logical_or.reduceat(frequent, at)
            block = block[at]
        else:
            parity, size, common, block = own, np.ones(n, np.int64), frequent, np.zeros(n, _U)
        signature = A.mix(parity + block * _U(0x9E3779B97F4A7C15) + _U(band + 1))
        order = ((common.astype(_U) << _U(63)) | ((_U(255) - np.minimum(size, 255).astype(_U)) << _U(55))
                 | (signature >> _U(9)))
        first = largest_difference(n, t) + 1
        out.append(signature if len(signature) <= first else signature[np.argpartition(order, first - 1)[:first]])
    return np.concatenate(out)


FACTS = ("doc_id bigint, n_shingles bigint, set_sum bigint, set_xor bigint, sketch array<bigint>, "
         "frequent array<bigint>")


def document_facts(docs: DataFrame) -> DataFrame:
    """Per row of (key, body): size, identity and parity sketch of its shingle set. The
    first row of a chunk also carries the shingles that are frequent in the chunk."""
    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for chunk in A.chunks(A.string_column(batch, "body"), CHUNK_BYTES):
                sets = shingle_sets(chunk)
                every, count = np.unique(np.concatenate(sets), return_counts=True)
                often = every[count >= max(4, FREQUENT_SHARE * chunk.rows)].view(np.int64)
                marked = [A.mix(s ^ _U(0x8EBC6AF09C88C6E3)) for s in sets]
                sketches = [parity_sketch(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    keys.slice(chunk.first_row, chunk.rows),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([m.sum(dtype=_U) for m in marked], _U).view(np.int64)),
                    pa.array(np.array([np.bitwise_xor.reduce(m) if len(m) else 0 for m in marked], _U).view(np.int64)),
                    pa.array(sketches, pa.list_(pa.int64())),
                    pa.array([often] + [None] * (chunk.rows - 1), pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "set_sum", "set_xor", "sketch", "frequent"])
    return docs.mapInArrow(A.tidy(run), FACTS)


def frequent_shingles(facts: DataFrame) -> np.ndarray:
    """At most FREQUENT_SHINGLES hashes, sorted: half a megabyte, whatever the input."""
    rows = (facts.select(F.explode("frequent").alias("h")).groupBy("h").count()
            .orderBy(F.desc("count"), "h").limit(FREQUENT_SHINGLES).select("h").collect())
    return np.sort(np.array([r.h for r in rows], np.int64).view(_U))


def _key_places(keys: np.ndarray) -> np.ndarray:
    return (A.mix(keys.view(_U)) & _U(KEY_BITS - 1)).astype(np.int64)


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """One bit for every key (the only column, a bigint) at its place among KEY_BITS."""
    def run(batches):
        for batch in batches:
            place = np.unique(_key_places(batch.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(np.left_shift(1, place & 63))],
                                             names=["word", "bits"])
    words = keys.mapInArrow(A.tidy(run), "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()
    bitmap = np.zeros(KEY_BITS // 64, np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bitmap


def _wanted_sets(batches, bitmap):
    """(keys, shingle sets) of the rows whose keys are in the bitmap, chunk by chunk."""
    for batch in batches:
        place = _key_places(batch.column(0).to_numpy(zero_copy_only=False))
        batch = batch.filter(pa.array((bitmap[place >> 6] >> (place & 63)) & 1 == 1))
        keys = batch.column(0)
        for chunk in A.chunks(A.string_column(batch, "body"), CHUNK_BYTES):
            yield keys.slice(chunk.first_row, chunk.rows), shingle_sets(chunk)


def signature_rows(docs: DataFrame, frequent: np.ndarray, wanted: DataFrame) -> DataFrame:
    """(signature, doc_id, hub) of the rows (key, body) whose keys are ``wanted`` (and perhaps of
    a few others): the first document of a chunk with a signature leads the chunk's others,
    which are already tied to it (hub). A leader's hub is itself, null if it leads none."""
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted))

    def run(batches):
        for keys, sets in _wanted_sets(batches, bitmap.value):
            flat = np.concatenate(sets)
            if not len(flat):
                continue
            common = np.zeros(len(flat), bool)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
                common = frequent[at] == flat
            ends = np.cumsum([len(s) for s in sets])
            found = [block_signatures(s, common[e - len(s):e]) for s, e in zip(sets, ends)]
            doc = np.repeat(keys.to_numpy(zero_copy_only=False), [len(f) for f in found])
            signature = np.concatenate(found)
            _, first, back, held = np.unique(signature, return_index=True, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(signature.view(np.int64)), pa.array(doc, pa.int64()),
                pa.array(doc[first][back], pa.int64(), mask=held[back] == 1),
            ], names=["signature", "doc_id", "hub"])
    return docs.mapInArrow(A.tidy(run), "signature bigint, doc_id bigint, hub bigint")


def signature_groups(rows: DataFrame) -> DataFrame:
    """(signature, hub, doc_id, many) of every document of ``signature_rows`` but the hubs of whole
    groups, the least leaders. Not ``many``: the two are the whole group. A group that goes
    on in another Arrow batch keeps its hub. Only leaders are dealt by signature, so that one
    held by a large share of all documents meets in one task with one row per chunk."""
    def run(batches):
        last, least = None, 0
        for batch in batches:
            signature, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            alone = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            hub = np.where(alone, doc, batch.column(2).fill_null(0).to_numpy(zero_copy_only=False))
            tied = hub != doc
            parts = [(signature[tied], hub[tied], doc[tied], np.ones(tied.sum(), bool))]
            if not tied.all():
                signature, doc, alone = signature[~tied], doc[~tied], alone[~tied]
                start = np.flatnonzero(np.concatenate([[True], signature[1:] != signature[:-1]]))
                size = np.diff(np.append(start, len(doc)))
                hubs = np.minimum.reduceat(doc, start)
                many = (size > 2) | ~np.logical_and.reduceat(alone, start)
                many[[0, -1]] = True  # may go on in other batches
                if signature[0] == last:
                    hubs[0] = least
                last, least = signature[-1], hubs[-1]
                hub = np.repeat(hubs, size)
                rest = hub != doc
                parts.append((signature[rest], hub[rest], doc[rest], np.repeat(many, size)[rest]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)],
                                             names=["signature", "hub", "doc_id", "many"])
    lane = F.when(F.col("hub") != F.col("doc_id"), F.col("doc_id"))
    return (rows.repartition("signature", lane).sortWithinPartitions("signature")
            .mapInArrow(A.tidy(run), "signature bigint, hub bigint, doc_id bigint, many boolean"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the rows (key, body) whose keys are ``wanted``, and perhaps a few others."""
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted))

    def run(batches):
        for keys, sets in _wanted_sets(batches, bitmap.value):
            yield pa.RecordBatch.from_arrays([
                keys, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "shingles"])
    return docs.mapInArrow(A.tidy(run), "doc_id bigint, shingles array<bigint>")


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (A.mix(shingles ^ _U(0x2545F4914F6CDD1D)) & _U(COUNT_CELLS - 1)).astype(np.int64)


def shingle_counts(docs: DataFrame, bitmap) -> np.ndarray:
    """How often the shingles of each cell occur in the rows (key, body) of the bitmap's keys."""
    def count(batches):
        total = np.zeros(COUNT_CELLS, np.int64)
        for _, sets in _wanted_sets(batches, bitmap.value):
            total += np.bincount(_cells(np.concatenate(sets)), minlength=COUNT_CELLS)
        yield from packed({i: row for i, row in enumerate(total.reshape(-1, CELLS_A_ROW)) if row.any()})

    def add(batches):
        total = {}
        for batch in batches:
            for i, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(cells, np.int64)
        yield from packed(total)

    def packed(rows):
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()),
                                              pa.array([r.tobytes() for r in rows.values()], pa.binary())],
                                             names=["row", "cells"])
    form = "row bigint, cells binary"
    found = docs.mapInArrow(A.tidy(count), form).repartition("row").mapInArrow(A.tidy(add), form).toArrow()
    total = np.zeros((COUNT_CELLS // CELLS_A_ROW, CELLS_A_ROW), np.int64)
    for i, cells in zip(found["row"].to_pylist(), found["cells"].to_pylist()):
        total[i] = np.frombuffer(cells, np.int64)
    return total.ravel()


def rarest_shingles(docs: DataFrame, wanted: DataFrame, t: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, n, shingles): the first floor(n (1 - t)) + 1 shingles of each row (key, body)
    whose key is ``wanted`` (and perhaps of a few others), rarest among them first."""
    sc = docs.sparkSession.sparkContext
    bitmap = sc.broadcast(key_bitmap(wanted))
    holders = sc.broadcast(shingle_counts(docs, bitmap))

    def run(batches):
        for keys, sets in _wanted_sets(batches, bitmap.value):
            kept = [s[np.lexsort((s, holders.value[_cells(s)]))[:largest_loss(len(s), t) + 1]] for s in sets]
            yield pa.RecordBatch.from_arrays([
                keys, pa.array([len(s) for s in sets], pa.int64()),
                pa.array([k.view(np.int64) for k in kept], pa.list_(pa.int64())),
            ], names=["doc_id", "n", "shingles"])
    return docs.mapInArrow(A.tidy(run), "doc_id bigint, n bigint, shingles array<bigint>")


def pairs_apart(docs: DataFrame, members: DataFrame, t: Fraction = THRESHOLD) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, among ``members`` (doc_id, component) of different
    components: every link between two of them is one. A pair is met where the smaller set
    probes with its first floor(n (1 - t) / (1 + t)) + 1 shingles, and only where what follows
    their shingle suffices for the threshold."""
    rows = written(rarest_shingles(docs, members.select("doc_id"), t).join(members, "doc_id"), "rarest-shingles")

    def side(x: str, shingles: Column) -> DataFrame:
        return rows.select(*(F.col(c).alias(c + x) for c in ("doc_id", "component", "n")),
                           F.posexplode(shingles).alias("place" + x, "shingle"))

    # |A & B| >= (n + m) t / (1 + t), all of it at the least common shingle's place or behind
    share = t.numerator, t.denominator + t.numerator
    needed = (F.col("n_a") + F.col("n_b")) * share[0]
    probes = F.slice("shingles", F.lit(1), F.expr(f"int(n * {t.denominator - t.numerator} div {share[1]}) + 1"))
    return (side("_a", probes).join(side("_b", F.col("shingles")), "shingle")
            .filter("component_a <> component_b AND (n_a < n_b OR (n_a = n_b AND doc_id_a < doc_id_b))")
            .filter((F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * share[1] >= needed))
            .select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))
            .distinct())


def _reaches(shared, n, m, t: Fraction = THRESHOLD):
    return shared * t.denominator >= (n + m - shared) * t.numerator


def _facts_of(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    side = facts.select("doc_id", F.struct("n_shingles", "set_sum", "set_xor", "sketch").alias("f"))
    return (pairs.join(side.select(F.col("doc_id").alias("a"), F.col("f").alias("fa")), "a")
            .join(side.select(F.col("doc_id").alias("b"), F.col("f").alias("fb")), "b"))


def _as_long(sketch: Column, other: Column) -> Column:
    """The sketch, folded once where the other one is shorter."""
    n = F.size(other)
    return F.when(F.size(sketch) > n, F.zip_with(
        F.slice(sketch, F.lit(1), n), F.slice(sketch, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(sketch)


def _distance() -> Column:
    """Hamming distance of two sketches; sizes that allow a link are at most one fold apart."""
    a, b = F.col("fa.sketch"), F.col("fb.sketch")
    return F.aggregate(F.zip_with(_as_long(a, b), _as_long(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda total, x: total + x)


def _not_ruled_out(apart: Column) -> Column:
    """Sizes and the distance of the parity sketches leave a link possible."""
    small = F.least("fa.n_shingles", "fb.n_shingles")
    large = F.greatest("fa.n_shingles", "fb.n_shingles")
    t = THRESHOLD
    # |A ^ B| <= (|A| + |B|) (1 - t) / (1 + t)
    allowed = (F.col("fa.n_shingles") + F.col("fb.n_shingles")) * (t.denominator - t.numerator)
    return ((small * t.denominator >= large * t.numerator)
            & (apart * (t.denominator + t.numerator) <= allowed))


def verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct candidate ``pairs`` (a, b) that are links. Equal sets are
    links at once; texts are read again only for the others."""
    known = written(_facts_of(pairs, facts).filter(_not_ruled_out(_distance())).select(
        "a", "b", F.col("fa.n_shingles").alias("n"), F.col("fb.n_shingles").alias("m"),
        ((F.col("fa.n_shingles") == F.col("fb.n_shingles")) & (F.col("fa.set_sum") == F.col("fb.set_sum"))
         & (F.col("fa.set_xor") == F.col("fb.set_xor"))).alias("same")), "candidates")
    open_pairs = known.filter(~F.col("same"))
    ends = open_pairs.select("a").union(open_pairs.select("b"))
    sets = written(sets_of(docs.select("key", "body"), ends), "shingle-sets")
    both = (open_pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return known.filter("same").select("a", "b").union(
        both.filter(_reaches(shared, F.col("n"), F.col("m"))).select("a", "b"))


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(signature, doc_id, component) of group members; a document without a link is its own."""
    return members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "signature", "doc_id", F.coalesce("component", "doc_id").alias("component"))


def hub_pairs(placed: DataFrame, lane: int) -> DataFrame:
    """One pair (a, b) at most for each document of (signature, doc_id, component): with the hub
    of another component that it shares most groups with. A group's hub is, of the members that
    hash to ``lane`` of HUB_ROUNDS, the one in most groups: of near copies one with few changes."""
    groups = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("groups"))
    some = placed.filter(F.pmod(F.xxhash64("doc_id"), F.lit(HUB_ROUNDS)) == lane).join(groups, "doc_id")
    hubs = some.groupBy("signature").agg(F.max(F.struct("groups", "doc_id", "component")).alias("hub"))
    return (placed.join(hubs, "signature").filter("component <> hub.component")
            .groupBy("doc_id", F.col("hub.doc_id").alias("hub")).agg(F.count(F.lit(1)).alias("shared"))
            .groupBy("doc_id").agg(F.max(F.struct("shared", "hub")).alias("best"))
            .select(F.least("doc_id", "best.hub").alias("a"), F.greatest("doc_id", "best.hub").alias("b")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable
    by links of Jaccard similarity 0.75 or more on distinct word 5-grams, itself included)
    and in_component (whether it has a link).

    Null and empty texts have no shingles and no link. Rows that repeat a key are one
    document (the least text stands for it). Rows without a key are returned with a
    null component. An empty table gives no row; other columns are not read.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("body"))
    facts = written(document_facts(rows), "shingle-facts")
    if facts.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        rows = (rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("body").alias("body"))
                .union(rows.filter("key IS NULL")))
        facts = written(document_facts(rows), "shingle-facts")
    keyed = rows.filter("key IS NOT NULL")
    with_facts = facts.filter("doc_id IS NOT NULL")
    # equal sets are links; the least document stands for all
    same = ["n_shingles", "set_sum", "set_xor"]
    ids = with_facts.filter("n_shingles > 0").select("doc_id", *same)
    copies = written(ids.join(ids.groupBy(same).agg(F.min("doc_id").alias("a")), same).select(
        "a", F.col("doc_id").alias("b")), "equal-sets")
    groups = written(signature_groups(signature_rows(keyed, frequent_shingles(facts), copies.filter("a = b").select("a"))),
                     "signature-groups")
    order = (F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b"))
    stars = written(groups.select(*order).distinct(), "star-pairs")
    links = verified(stars, with_facts, keyed).union(copies.filter("a < b"))
    found = written(components(links, "a", "b"), "star-components")

    # groups that the stars leave in several components; those of the very same pairs are one
    apart = named(stars, found).select("a", "b", F.lit(1).alias("apart"))
    several = groups.filter("many")
    mixed = (several.select("signature", *order).join(apart, ["a", "b"], "left").groupBy("signature").agg(
        F.count(F.lit(1)).alias("pairs"), F.max("apart").alias("apart"),
        F.bit_xor(F.xxhash64("a", "b")).alias("who"), F.bit_xor(F.xxhash64("b", "a")).alias("also"))
        .filter("pairs > 1 AND apart = 1")
        .groupBy("pairs", "who", "also").agg(F.min("signature").alias("signature")).select("signature"))
    undecided = written(several.join(mixed, "signature", "left_semi").select("signature", "hub", "doc_id"),
                        "undecided-groups")
    if undecided.limit(1).count():
        members = undecided.select("signature", "doc_id").union(
            undecided.select("signature", F.col("hub").alias("doc_id"))).distinct()
        placed = written(_placed(members, found), "undecided-members")
        tried = stars
        for i in range(HUB_ROUNDS):
            pairs = written(hub_pairs(placed, i).join(tried, ["a", "b"], "left_anti"), "hub-pairs")
            links = written(verified(pairs, with_facts, keyed), "hub-links")
            tried = tried.union(pairs)
            if links.limit(1).count():
                found = written(extended(found, links), "hub-components")
                placed = _placed(placed.select("signature", "doc_id"), found)
                still = placed.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                placed = written(placed.join(still.filter("lo < hi").select("signature"), "signature", "left_semi"),
                                 "undecided-members")
        left = written(placed.select("doc_id", "component").distinct(), "undecided")
        rest = written(pairs_apart(keyed, left).join(tried, ["a", "b"], "left_anti"), "rest-pairs")
        more = written(verified(rest, with_facts, keyed), "rest-links")
        if more.limit(1).count():
            found = extended(found, more)
    return facts.join(found, facts.doc_id == found.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.col("node").isNotNull().alias("in_component"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller key (rows without a
    key, empty texts and all columns stay)."""
    found = near_duplicates(docs, key, text).filter("component_id < doc_id").select(
        F.col("doc_id").alias("dropped_key"))
    return docs.join(found, docs[key].cast("bigint") == found.dropped_key, "left_anti")
