"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased runs of letters; a word is framed by start and end marks, and
each language has a 4-gram model over its characters with absolute discounting and
continuation counts in the lower orders. Counts come from all training texts and all of
their n-grams; an n-gram is two integers (two characters of 21 bits each), so no strings move.

A model is stored as sorted arrays of 64-bit n-gram hashes with their log probabilities, and
of context hashes with their log weights of the lower order, per language. They are cut into
blocks of about ``BLOCK_BYTES`` by language and by the character before the last, on which a 4-gram and all
that it backs off to agree: a block scores its n-grams alone. Texts are scored by binary
search in one block after the other, and their sums added up, so a model of any size passes
through a worker in bounded pieces. Only the discounts' floor and the limits of rejection (a few numbers
per language) and one block at a time reach the driver.

A text's cross-entropy is the mean over its characters, its language the one with the
least; a text whose least cross-entropy is above what its language's own training texts
(all of them) show is marked as rejected.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import arrays as A
from quarry.llm.scratch import written
from quarry.operators.quantiles import exact_quantiles

ORDER = 4
#: Hashes and values of one block of a model.
BLOCK_BYTES = 64 << 20
#: Distinct n-grams a task holds before it hands them on.
HELD_GRAMS = 500_000
REJECT_QUANTILE = 0.995
CHUNK_BYTES = 4 << 20
#: Nats per character that count as one unit of confidence.
SHARPNESS = 12.0
START, END = 2, 3
UNDETERMINED = "und"
BITS = 21
MASK = (1 << BITS) - 1
_U = A.U64
_tables: list = []
A.CACHES.append(_tables)


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point of each letter (0: not a letter), and a hash per code point."""
    if not _tables:
        lower = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                small = c.lower()
                lower[i] = ord(small) if len(small) == 1 else i
        _tables.extend([lower, A.mix(np.arange(0x110000, dtype=_U) + _U(1))])
    return _tables[0], _tables[1]


@dataclass
class Letters:
    """Distinct words of a chunk and where they stand."""
    codes: np.ndarray       # lower-case code points of the chunk, 0 between words
    start: np.ndarray       # of each distinct word
    length: np.ndarray
    word: np.ndarray        # index of the distinct word, for every word in order
    row: np.ndarray         # its row


def letters(column: pa.Array, chunk: A.Chunk) -> Letters:
    lower, code_hash = _letter_tables()
    part = column.slice(chunk.first_row, chunk.rows)
    raw = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    limits = np.concatenate([[0], np.cumsum(pc.utf8_length(part).to_numpy(zero_copy_only=False))]).astype(np.int64)
    codes = lower[raw]
    n = len(codes)
    cut = np.zeros(n + 1, bool)
    cut[limits] = True
    inside = codes > 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        nothing = np.zeros(0, np.int64)
        return Letters(codes, nothing, nothing, nothing, nothing)
    prefix = np.zeros(n + 1, _U)
    np.cumsum(code_hash[codes] * A.powers(A._BASE, n), out=prefix[1:])
    h = A.mix((prefix[stop] - prefix[start]) * A.powers(A._BASE_INV, n + 1)[start] ^ ((stop - start).astype(_U) << _U(40)))
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return Letters(codes, start[first], (stop - start)[first], back, np.searchsorted(limits, start, side="right") - 1)


def held_out(key):
    return F.crc32(key.cast("string")) % 4 == 2


def _framed(found: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words with three start marks and an end mark, and their limits."""
    sizes = found.length + ORDER
    limits = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(limits[-1]), START, np.uint32)
    inside = np.arange(found.length.sum()) - np.repeat(np.cumsum(found.length) - found.length, found.length)
    out[np.repeat(limits[:-1] + ORDER - 1, found.length) + inside] = found.codes[np.repeat(found.start, found.length) + inside]
    out[limits[1:] - 1] = END
    return out, limits


def _distinct_grams(codes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 4-grams of framed words (first and last two characters), and the index of each in order."""
    if not len(codes):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    pairs = codes[:-1].astype(np.int64) << BITS | codes[1:]
    place = np.unique(pairs, return_inverse=True)[1]
    first = np.ones(len(codes), bool)
    for k in range(1, ORDER):
        first[limits[1:] - k] = False
    at = np.flatnonzero(first)
    _, where, index = np.unique(place[at] << 32 | place[at + 2], return_index=True, return_inverse=True)
    return pairs[at[where]], pairs[at[where] + 2], index


@dataclass
class Grams:
    """Distinct 4-grams of a chunk (``hi``, ``lo``), the 4-grams of each distinct word in
    order (``spelt``, ``size`` a word), and how often (``n``) a ``row`` holds a ``word``."""
    hi: np.ndarray
    lo: np.ndarray
    spelt: np.ndarray
    size: np.ndarray
    row: np.ndarray
    word: np.ndarray
    n: np.ndarray


def grams_of(column: pa.Array, chunk: A.Chunk) -> Grams:
    found = letters(column, chunk)
    words = max(1, len(found.start))
    pair, n = np.unique(found.row * words + found.word, return_counts=True)
    row, word = np.divmod(pair, words)
    return Grams(*_distinct_grams(*_framed(found)), found.length + 1, row, word, n)


def _added_up(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.r_[True, (np.diff(hi) != 0) | (np.diff(lo) != 0)])
    return hi[first], lo[first], np.add.reduceat(n, first)


def _rows(docs: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    own = F.lit(None).cast("string")
    if lang is not None:
        named = F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(False))
        own = F.when(named, F.col(lang).cast("string"))
    return docs.select(F.col(key).alias("key"), own.alias("own"), F.col(text).cast("string").alias("body"))


def gram_rows(rows: DataFrame) -> DataFrame:
    """(lang, hi, lo, n) over all training texts, added up within tasks."""
    def handed_on(name, parts):
        hi, lo, n = _added_up(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(hi), pa.string()), pa.array(hi), pa.array(lo), pa.array(n)],
                                          names=["lang", "hi", "lo", "n"])

    def run(batches):
        held, size = defaultdict(list), 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("own")).to_pylist()
            column = A.string_column(batch, "body")
            for chunk in A.chunks(column, CHUNK_BYTES):
                g = grams_of(column, chunk)
                names = own[chunk.first_row:chunk.first_row + chunk.rows]
                for name in sorted(set(names)):
                    of = np.array([x == name for x in names])[g.row]
                    words = np.bincount(g.word[of], g.n[of], len(g.size))
                    total = np.bincount(g.spelt, np.repeat(words, g.size), len(g.hi)).astype(np.int64)
                    some = np.flatnonzero(total)
                    if len(some):
                        held[name].append((g.hi[some], g.lo[some], total[some]))
                        size += len(some)
                if size > HELD_GRAMS:
                    held = defaultdict(list, {x: [_added_up(*(np.concatenate(y) for y in zip(*parts)))]
                                              for x, parts in held.items()})
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD_GRAMS // 2:
                        yield from (handed_on(x, parts) for x, parts in held.items())
                        held, size = defaultdict(list), 0
        yield from (handed_on(x, parts) for x, parts in held.items())

    return rows.filter("own IS NOT NULL").mapInArrow(run, "lang string, hi bigint, lo bigint, n bigint")


def discount(n1: int, n2: int) -> float:
    """From the numbers of n-grams seen once and twice."""
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))


class KneserNey:
    """Interpolated Kneser-Ney over one language's 4-gram counts, in plain Python: the
    definition that :class:`Model` is tested against."""

    def __init__(self, grams: dict[str, int]):
        counts: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
        counts[ORDER] = dict(grams)
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
            counts[k] = dict(Counter(g[1:] for g in counts[k + 1]))
        self.counts, self.total, self.kinds, self.discount = counts, [None], [None], [0.0]
        for k in range(1, ORDER + 1):
            total, kinds = defaultdict(int), defaultdict(int)
            for g, n in counts[k].items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            seen = Counter(counts[k].values())
            n1, n2 = seen.get(1, 0), seen.get(2, 0)
            self.total.append(total)
            self.kinds.append(kinds)
            self.discount.append(discount(n1, n2))

    def backoff(self, context: str) -> float:
        """Weight of the lower order after a context (1 where it was not seen)."""
        k = len(context) + 1
        total = self.total[k].get(context, 0)
        return self.discount[k] * self.kinds[k][context] / total if total else 1.0

    def probability(self, gram: str, alphabet: int) -> float:
        if not gram:
            return 1.0 / alphabet
        k, context = len(gram), gram[:-1]
        lower = self.probability(gram[1:], alphabet)
        total = self.total[k].get(context, 0)
        if not total:
            return lower
        return max(self.counts[k].get(gram, 0) - self.discount[k], 0.0) / total + self.backoff(context) * lower


def gram_hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return A.mix(hi.astype(_U) * _U(A._BASE) ^ A.mix(lo.astype(_U) + _U(0x632BE59BD9B4E019)))


def _shorter(hi, lo, k: int):
    """The n-gram of order k without its first character."""
    return (hi & MASK, lo) if k == 4 else (hi * 0, lo) if k == 3 else (hi, lo & MASK)


def _context(hi, lo):
    """The n-gram without its last character."""
    return hi >> BITS, (hi & MASK) << BITS | lo >> BITS


def _spark_context(hi: str, lo: str):
    return (F.shiftright(hi, BITS).alias("hi"),
            F.shiftleft(F.col(hi).bitwiseAND(MASK), BITS).bitwiseOR(F.shiftright(lo, BITS)).alias("lo"))


def _spark_shorter(k: int):
    hi, lo = F.col("hi"), F.col("lo")
    zero = F.lit(0).cast("long")
    return {4: (hi.bitwiseAND(MASK), lo), 3: (zero, lo), 2: (zero, lo.bitwiseAND(MASK))}[k]


@dataclass
class Model:
    """``table``: (block, lang, kind, hashes, scores), one row per sorted array; kind k holds
    n-grams of order k, kind -k the contexts of k characters. Block -1 is part of every block."""
    languages: list[str]
    table: DataFrame | None = None
    blocks: int = 0
    floor: list[float] = field(default_factory=list)   # of an unseen character
    limits: list[float] = field(default_factory=list)

    def block(self, number: int) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The sorted arrays of a block, by language and kind: about BLOCK_BYTES."""
        out: list[dict] = [{} for _ in self.languages]
        rows = self.table.filter(F.col("block").isin(-1, number)).select("lang", "kind", "hashes", "scores")
        for r in rows.toArrow().to_pylist():
            out[r["lang"]][r["kind"]] = np.frombuffer(r["hashes"], "<u8"), np.frombuffer(r["scores"], "<f8")
        return out

    def score(self, arrays: dict, lang: int, hi: np.ndarray, lo: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log probabilities of n-grams of order k in a language."""
        found, out = _looked_up(arrays, k, hi, lo)
        rest = np.flatnonzero(~found)
        if not len(rest):
            return out
        if k == 1:
            out[rest] = self.floor[lang]
            return out
        hi, lo = hi[rest], lo[rest]
        seen, weight = _looked_up(arrays, 1 - k, *_context(hi, lo))
        out[rest] = np.where(seen, weight, 0.0) + self.score(arrays, lang, *_shorter(hi, lo, k), k - 1)
        return out

    def scores(self, block: list[dict], number: int, g: Grams) -> np.ndarray:
        """Per distinct word and language, the sum over those of its 4-grams that are the block's."""
        out = np.zeros((len(g.size), len(self.languages)))
        if len(g.spelt):
            for lang, arrays in enumerate(block):
                if self.blocks == 1:
                    s = self.score(arrays, lang, g.hi, g.lo)
                else:
                    s = np.zeros(len(g.hi))
                    own = np.flatnonzero(((g.lo >> BITS) + 31 * lang) % self.blocks == number)
                    s[own] = self.score(arrays, lang, g.hi[own], g.lo[own])
                out[:, lang] = np.add.reduceat(s[g.spelt], np.cumsum(g.size) - g.size)
        return out


def _looked_up(arrays: dict, kind: int, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, scores = arrays.get(kind, (None, None))
    if hashes is None:
        return np.zeros(len(hi), bool), np.zeros(len(hi))
    h = gram_hash(hi, lo)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return hashes[at] == h, scores[at].copy()


def cross_entropies(rows: DataFrame, model: Model) -> DataFrame:
    """(key, own, entropies) of every text: mean negative log probability per character
    in each language; null without letters."""
    n_languages, kind = len(model.languages), rows.schema["key"].dataType.simpleString()
    if not n_languages:
        return rows.select("key", "own", F.lit(None).cast("array<double>").alias("entropies"))
    marked = rows.select("key", "own", "body", F.xxhash64("body").alias("mark"), F.hash("body").alias("also"))
    sums = []
    plain = Model(model.languages, None, model.blocks, model.floor)
    for number in range(model.blocks):
        arrays = rows.sparkSession.sparkContext.broadcast(model.block(number))

        def run(batches, number=number, arrays=arrays):
            for batch in batches:
                column = A.string_column(batch, "body")
                others = batch.select(["key", "own", "mark", "also"])
                for chunk in A.chunks(column, CHUNK_BYTES):
                    g = grams_of(column, chunk)
                    scores = plain.scores(arrays.value, number, g)
                    total = np.stack([np.bincount(g.row, scores[g.word, j] * g.n, chunk.rows)
                                      for j in range(n_languages)], axis=1)
                    chars = np.bincount(g.row, g.size[g.word] * g.n, chunk.rows).astype(np.int64)
                    ends = pa.array(np.arange(chunk.rows + 1, dtype=np.int32) * n_languages)
                    part = others.slice(chunk.first_row, chunk.rows)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(chars), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))],
                        names=["key", "own", "mark", "also", "chars", "total"])

        sums.append(marked.mapInArrow(run, f"key {kind}, own string, mark bigint, also int, chars bigint, total array<double>"))
    found = sums[0]
    if len(sums) > 1:
        # equal rows have equal sums: each counts once per block, and all of them come back
        every = reduce(DataFrame.unionByName, [written(x, "language-sums") for x in sums])
        each = [F.sum(F.col("total")[i]) for i in range(n_languages)]
        found = every.groupBy("key", "own", "mark", "also", "chars").agg(
            F.array(*each).alias("total"), (F.count(F.lit(1)) / len(sums)).cast("int").alias("copies"))
        found = found.withColumn("total", F.transform("total", lambda x: x / F.col("copies"))).withColumn(
            "one", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return found.select("key", "own", F.when(F.col("chars") > 0, F.transform(
        "total", lambda x: -x / F.col("chars"))).alias("entropies"))


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """Sorted array of one block, language and kind."""
    h = gram_hash(rows["hi"].to_numpy(), rows["lo"].to_numpy())
    order = np.argsort(h)
    one = {c: [rows[c].iloc[0]] for c in ("block", "lang", "kind")}
    return pd.DataFrame(one | {"hashes": [h[order].astype("<u8").tobytes()],
                               "scores": [rows["score"].to_numpy()[order].astype("<f8").tobytes()]})


def count_model(counted: DataFrame, block_bytes: int = BLOCK_BYTES) -> Model:
    """The model, without limits, from (lang, hi, lo, n)."""
    grams = written(counted.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")), "language-grams")
    # a few numbers per language
    languages = sorted(r.lang for r in grams.select("lang").distinct().collect())
    model = Model(languages)
    if not languages:
        return model
    order, facts = {ORDER: grams}, {}
    gram = ["lang", "hi", "lo"]
    for k in range(ORDER, 0, -1):
        n1, n2 = (F.sum(F.when(F.col("n") == x, 1).otherwise(0)) for x in (1, 2))
        cut = F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.when(n1 > 0, n1 / (n1 + 2 * n2)).otherwise(0.5)))
        facts[k] = order[k].groupBy("lang").agg(cut.alias("cut"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        if k > 1:  # continuation counts: distinct left neighbours
            hi, lo = _spark_shorter(k)
            order[k - 1] = written(order[k].groupBy("lang", hi.alias("hi"), lo.alias("lo"))
                                   .agg(F.count(F.lit(1)).alias("n")), "language-grams")
    alphabet = order[1].select("lo").distinct().count() + 1
    ones = {r.lang: r for r in facts[1].collect()}
    model.floor = [float(np.log(r.cut * r.kinds / r["all"] / alphabet)) for r in (ones[x] for x in languages)]
    pieces = []
    # all languages' single characters: probability of those seen
    lower = order[1].join(facts[1], "lang").select(
        *gram, ((F.col("n") - F.col("cut") + F.col("cut") * F.col("kinds") / alphabet) / F.col("all")).alias("p"))
    for k in range(1, ORDER + 1):
        if k > 1:
            hi, lo = _spark_context("hi", "lo")
            contexts = (order[k].groupBy("lang", hi, lo).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
                        .join(facts[k].select("lang", "cut"), "lang")
                        .select(*gram, "total", (F.col("cut") * F.col("kinds") / F.col("total")).alias("weight")))
            contexts = written(contexts, "language-contexts")
            pieces.append(contexts.select(*gram, F.lit(1 - k).alias("kind"), F.ln("weight").alias("score"),
                                          F.col("lo").bitwiseAND(MASK).alias("pivot")))
            (ch, cl), (sh, sl) = _spark_context("hi", "lo"), _spark_shorter(k)
            found = order[k].select("*", ch.alias("ch"), cl.alias("cl"), sh.alias("sh"), sl.alias("sl"))
            found = found.join(contexts.select("lang", F.col("hi").alias("ch"), F.col("lo").alias("cl"), "total", "weight"),
                               ["lang", "ch", "cl"])
            found = found.join(lower.select("lang", F.col("hi").alias("sh"), F.col("lo").alias("sl"), F.col("p").alias("less")),
                               ["lang", "sh", "sl"]).join(facts[k].select("lang", "cut"), "lang")
            lower = found.select(*gram, ((F.col("n") - F.col("cut")) / F.col("total")
                                         + F.col("weight") * F.col("less")).alias("p"))
        lower = written(lower, "language-probabilities")
        pieces.append(lower.select(*gram, F.lit(k).alias("kind"), F.ln("p").alias("score"),
                                   (F.shiftright("lo", BITS) if k > 1 else F.lit(None).cast("long")).alias("pivot")))
    entries = reduce(DataFrame.unionByName, pieces)
    model.blocks = max(1, -(-entries.count() * 16 // block_bytes))
    number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1
    block = F.coalesce(((F.col("pivot") + 31 * number) % model.blocks).cast("int"), F.lit(-1))
    model.table = written(
        entries.select(block.alias("block"), number.alias("lang"), "kind", "hi", "lo", "score")
        .groupBy("block", "lang", "kind").applyInPandas(_packed, "block int, lang int, kind int, hashes binary, scores binary"),
        "language-model")
    return model


def _trained(docs: DataFrame, key: str, text: str, lang: str) -> tuple[Model, DataFrame]:
    """The model, and the cross-entropies of all of ``docs`` in it."""
    rows = _rows(docs, key, text, lang)
    model = count_model(gram_rows(rows))
    found = written(cross_entropies(rows, model), "language-entropies")
    if model.languages:
        place = F.array_position(F.array(*[F.lit(x) for x in model.languages]), F.col("own")).cast("int")
        own = found.filter("own is not null and entropies is not null").select(
            "own", F.element_at("entropies", place).alias("entropy"))
        limit = {r.own: 1.1 * r.value for r in exact_quantiles(own, ["entropy"], [REJECT_QUANTILE], by=["own"]).collect()}
        model.limits = [limit[x] for x in model.languages]
    return model, found


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the languages named in the training rows (those not held out, with
    text and language). No such row gives a model without languages; rows without a key
    train; repeated rows count as often as they occur; there may be any number of languages.

    A language's limit of rejection is 1.1 times the 0.995 quantile of all its training
    texts' cross-entropies; it has at least one, as its letters come from them.
    """
    return _trained(docs, key, text, lang)[0]


def train_and_identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """:func:`identify` of ``docs`` with the model trained on them."""
    model, found = _trained(docs, key, text, lang)
    return _judged(found, model)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1: how far ahead of the other
    languages), cross_entropy (nats per character) and rejected (the text is unlike the
    training texts of every language).

    Null texts and texts without letters are ``und`` with score 0 and rejected; very long
    texts are read whole; equal scores go to the first language by name; repeated rows
    are judged each; an empty table gives no row; other columns are not read.
    """
    return _judged(cross_entropies(_rows(docs, key, text), model), model)


def _judged(found: DataFrame, model: Model) -> DataFrame:
    none, ce = F.col("entropies").isNull(), F.col("entropies")
    least = F.array_min(ce)
    at = F.array_position(ce, least).cast("int")
    score = 1 / F.aggregate(ce, F.lit(0.0), lambda total, x: total + F.exp(-SHARPNESS * (x - least)))
    names, limits = (F.array(*[F.lit(x) for x in xs]) for xs in (model.languages or [UNDETERMINED], model.limits or [0.0]))
    return found.select(
        F.col("key").alias("doc_id"), F.when(none, UNDETERMINED).otherwise(F.element_at(names, at)).alias("lang_pred"),
        F.when(none, 0.0).otherwise(score).alias("score"), least.alias("cross_entropy"),
        (none | F.coalesce(least > F.element_at(limits, at), F.lit(False))).alias("rejected"))
