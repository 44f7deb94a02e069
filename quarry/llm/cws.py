"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by their counts. For sample i every word draws
r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from a hash of (word, i) alone; with weight S

    t = floor(ln S / r + beta),   a = c * exp(-r * (t - beta + 1)),

and the word with the least a is the sample, recorded as a hash of (word, t). Two
texts agree on a sample with probability sum(min(S, S')) / sum(max(S, S')), the
generalised Jaccard similarity, so the share of equal samples estimates it.

Everything is built-in column expressions: words are counted per text by a hash
aggregate on word hashes, and every sample is one ``min`` over packed longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.ordering import dealt_by_range, following
from quarry.llm.scratch import written

SAMPLES = 32
#: Samples computed side by side in one row; the others are rows of their own.
LANES = 8
_ID_MASK = 0x7FFFFFFF


def sample_column(word: Column, log_weight: Column, i: Column) -> Column:
    """The i-th sample of one weighted word as a long whose order is that of a:
    a quantised ln a above, 31 bits of the hash of (word, t) below. A Gamma(2, 1)
    draw is minus the logarithm of a product of two uniform ones."""
    def uniform(h: Column, low: int, n: int) -> Column:
        part = F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << n) - 1))
        return (part + F.lit(0.5)) * F.lit(2.0 ** -n)

    h, g = F.xxhash64(word, i), F.xxhash64(i, word)
    r = -F.log(uniform(h, 0, 32) * uniform(h, 32, 32))
    c = -F.log(uniform(g, 0, 21) * uniform(g, 21, 21))
    beta = uniform(g, 42, 22)
    t = F.floor(log_weight / r + beta)
    log_a = F.log(c) - r * (t - beta + F.lit(1.0))
    place = F.greatest(F.lit(0.0), (log_a + F.lit(96.0)) * F.lit(2.0 ** 24)).cast("bigint")
    return F.shiftleft(place, 32).bitwiseOR(F.xxhash64(g, t).bitwiseAND(F.lit(_ID_MASK)))


def spaces_to_blanks(text: Column) -> Column:
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def count_words(parts: DataFrame, keys: list[str], part: str, text: str,
                versions: dict[str, Column]) -> DataFrame:
    """Per key and distinct word hash the number of occurrences in each version: the
    rows of ``parts`` for which its condition on ``part`` holds."""
    words = (parts.select(*keys, part, F.explode(F.split(spaces_to_blanks(F.col(text)), " ")).alias("w"))
             .filter(F.col("w") != "").select(*keys, part, F.xxhash64("w").alias("word")))
    return words.groupBy(*keys, "word").agg(
        *[F.count(F.when(c, 1)).alias(v) for v, c in versions.items()])


def sample_versions(counts: DataFrame, keys: list[str], versions: list[str], samples: int) -> DataFrame:
    """Per key one array of samples for every version (a column of counts). A word
    that weighs the same in all versions is sampled once."""
    if samples % LANES:
        raise ValueError(f"samples must be a multiple of {LANES}")
    every = (1 << len(versions)) - 1
    weights = F.array(*[F.struct(F.col(v).alias("n"), F.lit(1 << k).alias("mask"))
                        for k, v in enumerate(versions)])
    shared = F.array(F.struct(F.col(versions[0]).alias("n"), F.lit(every).alias("mask")))
    if len(versions) > 1:
        equal = F.lit(True)
        for v in versions[1:]:
            equal = equal & (F.col(v) == F.col(versions[0]))
        weights = F.when(equal, shared).otherwise(weights)
    rows = counts.select(*keys, "word", F.explode(weights).alias("weight")).filter(F.col("weight.n") > 0)
    rows = rows.select(*keys, "word", F.log(F.col("weight.n").cast("double")).alias("log_weight"),
                       F.col("weight.mask").alias("mask"),
                       F.explode(F.array(*[F.lit(b) for b in range(samples // LANES)])).alias("block"))
    lanes = rows.select(*keys, "block", "mask", *[
        sample_column(F.col("word"), F.col("log_weight"), F.col("block") * LANES + k).alias(f"p{k}")
        for k in range(LANES)])
    least = lanes.groupBy(*keys, "block").agg(*[
        F.min(F.when(F.col("mask").bitwiseAND(1 << j) != 0, F.col(f"p{k}"))).alias(f"{v}_{k}")
        for j, v in enumerate(versions) for k in range(LANES)])
    blocks = least.select(*keys, F.struct("block", *[
        F.array(*[F.col(f"{v}_{k}").bitwiseAND(F.lit(_ID_MASK)).cast("int") for k in range(LANES)]).alias(v)
        for v in versions]).alias("b"))
    # at most samples / LANES rows per key
    ordered = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return ordered.select(*keys, *[
        F.when(F.col("bs")[0][v][0].isNotNull(), F.flatten(F.col(f"bs.{v}"))).alias(v) for v in versions])


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per key: ``samples`` as an array of ints.

    Rows with equal keys (null is a key too) are one text, their words pooled; texts
    without words, empty and null ones included, have no row; an empty table gives
    none; columns other than the keys and the text are not read. If the input is
    already dealt by (part of) the keys, nothing is shuffled.
    """
    named = texts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
                         F.lit(0).alias("part"), F.col(text).alias("text"))
    own = [f"k{i}" for i in range(len(keys))]
    counts = count_words(named, own, "part", "text", {"samples": F.lit(True)})
    return sample_versions(counts, own, ["samples"], samples).select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "samples")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; texts without words are alike (1) and unlike all others (0)."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0)
            .otherwise(same / F.size(a)))


def as_string(samples: Column) -> Column:
    """Eight hex digits per sample; empty for texts without words."""
    digits = F.transform(samples, lambda x: F.lpad(F.hex(x), 8, "0"))
    return F.coalesce(F.lower(F.array_join(digits, "")), F.lit(""))


def edited_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document beside what its edited text is made of: the characters before
    its last third (``kept``) and as many first ones (or all) of the next document by
    descending key (``head``; after the last comes the first). Also ``text``,
    ``next_id`` and ``n_chars``.

    Keys are put in order without their texts; a text is shuffled once, and of the
    next text only the characters that are needed.
    """
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = dealt_by_range(body.select("doc_id", F.char_length("text").cast("bigint").alias("n_chars")),
                         "doc_id", "cws-order")
    links = following(ids, "doc_id", "n_chars")
    placed = body.join(links, "doc_id")
    heads = placed.select(F.col("after_key").alias("doc_id"), F.col("doc_id").alias("next_id"),
                          F.col("text").substr(F.lit(1), F.floor(F.col("after_value") / 3).cast("int")).alias("head"))
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    return placed.join(heads, "doc_id").select(
        "doc_id", "text", "next_id", "n_chars", "head",
        F.col("text").substr(F.lit(1), kept.cast("int")).alias("kept"))


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    A null text counts as empty. Rows that repeat a key are one document (the least
    text stands for it); rows with a null key have no place in the order and are left
    out; a lone document is its own next one; an empty table gives no row; other
    columns are not read.
    """
    unique = (docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
              .filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text")))
    pairs = edited_texts(unique)
    # the words before the edit are common to both texts: cut at the last space before it
    broken = F.char_length(F.substring_index(spaces_to_blanks(F.col("kept")), " ", -1))
    whole = (F.char_length("kept") - broken).cast("int")
    segments = pairs.select("doc_id", F.posexplode(F.array(
        F.col("kept").substr(F.lit(1), whole),
        F.col("text").substr(whole + 1, F.col("n_chars").cast("int")),
        F.concat(F.col("kept").substr(whole + 1, F.col("n_chars").cast("int")), "head"))).alias("part", "words"))
    counts = count_words(segments, ["doc_id"], "part", "words",
                         {"own": F.col("part") <= 1, "edited": F.col("part") != 1})
    prints = sample_versions(counts, ["doc_id"], ["own", "edited"], samples)
    facts = pairs.select("doc_id", "next_id", "n_chars",
                         F.sha2(F.concat("kept", "head"), 256).alias("edited_sha256"))
    done = written(facts.join(prints, "doc_id", "left"), "cws-prints")
    following_prints = done.select(F.col("doc_id").alias("next_id"), F.col("own").alias("next"))
    return done.join(following_prints, "next_id").select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"), as_string(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"))
