"""Spelling variants: words one edit apart, and the common form of each.

Method: sorted-list dynamic programming. Within a list of words in order, the edit
matrix of a word against the next ones is kept as a stack of banded rows, one row per
character of the other word: moving on to the next word keeps the rows of the prefix that
it shares with the word before (their longest common prefix, LCP) and computes only the rest. Once a
row holds nothing within one edit, all words that share the prefix up to it are skipped.

Scale: the occurrences are counted in columns, so a frequent word collapses before
the exchange. Words one edit apart with a shorter length of s agree in at least
s - 1 characters outside the edit, hence in the first or in the last s // 2. Words are
dealt by (s, those characters); the lists by the end hold the words reversed. A list above
``LIST_WORDS`` is not scanned but dealt on by half of what its words do not yet share, again from the
front or from the back, until it is small: exact, with no cap, since a list whose words share all
but one character is bounded by the alphabet. Each pair is taken in one list only: the
one to which its own common prefix leads.

Defined results: null and empty texts have no words; a null key never deletes a character;
ties between forms go to the smallest in code-point order; an empty table gives no rows;
repeated rows count as often as they occur; a run of any length is a word; columns other
than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
LIST_WORDS = 4000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _dropped(word: Column, key: Column, every: int) -> Column:
    """``word`` without one character where ``every`` divides the CRC-32 of ``key:word``."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at),
                                           F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_every: int | None = None,
               min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the runs of letters, A-Z lower-cased, that have ``min_chars``
    code points or more and occur ``min_count`` times or more. ``drop_every`` takes one
    character from about one in so many (document, run) pairs, to plant variants."""
    # a run that is too short cannot become long enough
    runs = F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda x: F.length(x) >= min_chars)
    found = docs.select(F.col(key).alias("k"), F.explode(runs).alias("run"))
    word = F.translate("run", _UPPER, _UPPER.lower())
    found = found.select("k", word.alias("w"))
    if drop_every:
        found = found.select(_dropped(F.col("w"), F.col("k"), drop_every).alias("w"))
    return (found.filter(F.length("w") >= min_chars).groupBy(F.col("w").alias("word"))
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # a[:low] == b[:low], a[:high + 1] differs
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def _equal_row(depth: int, size: int) -> tuple[int, int, int]:
    """Row of the edit matrix where both prefixes are the same."""
    return (1 if depth else 2, 0, 1 if depth < size else 2)


def near_words(words: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs i < j of a sorted list of distinct words that are one edit apart.

    A row at depth d holds the edits between the first d characters of the word that is
    scanned and the first d - 1, d and d + 1 of word i; 2 stands for two or more."""
    count = len(words)
    lcp = [0] + [common_prefix(words[k - 1], words[k]) for k in range(1, count)]
    # the next word that shares less with its predecessor than word k does
    lower = [count] * count
    stack: list[int] = []
    for k in range(count):
        while stack and lcp[stack[-1]] > lcp[k]:
            lower[stack.pop()] = k
        stack.append(k)
    for i in range(count - 1):
        word = words[i]
        size = len(word)
        base = lcp[i + 1]  # rows[x] is the row at depth base + x
        rows = [_equal_row(base, size)]
        j = i + 1
        while j < count:
            kept = lcp[j]
            if kept < base:
                base = kept
                rows = [_equal_row(base, size)]
            else:
                del rows[kept - base + 1:]
            other, depth = words[j], kept
            before, same, after = rows[-1]
            for c in other[kept:]:
                depth += 1
                first = second = third = 2  # cells beyond word i's end stay at 2
                if depth - 1 <= size:
                    first = min(2, same + 1, before + (depth < 2 or word[depth - 2] != c))
                if depth <= size:
                    second = min(2, after + 1, first + 1, same + (word[depth - 1] != c))
                if depth < size:
                    third = min(2, second + 1, after + (word[depth] != c))
                before, same, after = first, second, third
                if before > 1 and same > 1 and after > 1:
                    break
                rows.append((before, same, after))
            else:
                if -1 <= size - depth <= 1 and (before, same, after)[size - depth + 1] == 1:
                    yield i, j
                j += 1
                continue
            # all words that share this prefix are more than one edit away
            j += 1
            while j < count and lcp[j] >= depth:
                j = lower[j]


def _leads_to(shared: int, shorter: int, path: str) -> bool:
    """Whether a pair with ``shared`` first characters in common belongs to the list that
    was dealt along ``path``: halves in front (``f``) or at the back (``b``)."""
    front = back = 0
    for way in path:
        half = (shorter - front - back) // 2
        if (shared >= front + half) != (way == "f"):
            return False
        if way == "f":
            front += half
        else:
            back += half
    return True


def _pairs_of(batches):
    """Pairs from rows sorted by list and word; a list fits in memory by construction."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held) < 2:
            continue
        lists = held[_LIST]
        starts = np.flatnonzero(np.r_[True, (lists.iloc[1:].to_numpy() != lists.iloc[:-1].to_numpy()).any(axis=1)])
        if len(starts) > 1:
            yield _scan(held.iloc[:starts[-1]], starts[:-1])
            held = held.iloc[starts[-1]:].reset_index(drop=True)
    if held is not None and len(held):
        yield _scan(held, [0])


def _scan(rows: pd.DataFrame, starts) -> pd.DataFrame:
    found = []
    columns = [rows[c].tolist() for c in ("shorter", "path", "word", "n")]
    for lo, hi in zip(starts, [*starts[1:], len(rows)]):
        shorter, path = columns[0][lo], columns[1][lo]
        words, n = columns[2][lo:hi], columns[3][lo:hi]
        for i, j in near_words([w[::-1] for w in words] if path[-1] == "b" else words):
            u, v = words[i], words[j]
            if min(len(u), len(v)) == shorter and _leads_to(common_prefix(u, v), shorter, path):
                found += [(u, n[i], v, n[j]), (v, n[j], u, n[i])]
    return pd.DataFrame(found, columns=["word", "n", "near", "near_n"])


#: What makes a list: the shorter length of its pairs, the halves along which it was dealt, and
#: the characters shared in front and at the back. After a half at the back the order is that
#: of the reversed words.
_LIST = ["shorter", "path", "head", "tail"]


def _dealt(words: DataFrame) -> DataFrame:
    """``words`` (word, n, shorter, path, front, back) as members of two lists each: one half
    more of what is not yet shared, in front or at the back."""
    half = ((F.col("shorter") - F.col("front") - F.col("back")) / 2).cast("int")
    ways = F.explode(F.array(
        F.struct(F.concat("path", F.lit("f")).alias("path"), (F.col("front") + half).alias("front"), "back"),
        F.struct(F.concat("path", F.lit("b")).alias("path"), "front", (F.col("back") + half).alias("back"))))
    out = words.select("word", "n", "shorter", ways.alias("x")).select("word", "n", "shorter", "x.*")
    return out.withColumn("head", F.substring("word", F.lit(1), F.col("front"))).withColumn(
        "tail", F.substring("word", F.length("word") - F.col("back") + 1, F.col("back")))


def near_pairs(words: DataFrame, list_words: int = LIST_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n, near, near_n) of all pairs of ``words`` (word, n) one edit apart, both ways."""
    length = F.length("word")
    # a word is the shorter (or an equal) one of a pair, or the longer one
    open_ = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("shorter")).filter(
        F.col("shorter") >= min_chars).select("*", F.lit("").alias("path"), F.lit(0).alias("front"), F.lit(0).alias("back"))
    found = []
    while True:
        lists = written(_dealt(open_), "spelling-lists")
        sizes = written(lists.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"),
                        "spelling-sizes")
        large = (F.col("size") > list_words) & (F.col("shorter") - F.length("head") - F.length("tail") > 1)
        order = F.when(F.col("path").endswith("b"), F.reverse("word")).otherwise(F.col("word"))
        small = lists.join(sizes.filter(~large), _LIST).withColumn("in_order", order)
        found.append(written(
            small.repartition(*_LIST).sortWithinPartitions(*_LIST, "in_order")
            .select(*_LIST, "word", "n")
            .mapInPandas(_pairs_of, "word string, n long, near string, near_n long"), "spelling-pairs"))
        if sizes.filter(large).isEmpty():
            break
        open_ = lists.join(sizes.filter(large), _LIST).select("word", "n", "shorter", "path", "front", "back")
    return reduce(DataFrame.unionByName, found)


def variants(words: DataFrame, ratio: int = RATIO, list_words: int = LIST_WORDS,
             min_chars: int = MIN_CHARS) -> DataFrame:
    """For each of ``words`` (word, n): ``n_near`` words one edit apart, ``form`` the most
    frequent of them (ties: the smallest) if it has ``ratio`` times the occurrences or more, with
    ``form_n``, and ``root``, where following the forms ends (the word itself without a form)."""
    words = written(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words, list_words, min_chars)
    near = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.first("n").alias("own"),
        F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    fits = -F.col("best.n") >= ratio * F.col("own")
    near = written(near.select("word", "n_near", F.when(fits, F.col("best.word")).alias("form"),
                               F.when(fits, -F.col("best.n")).alias("form_n")), "spelling-forms")
    # occurrences grow at least ratio-fold from word to form, so chains are short and end
    forms = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = forms.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(forms.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots")
        forms = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return (words.join(near, "word", "left").join(forms, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
