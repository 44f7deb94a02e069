"""Merkle manifest of a dataset: one tree per source, one tree over the sources' roots.

Method: SHA midstate tree. A node's digest is SHA-256 over its children's hex digests.
Building a parent keeps a copy of the running hash state before each child slot; folding
a replaced child resumes the state kept for its slot, feeds the replacement and the
siblings on its right only, and never hashes what stands on the left again. Every node
has up to ``FAN`` children; the last of a level may have fewer, even one.

Scale: rows are dealt by ranges of (source, key, leaf) and numbered from one summary row
per range and source. A block of ``FAN ** height`` consecutive leaves is one unit of work, so
a source of any size is many units; each round replaces a block by its top node, until
every source is one node. Between rounds only top nodes move. The last pass brings to
each block of leaves one row that holds the path from its top to the root.

Defined results: nulls in any column enter a leaf as ``-``; rows with a null key come
first in their source, rows without a source form a source of their own, before all
others; rows of equal keys are ordered by their leaves, so repeated rows are several
equal leaves. An empty table has no rows and no root. Texts of any length are hashed
whole. Extra columns are ignored; no name of a column of the input clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import sha_lanes as sha
from quarry.llm.scratch import written

FAN = 3
HEIGHT = 8
#: One level of a path: the slot taken, the parent's children, its state before the
#: slot, and the other children's digests from left to right.
STEP = np.dtype([("slot", "u1"), ("children", "u1"), ("state", ">u4", 8), ("others", ">u4", (FAN - 1, 8))])

_NODES = "tree string, pos long, n long, digest binary"


def leaf_digest(*columns: str) -> Column:
    """Binary SHA-256 of the columns, each as ``-`` or its UTF-8 length, ``:`` and itself."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
        for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with a column ``tree``) with ``pos``, the number of a row in its tree by
    ``order``, and ``n``, the rows of the tree. No task sees more than a range of rows."""
    by = ["tree", *order]
    dealt = written(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                    .withColumn("row_no", F.monotonically_increasing_id()), name)
    part = F.shiftright("row_no", 33)
    # a row per range and tree
    ranges = dealt.groupBy("tree", part.alias("part")).agg(F.min("row_no").alias("first"),
                                                           F.count(F.lit(1)).alias("size"))
    tree = Window.partitionBy("tree")
    ranges = ranges.select(
        "tree", "part", "first",
        F.coalesce(F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("before"),
        F.sum("size").over(tree).alias("n"))
    return (dealt.withColumn("part", part).join(ranges, ["tree", "part"])
            .withColumn("pos", F.col("row_no") - F.col("first") + F.col("before"))
            .drop("part", "first", "before", "row_no"))


def _heights(n: np.ndarray, height: int) -> np.ndarray:
    """Levels that a block of a tree of n nodes climbs: up to the root, at most ``height``."""
    return np.searchsorted(FAN ** np.arange(height, dtype=np.int64), n, side="left")


class _Blocks:
    """Whole blocks: nodes in order, ``block`` numbers each node's block from 0."""

    def __init__(self, pos: np.ndarray, digest: np.ndarray, block: np.ndarray, heights: np.ndarray):
        lanes = len(pos)
        self.levels = int(heights.max()) if len(heights) else 0
        self.height = heights[block]
        self.steps = np.zeros((lanes, self.levels), dtype=STEP)
        self.top = np.zeros((8, len(heights)), dtype=np.uint32)
        now = np.arange(lanes)  # each first node's ancestor on the level reached
        for level in range(self.levels + 1):
            done = np.flatnonzero(heights[block] == level)
            self.top[:, block[done]] = digest[:, done]
            if level == self.levels:
                break
            go = heights[block] > level
            pos, digest, block, place = pos[go], digest[:, go], block[go], np.cumsum(go) - 1
            parent = pos // FAN
            first = np.flatnonzero(np.r_[True, (np.diff(parent) != 0) | (np.diff(block) != 0)])
            size = np.diff(np.r_[first, len(pos)])
            states = [sha.start(len(first))]
            for slot in range(FAN):
                state, has = states[-1].copy(), np.flatnonzero(size > slot)
                state[:, has] = sha.resume(state[:, has], sha.hex_block(digest[:, first[has] + slot]))
                states.append(state)
            of = np.repeat(np.arange(len(first)), size)
            slot = np.arange(len(pos)) - first[of]
            step = np.zeros(len(pos), dtype=STEP)
            step["slot"], step["children"] = slot, size[of]
            for s in range(FAN):
                at = np.flatnonzero(slot == s)
                step["state"][at] = states[s][:, of[at]].T
                for i, other in enumerate(x for x in range(FAN) if x != s):
                    has = at[size[of[at]] > other]
                    step["others"][has, i] = digest[:, first[of[has]] + other].T
            climbs = self.height > level
            now[climbs] = place[now[climbs]]
            self.steps[climbs, level] = step[now[climbs]]
            now[climbs] = of[now[climbs]]
            pos, digest, block = parent[first], sha.finish(states[-1], size), block[first]


def fold(digest: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The parents' digests after the child in each step's slot became ``digest``: the
    state kept before the slot, the replacement, the siblings on its right."""
    state = sha.resume(step["state"].T.astype(np.uint32), sha.hex_block(digest))
    for other in range(FAN - 1):  # others[slot:] stand on the right
        has = np.flatnonzero((other >= step["slot"]) & (other < step["children"] - 1))
        if len(has):
            right = step["others"][has, other].T.astype(np.uint32)
            state[:, has] = sha.resume(state[:, has], sha.hex_block(right))
    return sha.finish(state, step["children"])


def _whole_blocks(batches: Iterator[pa.RecordBatch]):
    """Tables of whole blocks and the blocks' first rows, from rows that are sorted by (tree, block, pos)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        first = _block_starts(table)
        if len(first) > 1:
            last = int(first[-1])
            yield table.slice(0, last), first[:-1]
            held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _block_starts(table)


def _block_starts(table: pa.Table) -> np.ndarray:
    tree = table["tree"].combine_chunks().dictionary_encode()
    tree = (tree.combine_chunks() if isinstance(tree, pa.ChunkedArray) else tree).indices.to_numpy()
    block = table["block"].to_numpy()
    return np.flatnonzero(np.r_[True, (np.diff(tree) != 0) | (np.diff(block) != 0)])


def _binary(table: pa.Table, name: str) -> np.ndarray:
    return sha.from_bytes(b"".join(table[name].to_pylist()))


def _blocks(table: pa.Table, first: np.ndarray, height: int) -> _Blocks:
    size = np.diff(np.r_[first, table.num_rows])
    return _Blocks(table["pos"].to_numpy(), _binary(table, "digest"), np.repeat(np.arange(len(first)), size),
                   _heights(table["n"].to_numpy()[first], height))


def _tops(batches, height: int):
    for table, first in _whole_blocks(batches):
        blocks = _blocks(table, first, height)
        yield pa.RecordBatch.from_pydict({
            "tree": table["tree"].take(pa.array(first)).combine_chunks(),
            "pos": table["block"].to_numpy()[first],
            "n": -(-table["n"].to_numpy()[first] // FAN ** height),
            "digest": pa.array([d.tobytes() for d in sha.to_bytes(blocks.top)], pa.binary())})


def _paths(batches, height: int):
    for table, first in _whole_blocks(batches):
        blocks = _blocks(table, first, height)
        size = np.diff(np.r_[first, table.num_rows])
        top = sha.to_bytes(blocks.top)
        yield pa.RecordBatch.from_pydict({
            "tree": table["tree"].combine_chunks(), "pos": table["pos"].combine_chunks(),
            "n": table["n"].combine_chunks(),
            "path": pa.array([s[:h].tobytes() for s, h in zip(blocks.steps, blocks.height)], pa.binary()),
            "top": pa.array([top[b].tobytes() for b in np.repeat(np.arange(len(first)), size)], pa.binary())})


def _by_block(nodes: DataFrame, height: int) -> DataFrame:
    return (nodes.withColumn("block", F.floor(F.col("pos") / FAN ** height))
            .repartition("tree", "block").sortWithinPartitions("tree", "block", "pos"))


def _climb(nodes: DataFrame, height: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Paths of the nodes of every round, and one top node per tree."""
    rounds = []
    while True:
        biggest = nodes.agg(F.max("n")).first()[0]
        if biggest is None or biggest <= 1:
            return rounds, nodes
        paths = written(_by_block(nodes, height).select("tree", "block", "pos", "n", "digest").mapInArrow(
            partial(_paths, height=height), "tree string, pos long, n long, path binary, top binary"), f"{name}-paths")
        rounds.append(paths)
        width = FAN ** height
        nodes = paths.filter(F.col("pos") % width == 0).select(
            "tree", F.floor(F.col("pos") / width).alias("pos"), F.ceil(F.col("n") / width).alias("n"),
            F.col("top").alias("digest"))


def _upwards(rounds: list[DataFrame], last: DataFrame, height: int) -> DataFrame:
    """(tree, pos, upper): for every node of the first round its path through all
    rounds, then ``last`` (tree, upper) of its tree."""
    upper = last.select("tree", F.lit(0).cast("long").alias("pos"), "upper")
    for paths in reversed(rounds):
        above = upper.withColumnRenamed("pos", "above")
        upper = (paths.withColumn("above", F.floor(F.col("pos") / FAN ** height)).join(above, ["tree", "above"])
                 .select("tree", "pos", F.concat("path", "upper").alias("upper")))
    return upper


def _fold_leaves(batches, height: int):
    for table, first in _whole_blocks(batches):
        # the first row of a block holds the path from its top to the root
        is_leaf = np.ones(table.num_rows, dtype=bool)
        is_leaf[first] = False
        above = [np.frombuffer(u, dtype=STEP) for u in table["upper"].take(pa.array(first)).to_pylist()]
        roots = {c: table[c].take(pa.array(first)).to_pylist() for c in ("subroot", "root")}
        leaves = table.filter(pa.array(is_leaf))
        block = np.repeat(np.arange(len(first)), np.diff(np.r_[first, table.num_rows]) - 1)
        starts = np.flatnonzero(np.r_[True, np.diff(block) != 0])
        blocks = _blocks(leaves, starts, height)
        lanes, tall = len(block), blocks.levels
        length = np.array([len(u) for u in above])
        steps = np.zeros((lanes, tall + int(length.max())), dtype=STEP)
        steps[:, :tall] = blocks.steps
        for b, (i, j) in enumerate(zip(starts, np.r_[starts[1:], lanes])):
            steps[i:j, tall:tall + length[b]] = above[b]
        now = _binary(leaves, "changed")
        for level in range(steps.shape[1]):
            has = np.flatnonzero(steps["children"][:, level] > 0)
            now[:, has] = fold(now[:, has], steps[has, level])
        others = np.arange(FAN - 1)[None, None, :] < steps["children"][:, :, None].astype(np.int64) - 1
        proof = [hashlib.sha256(o[m].tobytes().hex().encode()).hexdigest() for o, m in zip(steps["others"], others)]
        folded = [d.tobytes().hex() for d in sha.to_bytes(now)]
        root = [roots["root"][b] for b in block]
        yield pa.RecordBatch.from_pydict({
            "key": leaves["key"].combine_chunks(), "tree": leaves["tree"].combine_chunks(),
            "leaf": pa.array([d.hex() for d in leaves["digest"].to_pylist()], pa.string()),
            "subroot": pa.array([roots["subroot"][b] for b in block], pa.string()),
            "root": pa.array(root, pa.string()), "proof_sha256": pa.array(proof, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([a == b for a, b in zip(folded, root)], pa.bool_())})


def verify(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Build the manifest of ``rows`` and fold every row's ``changed`` leaf into it.

    ``rows``: ``source`` string, ``key`` long, ``leaf`` and ``changed`` binary digests
    (:func:`leaf_digest`). Returns per row ``key``, ``source``, ``leaf``, ``subroot`` (of
    its source), ``root``, ``proof_sha256`` (over the hex digests of all siblings on the
    way up), ``folded_root`` and ``verified`` (``folded_root`` equals ``root``). Blocks
    hold ``FAN ** height`` leaves."""
    spark = rows.sparkSession
    # '' (no source) sorts before every other tree, and the others by their bytes
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    leaves = numbered(rows.select(tree.alias("tree"), "key", F.col("leaf").alias("digest"), "changed"),
                      ["key", "digest", "changed"], "merkle-leaves")
    tops = written(_by_block(leaves.select("tree", "pos", "n", "digest"), height).select(
        "tree", "block", "pos", "n", "digest").mapInArrow(partial(_tops, height=height), _NODES), "merkle-tops")
    rounds, subroots = _climb(tops, height, "merkle")

    sources = written(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"),
                               ["name"], "merkle-sources"), "merkle-source-order")
    over, root = _climb(sources.select("tree", "pos", "n", "digest"), height, "merkle-root")
    top = root.select(F.lower(F.hex("digest"))).first()  # one digest, or none without rows
    nothing = spark.createDataFrame([("", bytearray())], "tree string, upper binary")
    if over:
        to_root = sources.join(_upwards(over, nothing, height).drop("tree"), "pos")
    else:
        to_root = sources.withColumn("upper", F.lit(bytearray()))
    to_root = to_root.select(F.col("name").alias("tree"), "upper", F.lower(F.hex("digest")).alias("subroot"))
    above = to_root.drop("upper").join(
        _upwards(rounds, to_root.select("tree", "upper"), height) if rounds else
        to_root.select("tree", F.lit(0).cast("long").alias("pos"), "upper"), "tree").withColumn("root", F.lit(top[0] if top else None).cast("string"))

    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"),
                         F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("key"),
                         F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("changed"),
                         "upper", "subroot", "root")
    body = leaves.select("tree", F.floor(F.col("pos") / FAN ** height).alias("block"), "pos", "n", "key", "digest",
                         "changed", F.lit(None).cast("binary").alias("upper"),
                         F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    found = (heads.unionByName(body).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
             .mapInArrow(partial(_fold_leaves, height=height),
                         "key long, tree string, leaf string, subroot string, root string, proof_sha256 string, "
                         "folded_root string, verified boolean"))
    return found.select("key", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("source"),
                        "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
