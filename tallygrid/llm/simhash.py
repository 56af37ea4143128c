"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint is the bitwise majority of the hashes of a text's word shingles. Fingerprints are cut into ``PARTS`` blocks
of bits. Two that differ in at most ``DISTANCE`` bits share the pattern of some ``PARTS - DISTANCE`` blocks, so the upper
nodes of the index are these shared masked patterns; every fingerprint hangs below one node for each choice of blocks. The
rows below a node are sorted by Gray rank, which puts like patterns side by side, and grouped into a tree whose inner
nodes hold the bits common to all below. A search walks pairs of nodes downwards and leaves a pair once the bits fixed in
both differ in more than ``DISTANCE`` places.

Only distinct fingerprints are indexed: copies cost one row. The blocks not in a node's pattern hold at most 22 bits, so
no node has more than 2**22 fingerprints whatever the corpus holds, and a task keeps one node (34 MB) and its tree in
memory. Below a node only the links of a spanning forest are returned: the search also leaves a pair of nodes that lie in
one component already, so a dense group gives no pairs without number. Components are joined up by distributed rounds
of label exchange.

Defined results: null and empty texts have fingerprint zero, which is linked like any other; rows of equal id are rows of
their own; a component of rows without ids has a null id; no rows give no rows; other columns play no part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import labelled

# Tasks get this module's functions with the job; executors need not have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
DISTANCE = 2
SEED = 42
PARTS = 6
FANOUT = 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the text, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - last].tolist(), ends[last:].tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - last)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for first in range(0, n, 255):  # as many ones as a byte can count
        bits = np.unpackbits(hashes[first:first + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(shingle_hashes(text.as_py())) for text in batch.column("text")], np.uint64)
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(name) for name in names], pa.array(found.view(np.int64))], [*names, "fingerprint"])


def with_fingerprints(keyed: DataFrame) -> DataFrame:
    """The columns but ``text``, and ``fingerprint``, a long with the 64 bits."""
    rest = [f"`{name}` {kind}" for name, kind in keyed.dtypes if name != "text"]
    return keyed.mapInArrow(_fingerprints, ", ".join([*rest, "fingerprint bigint"]))


def gray_rank(bits: Column) -> Column:
    """The place of a bit pattern in the Gray sequence: each bit is the parity of those from it upwards."""
    for shift in (32, 16, 8, 4, 2, 1):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, shift))
    return bits


def blocks_of(parts: int = PARTS) -> list[int]:
    """Masks of consecutive blocks of bits, as even as can be."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def masks_of(parts: int = PARTS, distance: int = DISTANCE) -> list[int]:
    """The masks of the upper nodes: each choice of all blocks but ``distance``."""
    return [_signed(sum(chosen)) for chosen in combinations(blocks_of(parts), parts - distance)]


def popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits)


class Forest:
    """Disjoint sets over 0 … n-1, each named by its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if np.array_equal(above, self.parent):
                return self.parent
            self.parent = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of each pair, all pairs at once: larger roots hang below smaller ones until none is left."""
        while True:
            roots = self.roots()
            x, y = roots[a], roots[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def tree_of(points: np.ndarray, fanout: int = FANOUT) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(mask, pattern)`` of each level, leaves first: the bits common to all points below a node, and their values."""
    levels = [(np.full(len(points), ~np.uint64(0)), points)]
    while len(levels[-1][0]) > 1:
        mask, pattern = levels[-1]
        at = np.arange(0, len(mask), fanout)
        both = np.bitwise_and.reduceat(mask, at)
        unlike = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[at], np.diff(np.append(at, len(mask)))), at)
        both &= ~unlike
        levels.append((both, pattern[at] & both))
    return levels


def spanning_links(
        points: np.ndarray, distance: int = DISTANCE, fanout: int = FANOUT, chunk: int = 200_000,
) -> tuple[np.ndarray, np.ndarray]:
    """Each point and the first point of its component, of distinct points sorted by Gray rank; pairs of unlike places
    only. Points are linked when they differ in at most ``distance`` bits.

    The walk goes depth first in chunks, so the pairs that wait are few. Neighbours are linked first; what is found is
    used at once to leave pairs of nodes that are one component already.
    """
    n = len(points)
    forest = Forest(n)
    near = np.flatnonzero(popcount(points[1:] ^ points[:-1]) <= distance)
    forest.link(near, near + 1)
    levels = tree_of(points, fanout)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > chunk:
            stack += [(level, a[at:at + chunk], b[at:at + chunk]) for at in range(0, len(a), chunk)]
            continue
        mask, pattern = levels[level]
        open_ = popcount((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= distance
        a, b = a[open_], b[open_]
        if level == 0:
            forest.link(a, b)
            continue
        low, high = _labels(forest.roots(), fanout ** level)
        one = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        a, b = a[~one], b[~one]
        below = len(levels[level - 1][0])
        steps = np.arange(fanout)
        x = (a[:, None] * fanout + steps)[:, :, None].repeat(fanout, 2).ravel()
        y = (b[:, None] * fanout + steps)[:, None, :].repeat(fanout, 1).ravel()
        real = (x < below) & (y < below) & ((x < y) if level == 1 else (x <= y))
        if real.any():
            stack.append((level - 1, x[real], y[real]))
    roots = forest.roots()
    linked = np.flatnonzero(roots != np.arange(n))
    return linked, roots[linked]


def _labels(roots: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(roots), width)
    return np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links below the nodes of a partition, whose rows come sorted by choice, node and Gray rank."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        choice, node, _ = held[-1]
        if len(choice) and (held[0][0][0], held[0][1][0]) == (choice[-1], node[-1]):
            continue
        choice, node, bits = (np.concatenate(parts) for parts in zip(*held))
        starts = _starts(choice, node)
        yield from _below(bits[:starts[-1]], starts[:-1])
        held = [(choice[starts[-1]:], node[starts[-1]:], bits[starts[-1]:])]
    if held:
        choice, node, bits = (np.concatenate(parts) for parts in zip(*held))
        if len(bits):
            yield from _below(bits, _starts(choice, node))


def _starts(choice: np.ndarray, node: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero((choice[1:] != choice[:-1]) | (node[1:] != node[:-1])) + 1))


def _below(bits: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    bits = bits.view(np.uint64)
    sizes = np.diff(np.append(starts, len(bits)))
    pairs = starts[sizes == 2]
    pairs = pairs[popcount(bits[pairs] ^ bits[pairs + 1]) <= DISTANCE]
    a, b = [bits[pairs]], [bits[pairs + 1]]
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        points = bits[start:start + size]
        x, y = spanning_links(points)
        a.append(points[x])
        b.append(points[y])
    if sum(map(len, a)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(side).view(np.int64)) for side in (a, b)], ["a", "b"])


def links_of(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: links between distinct values of ``fingerprint``, whose components are those of all links."""
    bits = F.col("fingerprint")
    nodes = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("choice"), bits.bitwiseAND(F.lit(mask)).alias("node"))
        for i, mask in enumerate(masks_of())])
    below = distinct.select(bits, F.explode(nodes).alias("at")).select(
        F.col("at.choice").alias("choice"), F.col("at.node").alias("node"), bits)
    placed = below.repartition("choice", "node").sortWithinPartitions("choice", "node", gray_rank(bits))
    return placed.mapInArrow(_links, "a bigint, b bigint").distinct()


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, fingerprint, component, component_id)`` of each row; ``component`` is a fingerprint that names its
    component and ``component_id`` is the smallest ``doc_id`` in it. ``key`` is a column of the input that tells rows of
    equal id apart."""
    found = checkpointed(with_fingerprints(docs.select("doc_id", "key", "text")))
    distinct = found.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    labels = labelled(links_of(distinct.select("fingerprint"))).withColumnRenamed("node", "at")
    named = distinct.join(labels, distinct["fingerprint"] == F.col("at"), "left").select(
        "fingerprint", "first", F.coalesce("label", "fingerprint").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("fingerprint", "component", "component_id")
    return found.join(named, "fingerprint").select("doc_id", "key", "fingerprint", "component", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return components(docs.select("doc_id", F.lit(0).alias("key"), "text")).select(
        "doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, the one of the smallest ``doc_id``; all columns as they were. Of rows with equal id the
    one of the smallest hash stays, and of rows alike in all columns one."""
    row = F.struct("*")
    named = docs.select(
        row.alias("row"), F.col("doc_id").isNull().alias("missing"),
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64(F.to_json(row)).alias("key"), "text")
    found = components(named.select(F.when(~F.col("missing"), F.col("id")).alias("doc_id"), "key", "text"))
    place = F.struct(
        F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "key")
    kept = found.groupBy("component").agg(F.min(place).alias("at")).select("at.*")
    return named.drop("text").join(kept, ["missing", "id", "key"], "left_semi").dropDuplicates(
        ["missing", "id", "key"]).select("row.*")
