"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints that differ in few bits must agree on one of a few bit blocks, so a fingerprint goes to one group for each
block; a group too large for a task is dealt out again by blocks of the bits still free, as often as it takes. Within a
group the fingerprints are sorted by their rank in the Gray code, where neighbours differ in few bits. Runs of
neighbours form the nodes of a tree; a node holds the bits on which all below it agree and that its parent doesn't hold.
A search goes down the tree and adds up the differences on the nodes' bits; a whole subtree is left out once they exceed
the limit. What is found in a group is kept as a spanning star, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.llm.components import components
from stratadoc.llm.words import BYTES_TO_LOWER, spaced_words
from stratadoc.session import saved

MAX_DIFFERENCES = 3
SHINGLE = 3
#: Children of a node; fingerprints of a group that one task takes on; pairs of query and node that are held at once.
FAN = 16
GROUP = 4096
FRONTIER = 1 << 19
#: Places of a group that are compared with all of it before the search.
PIVOTS = 4
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16


def shingle_hashes(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of width words; of all words where they are fewer; nothing without words."""
    words = spaced_words(raw.translate(BYTES_TO_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    a, b = starts[:n].tolist(), ends[-n:].tolist()
    pieces = (joined[i:j] for i, j in zip(a, b))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        part = np.ascontiguousarray(hashes[i : i + COUNTED])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint_of(shingle_hashes(x.as_py())) for x in batch.column("content")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for each row. Null and empty texts have fingerprint zero."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    return rows.mapInArrow(_fingerprint, f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class _Level:
    """The nodes of one level: the bits they hold beside their parents', and where their children and leaves lie."""

    def __init__(self, agree: np.ndarray, bits: np.ndarray, first: np.ndarray, count: np.ndarray, end: np.ndarray) -> None:
        self.agree, self.bits, self.first, self.count, self.end = agree, bits, first, count, end


def build_levels(fp: np.ndarray, sizes: np.ndarray) -> list[_Level]:
    """The trees over the groups, lowest level (the fingerprints) first; every group has one node on the top level.

    fp lies group by group, by Gray rank in each. Nodes never reach across groups.
    """
    n = len(fp)
    all_bits = np.full(n, ~np.uint64(0))
    levels = [_Level(all_bits, fp, np.arange(n), np.ones(n, np.int64), np.arange(1, n + 1))]
    low, high = fp, fp
    while (sizes > 1).any():
        above = -(-sizes // FAN)
        within = np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above)
        first = np.repeat(np.cumsum(sizes) - sizes, above) + within * FAN
        count = np.minimum(FAN, np.repeat(sizes, above) - within * FAN)
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        levels.append(_Level(~(low ^ high), low, first, count, levels[-1].end[first + count - 1]))
        sizes = above
    return levels


def search(fp: np.ndarray, sizes: np.ndarray, limit: int = MAX_DIFFERENCES, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of pairs (i, j) of the same group whose fingerprints differ in limit bits at most.

    All pairs i < j; or, where asked gives some places, those of each of them with every other place.
    """
    every = asked is None
    asked = np.arange(len(fp)) if every else asked
    if not len(asked):
        return
    levels = build_levels(fp, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    work = np.cumsum(sizes[owner[asked]])
    cuts = np.searchsorted(work, np.arange(FRONTIER, work[-1] + FRONTIER, FRONTIER), side="left") + 1
    begin = 0
    for stop in np.minimum(cuts, len(asked)):
        q = asked[begin:stop]
        begin = stop
        if not len(q):
            continue
        top = levels[-1]
        node = owner[q]
        apart = np.bitwise_count((fp[q] ^ top.bits[node]) & top.agree[node]).astype(np.int16)
        for depth in range(len(levels) - 1, 0, -1):
            here, below = levels[depth], levels[depth - 1]
            keep = (apart <= limit) & (here.end[node] > q + 1) if every else apart <= limit
            q, node, apart = q[keep], node[keep], apart[keep]
            count = here.count[node]
            row = np.repeat(np.arange(len(q)), count)
            child = here.first[node][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            held = below.agree[child] & ~here.agree[node][row]
            q = q[row]
            apart = apart[row] + np.bitwise_count((fp[q] ^ below.bits[child]) & held)
            node = child
        keep = (apart <= limit) & (node > q if every else node != q)
        yield q[keep], node[keep]


def spanning_stars(fp: np.ndarray, sizes: np.ndarray, limit: int = MAX_DIFFERENCES, name: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names (member, root) that connect what search() connects; the root has the least name. Without names the
    fingerprints (signed) are the names.

    A few places of each group are compared with all of it first. What that leaves in a group's largest component needs
    no search among itself, so a group of fingerprints that all lie close costs no pairs.
    """
    n, name = len(fp), fp.view(np.int64) if name is None else name
    root = np.arange(n)
    begin = np.cumsum(sizes) - sizes

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != (up := root[root])).any():
                root = up

    for k in range(PIVOTS):
        pivot = np.repeat(begin + sizes * k // PIVOTS, sizes)
        close = np.flatnonzero(np.bitwise_count(fp ^ fp[pivot]) <= limit)
        join(close, pivot[close])
    held = np.bincount(root, minlength=n)
    largest = np.repeat(np.maximum.reduceat(held, begin), sizes)
    first = np.full(n, n)
    at = np.flatnonzero(held == largest)  # roots of a largest component
    group = np.repeat(np.arange(len(sizes)), sizes)
    np.minimum.at(first, group[at], at)
    for a, b in search(fp, sizes, limit, np.flatnonzero(root != first[group])):
        join(a, b)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, name)
    member = np.flatnonzero(name != least[root])
    return name[member], least[root][member]


def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], keys: int) -> Iterator[np.ndarray]:
    """Rows (columns x rows) of batches sorted by the first keys columns, in lots that hold whole groups."""
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]))
        n += batch.num_rows
        if n < 1 << 16:
            continue
        rows = np.concatenate(held, axis=1)
        last = np.flatnonzero((rows[:keys] != rows[:keys, -1:]).any(axis=0))
        cut = last[-1] + 1 if len(last) else 0  # the last group may go on
        if cut:
            yield np.ascontiguousarray(rows[:, :cut])
        held, n = [rows[:, cut:]], rows.shape[1] - cut
    if n:
        yield np.ascontiguousarray(np.concatenate(held, axis=1))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mask, value, fp, sorted by mask and value -> edges (a, b). Groups lie whole in a partition."""

    def solve(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
        sizes = np.diff(np.append(new, len(fp)))
        order = np.lexsort((gray_rank(fp.view(np.uint64)), np.repeat(np.arange(len(sizes)), sizes)))
        a, b = spanning_stars(fp.view(np.uint64)[order], sizes)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    yield from (solve(*rows) for rows in whole_groups(batches, ("mask", "value", "fp"), 2))


def _split_bits(mask: int, parts: int) -> list[int]:
    """mask with each of the parts that its free bits are cut into, as unsigned numbers."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_edges(distinct: DataFrame, limit: int = MAX_DIFFERENCES, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of distinct (fp) as their links of limit bits or less do."""
    parts = limit + 1
    masks = {0: _split_bits(0, parts)}
    rows = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks[0]))).alias("mask"))
    edges = None
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = saved(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1"), "group-sizes")
        fit = rows.join(sizes.filter(F.col("n") <= group), ["mask", "value"], "left_semi")
        fit = fit.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
        found = saved(fit.mapInArrow(_link, "a long, b long"), "group-edges")
        edges = found if edges is None else edges.unionByName(found)
        large = sizes.filter(F.col("n") > group)
        if large.isEmpty():
            return edges
        # Each step fixes more bits, so groups shrink; once few bits are free a group fits whatever it holds.
        masks = {m: _split_bits(m, parts) for m in {m for ms in masks.values() for m in ms}}
        if min(64 - m.bit_count() for ms in masks.values() for m in ms) <= 15:
            group = 1 << 16
        deal = F.create_map(*(x for m, ms in masks.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(k)) for k in ms)))))
        dealt = rows.join(large.select("mask", "value"), ["mask", "value"], "left_semi").select("fp", F.explode(deal[F.col("mask")]).alias("mask"))
        rows = saved(dealt.distinct(), "regrouped")


def near_duplicates(docs: DataFrame, limit: int = MAX_DIFFERENCES) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links of limit bits or less) for each row of docs.

    Null, empty and wordless texts have fingerprint zero and link like others. Equal texts have equal fingerprints, so
    copies are never paired. Rows without a doc_id count for the links but not for the smallest doc_id (null where a
    component has none). Repeated rows give a row each; other columns are not looked at.
    """
    prints = saved(fingerprints(docs), "fingerprints")
    firsts = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    linked = components(near_edges(firsts.select("fp"), limit))
    rooted = firsts.join(linked, firsts["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # A table of its own, so that the join can be split where a third of all rows have one fingerprint.
    named = saved(rooted.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_rows(found: DataFrame) -> DataFrame:
    """The columns of a query over near_duplicates, the fingerprint as 16 hexadecimal digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
