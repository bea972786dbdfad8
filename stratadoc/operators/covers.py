"""Smallest covers: the fewest blocks that together hold all anchors of a group, of those the first in order of ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Kinds = list[tuple[int, int]]  # (anchors held, as bits; least block that holds just these), by block


def undominated(kinds: Kinds, by_id: bool) -> Kinds:
    """Without kinds whose anchors another has too; by_id: another with a smaller block, so that no first cover is lost."""
    kept: Kinds = []
    order = sorted(kinds, key=lambda k: k[1]) if by_id else sorted(kinds, key=lambda k: (-k[0].bit_count(), k[1]))
    for mask, i in order:
        if not any(mask & ~other == 0 for other, _ in kept):
            kept.append((mask, i))
    return kept


def _holders(kinds: Kinds, need: int) -> Iterator[tuple[int, list[int]]]:
    """Each needed anchor's bit and the kinds that hold it."""
    while need:
        bit = need & -need
        need ^= bit
        yield bit, [m for m, _ in kinds if m & bit]


def _at_least(kinds: Kinds, need: int) -> int:
    """A lower bound: anchors no two of which are in one kind, picked rarest first."""
    found, barred = 0, 0
    for bit, masks in sorted(_holders(kinds, need), key=lambda x: len(x[1])):
        if not bit & barred:
            found += 1
            for m in masks:
                barred |= m
    return found


def covers_in(kinds: Kinds, need: int, most: int) -> bool:
    """Whether at most `most` kinds cover what is needed. Forced choices come first, then the anchor with fewest choices."""
    if not need:
        return True
    kinds = undominated([(m & need, i) for m, i in kinds if m & need], by_id=False)
    if most <= 0 or _at_least(kinds, need) > most:
        return False
    bit, masks = min(_holders(kinds, need), key=lambda x: len(x[1]))
    return any(covers_in(kinds, need & ~m, most - 1) for m in sorted(masks, key=lambda m: -m.bit_count()))


def smallest_cover(kinds: Kinds, need: int) -> list[int]:
    """The blocks of the smallest cover that comes first; kinds together hold all that is needed."""
    kinds = undominated([(m & need, i) for m, i in kinds if m & need], by_id=True)
    most = max(1, _at_least(kinds, need)) if need else 0
    while not covers_in(kinds, need, most):
        most += 1
    cover: list[int] = []
    while need:
        # The least block with which the rest can still be done by later ones.
        for at, (mask, i) in enumerate(kinds):
            if mask & need and covers_in(kinds[at + 1 :], need & ~mask, most - len(cover) - 1):
                cover.append(i)
                need &= ~mask
                kinds = kinds[at + 1 :]
                break
    return cover


def _solve(rows: pa.Table) -> pa.Table:
    kinds = sorted(((sum(1 << b for b in bits), i) for bits, i in zip(rows["bits"].to_pylist(), rows["i"].to_pylist())), key=lambda k: k[1])
    cover = smallest_cover(kinds, (1 << rows["n"][0].as_py()) - 1)
    return pa.table([rows["case_id"].slice(0, 1), rows["group_no"].slice(0, 1), pa.array([cover], pa.list_(pa.int64()))], names=["case_id", "group_no", "best"])


def min_covers(anchors: DataFrame, holding: DataFrame) -> DataFrame:
    """case_id, group_no, cover, complete: the smallest set of blocks that holds all of a group's anchors, the first in
    order of ids. Where some anchor is held by no block, complete is false and cover is all blocks that hold any.

    Blocks with the same anchors stand for one another by their least id before a group meets in a task, so what meets
    there grows with the combinations of its anchors, not with how many blocks hold them. Groups may have any number of
    anchors; the search is exact: what another kind of block makes needless goes, choices without an alternative are
    taken, and the size grows by one until it is enough.
    """
    group = ["case_id", "group_no"]
    bit = (F.row_number().over(Window.partitionBy(*group).orderBy("anchor")) - 1).alias("bit")
    numbered = anchors.select(*group, "anchor").distinct().select(*group, "anchor", bit)
    sizes = numbered.groupBy(*group).agg(F.count("*").cast("int").alias("n"))
    found = numbered.join(holding.select("anchor", "i").distinct(), "anchor")
    bits = found.groupBy(*group, "i").agg(F.array_sort(F.collect_list("bit")).alias("bits"))
    held = found.groupBy(*group).agg(F.count_distinct("bit").alias("held"))
    state = sizes.join(held, group, "left").withColumn("complete", F.coalesce(F.col("held") == F.col("n"), F.lit(False)))
    whole = state.filter("complete").select(*group, "n")
    kinds = bits.groupBy(*group, "bits").agg(F.min("i").alias("i")).join(whole, group)
    kind = {f.name: f.dataType.simpleString() for f in anchors.schema.fields}
    best = kinds.groupBy(*group).applyInArrow(_solve, f"case_id {kind['case_id']}, group_no {kind['group_no']}, best array<long>")
    every = bits.join(state.filter("not complete").select(*group), group).groupBy(*group).agg(F.array_sort(F.collect_list("i")).alias("every"))
    empty = F.expr("cast(array() as array<bigint>)")
    return state.join(best, group, "left").join(every, group, "left").select(*group, F.coalesce("best", "every", empty).alias("cover"), "complete")
