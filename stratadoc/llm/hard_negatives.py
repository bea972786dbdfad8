"""Hard-negative mining by angular triangle filtering.

Every vector stores its length and its angles to a few reference directions. The angle between two vectors lies between
the difference and the sum of their angles to any reference, so the references together give an interval for the cosine,
and the lengths an interval for the score. Rows lie in order of their nearest reference and their angle to it; runs of
neighbours form groups with ranges of angles and lengths. A group, and then a row of it, is left out for an anchor
unless its interval overlaps a window of scores that the anchor still asks for; only what is left gets its integer score.
The references shape the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadoc.session import saved, spread

#: The scale of components, and the window of negatives as hundredths of the positive's score.
SCALE = 256
LEAST_SHARE, MOST_SHARE = 80, 100
POSITIVES, NEGATIVES = 5, 5
#: Reference directions, and the rows (those that a hash puts first) that they are fitted to.
REFERENCES = 16
SAMPLE_ROWS = 2048
#: Rows of a group; anchors that go to the rows at once, with their windows.
GROUP = 64
ANCHOR_BLOCK = 4096
#: What angles may be wrong by, and scores as a share of the product of lengths.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-6
#: Products of lengths up to which a sum of integer products is exact in floating point.
EXACT = float(1 << 52)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows that take part, labels changed and components scaled to integers."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)) & ~F.isnan(x))
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of the given width, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.float64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def fit_references(sample: np.ndarray, count: int = REFERENCES, rounds: int = 8) -> np.ndarray:
    """Directions of the sample's clusters: begins far apart, then moves to the means, by cosine."""
    length = np.linalg.norm(sample, axis=1)
    unit = sample[length > 0] / length[length > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1] or 1)
    picked, near = [0], unit @ unit[0]
    while len(picked) < min(count, len(unit)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[picked[-1]])
    refs = unit[picked]
    for _ in range(rounds):
        own = (unit @ refs.T).argmax(axis=1)
        means = np.stack([unit[own == k].sum(axis=0) if (own == k).any() else refs[k] for k in range(len(refs))])
        size = np.linalg.norm(means, axis=1, keepdims=True)
        refs = np.where(size > 0, means / np.where(size > 0, size, 1), refs)
    return refs


def angles_to(refs: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and angles to each reference; a zero vector is at right angles to all."""
    norm = np.linalg.norm(v, axis=1)
    cosine = np.divide(v @ refs.T, norm[:, None], out=np.zeros((len(v), len(refs))), where=norm[:, None] > 0)
    return norm, np.arccos(np.clip(cosine, -1, 1))


def _placed(refs: np.ndarray, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, theta = angles_to(refs, matrix(batch.column("v"), width))
            cell = theta.argmin(axis=1) if len(theta) else np.empty(0, np.int64)
            near = theta[np.arange(len(theta)), cell]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(theta) + 1) * theta.shape[1], pa.int32()), pa.array(theta.ravel()))
            made = [pa.array(norm), listed, pa.array(cell.astype(np.int32)), pa.array(near)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "vec_id", "label", "v")), *made], ["rid", "vec_id", "label", "v", "norm", "theta", "cell", "near"])

    return run


PLACED = "rid long, vec_id long, label long, v array<long>, norm double, theta array<double>, cell int, near double"


def score_bounds(norm: np.ndarray, theta: np.ndarray, least_norm: np.ndarray, most_norm: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scores of vectors (norm, theta) with any that have such lengths and angles: rounded to the safe side."""
    low, high = np.zeros((len(norm), len(least_norm))), np.full((len(norm), len(least_norm)), np.pi)
    for r in range(theta.shape[1]):
        own = theta[:, r, None]
        low = np.maximum(low, np.maximum(own - most[None, :, r], least[None, :, r] - own))
        below, above = own + most[None, :, r], 2 * np.pi - own - least[None, :, r]
        high = np.minimum(high, np.where(below < np.pi, below, np.minimum(above, np.pi)))
    top, bottom = np.cos(np.maximum(low - ANGLE_SLACK, 0)), np.cos(np.minimum(high + ANGLE_SLACK, np.pi))
    a, slack = norm[:, None], SCORE_SLACK * norm[:, None] * most_norm[None] + SCORE_SLACK
    return (
        np.floor(a * bottom * np.where(bottom > 0, least_norm[None], most_norm[None]) - slack),
        np.ceil(a * top * np.where(top > 0, most_norm[None], least_norm[None]) + slack),
    )


@dataclass
class Anchors:
    """A block of anchors. A window is one of the score ranges that an anchor asks for; each keeps its first rows."""

    rid: np.ndarray
    label: np.ndarray
    v: np.ndarray
    norm: np.ndarray
    theta: np.ndarray
    same_label: bool  # whether rows of the anchor's label are asked for, or the others
    keep: int
    low: np.ndarray = field(default=None)  # anchors x windows; a window without scores is empty
    high: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.low is None:
            self.low, self.high = np.full((len(self.rid), 1), -math.inf), np.full((len(self.rid), 1), math.inf)
        self.scored = self.seen = 0
        self.best = {c: np.empty(0, np.int64) for c in ("slot", "score", "vec_id", "rid")} | {"without": np.empty(0, bool)}

    def _asked(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the intervals (anchors `at` x rows) overlap a window."""
        out = np.zeros(low.shape, bool)
        for w in range(self.low.shape[1]):
            out |= (high >= self.low[at, w, None]) & (low <= self.high[at, w, None])
        return out

    def take(self, rid: np.ndarray, vec_id: np.ndarray, without: np.ndarray, label: np.ndarray, v: np.ndarray, norm: np.ndarray, theta: np.ndarray) -> None:
        """Looks at rows, in runs of GROUP."""
        if not len(rid) or not len(self.rid):
            return
        first = np.arange(0, len(rid), GROUP)
        ends = np.append(first[1:], len(rid))
        reduced = lambda f, x: f.reduceat(x, first, axis=0)
        low, high = score_bounds(self.norm, self.theta, reduced(np.minimum, norm), reduced(np.maximum, norm), reduced(np.minimum, theta), reduced(np.maximum, theta))
        open_ = self._asked(np.arange(len(self.rid)), low, high)
        self.seen += len(self.rid) * len(rid)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for g, (a, b) in enumerate(zip(first.tolist(), ends.tolist())):
            at = np.flatnonzero(open_[:, g])
            if not len(at):
                continue
            low, high = score_bounds(self.norm[at], self.theta[at], norm[a:b], norm[a:b], theta[a:b], theta[a:b])
            mask = self._asked(at, low, high)
            mask &= (self.label[at, None] == label[None, a:b]) == self.same_label
            mask &= self.rid[at, None] != rid[None, a:b]
            rows, columns = mask.any(axis=1), mask.any(axis=0)
            if not rows.any():
                continue
            at, some = at[rows], np.arange(a, b)[columns]
            mask = mask[np.ix_(rows, columns)]
            if self.norm[at].max() * norm[some].max() < EXACT:
                scores = (self.v[at] @ v[some].T).astype(np.int64)
            else:
                scores = self.v[at].astype(np.int64) @ v[some].T.astype(np.int64)
            i, j = np.nonzero(mask)
            self.scored += len(i)
            found.append((at[i], some[j], scores[i, j]))
        if found:
            at, row, score = (np.concatenate(x) for x in zip(*found))
            self._merge(at, score, vec_id[row], without[row], rid[row])

    def _merge(self, at: np.ndarray, score: np.ndarray, vec_id: np.ndarray, without: np.ndarray, rid: np.ndarray) -> None:
        windows = self.low.shape[1]
        new = {"slot": [self.best["slot"]], "score": [self.best["score"]], "vec_id": [self.best["vec_id"]], "without": [self.best["without"]], "rid": [self.best["rid"]]}
        for w in range(windows):
            fits = (score >= self.low[at, w]) & (score <= self.high[at, w])
            for c, x in (("slot", at * windows + w), ("score", score), ("vec_id", vec_id), ("without", without), ("rid", rid)):
                new[c].append(x[fits])
        rows = {c: np.concatenate(x) for c, x in new.items()}
        order = np.lexsort((rows["rid"], rows["vec_id"], rows["without"], -rows["score"], rows["slot"]))
        slot = rows["slot"][order]
        begin = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.empty(0, np.int64)
        sizes = np.diff(np.append(begin, len(slot)))
        rank = np.arange(len(slot)) - np.repeat(begin, sizes)
        order = order[rank < self.keep]
        self.best = {c: x[order] for c, x in rows.items()}
        # What a window's last row scores is what others must reach from now on.
        full = np.flatnonzero(sizes >= self.keep)
        last = rows["score"][np.lexsort((rows["rid"], rows["vec_id"], rows["without"], -rows["score"], rows["slot"]))][begin[full] + self.keep - 1]
        flat = self.low.reshape(-1)
        flat[slot[begin[full]]] = np.maximum(flat[slot[begin[full]]], last)


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    whole = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    vec_id = batch.column("vec_id")
    return whole("rid"), vec_id.fill_null(0).to_numpy(), vec_id.is_null().to_numpy(zero_copy_only=False), whole("label"), matrix(batch.column("v"), width), whole("norm"), np.stack(batch.column("theta").to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty((0, 1))


def _search(block: dict, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows -> for each window of the block's anchors the first rows of this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(**{k: np.array(x) if isinstance(x, np.ndarray) else x for k, x in block.items()})
        for batch in batches:
            anchors.take(*_arrays(batch, width))
        best, windows = anchors.best, anchors.low.shape[1]
        made = [anchors.rid[best["slot"] // windows], (best["slot"] % windows).astype(np.int32), best["score"]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(best["vec_id"], mask=best["without"]), pa.array(best["rid"])], ["anchor", "win", "score", "vec_id", "rid"])

    return run


FOUND = "anchor long, win int, score long, vec_id long, rid long"


def _first(found: DataFrame, keep: int, label: str) -> DataFrame:
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return saved(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep), label)


def hard_negatives(embeddings: DataFrame, every: int = 100, references: int = REFERENCES, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by every; for each of its first POSITIVES rows of the same label the
    first NEGATIVES rows of other labels that score between LEAST_SHARE and MOST_SHARE hundredths of the positive. Rows
    with a null label, vector or component, or one that isn't finite, take no part. Vectors of different lengths are
    filled up with zeros; an empty vector scores 0. Rows without a vec_id are no anchors and come last among equal
    scores. Repeated rows and repeated vec_ids are rows of their own, also as anchors: a row is never its own positive,
    its copy may be. An empty table gives an empty result; other columns are not looked at. Scores must fit 64 bits.
    """
    spark = embeddings.sparkSession
    rows = saved(spread(usable(embeddings)).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    first_rows = rows.orderBy(F.xxhash64("v", "rid"), "rid").select("v").limit(SAMPLE_ROWS).toArrow()["v"].combine_chunks()
    refs = fit_references(matrix(first_rows, width), references) if width else np.eye(1)
    placed = rows.select("rid", "vec_id", "label", "v").mapInArrow(_placed(refs, max(1, width)), PLACED)
    placed = saved(placed.repartitionByRange("cell", "near", "rid").sortWithinPartitions("cell", "near", "rid"), "placed-vectors")
    asking = placed.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asking.count() // anchor_block))
    results = None
    for k in range(blocks):
        batch = asking.filter(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == k).sort("rid").toArrow().combine_chunks().to_batches()
        own = dict(zip(("rid", "vec_id", "without", "label", "v", "norm", "theta"), _arrays(batch[0], max(1, width)))) if batch else None
        if own is None:
            own = {c: np.empty(0, np.int64) for c in ("rid", "vec_id", "label")} | {"v": np.empty((0, max(1, width))), "norm": np.empty(0), "theta": np.empty((0, len(refs)))}
        block = {c: own[c] for c in ("rid", "label", "v", "norm", "theta")}
        positives = _first(placed.mapInArrow(_search(block | {"same_label": True, "keep": POSITIVES}, max(1, width)), FOUND), POSITIVES, "positives")
        # At most POSITIVES rows for each anchor of the block.
        of = positives.sort("anchor", "rank").toArrow()
        low, high = np.full((len(block["rid"]), POSITIVES), math.inf), np.full((len(block["rid"]), POSITIVES), -math.inf)
        at = np.searchsorted(block["rid"], of["anchor"].to_numpy()), of["rank"].to_numpy() - 1
        score = of["score"].to_numpy()
        low[at], high[at] = -((-LEAST_SHARE * score) // 100), (MOST_SHARE * score) // 100
        found = placed.mapInArrow(_search(block | {"same_label": False, "keep": NEGATIVES, "low": low, "high": high}, max(1, width)), FOUND)
        negatives = _first(found, NEGATIVES, "negatives")
        some = negatives.select("anchor", F.col("win").alias("w"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        positive = positives.select("anchor", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        names = asking.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        result = some.join(positive, ["anchor", "w"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        results = result if results is None else results.unionByName(result)
    return results
