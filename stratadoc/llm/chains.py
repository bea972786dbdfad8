"""Forward and backward recursions over many sequences at once, and sums of vectors over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Packed:
    """Lays sequences out step by step: first the first element of each, longest sequence first, then the second, ...

    place[i] is where element i (sequence after sequence) goes; step t takes places off[t] to off[t + 1], and a
    sequence keeps its position within the step as long as it lasts. sequence[i] is the sequence that element i is of,
    later[i] whether another element comes before it there.
    """

    def __init__(self, lengths: np.ndarray) -> None:
        order = np.argsort(-lengths, kind="stable")
        long_first = lengths[order]
        steps = int(long_first[0]) if len(long_first) else 0
        self.lengths = lengths
        self.active = np.searchsorted(-long_first, -np.arange(steps), side="left")
        self.off = np.concatenate(([0], np.cumsum(self.active)))
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        self.place = self.off[self._step()]
        self.place += np.repeat(rank, lengths)

    def _step(self) -> np.ndarray:
        return np.arange(self.lengths.sum()) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    @cached_property
    def sequence(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    @cached_property
    def later(self) -> np.ndarray:
        return self._step() > 0

    def forward(self, start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and the scales, whose logarithms sum up to the likelihood's. emit is packed."""
        alpha, scale = np.empty_like(emit), np.empty(len(emit), emit.dtype)
        off, active, ones = self.off.tolist(), self.active.tolist(), np.ones(len(start), emit.dtype)
        for t, n in enumerate(active):
            a, b = off[t], off[t + 1]
            now, total = alpha[a:b], scale[a:b]
            if t:
                np.matmul(alpha[off[t - 1] : off[t - 1] + n], trans, out=now)
                now *= emit[a:b]
            else:
                np.multiply(emit[a:b], start, out=now)
            np.matmul(now, ones, out=total)  # faster than a sum over so short an axis
            now *= np.reciprocal(total)[:, None]
        return alpha, scale

    def backward(self, trans: np.ndarray, emit: np.ndarray, scale: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled backward probabilities, and the expected counts of neighbouring states."""
        beta, ahead, pairs = np.ones_like(emit), emit / scale[:, None], np.zeros(trans.shape)
        off = self.off.tolist()
        back = np.ascontiguousarray(trans.T)
        for t in range(len(off) - 2, 0, -1):
            a, b, c = off[t], off[t + 1], off[t - 1]
            now = ahead[a:b]
            now *= beta[a:b]
            np.matmul(now, back, out=beta[c : c + b - a])
            pairs += alpha[c : c + b - a].T @ now
        return beta, pairs * trans


def vector_sum(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over partitions of the vector (of a fixed size) that part makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(batches)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.float64))], ["i", "v"])

    total = np.zeros(size)
    for row in df.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[row["i"]] = row["v"]
    return total
