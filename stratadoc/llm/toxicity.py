"""Toxicity by a linear-chain conditional random field over the words of each line.

Labels say which documents are toxic. Words whose form or beginning marks toxic documents, measured on a bounded sample
of labelled training rows, are the toxic ones among the tokens that the field learns from. Its parameters are fitted by
gradients that are summed over partitions. For every document, forward-backward marginals give the probability of each
word to be toxic: their sums make the document's score, and words that are likelier toxic than not are its spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from stratadoc.llm.chains import Packed, vector_sum
from stratadoc.session import saved

WORD = re.compile(r"[^\W\d_]+")
#: Labelled training rows that are learned from, about, at most. A share of rows by hash of doc_id where there are more.
SAMPLE_ROWS = 24_000
#: Features of a word beside the word: its beginnings of these lengths, when it is longer.
BEGINNINGS = (4, 5, 6)
#: A feature marks toxicity when it is in so many toxic documents and in this share of them, and this much likelier there
#: (log-odds; evidence is log-odds times toxic documents). As a share of the toxic documents is asked for, these features
#: are at most 1 / LEAST_SHARE times those of a toxic document, on average.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, LEAST_EVIDENCE = 3, 0.02, 2.0, 12.0
ROUNDS = 12
THRESHOLD = 0.7
BATCH_TOKENS = 1 << 17
#: Words whose scores a task remembers.
REMEMBERED = 1 << 17


def training_row(doc_id: Column, folds: int = 3, held_out: int = 1) -> Column:
    """Whether a row's label may be learned from. Rows without a doc_id can't have one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held_out, F.lit(False))


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by an asterisk."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def lines_of(text: str) -> list[list[str]]:
    """The words of each line as they stand, without lines that have none."""
    return [words for line in text.split("\n") if (words := WORD.findall(line))]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch that hold each feature, toxic ones and others."""
    for batch in batches:
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            into = counts[int(toxic)]
            for f in {f for w in {w.lower() for w in set(WORD.findall(text))} for f in features_of(w)}:
                into[f] = into.get(f, 0) + 1
        for toxic in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts[toxic], pa.string()), pa.array([toxic] * len(counts[toxic]), pa.int32()), pa.array(counts[toxic].values(), pa.int64())],
                ["feature", "toxic", "n"],
            )


def marking_features(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """feature -> log-odds of toxicity, for those that mark it: a bounded number."""
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * n_toxic))
    counted = sample.select("text", "toxic").mapInArrow(_seen, "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    odds = F.log((F.col("a") / F.lit(float(max(1, n_toxic)))) / ((F.col("b") + 1) / F.lit(float(max(1, n_clean)))))
    chosen = counted.filter(F.col("a") >= least).withColumn("odds", odds).withColumn("evidence", F.col("a") * F.col("odds"))
    rows = chosen.filter((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("evidence"), "feature").collect()
    return {r["feature"]: r["odds"] for r in rows}


LINES_SCHEMA = "n int, at array<int>, feature array<int>, toxic int"


def _encode_lines(feature_no: dict[str, int]):
    """Texts -> for each line its number of words and the words' marking features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for words in lines_of(text):
                    found = [(i, feature_no[f]) for i, w in enumerate(words) for f in features_of(w.lower()) if f in feature_no]
                    out.append((len(words), [i for i, _ in found], [f for _, f in found], toxic))
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["n", "at", "feature", "toxic"])

    return run


def marginals(pack: Packed, scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each element (sequence after sequence) to be toxic, and expected counts of neighbouring labels.

    scores: the log-potential of the label toxic over the other; trans: potentials of neighbours, other label first.
    """
    emit = np.ones((len(scores), 2))
    emit[pack.place, 1] = np.exp(np.clip(scores, -30, 30))
    alpha, scale = pack.forward(np.ones(2), trans, emit)
    beta, pairs = pack.backward(trans, emit, scale, alpha)
    return (alpha * beta)[pack.place, 1], pairs


def _gradient(weights: np.ndarray, n_features: int):
    """The likelihood's gradient in (bias, three transitions, features), of a partition's lines."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(4 + n_features)
        trans = np.exp(np.array([[0.0, weights[1]], [weights[2], weights[3]]]))
        for batch in batches:
            lengths = batch.column("n").to_numpy().astype(np.int64)
            work = np.cumsum(lengths)
            cuts = np.unique(np.searchsorted(work, np.arange(BATCH_TOKENS, work[-1] + BATCH_TOKENS, BATCH_TOKENS)).clip(max=len(lengths) - 1) + 1) if len(work) else []
            begin = 0
            for stop in cuts:
                some = batch.slice(begin, stop - begin)
                n = lengths[begin:stop]
                begin = stop
                at, feature = some.column("at"), some.column("feature")
                per_line = np.diff(at.offsets.to_numpy())
                place = np.repeat(np.cumsum(n) - n, per_line) + at.flatten().to_numpy()
                feature = feature.flatten().to_numpy()
                scores = np.full(n.sum(), weights[0])
                np.add.at(scores, place, weights[4 + feature])
                marked = np.zeros(len(scores), bool)
                marked[place] = True
                label = marked & np.repeat(some.column("toxic").to_numpy() == 1, n)
                pack = Packed(n)
                toxic, pairs = marginals(pack, scores, trans)
                off = label - toxic
                total[0] += off.sum()
                total[4:] += np.bincount(feature, weights=off[place], minlength=n_features)
                first, second = np.flatnonzero(pack.later) - 1, np.flatnonzero(pack.later)
                a, b = label[first], label[second]
                total[1:4] += (~a & b).sum() - pairs[0, 1], (a & ~b).sum() - pairs[1, 0], (a & b).sum() - pairs[1, 1]
        return total

    return part


def fit_field(lines: DataFrame, odds: list[float], rounds: int = ROUNDS) -> np.ndarray:
    """bias, transitions to, from and within toxic words, and a weight for each feature; by resilient gradient steps."""
    weights = np.concatenate(([-5.0, 0.0, 0.0, 0.0], np.asarray(odds, float)))
    step, before = np.full(len(weights), 0.3), np.zeros(len(weights))
    for _ in range(rounds if odds else 0):
        # Rounded, so that the order in which partitions are summed can't turn a sign.
        slope = np.round(vector_sum(lines, _gradient(weights, len(odds)), len(weights)) - 0.1 * weights, 6)
        turned = np.sign(slope * before)
        step = np.where(turned > 0, np.minimum(1.0, step * 1.2), np.where(turned < 0, step * 0.5, step))
        weights = weights + np.sign(slope) * step
        before = slope
    return weights


class _Scores(dict):
    """word -> score, worked out when it is first met."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = score = self.bias + sum(self.weights.get(f, 0.0) for f in features_of(word.lower()))
        return score


def _summaries(weights: dict[str, float], bias: float, trans: np.ndarray):
    """Texts -> the sum and the maximum of their words' marginals, and the spans of words likelier toxic than not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_scores = _Scores(weights, bias)
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            total, most, spans = [], [], []
            texts, scores, lengths, n_lines = [], [], [], []

            def flush() -> None:
                n = np.array(lengths, np.int64)
                toxic = marginals(Packed(n), np.array(scores), trans)[0] if len(n) else np.empty(0)
                end = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(n_lines))).astype(np.int64)]
                for text, a, b in zip(texts, end[:-1], end[1:]):
                    own = toxic[a:b]
                    total.append(float(own.sum()))
                    most.append(float(own.max(initial=0.0)))
                    found = np.flatnonzero(own > 0.5)
                    bounds = [m.span() for m in WORD.finditer(text)] if len(found) else []
                    spans.append([{"start": bounds[i][0], "end": bounds[i][1]} for i in found])
                for x in (texts, scores, lengths, n_lines):
                    x.clear()

            for text in batch.column("text") if "text" in batch.schema.names else batch.column("doc").field("text"):
                text = text.as_py() or ""
                lines = lines_of(text)
                texts.append(text)
                n_lines.append(len(lines))
                for words in lines:
                    lengths.append(len(words))
                    scores.extend([word_scores[w] for w in words])
                if len(scores) >= BATCH_TOKENS:
                    flush()
            flush()
            columns = [pa.array(total, pa.float64()), pa.array(most, pa.float64()), pa.array(spans, span_type)]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, "total", "most", "spans"])

    return run


SPANS = ArrayType(StructType().add("start", LongType()).add("end", LongType()))
SUMMARY = StructType().add("total", DoubleType()).add("most", DoubleType()).add("spans", SPANS)


def _calibrate(rows: list[tuple[float, float, int]]) -> np.ndarray:
    """Logistic regression of the label on (1, log(1 + total), most), with a small penalty, by Newton steps."""
    rows = sorted(rows)
    x = np.array([(1.0, math.log1p(a), b) for a, b, _ in rows]).reshape(-1, 3)
    y = np.array([label for _, _, label in rows], float)
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - np.array([1e-3, 0.1, 0.1]) * w)
    return w


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for each row of docs. labels has doc_id and toxic. Also the columns that
    carry names, the text among them if need be.

    Learns from the labels of training rows alone, from at most about sample_rows of them. Null and empty texts get the
    score of a text without words. Rows without a doc_id are scored; held_out is false for them. Labels that are null,
    or whose document is missing, teach nothing; a document with several labels is toxic if one says so. Equal texts
    among the sample count once, toxic if one of them is. Repeated rows give a row each; columns beside doc_id and text are not looked at.
    Without labels of both kinds all scores are 0. Offsets are characters of the text.
    """
    kept = ["doc_id", *carry]
    rows = docs.select("doc_id", "text", F.struct(*kept).alias("doc"))
    to_score = rows.select("doc") if "text" in carry else rows.select("doc", "text")
    result = ["doc.*", "held_out", "score", "predicted", "spans"]
    known = labels.filter(F.col("toxic").isNotNull() & training_row(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(1, known.count()))
    # The sample's bound is the bound of what is broadcast.
    picked = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))
    sample = rows.join(F.broadcast(picked), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic"))
    sample = saved(sample, "toxic-sample")
    n_toxic, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    rows_held_out = ~training_row(F.col("doc_id")) & F.col("doc_id").isNotNull()
    if n_toxic in (0, n):
        no_spans = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
        return rows.select("doc.*", rows_held_out.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), no_spans.alias("spans"))
    odds = marking_features(sample, n_toxic, n - n_toxic)
    lines = saved(sample.mapInArrow(_encode_lines({f: i for i, f in enumerate(odds)}), LINES_SCHEMA), "toxic-lines")
    found = fit_field(lines, list(odds.values()), rounds)
    trans = np.exp(np.array([[0.0, found[1]], [found[2], found[3]]]))
    field = dict(zip(odds, found[4:].tolist())), float(found[0]), trans
    fitted = sample.mapInArrow(_summaries(*field), StructType([sample.schema["toxic"], *SUMMARY])).select("total", "most", "toxic").collect()
    bias, by_total, by_most = _calibrate([tuple(r) for r in fitted]).tolist()
    schema = StructType([rows.schema["doc"], *SUMMARY])
    scored = to_score.mapInArrow(_summaries(*field), schema)
    score = F.round(1 / (1 + F.exp(-(F.lit(bias) + F.lit(by_total) * F.log1p("total") + F.lit(by_most) * F.col("most")))), 9)
    scored = scored.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    held_out = ~training_row(F.col("doc.doc_id")) & F.col("doc.doc_id").isNotNull()
    return scored.withColumn("held_out", held_out).select(*result)
