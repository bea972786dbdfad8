"""LM scoring with a hidden Markov language model.

Latent states emit word classes, a class emits words by their counts. The most frequent words are classes of their own;
the others are put together by their last bytes, so that the states' tables have a fixed size. Word counts come from all
training texts; Baum-Welch counts are summed over partitions; the scaled forward recursion gives the likelihood of a
whole text. A class keeps half a count for words it hasn't seen, as the base model does.

Counts of frequent words go to the executors as a broadcast of a fixed number of words; the counts of all others are
joined.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadoc.llm.chains import Packed, vector_sum
from stratadoc.llm.words import BYTES_TO_LOWER
from stratadoc.session import saved

STATES = 8
OWN_CLASSES = 2000
SHARED_CLASSES = 512
#: Frequent words whose counts are broadcast, at most.
FREQUENT = 1 << 17
ROUNDS = 6
#: Tokens of texts that go through the recursions together, and of texts that a task holds so as to take like lengths together
#: (a longer text is taken alone). Texts are never cut.
BATCH_TOKENS, HELD_TOKENS = 1 << 18, 1 << 22
#: Distinct words that a task counts before it passes the counts on; rows that it encodes at once.
COUNTED, ENCODED = 1 << 18, 1024
SMOOTHING = 0.5
#: The class of a text's end is 0; classes of single words follow, then shared ones.
END = 0


def training_row(doc_id: Column, folds: int = 5, held_out: int = 1) -> Column:
    """Whether a row is learned from. Rows without a doc_id aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held_out, F.lit(False))


def shared_class(word: bytes) -> int:
    """By the last three bytes, which tell languages and word forms apart."""
    return zlib.crc32(word[-3:]) % SHARED_CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def passed_on() -> pa.RecordBatch:
        words = list(counts)
        columns = [pa.array(words, pa.binary()), pa.array([shared_class(w) for w in words], pa.int32()), pa.array(counts.values(), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "shared", "c"])

    for batch in batches:
        for content in batch.column("content"):
            counts.update(content.as_py().translate(BYTES_TO_LOWER).split())
            if len(counts) >= COUNTED:
                yield passed_on()
    yield passed_on()


def word_counts(train: DataFrame) -> DataFrame:
    """word, shared (its class when it has none of its own), c over all rows of train (content)."""
    each = train.select("content").mapInArrow(_count, "word binary, shared int, c long")
    return each.groupBy("word", "shared").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What scoring needs of the word counts beside those of rare words. All of it has a fixed bound."""

    n_tokens: int
    n_types: int
    end_count: int
    frequent: dict[bytes, tuple[int, int]]  # word -> class, count
    shared_total: np.ndarray  # log10 of the denominators of shared classes
    class_counts: np.ndarray

    @property
    def n_classes(self) -> int:
        return len(self.class_counts)


def _vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The largest set of words with a count in common that the broadcast can hold: by eighths of powers of two.
    level = F.floor(F.log2("c") * 8).cast("int")
    room, least = FREQUENT, None
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        room -= row["n"]
        if room < 0:
            break
        least = row["level"]
    chosen = [] if least is None else counts.filter(level >= least).select("word", "shared", "c").collect()
    chosen.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    first_shared = 1 + OWN_CLASSES
    frequent = {bytes(r["word"]): (i + 1 if i < OWN_CLASSES else first_shared + r["shared"], r["c"]) for i, r in enumerate(chosen)}
    in_shared = np.zeros((SHARED_CLASSES, 2))
    for row in counts.groupBy("shared").agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect():
        in_shared[row["shared"]] = row["c"], row["types"]
    class_counts = np.zeros(first_shared + SHARED_CLASSES)
    class_counts[END] = n_docs
    for r in chosen[:OWN_CLASSES]:
        in_shared[r["shared"]] -= r["c"], 1
        class_counts[frequent[bytes(r["word"])][0]] = r["c"]
    class_counts[first_shared:] = in_shared[:, 0]
    total = np.log10(in_shared[:, 0] + SMOOTHING * (in_shared[:, 1] + 1))
    return Vocabulary(n_words + n_docs, n_types + (n_docs > 0), n_docs, frequent, total, class_counts)


CODED_SCHEMA = "row_id long, doc_id {}, train boolean, n_tokens long, n_known long, base double, words double, codes binary, rare array<binary>"
CODED_NAMES = ["row_id", "doc_id", "train", "n_tokens", "n_known", "base", "words", "codes", "rare"]


def _encode(shared):
    """Texts -> their classes, and the sums that frequent words and the ends give; rare words stay to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, shared_total, end_count = shared.value
        first_shared, shared_total = 1 + OWN_CLASSES, np.array(shared_total)
        number = {w: i for i, w in enumerate(frequent)}
        kind, c = np.array(list(frequent.values()), np.int64).reshape(-1, 2).T
        # Of each frequent word: its term in the base score, its term within its class.
        base_of = np.log10(c + SMOOTHING)
        within_of = np.where(kind < first_shared, 0.0, base_of - shared_total[np.maximum(kind - first_shared, 0)])
        end_log = math.log10(end_count + SMOOTHING)
        row_id = TaskContext.get().partitionId() << 40
        for batch in (b.slice(i, ENCODED) for b in batches for i in range(0, b.num_rows, ENCODED)):
            out = []
            for content in batch.column("content"):
                words = content.as_py().translate(BYTES_TO_LOWER).split()
                at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                known, others = at[at >= 0], np.flatnonzero(at < 0).tolist()
                rare = [words[i] for i in others]
                shared_kinds = np.fromiter(map(shared_class, rare), np.int64, len(rare))
                codes = np.zeros(len(words) + 1, "<u2")  # END comes last
                codes[:-1][at >= 0] = kind[known]
                codes[others] = first_shared + shared_kinds
                base, within = end_log + base_of[known].sum(), within_of[known].sum() - shared_total[shared_kinds].sum()
                out.append((row_id, len(codes), len(codes) - len(rare) - (end_count == 0), float(base), float(within), codes.tobytes(), rare))
                row_id += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            if out:
                ids, n, n_known, base, within, codes, rare = (pa.array(x, t) for x, t in zip(zip(*out), kinds))
                yield pa.RecordBatch.from_arrays([ids, batch.column("doc_id"), batch.column("train"), n, n_known, base, within, codes, rare], CODED_NAMES)

    return run


def _by_length(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, codes (one text after the other) and lengths of texts, those of like lengths together, a bounded lot at a time."""
    lengths = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(lengths, kind="stable")
    work = np.cumsum(lengths[order])
    cuts = np.unique(np.searchsorted(work, np.arange(BATCH_TOKENS, work[-1] + BATCH_TOKENS, BATCH_TOKENS)).clip(max=len(texts) - 1) + 1) if len(texts) else []
    begin = 0
    for stop in cuts:
        some = order[begin:stop]
        begin = stop
        yield some, np.concatenate([texts[i] for i in some]).astype(np.int64), lengths[some]


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The texts' codes, so many texts at a time as a task holds."""
    texts, n = [], 0
    for batch in batches:
        for x in batch.column("codes"):
            texts.append(np.frombuffer(x.as_py(), "<u2"))
            n += len(texts[-1])
            if n >= HELD_TOKENS:
                yield texts
                texts, n = [], 0
    if texts:
        yield texts


@dataclass
class Model:
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray  # states x classes

    def of_class(self) -> np.ndarray:
        """Of each class, its probability in every state."""
        return np.ascontiguousarray(self.emit.T.astype(np.float32))


def packed(pack: Packed, codes: np.ndarray) -> np.ndarray:
    out = np.empty(len(codes), np.int64)
    out[pack.place] = codes
    return out


def first_model(class_counts: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
    """States that tend to stay, each with the classes' shares times a random factor of its own."""
    noise = np.random.default_rng(seed).normal(size=(states, len(class_counts)))
    emit = (class_counts + SMOOTHING) * np.exp(noise)
    trans = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    return Model(np.full(states, 1 / states), trans / trans.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _expected(model: Model):
    """A partition's expected counts of starts, neighbouring states, and states with classes, in one vector."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        k, n_classes = model.emit.shape
        starts, pairs, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_classes))
        trans, start, of_class = model.trans.astype(np.float32), model.start.astype(np.float32), model.of_class()
        for _, codes, lengths in (lot for texts in _held(batches) for lot in _by_length(texts)):
            pack = Packed(lengths)
            at = packed(pack, codes)
            emit = np.take(of_class, at, axis=0)
            alpha, scale = pack.forward(start, trans, emit)
            beta, near = pack.backward(trans, emit, scale, alpha)
            pairs += near
            alpha *= beta
            starts += alpha[: pack.off[1]].sum(axis=0, dtype=np.float64)
            for i in range(k):
                emits[i] += np.bincount(at, weights=alpha[:, i], minlength=n_classes)
        return np.concatenate((starts, pairs.ravel(), emits.ravel()))

    return part


def train(coded: DataFrame, class_counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training rows of coded."""
    model, n_classes = first_model(class_counts, states), len(class_counts)
    rows = coded.filter("train").select("codes")
    for _ in range(rounds):
        found = vector_sum(rows, _expected(model), states + states * states + states * n_classes)
        starts, pairs, emits = np.split(found, [states, states + states * states])
        starts, pairs, emits = starts + 1, pairs.reshape(states, states) + 1, emits.reshape(states, n_classes) + SMOOTHING / states
        model = Model(starts / starts.sum(), pairs / pairs.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    return model


def _likelihood(shared):
    """row_id, log10 likelihood of each row's classes under the model; each text as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        trans, start, of_class = model.trans.astype(np.float32), model.start.astype(np.float32), model.of_class()
        for batch in batches:
            found = np.empty(batch.num_rows)
            for some, codes, lengths in _by_length([np.frombuffer(x.as_py(), "<u2") for x in batch.column("codes")]):
                pack = Packed(lengths)
                _, scale = pack.forward(start, trans, np.take(of_class, packed(pack, codes), axis=0))
                found[some] = np.bincount(pack.sequence, weights=np.log10(scale.astype(np.float64))[pack.place], minlength=len(lengths))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(found)], ["row_id", "classes"])

    return run


def language_model_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Both scores are log10 probabilities of the whole text and its end. Null and empty texts are the end alone. Rows
    without a doc_id are held out neither way: held_out is false and nothing is learned from them. Repeated rows count
    and are scored each. With no training rows every count is zero. Other columns are not looked at.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    learned = training_row(F.col("doc_id"))
    rows = docs.select("doc_id", learned.alias("train"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    counts = saved(word_counts(rows.filter("train")), "word-counts")
    vocabulary = _vocabulary(counts, docs.select("doc_id").filter(learned).count())
    to_encode = spark.sparkContext.broadcast((vocabulary.frequent, vocabulary.shared_total.tolist(), vocabulary.end_count))
    coded = saved(rows.mapInArrow(_encode(to_encode), CODED_SCHEMA.format(kind)), "coded")
    model = train(coded, vocabulary.class_counts, states, rounds if vocabulary.n_tokens else 0)

    to_score = spark.sparkContext.broadcast((model.start, model.trans, model.emit))
    classes = coded.select("row_id", "codes").mapInArrow(_likelihood(to_score), "row_id long, classes double")
    rare = coded.select(F.col("row_id").alias("of"), F.explode("rare").alias("word")).join(counts.select("word", "c"), "word", "left")
    term = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING))
    rare = rare.groupBy("of").agg(F.sum(term).alias("rare_sum"), F.count("c").alias("rare_known"))
    joined = coded.drop("codes", "rare").join(classes, "row_id").join(rare, F.col("row_id") == F.col("of"), "left")
    rest = F.coalesce("rare_sum", F.lit(0.0))
    norm = math.log10(vocabulary.n_tokens + SMOOTHING * (vocabulary.n_types + 1))
    return joined.select(
        "doc_id", (~F.col("train") & F.col("doc_id").isNotNull()).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("classes") + F.col("words") + rest).alias("score"),
    )
