"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often over a corpus.

An array over the first vocabulary names the entry of the second with the same bytes. Groups of one token each that agree
with it are counted in vectors as long as the vocabulary; only the pairs of all other groups enter a shuffle. Texts go in
lots of bounded size: a lot's pairs get their corpus-wide counts once, and its documents take them by position.

Both tokenizers cut before a single space between two characters that aren't white space, whatever stands around it: the
first one's pattern ends a piece there, and no entry of the second has a space after another character (this is looked
up when it is loaded; without it texts are taken whole). So a text is a row of stretches, and a stretch's tokens, groups
and pairs are worked out once and remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.session import saved, spread

#: The sign for a space in the second tokenizer's pieces, and its byte entries.
SPACE_SIGN = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bits of a pair that the second id takes.
B_BITS = 24
#: Characters of a lot's texts (a longer text is a lot of its own); stretches and characters that a worker remembers.
LOT_CHARS = 1 << 23
REMEMBERED, REMEMBERED_CHARS = 400_000, 1 << 24
#: Stretches that the tokenizers get at once, and as one text.
LEARNED, JOINED = 16_384, 128


def byte_level_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level entries: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class _Stretches(dict):
    """stretch -> number; new ones wait in pending."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []
        self.chars = 0

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.pending.append(key)
        self.chars += len(key)
        return n


class Aligner:
    """Both tokenizers, and what is remembered of stretches."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet, vocabulary = byte_level_alphabet(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(BYTE_PIECE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        # Byte entries last: where a byte has a piece of its own, that is the one that texts get.
        by_bytes: dict[bytes, int] = {}
        for i in sorted(range(len(pieces)), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)):
                by_bytes.setdefault(self.b_bytes[i], i)
        self.same = np.array([by_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_size, self.b_size = (np.array([len(x) for x in xs], np.int64) for xs in (self.a_bytes, self.b_bytes))
        self.cuts = not any(p[i] == SPACE_SIGN != p[i - 1] for p in pieces for i in range(1, len(p)))
        self.decimal = np.empty(0, object)
        self.forget()

    def forget(self) -> None:
        self.known = _Stretches()
        self.fits: np.ndarray = np.empty(0, bool)
        self.counts = np.empty((0, 4), np.int64)  # tokens of A and of B, groups, links
        self.written: list[bytes] = []
        self.single, self.single_end = np.empty(0, np.int64), np.zeros(1, np.int64)  # ids of A, stretch by stretch
        self.pairs, self.pairs_end = np.empty(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        """The stretches of a text that isn't empty."""
        parts = CUT.split(text) if self.cuts else [text]
        return np.fromiter(map(self.known.__getitem__, parts), np.int32, len(parts))

    def learn(self) -> None:
        """Works out the stretches that are new."""
        new, self.known.pending = self.known.pending, []
        for i in range(0, len(new), LEARNED):
            self._learn(new[i : i + LEARNED])

    def _learn(self, new: list[str]) -> None:
        whole = [f" {x}" for x in new]
        raw = [x.encode() for x in whole]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        alike = np.array([self.cuts and not (x[0].isspace() or x[-1].isspace()) for x in new], bool)
        a, n_a, fits_a = _by_stretch(lambda texts: [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], whole, raw, size, alike, self.a_bytes, self.a_size)
        b, n_b, fits_b = _by_stretch(lambda texts: self.b.encode([x[1:] for x in texts], num_threads=1), whole, raw, size, alike, self.b_bytes, self.b_size)
        fits = fits_a & fits_b
        flat_a, flat_b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)]
        n_a, n_b = n_a * fits, n_b * fits
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        # Between two neighbouring cuts lies the overlap of one token of A with one of B: a link.
        cuts = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        cuts = cuts[np.concatenate((np.ones(min(1, len(cuts)), bool), cuts[1:] != cuts[:-1]))]
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        ids_a, ids_b = flat_a[at_a], flat_b[at_b]
        closes = (ends_a[at_a] == cuts) & (ends_b[at_b] == cuts)
        owner = np.repeat(np.arange(len(new)), n_a)[at_a]
        alone = closes & np.concatenate((np.ones(min(1, len(closes)), bool), closes[:-1]))
        regular = alone & (self.same[ids_a] == ids_b)
        counted = lambda mask: np.bincount(owner[mask], minlength=len(new))
        n_links = np.bincount(owner, minlength=len(new))
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, counted(closes), n_links), axis=1)))
        self.fits = np.concatenate((self.fits, fits))
        self.single = np.concatenate((self.single, ids_a[regular]))
        self.single_end = np.concatenate((self.single_end, self.single_end[-1] + np.cumsum(counted(regular))))
        self.pairs = np.concatenate((self.pairs, (ids_a << B_BITS | ids_b)[~regular]))
        self.pairs_end = np.concatenate((self.pairs_end, self.pairs_end[-1] + np.cumsum(n_links - counted(regular))))
        ends = cuts[closes]
        self._write(flat_a, flat_b, np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b), np.cumsum(n_a + n_b))

    def _write(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, stretch_ends: np.ndarray) -> None:
        """Adds each stretch's groups as text: ids of A, a bar, ids of B; groups apart by semicolons."""
        if not len(self.decimal):
            ids = range(max(len(self.a_bytes), len(self.b_bytes)))
            self.decimal = np.array([[b"%d%c" % (i, c) for c in b",|;"] for i in ids], object)
        order = np.argsort(np.concatenate((group_a, group_b)), kind="stable")
        group, second = np.concatenate((group_a, group_b))[order], order >= len(a)
        last = np.concatenate((group[1:] != group[:-1], np.ones(min(1, len(group)), bool)))
        bar = ~last & (second != np.concatenate((second[1:], second[:1])))
        pieces = self.decimal[np.concatenate((a, b))[order], np.where(last, 2, bar.astype(np.int64))].tolist()
        begin = 0
        for end in stretch_ends.tolist():
            self.written.append(b"".join(pieces[begin:end]))
            begin = end


def _by_stretch(
    encode: Callable[[list[str]], list[list[int]]], whole: list[str], raw: list[bytes], size: np.ndarray, alike: np.ndarray, entry: list[bytes], entry_size: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all stretches, their number in each, and whether they give its bytes.

    Stretches that a text of them would be cut between go to the tokenizer as such texts; the others go alone.
    """
    n = len(whole)
    ids, count, fits = [[]] * n, np.zeros(n, np.int64), np.zeros(n, bool)

    def alone(places: list[int]) -> None:
        for i, x in zip(places, encode([whole[i] for i in places]) if places else []):
            ids[i], count[i] = x, len(x)
            fits[i] = b"".join(map(entry.__getitem__, x)) == raw[i]

    places = np.flatnonzero(alike)
    lots = [places[i : i + JOINED] for i in range(0, len(places), JOINED)]
    for lot, found in zip(lots, encode(["".join(whole[i] for i in lot.tolist()) for lot in lots]) if lots else []):
        at, begin, end = np.array(found, np.int64), 0, 0
        ends = np.searchsorted(np.cumsum(entry_size[at]), np.cumsum(size[lot])) + 1
        if b"".join(map(entry.__getitem__, found)) != b"".join(raw[i] for i in lot.tolist()):
            alone(lot.tolist())
            continue
        for i, end in zip(lot.tolist(), ends.tolist()):
            ids[i] = found[begin:end]
            begin = end
        count[lot], fits[lot] = np.diff(ends, prepend=0), True
    alone(np.flatnonzero(~alike).tolist())
    return np.fromiter(chain.from_iterable(ids), np.int64, count.sum()), count, fits


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], ... for count[0] places, then begin[1], ..."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


def _lists(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """values as n lists; owner says of which list each is, in order."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


DOCUMENT, LOT, VECTOR = range(3)
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: A row is of a document, of a lot (its pairs and their counts), or a task's vector of one-to-one groups.
ALIGNED = f"kind int, lot long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, single array<int>, single_n array<int>, place array<int>, place_n array<int>, pairs array<long>, pairs_n array<long>"


def _solve(aligner: Aligner, lot: int, doc_ids: list[pa.Array], numbers: list[np.ndarray], vector: np.ndarray, doc_type: pa.DataType) -> pa.RecordBatch:
    """A lot's rows: one for each document, and one for itself. vector takes its one-to-one groups."""
    aligner.learn()
    n = len(numbers)
    for i, x in enumerate(numbers):
        if not aligner.fits[x].all():
            numbers[i] = x[:0]
    lengths = np.fromiter(map(len, numbers), np.int64, n)
    flat, doc = np.concatenate(numbers).astype(np.int64), np.repeat(np.arange(n), lengths)
    sums = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(aligner.counts[flat], axis=0)))
    ends = np.cumsum(lengths)
    counts = sums[ends] - sums[ends - lengths]
    digests = [hashlib.sha256(b"".join(map(aligner.written.__getitem__, x.tolist()))[:-1]).hexdigest() if len(x) else "" for x in numbers]
    keys, times = _tally(doc << 32 | flat, np.ones(len(flat), np.int64))
    doc, stretch = keys >> 32, keys & 0xFFFFFFFF

    def held(values: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = end[stretch + 1] - end[stretch]
        return np.repeat(doc, count), values[_ranges(end[stretch], count)], np.repeat(times, count)

    of, ids, weight = held(aligner.single, aligner.single_end)
    single, single_n = _tally(of << 32 | ids, weight)
    vector += np.bincount(ids, weights=weight, minlength=len(vector)).astype(np.int64)
    of, pairs, weight = held(aligner.pairs, aligner.pairs_end)
    distinct, place = np.unique(pairs, return_inverse=True)
    pairs_n = np.bincount(place, weights=weight, minlength=len(distinct)).astype(np.int64)
    place, place_n = _tally(of << 32 | place, weight)
    none = lambda kind: pa.nulls(1, kind)
    ints, longs, low = pa.list_(pa.int32()), pa.list_(pa.int64()), 0xFFFFFFFF
    columns = [
        (pa.concat_arrays(doc_ids), none(doc_type)),
        (pa.array(np.full(n, DOCUMENT), pa.int32()), pa.array([LOT], pa.int32())),
        (pa.array(np.full(n, lot)), pa.array([lot])),
        *((pa.array(counts[:, k]), none(pa.int64())) for k in range(4)),
        (pa.array(digests, pa.string()), none(pa.string())),
        *((_lists(keys >> 32, x, n, pa.int32()), none(ints)) for keys, x in ((single, single & low), (single, single_n), (place, place & low), (place, place_n))),
        *((pa.nulls(n, longs), _lists(np.zeros(len(x), np.int64), x, 1, pa.int64())) for x in (distinct, pairs_n)),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], _names())


def _names() -> list[str]:
    return ["doc_id", *(x.split()[0] for x in ALIGNED.split(", "))]


def _align(a_path: str, b_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, lot, doc_type = Aligner(a_path, b_path), TaskContext.get().partitionId() << 32, pa.int64()
        vector = np.zeros(len(aligner.same), np.int64)
        ids: list[pa.Array] = []
        numbers: list[np.ndarray] = []
        chars = 0
        for batch in batches:
            doc_id, doc_type = batch.column("doc_id"), batch.schema.field("doc_id").type
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                ids.append(doc_id.slice(i, 1))
                numbers.append(aligner.numbers(text) if text else np.empty(0, np.int32))
                chars += len(text or "") + 16
                if chars >= LOT_CHARS:
                    yield _solve(aligner, lot, ids, numbers, vector, doc_type)
                    ids, numbers, chars, lot = [], [], 0, lot + 1
                    if len(aligner.known) > REMEMBERED or aligner.known.chars > REMEMBERED_CHARS:
                        aligner.forget()
        if numbers:
            yield _solve(aligner, lot, ids, numbers, vector, doc_type)
        at = np.flatnonzero(vector)
        null = {c: pa.nulls(1, t) for c, t in zip(_names(), [doc_type, pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int32())] * 4])}
        null["kind"] = pa.array([VECTOR], pa.int32())
        one = lambda x: _lists(np.zeros(len(x), np.int64), x, 1, pa.int64())
        yield pa.RecordBatch.from_arrays([*null.values(), one(at << B_BITS | aligner.same[at]), one(vector[at])], _names())

    return run


def _list_sums(column: pa.ChunkedArray, value: Callable[[np.ndarray], np.ndarray], times: pa.ChunkedArray) -> np.ndarray:
    """For each list the sum of value(element) times the number beside it."""
    column, times = column.combine_chunks(), times.combine_chunks()
    sums = np.concatenate(([0], np.cumsum(value(column.flatten().to_numpy()) * times.flatten().to_numpy())))
    ends = np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy()))))
    return sums[ends[1:]] - sums[ends[:-1]]


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n, best: how many links of the corpus hold each pair, and whether no pair of its B id has more."""
    each = aligned.filter(F.col("kind") != DOCUMENT).select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("p"))
    counts = saved(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pairs_n").alias("n")), "pair-counts")
    b = F.expr(f"pair & {(1 << B_BITS) - 1}L").alias("b")
    # A row for each entry of B's vocabulary at most.
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.select("*", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The table that `_align` makes of docs, in the shared folder; beside document rows it has those of lots and vectors."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return saved(spread(docs.select("doc_id", "text")).mapInArrow(_align(a_path, b_path), f"doc_id {kind}, {ALIGNED}"), "aligned")


def aligned_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    a_path is a byte-level tokenizer (.json), b_path a sentencepiece model that adds a space in front; both files must be
    readable on the executors. Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no
    tokens: zeros and an empty groups_sha256. Repeated rows and repeated or null doc_ids give a row each, and their links
    count each time. An empty table gives an empty result. Columns beside doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    aligned = align(docs, a_path, b_path)
    flagged = saved(pair_counts(aligned), "flagged-pairs")
    # The one-to-one groups' pairs are one for each entry of A's vocabulary at most.
    regular = aligned.filter(F.col("kind") == VECTOR).select(F.explode("pairs").alias("pair")).distinct()
    rows = flagged.join(regular, "pair", "left_semi").toArrow()
    ids = rows["pair"].to_numpy() >> B_BITS
    count, best = np.zeros(ids.max(initial=0) + 1, np.int64), np.zeros(ids.max(initial=0) + 1, np.int64)
    count[ids], best[ids] = rows["n"].to_numpy(), rows["best"].to_numpy()
    placed = aligned.filter(F.col("kind") == LOT).select("lot", F.posexplode("pairs").alias("pos", "pair"))
    known = placed.join(flagged, "pair").groupBy("lot").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "best"))).alias("k"))
    known = known.select(F.col("lot").alias("of"), F.col("k.n").alias("n"), F.col("k.best").alias("best"))

    def values(documents: pa.Table, lot: pa.Table) -> pa.Table:
        n, flag = (lot[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if lot.num_rows else np.zeros(0, np.int64) for c in ("n", "best"))
        single, place = (documents["single"], documents["single_n"]), (documents["place"], documents["place_n"])
        total, bests = (_list_sums(single[0], v.__getitem__, single[1]) + _list_sums(place[0], w.__getitem__, place[1]) for v, w in ((count, n), (best, flag)))
        return pa.table([*(documents[c] for c in ("doc_id", *COUNTS)), pa.array(bests), pa.array(total), documents["groups_sha256"]], names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    own = aligned.filter(F.col("kind") == DOCUMENT).select("doc_id", "lot", *COUNTS, "groups_sha256", "single", "single_n", "place", "place_n")
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"
    return own.groupBy("lot").cogroup(known.groupBy("of")).applyInArrow(values, schema)
