"""Substring dedup: removes every run of 20 words that also starts earlier in the corpus.

Suffix automata of reference shards find the runs. A run's least-hashed word group (its anchor) depends on the run
alone, so equal runs have equal anchors: anchors that occur once in the corpus need no further look, and the stretches
around the others are dealt by anchor. A shard is what one anchor gathers: its earlier stretches form a suffix
automaton, each further stretch streams through it for matching statistics, and where these reach the run's length the
run occurs earlier. Automata of the whole corpus have no size bound, so they are built where their shard is dealt and
not broadcast.

Hot anchors are thinned before each shuffle: within a batch an anchor seen twice is known to be repeated, and equal
stretches after the first are known to be removed. A shard with too many different stretches is dealt again by run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.llm.automaton import SuffixAutomaton
from stratadoc.llm.words import word_bounds
from stratadoc.session import saved

WINDOW = 20
#: Words of an anchor.
GRAM = 6
#: Bytes of text whose anchors are found at once; different stretches that one automaton holds.
CHUNK_BYTES = 1 << 20
SHARD_STRETCHES = 1024
NO_ID = -(1 << 63)

#: Fixed odd multipliers of the hashes of bytes, words and word groups.
BYTE_BASE, WORD_BASE = 0x100000001B3, 0x9E3779B97F4A7C15
_INVERSE = pow(BYTE_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes so that their order tells nothing of the words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1), base, np.uint64))))


class _Hasher:
    """Hashes the words of a buffer: equal words have equal hashes wherever they lie."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def words(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(raw):
            self.up, self.down = _powers(BYTE_BASE, 2 * len(raw)), _powers(_INVERSE, 2 * len(raw))
        b = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(b * self.up[: len(raw)])))
        return _mix((sums[ends] - sums[starts]) * self.down[starts])


def _gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    n = len(words) - gram + 1
    found = np.zeros(n, np.uint64)
    for j in range(gram):
        found = found * np.uint64(WORD_BASE) + words[j : n + j]
    return _mix(found)


def find_anchors(raw: bytes, doc_ends: np.ndarray, hasher: _Hasher, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts that end at doc_ends (in bytes) of raw: hash, text, lo, hi, at for each anchor.

    lo to hi (inclusive) are the starts of the windows whose least-hashed gram starts at `at`; the leftmost where grams
    are equal. All are word numbers within the text.
    """
    starts, ends = word_bounds(raw)
    empty = tuple(np.empty(0, np.int64) for _ in range(5))
    if len(starts) < window:
        return empty
    doc = np.searchsorted(doc_ends, starts, side="right")
    grams = _gram_hashes(hasher.words(raw, starts, ends), gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    whole = np.flatnonzero(doc[: len(views)] == doc[window - 1 :])
    if not len(whole):
        return empty
    at = views.argmin(axis=1)[whole] + whole
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[whole[1:]] != doc[whole[:-1]]))))
    lo, hi, at = whole[new], whole[np.append(new[1:], len(whole)) - 1], at[new]
    base = np.searchsorted(doc, doc[lo], side="left")
    return grams[at].view(np.int64), doc[lo], lo - base, hi - base, at - base


def _chunks(contents: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    held, size, first = [], 0, 0
    for i, x in enumerate(contents):
        held.append(x.as_py())
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


ANCHOR_SCHEMA = "route long, key long, place long, kind int"
#: Kinds of anchor rows: alone in its batch; one that stands for several; known to be repeated.
ALONE, SEVERAL, KNOWN = 0, 1, 2


def _emit_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            found = []
            for first, texts in _chunks(batch.column("content")):
                ends = np.cumsum([len(x) + 1 for x in texts])
                h, doc, lo, hi, at = find_anchors(b"\n".join(texts), ends, hasher, window, gram)
                found.append((h, keys[doc + first], lo << 10 | (hi - lo) << 5 | (at - lo)))
            if not found:
                continue
            h, key, place = (np.concatenate(x) for x in zip(*found))
            _, first, group, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            kind = np.where(count[group] > 1, KNOWN, ALONE).astype(np.int32)
            kind[first[count > 1]] = SEVERAL
            route = np.where(kind == KNOWN, _mix((key + place).view(np.uint64)).view(np.int64), h)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route, key, place, kind)], ["route", "key", "place", "kind"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor rows sorted by route -> key, place of those whose anchor occurs more than once."""
    out = lambda key, place: pa.RecordBatch.from_arrays([pa.array(key), pa.array(place)], ["key", "place"])
    last = None  # the last row (route, key, place, may still be alone); its group may go on in the next batch
    for batch in batches:
        route, key, place, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("route", "key", "place", "kind"))
        if not len(route):
            continue
        same = route[1:] == route[:-1]
        goes_on = last is not None and last[0] == route[0]
        again = np.concatenate(([goes_on], same)) | np.concatenate((same, [False])) | (kind != ALONE)
        if goes_on and last[3]:
            yield out([last[1]], [last[2]])
        yield out(key[again], place[again])
        last = int(route[-1]), int(key[-1]), int(place[-1]), not again[-1]


STRETCH_SCHEMA = "route long, id long, key long, lo long, n long, words binary"
STRETCH_NAMES = ["route", "id", "key", "lo", "n", "words"]


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], STRETCH_NAMES)


def _emit_stretches(window: int, gram: int):
    """Documents with their repeated anchors -> a row for each stretch; without words where it is known to be removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            met: list[tuple] = []
            for id_, key, content, places in zip(*(batch.column(c) for c in ("id", "key", "content", "places"))):
                raw, id_, key = content.as_py(), id_.as_py(), key.as_py()
                starts, ends = word_bounds(raw)
                place = np.unique(places.values.to_numpy(zero_copy_only=False))
                lo = place >> 10
                last, at = lo + (place >> 5 & 31), lo + (place & 31)
                # Two texts of one key (equal hashes) may differ in length.
                fits = last + window <= len(starts)
                lo, last, at = lo[fits], last[fits], at[fits]
                hashes = _gram_hashes(hasher.words(raw, starts, ends), gram)[at].view(np.int64) if len(lo) else lo
                for h, a, n, i, j in zip(hashes.tolist(), lo.tolist(), (last - lo + 1).tolist(), starts[lo].tolist(), ends[last + window - 1].tolist()):
                    met.append((h, id_, key, a, n, raw[i:j]))
            met.sort(key=lambda r: (r[1], r[2], r[3]))
            rows, seen = [], {}
            for row in met:
                words = b" ".join(row[5].split())
                first = seen.setdefault((row[0], words), row)
                if first is row:
                    rows.append((*row[:5], words))
                elif first[1:4] != row[1:4]:
                    rows.append((row[2] ^ row[3], *row[1:5], None))
            if rows:
                yield _stretch_batch(rows)

    return run


def _runs(starts: list[int]) -> Iterator[tuple[int, int]]:
    """Start and number of each run of consecutive numbers."""
    first = None
    for i, x in enumerate(starts):
        if first is None:
            first = x
        if i + 1 == len(starts) or starts[i + 1] != x + 1:
            yield first, x + 1 - first
            first = None


def _judge(window: int, most: int | None):
    """Stretches sorted by route and order -> rows without words for the removed windows.

    With most, a shard of more different stretches comes out again as single windows, to be dealt by their hash.
    """

    def again(row: tuple, words: list[bytes]) -> Iterator[tuple]:
        for i in range(row[4]):
            run = b" ".join(words[i : i + window])
            route = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little", signed=True)
            yield route, row[1], row[2], row[3] + i, 1, run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = automaton = None
        known: dict[bytes, tuple] = {}
        for batch in batches:
            judged = pc.is_null(batch.column("words"))
            passed = batch.filter(judged)
            if passed.num_rows:
                yield passed
            rows = []
            for row in zip(*(batch.filter(pc.invert(judged)).column(c).to_pylist() for c in STRETCH_NAMES)):
                if row[0] != route:
                    route, automaton, known, over = row[0], None, {}, False
                first = known.get(row[5])
                if first is not None:  # all its windows occur in an equal stretch
                    if first[1:4] != row[1:4]:
                        rows.append((row[2] ^ row[3], *row[1:5], None))
                    continue
                words = row[5].split()
                if over:
                    rows += again(row, words)
                    continue
                if known:
                    if automaton is None:
                        automaton = SuffixAutomaton()
                        automaton.add(next(iter(known)).split())
                    found = [n - window for n, _, matched in automaton.stream(words) if matched >= window]
                    rows += [(row[2] ^ row[3], row[1], row[2], row[3] + a, n, None) for a, n in _runs(found)]
                    automaton.add(words)
                known[row[5]] = row
                if most is not None and len(known) > most:
                    for text, held in known.items():
                        rows += again(held, text.split())
                    over, known, automaton = True, {}, None
            if rows:
                yield _stretch_batch(rows)

    return run


def removed_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = SHARD_STRETCHES) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, content), dealt by key, and their removed stretches of words (key, lo, hi), hi excluded."""
    order = ["route", "id", "key", "lo"]
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    anchors = rows.select("key", "content").mapInArrow(_emit_anchors(window, gram), ANCHOR_SCHEMA)
    repeated = anchors.repartition("route").sortWithinPartitions("route").mapInArrow(_repeated, "key long, place long")
    places = saved(repeated.groupBy("key").agg(F.collect_list("place").alias("places")), "anchors")
    # Both uses of the dealt documents read one shuffle.
    dealt = rows.repartition("key")
    with_places = dealt.join(places.hint("shuffle_hash"), "key").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "key", "content", "places"
    )
    stretches = with_places.mapInArrow(_emit_stretches(window, gram), STRETCH_SCHEMA)
    once = stretches.repartition("route").sortWithinPartitions(*order).mapInArrow(_judge(window, most), STRETCH_SCHEMA)
    twice = once.repartition("route").sortWithinPartitions(*order).mapInArrow(_judge(window, None), STRETCH_SCHEMA)
    return dealt, twice.select("key", "lo", (F.col("lo") + F.col("n") + F.lit(window - 1)).alias("hi"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for content, spans in zip(batch.column("content"), batch.column("spans")):
            words = content.as_py().split()
            n_words, kept, at = len(words), words, 0
            if spans.is_valid:
                kept = []
                for s in sorted((s["lo"], s["hi"]) for s in spans.as_py()):
                    kept += words[at : s[0]] if s[0] > at else []
                    at = max(at, s[1])
                kept += words[at:]
            found.append((n_words, n_words - len(kept), (b" ".join(kept)).decode()))
        columns = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string()))]
        if found:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = SHARD_STRETCHES) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by a space) for each row of docs.

    A word goes if a run of `window` words over it also starts earlier: in a smaller doc_id, or before it in the same
    document. Null doc_ids come before all others; rows that share a doc_id stand in the order of their text's hash;
    rows equal in doc_id and text are one document, returned for each. Null and empty texts have no words. Other
    columns are not looked at; an empty table gives an empty result.
    """
    dealt, runs = removed_runs(docs, window, gram, most)
    spans = runs.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "content", "spans").mapInArrow(
        _cut, f"doc_id {kind}, n_words long, n_removed long, text string"
    )


def substring_rows(found: DataFrame) -> DataFrame:
    """The digest columns of a query over substring_dedup."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
