"""Finding strings in texts by their grams.

A gram is a run of GRAM bytes of UTF-8 that begins with a character; a shorter string is one itself. Texts are read twice, in
tasks that hold the grams at all places of a text against a bit filter of fixed size: first to count the sought strings' grams, then to
say where each string's rarest one stands. There the string is verified. No string is held against a text that doesn't
have that gram, and nothing is written of places where no rarest gram stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.functions.text import FUZZY_CHARS
from stratadoc.session import saved

#: Bytes of a gram; shorter strings are grams themselves.
GRAM = 8
#: Words of 64 bits of the filter.
FILTER_WORDS = 1 << 16
#: Bytes of texts that are looked at together.
LOT = 1 << 18


def maybe_in(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """rows without most of those whose key isn't in wanted, by a broadcast filter of fixed size."""
    h = F.xxhash64(*key)
    word, bit = F.pmod(h, F.lit(FILTER_WORDS)).alias("_word"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int").alias("_bit")
    held = wanted.select(*(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in key)).select(word, bit).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return rows.select("*", word, bit).join(F.broadcast(held), "_word").filter("shiftright(_bits, _bit) & 1L = 1L").drop("_word", "_bit", "_bits")


def _hashes(bytes_: np.ndarray, size: int, keys: np.ndarray | None) -> np.ndarray:
    """A number for the `size` bytes from each place on, the last GRAM - 1 places left out; keys: what is mixed in, by place."""
    n = max(0, len(bytes_) - GRAM + 1)
    found = np.empty(n, np.uint64)
    for k in range(min(GRAM, n)):
        rows = (n - k + GRAM - 1) // GRAM
        found[k::GRAM] = bytes_[k : k + rows * GRAM].view("<u8")
    if size < GRAM:
        found &= np.uint64((1 << 8 * size) - 1)
    if keys is not None:
        found ^= keys
    found += np.uint64(size)
    found *= np.uint64(0x9E3779B97F4A7C15)
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts laid end to end, GRAM - 1 more than there are, and where each begins and the last one ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    own = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
    return np.concatenate((own, np.zeros(GRAM - 1, np.uint8))), ends - ends[0]


def _places(texts: pa.Array, keys: np.ndarray | None, sizes: list[int], marked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, place among all bytes, hash of the grams that the filter lets through."""
    flat, ends = _flat(texts)
    shift = np.uint64(64 - (len(marked).bit_length() - 1))
    for at in range(0, len(flat) - GRAM + 1, LOT):
        part = flat[at : at + LOT + GRAM - 1]
        mixed = None
        if keys is not None:
            first, last = np.searchsorted(ends, [at, at + len(part) - GRAM], "right") - 1
            mixed = np.repeat(keys[first : last + 1], np.diff(np.clip(ends[first : last + 2], at, at + len(part) - GRAM + 1)))
        for size in sizes:
            hashes = _hashes(part, size, mixed)
            place = np.flatnonzero(marked[hashes >> shift])
            hashes = hashes[place].view(np.int64)
            place += at
            row = np.searchsorted(ends, place, "right") - 1
            inside = place + size <= ends[row + 1]
            if inside.any():
                yield row[inside], place[inside], hashes[inside]


def _marked(hashes: DataFrame) -> bytes:
    """A bit for each first part of a hash (gram), whether there is one: of fixed size, whatever hashes there are."""
    bits = FILTER_WORDS.bit_length() - 1
    word = F.shiftrightunsigned("gram", 64 - bits).alias("word")
    bit = F.shiftrightunsigned("gram", 58 - bits).bitwiseAND(F.lit(63)).cast("int").alias("bit")
    held = hashes.select(word, bit).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    words = np.zeros(FILTER_WORDS, "<u8")
    words[held["word"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    return np.packbits(np.unpackbits(words.view(np.uint8), bitorder="little")).tobytes()


def _keys(batch: pa.RecordBatch) -> np.ndarray | None:
    return batch.column("_key").to_numpy().view(np.uint64) if "_key" in batch.schema.names else None


def _own(keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The grams of strings (text): keep..., off (in bytes), gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.ones(1 << 6, bool)
        for batch in batches:
            flat, ends = _flat(batch.column("text"))
            sizes = np.minimum(np.diff(ends), GRAM)
            for size in np.unique(sizes[sizes > 0]).tolist():
                for row, place, gram in _places(batch.column("text"), _keys(batch), [size], every):
                    begins = (sizes[row] == size) & ((flat[place] & 0xC0) != 0x80)
                    row, off = row[begins], (place - ends[row])[begins]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in keep), pa.array(off.astype(np.int32)), pa.array(gram[begins])], [*keep, "off", "gram"])

    return run


def _counted(sizes: list[int], packed: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often the texts (text) have the grams that the filter lets through: gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            for _, _, hashes in _places(batch.column("text"), _keys(batch), sizes, marked):
                gram, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    return run


def _standing(sizes: list[int], packed: bytes, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Where the texts (text) have the grams that the filter lets through: keep..., at (in bytes), gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            ends = _flat(batch.column("text"))[1]
            for row, place, gram in _places(batch.column("text"), _keys(batch), sizes, marked):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in keep), pa.array((place - ends[row]).astype(np.int32)), pa.array(gram)], [*keep, "at", "gram"])

    return run


def occurrences(needles: DataFrame, texts: DataFrame, text_id: str = "i", on: tuple[str, ...] = ()) -> DataFrame:
    """needles (on..., needle), texts (on..., text_id, text) -> on..., needle, text_id, pos: each place (from 1) at which a
    text that agrees on `on` has a needle. An empty or null needle, and a null text, has none; text_id tells texts apart."""
    by, kinds = list(on), {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    key = [F.xxhash64(*by).alias("_key")] if by else []
    schema = "".join(f"{c} {kinds[c]}, " for c in by)
    sought = needles.select(*(F.col(c).cast(kinds[c]).alias(c) for c in by), "needle").filter("needle <> ''").distinct()
    each = sought.select(*by, "needle", *key, F.col("needle").alias("text")).mapInArrow(_own([*by, "needle"]), f"{schema}needle string, off int, gram long")
    each = saved(each, "needle-grams")
    # As many values as a gram has bytes at most.
    size = F.least(F.octet_length("needle"), F.lit(GRAM))
    sizes = sorted(r[0] for r in each.select(size).distinct().collect())
    looked = texts.select(*by, text_id, *key, "text")
    counts = looked.select(*[c for c in looked.columns if c in ("_key", "text")]).mapInArrow(_counted(sizes, _marked(each)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # Without a place for one of its grams a needle is nowhere.
    rarest = each.join(counts, "gram", "left").groupBy(*by, "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "gram")).alias("r"))
    rarest = saved(rarest.filter("r.n > 0").select(*by, "needle", "r.off", "r.gram"), "rarest-grams")
    found = looked.mapInArrow(_standing(sizes, _marked(rarest), [*by, text_id]), f"{schema}{text_id} {kinds[text_id]}, at int, gram long")
    begin = (F.col("at") - F.col("off") + 1).alias("begin")
    places = saved(rarest.join(found, [*by, "gram"]).select(*by, "needle", text_id, begin).filter("begin > 0"), "gram-places")
    held = places.join(maybe_in(texts.select(*by, text_id, "text"), places, [*by, text_id]), [*by, text_id])
    verified = held.filter("substring(cast(text as binary), begin, octet_length(needle)) = cast(needle as binary)")
    return verified.select(*by, "needle", text_id, F.expr("length(cast(substring(cast(text as binary), 1, begin - 1) as string)) + 1").alias("pos"))


def one_edit(rest: str, text: str, one_more: bool) -> bool:
    """Whether text begins with rest up to one character missing, another, or (one_more) one more."""
    n = next((k for k, (a, b) in enumerate(zip(rest, text)) if a != b), min(len(rest), len(text)))
    after = rest[n + 1 :]
    return n == len(rest) or text.startswith(after, n + 1) and n < len(text) or text.startswith(after, n) or one_more and text.startswith(rest[n:], n + 1)


def _edited(one_more: bool, by: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [one_edit(r or "", t or "", one_more) for r, t in zip(batch.column("rest").to_pylist(), batch.column("around").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(by)], batch.schema.names[:by])

    return run


def near_occurrences(needles: DataFrame, texts: DataFrame, text_id: str = "i", on: tuple[str, ...] = (), mode: str = "compat") -> DataFrame:
    """on..., needle, text_id: the texts that hold a needle up to one edit, as functions.text.fuzzy_in has it.

    With one edit, one half of the needle stands in the text as it is; where a half stands, the other is compared with
    what is beside it. Needles under FUZZY_CHARS characters must occur as they are.
    """
    if mode not in ("compat", "edit1"):
        raise ValueError(mode)
    by = list(on)
    sought = needles.select(*by, "needle").filter("needle <> ''").distinct()
    n, half = F.length("needle"), F.floor(F.length("needle") / 2).cast("int")
    left, right = F.expr("left(needle, int(floor(length(needle) / 2)))"), F.substring("needle", half + 1, n)
    side = lambda first, seed, rest: F.struct(F.lit(first).alias("first"), seed.alias("seed"), rest.alias("rest"))
    whole = F.struct(F.lit(True).alias("first"), F.col("needle").alias("seed"), F.lit("").alias("rest"))
    seeds = sought.select(*by, "needle", F.explode(F.when(n >= FUZZY_CHARS, F.array(side(True, left, right), side(False, right, left))).otherwise(F.array(whole))).alias("s"))
    seeds = saved(seeds.select(*by, "needle", "s.*"), "seeds")
    at = occurrences(seeds.select(*by, F.col("seed").alias("needle")), texts, text_id, on).withColumnRenamed("needle", "seed")
    rows = seeds.join(at, [*by, "seed"]).join(texts.select(*by, text_id, "text"), [*by, text_id])
    size = F.length("rest")
    after = F.substring("text", F.col("pos") + F.length("seed"), size + 1)
    begin = F.greatest(F.col("pos") - size - 1, F.lit(1))
    before = F.reverse(F.substring("text", begin, F.col("pos") - begin))
    rest = F.when(F.col("first"), F.col("rest")).otherwise(F.reverse("rest"))
    windows = rows.select(*by, "needle", text_id, rest.alias("rest"), F.when(F.col("first"), after).otherwise(before).alias("around"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema.fields[: len(by) + 2])
    return windows.mapInArrow(_edited(mode == "edit1", len(by) + 2), schema).distinct()

