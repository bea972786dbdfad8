"""Benchmark decontamination with a generalised suffix automaton.

The normalised items of a benchmark are dealt to blocks of bounded size; a task makes the suffix automaton over words
of each and writes it down, and Spark sends these files to the executors. Documents stream through the automata: at each
word an automaton knows the longest suffix of the document so far that occurs in an item. Where that length reaches a
window's length the window's words are hit. However many blocks there are, documents are read once and never shuffled,
and a task holds one automaton at a time. The driver sees the files' names only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratadoc.llm.automaton import SuffixAutomaton
from stratadoc.llm.words import ALNUM_RE, ALNUM_WORD, TO_LOWER, ascii_lower
from stratadoc.session import saved
from stratadoc.sources.corpus import running_sum

#: Words of benchmark text at which a block is full (its last item may go beyond).
BLOCK_WORDS = 200_000
WINDOW = 10


class ItemAutomaton(SuffixAutomaton):
    """Suffix automaton of several word sequences, with the items whose windows end in each state."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int) -> None:
        super().__init__()
        self.window = window
        prefixes = [(name, len(words), self.add(words)) for name, words in items]
        # A window of an item ends at one of its prefixes: the last `window` words, or all words of a shorter item.
        full: list[set[str]] = [set() for _ in self.link]
        short: list[dict[int, set[str]]] = [{} for _ in self.link]
        for name, n_words, states in prefixes:
            if n_words < window:
                short[states[-1]].setdefault(n_words, set()).add(name)
            for state in states[window - 1 :]:
                full[state].add(name)
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in by_length:  # what ends in a suffix ends here too
            for n, names in short[self.link[state]].items():
                short[state].setdefault(n, set()).update(names)
        for state in reversed(by_length):  # the window is a suffix of all that ends here
            if self.length[self.link[state]] >= window:
                full[self.link[state]] |= full[state]
        self.full = [frozenset(x) for x in full]
        self.short = [tuple((n, frozenset(v)) for n, v in sorted(x.items(), reverse=True)) for x in short]

    def hits(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit spans of words (half-open, in order, merged) and the items whose windows occur."""
        link, length, window, full, short = self.link, self.length, self.window, self.full, self.short
        spans: list[list[int]] = []
        items: set[str] = set()
        for at, state, matched in self.stream(words):
            longest = 0
            if matched >= window:
                holder = state
                while length[link[holder]] >= window:
                    holder = link[holder]
                if full[holder]:
                    longest = window
                    items |= full[holder]
            for n, names in short[state]:
                if n <= matched:
                    longest = max(longest, n)
                    items |= names
            if longest:
                start = at - longest
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = at
                else:
                    spans.append([start, at])
        return [(a, b) for a, b in spans], items


def _automaton_of(window: int):
    """A block's items -> its automaton, as bytes."""

    def build(block: pd.DataFrame) -> pd.DataFrame:
        items = [(item, ALNUM_RE.findall(text)) for item, text in zip(block["item"], block["text"])]
        return pd.DataFrame({"automaton": [pickle.dumps(ItemAutomaton(sorted(items), window))]})

    return build


def item_automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """Makes the automata of a benchmark's items and has Spark send them to every executor, later ones too; the names of
    their files. Items with null ids or without words have none; equal rows are one."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), ascii_lower(F.col("text")).alias("text")).distinct()
    n_words = F.regexp_count("text", F.lit(ALNUM_WORD))
    placed = running_sum(items.filter(F.col("item").isNotNull() & (n_words > 0)).withColumn("all", F.lit(0)), "all", "item", n_words, "before")
    blocks = placed.withColumn("block", F.floor(F.col("before") / F.lit(block_words))).groupBy("block")
    stored = saved(blocks.applyInPandas(_automaton_of(window), "automaton binary"), "item-automata", maxRecordsPerFile=1)
    files = [r["f"] for r in stored.select(F.input_file_name().alias("f")).distinct().collect()]
    for f in files:
        spark.sparkContext.addFile(f)
    return sorted(f.rsplit("/", 1)[-1] for f in files)


#: The automaton that a worker holds, by its file's name: one, so that memory is that of a block.
_HELD: dict[str, ItemAutomaton] = {}


def _automata(names: list[str]) -> Iterator[ItemAutomaton]:
    """One after the other. A single one is read once for as long as the worker lives."""
    for name in names:
        if name not in _HELD:
            _HELD.clear()
            _HELD[name] = pickle.loads(pq.read_table(SparkFiles.get(name), columns=["automaton"])["automaton"][0].as_py())
        yield _HELD[name]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of several automata in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _found(texts: list[str | None], names: list[str]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Number of words, hit spans (in order and apart) and items of each text."""
    n_words, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    for nth, automaton in enumerate(_automata(names)):
        for i, text in enumerate(texts):
            words = ALNUM_RE.findall((text or "").translate(TO_LOWER))
            found, of_items = automaton.hits(words)
            n_words[i] = len(words)
            spans[i] = _merged(spans[i] + found) if nth and found else spans[i] or found
            items[i] |= of_items
    if not names:
        n_words = [len(ALNUM_RE.findall((text or "").translate(TO_LOWER))) for text in texts]
    return list(zip(n_words, spans, items))


#: Documents whose results leave a Python worker together.
LOT = 1024


def _lots(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches in smaller lots; whole where each lot would have to read several automata again."""
    for batch in batches:
        step = LOT if len(names) < 2 else max(1, batch.num_rows)
        yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def _streamer(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in _lots(batches, names):
            found = _found(batch.column("text").to_pylist(), names)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in batch.schema.names), pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans, _ in found], span_type),
                    pa.array([sorted(items) for _, _, items in found], pa.list_(pa.string())),
                ],
                [*batch.schema.names, "n_words", "spans", "items"],
            )

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = (), window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of word positions, in order and apart), items (sorted strings) and the columns in carry
    for each row of docs.

    Null or empty text has no words and no hit; items with null ids or without words have no windows; repeated items
    count once for each id. Repeated rows of docs give a row each. Very long texts are streamed like others. An empty
    benchmark hits nothing. Other columns are not looked at.
    """
    base = docs.select("doc_id", "text", *(c for c in carry if c != "text"))
    given = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in base.columns)
    schema = f"{given}, n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    out = base.mapInArrow(_streamer(item_automata(benchmark, window, block_words)), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", *carry, "n_words", hit.alias("n_hit"), "spans", "items")


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans (of word positions, in order and apart) and what lies between a span's words."""
    bounds = [m.span() for m in ALNUM_RE.finditer(text.translate(TO_LOWER))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : bounds[start][0]])
        at = bounds[end - 1][1]
    return "".join([*kept, text[at:]])


def _cutter(names: list[str], max_span: int, max_coverage: float):
    """Documents -> those not covered beyond max_coverage, without their long spans: all in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches, names):
            given, texts, kept = batch.column("text").to_pylist(), [], []
            for i, (n_words, spans, _) in enumerate(_found(given, names)):
                if sum(b - a for a, b in spans) <= n_words * max_coverage:
                    long = [s for s in spans if s[1] - s[0] > max_span]
                    texts.append(_without(given[i], long) if long else given[i])
                    kept.append(i)
            left = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else left.column(c) for c in left.schema.names], left.schema.names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_span: int = 0, max_coverage: float = 0.8, carry: tuple[str, ...] = (), window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text without the spans of more than max_span hit words, and the columns in carry.

    Documents covered beyond max_coverage go. See benchmark_hits for nulls, ties and repeats.
    """
    rows = docs.select("doc_id", "text", *carry)
    return rows.mapInArrow(_cutter(item_automata(benchmark, window, block_words), max_span, max_coverage), rows.schema)


def hit_rows(hits: DataFrame) -> DataFrame:
    """The digest columns of a query over benchmark_hits."""
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
