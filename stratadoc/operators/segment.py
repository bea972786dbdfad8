"""Segmenting runs of Han characters: the best path through the graph of words that a corpus knows.

The words are counted from the corpus itself: every character, and each string of up to LONGEST characters that comes
often enough and more often than its parts would by chance. A run's words are the path with the largest product of
relative frequencies; of equal ones that whose last word is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadoc.functions.text import tokenize
from stratadoc.session import saved

#: Characters of a word at most; how often it comes at least; how many times as often as its parts by chance.
LONGEST, LEAST, COHESION = 4, 3, 8.0
#: The logarithm of an unknown character's frequency.
UNKNOWN = -40.0
HAN_RUN = r"\p{IsHan}+"


def han_runs(texts: DataFrame) -> DataFrame:
    """run, n: the runs of Han characters of texts (text), and how often each comes."""
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(HAN_RUN), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def _strings(runs: DataFrame) -> DataFrame:
    """runs with at (from 0), word: each string of up to LONGEST characters."""
    at = runs.select("*", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("at"))
    sized = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - F.col("at")))).alias("size"))
    return sized.withColumn("word", F.substring("run", F.col("at") + 1, F.col("size"))).drop("size")


def lexicon(texts: DataFrame, least: int = LEAST, cohesion: float = COHESION) -> DataFrame:
    """word, score (the logarithm of its share of all characters) of the words that texts (text) have."""
    counts = saved(_strings(han_runs(texts)).groupBy("word").agg(F.sum("n").alias("n")), "han-strings")
    total = counts.filter("length(word) = 1").agg(F.sum("n").alias("total"))
    long = counts.filter((F.length("word") > 1) & (F.col("n") >= least)).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("cut"))
    parts = long.select("word", "n", F.expr("left(word, cut)").alias("a"), F.expr("substring(word, cut + 1)").alias("b"))
    own = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    held = parts.join(own("a"), "a").join(own("b"), "b").crossJoin(F.broadcast(total))
    by_chance = F.max(F.col("n_a").cast("double") * F.col("n_b") / F.col("total"))
    kept = held.groupBy("word").agg(F.first("n").alias("n"), by_chance.alias("chance")).filter(F.col("n") >= F.col("chance") * cohesion).select("word", "n")
    words = kept.unionByName(counts.filter("length(word) = 1"))
    return saved(words.crossJoin(F.broadcast(total)).select("word", F.log(F.col("n") / F.col("total")).alias("score")), "lexicon")


def best_path(run: str, words: dict[tuple[int, int], float]) -> list[str]:
    """words: (end, size) -> score, for the words that stand in the run."""
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        choices = [(best[end - size] + score, size) for size in range(1, min(LONGEST, end) + 1) if (score := words.get((end, size), UNKNOWN if size == 1 else None)) is not None]
        score, size = max(choices)
        best.append(score)
        back.append(size)
    found, end = [], len(run)
    while end:
        found.append(run[end - back[end] : end])
        end -= back[end]
    return found[::-1]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("run").to_pylist()
        paths = [best_path(r, {(w["end"], w["size"]): w["score"] for w in ws}) for r, ws in zip(runs, batch.column("words").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(paths, pa.list_(pa.string()))], ["run", "path"])


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """run, path (its words in order) of each distinct run, by a lexicon (word, score)."""
    own = runs.select("run").distinct()
    held = _strings(own).join(words, "word", "left")
    edge = F.when(F.col("score").isNotNull(), F.struct((F.col("at") + F.length("word")).alias("end"), F.length("word").alias("size"), "score"))
    return held.groupBy("run").agg(F.collect_list(edge).alias("words")).mapInArrow(_paths, "run string, path array<string>")


def terms(rows: DataFrame, keep: list[str], text: str, words: DataFrame | None) -> DataFrame:
    """keep..., term: the index terms of each row's text, repeats included; runs of Han characters by the lexicon, as
    overlapping pairs where there is none."""
    if words is None:
        return rows.select(*keep, F.explode(tokenize(F.col(text))).alias("term"))
    whole: Column = tokenize(F.col(text), segment=lambda t: F.array(t))
    each = rows.select(*keep, F.explode(whole).alias("term"))
    is_run = F.col("term").rlike(f"^{HAN_RUN}$")
    paths = saved(segmented(each.filter(is_run).select(F.col("term").alias("run")), words), "han-paths")
    cut = each.filter(is_run).withColumnRenamed("term", "run").join(paths, "run").select(*keep, F.explode("path").alias("term"))
    return each.filter(~is_run).unionByName(cut)


def lexicon_of(texts: DataFrame) -> DataFrame | None:
    """The lexicon of texts (text); None where none of them holds a Han character."""
    held = texts.filter(F.col("text").rlike(r"\p{IsHan}"))
    return None if held.isEmpty() else lexicon(held)
