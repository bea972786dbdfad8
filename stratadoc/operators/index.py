"""Lexical index: postings and the statistics that scores need, each a plain table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratadoc.functions.text import let, tokenize
from stratadoc.operators.segment import lexicon_of, terms
from stratadoc.session import passing, saved, shuffles_end

#: The ranking function's parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class LexicalIndex:
    postings: DataFrame  # term, i, tf; those of a stored index also have dl and span
    lengths: DataFrame  # i, dl: blocks without terms included
    idf: DataFrame  # term, df, idf
    stats: DataFrame  # one row: n, avgdl
    lexicon: DataFrame | None = None  # word, score: the words of Han text, where the blocks have any


def counted_terms(blocks: DataFrame, words: DataFrame | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep..., term, i, tf, dl of blocks (keep..., i, content): how often each term is in a block, and how many it has.

    A block's terms are counted within its row. Only where Han text is cut by a lexicon (words) they move.
    """
    own = [*keep, "i"]
    if words is not None:
        found = terms(blocks, own, "content", words).groupBy("term", *own).agg(F.count("*").alias("tf"))
        return found.join(found.groupBy(*own).agg(F.sum("tf").alias("dl")), own).select(*keep, "term", "i", "tf", "dl")

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k) != F.get(s, k - 1)))
        return let(begins, lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - at).cast("long").alias("tf"), F.size(s).cast("long").alias("dl"))))

    counts = let(F.sort_array(tokenize(F.col("content"))), lambda s: F.when(F.size(s) > 0, runs(s)))
    return blocks.select(*own, F.explode(counts).alias("c")).select(*keep, "c.term", "i", "c.tf", "c.dl")


def lexical_index(blocks: DataFrame) -> LexicalIndex:
    """From blocks (i, content). Terms in more than half of the blocks get a share of the mean idf in place of a negative one.

    Postings are written once, to the shared folder; all else comes from them. Han text is cut by a lexicon that is
    counted from the blocks.
    """
    words = lexicon_of(blocks.select(F.col("content").alias("text")))
    return statistics(blocks.select("i"), saved(counted_terms(blocks, words), "postings"), words)


def statistics(blocks: DataFrame, postings: DataFrame, words: DataFrame | None = None) -> LexicalIndex:
    """The index of blocks (i) whose postings are written down."""
    lengths = saved(
        blocks.join(postings.groupBy("i").agg(F.sum("tf").alias("dl")), "i", "left").select("i", F.coalesce("dl", F.lit(0)).alias("dl")), "lengths"
    )
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = saved(postings.groupBy("term").agg(F.count("*").alias("df")), "document-frequencies")
    raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(postings, lengths, idf, stats, lexicon=words)


def keyed_index(blocks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Over blocks (key, i, content), an index for each key, all made in one go: key, term, i, tf, dl, and key, term, idf.

    They are those that lexical_index has over a key's blocks alone, but dl is a share of the key's mean; Han text is cut
    into overlapping pairs.
    """
    found = saved(counted_terms(blocks, None, (key,)), "keyed-postings")
    # Blocks without terms count for the mean length.
    sizes = found.groupBy(key).agg(F.sum("tf").alias("terms"))
    stats = saved(blocks.groupBy(key).agg(F.count("*").alias("n")).join(sizes, key).select(key, "n", (F.col("terms") / F.col("n")).alias("avgdl")), "keyed-stats")
    raw = found.groupBy(key, "term").agg(F.count("*").alias("df")).join(F.broadcast(stats), key)
    raw = saved(raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "keyed-frequencies")
    floor = raw.groupBy(key).agg((F.avg("raw") * EPSILON).alias("floor"))
    idf = raw.join(F.broadcast(floor), key).select(key, "term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return found.join(F.broadcast(stats), key).select(key, "term", "i", "tf", (F.col("dl") / F.col("avgdl")).alias("dl")), idf


#: Blocks of a span, by their numbers.
SPAN_BITS = 10
#: The tables of a stored index.
TABLES = ("postings", "lengths", "idf", "stats", "lexicon")


def saturation() -> Column:
    """What a block's own counts (tf, dl, with avgdl) make of a term's idf."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def term_weights(index: LexicalIndex) -> DataFrame:
    """term, span, i, weight: what one occurrence of a term in a query adds to a block's score."""
    rows = index.postings if "dl" in index.postings.columns else index.postings.join(index.lengths, "i")
    rows = rows.join(index.idf.select("term", "idf"), "term").crossJoin(F.broadcast(index.stats))
    return rows.select("term", F.shiftright("i", SPAN_BITS).alias("span"), "i", (F.col("idf") * saturation()).alias("weight"))


def _write_postings(postings: DataFrame, path: str) -> DataFrame:
    """Writes term, span, i, tf, dl: each file as it comes, of blocks that lie together, in order of terms and spans, so
    that a term's rows of a span lie together and no posting moves."""
    rows = postings.withColumn("span", F.shiftright("i", SPAN_BITS)).select("term", "span", "i", "tf", "dl")
    rows.sortWithinPartitions("term", "span", "i").write.mode("overwrite").parquet(f"{path}/postings")
    return postings.sparkSession.read.parquet(f"{path}/postings")


def _write_rest(index: LexicalIndex, postings: DataFrame, path: str) -> None:
    none = postings.sparkSession.createDataFrame([], "word string, score double")
    (index.lexicon if index.lexicon is not None else none).write.mode("overwrite").parquet(f"{path}/lexicon")
    for name in ("lengths", "idf", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def store_lexical(index: LexicalIndex, path: str) -> None:
    """Writes the index."""
    postings = index.postings if "dl" in index.postings.columns else index.postings.join(index.lengths, "i")
    with shuffles_end(postings.sparkSession):
        _write_rest(index, _write_postings(postings, path), path)


def build_lexical(blocks: DataFrame, path: str) -> None:
    """Writes the index of blocks (i, content), as lexical_index and store_lexical do, but the postings once."""
    words = lexicon_of(blocks.select(F.col("content").alias("text")))
    with passing(blocks.sparkSession):
        postings = _write_postings(counted_terms(blocks, words), path)
        _write_rest(statistics(blocks.select("i"), postings, words), postings, path)


def load_lexical(spark: SparkSession, path: str) -> LexicalIndex | None:
    """The index stored at path; None where there is none."""
    try:
        tables = [spark.read.parquet(f"{path}/{name}") for name in TABLES]
        return LexicalIndex(*tables[:-1], lexicon=None if tables[-1].isEmpty() else tables[-1])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
