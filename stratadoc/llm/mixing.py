"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled and laid end to end; the line of words is cut into blocks of equal length. Slot i
of the schedule takes the point frac(i * golden ratio) of [0, 1), in which each source holds an interval in proportion
to the blocks it owes. The k-th slot of a source takes its k-th block, starting over after the last. Neighbouring
slots are thus spread over the sources as evenly as one can spread them, and nothing is drawn at random.

Running sums and ranks go in two levels (within a bucket, and over buckets), so that no source is ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratadoc.llm.words import word_count
from stratadoc.session import saved

WEIGHTS = (5, 2, 1)
SHARE, STOP = 1.5, 2.0
BLOCK_WORDS = 256
GOLDEN = (math.sqrt(5) - 1) / 2
#: A slot's number is split at this power of two so that its point keeps full precision.
SPLIT = 1 << 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, stop: float = STOP) -> DataFrame:
    """source, source_size -> also source_no, weight and target; a row for each source.

    Sources in code-point order (null last) weigh as weights repeats. Targets are level * weight, but stop at
    stop * source_size; the level is the one at which targets make share * all sizes. With all at their stop (share
    not below stop, or nothing but empty sources) every target is its stop.
    """
    every, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(by_name) - 1
    named = sizes.withColumn("source_no", number).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    )
    named = named.withColumn("most", F.col("source_size") * F.lit(float(stop)))
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "source_no")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    levelled = named.withColumn("place", F.row_number().over(ranked)).withColumn(
        "level",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), zero))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)),
    )
    # The first source, by the level that fills it, that its level doesn't fill: all before it are at their stop.
    open_ = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("place", "level"))
    level = F.min(open_).over(every)["level"]
    target = F.when(level.isNull(), F.col("most")).otherwise(F.least(F.col("most"), level * F.col("weight")))
    return levelled.withColumn("target", target).select("source", "source_no", "weight", "source_size", "target")


def _two_level(df: DataFrame, group: str, bucket: str, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Adds out: the sum of amount over the rows of the group that stand before this one by (bucket, order)."""
    totals = df.groupBy(group, bucket).agg(F.sum(amount).alias("_total"))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(offsets, [group, bucket])
        .withColumn(out, (F.col("_ahead") + F.col("_inside")).cast("long"))
        .drop("_inside", "_ahead")
    )


def _sized(docs: DataFrame, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document, with a number of its own, the place that the shuffle gives it and the columns in carry."""
    given = [F.struct(*carry).alias("carried")] if carry else []
    return saved(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", F.xxhash64("text").alias("text_key"), "source", word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("shuffled"), *given,
        ),
        "mix-sizes",
    )


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized with source_no and start: the words of its source that lie before it."""
    # As many buckets of a source as documents in a bucket, more or less.
    bits = max(1, math.ceil(math.log2(4 * math.sqrt(max(1, sized.count())))))
    numbered = sized.drop("carried").join(sources.alias("s"), sized["source"].eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    numbered = numbered.withColumn("bucket", F.shiftrightunsigned("shuffled", 64 - bits))
    return _two_level(numbered, "source_no", "bucket", [F.col("shuffled"), F.col("doc_id"), F.col("text_key"), F.col("row_id")], F.col("size"), "start").drop("bucket")


def _slots(spark, quotas: DataFrame) -> DataFrame:
    """slot, source_no, rank: the schedule, in which every source has its quota of slots.

    An interval's count of golden-ratio points is off its share by a few; what a source has too much is left out, what
    it lacks comes last.
    """
    n, n_sources = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    cells = max(1024, 4 * n_sources)
    upto = Window.partitionBy(F.lit(0)).orderBy("source_no")
    held = quotas.filter("quota > 0").withColumn("hi", F.sum("quota").over(upto) / F.lit(float(max(n, 1)))).withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
    held = held.select(
        "source_no", "quota", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells)))).alias("cell"),
    )
    high, low = F.floor(F.col("id") / SPLIT), F.col("id") % SPLIT
    point = F.pmod(high * F.lit((SPLIT * GOLDEN) % 1.0) + low * F.lit(GOLDEN), F.lit(1.0))
    points = spark.range(n).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * cells))
    chunk = max(1024, 4 * math.isqrt(n))
    dealt = points.join(held, (points["cell"] == held["cell"]) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    dealt = dealt.select(F.col("id").alias("slot"), "source_no", "quota", F.floor(F.col("id") / chunk).alias("chunk"))
    ranked = _two_level(dealt, "source_no", "chunk", [F.col("slot")], F.lit(1), "rank")
    got = quotas.join(dealt.groupBy("source_no").agg(F.count("*").alias("got")), "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    lacking = got.filter(F.col("got") < F.col("quota")).select("source_no", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank"))
    lacking = lacking.select((F.col("rank") + F.lit(n)).alias("slot"), "source_no", "rank")
    return ranked.filter(F.col("rank") < F.col("quota")).select("slot", "source_no", "rank").unionByName(lacking)


def _mix(sized: DataFrame, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = sized.sparkSession
    sources = saved(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    placed = saved(_placed(sized, sources), "mix-placed")
    n_blocks = F.ceil(F.col("source_size") / block_words)
    due = F.floor("target")
    quotas = sources.withColumn("n_blocks", n_blocks).withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size"))).otherwise(F.lit(0))
    )
    quotas = quotas.withColumn("rest", due - F.col("rounds") * F.col("source_size")).withColumn(
        "quota", F.col("rounds") * F.col("n_blocks") + F.ceil(F.col("rest") / block_words)
    )
    terms = quotas.select(F.col("source_no"), "n_blocks", "rounds", "rest", "source_size")
    uses = (
        _slots(spark, quotas.select("source_no", "quota")).join(terms, "source_no")
        .withColumn("block", F.col("rank") % F.col("n_blocks")).withColumn("round", F.floor(F.col("rank") / F.col("n_blocks")))
        .withColumn("upto", F.when(F.col("round") >= F.col("rounds"), F.col("rest")).otherwise(F.col("source_size")))
        .select("slot", "source_no", "block", "round", "upto")
    )
    last = F.col("start") + F.col("size")
    pieces = placed.filter("size > 0").select(
        "doc_id", "source_no", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((last - 1) / block_words))).alias("block"),
    )
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(last, (F.col("block") + 1) * block_words)
    pieces = pieces.select("doc_id", "source_no", "start", "block", lo.alias("lo"), hi.alias("hi"))
    n_words = F.least("hi", "upto") - F.col("lo")
    spans = uses.join(pieces, ["source_no", "block"]).filter(n_words > 0).select(
        "slot", "source_no", "round", "doc_id", "start", (F.col("lo") - F.col("start")).alias("from_word"), n_words.alias("n_words")
    )
    return placed, sources, spans


def mixed_spans(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mix itself: slot, source, round, doc_id, from_word, n_words. Read in order of slot, from_word of a slot's documents."""
    _, sources, spans = _mix(_sized(docs, seed), block_words)
    return spans.join(sources.select("source_no", "source"), "source_no").select("slot", "source", "round", "doc_id", "from_word", "n_words")


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot, n_slots, spans for each row of docs; also, ahead of
    them, the columns of docs that carry names.

    spans are the words that the mix takes of the row: slot, from_word, n_words, by slot and place; at most twice the row's
    blocks of them. Null and empty texts have size 0 and nothing taken (no spans, null first_slot); a null source is a
    source of its own, last in order. Repeated rows are laid side by side and share their source's words as others do.
    Equal shuffle places are told apart by doc_id and text. An empty table gives an empty result. Only doc_id, text,
    source and what carry names are looked at.
    """
    sized = _sized(docs, seed, carry)
    placed, _, spans = _mix(sized, block_words)
    # Among documents with words, source and start name one.
    own = F.array_sort(F.collect_list(F.struct("slot", "from_word", "n_words")))
    taken = spans.groupBy(F.col("source_no").alias("s"), F.col("start").alias("at")).agg(F.sum("n_words").alias("taken"), own.alias("spans"))
    at = F.when(F.col("size") > 0, F.col("start"))
    joined = placed.join(taken, (placed["source_no"] == taken["s"]) & (at == taken["at"]), "left")
    none = F.expr("cast(array() as array<struct<slot: bigint, from_word: bigint, n_words: bigint>>)")
    joined = joined.select(
        "row_id", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.get("spans", F.lit(0))["slot"].alias("first_slot"),
        F.coalesce(F.size(F.array_distinct(F.transform("spans", lambda x: x["slot"]))), F.lit(0)).cast("long").alias("n_slots"), F.coalesce("spans", none).alias("spans"),
    )
    if not carry:
        return joined.drop("row_id")
    rest = [c for c in joined.columns if c not in ("row_id", *carry)]
    return sized.select("row_id", "carried").join(joined, "row_id").select("carried.*", *rest)
