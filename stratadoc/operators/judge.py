"""Answer scoring: how much of the anchors an answer covers, what of it is copied, and which arm wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratadoc.functions.text import char_ngrams, identifiers, is_refusal, norm
from stratadoc.operators.grams import near_occurrences
from stratadoc.session import saved
from stratadoc.sources.corpus import PART, in_ranges

METRICS = ("strict", "strict_norm", "strict_fuzzy", "ident", "gram")
#: The verdict's margin, and the bounds between which two metrics contradict each other.
MARGIN, HIGH, LOW = 0.10, 0.5, 0.2


def gram_counts(grams: Column, text: Column) -> tuple[Column, Column]:
    """How many of an anchor's grams a normalised answer holds, and how many there are."""
    return F.size(F.filter(grams, lambda g: F.contains(text, g))), F.size(grams)


def judge_groups(answers: DataFrame, anchors: DataFrame, fuzzy: str = "compat") -> DataFrame:
    """answer_id, case_id, group_no, mode and the five metrics, for answers (answer_id, case_id, answer) and their case's anchors.

    The strict metrics are shares of anchors; ident and gram are shares of all identifiers and grams of the group. ident
    is null for a group without identifiers.
    """
    # Normalised before the join: once for each answer and each anchor.
    answers = answers.withColumn("na", norm(F.col("answer")))
    anchors = anchors.withColumn("nn", norm(F.col("anchor"))).withColumn("ids", identifiers(F.col("anchor"))).withColumn("grams", char_ngrams(F.col("anchor")))
    texts, needles = answers.select("case_id", "answer_id", F.col("na").alias("text")), anchors.select("case_id", F.col("nn").alias("needle"))
    near = near_occurrences(needles, texts, "answer_id", ("case_id",), fuzzy)
    near = saved(near.select("case_id", F.col("needle").alias("nn"), "answer_id", F.lit(True).alias("near")), "near-anchors")
    rows = answers.join(anchors, "case_id").join(near, ["case_id", "nn", "answer_id"], "left")
    exact = F.contains("na", "nn")
    hit, size = gram_counts(F.col("grams"), F.col("na"))
    rows = rows.select(
        "answer_id", "case_id", "group_no", "mode", F.contains("answer", "anchor").cast("int").alias("st"), exact.cast("int").alias("sn"),
        F.coalesce(F.col("near"), exact).cast("int").alias("sf"), F.size("ids").alias("i_all"),
        F.size(F.filter("ids", lambda t: F.contains("answer", t) | F.contains("na", t))).alias("i_hit"), hit.alias("g_hit"), size.alias("g_all"),
    )
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    return rows.groupBy("answer_id", "case_id", "group_no", "mode").agg(
        F.avg("st").alias("strict"), F.avg("sn").alias("strict_norm"), F.avg("sf").alias("strict_fuzzy"),
        share("i_hit", "i_all").alias("ident"), F.coalesce(share("g_hit", "g_all"), F.lit(0.0)).alias("gram"),
    )


def judge_cases(groups: DataFrame) -> DataFrame:
    """A case's metrics: each the best of its groups (any) or the worst (all); null where a group's is."""
    pick = lambda m: F.when(F.count(m) == F.count("*"), F.when(F.col("mode") == "any", F.max(m)).otherwise(F.min(m))).alias(m)
    return groups.groupBy("answer_id", "case_id", "mode").agg(*map(pick, METRICS)).drop("mode")


def copy_ratios(answers: DataFrame, corpus_grams: DataFrame) -> DataFrame:
    """answer_id, copy: the share of an answer's grams, repeats included, that the corpus (gram) holds; 0 without grams."""
    grams = answers.select("answer_id", F.explode_outer(char_ngrams(F.col("answer"))).alias("gram"))
    counted = grams.groupBy("answer_id", "gram").agg(F.count("gram").alias("n"))
    found = counted.join(corpus_grams.withColumn("known", F.lit(1)), "gram", "left")
    held = F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0))
    return found.groupBy("answer_id").agg(F.when(F.sum("n") > 0, held / F.sum("n")).otherwise(F.lit(0.0)).alias("copy"))


def corpus_grams(texts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The distinct grams of all texts (text) of at least three characters.

    by: columns that order the texts; the grams that cross from one text into the next ones are then the corpus's too,
    as if it were one text. What crosses into a text is settled by the last two characters before it, and those by the
    ends of the two texts before, as no text here is empty; ranges of texts pass theirs on.
    """
    kept = texts.withColumn("_n", norm(F.col("text"))).filter("_n <> ''")
    inside = kept.filter(F.length("_n") >= 3).select(F.explode(F.array_distinct(char_ngrams(F.col("text")))).alias("gram"))
    if by is None:
        return inside.distinct()
    last_two = lambda *parts: F.right(F.concat(*parts), F.lit(2))
    ends = in_ranges(kept.select(*by, F.substring("_n", 1, 2).alias("head"), last_two(F.col("_n")).alias("tail")), by).withColumn("part", F.expr(PART))
    order = Window.partitionBy("part").orderBy("_place")
    before = lambda n, w: F.coalesce(F.lag("tail", n).over(w), F.lit(""))
    ends = ends.withColumn("own", last_two(before(2, order), before(1, order)))
    parts = ends.withColumn("whole", last_two(F.col("own"), F.col("tail"))).groupBy("part").agg(F.max_by("whole", "_place").alias("tail"))
    ranges = Window.partitionBy(F.lit(0)).orderBy("part")  # one row for each range
    incoming = parts.select("part", last_two(before(2, ranges), before(1, ranges)).alias("incoming"))
    joins = ends.join(F.broadcast(incoming), "part").select(F.concat(last_two(F.col("incoming"), F.col("own")), "head").alias("s")).filter(F.length("s") >= 3)
    crossing = joins.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda p: F.substring(F.col("s"), p, F.lit(3)))).alias("gram"))
    return inside.unionByName(crossing).distinct()


def across(cases: DataFrame) -> DataFrame:
    """case_id, other_id: the case half the list away (by case_id, around the end)."""
    numbered = cases.select("case_id").distinct()
    everyone = Window.partitionBy(F.lit(0))
    numbered = numbered.withColumn("at", F.row_number().over(everyone.orderBy("case_id")) - 1).withColumn("n", F.count("*").over(everyone))
    there = F.pmod(F.col("at") + F.floor(F.col("n") / 2), F.col("n"))
    return numbered.withColumn("there", there).alias("a").join(numbered.alias("b"), F.col("a.there") == F.col("b.at")).select(F.col("a.case_id").alias("case_id"), F.col("b.case_id").alias("other_id"))


def gram_floor(answers: DataFrame, anchors: DataFrame, others: DataFrame) -> DataFrame:
    """answer_id, gram_null: the mean gram share of the other case's groups: what an unrelated answer reaches."""
    # Normalised and cut before the join: once for each answer and each anchor.
    moved = answers.select("case_id", "answer_id", norm(F.col("answer")).alias("na")).join(others, "case_id").select("answer_id", F.col("other_id").alias("case_id"), "na")
    anchors = anchors.select("case_id", "group_no", char_ngrams(F.col("anchor")).alias("grams"))
    hit, size = gram_counts(F.col("grams"), F.col("na"))
    rows = moved.join(anchors, "case_id").select("answer_id", "group_no", hit.alias("hit"), size.alias("size"))
    groups = rows.groupBy("answer_id", "group_no").agg(F.when(F.sum("size") > 0, F.sum("hit") / F.sum("size")).otherwise(F.lit(0.0)).alias("gram"))
    return groups.groupBy("answer_id").agg(F.avg("gram").alias("gram_null"))


def deltas(scores: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """The gram score above its floor; answers without either are dropped.

    floors (answer_id, gram_null) is what was worked out anew; without it the floor stored with the scores (gram_null) is
    taken. raw_deltas() takes none.
    """
    rows = scores if floors is None else scores.drop("gram_null").join(floors, "answer_id")
    return rows.withColumn("delta", F.col("gram") - F.col("gram_null")).filter(F.col("delta").isNotNull())


def raw_deltas(scores: DataFrame) -> DataFrame:
    """The gram score itself as delta; answers without one are dropped."""
    return scores.withColumn("delta", F.col("gram")).filter(F.col("delta").isNotNull())


def verdicts(rows: DataFrame, baseline: str = "long", margin: float = MARGIN) -> DataFrame:
    """Wins, losses and ties of each arm against the baseline on the same case, by bank and type, with totals.

    rows: case_id, bank, type, arm, delta. A total's bank and type are "total".
    """
    base = rows.filter(F.col("arm") == baseline).select("case_id", F.col("delta").alias("base"))
    diff = F.round(F.col("delta") - F.col("base"), 9)
    pairs = rows.filter(F.col("arm") != baseline).join(base, "case_id").withColumn("diff", diff)
    total = lambda c: F.when(F.grouping(c) == 1, "total").otherwise(F.col(c))
    counts = pairs.groupingSets([["arm", "bank", "type"], ["arm"]], "arm", "bank", "type").agg(
        total("bank").alias("b"), total("type").alias("t"), F.count_if(F.col("diff") > margin).alias("wins"),
        F.count_if(F.col("diff") < -margin).alias("losses"), F.count_if(F.abs("diff") <= margin).alias("ties"),
    )
    return counts.select("arm", F.col("b").alias("bank"), F.col("t").alias("type"), "wins", "losses", "ties")


def mean_deltas(rows: DataFrame) -> DataFrame:
    """arm, its mean delta over cases (case_id, arm, delta), and their number. A figure for reference, not a verdict."""
    return rows.groupBy("arm").agg(F.avg("delta").alias("mean_delta"), F.count("delta").alias("n"))


def conflicts(cases: DataFrame) -> DataFrame:
    """Cases that the loosest and the strictest of strict_fuzzy, gram disagree on."""
    return cases.filter((F.greatest("strict_fuzzy", "gram") >= HIGH) & (F.least("strict_fuzzy", "gram") <= LOW))


def score_summary(rows: DataFrame) -> DataFrame:
    """Means of the metrics, answer length and copy share, and counts, by bank, type and arm."""
    means = [F.avg(m).alias(m) for m in (*METRICS, "copy")]
    return rows.groupBy("bank", "type", "arm").agg(
        *means, F.avg(F.length("answer")).alias("chars"), F.count_if(is_refusal(F.col("answer"))).alias("refusals"), F.count("ident").alias("n_ident"), F.count("*").alias("n")
    )
