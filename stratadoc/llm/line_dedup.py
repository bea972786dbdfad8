"""Line dedup by the spread of a line over sites.

A HyperLogLog sketch of sites is kept for each distinct line and merged by aggregation, so that a line's spread costs a
few bytes whatever its number of occurrences. Lines whose estimate lies near the threshold get an exact distinct count.
Lines on enough sites are boilerplate: all but the first occurrence are taken out of the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratadoc.llm.words import ascii_lower
from stratadoc.session import saved

MIN_SITES = 5
LOG_REGISTERS = 12


def line_key(line: Column) -> Column:
    """What lines are compared by: lower-cased A-Z, white space at the ends left out and elsewhere made one space."""
    return F.trim(F.regexp_replace(ascii_lower(line), r"[\x20\x09-\x0D]+", " "))


def _lines(docs: DataFrame) -> DataFrame:
    """text_key, doc_id, site, line_no and two 64-bit hashes of the key for each line that isn't blank."""
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("site"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"),
    ).withColumn("key", line_key(F.col("line"))).filter("key != ''")
    return lines.select(
        "doc_id", "text_key", "site", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """h1, h2, first (doc_id, text_key, line_no of the first occurrence) of the lines on min_sites sites or more."""
    keys = ["h1", "h2"]
    spread = lines.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_registers))).alias("sites"),
        F.min(F.struct("doc_id", "text_key", "line_no")).alias("first"),
    )
    # Four standard errors of the sketch to either side, and at least one site.
    margin = max(1, math.ceil(4 * 1.04 / math.sqrt(2**log_registers) * min_sites))
    wide = saved(spread.filter(F.col("sites") >= min_sites - margin), "line-spread")
    near = wide.filter(F.col("sites") < min_sites + margin)
    pairs = lines.select(*keys, "site").join(near.select(*keys), keys, "left_semi").distinct()
    exact = pairs.groupBy(*keys).agg(F.count("*").alias("exact")).filter(F.col("exact") >= min_sites)
    far = wide.filter(F.col("sites") >= min_sites + margin).select(*keys, "first")
    return far.unionByName(near.join(exact, keys).select(*keys, "first"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, log_registers: int = LOG_REGISTERS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (without the removed lines), n_lines, n_removed and the columns in carry for each row of docs.

    A site is a source; a null source is one site. The first occurrence of a line, by doc_id (null first) and line
    number, stays; so does every blank line. Null text stays null, with 0 lines; empty text is one blank line. A
    document all of whose lines go is kept with an empty text. Rows equal in doc_id and text count as one document,
    each returned. Only doc_id, text and source are looked at.
    """
    lines = saved(_lines(docs), "lines")
    found = boilerplate(lines, min_sites, log_registers)
    is_first = F.col("first").eqNullSafe(F.struct("doc_id", "text_key", "line_no"))
    gone = lines.join(found, ["h1", "h2"]).filter(~is_first)
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.select("doc_id", "text", F.struct("doc_id", *carry).alias("carried"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(rows["text"]) == gone["_key"]), "left")
    parts = F.split("text", "\n", -1)
    last = F.size(parts) - 1
    kept = F.array_except(F.sequence(F.lit(0), last), F.col("_gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    return rows.select(
        "doc_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long").alias("n_removed"), *(F.col("carried")[c].alias(c) for c in carry),
    )


def dedup_rows(found: DataFrame) -> DataFrame:
    """The digest columns of a query over line_dedup."""
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
