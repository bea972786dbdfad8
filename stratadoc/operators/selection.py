"""Exact middle values of groups of any size, by counts over ranges that close in on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratadoc.session import saved

#: Ranges that a group's values are counted by; values that are put in order at once.
RANGES, ORDERED = 256, 4096


def medians(rows: DataFrame, by: list[str], value: str, ordered: int = ORDERED) -> DataFrame:
    """by..., n, lower, upper: how many values a group has and the two in the middle, the same where n is odd.

    Null and NaN values don't count; groups without others have no row, null keys are keys. While a group has more than
    `ordered` values that the middle can be among, they are counted by ranges, and the range that holds it is looked at
    again: no task gets a group's values as a whole.
    """
    v = F.col(value).cast("double")
    names = [f"_k{i}" for i in range(len(by))]
    own = saved(rows.select(*(F.col(c).alias(k) for c, k in zip(by, names)), v.alias("_v")).filter("_v is not null and not isnan(_v)"), "values")
    ends = [F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")]
    sizes = saved(own.groupBy(*names).agg(*ends), "group-sizes")
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(F.col("n") / 2).alias("rank"))))
    state = sizes.select("*", ranks.alias("_r")).select(*names, "_r.which", "_r.rank", "low", "high", F.col("n").alias("held"))
    key = [*names, "which"]

    def matched(some: DataFrame) -> DataFrame:
        right = some.select(*(F.col(k).alias(f"{k}_") for k in names), "which", "rank", "low", "high", "held")
        same = F.lit(True)
        for k in names:
            same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
        return own.join(right, same).filter((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))).drop(*(f"{k}_" for k in names))

    done = None
    while True:
        state = saved(state, "middles")
        large = state.filter((F.col("held") > ordered) & (F.col("low") < F.col("high")))
        small = state.filter((F.col("held") <= ordered) | (F.col("low") == F.col("high")))
        same = small.filter("low = high").select(*key, F.col("low").alias("_v"))
        order = Window.partitionBy(*key).orderBy("_v")
        few = matched(small.filter("low < high")).withColumn("_at", F.row_number().over(order) - 1).filter("_at = rank").select(*key, "_v")
        found = same.unionByName(few)
        done = found if done is None else done.unionByName(found)
        if large.isEmpty():
            break
        part = F.least(F.floor((F.col("_v") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1)).alias("_part")
        counts = matched(large).groupBy(*key, "rank", part).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        ahead = F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = counts.withColumn("_ahead", ahead).filter((F.col("_ahead") <= F.col("rank")) & (F.col("rank") < F.col("_ahead") + F.col("c")))
        state = at.select(*key, (F.col("rank") - F.col("_ahead")).alias("rank"), "low", "high", F.col("c").alias("held"))
    middle = done.groupBy(*names).agg(F.max(F.when(F.col("which") == 0, F.col("_v"))).alias("lower"), F.max(F.when(F.col("which") == 1, F.col("_v"))).alias("upper"))
    middle = middle.withColumnsRenamed({k: f"{k}_" for k in names})
    same = F.lit(True)
    for k in names:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return sizes.join(middle, same).select(*(F.col(k).alias(c) for c, k in zip(by, names)), "n", "lower", "upper")
