"""Samples of a segment and the context around a comment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import token_estimate
from tidemark.settings import DEFAULT, Settings


def head_per_segment(members: DataFrame, n: int = DEFAULT.top_n) -> DataFrame:
    """The first ``n`` rows of each segment of the timeline."""
    w = W.partitionBy("bvid", "segment_id").orderBy("idx")
    return members.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def frequent_per_segment(members: DataFrame, n: int = DEFAULT.top_n) -> DataFrame:
    """The ``n`` most frequent texts of each segment, each with its first row; ties by first appearance."""
    t = members.groupBy("bvid", "segment_id", "content").agg(F.count("*").alias("freq"), F.min(F.struct("idx", "dm_id")).alias("f"))
    w = W.partitionBy("bvid", "segment_id").orderBy(F.desc("freq"), "f.idx")
    return t.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).select("bvid", "segment_id", "content", "freq", F.col("f.dm_id").alias("dm_id"), "pick")


def neighbours(members: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Per row, the rows of its segment up to so many seconds before (nearest last) and after (nearest first), by a range window."""
    ms = round(settings.context_seconds * 1000)
    w = W.partitionBy("bvid", "segment_id").orderBy(F.round(F.col("time_sec") * 1000).cast("long")).rangeBetween(-ms, ms)
    near = F.collect_list(F.struct("time_sec", "idx", "dm_id", "content")).over(w)
    m = members.select("bvid", "segment_id", "dm_id", "idx", "time_sec", "content", F.array_sort(near).alias("near"))
    return m.select("bvid", "segment_id", "dm_id", "content", F.filter("near", lambda x: x.time_sec < F.col("time_sec")).alias("before"), F.filter("near", lambda x: x.time_sec > F.col("time_sec")).alias("after"))


def context(members: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Neighbours within a token budget: six tenths of what the target leaves go before, the rest after; from the nearest on, up to the
    first that does not fit. Columns n_before, n_after, total_tokens, context_text."""
    c = neighbours(members, settings).withColumn("_t", token_estimate(F.col("content")))
    left = F.lit(settings.context_tokens) - F.col("_t")
    c = c.withColumn("_b", F.floor(left * 0.6)).withColumn("_a", left - F.col("_b"))

    def fit(col, budget):
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("go"))

        def step(acc, x):
            t = token_estimate(x.content)
            ok = acc.go & (acc.used + t <= budget)
            return F.struct(F.when(ok, acc.used + t).otherwise(acc.used).alias("used"), F.when(ok, acc.n + 1).otherwise(acc.n).alias("n"), ok.alias("go"))

        return F.aggregate(col, start, step)

    c = c.withColumn("_fb", fit(F.reverse("before"), F.col("_b"))).withColumn("_fa", fit(F.col("after"), F.col("_a")))
    fits = left > 0
    nb, na = F.when(fits, F.col("_fb.n")).otherwise(0), F.when(fits, F.col("_fa.n")).otherwise(0)
    total = F.col("_t") + F.when(fits, F.col("_fb.used") + F.col("_fa.used")).otherwise(0)
    text = F.concat_ws("\n", F.transform(F.when(nb > 0, F.slice("before", -nb, nb)).otherwise(F.slice("before", F.lit(1), F.lit(0))), lambda x: x.content), F.concat(F.lit("> "), F.col("content")),
                       F.transform(F.slice("after", F.lit(1), na), lambda x: x.content))
    return c.select("bvid", "segment_id", "dm_id", nb.alias("n_before"), na.alias("n_after"), total.alias("total_tokens"), text.alias("context_text"))
