"""Label records and segment metrics aggregated by category and zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.pvalues import z_of
from tidemark.settings import DEFAULT, Settings

GROUP = ("bvid", "tname", "zone_type")


def weighted_hard(segment_metrics: DataFrame, values: Sequence[str], weight: str = "total_comments", keys: Sequence[str] = GROUP) -> DataFrame:
    """Means of segment measures weighted by comments; 0 without weight. Give it only segments that have label records."""
    w = F.sum(F.col(weight).cast("double"))
    return segment_metrics.groupBy(*keys).agg(F.count("*").alias("segments"), F.sum(weight).alias("danmaku_count"),
        *[F.round(F.when(w > 0, F.sum(F.col(v) * F.col(weight)) / w).otherwise(F.lit(0.0)), 6).alias(v) for v in values])


def weighted_map(long: DataFrame, totals: DataFrame, weight: str, keys: Sequence[str] = GROUP) -> DataFrame:
    """Ratios (keys, key, ratio, weight) merged with weights; a key missing somewhere counts as 0 there, so all weights of the group divide.
    ``totals``: (keys, total weight)."""
    s = long.groupBy(*keys, "key").agg(F.sum(F.col("ratio") * F.col(weight)).alias("x"))
    return s.join(totals, list(keys)).select(*keys, "key", F.round(F.col("x") / F.col("total"), 6).alias("ratio"))


def weighted_soft(records: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Label shares (keys, dim, label, ratio), each record counting by its weight_multiplier."""
    fields = (("emotion", "output.emotion.label"), ("interaction_type", "output.interaction_type.label"), ("sentence_function", "output.sentence_function.label"), ("orthography", "output.orthography.status"))
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f).alias("label")) for d, f in fields])
    r = records.select(*keys, "weight_multiplier", F.inline(dims)).where(F.col("label").isNotNull())
    s = r.groupBy(*keys, "dim", "label").agg(F.sum("weight_multiplier").alias("x"))
    t = s.groupBy(*keys, "dim").agg(F.sum("x").alias("t"))
    return s.join(t, [*keys, "dim"]).select(*keys, "dim", "label", F.round(F.col("x") / F.col("t"), 6).alias("ratio"))


def consensus_rates(records: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Records, unweighted shares of consensus levels, mean weight, and the weighted rate of violations."""
    level = lambda x: F.round(F.avg((F.col("consensus_level") == x).cast("double")), 6).alias(f"{x}_consensus_rate")
    w = F.sum("weight_multiplier")
    v = F.sum(F.when(F.col("output.cooperative_principle.violated"), F.col("weight_multiplier")).otherwise(0.0))
    return records.groupBy(*keys).agg(F.count("*").alias("n_records"), level("high"), level("medium"), level("low"),
        F.round(F.avg("weight_multiplier"), 6).alias("avg_weight_multiplier"), F.round(F.when(w > 0, v / w).otherwise(0.0), 6).alias("violation_rate"))


def wilson(rate: Column, n: Column, level: float = DEFAULT.confidence_level) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, from successes cut to a whole number; within [0, 1], zeros for n = 0."""
    z = z_of(level)
    m = n.cast("double")
    p = F.floor(rate * m) / m
    mid, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    den = 1 + z * z / m
    edge = lambda x: F.when(n > 0, F.round(F.least(F.greatest(x / den, F.lit(0.0)), F.lit(1.0)), 4)).otherwise(F.lit(0.0))
    return edge(mid - half), edge(mid + half)


def with_interval(rates: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ci_lower, ci_upper and ci_status ('insufficient_sample' for fewer records than a segment needs; then no bounds)."""
    lo, hi = wilson(F.col("high_consensus_rate"), F.col("n_records"), settings.confidence_level)
    enough = F.col("n_records") >= settings.min_segment_samples
    return rates.withColumn("ci_lower", F.when(enough, lo)).withColumn("ci_upper", F.when(enough, hi)).withColumn("ci_status", F.when(enough, "ok").otherwise("insufficient_sample"))
