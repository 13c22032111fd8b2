"""Rank statistics as distributed plans; only one row per test is finished in Python."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.pvalues import chi2_sf, mann_whitney_p, wilcoxon_p


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot([*ids], [*values], "metric", "value")


def descriptives(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, sample deviation (0 for one value), extremes, count and exact linear quartiles; nulls left out."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.round(F.avg(v), 9).alias("mean"), F.round(F.median(v), 9).alias("median"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 9).alias("std"),
        F.round(F.min(v), 9).alias("min"), F.round(F.max(v), 9).alias("max"), F.count("*").alias("count"), F.round(q[0], 9).alias("q25"), F.round(q[1], 9).alias("q75"))


def _span(v: Column) -> Column:
    """A number that rises with the value: 4,096 spans per power of two, so that values of any scale are spread over many."""
    at = F.floor(F.log2(F.abs(v)) * 4096) + 5_000_000
    return F.when(v > 0, at).when(v < 0, -at).otherwise(F.lit(0)).cast("long")


def _ranked(cells: DataFrame, within: Sequence[str]) -> DataFrame:
    """Average ranks from counts per distinct value: cells (within, group, value, c). Ties are one cell. Values are ranked within their span and
    shifted by the counts of the spans before, so no window sees all values of a group."""
    tot = cells.groupBy(*within, "value").agg(F.sum("c").alias("t")).withColumn("_span", _span(F.col("value")))
    up_to = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    spans = tot.groupBy(*within, "_span").agg(F.sum("t").alias("_n"))
    spans = spans.select(*within, "_span", F.coalesce(F.sum("_n").over(up_to(*within).orderBy("_span")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("t").over(up_to(*within, "_span").orderBy("value")), F.lit(0))
    ranked = tot.withColumn("_inside", inside).join(spans, [*within, "_span"])
    rank = F.col("_before") + F.col("_inside") + (F.col("t") + 1) / F.lit(2.0)
    return cells.join(ranked.select(*within, "value", "t", rank.alias("rank")), [*within, "value"])


def average_ranks(df: DataFrame, within: Sequence[str], group: str, value: str) -> DataFrame:
    """(within, group, value, c, t, rank): average rank of each value over all groups."""
    cells = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*within, F.col(group).alias("grp"), F.col(value).alias("value")).agg(F.count("*").alias("c"))
    return _ranked(cells, within)


def _p(f, *cols: Column) -> Column:
    @F.pandas_udf("double")
    def run(*s: pd.Series) -> pd.Series:
        return pd.Series([f(*x) for x in zip(*s, strict=True)], dtype="float64")

    return run(*cols)


def kruskal_wallis(df: DataFrame, within: Sequence[str], group: str, value: str) -> DataFrame:
    """(within, k, n, h, p_value, epsilon_squared): tie-corrected; all values equal gives h 0, p 1; fewer than two groups give nothing."""
    r = average_ranks(df, within, group, value)
    per = r.groupBy(*within, "grp").agg(F.sum(F.col("rank") * F.col("c")).alias("rs"), F.sum("c").alias("m"))
    g = per.groupBy(*within).agg(F.count("*").alias("k"), F.sum("m").alias("n"), F.sum(F.col("rs") * F.col("rs") / F.col("m")).alias("q"))
    t = r.select(*within, "value", "t").distinct().groupBy(*within).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    j = (g.join(t, list(within)) if within else g.crossJoin(t)).where(F.col("k") >= 2)
    n = F.col("n").cast("double")
    c = F.lit(1.0) - F.col("ties") / (n * n * n - n)
    h = F.when(c <= 0, F.lit(0.0)).otherwise((F.lit(12.0) / (n * (n + 1.0)) * F.col("q") - 3.0 * (n + 1.0)) / c)
    j = j.withColumn("h", h)
    eps = F.when(n > F.col("k"), F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1.0) / (n - F.col("k")))).otherwise(0.0)
    return j.select(*within, "k", "n", F.round("h", 4).alias("h"), F.round(_p(lambda x, k: chi2_sf(x, int(k) - 1), F.col("h"), F.col("k")), 6).alias("p_value"),
                    F.round(F.when(c <= 0, 0.0).otherwise(eps), 4).alias("epsilon_squared"))


def magnitude(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").otherwise("large")


def mann_whitney(df: DataFrame, within: Sequence[str], group: str, value: str) -> DataFrame:
    """All pairs of groups a < b: (within, group_a, group_b, n_a, n_b, u, p_value, cliff_delta, magnitude). Groups are categories: the pairs are of
    group names, joined by the distinct values of both, never of rows."""
    base = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*within, F.col(group).alias("grp"), F.col(value).alias("value")).agg(F.count("*").alias("c"))
    names = base.select(*within, "grp").distinct()
    a, b = names.withColumnRenamed("grp", "group_a"), names.withColumnRenamed("grp", "group_b")
    pairs = (a.join(b, list(within)) if within else a.join(b, F.lit(True))).where(F.col("group_a") < F.col("group_b"))
    sides = pairs.select(*within, "group_a", "group_b", F.explode(F.array("group_a", "group_b")).alias("grp"))
    cells = sides.join(base, [*within, "grp"])
    by = [*within, "group_a", "group_b"]
    r = _ranked(cells, by)
    in_a = F.col("grp") == F.col("group_a")
    g = r.groupBy(*by).agg(F.sum(F.when(in_a, F.col("rank") * F.col("c")).otherwise(0.0)).alias("r1"), F.sum(F.when(in_a, F.col("c")).otherwise(0)).alias("n_a"), F.sum(F.when(in_a, 0).otherwise(F.col("c"))).alias("n_b"),
                           (F.sum(F.col("c") * (F.col("t").cast("double") * F.col("t") - 1.0))).alias("ties"))
    u = F.col("r1") - F.col("n_a") * (F.col("n_a") + 1) / F.lit(2.0)
    delta = 2.0 * F.col("u") / (F.col("n_a").cast("double") * F.col("n_b")) - 1.0
    g = g.withColumn("u", u).withColumn("cliff_delta", delta)
    return g.select(*by, "n_a", "n_b", "u", F.round(_p(mann_whitney_p, F.col("u"), F.col("n_a"), F.col("n_b"), F.col("ties")), 6).alias("p_value"),
                    F.round("cliff_delta", 4).alias("cliff_delta"), magnitude(F.col("cliff_delta")).alias("magnitude"))


def wilcoxon_paired(pairs: DataFrame, within: Sequence[str], x: str, y: str) -> DataFrame:
    """Signed ranks of x - y per group: (within, n_pairs, statistic, p_value). Nulls and zero differences are left out; all zero: n*n/2, p 1."""
    d = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*within, F.round(F.col(x) - F.col(y), 9).alias("d"))
    size = d.groupBy(*within).agg(F.count("*").alias("n_pairs"))
    cells = d.where(F.col("d") != 0).groupBy(*within, F.signum("d").alias("grp"), F.abs("d").alias("value")).agg(F.count("*").alias("c"))
    r = _ranked(cells, within)
    g = r.groupBy(*within).agg(F.sum(F.when(F.col("grp") > 0, F.col("rank") * F.col("c")).otherwise(0.0)).alias("wp"), F.sum(F.when(F.col("grp") < 0, F.col("rank") * F.col("c")).otherwise(0.0)).alias("wm"),
                               F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("t").cast("double") * F.col("t") - 1.0)).alias("ties"))
    j = size.join(g, list(within), "left") if within else size.crossJoin(g)
    n = F.col("n_pairs").cast("double")
    stat = F.when(F.coalesce("m", F.lit(0)) > 0, F.least("wp", "wm")).otherwise(n * n / 2.0)
    p = F.when(F.coalesce("m", F.lit(0)) > 0, _p(lambda w, k, t: wilcoxon_p(w, int(k), t), F.coalesce(F.least("wp", "wm"), F.lit(0.0)), F.coalesce("m", F.lit(0)), F.coalesce("ties", F.lit(0.0)))).otherwise(1.0)
    return j.select(*within, "n_pairs", stat.alias("statistic"), F.round(p, 6).alias("p_value"))


def sample_status(df: DataFrame, group: str, least: int, within: Sequence[str] = ()) -> DataFrame:
    g = df.where(F.col(group).isNotNull() & (F.trim(F.col(group)) != "")).groupBy(*within, F.col(group).alias("grp")).agg(F.count("*").alias("n"))
    return g.select(*within, "grp", "n", F.when(F.col("n") >= least, "ok").otherwise("insufficient_sample").alias("status"))
