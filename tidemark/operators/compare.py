"""The comparison of a corpus: sample sizes, rank tests between groups, paired tests between zones, as one typed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import statistics as X
from tidemark.operators.snapshots import MEASURES
from tidemark.session import blank_to_null, materialise
from tidemark.settings import DEFAULT, Settings

COLUMNS = "ord int, metric string, test_type string, group1 string, group2 string, n1 long, n2 long, statistic double, p_value double, effect_size double, effect_magnitude string, note string"
UNCORRECTED = "p not corrected for multiple tests"


def axis(obs: DataFrame) -> str:
    """'time_period' if there is one category and at least two periods, else 'tname'."""
    cols = [F.count_distinct(blank_to_null(F.col("tname"))).alias("t")]
    cols.append(F.count_distinct(blank_to_null(F.col("time_period"))).alias("p") if "time_period" in obs.columns else F.lit(0).alias("p"))
    r = obs.agg(*cols).first()
    return "time_period" if r.t <= 1 and r.p >= 2 else "tname"


def _shape(df: DataFrame, within: Sequence[str], ord_: int, kind: str, **given) -> DataFrame:
    names = [x.split() for x in COLUMNS.split(", ")]
    fixed = {"ord": F.lit(ord_), "test_type": F.lit(kind)} | given
    return df.select(*within, *[(fixed[n] if n in fixed else F.lit(None)).cast(t).alias(n) for n, t in names])


def paired_rows(obs: DataFrame, measures: Sequence[str] = MEASURES, settings: Settings = DEFAULT, within: Sequence[str] = ()) -> DataFrame:
    """Hot against cold zones of the same videos (the first row of each video and zone), for at least so many pairs without nulls; the effect is
    the unpaired Cliff's delta. Tests are made ``within`` these columns."""
    w = list(within)
    once = obs.where(F.col("zone_type").isin("hot_zone", "cold_zone")).groupBy(*w, "bvid", "zone_type").agg(F.min(F.struct(*measures)).alias("r")).select(*w, "bvid", "zone_type", "r.*")
    long = X.melt(once, [*w, "bvid", "zone_type"], measures)
    side = lambda z, n: long.where(F.col("zone_type") == z).select(*w, "bvid", "metric", F.col("value").alias(n))
    pairs = side("hot_zone", "x").join(side("cold_zone", "y"), [*w, "bvid", "metric"]).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    t = X.wilcoxon_paired(pairs, [*w, "metric"], "x", "y").where(F.col("n_pairs") >= settings.min_videos_per_partition)
    flat = pairs.select(*w, "metric", F.inline(F.array(F.struct(F.lit("a_hot").alias("z"), F.col("x").alias("v")), F.struct(F.lit("b_cold").alias("z"), F.col("y").alias("v")))))
    d = X.mann_whitney(flat, [*w, "metric"], "z", "v").select(*w, "metric", "cliff_delta", "magnitude")
    return _shape(t.join(d, [*w, "metric"]), w, 3, "wilcoxon_paired", metric=F.col("metric"), group1=F.lit("hot_zone"), group2=F.lit("cold_zone"), n1=F.col("n_pairs"), n2=F.col("n_pairs"),
                  statistic=F.round("statistic", 4), p_value=F.col("p_value"), effect_size=F.col("cliff_delta"), effect_magnitude=F.col("magnitude"), note=F.lit(UNCORRECTED))


def corpus_compare(obs: DataFrame, measures: Sequence[str] = MEASURES, group: str | None = None, settings: Settings = DEFAULT, within: Sequence[str] = (), paired: bool | None = None) -> DataFrame:
    """One row per group with its sample status; then, over groups of at least so many rows, per measure a Kruskal-Wallis row and a Mann-Whitney row for each pair
    (groups with fewer than two values of a measure are left out of it); with a single category, or if ``paired``, also the paired rows, or a note if nothing
    could be compared. All tests are made ``within`` these columns (a delivery, a category), which lead the result; rows with a null there are left
    out. Sizes count rows, so a video with two zone rows counts twice. Rows are told apart and put in order by ``ord``."""
    w = list(within)
    # read by every test below: written once
    obs = materialise(obs.select(*dict.fromkeys([*w, *[c for c in ("bvid", "tname", "time_period", "zone_type", group) if c in obs.columns], *measures])), "observations")
    by = group or axis(obs)
    rows = obs.where(blank_to_null(F.col(by)).isNotNull()).withColumn("_g", F.col(by).cast("string"))
    for c in w:
        rows = rows.where(F.col(c).isNotNull())
    least = settings.min_videos_per_partition
    sizes = rows.groupBy(*w, "_g").agg(F.count("*").alias("n"))
    enough = F.col("n") >= least
    out = _shape(sizes, w, 0, "sample_status", group1=F.col("_g"), n1=F.col("n"), note=F.when(enough, "sample_sufficient").otherwise("insufficient_sample"))
    note = F.lit(UNCORRECTED if by == "tname" else f"{UNCORRECTED}; axis: period")
    valid = sizes.where(enough).select(*w, "_g")
    long = X.melt(rows.join(valid, [*w, "_g"], "left_semi").select(*w, "_g", *measures), [*w, "_g"], measures).where(F.col("value").isNotNull())
    two = long.groupBy(*w, "metric", "_g").agg(F.count("*").alias("k")).where(F.col("k") >= 2)
    long = long.join(two.select(*w, "metric", "_g"), [*w, "metric", "_g"], "left_semi")
    k = X.kruskal_wallis(long, [*w, "metric"], "_g", "value")
    m = X.mann_whitney(long, [*w, "metric"], "_g", "value")
    out = out.unionByName(_shape(k, w, 1, "kruskal_wallis", metric=F.col("metric"), n1=F.col("n"), statistic=F.col("h"), p_value=F.col("p_value"), effect_size=F.col("epsilon_squared"), note=note))
    out = out.unionByName(_shape(m, w, 2, "mann_whitney", metric=F.col("metric"), group1=F.col("group_a"), group2=F.col("group_b"), n1=F.col("n_a"), n2=F.col("n_b"),
                                 statistic=F.col("u"), p_value=F.col("p_value"), effect_size=F.col("cliff_delta"), effect_magnitude=F.col("magnitude"), note=note))
    if paired is None:
        paired = rows.agg(F.count_distinct(F.trim("tname"))).first()[0] <= 1
    if paired and "zone_type" in obs.columns:
        pairs = paired_rows(rows, measures, settings, w)
        out = out.unionByName(pairs)
        if not w and valid.count() < 2 and not pairs.take(1):
            out = out.unionByName(_shape(obs.sparkSession.range(1), w, 4, "note", note=F.lit("one category, no second axis: nothing was compared")))
    return out


def compare_two(df: DataFrame, group: str, value: str, settings: Settings = DEFAULT) -> DataFrame:
    """Descriptives per group, and for two groups of at least three values each the test between them with its flag at alpha."""
    d = X.descriptives(df, [group], value)
    size = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("k")).where(F.col("k") >= 3)
    m = X.mann_whitney(df.join(size, group, "left_semi"), [], group, value).withColumn("significant", F.col("p_value") < settings.significance_alpha)
    return d.join(m, (F.col(group) == F.col("group_a")) | (F.col(group) == F.col("group_b")), "left")


def prefix_means(wide: DataFrame, columns: Sequence[str], weight: str = "danmaku_count") -> DataFrame:
    """Weighted means of distribution columns by (group of names: the part before '_', category of videos, column), for plots."""
    long = X.melt(wide.select("tname", weight, *columns), ["tname", weight], columns).where(F.col("value").isNotNull())
    w = F.sum(F.col(weight).cast("double"))
    return long.groupBy(F.split_part("metric", F.lit("_"), F.lit(1)).alias("family"), "tname", "metric").agg(F.when(w > 0, F.sum(F.col("value") * F.col(weight)) / w).otherwise(F.avg("value")).alias("mean"))
