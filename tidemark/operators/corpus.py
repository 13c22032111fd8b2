"""Corpus level: one observation per video, groups, index, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import period_bucket
from tidemark.operators.snapshots import MEASURES
from tidemark.session import blank_to_null
from tidemark.settings import DEFAULT, Settings


def zone_rows(snapshots: DataFrame) -> DataFrame:
    """One row per (snapshot_no, bvid, zone_type), the last delivered."""
    cols = [c for c in snapshots.columns if c not in ("snapshot_no", "bvid", "zone_type")]
    g = snapshots.groupBy("snapshot_no", "bvid", "zone_type").agg(F.max(F.struct("delivered_at", *[c for c in cols if c != "delivered_at"])).alias("r"))
    return g.select("snapshot_no", "bvid", "zone_type", "r.*")


def observations(zones: DataFrame, policy: str = DEFAULT.zone_policy, measures: Sequence[str] = MEASURES, keys: Sequence[str] = ("snapshot_no", "bvid")) -> DataFrame:
    """Zone rows folded by policy: 'hot_only' (videos without a hot zone drop out), 'weighted' (both zones merged), 'all' (one row per zone). Measures are
    means weighted by comments over the zones where they are not null; equal weights if there are no comments."""
    if policy not in ("hot_only", "weighted", "all"):
        raise ValueError(policy)
    rows = zones.where(F.col("zone_type") == "hot_zone") if policy == "hot_only" else zones
    by = [*keys, "zone_type"] if policy == "all" else list(keys)
    w = F.greatest(F.coalesce("danmaku_count", F.lit(0)), F.lit(0)).cast("double")
    total = F.sum(w)
    known = lambda m: F.col(m).isNotNull()
    mean = lambda m: F.when(total > 0, F.sum(F.when(known(m), F.col(m) * w)) / F.nullif(F.sum(F.when(known(m), w)), F.lit(0.0))).otherwise(F.avg(m))
    out = rows.groupBy(*by).agg(
        F.min_by("tname", F.coalesce("zone_type", F.lit("~"))).alias("tname"), F.min_by("prompt_version", F.coalesce("zone_type", F.lit("~"))).alias("prompt_version"),
        F.min_by("pubdate", F.coalesce("zone_type", F.lit("~"))).alias("pubdate"), total.cast("long").alias("danmaku_count"), *[mean(m).alias(m) for m in measures])
    return out if policy == "all" else out.withColumn("zone_type", F.lit(None).cast("string"))


def corpus_groups(obs: DataFrame, measures: Sequence[str] = MEASURES, granularity: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Per (``within``, tname, time_period, zone_type): videos, comments, mean and sample deviation (0 for one video) of each measure; a missing measure counts as 0."""
    period = period_bucket(F.col("pubdate"), granularity) if granularity else F.lit("all")
    g = obs.withColumn("time_period", period).groupBy(*within, "tname", "time_period", "zone_type")
    out = [F.count("*").alias("video_count"), F.sum("danmaku_count").alias("total_danmaku")]
    for m in measures:
        x = F.coalesce(m, F.lit(0.0))
        out += [F.round(F.avg(x), 9).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 9).alias(f"{m}_std")]
    return g.agg(*out).orderBy(*within, "tname", "time_period", "zone_type")


def small_groups(groups: DataFrame, settings: Settings = DEFAULT, within: Sequence[str] = ()) -> DataFrame:
    return groups.where(F.col("video_count") < settings.min_videos_per_partition).select(*within, "tname", "time_period", "zone_type", "video_count")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each key (upsert, state logs); ties by all columns. Map-side combine, no window."""
    rest = [c for c in rows.columns if c not in keys]
    first = [c for c in order] + [c for c in rest if c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*first)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(index: DataFrame, entries: DataFrame, key: str = "bvid") -> DataFrame:
    """The index with entries replaced or appended by key; later entries win."""
    both = index.withColumn("_g", F.lit(0)).unionByName(entries.withColumn("_g", F.lit(1)), allowMissingColumns=True)
    return latest(both, [key], ["_g"]).drop("_g")


def as_of(index: DataFrame, moment: str, column: str = "analyzed_at") -> DataFrame:
    """Entries up to a moment; without a date they are left out."""
    return index.where(F.col(column) <= F.lit(moment))


def partition_gaps(index: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(tname, have, min_required, missing), the fullest first, then by name; blank names count as 'unknown'."""
    n = F.lit(settings.min_videos_per_partition)
    gaps = index.groupBy(F.coalesce(blank_to_null(F.col("tname")), F.lit("unknown")).alias("tname")).agg(F.count("*").alias("have")).select(
        "tname", "have", n.cast("long").alias("min_required"), F.greatest(n - F.col("have"), F.lit(0)).cast("long").alias("missing"))
    return gaps.orderBy(F.desc("have"), "tname")


def candidates(found: DataFrame, indexed: DataFrame, per_partition: int, size: str = "danmaku_count") -> DataFrame:
    """Videos not yet indexed, the largest of each partition (ties by bvid)."""
    w = W.partitionBy("tname").orderBy(F.desc(size), "bvid")
    return found.join(indexed.select("bvid").distinct(), "bvid", "left_anti").withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per_partition)


def work_left(requested: DataFrame, done: DataFrame, key: str = "bvid") -> DataFrame:
    return requested.dropDuplicates([key]).join(done.select(key), key, "left_anti")
