"""Groups of label records by category and zone, and the report tables made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregate as A
from tidemark.operators import consensus as C
from tidemark.sinks.tables import wide

KEYS = ("tname", "zone_type")
LABELS = {"emotion": C.EMOTION, "interaction_type": C.INTERACTION, "sentence_function": C.SENTENCE, "orthography": C.ORTHOGRAPHY}
SYLLABLES = ("one", "two", "three_plus")


def group_sizes(records: DataFrame, keys: Sequence[str] = KEYS, size: str = "segment_n") -> DataFrame:
    """(keys, danmaku_count, segments, video_count) over the distinct segments that have records, each counting all its comments once."""
    once = records.groupBy(*keys, "bvid", "segment_id").agg(F.max(size).alias("_n"))
    videos = once.groupBy(*keys, "bvid").agg(F.sum("_n").alias("_n"), F.count("*").alias("_k"))
    return videos.groupBy(*keys).agg(F.sum("_n").alias("danmaku_count"), F.sum("_k").alias("segments"), F.count("*").alias("video_count"))


def group_tags(records: DataFrame, tags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, tags): the distinct tags of the group's videos, sorted. ``tags``: (bvid, tags), several rows per video allowed. What is gathered is
    one list of names per group; nulls and videos without tags add nothing."""
    names = tags.select("bvid", F.explode("tags").alias("tag")).where(F.col("tag").isNotNull()).distinct()
    held = records.select(*keys, "bvid").distinct().join(names, "bvid").select(*keys, "tag").distinct()
    return held.groupBy(*keys).agg(F.sort_array(F.collect_list("tag")).alias("tags"))


def merged_shares(shares: DataFrame, segments: DataFrame, keys: Sequence[str], weight: str = "total_comments") -> DataFrame:
    """Shares of segments, (bvid, segment_id, key, ratio), merged over groups: weighted by the segment's comments, a missing key counting 0.
    ``segments``: (bvid, segment_id, keys, weight) of all segments that take part."""
    totals = segments.groupBy(*keys).agg(F.sum(weight).alias("total"))
    return A.weighted_map(shares.join(segments, ["bvid", "segment_id"]), totals, weight, list(keys))


def label_table(records: DataFrame, dim: str, keys: Sequence[str] = KEYS, prefix: str = "") -> DataFrame:
    """One row per group: its comments and the weighted share of each label of a dimension (0 if it does not occur)."""
    soft = A.weighted_soft(records, list(keys)).where(F.col("dim") == dim)
    return group_sizes(records, keys).select(*keys, "danmaku_count").join(wide(soft, keys, "label", "ratio", prefix, LABELS[dim]), list(keys))


def emotion_table(records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``label_table`` of emotions with the weighted rate of violations."""
    rate = A.consensus_rates(records, list(keys)).select(*keys, F.col("violation_rate").alias("cooperative_principle_violation_rate"))
    return label_table(records, "emotion", keys).join(rate, list(keys))


def consensus_table(records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rates of consensus, mean weight and the interval of the high rate."""
    r = A.with_interval(A.consensus_rates(records, list(keys)))
    r = r.select(*keys, "high_consensus_rate", "medium_consensus_rate", "low_consensus_rate", "avg_weight_multiplier",
                 *[F.col(f"ci_{x}").alias(f"high_consensus_ci_{x}") for x in ("lower", "upper", "status")])
    return group_sizes(records, keys).select(*keys, "danmaku_count").join(r, list(keys))


def lexical_table(metrics: DataFrame, pos: DataFrame, keys: Sequence[str] = KEYS, parts: Sequence[str] = ("eng", "m", "n")) -> DataFrame:
    """One row per group: comments, three means, and shares of parts of speech and of word lengths, all weighted by the segments' comments.
    ``metrics``: measures per segment with the keys; ``pos``: (bvid, segment_id, pos, ratio)."""
    seg = metrics.select("bvid", "segment_id", *keys, "total_comments")
    shares = merged_shares(pos.select("bvid", "segment_id", F.col("pos").alias("key"), "ratio"), seg, keys)
    names = [f"syllable_{x}" for x in SYLLABLES]
    means = A.weighted_hard(metrics, ["avg_word_length", "content_word_density", "punctuation_emoji_rate", *names], keys=list(keys)).drop("segments")
    return means.join(wide(shares, keys, "key", "ratio", "pos_", parts), list(keys), "left").na.fill(0.0, [f"pos_{p}" for p in parts])


def orthography_table(metrics: DataFrame, records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Measured (``hard_``) and labelled (``soft_``) orthography per group."""
    names = ["uppercase_abbr_per_1000", "number_symbol_per_1000", "emoticon_per_1000"]
    hard = A.weighted_hard(metrics, names, keys=list(keys)).select(*keys, *[F.col(n).alias(f"hard_{n}") for n in names])
    return label_table(records, "orthography", keys, "soft_").join(hard, list(keys))


def tenths(seconds: Column) -> Column:
    """Seconds with one decimal, halves up, as text; exact in thousandths."""
    q = F.floor((F.round(seconds * 1000).cast("long") + 50) / 100).cast("long")
    return F.concat(F.floor(q / 10).cast("string"), F.lit("."), F.pmod(q, F.lit(10)).cast("string"))


def kappa_rows(records: DataFrame) -> DataFrame:
    """One flat row per label record for agreement between coders, 17 columns, with a default for what is missing."""
    f = lambda path, default: F.coalesce(F.col(f"output.{path}"), F.lit(default))
    text = lambda c: F.coalesce(c, F.lit(""))
    out = [text(F.col("uid_hash")).alias("uid_hash"), F.concat(tenths(F.col("start_time")), F.lit("-"), tenths(F.col("end_time"))).alias("time_segment"), text(F.col("content")).alias("raw_text"),
           text(F.col("tname")).alias("tname"), text(F.col("zone_type")).alias("zone_type"), text(F.col("consensus_level")).alias("consensus_level"), F.coalesce("weight_multiplier", F.lit(1.0)).alias("weight_multiplier")]
    for dim, field in (("emotion", "label"), ("interaction_type", "label"), ("sentence_function", "label"), ("orthography", "status")):
        out += [f(f"{dim}.{field}", "").alias(f"{dim}_{field}"), f(f"{dim}.confidence", 0.0).alias(f"{dim}_confidence")]
    out += [f("cooperative_principle.violated", False).alias("cooperative_principle_violated"), f("cooperative_principle.maxim", "").alias("cooperative_principle_maxim")]
    return records.select(*out)


def weighted_distributions(obs: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("tname", "time_period", "zone_type")) -> DataFrame:
    """Means of distribution columns per group of videos, weighted by comments, a missing one counting 0; the divisor is all comments, or 1. Shares count
    in millionths, sums are exact and rounded once, to nine digits, halves up, so the result does not depend on the order of rows."""
    w = F.coalesce("danmaku_count", F.lit(0))
    exact = lambda c: F.sum(F.round(F.coalesce(c, F.lit(0.0)) * 1e6).cast("decimal(18,0)") * w.cast("decimal(18,0)"))
    g = obs.groupBy(*keys).agg(F.greatest(F.sum(w), F.lit(1)).cast("decimal(20,0)").alias("_w"), *[exact(c).alias(f"_{c}") for c in columns])
    return g.select(*keys, *[(F.expr(f"(`_{c}` * 2000 + _w) div (2 * _w)") / F.lit(1e9)).alias(f"{c}_mean") for c in columns])


def snapshot_manifests(observations: DataFrame) -> DataFrame:
    """(snapshot_no, video_count, prompt_versions): what a delivery holds. The versions, few, are sorted; the videos stay a table, ``snapshot_videos``."""
    videos = observations.groupBy("snapshot_no", "bvid").agg(F.count("*").alias("_n")).groupBy("snapshot_no").agg(F.count("*").alias("video_count"))
    kinds = observations.where(F.coalesce("prompt_version", F.lit("")) != "").select("snapshot_no", "prompt_version").distinct()
    kinds = kinds.groupBy("snapshot_no").agg(F.sort_array(F.collect_list("prompt_version")).alias("v"))
    return videos.join(kinds, "snapshot_no", "left").select("snapshot_no", "video_count", F.concat_ws(",", "v").alias("prompt_versions"), (F.coalesce(F.size("v"), F.lit(0)) > 1).alias("mixed_versions"))


def snapshot_videos(observations: DataFrame) -> DataFrame:
    """The distinct videos of each delivery, sorted within their partitions' ranges."""
    return observations.select("snapshot_no", "bvid").distinct().repartitionByRange("snapshot_no", "bvid").sortWithinPartitions("snapshot_no", "bvid")
