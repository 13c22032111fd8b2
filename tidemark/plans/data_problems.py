"""Queries of the general data problems 3 and 4, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dense_totals import dense_totals
from tidemark.operators.snapshots import MEASURES, snapshot_changes
from tidemark.session import blank_to_null, table

HOT_SHARE = 0.05


def video_names(videos: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row per video: (``bvid``, ``tname``), the trimmed name of any crawl, else the lookup's name for its ``tid``,
    else null. With differing names the smallest is taken. The lookup is a fixed table of about 60 rows."""
    names = lookup.select(F.col("tid").alias("_tid"), blank_to_null(F.col("tname")).alias("_known"))
    named = videos.join(names, F.col("tid") == F.col("_tid"), "left")
    own = blank_to_null(F.col("tname"))
    return named.groupBy("bvid").agg(F.coalesce(F.min(own), F.min("_known")).alias("tname"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "corpus_snapshots")).select("snapshot_no", "bvid", "change_type", "field")


def p3_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many videos and fields changed from each delivery to the next."""
    c = snapshot_changes(table(spark, sf, "corpus_snapshots"))
    return c.groupBy("snapshot_no", "change_type", "field").agg(F.count("*").alias("videos"))


def _by_name(per_video: DataFrame, names: DataFrame, values: list[str]) -> DataFrame:
    """Totals per video summed to totals per name, again over dense arrays."""
    named = per_video.join(names, per_video["key"] == names["bvid"]).select("tname", "n", *values)
    t = dense_totals(named, "tname", ["n", *values])
    return t.select("key", F.col("sum_n").alias("n"), *[F.col(f"sum_{v}").alias(v) for v in values])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    comments = table(spark, sf, "comments").select("bvid")
    names = video_names(table(spark, sf, "videos"), table(spark, sf, "partition_lookup"))
    total = comments.count()
    per_video = dense_totals(comments, "bvid")
    hot = lambda d, kind: d.where(F.col("n") >= F.lit(HOT_SHARE) * F.lit(total)).select(F.lit(kind).alias("key_kind"), F.col("key").alias("key_value"))
    return hot(per_video, "bvid").unionByName(hot(_by_name(per_video, names, []), "tname"))


def p4_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per ``bvid`` and per ``tname`` over comments, videos and snapshots; for snapshots the comment sums too."""
    names = video_names(table(spark, sf, "videos"), table(spark, sf, "partition_lookup"))
    out = None
    for name, values in (("comments", []), ("videos", []), ("corpus_snapshots", ["danmaku_count"])):
        per_video = dense_totals(table(spark, sf, name), "bvid", values)
        if values:
            per_video = per_video.withColumnsRenamed({f"sum_{v}": v for v in values})
        for kind, d in (("bvid", per_video), ("tname", _by_name(per_video, names, values))):
            d = d.select(F.lit(name).alias("tbl"), F.lit(kind).alias("key_kind"), F.col("key").alias("key_value"), F.col("n").alias("row_count"),
                         (F.col("danmaku_count") if values else F.lit(None).cast("long")).alias("danmaku_sum"))
            out = d if out is None else out.unionByName(d)
    return out


QUERIES = {"p3_found": p3_found, "p3_change_counts": p3_change_counts, "p4_found": p4_found, "p4_totals": p4_totals}

_P3 = f"""
WITH once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, bvid, zone_type ORDER BY delivered_at) AS rn FROM corpus_snapshots
  WHERE snapshot_no IS NOT NULL AND bvid IS NOT NULL) WHERE rn = 1),
vid AS (SELECT snapshot_no, bvid, arg_min(tname, zone_type) AS tname, arg_min(prompt_version, zone_type) AS prompt_version,
  sum(danmaku_count) AS danmaku_count, {", ".join(f"avg({m}) AS {m}" for m in MEASURES)} FROM once GROUP BY ALL),
steps AS (SELECT snapshot_no AS a, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS b FROM (SELECT DISTINCT snapshot_no FROM vid)),
old AS (SELECT s.b AS later, v.* FROM vid v JOIN steps s ON v.snapshot_no = s.a WHERE s.b IS NOT NULL),
neu AS (SELECT v.* FROM vid v WHERE snapshot_no IN (SELECT b FROM steps)),
changes AS (
SELECT n.snapshot_no, n.bvid, 'added' AS change_type, '' AS field FROM neu n ANTI JOIN old o ON o.later = n.snapshot_no AND o.bvid = n.bvid
UNION ALL SELECT o.later, o.bvid, 'removed', '' FROM old o ANTI JOIN neu n ON o.later = n.snapshot_no AND o.bvid = n.bvid
""" + "".join(
    f"UNION ALL SELECT o.later, o.bvid, 'changed', '{f}' FROM old o JOIN neu n ON o.later = n.snapshot_no AND o.bvid = n.bvid WHERE o.{f} IS DISTINCT FROM n.{f}\n"
    for f in ("tname", "prompt_version", "danmaku_count")
) + "".join(
    f"UNION ALL SELECT o.later, o.bvid, 'changed', '{f}' FROM old o JOIN neu n ON o.later = n.snapshot_no AND o.bvid = n.bvid WHERE abs(o.{f} - n.{f}) > 1e-9 OR (o.{f} IS NULL) <> (n.{f} IS NULL)\n"
    for f in MEASURES
) + ")\n"

_NAMES = r"""
names AS (SELECT v.bvid, coalesce(min(nullif(regexp_replace(v.tname, '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g'), '')), min(p.tname)) AS tname
  FROM videos v LEFT JOIN partition_lookup p ON v.tid = p.tid GROUP BY v.bvid)
"""

_P4_PARTS = []
for _t, _v in (("comments", "CAST(NULL AS BIGINT)"), ("videos", "CAST(NULL AS BIGINT)"), ("corpus_snapshots", "CAST(sum(danmaku_count) AS BIGINT)")):
    _P4_PARTS += [
        f"SELECT '{_t}' AS tbl, 'bvid' AS key_kind, bvid AS key_value, count(*) AS row_count, {_v} AS danmaku_sum FROM {_t} WHERE bvid IS NOT NULL GROUP BY bvid",
        f"SELECT '{_t}', 'tname', n.tname, count(*), {_v} FROM {_t} t JOIN names n ON t.bvid = n.bvid WHERE n.tname IS NOT NULL GROUP BY n.tname",
    ]

SQL = {
    "p3_found": _P3 + "SELECT CAST(snapshot_no AS INTEGER) AS snapshot_no, bvid, change_type, field FROM changes",
    "p3_change_counts": _P3 + "SELECT CAST(snapshot_no AS INTEGER) AS snapshot_no, change_type, field, count(*) AS videos FROM changes GROUP BY ALL",
    "p4_found": f"""WITH {_NAMES}, total AS (SELECT count(*) AS n FROM comments)
SELECT 'bvid' AS key_kind, bvid AS key_value FROM comments GROUP BY bvid HAVING count(*) >= 0.05e0 * (SELECT n FROM total)
UNION ALL SELECT 'tname', tname FROM comments c JOIN names USING (bvid) WHERE tname IS NOT NULL GROUP BY tname HAVING count(*) >= 0.05e0 * (SELECT n FROM total)""",
    "p4_totals": f"WITH {_NAMES} " + " UNION ALL ".join(_P4_PARTS),
}
