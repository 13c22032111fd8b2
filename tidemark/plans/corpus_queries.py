"""Queries at corpus level, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import period_bucket
from tidemark.operators import corpus as K
from tidemark.operators import statistics as X
from tidemark.operators.compare import corpus_compare
from tidemark.operators.snapshots import MEASURES
from tidemark.plans import views as V
from tidemark.plans.data_problems import _NAMES
from tidemark.session import table


def _zones(s: SparkSession, sf: str) -> DataFrame:
    return K.zone_rows(table(s, sf, "corpus_snapshots"))


def _observed(s: SparkSession, sf: str, policy: str) -> DataFrame:
    """The observations of every delivery; what follows is computed for each ``snapshot_no``."""
    return K.observations(_zones(s, sf), policy)


def _rounded(df: DataFrame, columns=MEASURES) -> DataFrame:
    return df.withColumns({m: F.round(m, 9) for m in columns})


def _long(s: SparkSession, sf: str) -> DataFrame:
    """Measures in long form, rounded so that equal values are ties."""
    return X.melt(_rounded(_observed(s, sf, "weighted")), ["snapshot_no", "bvid", "tname"], MEASURES)


def q_zone_policy_hot(s, sf):
    return _rounded(K.observations(_zones(s, sf), "hot_only")).drop("pubdate", "zone_type")


def q_zone_policy_weighted(s, sf):
    return _rounded(K.observations(_zones(s, sf), "weighted")).drop("pubdate", "zone_type")


def q_zone_policy_all(s, sf):
    return _rounded(K.observations(_zones(s, sf), "all")).drop("pubdate")


def q_period_bucket(s, sf):
    p = table(s, sf, "corpus_snapshots").select("pubdate").distinct()
    return p.select("pubdate", *[period_bucket(F.col("pubdate"), g).alias(g) for g in ("year", "quarter", "month")])


def q_corpus_group(s, sf):
    return K.corpus_groups(_observed(s, sf, "all"), within=["snapshot_no"])


def q_small_groups(s, sf):
    return K.small_groups(K.corpus_groups(_observed(s, sf, "all"), granularity="quarter", within=["snapshot_no"]), within=["snapshot_no"])


def q_descriptives(s, sf):
    o = table(s, sf, "orders").join(table(s, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return X.descriptives(o, ["c_mktsegment"], "o_totalprice")


def q_snapshot_descriptives(s, sf):
    """Of the measures of all zone rows, in millionths: sums of whole numbers do not depend on the order of rows."""
    obs = _observed(s, sf, "all").withColumns({m: F.round(F.col(m) * 1e6) for m in MEASURES})
    d = X.descriptives(X.melt(obs, ["snapshot_no", "bvid", "tname"], MEASURES), ["snapshot_no", "tname", "metric"], "value")
    return d.withColumns({c: F.round(c, 3) for c in ("mean", "median", "std", "q25", "q75")})


def q_average_ranks(s, sf):
    r = X.average_ranks(_observed(s, sf, "weighted"), ["snapshot_no"], "tname", "danmaku_count")
    return r.select("snapshot_no", "grp", "value", "c", "t", "rank")


def q_kruskal_wallis(s, sf):
    return X.kruskal_wallis(_long(s, sf), ["snapshot_no", "metric"], "tname", "value").drop("p_value")


def q_kruskal_p(s, sf):
    return X.kruskal_wallis(_long(s, sf), ["snapshot_no", "metric"], "tname", "value")


def q_mann_whitney(s, sf):
    return X.mann_whitney(_long(s, sf), ["snapshot_no", "metric"], "tname", "value").drop("p_value")


def q_mann_whitney_p(s, sf):
    return X.mann_whitney(_long(s, sf), ["snapshot_no", "metric"], "tname", "value")


def q_wilcoxon(s, sf):
    o = X.melt(_rounded(_observed(s, sf, "all")), ["snapshot_no", "bvid", "zone_type"], MEASURES)
    pick = lambda z, name: o.where(F.col("zone_type") == z).select("snapshot_no", "bvid", "metric", F.col("value").alias(name))
    return X.wilcoxon_paired(pick("hot_zone", "x").join(pick("cold_zone", "y"), ["snapshot_no", "bvid", "metric"]), ["snapshot_no", "metric"], "x", "y").drop("p_value")


def q_sample_status(s, sf):
    return X.sample_status(_observed(s, sf, "weighted"), "tname", 30, ["snapshot_no"])


def q_index_upsert(s, sf):
    v = table(s, sf, "videos").select("bvid", "title", "view_count", "crawled_at")
    return K.latest(v.select("bvid", "crawled_at", F.coalesce("view_count", F.lit(-1)).alias("view_count")), ["bvid"], ["crawled_at"])


def q_index_as_of(s, sf):
    v = table(s, sf, "videos").select("bvid", F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ss").alias("analyzed_at"))
    return K.as_of(v, "2023-02-01T00:00:00")


def q_partition_gaps(s, sf):
    return K.partition_gaps(V.names(s, sf))


def q_candidates(s, sf):
    n = table(s, sf, "comments").groupBy("bvid").agg(F.count("*").alias("danmaku_count"))
    found = n.join(V.names(s, sf), "bvid")
    known = table(s, sf, "corpus_snapshots").where(F.col("zone_type") == "hot_zone").select("bvid")
    return K.candidates(found, known, 5).select("bvid", "tname", "danmaku_count", "pick")


def q_raw_union(s, sf):
    a = table(s, sf, "comments").select("bvid", "content", "time_sec")
    p = F.from_json("payload", "bvid STRING, content STRING, time_sec DOUBLE")
    b = table(s, sf, "raw_comments").select(p.alias("p")).where(F.col("p.bvid").isNotNull()).select("p.*")
    return a.unionByName(b, allowMissingColumns=True).groupBy("bvid").agg(F.count("*").alias("n"), F.count("content").alias("with_text"))


def q_work_left(s, sf):
    return K.work_left(table(s, sf, "comments").select("bvid"), table(s, sf, "videos").select("bvid"))


def q_heatmap_long(s, sf):
    g = _observed(s, sf, "all").groupBy("snapshot_no", F.concat_ws("_", "tname", "zone_type").alias("key")).agg(*[F.round(F.avg(m), 9).alias(m) for m in MEASURES])
    return g.unpivot(["snapshot_no", "key"], [*MEASURES], "metric", "value")


def q_corpus_compare(s, sf):
    obs = _rounded(_observed(s, sf, "weighted")).withColumn("time_period", period_bucket(F.col("pubdate"), "year"))
    return corpus_compare(obs, within=["snapshot_no"])


def q_corpus_compare_periods(s, sf):
    """Within every category: compared by year, and zones in pairs."""
    obs = _rounded(_observed(s, sf, "all")).withColumn("time_period", period_bucket(F.col("pubdate"), "year"))
    return corpus_compare(obs, group="time_period", within=["snapshot_no", "tname"], paired=True)


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_ONCE = "once AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, bvid, zone_type ORDER BY delivered_at DESC) AS rn FROM corpus_snapshots) WHERE rn = 1)"
_MEANS = ", ".join(f"(CASE WHEN sum(danmaku_count) > 0 THEN sum({m} * danmaku_count) / nullif(sum(CASE WHEN {m} IS NOT NULL THEN danmaku_count END), 0) ELSE avg({m}) END) AS {m}" for m in MEASURES)
_R = ", ".join(f"round({m}, 9) AS {m}" for m in MEASURES)
_HEAD = "arg_min(tname, zone_type) AS tname, arg_min(prompt_version, zone_type) AS prompt_version, CAST(sum(danmaku_count) AS BIGINT) AS danmaku_count"
_LAST = f"{_ONCE}, lastz AS (SELECT * FROM once)"
_WEIGHTED = f"{_LAST}, obs AS (SELECT snapshot_no, bvid, {_HEAD}, {_MEANS} FROM lastz GROUP BY snapshot_no, bvid)"
_ALL = f"{_LAST}, obs AS (SELECT snapshot_no, bvid, zone_type, arg_min(pubdate, zone_type) AS pubdate, {_HEAD}, {_MEANS} FROM lastz GROUP BY snapshot_no, bvid, zone_type)"
_LONG = "long AS (UNPIVOT (SELECT {0}, " + _R + " FROM obs) ON " + ", ".join(MEASURES) + " INTO NAME metric VALUE value)"
_QUARTER = "CASE WHEN try_cast(replace(pubdate, 'T', ' ') AS TIMESTAMP) IS NULL THEN 'unknown' ELSE strftime(try_cast(replace(pubdate, 'T', ' ') AS TIMESTAMP), '{0}') END"
_TS = "try_cast(replace(pubdate, 'T', ' ') AS TIMESTAMP)"
_DESC = """round(avg({0}), 9) AS mean, round(median({0}), 9) AS median, round(coalesce(stddev_samp({0}), 0), 9) AS std, round(min({0}), 9) AS min, round(max({0}), 9) AS max, count(*) AS count, round(quantile_cont({0}, 0.25), 9) AS q25, round(quantile_cont({0}, 0.75), 9) AS q75"""
_RANKS = """ranked AS (SELECT *, rank() OVER (PARTITION BY {1} ORDER BY value) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY {0}) AS t FROM {2})"""
_PAIRS = f"""WITH {_WEIGHTED}, {_LONG.format("snapshot_no, bvid, tname")}, names AS (SELECT DISTINCT snapshot_no, metric, tname FROM long WHERE tname IS NOT NULL), pr AS (SELECT a.snapshot_no, a.metric, a.tname AS group_a, b.tname AS group_b FROM names a JOIN names b ON a.snapshot_no = b.snapshot_no AND a.metric = b.metric AND a.tname < b.tname),
src AS (SELECT p.snapshot_no, p.metric, group_a, group_b, l.tname, l.value FROM pr p JOIN long l ON l.snapshot_no = p.snapshot_no AND l.metric = p.metric AND l.tname IN (p.group_a, p.group_b)),
{_RANKS.format("snapshot_no, metric, group_a, group_b, value", "snapshot_no, metric, group_a, group_b", "src")}, g AS (SELECT snapshot_no, metric, group_a, group_b, sum(CASE WHEN tname = group_a THEN rk ELSE 0 END) AS r1, count(*) FILTER (tname = group_a) AS n_a, count(*) FILTER (tname = group_b) AS n_b FROM ranked GROUP BY ALL),
h AS (SELECT *, r1 - n_a * (n_a + 1) / 2e0 AS u FROM g), k AS (SELECT *, 2e0 * u / (CAST(n_a AS DOUBLE) * n_b) - 1e0 AS d FROM h)
SELECT snapshot_no, metric, group_a, group_b, n_a, n_b, u, round(d, 4) AS cliff_delta, CASE WHEN abs(d) < 0.147e0 THEN 'negligible' WHEN abs(d) < 0.33e0 THEN 'small' WHEN abs(d) < 0.474e0 THEN 'medium' ELSE 'large' END AS magnitude FROM k"""

SQL = {
    "zone_policy_hot": f"WITH {_ONCE}, obs AS (SELECT snapshot_no, bvid, {_HEAD}, {_MEANS} FROM once WHERE zone_type = 'hot_zone' GROUP BY snapshot_no, bvid) SELECT snapshot_no, bvid, tname, prompt_version, danmaku_count, {_R} FROM obs",
    "zone_policy_weighted": f"WITH {_ONCE}, obs AS (SELECT snapshot_no, bvid, {_HEAD}, {_MEANS} FROM once GROUP BY snapshot_no, bvid) SELECT snapshot_no, bvid, tname, prompt_version, danmaku_count, {_R} FROM obs",
    "zone_policy_all": f"WITH {_ONCE}, obs AS (SELECT snapshot_no, bvid, zone_type, {_HEAD}, {_MEANS} FROM once GROUP BY snapshot_no, bvid, zone_type) SELECT snapshot_no, bvid, zone_type, tname, prompt_version, danmaku_count, {_R} FROM obs",
    "period_bucket": f"""SELECT DISTINCT pubdate, coalesce(strftime({_TS}, '%Y'), 'unknown') AS year, coalesce(strftime({_TS}, '%Y') || '-Q' || quarter({_TS}), 'unknown') AS quarter, coalesce(strftime({_TS}, '%Y-%m'), 'unknown') AS month FROM corpus_snapshots""",
    "corpus_group": f"WITH {_ALL} SELECT snapshot_no, tname, 'all' AS time_period, zone_type, count(*) AS video_count, CAST(sum(danmaku_count) AS BIGINT) AS total_danmaku, " + ", ".join(f"round(avg(coalesce({m}, 0)), 9) AS {m}_mean, round(coalesce(stddev_samp(coalesce({m}, 0)), 0), 9) AS {m}_std" for m in MEASURES) + " FROM obs GROUP BY snapshot_no, tname, zone_type",
    "small_groups": f"WITH {_ALL}, g AS (SELECT snapshot_no, tname, coalesce(strftime({_TS}, '%Y') || '-Q' || quarter({_TS}), 'unknown') AS time_period, zone_type, count(*) AS video_count FROM obs GROUP BY ALL) SELECT * FROM g WHERE video_count < 3",
    "descriptives": f"SELECT c_mktsegment, {_DESC.format('o_totalprice')} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "snapshot_descriptives": f"WITH {_ALL}, {_LONG.format('snapshot_no, bvid, tname').replace(_R, ', '.join(f'round({m} * 1e6) AS {m}' for m in MEASURES))} SELECT * REPLACE (round(mean, 3) AS mean, round(median, 3) AS median, round(std, 3) AS std, round(q25, 3) AS q25, round(q75, 3) AS q75) FROM (SELECT snapshot_no, tname, metric, {_DESC.format('value')} FROM long GROUP BY snapshot_no, tname, metric)",
    "average_ranks": f"WITH {_WEIGHTED}, src AS (SELECT snapshot_no, tname, danmaku_count AS value FROM obs WHERE tname IS NOT NULL), {_RANKS.format('snapshot_no, value', 'snapshot_no', 'src')} SELECT snapshot_no, tname AS grp, value, count(*) AS c, any_value(t) AS t, any_value(rk) AS rank FROM ranked GROUP BY snapshot_no, tname, value",
    "kruskal_wallis": f"""WITH {_WEIGHTED}, {_LONG.format("snapshot_no, bvid, tname")}, {_RANKS.format("snapshot_no, metric, value", "snapshot_no, metric", "long")}, per AS (SELECT snapshot_no, metric, tname, sum(rk) AS rs, count(*) AS m FROM ranked GROUP BY ALL),
g AS (SELECT snapshot_no, metric, count(*) AS k, CAST(sum(m) AS BIGINT) AS n, sum(rs * rs / m) AS q FROM per GROUP BY ALL), ti AS (SELECT snapshot_no, metric, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT DISTINCT snapshot_no, metric, value, t FROM ranked) GROUP BY ALL),
h AS (SELECT snapshot_no, metric, k, n, (12e0 / (n * (n + 1e0)) * q - 3e0 * (n + 1e0)) / (1e0 - ties / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM g JOIN ti USING (snapshot_no, metric)) SELECT snapshot_no, metric, k, n, round(h, 4) AS h, round(greatest(0e0, (h - k + 1e0) / (n - k)), 4) AS epsilon_squared FROM h WHERE k >= 2""",
    "mann_whitney": _PAIRS,
    "wilcoxon": f"""WITH {_ALL}, {_LONG.format("snapshot_no, bvid, zone_type")}, d AS (SELECT h.snapshot_no, h.metric, round(h.value - c.value, 9) AS d FROM long h JOIN long c ON h.snapshot_no = c.snapshot_no AND h.bvid = c.bvid AND h.metric = c.metric WHERE h.zone_type = 'hot_zone' AND c.zone_type = 'cold_zone'),
src AS (SELECT snapshot_no, metric, sign(d) AS s, abs(d) AS value FROM d WHERE d <> 0), {_RANKS.format("snapshot_no, metric, value", "snapshot_no, metric", "src")} SELECT snapshot_no, metric, n_pairs, CASE WHEN wp IS NULL AND wm IS NULL THEN n_pairs * n_pairs / 2e0 ELSE least(coalesce(wp, 0), coalesce(wm, 0)) END AS statistic FROM (SELECT snapshot_no, metric, count(*) AS n_pairs FROM d GROUP BY ALL)
LEFT JOIN (SELECT snapshot_no, metric, sum(rk) FILTER (s > 0) AS wp, sum(rk) FILTER (s < 0) AS wm FROM ranked GROUP BY ALL) USING (snapshot_no, metric)""",
    "sample_status": f"WITH {_WEIGHTED} SELECT snapshot_no, tname AS grp, count(*) AS n, CASE WHEN count(*) >= 30 THEN 'ok' ELSE 'insufficient_sample' END AS status FROM obs WHERE trim(tname) <> '' GROUP BY snapshot_no, tname",
    "index_upsert": "SELECT bvid, crawled_at, view_count FROM (SELECT bvid, crawled_at, coalesce(view_count, -1) AS view_count, row_number() OVER (PARTITION BY bvid ORDER BY crawled_at DESC, coalesce(view_count, -1) DESC) AS rn FROM videos) WHERE rn = 1",
    "index_as_of": "SELECT bvid, strftime(crawled_at, '%Y-%m-%dT%H:%M:%S') AS analyzed_at FROM videos WHERE strftime(crawled_at, '%Y-%m-%dT%H:%M:%S') <= '2023-02-01T00:00:00'",
    "partition_gaps": f"WITH {_NAMES} SELECT coalesce(tname, 'unknown') AS tname, count(*) AS have, CAST(3 AS BIGINT) AS min_required, greatest(3 - count(*), 0) AS missing FROM names GROUP BY 1",
    "candidates": f"""WITH {_NAMES}, n AS (SELECT bvid, count(*) AS danmaku_count FROM comments GROUP BY bvid), f AS (SELECT bvid, tname, danmaku_count FROM n JOIN names USING (bvid) WHERE bvid NOT IN (SELECT bvid FROM corpus_snapshots WHERE zone_type = 'hot_zone'))
SELECT bvid, tname, danmaku_count, pick FROM (SELECT *, row_number() OVER (PARTITION BY tname ORDER BY danmaku_count DESC, bvid) AS pick FROM f) WHERE pick <= 5""",
    "raw_union": """WITH u AS (SELECT bvid, content FROM comments UNION ALL SELECT json_extract_string(payload, '$.bvid'), json_extract_string(payload, '$.content') FROM (SELECT payload FROM raw_comments WHERE json_valid(payload)))
SELECT bvid, count(*) AS n, count(content) AS with_text FROM u GROUP BY bvid""",
    "work_left": "SELECT DISTINCT bvid FROM comments WHERE bvid NOT IN (SELECT bvid FROM videos)",
    "heatmap_long": f"WITH {_ALL}, g AS (SELECT snapshot_no, tname || '_' || zone_type AS key, " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in MEASURES) + " FROM obs GROUP BY 1, 2) UNPIVOT g ON " + ", ".join(MEASURES) + " INTO NAME metric VALUE value",
}
