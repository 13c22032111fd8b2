"""Timelines cut into segments by density, and hot and cold zones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.settings import DEFAULT, Settings

BUCKET_S = 60.0
#: Input numbers of rows of one time that are ranked in one task.
SEQ_BLOCK = 4096
#: Seconds made from one row at once.
SPAN_S = 1 << 16


def timeline_rank(comments: DataFrame) -> DataFrame:
    """Adds ``idx``, the 0-based place of a row in its video by (time_sec, anonymous last, seq, dm_id).

    Rows are ranked within cells of one time, one kind of identity and ``SEQ_BLOCK`` input numbers, and shifted by the counts of the cells before in
    their minute and of the minutes before in their video. So neither a video with very many rows nor a minute of them (as rows without a
    time make one, at 0) meets in one task; what a window sees of them is counts."""
    block = F.coalesce(F.floor(F.col("seq") / SEQ_BLOCK), F.lit(-1))
    c = comments.withColumns({"_b": F.floor(F.col("time_sec") / BUCKET_S), "_anon": F.col("identity_type") == "unknown_device", "_block": block})
    cell = ["bvid", "_b", "time_sec", "_anon", "_block"]
    cells = c.groupBy(*cell).agg(F.count("*").alias("_n"))
    sums = lambda by, *order: F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    minutes = cells.groupBy("bvid", "_b").agg(F.sum("_n").alias("_n")).select("bvid", "_b", sums(["bvid"], "_b").alias("_minute"))
    before = cells.withColumn("_cell", sums(["bvid", "_b"], "time_sec", "_anon", "_block")).join(minutes, ["bvid", "_b"]).select(*cell, (F.col("_minute") + F.col("_cell")).alias("_before"))
    within = W.partitionBy(*cell).orderBy("seq", "dm_id")
    ranked = c.withColumn("_r", F.row_number().over(within)).join(before, cell)
    return ranked.withColumn("idx", F.col("_before") + F.col("_r") - 1).drop("_b", "_anon", "_block", "_r", "_before")


def fixed_segments(comments: DataFrame, step: int = DEFAULT.fixed_step) -> DataFrame:
    """Adds ``segment_id``: every ``step`` rows of a video's timeline; the last segment may be short."""
    return timeline_rank(comments).withColumn("segment_id", F.floor(F.col("idx") / step).cast("int"))


def segment_bounds(members: DataFrame) -> DataFrame:
    """(bvid, segment_id, start_time, end_time, n, density): density is rows per second, 0 for no duration."""
    g = members.groupBy("bvid", "segment_id").agg(F.min("time_sec").alias("start_time"), F.max("time_sec").alias("end_time"), F.count("*").alias("n"))
    d = F.col("end_time") - F.col("start_time")
    return g.withColumn("density", F.when(d > 0, F.col("n") / d).otherwise(F.lit(0.0)))


def label_zones(segments: DataFrame) -> DataFrame:
    """Adds ``zone_type``: hot above mean + 1.5 x median absolute deviation of the video's densities; a single segment is cold."""
    w = W.partitionBy("bvid")
    s = segments.select("*", F.avg("density").over(w).alias("_m"), F.median("density").over(w).alias("_d"), F.count("*").over(w).alias("_k"))
    s = s.withColumn("_mad", F.median(F.abs(F.col("density") - F.col("_d"))).over(w))
    hot = (F.col("_k") > 1) & (F.col("density") > F.col("_m") + 1.5 * F.col("_mad"))
    return s.withColumn("zone_type", F.when(hot, "hot_zone").otherwise("cold_zone")).drop("_m", "_d", "_k", "_mad")


def _bins(comments: DataFrame) -> DataFrame:
    """(bvid, bin, n, t0, t1): one-second bins from the video's first time on. Rows are first reduced to distinct times."""
    times = comments.groupBy("bvid", "time_sec").agg(F.count("*").alias("n"))
    start = F.min("time_sec").over(W.partitionBy("bvid"))
    b = times.withColumn("bin", F.floor(F.round(F.col("time_sec") - start, 3)).cast("long"))
    return b.groupBy("bvid", "bin").agg(F.sum("n").alias("n"), F.min("time_sec").alias("t0"), F.max("time_sec").alias("t1"))


def density_signal(comments: DataFrame) -> DataFrame:
    """(bvid, bin, n): rows per second from the first row on, empty seconds included."""
    b = _bins(comments)
    # in two steps, so that no array grows with a late time
    spans = b.groupBy("bvid").agg(F.max("bin").alias("m")).select("bvid", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / SPAN_S))).alias("s"))
    first = F.col("s") * SPAN_S
    every = spans.select("bvid", F.explode(F.sequence(first, F.least(first + SPAN_S - 1, F.col("m")))).alias("bin"))
    return every.join(b.select("bvid", "bin", "n"), ["bvid", "bin"], "left").select("bvid", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def change_points(signal: np.ndarray, penalty: float = 1.0) -> list[int]:
    """Starts of new segments: the exact optimum of squared error plus a penalty per change, by pruned dynamic programming.
    Inside a run of equal values the error is a concave function of where a change lies, so changes are only sought at the
    ends of runs, of which a sparse signal has few. Signals of fewer than three values have none; of equal optima the earliest last start is taken."""
    x = np.asarray(signal, dtype=float)
    at = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1]) if len(x) else np.zeros(0, dtype=np.int64)
    return change_points_of_runs(x[at], np.diff(np.append(at, len(x))), penalty)


def change_points_of_runs(value: np.ndarray, length: np.ndarray, penalty: float = 1.0) -> list[int]:
    """``change_points`` of a signal given as runs of equal values, neighbouring runs unequal; its length costs nothing."""
    if length.sum() < 3:
        return []
    ends = np.concatenate([[0], np.cumsum(length)])
    s1 = np.concatenate([[0.0], np.cumsum(value * length)])
    s2 = np.concatenate([[0.0], np.cumsum(value**2 * length)])
    m = len(length)
    best = np.empty(m + 1)
    best[0] = -penalty
    last = np.zeros(m + 1, dtype=np.int64)
    cand = np.array([0])
    for t in range(1, m + 1):
        cost = best[cand] + (s2[t] - s2[cand]) - (s1[t] - s1[cand]) ** 2 / (ends[t] - ends[cand])
        k = int(np.argmin(cost))
        best[t], last[t] = cost[k] + penalty, cand[k]
        cand = np.append(cand[cost <= best[t] + 1e-9], t)
    out, t = [], m
    while t > 0:
        t = int(last[t])
        if t:
            out.append(int(ends[t]))
    return out[::-1]


def _merge(parts: list[list], least: int) -> list[list]:
    """Too small segments join the one before; a too small first one takes in what follows. Each: [bins.., n, t0, t1]."""
    merged: list[list] = []
    for p in parts:
        if p[1] < least and merged:
            merged[-1] = [merged[-1][0], merged[-1][1] + p[1], merged[-1][2], p[3]]
        else:
            merged.append(list(p))
    while len(merged) > 1 and merged[0][1] < least:
        a, b = merged[0], merged[1]
        merged = [[a[0], a[1] + b[1], a[2], b[3]], *merged[2:]]
    return merged


def dynamic_segments(comments: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(bvid, segment_id, first_bin, start_time, end_time, n, density, zone_type) by change points of the density signal, small segments
    merged. A task holds one video's occupied seconds, never its rows."""
    penalty, least = settings.pelt_penalty, settings.min_segment_samples

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bin")
        at, n = g["bin"].to_numpy(), g["n"].to_numpy()
        # runs of the signal: occupied seconds and the gaps between them
        gaps = np.diff(np.append(at, at[-1] + 1)) - 1
        value = np.stack([n, np.zeros(len(n))], axis=1).ravel()
        length = np.stack([np.ones(len(n), dtype=np.int64), gaps], axis=1).ravel()
        value, length = value[length > 0], length[length > 0]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        starts = np.array([0, *change_points_of_runs(value[first], np.add.reduceat(length, first), penalty)])
        seg = np.searchsorted(starts, at, side="right") - 1
        parts = [[int(starts[k]), int(n[seg == k].sum()), float(g["t0"].to_numpy()[seg == k].min()), float(g["t1"].to_numpy()[seg == k].max())] for k in np.unique(seg)]
        merged = _merge(parts, least)
        out = pd.DataFrame(merged, columns=["first_bin", "n", "start_time", "end_time"])
        out.insert(0, "segment_id", range(len(out)))
        out.insert(0, "bvid", g["bvid"].iloc[0])
        return out

    # the signals are small but costly: a fixed number of partitions keeps adaptive execution from packing them into one task
    spark = comments.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    s = _bins(comments).repartition(tasks, "bvid").groupBy("bvid").applyInPandas(cut, "bvid string, segment_id int, first_bin long, n long, start_time double, end_time double")
    d = F.col("end_time") - F.col("start_time")
    return label_zones(s.withColumn("density", F.when(d > 0, F.col("n") / d).otherwise(F.lit(0.0))))


def merge_small(segments: DataFrame, least: int = DEFAULT.min_segment_samples) -> DataFrame:
    """Merge segments (bvid, segment_id, n, start_time, end_time) that are too small, by two folds over each video's list."""
    arr = segments.groupBy("bvid").agg(F.array_sort(F.collect_list(F.struct("segment_id", "n", "start_time", "end_time"))).alias("a"))
    part = lambda x: F.struct(x.n.cast("long").alias("n"), x.start_time.alias("start_time"), x.end_time.alias("end_time"))
    kind = "array<struct<n:bigint,start_time:double,end_time:double>>"
    join = lambda p, q: F.array(F.struct((p.n + q.n).alias("n"), p.start_time.alias("start_time"), q.end_time.alias("end_time")))
    empty = F.from_json(F.lit("[]"), kind)
    first = F.aggregate("a", empty, lambda acc, x: F.when((x.n < least) & (F.size(acc) > 0), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), join(F.element_at(acc, -1), x))).otherwise(F.concat(acc, F.array(part(x)))))
    second = lambda col: F.aggregate(col, empty, lambda acc, x: F.when((F.size(acc) == 1) & (F.get(acc, F.lit(0)).n < least), join(F.get(acc, F.lit(0)), x)).otherwise(F.concat(acc, F.array(part(x)))))
    m = arr.select("bvid", first.alias("m")).select("bvid", second(F.col("m")).alias("m"))
    return m.select("bvid", F.posexplode("m").alias("segment_id", "x")).select("bvid", "segment_id", "x.n", "x.start_time", "x.end_time")
