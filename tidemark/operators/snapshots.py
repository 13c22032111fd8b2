"""Changes between consecutive full deliveries of a table (problem 3)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bitmap import BITS, SPAN, Container
from tidemark.operators.ordinals import assign_ordinals

MEASURES = (
    "avg_word_length", "content_word_density", "punctuation_emoji_rate", "high_consensus_rate",
    "medium_consensus_rate", "low_consensus_rate", "avg_weight_multiplier", "cooperative_principle_violation_rate",
)
TOLERANCE = 1e-9


def per_video(snapshots: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per (``snapshot_no``, ``bvid``): each (number, video, zone) counts once (the first
    delivered; ties by the values), counts are summed and measures averaged over zones where they are
    not null. NaN counts as null. Rows without number or video are dropped. Late rows belong to their number."""
    cols = ["tname", "prompt_version", "danmaku_count", *measures]
    rows = snapshots.where(F.col("snapshot_no").isNotNull() & F.col("bvid").isNotNull()).select(
        "snapshot_no", "bvid", "zone_type", "delivered_at", "tname", "prompt_version", "danmaku_count",
        *[F.when(~F.isnan(m), F.col(m).cast("double")).alias(m) for m in measures])
    once = rows.groupBy("snapshot_no", "bvid", "zone_type").agg(F.min(F.struct("delivered_at", *cols)).alias("r"))
    return once.groupBy("snapshot_no", "bvid").agg(
        F.min(F.struct(F.col("zone_type").isNull().alias("a"), "zone_type", "r.tname", "r.prompt_version")).alias("_f"),
        F.sum("r.danmaku_count").alias("danmaku_count"), *[F.avg(f"r.{m}").alias(m) for m in measures],
    ).select("snapshot_no", "bvid", F.col("_f.tname").alias("tname"), F.col("_f.prompt_version").alias("prompt_version"), "danmaku_count", *measures)


def _differs(field: str, a: pd.Series, b: pd.Series, texts: set[str]) -> np.ndarray:
    na, nb = a.isna().to_numpy(), b.isna().to_numpy()
    if field in texts:
        unequal = a.to_numpy(dtype=object) != b.to_numpy(dtype=object)
    elif field == "danmaku_count":
        unequal = a.fillna(0).to_numpy(dtype="int64") != b.fillna(0).to_numpy(dtype="int64")
    else:
        unequal = np.abs(a.to_numpy(dtype="float64", na_value=np.nan) - b.to_numpy(dtype="float64", na_value=np.nan)) > TOLERANCE
    return (na != nb) | (~na & ~nb & unequal)


def snapshot_changes(snapshots: DataFrame, measures: Sequence[str] = MEASURES, dictionary: DataFrame | None = None) -> DataFrame:
    """Compare every delivered snapshot with the next one delivered.

    Videos get persistent ordinals (``dictionary``: those of earlier deliveries, kept and extended).
    Ordinals are cut into spans of 4096; for each (later snapshot, span) the members of both sides form
    compressed bitmaps, whose AND-NOT gives removals and additions, and the fields, laid out by ordinal,
    are compared for the members of both. A task holds one span of two snapshots, never more; the
    list of snapshot numbers (one per delivery) is the only thing brought to the driver.

    Result: ``snapshot_no`` (the later one), ``bvid``, ``change_type`` (added, removed, changed), ``field``
    ('' unless changed), ``old_value``, ``new_value`` as text. Cases: no or one snapshot, empty result;
    gaps in the numbers are skipped over; repeated rows count once; a field null on one side only is changed,
    null on both is not; extra columns are ignored.
    """
    fields = ["tname", "prompt_version", "danmaku_count", *measures]
    texts = {"tname", "prompt_version"}
    rows = per_video(snapshots, measures)
    numbers = sorted(r[0] for r in snapshots.where(F.col("snapshot_no").isNotNull()).select("snapshot_no").distinct().collect())
    following = dict(zip(numbers, numbers[1:], strict=False))
    known = assign_ordinals(snapshots.select("snapshot_no", "bvid"), "bvid", ["snapshot_no"], dictionary)
    steps = F.create_map(*[F.lit(x) for kv in following.items() for x in kv]) if following else F.create_map().cast("map<int,int>")
    sides = F.array(
        F.struct(F.col("snapshot_no").cast("int").alias("later"), F.lit(True).alias("new")),
        F.struct(F.element_at(steps, F.col("snapshot_no")).cast("int").alias("later"), F.lit(False).alias("new")),
    )
    first = numbers[0] if numbers else 0
    paired = (
        rows.join(known, "bvid")
        .select("*", F.explode(sides).alias("s"))
        .where(F.col("s.later").isNotNull() & (F.col("s.later") != F.lit(first)))
        .select(F.col("s.later").alias("snapshot_no"), F.col("s.new").alias("new"), "bvid",
                F.shiftright("ordinal", BITS).alias("span"), F.col("ordinal").bitwiseAND(F.lit(SPAN - 1)).cast("int").alias("low"), *fields)
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        old, new = pdf[~pdf["new"]], pdf[pdf["new"]]
        a, b = Container(old["low"].to_numpy()), Container(new["low"].to_numpy())
        name = pd.Series(index=range(SPAN), dtype=object)
        name.loc[pdf["low"].to_numpy()] = pdf["bvid"].to_numpy()
        out = []

        def emit(members, kind, field, was, now):
            if len(members):
                out.append(pd.DataFrame({"bvid": name.loc[members].to_numpy(), "change_type": kind, "field": field, "old_value": was, "new_value": now}))

        emit(b.and_not(a), "added", "", None, None)
        emit(a.and_not(b), "removed", "", None, None)
        both = a.intersect(b)
        if len(both):
            x, y = old.set_index("low").loc[both], new.set_index("low").loc[both]
            for f in fields:
                d = _differs(f, x[f], y[f], texts)
                if d.any():
                    show = lambda s: [None if pd.isna(v) else str(int(v)) if f == "danmaku_count" else str(v) for v in s[d]]
                    emit(both[d], "changed", f, show(x[f]), show(y[f]))
        if not out:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("snapshot_no", "bvid", "change_type", "field", "old_value", "new_value")})
        res = pd.concat(out, ignore_index=True)
        res.insert(0, "snapshot_no", int(pdf["snapshot_no"].iloc[0]))
        return res

    return paired.groupBy("snapshot_no", "span").applyInPandas(
        compare, "snapshot_no int, bvid string, change_type string, field string, old_value string, new_value string"
    )
