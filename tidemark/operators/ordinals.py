"""Persistent ordinals: a dense 0..n-1 numbering of keys that later deliveries only extend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

_LOCAL = (1 << 33) - 1


def _lookup(values: dict[int, int], at: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), at) if pairs else F.lit(0)


def assign_ordinals(keys: DataFrame, key: str, order: list[str] = (), known: DataFrame | None = None) -> DataFrame:
    """Number the distinct non-null values of ``key``.

    ``order``: columns that decide the numbering (their minimum per key comes first, then the key).
    ``known``: a dictionary (key, ``ordinal``) from an earlier call; its keys keep their ordinals and
    new keys are appended behind its largest.

    The keys are range-partitioned and numbered inside each partition; the only thing brought to the
    driver is one count per partition, from which the offsets follow. No single-partition sort.
    Result: (key, ``ordinal`` BIGINT), written once to the shared folder. Empty input: empty result.
    """
    firsts = [F.min(c).alias(f"_o{i}") for i, c in enumerate(order)]
    d = keys.where(F.col(key).isNotNull()).groupBy(key).agg(*(firsts or [F.lit(0).alias("_o0")]))
    start = 0
    if known is not None:
        d = d.join(known.select(key), key, "left_anti")
        start = (known.agg(F.max("ordinal")).first()[0] or -1) + 1 if known.take(1) else 0
    by = [f"_o{i}" for i in range(len(order))] + [key]
    d = d.repartitionByRange(*by).sortWithinPartitions(*by)
    d = materialise(d.select(key, F.monotonically_increasing_id().alias("_m")), "ordinals")
    part = F.shiftright("_m", 33).cast("int")
    counts = {r["p"]: r["n"] for r in d.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, at = {}, start
    for p in sorted(counts):
        offsets[p] = at
        at += counts[p]
    out = d.select(key, (_lookup(offsets, part) + F.col("_m").bitwiseAND(F.lit(_LOCAL))).cast("long").alias("ordinal"))
    return out if known is None else known.select(key, "ordinal").unionByName(out)
