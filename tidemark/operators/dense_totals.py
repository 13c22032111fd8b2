"""Per-key totals with evenly loaded tasks, however the keys are distributed (problem 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordinals import assign_ordinals
from tidemark.session import materialise

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS


def _split_totals(n_values: int, flush: int):
    """Over one input split: encode the keys in a local dictionary and add into dense arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        totals = np.zeros((n_values + 1, 1024), dtype=np.int64)

        def emit():
            n = len(codes)
            cols = [pa.array(list(codes), pa.string()), *[pa.array(totals[i, :n].copy()) for i in range(n_values + 1)]]
            return pa.RecordBatch.from_arrays(cols, ["key", *[f"t{i}" for i in range(n_values + 1)]])

        for b in batches:
            enc = b.column(0).dictionary_encode()
            words = enc.dictionary.to_pylist()
            local = np.array([codes.setdefault(w, len(codes)) for w in words] or [0], dtype=np.int64)
            while len(codes) > totals.shape[1]:
                totals = np.concatenate([totals, np.zeros_like(totals)], axis=1)
            at = local[enc.indices.to_numpy(zero_copy_only=False)] if len(enc) else np.zeros(0, np.int64)
            n = len(codes)
            totals[0, :n] += np.bincount(at, minlength=n)[:n]
            for i in range(n_values):
                v = b.column(i + 1).fill_null(0).to_numpy(zero_copy_only=False)
                np.add.at(totals[i + 1], at, v)
            if n >= flush:
                yield emit()
                codes.clear()
                totals[:] = 0
        if codes:
            yield emit()

    return run


def dense_totals(df: DataFrame, key: str, values: Sequence[str] = (), flush: int = 500_000) -> DataFrame:
    """Rows and sums of integer columns per non-null key: (``key`` STRING, ``n`` BIGINT, ``sum_<value>`` BIGINT...).

    1. Each input split (the scan's equal-sized file splits) encodes its keys in its own dictionary and adds into
       dense arrays by bincount / scatter-add, so a key that holds a third of all rows costs every split
       alike and leaves it as one number. At ``flush`` distinct keys the arrays are sent on and begun anew.
    2. Keys get global ordinals; the partial totals, at most one row per key and split, are cut into
       blocks of 4096 ordinals, and the blocks, as arrays, are summed in two levels: first over about the square
       root of the number of splits, then over those.
    No input row is shuffled; the partial totals, one row per key and split, are joined to the ordinals by key. Cases: null keys are left out, null values count as 0, an empty table gives no
    rows, extra columns are ignored.
    """
    k = len(values)
    cols = [F.col(key).cast("string").alias("key"), *[F.col(v).cast("long").alias(f"v{i}") for i, v in enumerate(values)]]
    names = [f"t{i}" for i in range(k + 1)]
    schema = "key string, " + ", ".join(f"{t} bigint" for t in names)
    src = df.where(F.col(key).isNotNull()).select(*cols)
    part = src.mapInArrow(_split_totals(k, flush), schema).withColumn("split", F.spark_partition_id())
    part = materialise(part, "split-totals")
    ordinals = assign_ordinals(part.select("key"), "key")
    lanes = max(1, math.isqrt(part.select("split").distinct().count()))
    coded = part.join(ordinals, "key").select(
        F.shiftright("ordinal", BLOCK_BITS).alias("block"), F.col("ordinal").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("low"),
        (F.col("split") % lanes).alias("lane"), *names)

    def to_block(g: pd.DataFrame) -> pd.DataFrame:
        at = g["low"].to_numpy()
        sums = []
        for t in names:
            s = np.zeros(BLOCK, dtype=np.int64)
            np.add.at(s, at, g[t].to_numpy())
            sums.append(s)
        return pd.DataFrame({"block": [g["block"].iloc[0]], **{t: [s] for t, s in zip(names, sums, strict=True)}})

    def add_blocks(g: pd.DataFrame) -> pd.DataFrame:
        block = int(g["block"].iloc[0])
        sums = {t: np.sum(np.stack(g[t].to_numpy()), axis=0) for t in names}
        used = np.flatnonzero(sums["t0"])
        return pd.DataFrame({"ordinal": block * BLOCK + used, **{t: s[used] for t, s in sums.items()}})

    arrays = "block bigint, " + ", ".join(f"{t} array<bigint>" for t in names)
    blocks = coded.groupBy("block", "lane").applyInPandas(to_block, arrays)
    dense = blocks.groupBy("block").applyInPandas(add_blocks, "ordinal bigint, " + ", ".join(f"{t} bigint" for t in names))
    return dense.join(ordinals, "ordinal").select(
        "key", F.col("t0").alias("n"), *[F.col(f"t{i + 1}").alias(f"sum_{v}") for i, v in enumerate(values)])
