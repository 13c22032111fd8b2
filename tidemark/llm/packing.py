"""Texts packed into containers of a fixed capacity in tokens (problem 8)."""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialise, table

CAPACITY = 2048
#: Permitted container sizes; the largest is the capacity.
SIZES = (256, 512, 1024, 2048)
#: Cost of a container besides its size, in tokens.
OVERHEAD = 16
#: Vocabulary file of a public tokenizer (a sentencepiece model).
VOCABULARY = os.environ.get("TIDEMARK_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _shipped(path: str) -> str:
    """Where the file lies on this machine: the copy that came with the job, else the path itself."""
    copy = SparkFiles.get(os.path.basename(path))
    return copy if os.path.isfile(copy) else path


def token_counts(texts: Sequence[str | None], path: str = VOCABULARY) -> list[int]:
    distinct = list({t for t in texts if t})
    sizes = dict(zip(distinct, map(len, _tokenizer(path).encode(distinct, num_threads=1)), strict=True)) if distinct else {}
    return [sizes[t] if t else 0 for t in texts]


@dataclass
class Kind:
    """``bins`` containers with the same contents: ``parts`` lists (length, items of it in each container)."""

    size: int
    bins: int
    free: int
    parts: tuple[tuple[int, int], ...]


def plan(histogram: dict[int, int], sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> list[Kind]:
    """Best-fit decreasing over a histogram of lengths (at most ``capacity`` entries, however many items there are).

    Longest first, each item goes where it leaves the least space. If it fits nowhere, a container of the permitted size is
    opened for which a token costs least, counting the space that the shorter items still to come can fill. At the end
    each container is taken down to the smallest permitted size that holds its contents.
    """
    sizes = sorted(sizes)
    lengths = sorted((x for x, n in histogram.items() if x > 0 and n > 0), reverse=True)
    if lengths and lengths[0] > sizes[-1]:
        raise ValueError("items longer than the capacity must be split first")
    mass = np.zeros(sizes[-1] + 2, dtype=np.float64)
    for x in lengths:
        mass[x] = x * histogram[x]
    below = np.cumsum(mass)  # tokens still to come in items of at most so many
    free: dict[int, list[Kind]] = {}
    levels: list[int] = []
    done: list[Kind] = []

    def put(k: Kind) -> None:
        if not k.bins:
            return
        if k.free == 0:
            done.append(k)
            return
        if not free.get(k.free):
            free[k.free] = []
            insort(levels, k.free)
        free[k.free].append(k)

    for x in lengths:
        n = histogram[x]
        below[x:] -= x * n
        while n:
            at = bisect_left(levels, x)
            if at < len(levels):
                level = levels[at]
                k = free[level].pop()
                if not free[level]:
                    levels.pop(at)
            else:
                best = None
                for size in sizes:
                    if size < x:
                        continue
                    each = size // x
                    bins = max(1, n // each)
                    rest = size - each * x
                    fill = min(rest, below[rest] / bins)
                    cost = (size + overhead) / (each * x + fill)
                    if n < each:  # the last few: what else comes must fill the rest
                        rest = size - n * x
                        cost = (size + overhead) / (n * x + min(rest, below[min(rest, x)]))
                    if best is None or cost <= best[0]:
                        best = (cost, size, bins)
                k = Kind(best[1], best[2], best[1], ())
            each = k.free // x
            full = min(k.bins, n // each)
            if full:
                put(Kind(k.size, full, k.free - each * x, (*k.parts, (x, each))))
                n -= full * each
            left = k.bins - full
            if left and n and n < each:
                put(Kind(k.size, 1, k.free - n * x, (*k.parts, (x, n))))
                n, left = 0, left - 1
            if left and k.parts:
                put(Kind(k.size, left, k.free, k.parts))
    kinds = done + [k for ks in free.values() for k in ks]
    out = []
    for k in kinds:
        used = k.size - k.free
        size = next(s for s in sizes if s >= used)
        out.append(Kind(size, k.bins, size - used, k.parts))
    return out


def places(kinds: list[Kind]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: the ranks at which its containers change kind, and each kind's first container, items per container and size."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for k in kinds:
        for x, each in k.parts:
            rows.setdefault(x, []).append((taken.get(x, 0), first, each, k.size))
            taken[x] = taken.get(x, 0) + each * k.bins
        first += k.bins
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def _measure(capacity: int, vocabulary: str):
    """Pieces of each text with their sizes; ``nth`` numbers the pieces of one size within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, path = TaskContext.get().partitionId(), _shipped(vocabulary)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, n in zip(b.column(0).to_pylist(), token_counts(b.column(1).to_pylist(), path), strict=True):
                for piece, start in enumerate(range(0, max(n, 1), capacity)):
                    size = min(capacity, n - start)
                    for c, v in zip(cols, (i, piece, start, size, int(seen[size])), strict=True):
                        c.append(v)
                    seen[size] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(cols[0]), pa.int32())], ["id", "piece", "start", "tokens", "nth", "task"])

    return run


def pack(docs: DataFrame, doc_id: str, text: str, sizes: Sequence[int] = SIZES, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``doc_id``, ``piece``, ``start_token``, ``tokens``, ``container_id``, ``container_size``) of every document or piece of one.

    Texts longer than the capacity are split into pieces that fill it and a rest; others stay whole. Sizes are measured once
    and written to the shared folder. Only the histogram of sizes, at most ``capacity`` numbers, goes to the driver, where the
    whole collection is packed by ``plan``. Then each piece finds its container from its rank among the pieces of
    its size, which follows from counts per task: no row is sorted or gathered by size, so a size that a third of all
    pieces share is no burden. A null or empty text has 0 tokens and a null container. Repeated rows are packed each.
    """
    capacity = max(sizes)
    docs.sparkSession.sparkContext.addFile(vocabulary)  # executors need no copy of their own
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "id bigint, piece int, start bigint, tokens int, nth bigint, task int"
    pieces = materialise(src.mapInArrow(_measure(capacity, vocabulary), schema), "pieces")
    counts = pieces.groupBy("task", "tokens").agg(F.count("*").alias("n"))
    histogram = {r["tokens"]: r["n"] for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, sizes))
    before = W.partitionBy("tokens").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("task", "tokens", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["task", "tokens"]).select("id", "piece", "start", "tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            box = np.full(len(tokens), -1, dtype=np.int64)
            size = np.zeros(len(tokens), dtype=np.int32)
            for x in np.unique(tokens):
                if x:
                    begin, first, each, room = where[int(x)]
                    at = np.flatnonzero(tokens == x)
                    k = np.searchsorted(begin, rank[at], side="right") - 1
                    box[at] = first[k] + (rank[at] - begin[k]) // each[k]
                    size[at] = room[k]
            none = box < 0
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(box, mask=none), pa.array(size, mask=none)],
                ["doc_id", "piece", "start_token", "tokens", "container_id", "container_size"])

    return ranked.mapInArrow(assign, "doc_id bigint, piece int, start_token bigint, tokens int, container_id bigint, container_size int")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), "doc_id", "text")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and unused share per container size."""
    p = p8_containers(spark, sf).where(F.col("container_id").isNotNull())
    boxes = p.groupBy("container_id", "container_size").agg(F.sum("tokens").alias("used"))
    return boxes.groupBy("container_size").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), (1 - F.sum("used") / F.sum("container_size")).alias("unused_share"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
