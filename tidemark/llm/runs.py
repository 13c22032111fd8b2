"""Runs of the same or nearly the same event, collapsed (problem 6)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.copies import usable_comments
from tidemark.session import materialise, table

GAP_MS = 60_000
#: No predecessor.
NONE = np.iinfo(np.int64).min
MIN_EDIT = 8
SCHEMA = "part int, run_no bigint, id bigint, prev_id bigint, ent_a string, ent_b string, ms bigint, edge int, n string, raw string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

_REPEAT = re.compile(r"(\D{1,4}?)\1+")
_DIGITS = re.compile(r"(\d)\1{2,}")
_SPACE = re.compile(r"\s+")
_DIGIT = re.compile(r"\d")


def squash(s: str) -> str:
    """A piece of one to four non-digits directly repeated counts once (until nothing changes), three or more equal
    digits count as three."""
    while (t := _REPEAT.sub(r"\1", s)) != s:
        s = t
    return _DIGITS.sub(r"\1\1\1", s)


def one_edit(a: str, b: str) -> bool:
    """Equal, or apart by one character inserted, omitted or replaced, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) != len(b):
        return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < n and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def nearly_equal(na: str, nb: str, raw_a: str | None, raw_b: str | None) -> bool:
    """``na``, ``nb``: the normalised texts; ``raw_*``: the texts as stored, used when the normalised text is empty."""
    if not na or not nb:
        return not na and not nb and squash(_SPACE.sub("", raw_a or "")) == squash(_SPACE.sub("", raw_b or ""))
    if na == nb:
        return True
    a, b = squash(na), squash(nb)
    if a == b:
        return True
    return len(a) >= MIN_EDIT and len(b) >= MIN_EDIT and _DIGIT.findall(a) == _DIGIT.findall(b) and one_edit(a, b)


def _run_batches(same: Callable[[str, str, str | None, str | None], bool], gap_ms: int):
    """Over a slice of events sorted by entity and time: gather the run starts as a sorted array of positions, look every event up in it,
    and number it by its run; its predecessor is the event before it in the same run. The last event of a batch is held back and
    goes in front of the next. The first and the last event of the slice keep their texts, for the links across slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, base, before, first = TaskContext.get().partitionId(), None, 0, NONE, True

        def emit(t: pa.Table, number: np.ndarray, prev: np.ndarray, final: bool) -> pa.RecordBatch:
            m = len(number)
            edge = np.zeros(m, dtype=np.int32)
            edge[0] |= int(first)
            edge[m - 1] |= 2 * int(final)
            text = lambda c: pc.if_else(pa.array(edge > 0), t[c].combine_chunks(), pa.scalar(None, pa.string()))
            cols = [pa.array(np.full(m, part, dtype=np.int32)), pa.array(number.astype(np.int64)), t["id"], pa.array(prev, mask=prev == NONE), t["ent_a"], t["ent_b"], t["ms"], pa.array(edge), text("n"), text("raw")]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], COLUMNS)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
            col = {c: t[c].chunk(0) for c in t.column_names}
            ids, ms = col["id"].to_numpy(), col["ms"].to_numpy()
            m = len(ids)
            new = np.ones(m, dtype=bool)
            if m > 1:
                close = np.diff(ms) <= gap_ms
                for c in ("ent_a", "ent_b"):
                    close &= pc.equal(col[c].slice(1), col[c].slice(0, m - 1)).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(close)
                if len(at):
                    take = lambda c, i: col[c].take(pa.array(i)).to_pylist()
                    hits = [same(*x) for x in zip(take("n", at), take("n", at + 1), take("raw", at), take("raw", at + 1), strict=True)]
                    new[at[np.array(hits, dtype=bool)] + 1] = False
            starts = np.flatnonzero(new)  # the boundary positions, sorted
            nth = np.searchsorted(starts, np.arange(m), side="right") - 1
            prev = np.concatenate([[before], np.where(nth[1:] == nth[:-1], ids[:-1], NONE)])
            if m > 1:
                yield emit(t.slice(0, m - 1), base + nth[:-1], prev[:-1], False)
                first = False
            held, base, before = t.slice(m - 1, 1), base + int(nth[-1]), int(prev[-1])
        if held is not None:
            yield emit(held, np.array([base]), np.array([before]), True)

    return run


@dataclass
class Runs:
    """``members``: (``part``, ``run_no``, ``id``, ``prev_id``, ``ent_a``, ``ent_b``, ``ms``) of every event; ``links``: pairs of ids, and ``joined``: runs continued, across slices."""

    members: DataFrame
    links: list[tuple[int, int]]
    joined: dict[tuple[int, int], tuple[int, int]]


def run_members(events: DataFrame, same=nearly_equal, gap_ms: int = GAP_MS) -> Runs:
    """The runs of events (``id``, ``ent_a``, ``ent_b``, ``ms``, ``seq``, ``n``, ``raw``): two directly consecutive events of an entity belong to one if ``same``
    holds and they are at most ``gap_ms`` apart.

    Events are cut into slices of equal size by entity, time, ``seq`` (null first) and id, so an entity that holds a third of all events, even within one
    minute, is spread over a third of the slices. Only the two events at the ends of each slice come to the driver, where neighbouring
    slices are linked."""
    order = ["ent_a", "ent_b", "ms", F.col("seq").asc_nulls_first(), "id"]
    # written first: the slices' bounds come from a pass of their own over the events
    e = materialise(events.select("id", "ent_a", "ent_b", "ms", "seq", "n", "raw"), "run-events")
    m = e.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_run_batches(same, gap_ms), SCHEMA)
    m = materialise(m, "run-members")
    edges = sorted(m.where(F.col("edge") > 0).collect(), key=lambda r: (r.part, r.run_no, r.edge))
    links, joined = [], {}
    for x, y in zip(edges, edges[1:], strict=False):
        if x.part != y.part and (x.ent_a, x.ent_b) == (y.ent_a, y.ent_b) and y.ms - x.ms <= gap_ms and same(x.n, y.n, x.raw, y.raw):
            links.append((x.id, y.id))
            joined[y.part, y.run_no] = joined.get((x.part, x.run_no), (x.part, x.run_no))
    return Runs(m.drop("edge", "n", "raw"), links, joined)


def viewer_events(comments: DataFrame) -> DataFrame:
    """The comments that take part, copies dropped (the smallest id of a record stays). Null viewer, video, time or
    blank content: left out. Equal times are ordered by ``seq`` (null first), then id."""
    u = usable_comments(comments)
    raw = F.when(F.col("n") == "", F.col("content"))
    once = u.groupBy("digest", "bvid", "u", "n", "time_sec").agg(F.min(F.struct("dm_id", "seq", raw.alias("raw"))).alias("r"))
    return once.select(F.col("r.dm_id").alias("id"), F.col("bvid").alias("ent_a"), F.col("u").alias("ent_b"),
                       F.round(F.col("time_sec") * 1000).cast("long").alias("ms"), F.col("r.seq").alias("seq"), "n", F.col("r.raw").alias("raw"))


def collapse_runs(events: DataFrame, same=nearly_equal) -> DataFrame:
    """One row per run: (``ent_a``, ``ent_b``, ``first_id``, ``events``, ``start_ms``, ``duration_ms``). Runs are aggregated within their slices; those that go on in the
    next slice, at most one per slice, are put together."""
    r = run_members(events, same)
    spark = events.sparkSession
    joined = spark.createDataFrame([(*a, *b) for a, b in r.joined.items()], "part int, run_no bigint, _p int, _r bigint")
    pieces = r.members.groupBy("ent_a", "ent_b", "part", "run_no").agg(
        F.max(F.when(F.col("prev_id").isNull(), F.col("id"))).alias("first_id"), F.min("ms").alias("t0"), F.max("ms").alias("t1"), F.count("*").alias("k"))
    pieces = pieces.join(joined, ["part", "run_no"], "left").withColumn("first_id", F.when(F.col("_p").isNull(), F.col("first_id")))
    whole = pieces.groupBy("ent_a", "ent_b", F.coalesce("_p", "part").alias("part"), F.coalesce("_r", "run_no").alias("run_no")).agg(
        F.max("first_id").alias("first_id"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("k").alias("k"))
    return whole.select("ent_a", "ent_b", "first_id", F.col("k").alias("events"), F.col("t0").alias("start_ms"), (F.col("t1") - F.col("t0")).alias("duration_ms"))


def run_pairs(events: DataFrame, same=nearly_equal) -> DataFrame:
    """(``id_a``, ``id_b``; smaller first) of every two consecutive members of a run."""
    r = run_members(events, same)
    across = events.sparkSession.createDataFrame(r.links, "prev_id bigint, id bigint")
    pairs = r.members.where(F.col("prev_id").isNotNull()).select("prev_id", "id").unionByName(across)
    return pairs.select(F.least("id", "prev_id").alias("id_a"), F.greatest("id", "prev_id").alias("id_b"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return run_pairs(viewer_events(table(spark, sf, "comments"))).select(F.col("id_a").alias("dm_id_a"), F.col("id_b").alias("dm_id_b"))


def p6_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run of a viewer's comments in a video as one event."""
    r = collapse_runs(viewer_events(table(spark, sf, "comments")))
    return r.select(F.col("ent_a").alias("bvid"), F.col("ent_b").alias("uid"), F.col("first_id").alias("first_dm_id"), "events",
                    (F.col("start_ms") / 1000).alias("start_sec"), (F.col("duration_ms") / 1000).alias("duration_sec"))


QUERIES = {"p6_found": p6_found, "p6_runs": p6_runs}
SQL: dict[str, str] = {}
