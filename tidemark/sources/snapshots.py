"""Corpus snapshots: observations and archives read back, archives and state files written."""

from __future__ import annotations

import json
import os
import re
import zipfile
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.corpus import latest
from tidemark.operators.snapshots import MEASURES
from tidemark.settings import DEFAULT, Settings
from tidemark.sources import reports as R

# Names inside a snapshot archive, fields of its manifest and of the index.
VIDEOS_TABLE, MANIFEST, FOLDER = "corpus_videos.csv", "corpus_metadata.json", "videos/"
MANIFEST_FIELDS = {"generated_at": str, "pipeline_version": str, "zone_policy": str, "temporal_grouping": bool, "temporal_granularity": str, "video_count": int, "bvids": list, "prompt_versions": list, "warnings": list}
INDEX_FIELDS = ("bvid", "title", "tname", "pubdate", "danmaku_count", "pipeline_version", "prompt_version", "zip_path")
#: A log of progress is compacted beyond so many bytes.
COMPACT_BYTES = 512 * 1024


def _literal(path: str) -> str:
    """A path whose brackets and stars are no pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that exist, in order, each once; any file system that Hadoop knows."""
    fs, out = spark._jvm.org.apache.hadoop.fs, {}
    for p in paths:
        h = fs.Path(p)
        if p not in out and h.getFileSystem(spark._jsc.hadoopConfiguration()).exists(h):
            out[p] = None
    return list(out)


def archives(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``reports.zip_entries`` of a list of archives; missing ones are skipped, as an index may name them."""
    there = existing(spark, paths)
    return R.zip_entries(spark, [_literal(p) for p in there]) if there else spark.createDataFrame([], "path string, entry string, body string, error string")


def sources(entries: DataFrame) -> DataFrame:
    """(path, is_source, has_rows): an unreadable archive is no source; a readable one without usable metadata is a source without rows."""
    readable = entries.groupBy("path").agg((F.count("error") == 0).alias("is_source"))
    usable = R.metadata(entries).select("path").distinct().withColumn("_m", F.lit(True))
    return readable.join(usable, "path", "left").select("path", "is_source", (F.col("is_source") & F.coalesce("_m", F.lit(False))).alias("has_rows"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """The video table of a snapshot archive, or a CSV table itself, typed: bvid, tname, prompt_version, danmaku_count and the measures. Columns that it
    does not have are null; text that is no number is null. Without a ``bvid`` column this raises."""
    if path.endswith(".zip"):
        long = R.csv_rows(R.zip_entries(spark, _literal(path)), (VIDEOS_TABLE,))
        names = {r[0] for r in long.select("column").distinct().collect()}
        raw = long.groupBy("path", "row").pivot("column", sorted(names)).agg(F.first("value")) if names else None
    else:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(_literal(path))
        raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns})
        names = set(raw.columns)
    if "bvid" not in names:
        raise ValueError(f"no column bvid: {path}")
    kinds = {"bvid": "string", "tname": "string", "prompt_version": "string", "zone_type": "string", "danmaku_count": "long", **{m: "double" for m in MEASURES}}
    col = lambda c, k: (F.col(c) if k == "string" else F.col(c).try_cast("double").try_cast(k)) if c in names else F.lit(None).cast(k)
    return raw.select(*[col(c, k).alias(c) for c, k in kinds.items()]).where(F.col("bvid").isNotNull())


def snapshot_pair(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Two snapshots as deliveries 1 and 2, in the form that ``snapshot_changes`` compares."""
    one = lambda path, n: observations(spark, path).withColumns({"snapshot_no": F.lit(n), "delivered_at": F.lit(None).cast("timestamp")})
    return one(a, 1).unionByName(one(b, 2))


def manifest(observed: DataFrame, warnings: Sequence[str] = (), settings: Settings = DEFAULT, version: str = "") -> dict:
    """What an archive says about itself. The list of its videos is written with it, so an archive is made of a bounded selection."""
    bvids = [r[0] for r in observed.select("bvid").distinct().orderBy("bvid").collect()]
    kinds = [r[0] for r in observed.where(F.coalesce("prompt_version", F.lit("")) != "").select("prompt_version").distinct().orderBy("prompt_version").collect()]
    return {"generated_at": datetime.now().isoformat(timespec="seconds"), "pipeline_version": version, "zone_policy": settings.zone_policy, "temporal_grouping": settings.temporal_grouping,
            "temporal_granularity": settings.temporal_granularity, "video_count": len(bvids), "bvids": bvids, "prompt_versions": kinds, "warnings": list(warnings)}


def checked(m: dict) -> dict:
    """The manifest, if its fields are all there with their types and agree; else this raises."""
    bad = [k for k, t in MANIFEST_FIELDS.items() if not isinstance(m.get(k), t)]
    if bad or m["video_count"] != len(m["bvids"]):
        raise ValueError(f"manifest: {bad or 'video_count'}")
    return m


def pack_snapshot(folder: str, meta: dict, loose: Sequence[str], archives_: Sequence[str], extra: Sequence[str] = ()) -> tuple[str, bool]:
    """A self-contained archive (path, valid) of the manifest, loose files and, below ``videos/``, the source archives, of which the first of each base name
    is taken and missing ones are left out. Only if it verifies are the loose files removed; source archives always stay."""
    meta_path = os.path.join(folder, MANIFEST)
    with open(meta_path, "w", encoding="utf-8") as f:
        json.dump(checked(meta), f, ensure_ascii=False, indent=2)
    target = os.path.join(folder, f"[corpus]_{meta['video_count']}videos_{datetime.now():%Y%m%d_%H%M%S}.zip")
    files = [p for p in dict.fromkeys([*loose, meta_path, *extra]) if os.path.isfile(p)]
    inside = {p: os.path.basename(p) for p in files}
    named: dict[str, str] = {}
    for p in archives_:
        if os.path.isfile(p):
            named.setdefault(FOLDER + os.path.basename(p), p)
    try:
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p, name in [*inside.items(), *((p, n) for n, p in named.items())]:
                z.write(p, name)
        with zipfile.ZipFile(target) as z:
            valid = len(z.namelist()) == len(inside) + len(named) and z.testzip() is None
    except (OSError, zipfile.BadZipFile):
        return target, False
    if valid:
        for p in files:
            os.remove(p)
    return target, valid


def index_entries(meta: DataFrame) -> DataFrame:
    """Entries of the index, from archives' metadata (``reports.metadata``): eight fields, '' and 0 for what is missing."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    first = F.coalesce(F.nullif(F.col("tname"), F.lit("")), F.get("partitions", F.lit(0)), F.lit("")).alias("tname")
    return meta.select(text("bvid"), text("title"), first, text("pubdate"), F.coalesce("danmaku_count", F.lit(0)).cast("long").alias("danmaku_count"), text("pipeline_version"), text("prompt_version"), F.col("path").alias("zip_path"))


def save_index(index: DataFrame, path: str, version: str = "1") -> None:
    """The index as one JSON file, written beside and put in place at once. Rows are streamed, not gathered."""
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(f'{{"schema_version": {json.dumps(version)}, "videos": [')
        for n, r in enumerate(index.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            f.write((",\n" if n else "\n") + r.j)
        f.write("\n]}\n")
    os.replace(tmp, path)


def append_progress(path: str, **state) -> None:
    """One line of a progress log."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(state, ensure_ascii=False) + "\n")


def compact_progress(spark: SparkSession, path: str, key: str = "input", order: str = "updated_at", limit: int = COMPACT_BYTES) -> bool:
    """Rewrite a log that has grown beyond the limit to the latest line of each key; whether it did. Lines that are no JSON are lost."""
    if not os.path.isfile(path) or os.path.getsize(path) <= limit:
        return False
    rows = latest(R.json_lines(spark, path, R.TASK_SCHEMA), [key], [order])
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            f.write(r.j + "\n")
    os.replace(tmp, path)
    return True


def relative(path: str, base: str) -> str:
    """A path as stored in the index: relative to the index's folder where it lies below it."""
    full, root = os.path.abspath(path), os.path.abspath(base)
    return os.path.relpath(full, root) if os.path.commonpath([full, root]) == root else full


def absolute(stored: str, base: str) -> str:
    return stored if os.path.isabs(stored) else os.path.normpath(os.path.join(base, stored))
