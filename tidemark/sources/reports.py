"""Report archives, snapshots and state files as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "metadata.json"
RAW_TABLE = "danmaku_raw.csv"
# The tables of an archive that are read back.
TABLES = ("table_lexical_by_partition.csv", "table_sentence_function.csv", "table_emotion.csv", "table_interaction_type.csv", "table_consensus_stats.csv")
#: Columns of those tables that are no measures.
NO_MEASURES = ("tname", "zone_type", "danmaku_count", "video_count", "ci_lower", "ci_upper", "ci_status", "n_records")
META_SCHEMA = "bvid STRING, title STRING, tname STRING, partitions ARRAY<STRING>, pubdate STRING, prompt_version STRING, pipeline_version STRING, danmaku_count BIGINT, generated_at STRING"


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, i.filename, z.read(i).decode("utf-8-sig", "replace"), None) for i in z.infolist() if not i.is_dir()]
            except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError) as e:
                rows.append((path, None, None, str(e)[:200]))
        yield pd.DataFrame(rows, columns=["path", "entry", "body", "error"])


def zip_entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, entry, body, error) of every file in the archives; an unreadable archive is one row with its error."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_entries, "path string, entry string, body string, error string")


def valid_archives(entries: DataFrame, expected: int | None = None) -> DataFrame:
    """(path, ok): readable, not empty and, if given, with so many entries."""
    n = F.count("entry")
    ok = (F.count("error") == 0) & (n > 0)
    return entries.groupBy("path").agg((ok & (n == expected) if expected is not None else ok).alias("ok"))


def metadata(entries: DataFrame) -> DataFrame:
    """One row per archive with metadata; the category falls back to the first of its partitions. Archives without either are no source of rows."""
    m = entries.where(F.col("entry") == METADATA).select("path", F.from_json("body", META_SCHEMA).alias("m")).select("path", "m.*")
    name = F.coalesce(F.nullif(F.col("tname"), F.lit("")), F.get("partitions", F.lit(0)))
    return m.withColumn("tname", name).where(F.col("tname").isNotNull())


def csv_rows(entries: DataFrame, names: tuple[str, ...] = TABLES) -> DataFrame:
    """Rows of the archives' tables in long form: (path, entry, row, column, value)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, entry, body in zip(b["path"], b["entry"], b["body"], strict=True):
                try:
                    t = pd.read_csv(io.StringIO(body), dtype=str, keep_default_na=False)
                except (pd.errors.ParserError, pd.errors.EmptyDataError):
                    continue
                for i, r in enumerate(t.to_dict("records")):
                    out += [(path, entry, i, k, v or None) for k, v in r.items()]
            yield pd.DataFrame(out, columns=["path", "entry", "row", "column", "value"])

    return entries.where(F.col("entry").isin(*names)).select("path", "entry", "body").mapInPandas(parse, "path string, entry string, row int, column string, value string")


def zone_measures(entries: DataFrame) -> DataFrame:
    """(path, zone_type, danmaku_count, column, value) of the archives' tables. A column of an archive with any text that is no number is left out whole."""
    long = csv_rows(entries)
    ids = long.groupBy("path", "entry", "row").agg(F.max(F.when(F.col("column") == "zone_type", F.col("value"))).alias("zone_type"),
                                                   F.max(F.when(F.col("column") == "danmaku_count", F.col("value").try_cast("double"))).alias("danmaku_count"))
    num = F.col("value").try_cast("double")
    bad = long.where(F.col("value").isNotNull() & num.isNull() & ~F.col("column").isin(*NO_MEASURES)).select("path", "column").distinct()
    v = long.where(~F.col("column").isin(*NO_MEASURES)).join(bad, ["path", "column"], "left_anti")
    return v.join(ids, ["path", "entry", "row"]).where(F.col("zone_type").isNotNull()).select("path", "zone_type", F.coalesce("danmaku_count", F.lit(0.0)).alias("danmaku_count"), "column", num.alias("value"))


def raw_comments(entries: DataFrame) -> DataFrame:
    """Comments of all archives with their video: (bvid, uid_hash, content, time_sec, identity_type)."""
    long = csv_rows(entries, (RAW_TABLE,))
    cols = ["uid_hash", "content", "time_sec", "identity_type"]
    wide = long.groupBy("path", "row").pivot("column", cols).agg(F.first("value"))
    return wide.join(metadata(entries).select("path", "bvid"), "path").select("bvid", "uid_hash", "content", F.col("time_sec").try_cast("double").alias("time_sec"), "identity_type")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state log; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


TASK_SCHEMA = "input STRING, status STRING, bvid STRING, zip_path STRING, error STRING, updated_at STRING"


def task_states(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each task; those that were running are pending again."""
    from tidemark.operators.corpus import latest

    t = latest(json_lines(spark, path, TASK_SCHEMA), ["input"], ["updated_at"])
    return t.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


INDEX_SCHEMA = "schema_version STRING, videos ARRAY<STRUCT<bvid:STRING,title:STRING,tname:STRING,pubdate:STRING,danmaku_count:BIGINT,pipeline_version:STRING,prompt_version:STRING,zip_path:STRING,analyzed_at:STRING>>"


def corpus_index(spark: SparkSession, path: str) -> DataFrame:
    """The index file as a table; missing, broken or empty files give an empty one."""
    import os

    empty = spark.createDataFrame([], INDEX_SCHEMA).select(F.inline("videos"))
    if "://" not in path and not os.path.exists(path):
        return empty
    return spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(path).where(F.col("videos").isNotNull()).select(F.inline("videos"))


def lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """(word, freq, pos) of all lines 'word freq pos' in the folder's text files; freq and pos may be missing."""
    p = F.split(F.trim("value"), "\\s+")
    return spark.read.text(folder, pathGlobFilter="*.txt").where(F.trim("value") != "").select(p[0].alias("word"), F.get(p, F.lit(1)).try_cast("long").alias("freq"), F.get(p, F.lit(2)).alias("pos"))


def fresh(spark: SparkSession, path: str, hours: float = 12.0) -> DataFrame:
    """Rows of the parquet files below a staging path that are younger than a time to live."""
    age = F.current_timestamp() - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    return spark.read.parquet(path).where(F.col("_metadata.file_modification_time") >= age)
