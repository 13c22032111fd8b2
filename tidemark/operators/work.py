"""What is left of a list of work: finished, reusable, to be done again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import parse_input
from tidemark.operators.corpus import latest


def resolved(items: DataFrame, mapping: DataFrame | None = None, column: str = "input") -> DataFrame:
    """Adds ``bvid`` and ``input_type`` of each reference. Numbers and short links have no id of their own: they are looked up in ``mapping`` (ref, bvid),
    where ref is 'av<number>' or the link as given; what is not there stays null."""
    p = parse_input(F.col(column))
    d = items.withColumns({"input_type": p["input_type"], "_own": p["bvid"], "_ref": F.coalesce(F.concat(F.lit("av"), p["avid"]), F.trim(F.col(column)))})
    if mapping is None:
        return d.withColumn("bvid", F.col("_own")).drop("_own", "_ref")
    m = mapping.groupBy(F.col("ref").alias("_ref")).agg(F.min("bvid").alias("_mapped"))
    return d.join(m, "_ref", "left").withColumn("bvid", F.coalesce("_own", "_mapped")).drop("_own", "_ref", "_mapped")


def reusable(index: DataFrame, files: DataFrame, prompt_version: str | None = None) -> DataFrame:
    """(bvid, zip_path): the latest analysed entry of each video whose archive exists (``files``: path) and, if given, was made with this version of the prompts."""
    e = index.where(F.col("bvid").isNotNull() & F.col("zip_path").isNotNull())
    if prompt_version is not None:
        e = e.where(F.col("prompt_version") == prompt_version)
    there = e.join(files.select(F.col("path").alias("zip_path")).distinct(), "zip_path", "left_semi")
    return latest(there.select("bvid", F.coalesce("analyzed_at", F.lit("")).alias("analyzed_at"), "zip_path"), ["bvid"], ["analyzed_at"]).select("bvid", "zip_path")


def restored(states: DataFrame, files: DataFrame) -> DataFrame:
    """States of tasks after a stop: what was running is pending again, and so is what is done but whose archive is gone."""
    f = files.select(F.col("path").alias("zip_path")).distinct().withColumn("_there", F.lit(True))
    d = states.join(f, "zip_path", "left")
    lost = (F.col("status") == "running") | ((F.col("status") == "done") & F.col("_there").isNull())
    return d.withColumn("status", F.when(lost, "pending").otherwise(F.col("status"))).drop("_there")


def decisions(items: DataFrame, states: DataFrame, index: DataFrame, files: DataFrame, reuse: bool = True, resume: bool = True, mapping: DataFrame | None = None) -> DataFrame:
    """(``input``, ``bvid``, ``decision``, ``zip_path``) of every distinct item: 'resumed' if it, or its video, is done and the archive is there; 'reused' if the
    index has a usable archive of the video; 'analyse'; 'unresolved' without an id. One join per source, no loop over items."""
    d = resolved(items.select("input").where(F.col("input").isNotNull()).distinct(), mapping)
    done = restored(states, files).where("status = 'done'")
    by_input = done.groupBy("input").agg(F.max("zip_path").alias("_by_input"))
    by_video = done.where(F.col("bvid").isNotNull()).groupBy("bvid").agg(F.max("zip_path").alias("_by_video"))
    d = d.join(by_input, "input", "left").join(by_video, "bvid", "left").join(reusable(index, files).withColumnRenamed("zip_path", "_index"), "bvid", "left")
    again = F.coalesce("_by_input", "_by_video") if resume else F.lit(None).cast("string")
    other = F.col("_index") if reuse else F.lit(None).cast("string")
    decision = F.when(again.isNotNull(), "resumed").when(F.col("bvid").isNull(), "unresolved").when(other.isNotNull(), "reused").otherwise("analyse")
    return d.select("input", "bvid", decision.alias("decision"), F.coalesce(again, F.when(F.col("bvid").isNotNull(), other)).alias("zip_path"))
