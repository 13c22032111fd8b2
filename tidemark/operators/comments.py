"""Comment rows: conversion, identity, first per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import uid_digest
from tidemark.session import blank_to_null, trimmed

UNKNOWN = "unknown_device"


def from_objects(raw: DataFrame) -> DataFrame:
    """Rows of the binary feed (``crc32_id``, ``uid``, ``content``, ``time_sec``): a usable crc stays as it is, else a positive user id is
    digested, else the device is unknown. Content is trimmed, blank content dropped, a missing time is 0."""
    crc = F.nullif(blank_to_null(F.col("crc32_id")), F.lit("0"))
    uid = F.when(F.col("uid") > 0, uid_digest(F.col("uid")))
    who = F.coalesce(crc, uid, F.lit(UNKNOWN))
    return raw.where(blank_to_null(F.col("content")).isNotNull()).select(
        "*", who.alias("uid_hash"), F.when(who == UNKNOWN, UNKNOWN).otherwise("real_user").alias("identity_type")
    ).withColumn("content", trimmed(F.col("content"))).withColumn("time_sec", F.coalesce("time_sec", F.lit(0.0)))


def from_xml(docs: DataFrame, column: str = "xml") -> DataFrame:
    """Rows of the XML feed, one document per row: <d p="time,..,user,..">text</d>. Rows with fewer than eight fields, an unusable time or blank text are dropped;
    user '' or '0' is unknown, others are digested."""
    d = docs.select("*", F.explode(F.from_xml(F.col(column), "d ARRAY<STRUCT<_p:STRING,_VALUE:STRING>>")["d"]).alias("d"))
    p = F.split("d._p", ",")
    user = F.get(p, F.lit(6))
    who = F.when((user == "") | (user == "0"), UNKNOWN).otherwise(uid_digest(user))
    text = blank_to_null(F.col("d._VALUE"))
    keep = (F.size(p) >= 8) & text.isNotNull() & F.get(p, F.lit(0)).try_cast("double").isNotNull()
    out = d.where(keep).select(*[c for c in docs.columns if c != column], who.alias("uid_hash"), text.alias("content"), F.get(p, F.lit(0)).try_cast("double").alias("time_sec"))
    return out.withColumn("identity_type", F.when(F.col("uid_hash") == UNKNOWN, UNKNOWN).otherwise("real_user"))


def prepared(comments: DataFrame) -> DataFrame:
    """The comment table in the form the pipelines expect: blank content dropped, content trimmed, missing time 0, rows without a user
    anonymous. Columns: dm_id, bvid, seq, uid_hash, content, time_sec, identity_type."""
    anon = F.col("uid_hash").isNull() | (F.col("uid_hash") == UNKNOWN) | (F.coalesce("identity_type", F.lit(UNKNOWN)) == UNKNOWN)
    return comments.where(blank_to_null(F.col("content")).isNotNull()).select(
        "dm_id", "bvid", "seq", F.when(anon, UNKNOWN).otherwise(F.col("uid_hash")).alias("uid_hash"), trimmed(F.col("content")).alias("content"),
        F.coalesce("time_sec", F.lit(0.0)).alias("time_sec"), F.when(anon, UNKNOWN).otherwise("real_user").alias("identity_type"))


def first_per_user(comments: DataFrame) -> DataFrame:
    """Per video, the first row of each user in input order (``seq``, then ``dm_id``); anonymous rows all stay. An aggregation
    with map-side combine rather than a window, so a user with very many rows is no burden."""
    cols = comments.columns
    real = comments.where(F.col("identity_type") != UNKNOWN)
    first = real.groupBy("bvid", "uid_hash").agg(F.min(F.struct("seq", "dm_id", *[c for c in cols if c not in ("seq", "dm_id")])).alias("r")).select("r.*").select(cols)
    return first.unionByName(comments.where(F.col("identity_type") == UNKNOWN))


def dedup_stats(comments: DataFrame) -> DataFrame:
    """Per video: rows, distinct users, anonymous rows, duplicates and their rate."""
    anon = F.col("identity_type") == UNKNOWN
    per_user = comments.groupBy("bvid", "uid_hash", anon.alias("anon")).agg(F.count("*").alias("n"))
    out = per_user.groupBy("bvid").agg(
        F.sum("n").alias("total"), F.count_if(~F.col("anon")).alias("unique_users"), F.coalesce(F.sum(F.when(F.col("anon"), F.col("n"))), F.lit(0)).alias("anonymous"))
    dup = F.col("total") - F.col("anonymous") - F.col("unique_users")
    return out.select("*", dup.alias("duplicates"), F.round(dup / F.col("total"), 6).alias("dedup_rate"))
