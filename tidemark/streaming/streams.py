"""The same operators over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.comments import UNKNOWN


def comment_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Comments arriving as parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ingested_at").cast("timestamp"))


def first_per_user_stream(comments: DataFrame, lateness: str = "7 days") -> DataFrame:
    """The first arrival of each user of a video; state leaves with the watermark. Anonymous rows all pass."""
    anon = F.coalesce("uid_hash", F.lit(UNKNOWN)) == UNKNOWN
    keyed = comments.withWatermark("at", lateness).withColumn("_u", F.when(anon, F.concat(F.lit("#"), F.col("dm_id"))).otherwise(F.col("uid_hash")))
    return keyed.dropDuplicatesWithinWatermark(["bvid", "_u"]).drop("_u")


def arrivals_per_window(comments: DataFrame, window: str = "1 hour", lateness: str = "7 days") -> DataFrame:
    """Comments per video and arrival window."""
    return comments.withWatermark("at", lateness).groupBy("bvid", F.window("at", window).alias("w")).agg(F.count("*").alias("n")).select("bvid", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what has arrived and return it: 'append' adds each batch to a table below the checkpoint's folder, 'complete' replaces it. Rows never pass the driver."""
    out, schema = f"{checkpoint}/rows", stream.schema

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(out)

    q = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(out)
