"""Tables as the pipelines see them. The label table stands for model output, which the data has not: two annotators derived from ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import consensus as C
from tidemark.operators.comments import first_per_user, prepared
from tidemark.operators.segments import fixed_segments, label_zones, segment_bounds
from tidemark.plans.data_problems import video_names
from tidemark.session import table


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(table(spark, sf, "comments"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """First comment of each user, in fixed segments."""
    return fixed_segments(first_per_user(comments(spark, sf)))


def names(spark: SparkSession, sf: str) -> DataFrame:
    return video_names(table(spark, sf, "videos"), table(spark, sf, "partition_lookup"))


def zones(m: DataFrame) -> DataFrame:
    return label_zones(segment_bounds(m))


def paths(c: DataFrame) -> DataFrame:
    """Two annotation paths for each row, from its id."""

    def out(k: int):
        i = F.col("dm_id")
        pick = lambda labels, a: F.element_at(F.array(*map(F.lit, labels)), (F.pmod(F.floor(i / a) * k + i, F.lit(len(labels))) + 1).cast("int"))
        conf = (F.pmod(i * k, F.lit(50)) + 50) / F.lit(100.0)
        bad = F.pmod(F.floor(i / 7) * k, F.lit(5)) == 0
        return F.struct(
            F.struct(pick(C.EMOTION, 3).alias("label"), conf.alias("confidence")).alias("emotion"), F.struct(bad.alias("violated"), F.when(bad, pick(C.MAXIMS, 11)).alias("maxim")).alias("cooperative_principle"),
            F.struct(pick(C.INTERACTION, 5).alias("label"), conf.alias("confidence")).alias("interaction_type"), F.struct(pick(C.SENTENCE, 7).alias("label"), conf.alias("confidence")).alias("sentence_function"),
            F.struct(pick(C.ORTHOGRAPHY, 13).alias("status"), conf.alias("confidence")).alias("orthography"))

    return c.withColumn("path_a", out(1)).withColumn("path_b", out(3))
