"""Queries of sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregate import weighted_soft
from tidemark.operators.consensus import EMOTION
from tidemark.operators.lexical import hard_metrics
from tidemark.operators.tokenise import tagged
from tidemark.plans import views as V
from tidemark.plans.pipelines import RECORDS, _records
from tidemark.session import blank_to_null, shared_dir, table
from tidemark.sinks import tables as K
from tidemark.streaming import streams


def q_coder_rows(s: SparkSession, sf: str) -> DataFrame:
    return K.coder_rows(_records(s, sf)).drop("segment_id", "maxim")


def q_wide_emotion(s, sf):
    soft = weighted_soft(_records(s, sf), ["tname", "zone_type"]).where("dim = 'emotion'")
    return K.wide(soft, ["tname", "zone_type"], "label", "ratio", names=EMOTION)


def q_heatmap_json(s, sf):
    return K.heatmap_json(weighted_soft(_records(s, sf), ["tname", "zone_type"]))


def _stream(s: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/comments.parquet"
    t = table(s, sf, "comments")
    return streams.comment_stream(s, path if t.inputFiles()[0].rstrip("/") != f"file://{path}" else sf + "/comments.parquet*", t.schema)


def q_stream_arrivals(s, sf):
    name = f"arrivals_{uuid.uuid4().hex}"
    return streams.run_once(streams.arrivals_per_window(_stream(s, sf)), name, f"{shared_dir(s)}/{name}", "complete")


def q_lexicon_metrics(s, sf):
    """Lexical measures per video, the tags of all videos and the categories serving as a lexicon of names."""
    words = table(s, sf, "videos").select(F.explode("tags").alias("word")).unionByName(table(s, sf, "partition_lookup").select(blank_to_null(F.col("tname")).alias("word")))
    lexicon = words.select("word", F.lit(None).cast("long").alias("freq"), F.lit("nz").alias("pos"))
    return hard_metrics(tagged(V.comments(s, sf).select("bvid", "content"), lexicon), ["bvid"])


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
SQL = {
    "coder_rows": RECORDS + """ SELECT bvid, tname, zone_type, dm_id, e AS emotion, CASE WHEN fst THEN c1 ELSE c3 END AS emotion_confidence, v AS violated, i AS interaction_type, sf AS sentence_function, o AS orthography, consensus_level, round(jsd_score, 6) AS jsd_score, weight_multiplier FROM full_recs""",
    "wide_emotion": RECORDS + """, s AS (SELECT tname, zone_type, e, sum(weight_multiplier) AS x FROM full_recs WHERE tname IS NOT NULL GROUP BY ALL), r AS (SELECT tname, zone_type, e, round(x / sum(x) OVER (PARTITION BY tname, zone_type), 6) AS ratio FROM s)
SELECT tname, zone_type, coalesce(max(ratio) FILTER (e = 'negative'), 0) AS negative, coalesce(max(ratio) FILTER (e = 'neutral'), 0) AS neutral, coalesce(max(ratio) FILTER (e = 'positive'), 0) AS positive FROM r GROUP BY tname, zone_type""",
    "stream_arrivals": "SELECT bvid, CAST(date_trunc('hour', ingested_at) AS TIMESTAMP) AS start, count(*) AS n FROM comments GROUP BY ALL",
}
