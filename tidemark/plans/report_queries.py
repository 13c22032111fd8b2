"""The report tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import consensus as C
from tidemark.operators import corpus as K
from tidemark.operators import groups as G
from tidemark.operators import lexical as L
from tidemark.operators import sampling as P
from tidemark.operators.segments import segment_bounds
from tidemark.plans import views as V
from tidemark.plans.corpus_queries import _ONCE
from tidemark.plans.pipelines import RECORDS, _metrics
from tidemark.session import materialise, table

DISTRIBUTIONS = ("high_consensus_rate", "medium_consensus_rate", "low_consensus_rate")


def _members(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Members, written once, and their segments with zone, bounds and category."""
    m = materialise(V.members(s, sf), "members")
    z = V.zones(m).select("bvid", "segment_id", "zone_type", F.col("n").alias("segment_n"), "start_time", "end_time")
    return m, z.join(V.names(s, sf), "bvid", "left")


def _labelled(s: SparkSession, sf: str) -> DataFrame:
    m, z = _members(s, sf)
    heads = P.head_per_segment(m).select("bvid", "segment_id", "dm_id", "uid_hash", "content")
    r = C.reconcile(V.paths(heads)).join(z, ["bvid", "segment_id"])
    return r.where(F.col("tname").isNotNull())


def _measured(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m, z = _members(s, sf)
    x = L.hard_metrics(m, ["bvid", "segment_id"]).join(z.select("bvid", "segment_id", "tname", "zone_type"), ["bvid", "segment_id"])
    return x.where(F.col("tname").isNotNull()), L.pos_distribution(m, ["bvid", "segment_id"])


def q_table_lexical(s, sf):
    return G.lexical_table(*_measured(s, sf))


def q_table_orthography(s, sf):
    return G.orthography_table(_measured(s, sf)[0], _labelled(s, sf))


def q_table_sentence_function(s, sf):
    return G.label_table(_labelled(s, sf), "sentence_function")


def q_table_emotion(s, sf):
    return G.emotion_table(_labelled(s, sf))


def q_table_interaction(s, sf):
    return G.label_table(_labelled(s, sf), "interaction_type")


def q_table_consensus(s, sf):
    return G.consensus_table(_labelled(s, sf))


def q_kappa_ready(s, sf):
    return G.kappa_rows(_labelled(s, sf))


def q_group_summary(s, sf):
    r = _labelled(s, sf).select("tname", "zone_type", "bvid", "segment_id", "segment_n")
    tags = G.group_tags(r, table(s, sf, "videos").select("bvid", "tags"))
    return G.group_sizes(r).join(tags, ["tname", "zone_type"], "left").select("tname", "zone_type", "danmaku_count", "segments", "video_count", F.concat_ws(",", "tags").alias("tags"))


def q_corpus_distributions(s, sf):
    """Per snapshot, category and zone."""
    obs = K.observations(K.zone_rows(table(s, sf, "corpus_snapshots")), "all")
    return G.weighted_distributions(obs, DISTRIBUTIONS, ("snapshot_no", "tname", "zone_type"))


def q_snapshot_manifests(s, sf):
    return G.snapshot_manifests(table(s, sf, "corpus_snapshots"))


def q_segment_labels(s, sf):
    b = segment_bounds(V.members(s, sf))
    return b.select("bvid", "segment_id", F.concat(G.tenths(F.col("start_time")), F.lit("-"), G.tenths(F.col("end_time"))).alias("label"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_LAB = RECORDS + """, lab AS (SELECT f.*, b.n AS segment_n, b.start_time, b.end_time FROM full_recs f JOIN bounds b USING (bvid, segment_id) WHERE f.tname IS NOT NULL),
sizes AS (SELECT tname, zone_type, CAST(sum(segment_n) AS BIGINT) AS danmaku_count, count(*) AS segments, count(DISTINCT bvid) AS video_count FROM (SELECT DISTINCT tname, zone_type, bvid, segment_id, segment_n FROM lab) GROUP BY ALL)"""


def _shares(col: str, labels: tuple, prefix: str = "") -> str:
    cells = ", ".join(f"round(sum(CASE WHEN {col} = '{x}' THEN weight_multiplier ELSE 0 END) / sum(weight_multiplier), 6) AS {prefix}{x}" for x in labels)
    return f"(SELECT tname, zone_type, {cells} FROM lab GROUP BY ALL)"


def _label_sql(col: str, labels: tuple, prefix: str = "", more: str = "") -> str:
    return f"{_LAB} SELECT sizes.tname, sizes.zone_type, danmaku_count, s.* EXCLUDE (tname, zone_type){more} FROM sizes JOIN {_shares(col, labels, prefix)} s ON s.tname = sizes.tname AND s.zone_type = sizes.zone_type"


_SEG = f"{_LAB}" + _metrics("members", "bvid, segment_id") + ", mz AS (SELECT m.*, z.zone_type, n.tname FROM metrics m JOIN zones z USING (bvid, segment_id) JOIN names n USING (bvid) WHERE n.tname IS NOT NULL)"
_MEAN = lambda c, name: f"round(sum({c} * total_comments) / sum(total_comments), 6) AS {name}"
_TENTH = "CAST((CAST(round({0} * 1000) AS BIGINT) + 50) // 100 // 10 AS VARCHAR) || '.' || CAST((CAST(round({0} * 1000) AS BIGINT) + 50) // 100 % 10 AS VARCHAR)"
_LABEL = f"{_TENTH.format('start_time')} || '-' || {_TENTH.format('end_time')}"
_POS = "CASE WHEN regexp_matches(x, '^[A-Za-z]') THEN 'eng' WHEN regexp_matches(x, '^[0-9]') THEN 'm' ELSE 'n' END"
_RATE = "(SELECT tname, zone_type, {0} FROM lab GROUP BY ALL)"
_LEVEL = lambda x: f"round(avg((consensus_level = '{x}')::DOUBLE), 6) AS {x}_consensus_rate"
_Z = "1.9599639845400536e0"
_EDGE = f"CASE WHEN n_records >= 30 THEN round(least(greatest((p + {_Z} * {_Z} / (2 * n_records) {{0}} {_Z} * sqrt(p * (1 - p) / n_records + {_Z} * {_Z} / (4e0 * n_records * n_records))) / (1 + {_Z} * {_Z} / n_records), 0), 1), 4) END"


def _maxim(k: int) -> str:
    names = "[" + ", ".join(f"'{x}'" for x in C.MAXIMS) + "]"
    return f"CASE WHEN v{k} THEN {names}[CAST(((dm_id // 11) * {k} + dm_id) % {len(C.MAXIMS)} AS INTEGER) + 1] ELSE '' END"


SQL = {
    "table_sentence_function": _label_sql("sf", C.SENTENCE),
    "table_interaction": _label_sql("i", C.INTERACTION),
    "table_emotion": f"""{_LAB} SELECT sizes.tname, sizes.zone_type, danmaku_count, s.* EXCLUDE (tname, zone_type), rate AS cooperative_principle_violation_rate FROM sizes JOIN {_shares("e", C.EMOTION)} s ON s.tname = sizes.tname AND s.zone_type = sizes.zone_type
JOIN {_RATE.format("round(sum(CASE WHEN v THEN weight_multiplier ELSE 0 END) / sum(weight_multiplier), 6) AS rate")} r ON r.tname = sizes.tname AND r.zone_type = sizes.zone_type""",
    "table_consensus": f"""{_LAB}, g AS (SELECT tname, zone_type, count(*) AS n_records, {_LEVEL("high")}, {_LEVEL("medium")}, {_LEVEL("low")}, round(avg(weight_multiplier), 6) AS avg_weight_multiplier FROM lab GROUP BY ALL),
h AS (SELECT *, floor(high_consensus_rate * n_records) / n_records AS p FROM g)
SELECT sizes.tname, sizes.zone_type, danmaku_count, high_consensus_rate, medium_consensus_rate, low_consensus_rate, avg_weight_multiplier, {_EDGE.format("-")} AS high_consensus_ci_lower, {_EDGE.format("+")} AS high_consensus_ci_upper,
CASE WHEN n_records >= 30 THEN 'ok' ELSE 'insufficient_sample' END AS high_consensus_ci_status FROM sizes JOIN h ON h.tname = sizes.tname AND h.zone_type = sizes.zone_type""",
    "table_lexical": f"""{_SEG}, pw AS (SELECT bvid, segment_id, {_POS} AS pos, count(*) AS k FROM (SELECT bvid, segment_id, unnest(w) AS x FROM tok) GROUP BY ALL), pr AS (SELECT bvid, segment_id, pos, round(k / CAST(sum(k) OVER (PARTITION BY bvid, segment_id) AS DOUBLE), 6) AS ratio FROM pw),
merged AS (SELECT tname, zone_type, {", ".join(f"sum(CASE WHEN pos = '{p}' THEN ratio * total_comments ELSE 0 END) AS {p}" for p in ("eng", "m", "n"))} FROM mz JOIN pr USING (bvid, segment_id) GROUP BY ALL),
means AS (SELECT tname, zone_type, CAST(sum(total_comments) AS BIGINT) AS danmaku_count, {", ".join(_MEAN(c, c) for c in ("avg_word_length", "content_word_density", "punctuation_emoji_rate", "syllable_one", "syllable_two", "syllable_three_plus"))} FROM mz GROUP BY ALL)
SELECT means.*, {", ".join(f"round(coalesce({p}, 0) / danmaku_count, 6) AS pos_{p}" for p in ("eng", "m", "n"))} FROM means LEFT JOIN merged ON means.tname = merged.tname AND means.zone_type = merged.zone_type""",
    "table_orthography": f"""{_SEG}, hard AS (SELECT tname, zone_type, {", ".join(_MEAN(c, f"hard_{c}") for c in ("uppercase_abbr_per_1000", "number_symbol_per_1000", "emoticon_per_1000"))} FROM mz GROUP BY ALL)
SELECT sizes.tname, sizes.zone_type, danmaku_count, s.* EXCLUDE (tname, zone_type), hard.* EXCLUDE (tname, zone_type) FROM sizes JOIN {_shares("o", C.ORTHOGRAPHY, "soft_")} s ON s.tname = sizes.tname AND s.zone_type = sizes.zone_type JOIN hard ON hard.tname = sizes.tname AND hard.zone_type = sizes.zone_type""",
    "kappa_ready": f"""{_LAB} SELECT uid_hash, {_LABEL} AS time_segment, content AS raw_text, tname, zone_type, consensus_level, weight_multiplier, e AS emotion_label, CASE WHEN fst THEN c1 ELSE c3 END AS emotion_confidence, v AS cooperative_principle_violated,
CASE WHEN fst THEN {_maxim(1)} ELSE {_maxim(3)} END AS cooperative_principle_maxim, i AS interaction_type_label, CASE WHEN fst THEN c1 ELSE c3 END AS interaction_type_confidence, sf AS sentence_function_label, CASE WHEN fst THEN c1 ELSE c3 END AS sentence_function_confidence,
o AS orthography_status, CASE WHEN fst THEN c1 ELSE c3 END AS orthography_confidence FROM lab""",
    "group_summary": f"""{_LAB}, tg AS (SELECT DISTINCT bvid, unnest(tags) AS tag FROM videos), tl AS (SELECT tname, zone_type, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT l.tname, l.zone_type, tag FROM lab l JOIN tg USING (bvid) WHERE tag IS NOT NULL) GROUP BY ALL)
SELECT sizes.*, coalesce(tags, '') AS tags FROM sizes LEFT JOIN tl ON tl.tname = sizes.tname AND tl.zone_type = sizes.zone_type""",
    "corpus_distributions": f"WITH {_ONCE} SELECT snapshot_no, tname, zone_type, " + ", ".join(f"CAST((CAST(sum(CAST(round(coalesce({c}, 0) * 1e6) AS HUGEINT) * coalesce(danmaku_count, 0)) AS HUGEINT) * 2000 + greatest(sum(coalesce(danmaku_count, 0)), 1)) // (2 * greatest(sum(coalesce(danmaku_count, 0)), 1)) AS DOUBLE) / 1e9 AS {c}_mean" for c in DISTRIBUTIONS) + " FROM once GROUP BY ALL",
    "snapshot_manifests": """SELECT snapshot_no, count(DISTINCT bvid) AS video_count, coalesce(string_agg(DISTINCT prompt_version, ',' ORDER BY prompt_version) FILTER (prompt_version <> ''), '') AS prompt_versions,
count(DISTINCT prompt_version) FILTER (prompt_version <> '') > 1 AS mixed_versions FROM corpus_snapshots GROUP BY snapshot_no""",
    "segment_labels": f"WITH {RECORDS.split('WITH ', 1)[1]} SELECT bvid, segment_id, {_LABEL} AS label FROM bounds",
}
