"""Queries of the comment pipelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import aggregate as A
from tidemark.operators import consensus as C
from tidemark.operators import lexical as L
from tidemark.operators import sampling as P
from tidemark.operators import segments as S
from tidemark.operators.comments import UNKNOWN, dedup_stats, first_per_user
from tidemark.plans import views as V
from tidemark.session import materialise, table

SCALARS = ("avg_word_length", "content_word_density", "punctuation_emoji_rate")


def q_dedup_first_per_user(s: SparkSession, sf: str) -> DataFrame:
    return first_per_user(V.comments(s, sf)).select("dm_id", "bvid", "uid_hash")


def q_dedup_stats(s, sf):
    return dedup_stats(V.comments(s, sf))


def q_identity_split(s, sf):
    return V.comments(s, sf).groupBy("bvid", "identity_type").agg(F.count("*").alias("n"))


def q_partition_lookup(s, sf):
    return V.names(s, sf)


def q_density_signal(s, sf):
    return S.density_signal(V.comments(s, sf))


def q_fixed_segments(s, sf):
    return V.members(s, sf).select("dm_id", "bvid", "segment_id")


def q_segment_bounds(s, sf):
    return S.segment_bounds(V.members(s, sf)).withColumn("density", F.round("density", 6))


def q_zone_labels(s, sf):
    return V.zones(V.members(s, sf)).select("bvid", "segment_id", "zone_type")


def q_dynamic_segments(s, sf):
    return S.dynamic_segments(first_per_user(V.comments(s, sf))).withColumn("density", F.round("density", 6))


def q_merge_small(s, sf):
    seg = S.segment_bounds(S.fixed_segments(first_per_user(V.comments(s, sf)), 10))
    return S.merge_small(seg.where(F.col("n") > 0), 25)


def q_regex_orthography(s, sf):
    c = F.col("content")
    return V.comments(s, sf).select("dm_id", T.has_emphasis(c).alias("emphasis"), T.upper_runs(c).cast("long").alias("upper_runs"), T.digit_runs(c).cast("long").alias("digit_runs"))


def q_syllable_mix(s, sf):
    w = V.comments(s, sf).select("bvid", F.explode(T.tokens(F.col("content"))).alias("w"))
    return w.groupBy("bvid", T.syllables(F.col("w")).alias("bucket")).agg(F.count("*").alias("n"))


def q_hard_metrics(s, sf):
    return L.hard_metrics(V.members(s, sf), ["bvid", "segment_id"])


def q_pos_distribution(s, sf):
    return L.pos_distribution(V.comments(s, sf), ["bvid"])


def q_sample_head(s, sf):
    return P.head_per_segment(V.members(s, sf)).select("bvid", "segment_id", "dm_id", "pick")


def q_sample_frequent(s, sf):
    return P.frequent_per_segment(V.members(s, sf))


def q_context_neighbours(s, sf):
    n = P.neighbours(V.members(s, sf))
    return n.select("dm_id", F.size("before").cast("long").alias("n_before"), F.size("after").cast("long").alias("n_after"))


def q_context_budget(s, sf):
    return P.context(V.members(s, sf)).select("dm_id", "n_before", "n_after", "total_tokens")


def q_token_estimate(s, sf):
    return V.comments(s, sf).select("dm_id", T.token_estimate(F.col("content")).alias("tokens"))


def _records(s, sf) -> DataFrame:
    members = materialise(V.members(s, sf), "members")  # read twice
    m = P.head_per_segment(members)
    r = C.reconcile(V.paths(m.select("bvid", "segment_id", "dm_id")))
    z = V.zones(members).select("bvid", "segment_id", "zone_type", F.col("n").alias("segment_n"))
    return r.join(z, ["bvid", "segment_id"]).join(V.names(s, sf), "bvid", "left")


def q_jsd_score(s, sf):
    return C.reconcile(V.paths(V.comments(s, sf))).select("dm_id", F.round("jsd_score", 6).alias("jsd_score"), "consensus_level", "weight_multiplier", F.col("output.emotion.label").alias("emotion"))


def q_dual_path_kappa(s, sf):
    return C.dual_path_kappa(V.paths(V.comments(s, sf)))


def q_rater_kappa(s, sf):
    return C.cohen_kappa(table(s, sf, "moderation_samples"), "rater_a", "rater_b")


def q_consensus_rates(s, sf):
    return A.with_interval(A.consensus_rates(_records(s, sf), ["tname", "zone_type"]))


def q_weighted_soft(s, sf):
    return A.weighted_soft(_records(s, sf), ["tname", "zone_type"])


def q_weighted_hard(s, sf):
    m = materialise(V.members(s, sf), "members")
    x = L.hard_metrics(m, ["bvid", "segment_id"]).join(V.zones(m).select("bvid", "segment_id", "zone_type"), ["bvid", "segment_id"]).join(V.names(s, sf), "bvid", "left")
    return A.weighted_hard(x, SCALARS, keys=["tname", "zone_type"])


def q_parse_input(s, sf):
    v = table(s, sf, "videos").select("bvid", "cid").distinct()
    forms = F.explode(F.array("bvid", F.concat(F.lit("av"), F.col("cid")), F.concat(F.lit("https://www.bilibili.com/video/"), F.col("bvid"), F.lit("?p=1")), F.lit("nothing")))
    return v.select(forms.alias("ref")).distinct().select("ref", T.parse_input(F.col("ref")).alias("x")).select("ref", "x.*")


def q_text_functions(s, sf):
    t = F.col("title")
    return table(s, sf, "videos").select("bvid", "title", "crawled_at").distinct().select(
        "bvid", "crawled_at", T.safe_file_name(t).alias("file_name"), T.clean_title(F.concat(F.lit("<em class='k'>"), t, F.lit("</em> &amp; more "))).alias("cleaned"),
        T.latex_escape(F.concat(t, F.lit(" 5% & a_b"))).alias("latex"), T.html_escape(F.concat(t, F.lit("<b>"))).alias("html"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

TRIM = r"regexp_replace({0}, '^[\t-\r \x{{85}}\p{{Z}}]+|[\t-\r \x{{85}}\p{{Z}}]+$', '', 'g')"
PREP = f"""prep AS (SELECT dm_id, bvid, seq, CASE WHEN anon THEN '{UNKNOWN}' ELSE uid_hash END AS uid_hash, content, time_sec, CASE WHEN anon THEN '{UNKNOWN}' ELSE 'real_user' END AS identity_type FROM (
  SELECT dm_id, bvid, seq, uid_hash, {TRIM.format("content")} AS content, coalesce(time_sec, 0e0) AS time_sec, (uid_hash IS NULL OR uid_hash = '{UNKNOWN}' OR coalesce(identity_type, '{UNKNOWN}') = '{UNKNOWN}') AS anon
  FROM comments) WHERE content <> '')"""
FIRST = PREP + f""", firsts AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY bvid, uid_hash ORDER BY seq, dm_id) AS rn FROM prep WHERE identity_type <> '{UNKNOWN}') WHERE rn = 1
  UNION ALL SELECT * FROM prep WHERE identity_type = '{UNKNOWN}')"""


def _fixed(step: int) -> str:
    return FIRST + f""", members AS (SELECT *, CAST(floor(idx / {step}) AS INTEGER) AS segment_id FROM (
  SELECT *, row_number() OVER (PARTITION BY bvid ORDER BY time_sec, identity_type = '{UNKNOWN}', seq, dm_id) - 1 AS idx FROM firsts)),
bounds AS (SELECT *, CASE WHEN end_time > start_time THEN n / (end_time - start_time) ELSE 0e0 END AS density FROM (SELECT bvid, segment_id, min(time_sec) AS start_time, max(time_sec) AS end_time, count(*) AS n FROM members GROUP BY ALL))"""


MEMBERS = _fixed(30)
ZONES = MEMBERS + """, z1 AS (SELECT *, avg(density) OVER w AS m, median(density) OVER w AS d, count(*) OVER w AS k FROM bounds WINDOW w AS (PARTITION BY bvid)),
z2 AS (SELECT *, median(abs(density - d)) OVER (PARTITION BY bvid) AS mad FROM z1),
zones AS (SELECT bvid, segment_id, n, CASE WHEN k > 1 AND density > m + 1.5e0 * mad THEN 'hot_zone' ELSE 'cold_zone' END AS zone_type FROM z2)"""
TOKENS = r"regexp_extract_all({0}, '[A-Za-z]+|[0-9]+|[\x{{3400}}-\x{{9fff}}]{{1,2}}|[\x{{3041}}-\x{{3096}}\x{{30a1}}-\x{{30fa}}\x{{30fc}}-\x{{30fe}}]+|[\x{{ac00}}-\x{{d7a3}}]+')"
EMOJI_SQL = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B50}\x{2B55}]"
METRICS = r""", tok AS (SELECT *, """ + TOKENS.format("content") + r""" AS w FROM @SRC),
per AS (SELECT @KEYS, len(w) AS words, list_sum(list_transform(w, lambda x: length(x))) AS chars, len(list_filter(w, lambda x: NOT regexp_matches(x, '^[0-9]') AND NOT regexp_matches(x, '^[A-Za-z]'))) AS cw,
  len(list_filter(w, lambda x: length(x) = 1)) AS w1, len(list_filter(w, lambda x: length(x) = 2)) AS w2, (regexp_matches(content, '[!?~！？～]') OR regexp_matches(content, '""" + EMOJI_SQL + r"""')) AS marked,
  len(regexp_extract_all(content, '[A-Z]{2,}')) AS upper, len(regexp_extract_all(content, '\p{Nd}{2,}')) AS digits, len(regexp_extract_all(content, '[（(][\x{4e00}-\x{9fff}\p{L}\p{M}\p{Nd}\p{Pc}\t-\r\x{85}\p{Z}・ω･｡]+[）)]')) AS faces FROM tok),
metrics AS (SELECT @KEYS, count(*) AS total_comments, CAST(sum(words) AS BIGINT) AS total_words, CAST(coalesce(sum(chars), 0) AS BIGINT) AS total_chars,
  round(CASE WHEN sum(words) > 0 THEN sum(chars) / CAST(sum(words) AS DOUBLE) ELSE 0 END, 6) AS avg_word_length, round(CASE WHEN sum(words) > 0 THEN sum(cw) / CAST(sum(words) AS DOUBLE) ELSE 0 END, 6) AS content_word_density,
  round(avg(CASE WHEN marked THEN 1e0 ELSE 0e0 END), 6) AS punctuation_emoji_rate, round(CASE WHEN sum(words) > 0 THEN sum(w1) / CAST(sum(words) AS DOUBLE) ELSE 0 END, 6) AS syllable_one,
  round(CASE WHEN sum(words) > 0 THEN sum(w2) / CAST(sum(words) AS DOUBLE) ELSE 0 END, 6) AS syllable_two, round(CASE WHEN sum(words) > 0 THEN (sum(words) - sum(w1) - sum(w2)) / CAST(sum(words) AS DOUBLE) ELSE 0 END, 6) AS syllable_three_plus,
  round(CASE WHEN sum(chars) > 0 THEN sum(upper) / CAST(sum(chars) AS DOUBLE) ELSE 0 END * 1000, 6) AS uppercase_abbr_per_1000, round(CASE WHEN sum(chars) > 0 THEN sum(digits) / CAST(sum(chars) AS DOUBLE) ELSE 0 END * 1000, 6) AS number_symbol_per_1000,
  round(CASE WHEN sum(chars) > 0 THEN sum(faces) / CAST(sum(chars) AS DOUBLE) ELSE 0 END * 1000, 6) AS emoticon_per_1000 FROM per GROUP BY ALL)"""


def _metrics(src: str, keys: str) -> str:
    return METRICS.replace("@SRC", src).replace("@KEYS", keys)


NAMES = r"names AS (SELECT v.bvid, coalesce(min(nullif(" + TRIM.format("v.tname") + r", '')), min(p.tname)) AS tname FROM videos v LEFT JOIN partition_lookup p ON v.tid = p.tid GROUP BY v.bvid)"
TOKEN_EST = "CASE WHEN {0} IS NULL OR {0} = '' THEN 0 ELSE greatest(1, CAST(floor(len(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]')) * 0.5e0 + (length({0}) - len(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fff}}]'))) * 0.3e0) AS BIGINT)) END"


def _path(k: int) -> str:
    lst = lambda labels: "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    pick = lambda labels, a: f"{lst(labels)}[CAST(((dm_id // {a}) * {k} + dm_id) % {len(labels)} AS INTEGER) + 1]"
    return (f"{pick(C.EMOTION, 3)} AS e{k}, {pick(C.INTERACTION, 5)} AS i{k}, {pick(C.SENTENCE, 7)} AS s{k}, {pick(C.ORTHOGRAPHY, 13)} AS o{k}, "
            f"((dm_id * {k}) % 50 + 50) / 100e0 AS c{k}, ((dm_id // 7) * {k}) % 5 = 0 AS v{k}")  # fmt: skip


def _jsd(label: str, labels: tuple) -> str:
    n = len(labels)
    arr = "[" + ", ".join(f"'{x}'" for x in labels) + "]"
    dist = lambda k: f"(SELECT list(x + 1e-10) FROM (SELECT unnest(list_transform({arr}, lambda l: CASE WHEN l = {label}{k} THEN c{k} ELSE (1e0 - c{k}) / {float(n)}e0 END)) AS x))"  # noqa: E731, F841
    term = lambda x, y: f"{x} * ln(2e0 * {x} / ({x} + {y}))"
    parts = []
    for l in labels:  # noqa: E741
        p = {k: f"((CASE WHEN {label}{k} = '{l}' THEN c{k} ELSE (1e0 - c{k}) / {float(n - 1)}e0 END + 1e-10) / (1e0 + {n}e-10))" for k in (1, 3)}
        parts.append(f"{term(p[1], p[3])} + {term(p[3], p[1])}")
    return "(" + " + ".join(parts) + ") / 2e0 / ln(2e0)"


def _binary() -> str:
    p = {k: (f"((CASE WHEN v{k} THEN 1e0 ELSE 0e0 END + 1e-10) / (1e0 + 2e-10))", f"((CASE WHEN v{k} THEN 0e0 ELSE 1e0 END + 1e-10) / (1e0 + 2e-10))") for k in (1, 3)}
    t = lambda x, y: f"{x} * ln(2e0 * {x} / ({x} + {y})) + {y} * ln(2e0 * {y} / ({x} + {y}))"
    return f"({t(p[1][0], p[3][0])} + {t(p[1][1], p[3][1])}) / 2e0 / ln(2e0)"


def _reconciled(src: str) -> str:
    return f""", pth AS (SELECT *, {_path(1)}, {_path(3)} FROM {src}),
rec0 AS (SELECT *, ({_jsd("e", C.EMOTION)} + {_jsd("i", C.INTERACTION)} + {_jsd("o", C.ORTHOGRAPHY)} + {_binary()}) / 4e0 AS jsd_score FROM pth),
rec1 AS (SELECT *, CASE WHEN jsd_score < 0.2e0 THEN 'high' WHEN jsd_score < 0.6e0 THEN 'medium' ELSE 'low' END AS consensus_level FROM rec0),
recs AS (SELECT *, CASE WHEN consensus_level = 'low' THEN 0.2e0 ELSE 1e0 END AS weight_multiplier, (consensus_level = 'high' OR c1 >= c3) AS fst FROM rec1)"""


HEADS = ZONES + ", heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bvid, segment_id ORDER BY idx) AS pick FROM members) WHERE pick <= 10)"
RECORDS = f"WITH {HEADS}, {NAMES}" + _reconciled("heads") + """, full_recs AS (SELECT r.*, z.zone_type, n.tname, CASE WHEN fst THEN e1 ELSE e3 END AS e, CASE WHEN fst THEN i1 ELSE i3 END AS i, CASE WHEN fst THEN s1 ELSE s3 END AS sf,
  CASE WHEN fst THEN o1 ELSE o3 END AS o, CASE WHEN fst THEN v1 ELSE v3 END AS v FROM recs r JOIN zones z USING (bvid, segment_id) LEFT JOIN names n USING (bvid))"""
_DIMS = (("emotion", "e"), ("interaction_type", "i"), ("sentence_function", "sf"), ("orthography", "o"))
_KDIMS = (("emotion", "e"), ("interaction_type", "i"), ("sentence_function", "s"), ("orthography", "o"))
KAPPA = """, cells AS (SELECT dim, la, lb, count(*) AS c FROM pairs WHERE la IS NOT NULL AND lb IS NOT NULL GROUP BY ALL),
m AS (SELECT dim, lab, sum(x) AS x, sum(y) AS y FROM (SELECT dim, la AS lab, c AS x, 0 AS y FROM cells UNION ALL SELECT dim, lb, 0, c FROM cells) GROUP BY ALL),
pe AS (SELECT dim, sum(CAST(x AS DOUBLE) * y) AS xy FROM m GROUP BY dim), po AS (SELECT dim, CAST(sum(c) AS BIGINT) AS n, sum(CASE WHEN la = lb THEN c ELSE 0 END) AS same FROM cells GROUP BY dim),
kap AS (SELECT po.dim, n, round(CASE WHEN xy / (CAST(n AS DOUBLE) * n) >= 1 THEN CASE WHEN same = n THEN 1e0 END ELSE (same / CAST(n AS DOUBLE) - xy / (CAST(n AS DOUBLE) * n)) / (1 - xy / (CAST(n AS DOUBLE) * n)) END, 4) AS kappa FROM po JOIN pe USING (dim))"""
_Z = "1.9599639845400536e0"
_CI = f"(p + {_Z} * {_Z} / (2 * n_records) {{0}} {_Z} * sqrt(p * (1 - p) / n_records + {_Z} * {_Z} / (4e0 * n_records * n_records))) / (1 + {_Z} * {_Z} / n_records)"

SQL = {
    "dedup_first_per_user": f"WITH {FIRST} SELECT dm_id, bvid, uid_hash FROM firsts",
    "dedup_stats": f"""WITH {PREP} SELECT bvid, count(*) AS total, count(DISTINCT CASE WHEN identity_type <> '{UNKNOWN}' THEN uid_hash END) AS unique_users, count(*) FILTER (identity_type = '{UNKNOWN}') AS anonymous,
count(*) - count(*) FILTER (identity_type = '{UNKNOWN}') - count(DISTINCT CASE WHEN identity_type <> '{UNKNOWN}' THEN uid_hash END) AS duplicates,
round((count(*) - count(*) FILTER (identity_type = '{UNKNOWN}') - count(DISTINCT CASE WHEN identity_type <> '{UNKNOWN}' THEN uid_hash END)) / CAST(count(*) AS DOUBLE), 6) AS dedup_rate FROM prep GROUP BY bvid""",
    "identity_split": f"WITH {PREP} SELECT bvid, identity_type, count(*) AS n FROM prep GROUP BY ALL",
    "partition_lookup": f"WITH {NAMES} SELECT bvid, tname FROM names",
    "density_signal": f"""WITH {PREP}, st AS (SELECT bvid, min(time_sec) AS m FROM prep GROUP BY bvid), b AS (SELECT p.bvid, CAST(floor(round(time_sec - m, 3)) AS BIGINT) AS bin, count(*) AS n FROM prep p JOIN st ON st.bvid = p.bvid GROUP BY ALL),
e AS (SELECT bvid, unnest(range(0, max(bin) + 1)) AS bin FROM b GROUP BY bvid) SELECT e.bvid, e.bin, coalesce(b.n, 0) AS n FROM e LEFT JOIN b ON b.bvid = e.bvid AND b.bin = e.bin""",
    "fixed_segments": f"WITH {MEMBERS} SELECT dm_id, bvid, segment_id FROM members",
    "segment_bounds": f"WITH {MEMBERS} SELECT bvid, segment_id, start_time, end_time, n, round(density, 6) AS density FROM bounds",
    "zone_labels": f"WITH {ZONES} SELECT bvid, segment_id, zone_type FROM zones",
    "regex_orthography": rf"WITH {PREP} SELECT dm_id, regexp_matches(content, '[!?~！？～]') AS emphasis, len(regexp_extract_all(content, '[A-Z]{{2,}}')) AS upper_runs, len(regexp_extract_all(content, '\p{{Nd}}{{2,}}')) AS digit_runs FROM prep",
    "syllable_mix": f"WITH {PREP}, w AS (SELECT bvid, unnest({TOKENS.format('content')}) AS w FROM prep) SELECT bvid, CASE length(w) WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three_plus' END AS bucket, count(*) AS n FROM w GROUP BY ALL",
    "hard_metrics": f"WITH {MEMBERS}" + _metrics("members", "bvid, segment_id") + " SELECT * FROM metrics",
    "pos_distribution": f"""WITH {PREP}, w AS (SELECT bvid, unnest({TOKENS.format('content')}) AS w FROM prep), c AS (SELECT bvid, CASE WHEN regexp_matches(w, '^[A-Za-z]') THEN 'eng' WHEN regexp_matches(w, '^[0-9]') THEN 'm' ELSE 'n' END AS pos, count(*) AS n FROM w GROUP BY ALL)
SELECT bvid, pos, round(n / CAST(sum(n) OVER (PARTITION BY bvid) AS DOUBLE), 6) AS ratio FROM c""",
    "sample_head": f"WITH {HEADS} SELECT bvid, segment_id, dm_id, pick FROM heads",
    "sample_frequent": f"""WITH {MEMBERS}, t AS (SELECT bvid, segment_id, content, count(*) AS freq, min(idx) AS fi, arg_min(dm_id, idx) AS dm_id FROM members GROUP BY ALL)
SELECT bvid, segment_id, content, freq, dm_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY bvid, segment_id ORDER BY freq DESC, fi) AS pick FROM t) WHERE pick <= 10""",
    "context_neighbours": f"""WITH {MEMBERS} SELECT a.dm_id, count(b.dm_id) FILTER (b.time_sec < a.time_sec) AS n_before, count(b.dm_id) FILTER (b.time_sec > a.time_sec) AS n_after FROM members a
LEFT JOIN members b ON a.bvid = b.bvid AND a.segment_id = b.segment_id AND abs(round(b.time_sec * 1000) - round(a.time_sec * 1000)) <= 5000 GROUP BY a.dm_id""",
    "context_budget": f"""WITH {MEMBERS}, t AS (SELECT *, {TOKEN_EST.format("content")} AS tk FROM members), nb AS (SELECT a.dm_id, a.tk AS own, 200 - a.tk AS remaining, b.dm_id AS other, b.tk, b.time_sec < a.time_sec AS bef,
  sum(b.tk) OVER (PARTITION BY a.dm_id, b.time_sec < a.time_sec ORDER BY CASE WHEN b.time_sec < a.time_sec THEN -b.idx ELSE b.idx END ROWS UNBOUNDED PRECEDING) AS run
  FROM t a LEFT JOIN t b ON a.bvid = b.bvid AND a.segment_id = b.segment_id AND abs(round(b.time_sec * 1000) - round(a.time_sec * 1000)) <= 5000 AND b.time_sec <> a.time_sec),
f AS (SELECT *, other IS NOT NULL AND remaining > 0 AND run <= CASE WHEN bef THEN floor(remaining * 0.6e0) ELSE remaining - floor(remaining * 0.6e0) END AS ok FROM nb)
SELECT dm_id, count(*) FILTER (ok AND bef) AS n_before, count(*) FILTER (ok AND NOT bef) AS n_after, CAST(max(own) + coalesce(sum(tk) FILTER (ok), 0) AS BIGINT) AS total_tokens FROM f GROUP BY dm_id""",
    "token_estimate": f"WITH {PREP} SELECT dm_id, CAST({TOKEN_EST.format('content')} AS BIGINT) AS tokens FROM prep",
    "jsd_score": f"WITH {PREP}" + _reconciled("prep") + " SELECT dm_id, round(jsd_score, 6) AS jsd_score, consensus_level, weight_multiplier, CASE WHEN fst THEN e1 ELSE e3 END AS emotion FROM recs",
    "dual_path_kappa": f"WITH {PREP}" + _reconciled("prep") + ", pairs AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dim, {x}1 AS la, {x}3 AS lb FROM recs" for d, x in _KDIMS) + ")" + KAPPA + " SELECT dim, n, kappa FROM kap",
    "rater_kappa": "WITH pairs AS (SELECT 'x' AS dim, rater_a AS la, rater_b AS lb FROM moderation_samples)" + KAPPA + " SELECT n, kappa FROM kap",
    "consensus_rates": RECORDS + f""", g AS (SELECT tname, zone_type, count(*) AS n_records, round(avg((consensus_level = 'high')::DOUBLE), 6) AS high_consensus_rate, round(avg((consensus_level = 'medium')::DOUBLE), 6) AS medium_consensus_rate,
  round(avg((consensus_level = 'low')::DOUBLE), 6) AS low_consensus_rate, round(avg(weight_multiplier), 6) AS avg_weight_multiplier, round(sum(CASE WHEN v THEN weight_multiplier ELSE 0 END) / sum(weight_multiplier), 6) AS violation_rate FROM full_recs GROUP BY ALL),
h AS (SELECT *, floor(high_consensus_rate * n_records) / n_records AS p FROM g) SELECT * EXCLUDE p, CASE WHEN n_records >= 30 THEN round(least(greatest({_CI.format('-')}, 0), 1), 4) END AS ci_lower,
CASE WHEN n_records >= 30 THEN round(least(greatest({_CI.format('+')}, 0), 1), 4) END AS ci_upper, CASE WHEN n_records >= 30 THEN 'ok' ELSE 'insufficient_sample' END AS ci_status FROM h""",
    "weighted_soft": RECORDS + ", d AS (" + " UNION ALL ".join(f"SELECT tname, zone_type, weight_multiplier, '{d}' AS dim, {x} AS label FROM full_recs" for d, x in _DIMS) + """), s AS (SELECT tname, zone_type, dim, label, sum(weight_multiplier) AS x FROM d GROUP BY ALL)
SELECT tname, zone_type, dim, label, round(x / sum(x) OVER (PARTITION BY tname, zone_type, dim), 6) AS ratio FROM s WHERE tname IS NOT NULL""",
    "parse_input": r"""WITH v AS (SELECT DISTINCT bvid, cid FROM videos), f AS (SELECT DISTINCT unnest([bvid, 'av' || cid, 'https://www.bilibili.com/video/' || bvid || '?p=1', 'nothing']) AS ref FROM v)
SELECT ref, CASE WHEN regexp_matches(ref, '^BV[a-zA-Z0-9]{10}$') THEN 'bv' WHEN regexp_matches(ref, '^av[0-9]+$') THEN 'av' WHEN ref LIKE 'https:%' THEN 'url' ELSE 'unknown' END AS input_type,
nullif(regexp_extract(ref, 'BV[a-zA-Z0-9]{10}'), '') AS bvid, CAST(nullif(regexp_extract(ref, '^av([0-9]+)$', 1), '') AS BIGINT) AS avid FROM f""",
    "text_functions": rf"""SELECT DISTINCT bvid, crawled_at, regexp_replace({TRIM.format("translate(title, '" + chr(92) + "/:*?" + chr(34) + "<>|', '_________')")}, '[. ]+$', '') AS file_name,
{TRIM.format("replace(replace(replace(replace(replace(replace(regexp_replace(title, '</?em[^>]*>', '', 'g') || ' &amp; more ', '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')")} AS cleaned,
replace(replace(replace(regexp_replace(replace(title || ' 5% & a_b', '\', chr(1)), '([&%$#_{{}}])', '\\\1', 'g'), '~', '\textasciitilde{{}}'), '^', '\textasciicircum{{}}'), chr(1), '\textbackslash{{}}') AS latex,
replace(replace(replace(replace(replace(title || '<b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS html FROM videos""",
    "weighted_hard": f"WITH {ZONES}" + _metrics("members", "bvid, segment_id") + f""", {NAMES} SELECT tname, zone_type, count(*) AS segments, CAST(sum(total_comments) AS BIGINT) AS danmaku_count,
""" + ", ".join(f"round(sum({v} * total_comments) / sum(total_comments), 6) AS {v}" for v in SCALARS) + " FROM metrics JOIN zones USING (bvid, segment_id) LEFT JOIN names USING (bvid) GROUP BY tname, zone_type",
}
