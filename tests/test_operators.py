import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import pvalues
from tidemark.functions import text as T
from tidemark.functions.bitmap import Container
from tidemark.operators import aggregate, compare, consensus, corpus, sampling, segments, statistics
from tidemark.operators.comments import dedup_stats, first_per_user, from_objects, from_xml, prepared
from tidemark.operators.dense_totals import dense_totals
from tidemark.operators.ordinals import assign_ordinals
from tidemark.operators.snapshots import MEASURES, snapshot_changes

COMMENT = "dm_id long, bvid string, seq long, uid_hash string, content string, time_sec double, identity_type string"


def comments(spark, times, bvid="v", user=None):
    rows = [(i, bvid, i, user(i) if user else f"u{i}", f"text {i}", float(t), "real_user") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, COMMENT)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


# --- comments -----------------------------------------------------------------------------------------------------


def test_first_per_user_keeps_first_in_input_order_and_all_anonymous(spark):
    rows = [(1, "v", 5, "a", "late", 1.0, "real_user"), (2, "v", 2, "a", "first", 9.0, "real_user"), (3, "v", 3, "unknown_device", "x", 0.0, "unknown_device"),
            (4, "v", 4, "unknown_device", "x", 0.0, "unknown_device"), (5, "w", 9, "a", "other video", 1.0, "real_user")]
    got = {r.dm_id for r in first_per_user(spark.createDataFrame(rows, COMMENT)).collect()}
    assert got == {2, 3, 4, 5}
    s = {r.bvid: r for r in dedup_stats(spark.createDataFrame(rows, COMMENT)).collect()}["v"]
    assert (s.total, s.unique_users, s.anonymous, s.duplicates, s.dedup_rate) == (4, 1, 2, 1, 0.25)


def test_prepared_handles_nulls(spark):
    rows = [(1, "v", 0, None, " a ", None, None), (2, "v", 1, "u", None, 1.0, "real_user"), (3, "v", 2, "u", "　 ", 1.0, "real_user")]
    got = prepared(spark.createDataFrame(rows, COMMENT)).collect()
    assert [(r.dm_id, r.uid_hash, r.content, r.time_sec, r.identity_type) for r in got] == [(1, "unknown_device", "a", 0.0, "unknown_device")]


def test_object_and_xml_conversion(spark):
    raw = spark.createDataFrame([("abc", 5, " hi ", 1.0), ("0", 7, "x", None), (None, 0, "y", 2.0), ("z", 1, "  ", 1.0)], "crc32_id string, uid long, content string, time_sec double")
    got = {r.content: (r.uid_hash, r.identity_type, r.time_sec) for r in from_objects(raw).collect()}
    import hashlib

    assert got == {"hi": ("abc", "real_user", 1.0), "x": (hashlib.md5(b"7").hexdigest()[:16], "real_user", 0.0), "y": ("unknown_device", "unknown_device", 2.0)}
    xml = '<i><d p="1.5,1,25,0,0,0,77,9">hello</d><d p="2,1,25,0,0,0,0,9">anon</d><d p="3,1">short</d><d p="4,1,25,0,0,0,5,9"> </d></i>'
    got = {r.content: (r.uid_hash, r.time_sec) for r in from_xml(spark.createDataFrame([("v", xml)], "bvid string, xml string")).collect()}
    assert got == {"hello": (hashlib.md5(b"77").hexdigest()[:16], 1.5), "anon": ("unknown_device", 2.0)}


# --- segments -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "sizes"), [(12, [5, 5, 2]), (10, [5, 5]), (3, [3])])
def test_fixed_segments(spark, n, sizes):
    m = segments.fixed_segments(comments(spark, range(n)), 5)
    b = segments.label_zones(segments.segment_bounds(m)).orderBy("segment_id").collect()
    assert [r.n for r in b] == sizes
    if len(sizes) == 1:
        assert b[0].zone_type == "cold_zone"


def test_timeline_rank_over_minutes(spark):
    times = [random.Random(1).uniform(0, 500) for _ in range(200)]
    got = [r.time_sec for r in segments.timeline_rank(comments(spark, times)).orderBy("idx").collect()]
    assert got == sorted(times)


def test_density_and_zones(spark):
    d = segments.density_signal(comments(spark, [0.5, 0.8, 1.2, 1.5, 1.9, 5.0])).orderBy("bin").collect()
    assert [r.n for r in d][:2] == [3, 2]
    z = spark.createDataFrame([("v", 0, 1.0), ("v", 1, 1.0), ("v", 2, 30.0)], "bvid string, segment_id int, density double")
    assert [r.zone_type for r in segments.label_zones(z).orderBy("segment_id").collect()] == ["cold_zone", "cold_zone", "hot_zone"]


def test_change_points_are_optimal():
    rng = np.random.default_rng(3)

    def cost(x, cuts):
        parts = [x[a:b] for a, b in itertools.pairwise([0, *cuts, len(x)])]
        return sum(((p - p.mean()) ** 2).sum() for p in parts) + len(cuts)

    for _ in range(60):
        x = rng.integers(0, 4, rng.integers(3, 9)).astype(float)
        best = min(cost(x, c) for k in range(len(x)) for c in itertools.combinations(range(1, len(x)), k))
        assert cost(x, segments.change_points(x)) == pytest.approx(best)
    assert segments.change_points(np.array([1.0, 9.0])) == []


def test_merge_small(spark):
    s = spark.createDataFrame([("v", 0, 8, 0.0, 1.0), ("v", 1, 2, 1.0, 3.0), ("w", 0, 1, 0.0, 1.0), ("w", 1, 2, 1.0, 2.0), ("w", 2, 7, 2.0, 4.0)], "bvid string, segment_id int, n long, start_time double, end_time double")
    got = [(r.bvid, r.n, r.start_time, r.end_time) for r in segments.merge_small(s, 5).orderBy("bvid", "segment_id").collect()]
    assert got == [("v", 10, 0.0, 3.0), ("w", 10, 0.0, 4.0)]
    assert segments._merge([[0, 1, 0, 1], [1, 2, 1, 2], [2, 7, 2, 4]], 5) == [[0, 10, 0, 4]]


def test_dynamic_segments_cover_all_rows(spark):
    c = comments(spark, [i * 0.1 for i in range(20)] + [10 + i for i in range(20)])
    got = segments.dynamic_segments(c).collect()
    assert sum(r.n for r in got) == 40


# --- text ---------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    assert [one(spark, s, T.has_emphasis) for s in ("太好看了！", "哈哈哈", "真的吗？", "666")] == [True, False, True, False]
    assert one(spark, "AWSL 太棒了", T.upper_runs) == 1 and one(spark, "23333 笑死", T.digit_runs) == 1
    assert one(spark, "😀中", lambda c: F.length(c)) == 2 and one(spark, "🎉", T.has_emoji)
    assert one(spark, " Noun ", T.pos_alias) == "n" and one(spark, "nz", T.pos_alias) == "nz"
    assert one(spark, "中文ab", T.token_estimate) == 1 and one(spark, "", T.token_estimate) == 0
    assert one(spark, 'a/b:c?. ', T.safe_file_name) == "a_b_c_"
    long = one(spark, "字" * 100, T.safe_file_name)
    assert long == "字" * 50
    assert one(spark, '<em class="k">A&amp;B</em> &lt;', T.clean_title) == "A&B <"
    assert one(spark, "a_b & 5%", T.latex_escape) == r"a\_b \& 5\%"
    assert one(spark, "a, b；c  d", T.split_inputs) == ["a", "b", "c", "d"]
    assert one(spark, "```json\n{}\n```", T.strip_fence) == "{}"


def test_parse_input(spark):
    cases = {"bv1abcdefghi": ("bv", "BV1abcdefghi", None), "AV123": ("av", None, 123), "https://www.bilibili.com/video/BV1abcdefghi/": ("url", "BV1abcdefghi", None),
             "https://player.bilibili.com/player.html?aid=9": ("url", None, 9), "": ("unknown", None, None), "x": ("unknown", None, None)}
    for s, want in cases.items():
        x = one(spark, s, T.parse_input)
        assert (x.input_type, x.bvid, x.avid) == want


@pytest.mark.parametrize(("text", "want"), [("2025-01-05T00:00:00", ("2025", "2025-Q1", "2025-01")), ("", ("unknown",) * 3), (None, ("unknown",) * 3), ("bad", ("unknown",) * 3)])
def test_period_bucket(spark, text, want):
    assert tuple(one(spark, text, lambda c, g=g: T.period_bucket(c, g)) for g in ("year", "quarter", "month")) == want


def test_context(spark):
    m = segments.fixed_segments(comments(spark, [0, 3, 5, 5, 9, 20]), 30)
    got = {r.dm_id: ([x.dm_id for x in r.before], [x.dm_id for x in r.after]) for r in sampling.neighbours(m).collect()}
    assert got[2] == ([0, 1], [4]) and got[5] == ([], [])
    assert {r.n_before for r in sampling.context(m).collect() if r.dm_id == 2} == {2}


# --- consensus and aggregation ------------------------------------------------------------------------------------

OUT = "struct<emotion:struct<label:string,confidence:double>,cooperative_principle:struct<violated:boolean,maxim:string>,interaction_type:struct<label:string,confidence:double>,sentence_function:struct<label:string,confidence:double>,orthography:struct<status:string,confidence:double>>"


def output(e="positive", v=False, i="other", o="standard", c=0.95):
    return ((e, c), (v, None), (i, c), ("fragment", c), (o, c))


def test_divergence(spark):
    a, far, near = output(), output("negative", True, "mocking", "non_standard_typo"), output("negative")
    d = spark.createDataFrame([(1, a, a), (2, a, far), (3, a, near), (4, a, None), (5, None, None)], f"id int, path_a {OUT}, path_b {OUT}")
    r = {x.id: x for x in consensus.reconcile(d).collect()}
    assert r[1].jsd_score == pytest.approx(0, abs=1e-6) and r[1].consensus_level == "high"
    assert r[2].jsd_score > 0.8 and r[2].weight_multiplier == 0.2
    assert 0 < r[3].jsd_score < 0.3 and r[4].jsd_score == 0 and r[4].output.emotion.label == "positive"
    assert r[5].consensus_level == "low" and r[5].output is None


def test_levels_and_merge(spark):
    d = spark.createDataFrame([(x,) for x in (0.05, 0.2, 0.4, 0.6, 0.8)], "j double")
    assert [r[0] for r in d.select(consensus.consensus_level(F.col("j"))).collect()] == ["high", "medium", "medium", "low", "low"]
    a, b = (("positive", 0.98), (False, None), ("other", 0.3), ("fragment", 0.5), ("standard", 0.3)), (("negative", 0.7), (False, None), ("other", 0.9), ("fragment", 0.5), ("standard", 0.9))
    m = spark.createDataFrame([(a, b)], f"path_a {OUT}, path_b {OUT}").select(consensus.merged_output("path_a", "path_b", F.lit("medium")).alias("o")).first().o
    assert m.emotion.label == "negative"


def test_parse_outputs_marks_unknown_labels(spark):
    good = '{"emotion":{"label":"neutral","confidence":0.5},"interaction_type":{"label":"other"},"orthography":{"status":"standard"},"cooperative_principle":{"violated":false,"maxim":"manner"}}'
    rows = consensus.parse_outputs(spark.createDataFrame([(1, good), (2, good.replace("neutral", "angry")), (3, "no json"), (4, good.replace("0.5", "1.5")), (5, None)], "id int, t string"), "t").collect()
    assert [r.valid for r in sorted(rows)] == [True, False, False, False, False] and min(rows).output.cooperative_principle.maxim is None


@pytest.mark.parametrize(("a", "b", "want"), [(list("ppnn"), list("pnnn"), 0.5), (list("aabb"), list("abab"), 0.0), (list("aa"), list("aa"), 1.0)])
def test_kappa(spark, a, b, want):
    assert consensus.cohen_kappa(spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string"), "a", "b").first().kappa == want


def test_wilson(spark):
    d = spark.createDataFrame([(0.5, 40), (0.0, 0), (31 / 39, 39)], "r double, n long")
    got = [tuple(r) for r in d.select(*aggregate.wilson(F.col("r"), F.col("n"))).collect()]
    assert got[0] == (0.352, 0.648) and got[1] == (0.0, 0.0)
    assert 0 < got[2][0] < got[2][1] < 1


# --- statistics ---------------------------------------------------------------------------------------------------


def groups(spark, **g):
    return spark.createDataFrame([(k, float(v)) for k, vs in g.items() for v in vs], "g string, v double")


def test_rank_tests(spark):
    k = statistics.kruskal_wallis(groups(spark, A=[1, 2, 3, 4], B=[5, 6, 7, 8], C=[3, 4, 5, 6]), [], "g", "v").first()
    assert k.k == 3 and k.epsilon_squared == pytest.approx((k.h - 2) / 9, abs=1e-3) and 0 < k.p_value < 0.05
    flat = statistics.kruskal_wallis(groups(spark, A=[1, 1], B=[1, 1]), [], "g", "v").first()
    assert (flat.h, flat.p_value, flat.epsilon_squared) == (0.0, 1.0, 0.0)
    m = statistics.mann_whitney(groups(spark, A=[1, 2], B=[2, 3]), [], "g", "v").first()
    assert m.cliff_delta == -0.75
    m = statistics.mann_whitney(groups(spark, A=[1, 2], B=[3, 4]), [], "g", "v").first()
    assert (m.u, m.cliff_delta, m.magnitude) == (0.0, -1.0, "large") and m.p_value == pytest.approx(1 / 3, abs=1e-6)


def test_cliff_is_the_pair_count(spark):
    rng = random.Random(5)
    a, b = [rng.randint(0, 9) for _ in range(25)], [rng.randint(0, 9) for _ in range(31)]
    want = (sum(x > y for x in a for y in b) - sum(x < y for x in a for y in b)) / (len(a) * len(b))
    assert statistics.mann_whitney(groups(spark, A=a, B=b), [], "g", "v").first().cliff_delta == pytest.approx(want, abs=1e-4)


def test_wilcoxon(spark):
    d = spark.createDataFrame([(0.3 + i / 100, 0.6 + i / 50) for i in range(4)], "x double, y double")
    r = statistics.wilcoxon_paired(d, [], "x", "y").first()
    assert (r.n_pairs, r.statistic, r.p_value) == (4, 0.0, 0.125)
    same = statistics.wilcoxon_paired(spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double"), [], "x", "y").first()
    assert (same.statistic, same.p_value) == (4.5, 1.0)


def test_pvalues_against_tables():
    assert pvalues.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4) and pvalues.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert pvalues.z_of(0.95) == pytest.approx(1.959964, abs=1e-6)
    assert pvalues.mann_whitney_p(2, 5, 5, 0) == pytest.approx(0.0317, abs=1e-3)
    assert pvalues.wilcoxon_p(8, 10, 0) == pytest.approx(0.0488, abs=1e-3)


def test_descriptives_one_value(spark):
    r = statistics.descriptives(spark.createDataFrame([("a", 2.0), ("a", None)], "g string, v double"), ["g"], "v").first()
    assert (r["mean"], r["std"], r["count"], r["q25"]) == (2.0, 0.0, 1, 2.0)


# --- corpus -------------------------------------------------------------------------------------------------------


def test_zone_policy(spark):
    z = spark.createDataFrame([(1, "a", "hot_zone", "t", "p", "d", 100, 0.5, None), (1, "a", "cold_zone", "t", "p", "d", 200, 0.2, 0.4), (1, "b", "cold_zone", "t", "p", "d", 5, 0.3, 0.1)],
                              "snapshot_no int, bvid string, zone_type string, tname string, prompt_version string, pubdate string, danmaku_count long, m1 double, m2 double")
    get = lambda p: {(r.bvid, r.zone_type): (r.danmaku_count, r.m1, r.m2) for r in corpus.observations(z, p, ["m1", "m2"]).collect()}
    assert get("hot_only") == {("a", None): (100, 0.5, None)}
    w = get("weighted")[("a", None)]
    assert w[0] == 300 and w[1] == pytest.approx(0.3) and w[2] == pytest.approx(0.4)
    assert len(get("all")) == 3
    with pytest.raises(ValueError):
        corpus.observations(z, "none")


def test_index(spark):
    i = spark.createDataFrame([("a", "old", "2026-01-01"), ("b", "b", None)], "bvid string, title string, analyzed_at string")
    e = spark.createDataFrame([("a", "new", "2026-07-01")], "bvid string, title string, analyzed_at string")
    assert {(r.bvid, r.title) for r in corpus.upsert(i, e).collect()} == {("a", "new"), ("b", "b")}
    assert [r.bvid for r in corpus.as_of(i, "2026-06-01").collect()] == ["a"]
    g = corpus.partition_gaps(spark.createDataFrame([("x",), ("x",), (" ",), (None,)], "tname string")).collect()
    assert {(r.tname, r.have, r.missing) for r in g} == {("x", 2, 1), ("unknown", 2, 1)}


# --- problems 3 and 4 ---------------------------------------------------------------------------------------------

SNAP = "snapshot_no int, bvid string, zone_type string, tname string, prompt_version string, danmaku_count long, delivered_at timestamp, " + ", ".join(f"{m} double" for m in MEASURES)


def snap(no, bvid, zone="hot_zone", name="t", version="v", n=1, **m):
    return (no, bvid, zone, name, version, n, None, *[m.get(x, 0.5) for x in MEASURES])


def changes(spark, rows, **kw):
    d = spark.createDataFrame(rows, SNAP).withColumn("low", F.lit(1)).withColumn("span", F.lit("clash"))
    return {(r.snapshot_no, r.bvid, r.change_type, r.field) for r in snapshot_changes(d, **kw).collect()}


def test_snapshot_changes(spark):
    m = MEASURES[0]
    rows = [snap(1, "a"), snap(1, "b"), snap(1, "c"), snap(1, "d", **{m: None}), snap(1, "f", n=None), snap(3, "a"), snap(3, "b", n=2, name="u"), snap(3, "b", n=2, name="u"), snap(3, "e"),
            snap(3, "d", **{m: None, MEASURES[1]: 0.5 + 1e-12, MEASURES[2]: None}), snap(3, "f", n=None, version=None), snap(None, "a"), snap(3, None)]
    assert changes(spark, rows) == {(3, "c", "removed", ""), (3, "e", "added", ""), (3, "b", "changed", "tname"), (3, "b", "changed", "danmaku_count"), (3, "d", "changed", MEASURES[2]), (3, "f", "changed", "prompt_version")}


def test_snapshot_changes_empty_and_single(spark):
    assert changes(spark, []) == set() and changes(spark, [snap(1, "a")]) == set()


def test_snapshot_zones_are_averaged_and_nan_is_null(spark):
    m = MEASURES[0]
    rows = [snap(1, "a", "hot_zone", **{m: 0.2}), snap(1, "a", "cold_zone", **{m: 0.4}), snap(2, "a", "hot_zone", n=2, **{m: 0.3}), snap(1, "b", **{m: float("nan")}), snap(2, "b", **{m: None})]
    assert changes(spark, rows) == set()


def test_ordinals_are_dense_and_persistent(spark):
    k = spark.createDataFrame([(f"k{i % 50}",) for i in range(500)] + [(None,)], "key string")
    a = assign_ordinals(k, "key")
    first = {r["key"]: r["ordinal"] for r in a.collect()}
    assert sorted(first.values()) == list(range(50))
    b = {r["key"]: r["ordinal"] for r in assign_ordinals(spark.createDataFrame([("new",), ("k1",)], "key string"), "key", known=a).collect()}
    assert b == first | {"new": 50}
    assert assign_ordinals(k.limit(0), "key").count() == 0


def test_bitmap_containers():
    rng = np.random.default_rng(0)
    for n, m in ((5, 3000), (3000, 2500), (10, 20), (0, 5)):
        a, b = set(rng.choice(4096, n, replace=False)), set(rng.choice(4096, m, replace=False))
        x, y = Container(np.array(sorted(a), dtype=int)), Container(np.array(sorted(b), dtype=int))
        assert set(x.and_not(y)) == a - b and set(x.intersect(y)) == a & b and set(x.members()) == a


def test_dense_totals(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9000)}", rng.choice([None, 1, 5]), "x") for _ in range(20_000)] + [(None, 3, "x")] * 5
    d = spark.createDataFrame(rows, "key string, v int, low string").repartition(5)
    want = {}
    for k, v, _ in rows:
        if k is not None:
            n, s = want.get(k, (0, 0))
            want[k] = (n + 1, s + (v or 0))
    for flush in (500_000, 100):
        assert {r["key"]: (r["n"], r["sum_v"]) for r in dense_totals(d, "key", ["v"], flush).collect()} == want
    assert dense_totals(d.limit(0), "key").count() == 0


def test_jsd_is_symmetric_and_bounded(spark):
    a, b = output("positive", c=0.8), output("neutral", True, c=0.6)
    d = spark.createDataFrame([(a, b), (b, a)], f"path_a {OUT}, path_b {OUT}")
    x, y = (r[0] for r in d.select(consensus.jsd_score("path_a", "path_b")).collect())
    assert x == pytest.approx(y) and 0 <= x <= 1 and math.isfinite(x)


def test_closed_form_equals_arrays(spark):
    labels = consensus.EMOTION
    cases = [(a, x, b, y) for a in ("positive", "neutral", "odd", None) for b in ("positive", "negative", "odd", None) for x, y in ((0.9, 0.4), (1.0, 0.5))]
    d = spark.createDataFrame(cases, "a string, x double, b string, y double")
    c = [F.col(n) for n in "axby"]
    want = consensus.normalised_jsd(consensus.distribution(c[0], c[1], labels), consensus.distribution(c[2], c[3], labels))
    for r in d.select(want.alias("w"), consensus.categorical_jsd(c[0], c[1], c[2], c[3], labels).alias("g")).collect():
        assert r.g == pytest.approx(r.w, abs=1e-9)


# --- corpus comparison --------------------------------------------------------------------------------------------


def observed(spark, rows):
    return spark.createDataFrame(rows, "bvid string, tname string, time_period string, zone_type string, m1 double")


def test_corpus_compare(spark):
    rows = [(f"a{i}", "A", "2025", "hot_zone", 0.1 * i) for i in range(3)] + [(f"b{i}", "B", "2025", "hot_zone", 0.5 + 0.1 * i) for i in range(3)] + [("c", "C", "2025", "hot_zone", 0.1), ("d", " ", "2025", "hot_zone", 0.1)]
    got = compare.corpus_compare(observed(spark, rows), ["m1"]).collect()
    kinds = [r.test_type for r in got]
    assert kinds.count("sample_status") == 3 and kinds.count("kruskal_wallis") == 1 and kinds.count("mann_whitney") == 1 and len(got) == 5
    assert {r.note for r in got if r.group1 == "C"} == {"insufficient_sample"} and [r.effect_size for r in got if r.test_type == "mann_whitney"] == [-1.0]


def test_corpus_compare_axes(spark):
    by_year = [(f"{y}{i}", "A", y, None, 0.1 * i + int(y) - 2024) for y in ("2024", "2025") for i in range(3)]
    got = compare.corpus_compare(observed(spark, by_year), ["m1"]).collect()
    assert {r.group1 for r in got if r.test_type == "sample_status"} == {"2024", "2025"} and all("axis: period" in r.note for r in got if r.test_type == "kruskal_wallis")
    zones = [(f"v{i}", "A", "2025", z, x + 0.01 * i) for i in range(4) for z, x in (("hot_zone", 0.3), ("cold_zone", 0.6))]
    p = [r for r in compare.corpus_compare(observed(spark, zones), ["m1"]).collect() if r.test_type == "wilcoxon_paired"]
    assert [(r.n1, r.effect_size) for r in p] == [(4, -1.0)]
    few = [r.test_type for r in compare.corpus_compare(observed(spark, zones[:4]), ["m1"]).collect()]
    assert few.count("wilcoxon_paired") == 0


def test_compare_two_and_prefixes(spark):
    r = compare.compare_two(groups(spark, A=[1, 2, 3, 4, 5], B=[11, 12, 13, 14, 15]), "g", "v").collect()
    assert len(r) == 2 and all(x.significant for x in r)
    w = spark.createDataFrame([("t", 1, 0.2, 0.5), ("t", 3, 0.6, None)], "tname string, danmaku_count long, pos_n double, syl_one double")
    assert {(x.family, x.metric, round(x["mean"], 6)) for x in compare.prefix_means(w, ["pos_n", "syl_one"]).collect()} == {("pos", "pos_n", 0.5), ("syl", "syl_one", 0.5)}
