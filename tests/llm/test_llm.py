import json
import os
import random
import string
from collections import Counter

import numpy as np
import pytest
from compare import check, connection
from pyspark.sql import functions as F

from tidemark.llm import abuse, catalogue, copies, leaks, lookalikes, packing, runs, terms, truncation

SF = "/root/testdata/sf0.001"
LONG = "长句子" * 60_000
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COMMENT = "dm_id long, bvid string, seq long, uid_hash string, content string, time_sec double, identity_type string, n string, digest string, term string, form string, id long, score string, suffix string"


def comments(spark, rows):
    """rows: (id, user, text, time[, identity[, bvid[, seq]]]); the other columns clash with names used inside the operators."""
    full = []
    for r in rows:
        i, u, t, s, ident, b, q = (*r, *(["real_user", "v", r[0]][len(r) - 4 :]))
        full.append((i, b, q, u, t, s, ident, "c", "c", "c", "c", 9, "c", "c"))
    return spark.createDataFrame(full, COMMENT)


@data
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    check(spark, connection(SF), SF, catalogue.queries()[name], catalogue.oracle_sql()[name])


@data
@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0


# --- 1: look-alikes -----------------------------------------------------------------------------------------------


def test_lookalike_forms(spark):
    plain = ["Fête Lumette", "ガラス", "등대 극장 2", "山水 No.5", "Café"]
    odd = ["Ｆêｔｅ　Ｌｕｍｅｔｔｅ", "ｶﾞﾗｽ", "등대 극장 2", "⼭⽔ Νο.5", "Cаfе́", "Ca​fé"]
    other = ["fête lumette", "Fete Lumette", "등대 극장 3", "山水 No.55", None, "", LONG]
    t = spark.createDataFrame([(s,) for s in plain * 3 + odd + other], "content string")
    reps = lookalikes.representatives(t, "content")
    rewrite = lookalikes.Rewriter(reps)
    form = {s: rewrite(s) for s in plain + odd + other if s is not None}
    for a, b in zip(odd, [*plain, "Café"], strict=True):
        assert form[a] == form[b], (a, b)
    assert len({form[s] for s in plain} | {form[s] for s in other if s}) == len(plain) + 5
    assert rewrite(rewrite("Ｆêｔｅ")) == rewrite("Ｆêｔｅ")
    got = lookalikes.unify(t.withColumn("form", F.lit(1)), "content", reps, ["content"]).collect()
    assert len(got) == len(plain) * 3 + len(odd) + len(other) and [r.form for r in got if r.content is None] == [None] and len([r for r in got if r.form == LONG]) == 1
    assert lookalikes.representatives(t.limit(0), "content")["Ａ"] == "A"


def test_lookalike_strings_are_counted_everywhere(spark):
    """A string that many plain texts hold stands for its class, not the one ligature."""
    t = spark.createDataFrame([("final fit fine",)] * 1000 + [("ﬁn",)], "content string")
    reps = lookalikes.representatives(t, "content")
    assert reps["ﬁ"] == "fi" and "fi" not in reps
    rewrite = lookalikes.Rewriter(reps)
    assert rewrite("ﬁn") == rewrite("fin") == "fin"
    assert rewrite("ﬁ" * 50 + "á̂" * 50) == rewrite(rewrite("ﬁ" * 50 + "á̂" * 50))


def test_lookalike_classes_are_disjoint_and_transitive():
    seen = Counter(m for c in lookalikes.look_classes() for m in c)
    assert max(seen.values()) == 1
    of = {m: i for i, c in enumerate(lookalikes.look_classes()) for m in c}
    assert of["а"] == of["ａ"] == of["a"] and of["é"] == of["é"] and of["\u0450"] == of["\u00e8"] and of["a"] != of["A"]


# --- 2: terms -----------------------------------------------------------------------------------------------------


def brute_counts(texts, sigma):
    occ, rec = Counter(), Counter()
    for t in texts:
        if t is None:
            continue
        w = [x for x in t.split(" ") if x]
        grams = [tuple(w[i : i + k]) for k in range(1, sigma + 1) for i in range(len(w) - k + 1)]
        occ.update(grams)
        rec.update(set(grams))
    return {" ".join(g): (len(g), occ[g], rec[g]) for g in occ}


@pytest.mark.parametrize("sigma", [1, 2, 4])
def test_suffix_counts(spark, monkeypatch, sigma):
    rng = random.Random(sigma)
    texts = [" ".join(rng.choice(["hot", "a", "b\tc", "ü", "\x01"]) for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "", "   ", "hot hot hot", "hot " * 30_000]
    d = spark.createDataFrame([(t,) for t in texts], "content string").withColumn("term", F.lit("x")).withColumn("suffix", F.lit(1)).repartition(3)
    got = {r.term: (r.n, r.occurrences, r.records) for r in terms.suffix_counts(d, "content", sigma).collect()}
    assert got == brute_counts(texts, sigma)
    assert terms.suffix_counts(d.limit(0), "content", sigma).count() == 0


def test_marks(spark):
    d = spark.createDataFrame([("a",), ("a b",), ("a c",)], "content string")
    got = {r.term: r.mark for r in terms.marked(terms.suffix_counts(d, "content"), 1000).collect()}
    assert got == {"a": "", "b": "rare", "c": "rare"}
    assert {r.mark for r in terms.marked(terms.suffix_counts(d, "content"), 3).collect()} == {"common", "common rare"}
    v = {r.term: r.occurrences for r in terms.suffix_counts(d.union(d.limit(1)), "content", whole=True).collect()}
    assert v["a b"] == 1 and sum(v.values()) == 4


# --- 5: abuse -----------------------------------------------------------------------------------------------------


@data
def test_abuse_held_out(spark):
    """Labelled texts that the fit has not seen, at the shipped threshold: the other parts are the labels, all texts the collection."""
    m = spark.read.parquet(f"{SF}/moderation_samples.parquet").where("rater_a = rater_b")
    part = F.pmod(F.xxhash64("content"), F.lit(4)) == 0
    test = spark.read.parquet(f"{SF}/comments.parquet").select("dm_id", "content", F.lit(None).cast("int").alias("y"))
    test = test.unionByName(m.where(part).select(F.lit(-1).cast("long").alias("dm_id"), "content", F.col("rater_a").alias("y")))
    got = abuse.scored(test, "content", ["y"], m.where(~part)).where("y is not null").collect()
    bad, said = [r.score >= abuse.THRESHOLD for r in got if r.y == 1], [r for r in got if r.score >= abuse.THRESHOLD]
    assert len(bad) > 50 and sum(bad) / len(bad) >= 0.9
    assert sum(r.y == 1 for r in said) / len(said) >= 0.95


def abuse_samples(spark, more=()):
    bad, good = ["you idiot", "such an idiot you are"] * 6, ["nice video", "great music here"] * 6
    rows = [(t, 1, 1) for t in bad] + [(t, 0, None) for t in good] + [(None, 1, 1), ("", 0, 0), ("x", 1, 0), ("y", None, None), *more]
    return spark.createDataFrame(rows, "content string, rater_a int, rater_b int")


def test_abuse_edges(spark):
    s = abuse_samples(spark)
    m = abuse.train(s)
    a, b, none = m.worst(["what an i\u200bdIOt you are", "nice music", "！！"])
    assert a > b and none == abuse.NOTHING
    c = comments(spark, [(1, "u", None, 1.0), (2, "u", " ", 1.0), (3, "u", LONG, 1.0), (4, "u", "you idiot", None), (4, "u", "you idiot", None), (5, "u", "nice video", 1.0)])
    got = [(r.dm_id, r.score) for r in abuse.scored(c, "content", ["dm_id"], s).collect()]
    assert len(got) == 6 and all(0 <= x <= 1 for _, x in got) and dict(got)[1] == 0 and dict(got)[2] == 0 and dict(got)[4] >= 0.5 > dict(got)[5]
    assert all(x < 1e-9 for (x,) in abuse.scored(c, "content", [], s.limit(0)).collect())
    assert abuse.scored(c.limit(0), "content", ["dm_id"], s).count() == 0


def test_abuse_windows():
    """Windows are the whole, the clauses and pieces of bounded width; the sums over them are those of their n-grams."""
    texts = ["only a d3generate would edit like this!! does it", "", "废．物一个，你妈没教过你吗", "Ѕоrіѕ is 12:30", "！！！", "x" * 3000, "a\nb " * 40]
    w = abuse.Windows(texts)
    assert set(w.text.tolist()) == {0, 2, 3, 5, 6} and len(abuse.Windows(texts, whole=True).spans) == 5
    rows, keys = w.grams(np.arange(len(w.spans)))
    v = abuse.Vocabulary(np.unique(keys)[::3])
    m = abuse.Model(0.5, v, np.random.default_rng(1).normal(size=len(v.keys)))
    want = 0.5 + np.bincount(rows, weights=m.weight_of(keys), minlength=len(w.spans))
    assert np.allclose(w.sums(m), want)
    one = np.concatenate([m.worst([t]) for t in texts])
    assert np.allclose(m.worst(texts), one)
    same = m.worst(["Ѕоrіѕ said", "soris said", "s\u200boris SAID"])
    assert same[0] == same[1] == same[2]


@data
def test_abuse_keeps_harmless_texts(spark):
    """Comments with a text that both raters call harmless, many with words of abuse in them, are not reported at the shipped threshold."""
    large = SF.replace("0.001", "0.1")
    samples, c = spark.read.parquet(f"{large}/moderation_samples.parquet"), spark.read.parquet(f"{large}/comments.parquet")
    good = samples.where("rater_a = 0 and rater_b = 0").select(F.trim("content").alias("content")).distinct()
    got = abuse.scored(c, "content", ["content"], samples).withColumn("content", F.trim("content")).join(good, "content")
    reported = F.count_if(F.col("score") >= abuse.THRESHOLD)
    n, bad = got.agg(F.count("*"), reported).first()
    assert n > 10_000 and bad <= 0.001 * n


def test_abuse_does_not_depend_on_copies(spark):
    """The same text gets the same logit however often the collection holds texts; the ratios see shares of distinct texts."""
    s = abuse_samples(spark)
    few = comments(spark, [(i, "u", f"fine work {i}", 1.0) for i in range(20)] + [(99, "u", "what a foolish idjot", 1.0)])
    hot = few.unionByName(comments(spark, [(1000 + i, "u", "what a foolish idjot", 1.0) for i in range(500)]))
    a, b = abuse.train(s, few), abuse.train(s, hot)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)
    score = lambda c: {r.content: r.score for r in abuse.scored(c, "content", ["content"], s).collect()}
    assert score(few) == score(hot)


def test_abuse_wordings(spark):
    """N-grams that come with found texts in the collection are marked and lift texts that share them; those that come anywhere are not."""
    found = [f"this {w} belongs in a muzzle" for w in ("idiot", "moron", "loser", "scumbag")]
    plain = [f"this {a} is {b}" for a in ("river", "garden", "window", "ladder", "pocket", "castle") for b in ("blue", "quiet", "wide", "old")]
    rows = [(t, 5.0) for t in found] + [(t, -6.0) for t in plain] + [("this fellow belongs in a muzzle", -3.0), ("！！", abuse.NOTHING)]
    judged = spark.createDataFrame(rows, "t string, logit double")
    model = abuse.Model(-3.0).marking(abuse.wordings(judged, 0.0))
    lifted, same, whole = model.worst(["this fellow belongs in a muzzle", "this river is wide", "muzzle"])
    assert -3.0 + abuse.GAIN / 3 < lifted < -3.0 + abuse.GAIN and whole > lifted and abs(same + 3.0) < 0.1
    assert not len(abuse.wordings(judged, 9.0)) and not len(abuse.wordings(judged.limit(0), 0.0))


def test_abuse_counts_once_per_text(spark):
    known = abuse.vocabulary(["abcabc", "xyz"])
    held, n = abuse.counts(spark.createDataFrame([("abcabc abc",), ("xy",), ("！！",), ("no",)], "t string"), known)
    w = abuse.Windows(["abcabc abc", "xy", "！！", "no"], whole=True)
    rows, keys = w.grams(np.arange(len(w.spans)))
    at, which = known.find(keys)
    want = Counter(k for _, k in set(zip(rows[at].tolist(), which.tolist(), strict=True)))
    assert n == 4 and {i: int(x) for i, x in enumerate(held) if x} == want


def test_abuse_cut():
    hill = {i: int(4000 * 0.5 ** abs(i + 40)) + 3 for i in range(-60, 80)}
    cut = abuse.cut_of(hill, np.array([5.0]))
    at = round(cut / abuse.BIN)
    over = sum(max(n - 3, 0) for i, n in hill.items() if i >= at)
    assert cut < 0 and over <= 0.03 * sum(n for i, n in hill.items() if i >= at)
    assert abuse.cut_of(hill | {10: 50_000}, np.array([5.0])) <= cut  # a hot bin among the abusive texts does not raise it
    assert abuse.cut_of({}, np.array([1.0])) == 0.0 and abuse.cut_of({-5: 9}, np.zeros(0)) == 0.0 and abuse.cut_of({3: 9}, np.array([1.0])) == 0.0


# --- 6: runs ------------------------------------------------------------------------------------------------------


def test_near_equality():
    same = lambda a, b: runs.nearly_equal(copies.plain_text(a), copies.plain_text(b), a, b)
    assert same("Ha ha!", "haha") and same("哈哈哈哈", "哈") and same("来了来了", "来了") and same("2333333", "2333") and not same("233", "2333")
    assert same("abcdefghij", "abcdefghij x") and same("abcdefghij", "abcdefgihj") and not same("abcdefghij", "abcdefghxy") and not same("abcdefgh1", "abcdefgh2") and not same("abc", "abd")
    assert same("！！！", "！") and not same("！！", "？") and not same("！", "a")


def test_one_edit_by_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
        near = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "ab"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "ab"}
        near |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
        assert runs.one_edit(a, b) == (b in near)


def brute_runs(rows):
    ok = [r for r in rows if r[2] and r[2].strip() and r[3] is not None and r[1] is not None]
    best = {}
    for i, u, t, s, *_ in ok:
        k = (copies.plain_text(u), copies.plain_text(t), s)
        best[k] = min(best.get(k, (i, t)), (i, t))
    order = sorted((k[0], round(k[2] * 1000), i, k[1], t) for k, (i, t) in best.items())
    return {(min(a[2], b[2]), max(a[2], b[2])) for a, b in zip(order, order[1:], strict=False) if a[0] == b[0] and b[1] - a[1] <= 60_000 and runs.nearly_equal(a[3], b[3], a[4], b[4])}


def test_runs_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["u", "U ", "w", None]), rng.choice(["哈哈", "哈哈哈", "!!", "！", "ok", "OK!", None, " "]), rng.choice([None, rng.randint(0, 4000) / 2])) for i in range(1500)]
    rows += [(5000 + i, "hot", "same text", 590.0 + i * 7) for i in range(300)] + [(9000, "hot", LONG, 1.0), (9001, "hot", LONG, 2.0)]
    c = comments(spark, rows)
    want = brute_runs(rows)
    events = runs.viewer_events(c)
    assert {tuple(r) for r in runs.run_pairs(events).collect()} == want
    r = runs.collapse_runs(events).collect()
    assert sum(x.events for x in r) == events.count() and len(r) == events.count() - len(want) and all(x.first_id is not None for x in r)
    hot = [x for x in r if x.first_id == 5000]
    assert (hot[0].events, hot[0].duration_ms) == (300, 299 * 7000)
    assert runs.collapse_runs(runs.viewer_events(c.limit(0))).count() == 0 and runs.run_pairs(runs.viewer_events(c.limit(0))).count() == 0


def test_runs_of_a_hot_viewer_are_spread(spark):
    """One viewer's events within one minute fill several slices, and a run goes on across all of them."""
    c = comments(spark, [(i, "bot", f"go{'!' * (i % 3)}" if i < 2500 else "stop it", 5 + i / 100) for i in range(4000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = runs.run_members(runs.viewer_events(c))
        assert max(x["count"] for x in r.members.groupBy("part").count().collect()) < 2000 and len(r.links) == 3
        got = sorted((x.first_id, x.events) for x in runs.collapse_runs(runs.viewer_events(c)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(0, 2500), (2500, 1500)]
    assert runs.run_pairs(runs.viewer_events(c)).count() == 3998


# --- 7: copies ----------------------------------------------------------------------------------------------------


def test_copies(spark, monkeypatch):
    rows = [(1, "AB-1", "Hi, there!", 1.0), (2, "ab1", "hi there", 1.0), (3, "ab1", "hi there", 1.5), (4, None, "hi there", 1.0), (5, "ab1", None, 1.0), (6, "ab1", "　", 1.0), (7, "ab1", "Hi​there～", 1.0),
            (8, "ab1", "hithere", None), (9, "ab1", "hi there", 1.0, "unknown_device"), (10, "x", LONG, 0.0), (11, "x", LONG + "!", -0.0), (12, "x", "é", 0.0)]
    c = comments(spark, rows)
    want = {(1, 2), (1, 7), (10, 11)}
    assert {tuple(r) for r in copies.copy_links(copies.comment_records(c)).collect()} == want
    many = comments(spark, [(i, "u", "copy" if i % 3 else f"t{i}", 1.0) for i in range(9000)]).unionByName(c)
    monkeypatch.setattr(copies, "HEAVY", 0)
    a = copies.copy_links(copies.comment_records(many)).count()
    monkeypatch.setattr(copies, "HEAVY", 1)
    assert copies.copy_links(copies.comment_records(many)).count() == a == 5999 + 3
    assert copies.copy_links(copies.comment_records(c.limit(0))).count() == 0


def test_nested_json_copies(spark):
    v = {"bvid": "v", "time_sec": 1, "uid_hash": "U", "content": "a b", "identity_type": "real_user", "x": {"p": [1, {"q": "Z!"}], "r": None}}
    same = {"x": {"r": None, "p": [1.0, {"q": "z"}]}, "content": "A-B", "identity_type": "real-user", "uid_hash": "u", "time_sec": 1.0, "bvid": "v"}
    assert copies.merkle_json(v) == copies.merkle_json(same) and copies.canonical_json(v) == copies.canonical_json(same)
    assert copies.merkle_json(v) != copies.merkle_json(v | {"x": {"p": [{"q": "Z!"}, 1], "r": None}})
    rows = [(1, json.dumps(v)), (2, json.dumps(v | {"content": "AB."}, indent=1)), (3, json.dumps(v)[:-3]), (4, "[1]"), (5, None), (6, json.dumps(v) + " x"), (7, json.dumps(v | {"time_sec": None})), (8, json.dumps(v).replace("1,", "NaN,", 1))]
    d = spark.createDataFrame(rows, "raw_id long, payload string").withColumn("digest", F.lit("c"))
    assert {tuple(r) for r in copies.copy_links(copies.payload_records(d)).collect()} == {(1, 2)}


def test_payload_copies_by_field(spark):
    """Videos whose ids differ in case are different; fields that do not make a record hide no copy."""
    v = {"bvid": "BV1aBcD", "time_sec": 1, "uid_hash": "U-1", "content": "a b", "identity_type": "real_user"}
    rows = [(1, v), (2, v | {"bvid": "BV1AbCd"}), (3, v | {"note": None}), (4, v | {"time_sec": 1.0, "uid_hash": "u1", "content": "AB!"}), (5, v | {"bvid": "BV1aBcD "})]
    d = spark.createDataFrame([(i, json.dumps(x)) for i, x in rows], "raw_id long, payload string")
    assert {tuple(r) for r in copies.copy_links(copies.payload_records(d)).collect()} == {(1, 3), (1, 4)}


# --- 8: packing ---------------------------------------------------------------------------------------------------


def test_plan_uses_every_item_once():
    rng = random.Random(4)
    for _ in range(60):
        h = {rng.randint(1, 2048): rng.randint(1, 300) for _ in range(rng.randint(0, 200))}
        used = Counter()
        for k in packing.plan(h):
            assert k.size in packing.SIZES and k.bins > 0 and sum(x * n for x, n in k.parts) == k.size - k.free <= k.size
            assert k.size == min(s for s in packing.SIZES if s >= k.size - k.free)
            for x, n in k.parts:
                used[x] += n * k.bins
        assert used == h
    with pytest.raises(ValueError):
        packing.plan({4000: 1})


def test_pack(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["film", "scene", "木头", "!"]) for _ in range(rng.randint(1, 400))) for _ in range(300)] + [None, "", "a", "a", "word " * 9000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit("c")).withColumn("id", F.lit("c")).repartition(4)
    p = packing.pack(d, "doc_id", "text").toPandas()
    sizes = packing.token_counts(texts)
    assert p.groupby("doc_id").tokens.sum().to_dict() == dict(enumerate(sizes))
    assert set(p[p.tokens == 0].doc_id) == {300, 301} and p[p.tokens == 0].container_id.isna().all()
    assert all(len(g) == 1 for i, g in p.groupby("doc_id") if sizes[i] <= 2048) and (p[p.doc_id == 304].tokens.iloc[:-1] == 2048).all()
    boxes = p.dropna().groupby("container_id").agg(used=("tokens", "sum"), size=("container_size", "max"))
    assert (boxes.used <= boxes["size"]).all() and boxes.used.sum() / boxes["size"].sum() > 0.95
    assert packing.pack(d.limit(0), "doc_id", "text").count() == 0


# --- 9: leaks -----------------------------------------------------------------------------------------------------


def distance(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def test_bit_parallel_distance():
    rng = random.Random(6)
    for _ in range(500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        d = distance(p, t)
        assert leaks.best_match(p, t, d)[0] == d and leaks.best_match(p, t, d - 1) is None
        assert leaks.best_match([*p], [*t], d) == leaks.best_match(p, t, d)


def test_leak_search_misses_nothing_within_its_budget():
    """Changed, missing and additional words at every rate: the same items as by the distance to every window of every item."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 60)))) for i in range(30)]
    search = leaks.Searcher(items)
    found = 0
    for n in range(600):
        i, body = rng.choice(items)
        w = body.split()
        lo = rng.randint(0, len(w) // 2)
        w = w[lo : lo + rng.randint(len(w) // 2, len(w))]
        every = rng.choice([2, 3, 4, 5, 6, 8, 11, 15, 99])
        for k in range(every - 1, len(w), every):
            w[k] = rng.choice([word(), "", f"{w[k]} {word()}", w[k][::-1]])
        doc = " ".join([*(word() for _ in range(rng.randint(0, 30))), *w, *(word() for _ in range(rng.randint(0, 30)))])
        text = leaks.words(doc)
        want = sorted(k for k, it in search.items.items() if any(distance(it.words[a:b], text) <= most for a, b, most in it.windows)) if n < 60 else None
        got = sorted(search.find(doc))
        if want is None:
            it = search.items[i]
            want = [i] if any(distance(it.words[a:b], text) <= most for a, b, most in it.windows) else []
            assert not want or i in got
        else:
            assert got == want
        found += bool(want)
    assert 100 < found < 590


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    """An instruction that few items share is left aside whichever block they come into."""
    ask = "Read the following passage with all due care and answer"
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    items = spark.createDataFrame([(k, f"{ask}: {body(k)}") for k in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ask + " nothing"), (2, body(3)), (3, body(1)[:25]), (4, body(0).upper())], "doc_id long, text string")
    run = lambda: sorted(map(tuple, leaks.leaked(docs, "doc_id", "text", items, "item_id", "text").collect()))
    whole = run()
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 2)
    assert run() == whole == [(0, 4), (3, 2)]


def test_leaks(spark):
    a = "Children in Pennmere tied shadow puppets to the railing and counted to 4 before going home. The grandfather of Kasoro kept a shop in Brackby for 38 years with only bell moulds on the counter."
    b = "据桦坳的账本记载，漆盒的学徒要先劈1007根竹篾才准碰刀。1959年的一封信提到，小橙曾把51件草靴埋在菜市场的第1级台阶下。"
    items = [(1, "Choose one: " + a), (2, "Choose one: " + b), (3, "Choose one: short one"), (4, None), (5, ""), (6, "Choose one: " + a[:92].replace("4", "57").replace("Pennmere", "Oldcombe") + " By the winter of 1948 only 16 families made wooden type.")]
    pad = "The rain moved the harbour shoot indoors, which made the pacing look odd. "
    docs = [(1, pad + a + pad), (2, pad + a.upper().replace(". ", "!\n> ").replace("tied", "perhaps")), (3, pad + a[40:170]), (4, pad + a[:50]), (5, b.replace("，", "\n")), (6, None), (7, ""), (8, LONG + b), (9, "Choose one: " + pad),
            (10, pad + a[:92].replace("4", "31").replace("Pennmere", "Wickby").replace("shadow puppets", "straw boots")), (1, pad + a)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("c"))
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, leaks.leaked(d, "doc_id", "text", q, "item_id", "text").where(F.col("item_id").isin(1, 2)).collect()))
    assert got == [(1, 1), (1, 1), (1, 2), (1, 3), (2, 5), (2, 8)]
    assert leaks.leaked(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0 and leaks.leaked(d.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0


# --- 10: truncation -----------------------------------------------------------------------------------------------


def test_truncation(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 8)))
    openings = ["the crew said", "we watched it", "nobody knew why"]
    text = lambda: " ".join(f"{rng.choice(openings)} {' '.join(word() for _ in range(rng.randint(4, 9)))}." for _ in range(rng.randint(3, 30)))
    rows, cut = [], set()
    for i in range(900):
        t, source = text(), rng.choice(["feed", "free", None])
        if source == "feed" and len(t) > 200:
            t = t[:200]
            if not t.rstrip().endswith("."):
                cut.add(i)
        elif i % 5 == 0:
            t += rng.choice(["\nThanks for watching <3", " #a #b", "\n— Ada", " 🎉🎉"])
        rows.append((i, source, t))
    rows += [(901, "free", rows[0][2] + " and so�"), (902, "free", None), (903, "free", ""), (904, "free", "  \n"), (905, "free", (text() + " ") * 3000 + "the crew sa")]
    cut |= {901, 905}
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("len", F.lit("c")).withColumn("state", F.lit("c"))
    got = {r.doc_id: r.cause for r in truncation.truncated(d).collect()}
    assert set(got) == cut and all(got[i] == "limit" for i in cut if i < 900)
    s = {(r.source, r.unit, r.len) for r in truncation.length_tests(truncation.endings(d)).where("significant").collect()}
    assert ("feed", "chars", 200) in s
    assert truncation.truncated(d.limit(0)).count() == 0


def test_truncation_with_hot_copies(spark):
    """Copies of one cut text make its opening no closing, neither for themselves nor for other texts; at a limit no opening excuses."""
    go_on = [(i, "free", f"Nobody knew why number {i} was there. The tide took {'it ' * (i % 7)}away.") for i in range(20)]
    hot = [(100 + i, "free", "A quiet start. Nobody knew why the harbour") for i in range(200)]
    other = [(400, "free", "Rain again. Nobody knew how the")]
    limited = [(500 + i, "feed", f"Report {i} ends here. Zqx and then {chr(97 + i) * 200}"[:200]) for i in range(12)]
    d = spark.createDataFrame(go_on + hot + other + limited, "doc_id long, source string, text string")
    got = {r.doc_id for r in truncation.truncated(d).collect()}
    assert got >= {r[0] for r in hot + other}
    uses = {(r.kind, r.key): (r["last"], r.inner) for r in truncation.phrase_uses(truncation.endings(d.where("doc_id < 400"))).collect()}
    assert uses["opening", "nobody knew "] == (1, 20)
    assert got >= {500 + i for i in range(12)}


def test_truncation_rows_follow_hazards(spark, monkeypatch):
    """Texts in words of their own show their cut by their length alone: without significant lengths they are not found."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(5, 9)))
    text = lambda: " ".join(" ".join(word() for _ in range(rng.randint(5, 9))) + "." for _ in range(12))
    rows = [(i, "feed", text()[:250]) for i in range(60)] + [(100 + i, "free", text()) for i in range(300)] + [(900 + i, "free", text() + "\nWritten by hand with care") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = {i for i, _, t in rows[:60] if not t.rstrip().endswith(".")}
    got = {r.doc_id: r.cause for r in truncation.truncated(d).collect()}
    assert {i for i, c in got.items() if c == "limit"} == want and set(got) <= set(range(60))
    real = truncation.length_tests
    monkeypatch.setattr(truncation, "length_tests", lambda ends: real(ends).withColumn("significant", F.lit(False)))
    short = {i for i in want if len(rows[i][2].split(".")[-1].strip()) < 4}  # the beginning of a word alone
    assert want & {r.doc_id for r in truncation.truncated(d).collect()} == short


def test_length_hazards_against_brute_force(spark):
    """Expected counts follow the texts alive at each length; a limit on a steep slope shows."""
    rng, alive, sizes = random.Random(2), 20_000, Counter()
    for n in range(1, 120):
        sizes[n] = max(1, int(alive * 0.05) + rng.randint(-2, 2)) if alive > 0 else 0
        alive -= sizes[n]
    sizes[60] *= 6
    sizes = {n: k for n, k in sizes.items() if k > 0}
    rows = [(f"{n}-{i}", "s", n, n, hash((n, i))) for n, k in sizes.items() for i in range(k)]
    d = spark.createDataFrame(rows, "doc_id string, source string, chars int, bytes int, same long")
    got = {r.len: r for r in truncation.length_tests(d).where("source = 's' and unit = 'chars'").collect()}
    living = [sum(k for n, k in sizes.items() if n >= x) for x in range(500)]
    for n, r in got.items():
        near = [x for x in range(n - 40, n + 41) if x >= 0 and abs(x - n) >= 4]
        assert r.expected == pytest.approx(living[n] * sum(sizes.get(x, 0) for x in near) / sum(living[x] for x in near))
    assert {n for n, r in got.items() if r.significant} == {60}
