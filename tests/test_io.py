import json
import os
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.cli import main
from tidemark.settings import DEFAULT
from tidemark.sinks import tables as K
from tidemark.sources import reports as R
from tidemark.streaming import streams


def archive(path, meta, **tables):
    with zipfile.ZipFile(path, "w") as z:
        if meta is not None:
            z.writestr("metadata.json", json.dumps(meta))
        for name, text in tables.items():
            z.writestr(f"{name}.csv", "﻿" + text)


@pytest.fixture
def folder(tmp_path):
    archive(tmp_path / "a.zip", {"bvid": "A", "tname": "", "partitions": ["P"]}, table_emotion="tname,zone_type,danmaku_count,positive,note\nP,hot_zone,3,0.5,x\nP,cold_zone,1,0.1,2\n",
            danmaku_raw="uid_hash,content,time_sec,identity_type\nu,hi,1.5,real_user\nw,yo,bad,real_user\n")
    archive(tmp_path / "b.zip", None, table_emotion="tname,zone_type\n")
    (tmp_path / "c.zip").write_bytes(b"no archive")
    return str(tmp_path)


def test_archives(spark, folder):
    e = R.zip_entries(spark, f"{folder}/*.zip").cache()
    assert {(os.path.basename(r.path), r.ok) for r in R.valid_archives(e).collect()} == {("a.zip", True), ("b.zip", True), ("c.zip", False)}
    assert [(r.bvid, r.tname) for r in R.metadata(e).collect()] == [("A", "P")]
    got = {(r.zone_type, r.column, r.value) for r in R.zone_measures(e).collect()}
    assert got == {("hot_zone", "positive", 0.5), ("cold_zone", "positive", 0.1)}
    assert {(r.bvid, r.content, r.time_sec) for r in R.raw_comments(e).collect()} == {("A", "hi", 1.5), ("A", "yo", None)}


def test_state_files(spark, tmp_path):
    p = tmp_path / "state.jsonl"
    p.write_text('{"input":"a","status":"done","updated_at":"1"}\nnot json\n{"input":"a","status":"running","updated_at":"2"}\n')
    assert [(r.input, r.status) for r in R.task_states(spark, str(p)).collect()] == [("a", "pending")]
    assert R.corpus_index(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "index.json").write_text('{"schema_version":"1","videos":[{"bvid":"A"}]}')
    assert R.corpus_index(spark, str(tmp_path / "index.json")).first().bvid == "A"
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex" / "w.txt").write_text("词 10 n\nonly\n\n")
    assert {(r.word, r.freq, r.pos) for r in R.lexicon(spark, str(tmp_path / "lex")).collect()} == {("词", 10, "n"), ("only", None, None)}
    spark.range(3).write.parquet(str(tmp_path / "stage"))
    assert R.fresh(spark, str(tmp_path / "stage")).count() == 3


def test_sinks(spark, tmp_path):
    long = spark.createDataFrame([("t", "hot_zone", "b", 0.5), ("t", "hot_zone", "a", 0.5), ("u", "cold_zone", "a", 1.0)], "tname string, zone_type string, label string, ratio double")
    w = K.wide(long, ["tname", "zone_type"], "label", "ratio", "x_")
    assert w.columns == ["tname", "zone_type", "x_a", "x_b"]
    paths = K.write_csv(w, str(tmp_path / "w.csv"), {"tname": "category", "x_": "share_"})
    assert open(paths[0], "rb").read(3) == b"\xef\xbb\xbf" and "share_a" in open(paths[1], encoding="utf-8-sig").readline()
    assert K.pack_zip([*paths, "missing"], str(tmp_path / "o.zip")) and not os.path.exists(paths[0])
    assert not K.pack_zip(["missing"], str(tmp_path / "p.zip"))
    t = K.latex_table(pd.DataFrame({"a_b": ["x&y"], "v": [0.5]}), "c", "l")
    assert r"a\_b" in t and r"x\&y & 0.5" in t
    s = K.apa_descriptives(pd.DataFrame({"tname": ["t"], "video_count": [2], "total_danmaku": [200], "d_mean": [0.5], "d_std": [0.1]}))
    assert "M = 0.500, SD = 0.100" in s and "k = 2, N = 200" in s
    assert K.p_text(0.0001) == "p < .001" and K.p_text(0.012) == "p = .012"
    assert "<rect" in K.html_report("r", {"t": pd.DataFrame({"x": [0.5]})}, {"a": 1}) and K.optional(lambda: 1 / 0) is None
    assert "change points" in K.methodology(DEFAULT) and K.reproducibility(DEFAULT, spark)["settings"]["top_n"] == 10
    h = K.heatmap_json(long.withColumn("dim", F.lit("emotion"))).first()
    assert json.loads(json.loads(h.json)["t_hot_zone"]) == {"a": 0.5, "b": 0.5}


def test_model_calls(spark):
    assert model.extract_json('say {"a": "}{"} end') == '{"a": "}{"}' and model.extract_json("none") is None and model.extract_json(None) is None
    assert model.batch_items('{"items": [1, 2]}', 2) == ["1", "2"] and model.batch_items('{"items": [1]}', 2) is None

    class Failing:
        n = 0

        def complete(self, *a):
            self.n += 1
            if self.n < 3:
                raise OSError
            return "{}"

    assert model.call(Failing(), "", "", 0.1, wait=lambda s: None) == "{}"
    d = spark.createDataFrame([(1, "hi"), (2, "yo")], "dm_id long, content string")
    got = model.label(d, model.OfflineBackend()).collect()
    assert len(got) == 2 and all(json.loads(r.raw_a)["emotion"] for r in got)


def test_streams(spark, tmp_path):
    rows = [(1, "v", "u", "2025-01-01 00:00:00"), (2, "v", "u", "2025-01-01 00:10:00"), (3, "v", "unknown_device", "2025-01-01 01:00:00"), (4, "v", None, "2025-01-01 01:00:00")]
    d = spark.createDataFrame(rows, "dm_id long, bvid string, uid_hash string, t string").withColumn("ingested_at", F.to_timestamp("t"))
    d.write.parquet(str(tmp_path / "in"))
    s = streams.comment_stream(spark, str(tmp_path / "in"), d.schema)
    got = sorted(r.dm_id for r in streams.run_once(streams.first_per_user_stream(s), "first_users", str(tmp_path / "c1")).collect())
    assert len(got) == 3 and {3, 4} <= set(got)
    n = streams.run_once(streams.arrivals_per_window(s), "arrivals", str(tmp_path / "c2"), "complete")
    assert {r.n for r in n.collect()} == {2}


def test_settings():
    s = DEFAULT.with_overrides({"top_n": 5, "unknown": 1, "zone_policy": "all", "fixed_step": None})
    assert (s.top_n, s.zone_policy, s.fixed_step) == (5, "all", 30)


def test_cli_lists_queries(capsys):
    assert main(["list"]) == 0 and "p4_found" in capsys.readouterr().out


def test_prompts(spark):
    from tidemark.functions import prompts as P

    d = spark.createDataFrame([("Game", ["a", "b", "c", "d", "e", "f"], 1, "hi"), (None, None, 2, "yo")], "tname string, tags array<string>, pick int, content string")
    a, b = (r[0] for r in d.select(P.system_prompt(F.col("tname"), F.col("tags"), {"Game": "scores"})).collect())
    assert "scores" in a and "a, b, c, d, e." in a and "none" in b and P.DEFAULT_HINT in b
    r = P.batch_prompts(d.withColumns({"bvid": F.lit("v"), "segment_id": F.lit(0)})).first()
    assert r.expected == 2 and "1. hi\n2. yo" in r.prompt
    assert json.loads(P.narrative_input(d, "pick", 1))[0]["content"] == "yo"


def test_config_files(tmp_path):
    from tidemark.sources import config as C

    (tmp_path / "a.env").write_text("# c\nX=1\nY='2'\n")
    (tmp_path / "b.env").write_text("X=3\n")
    assert C.env_values(str(tmp_path / "a.env"), str(tmp_path / "b.env"), "none") == {"X": "3", "Y": "2"}
    (tmp_path / "t.json").write_text('[{"command": "analyze", "options": {"input": "BV1"}}]')
    assert C.script_tasks(str(tmp_path / "t.json"))[0]["command"] == "analyze"
    (tmp_path / "u.json").write_text('[{"command": "rm"}]')
    with pytest.raises(ValueError):
        C.script_tasks(str(tmp_path / "u.json"))
