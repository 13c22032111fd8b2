import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import work
from tidemark.operators.snapshots import snapshot_changes
from tidemark.sources import reports as R
from tidemark.sources import snapshots as S


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_snapshot_round_trip(spark, tmp_path):
    a = write(tmp_path / "a.csv", "﻿bvid,tname,prompt_version,zone_type,danmaku_count,avg_word_length\nA,T,1,hot_zone,3,1.5\nA,T,1,cold_zone,2,bad\nB,T,1,hot_zone,1,2\n")
    out = tmp_path / "out"
    out.mkdir()
    videos = write(out / "corpus_videos.csv", "﻿bvid,tname,prompt_version,zone_type,danmaku_count,avg_word_length\nA,T,2,hot_zone,5,1.5\nC,T,,hot_zone,1,1\n")
    source, twin = tmp_path / "x" / "v.zip", tmp_path / "y" / "v.zip"
    for p in (source, twin):
        p.parent.mkdir()
        with zipfile.ZipFile(p, "w") as z:
            z.writestr("metadata.json", "{}")
    meta = S.manifest(S.observations(spark, videos), ["w"])
    assert (meta["video_count"], meta["bvids"], meta["prompt_versions"]) == (2, ["A", "C"], ["2"])
    path, valid = S.pack_snapshot(str(out), meta, [videos], [str(source), str(twin), str(tmp_path / "gone.zip")])
    assert valid and not os.path.exists(videos) and source.exists() and twin.exists()
    with zipfile.ZipFile(path) as z:
        assert sorted(z.namelist()) == ["corpus_metadata.json", "corpus_videos.csv", "videos/v.zip"]
    got = {(r.bvid, r.change_type, r.field) for r in snapshot_changes(S.snapshot_pair(spark, a, path)).collect()}
    assert got == {("B", "removed", ""), ("C", "added", ""), ("A", "changed", "prompt_version")}
    with pytest.raises(ValueError):
        S.checked(meta | {"video_count": 3})
    with pytest.raises(ValueError):
        S.observations(spark, write(tmp_path / "n.csv", "x\n1\n"))


def test_archives_of_a_list(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("metadata.json", json.dumps({"bvid": "A", "tname": "", "partitions": ["P"], "danmaku_count": None}))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("other.txt", "")
    (tmp_path / "c.zip").write_bytes(b"broken")
    e = S.archives(spark, [str(tmp_path / n) for n in ("a.zip", "b.zip", "c.zip", "gone.zip", "a.zip")])
    assert {(os.path.basename(r.path), r.is_source, r.has_rows) for r in S.sources(e).collect()} == {("a.zip", True, True), ("b.zip", True, False), ("c.zip", False, False)}
    assert S.archives(spark, ["/nowhere/x.zip"]).count() == 0
    entry = S.index_entries(R.metadata(e)).first()
    assert entry.asDict().keys() == set(S.INDEX_FIELDS) and (entry.bvid, entry.tname, entry.title, entry.danmaku_count) == ("A", "P", "", 0)
    S.save_index(S.index_entries(R.metadata(e)), str(tmp_path / "index.json"))
    assert R.corpus_index(spark, str(tmp_path / "index.json")).first().bvid == "A" and not (tmp_path / "index.json.tmp").exists()
    assert S.absolute(S.relative(str(tmp_path / "d" / "a.zip"), str(tmp_path)), str(tmp_path)) == str(tmp_path / "d" / "a.zip")


def test_progress_log(spark, tmp_path):
    p = str(tmp_path / "p.jsonl")
    for i in range(50):
        S.append_progress(p, input="a" if i % 2 else "b", status=f"s{i}", updated_at=f"{i:03d}")
    assert not S.compact_progress(spark, p) and S.compact_progress(spark, p, limit=100)
    assert {(r.input, r.status) for r in R.json_lines(spark, p, R.TASK_SCHEMA).collect()} == {("a", "s49"), ("b", "s48")}


def test_decisions(spark):
    ids = {n: f"BV{n * 10}" for n in "abcd"}
    items = spark.createDataFrame([(ids["a"],), (ids["b"],), (ids["c"],), ("av7",), ("av8",), (ids["d"],), ("nothing",), (ids["a"],), (None,)], "input string")
    states = spark.createDataFrame([(ids["a"], "done", ids["a"], "/a.zip"), (ids["b"], "done", ids["b"], "/gone.zip"), (ids["d"], "running", ids["d"], None)], "input string, status string, bvid string, zip_path string")
    index = spark.createDataFrame([(ids["c"], "/c1.zip", "1", "2024"), (ids["c"], "/c2.zip", "1", "2025"), (ids["c"], "/lost.zip", "1", "2026")], "bvid string, zip_path string, prompt_version string, analyzed_at string")
    files = spark.createDataFrame([("/a.zip",), ("/c1.zip",), ("/c2.zip",)], "path string")
    mapping = spark.createDataFrame([("av7", ids["c"])], "ref string, bvid string")
    got = {r.input: (r.decision, r.zip_path) for r in work.decisions(items, states, index, files, mapping=mapping).collect()}
    assert got == {ids["a"]: ("resumed", "/a.zip"), ids["b"]: ("analyse", None), ids["c"]: ("reused", "/c2.zip"), "av7": ("reused", "/c2.zip"), "av8": ("unresolved", None), ids["d"]: ("analyse", None), "nothing": ("unresolved", None)}
    fresh = work.decisions(items, states, index, files, reuse=False, resume=False)
    assert {r.decision for r in fresh.where(F.col("bvid").isNotNull()).collect()} == {"analyse"}
    assert {r.input: r.status for r in work.restored(states, files).collect()} == {ids["a"]: "done", ids["b"]: "pending", ids["d"]: "pending"}
    assert work.resolved(spark.createDataFrame([("https://b23.tv/abc",)], "input string")).first().input_type == "url"
