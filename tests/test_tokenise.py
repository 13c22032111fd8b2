import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexical
from tidemark.operators import tokenise as T


def test_segmenter_finds_the_most_probable_words():
    """Against every possible division of short texts."""
    rng = random.Random(5)
    words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 3))): (rng.randint(1, 500), "n") for _ in range(12)}
    cut = T.Segmenter(words)
    for _ in range(200):
        s = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 8)))
        best = -math.inf
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:], strict=False)]
            if all(len(p) == 1 or p in cut.score for p in parts):
                best = max(best, sum(cut.score.get(p, -cut.total) for p in parts))
        got = [x["word"] for x in cut(s)]
        assert "".join(got) == s and sum(cut.score.get(p, -cut.total) for p in got) == pytest.approx(best)


def test_lexicon_words_win(spark):
    lex = spark.createDataFrame([("弹幕文化", 10, "n"), ("好看", None, "a"), ("B站", 5, "nz"), ("好看", 3, "v"), ("# 注释", None, None), (None, 1, "n")], "word string, freq long, pos string")
    d = spark.createDataFrame([(1, "B站的弹幕文化真好看！ lol 3.5 かわいい"), (2, None), (3, " "), (4, "甲" * 5000)], "k int, content string").withColumn("pos", F.lit("clash"))
    got = {r.k: [tuple(x) for x in r.tagged] for r in T.tagged(d, lex).collect()}
    assert got[1] == [("B站", "nz"), ("的", "x"), ("弹幕文化", "n"), ("真", "x"), ("好看", "a"), ("！", "x"), ("lol", "eng"), ("3.5", "m"), ("かわいい", "n")]
    assert got[2] == got[3] == [] and len(got[4]) == 5000
    m = lexical.hard_metrics(T.tagged(d.where("k = 1"), lex), ["k"]).first()
    assert (m.total_words, m.content_word_density) == (9, round(4 / 9, 6))
    p = {r.pos: r.ratio for r in lexical.pos_distribution(T.tagged(d.where("k = 1"), lex).drop("pos"), ["k"]).collect()}
    assert p["x"] == round(3 / 9, 6) and p["nz"] == round(1 / 9, 6)
    empty = lexical.complete(lexical.hard_metrics(T.tagged(d.where("k = 1"), lex), ["k"]), d, ["k"]).where("k = 2").first()
    assert empty.total_comments == 0 and empty.avg_word_length == 0


def test_lexicon_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_WORDS", 2)
    with pytest.raises(ValueError):
        T.lexicon_words(spark.range(3).select(F.concat(F.lit("w"), "id").alias("word"), F.lit(1).cast("long").alias("freq"), F.lit("n").alias("pos")))


def test_words_from_a_model():
    class Model:
        def complete(self, system, user, temperature):
            words = user.split() if "bad" not in user else ["other"]
            return json.dumps({"tokens": [{"word": w, "pos": "Noun"} for w in words]})

    cut = T.Segmenter({})
    a, b, c = T.model_tagged(["a text of many short words", "bad answers are thrown away", "short one"], Model(), cut)
    assert {x["pos"] for x in a} == {"n"} and {x["pos"] for x in b} == {"eng"} and c == cut("short one")
