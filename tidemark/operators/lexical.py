"""Lexical and orthographic measures per group of comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def hard_metrics(comments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: comments, words, characters, mean word length, share of content words (parts of speech n*, v*, a*), share of comments
    with emphasis or emoji, syllable shares, and upper-case runs, digit runs and emoticons per 1000 characters. Words come from ``tagged`` (words with parts
    of speech, see ``tokenise``) or ``tokens`` (words) if the table has one of them, else from the built-in tokeniser. Zero where nothing is counted."""
    lexical = "tagged" in comments.columns
    c = comments if lexical or "tokens" in comments.columns else comments.withColumn("tokens", T.tokens(F.col("content")))
    col = "tagged" if lexical else "tokens"
    word = (lambda x: x.word) if lexical else (lambda x: x)
    pos = (lambda x: x.pos) if lexical else T.shape_pos
    over = lambda f: F.aggregate(col, F.lit(0), lambda a, w: a + f(w).cast("int"))
    per = c.select(
        *keys, F.size(col).alias("words"), over(lambda w: T.word_chars(word(w))).alias("chars"), over(lambda w: pos(w).rlike("^[nva]")).alias("content_words"),
        over(lambda w: F.length(word(w)) == 1).alias("w1"), over(lambda w: F.length(word(w)) == 2).alias("w2"),
        (T.has_emphasis(F.col("content")) | T.has_emoji(F.col("content"))).alias("marked"),
        T.upper_runs(F.col("content")).alias("upper"), T.digit_runs(F.col("content")).alias("digits"), T.emoticons(F.col("content")).alias("faces"))
    s = lambda x: F.sum(x).cast("double")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    words, chars = s("words"), s("chars")
    return per.groupBy(*keys).agg(
        F.count("*").alias("total_comments"), F.sum("words").alias("total_words"), F.sum("chars").alias("total_chars"),
        F.round(rate(chars, words), 6).alias("avg_word_length"), F.round(rate(s("content_words"), words), 6).alias("content_word_density"),
        F.round(F.avg(F.col("marked").cast("double")), 6).alias("punctuation_emoji_rate"),
        F.round(rate(s("w1"), words), 6).alias("syllable_one"), F.round(rate(s("w2"), words), 6).alias("syllable_two"),
        F.round(rate(words - s("w1") - s("w2"), words), 6).alias("syllable_three_plus"),
        F.round(rate(s("upper"), chars) * 1000, 6).alias("uppercase_abbr_per_1000"), F.round(rate(s("digits"), chars) * 1000, 6).alias("number_symbol_per_1000"),
        F.round(rate(s("faces"), chars) * 1000, 6).alias("emoticon_per_1000"))


def pos_distribution(comments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form: (keys, pos, ratio)."""
    if "tagged" in comments.columns:
        w = comments.select(*keys, F.explode("tagged").alias("w")).select(*keys, F.col("w.pos").alias("pos"))
    else:
        w = comments.select(*keys, F.explode(T.tokens(F.col("content"))).alias("w")).select(*keys, T.shape_pos(F.col("w")).alias("pos"))
    counts = w.groupBy(*keys, "pos").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return counts.join(total, list(keys)).select(*keys, "pos", F.round(F.col("n") / F.col("_t"), 6).alias("ratio"))


def complete(metrics: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for every group, with zeros where it has no comments."""
    rest = [c for c in metrics.columns if c not in keys]
    return groups.select(*keys).distinct().join(metrics, list(keys), "left").na.fill(0, rest)
