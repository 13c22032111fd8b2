"""Words with parts of speech, by a lexicon."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidemark.functions.text import POS_ALIASES
from tidemark.model import Backend, call

#: A lexicon goes along with every task, so it may hold at most so many words.
MOST_WORDS = 500_000
#: How often a word counts that stands in the lexicon without a number.
FREQUENCY = 100
#: Texts from so many characters on may be given to a labelling model.
MODEL_FROM = 20

_RUN = re.compile(r"[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|[㐀-鿿]+|[ぁ-ゖァ-ヺー]+|[가-힣]+|\S")
TAGGED = ArrayType(StructType([StructField("word", StringType()), StructField("pos", StringType())]))


class Segmenter:
    """The most probable division of a text into words, of which those of the lexicon count by frequency and any other character once. So a word of
    the lexicon is never divided into unknown characters, and of overlapping words the more frequent, or the longer, stand. Without a lexicon
    entry: Latin words 'eng', numbers 'm', kana and Hangul runs 'n', everything else by character, 'x'."""

    def __init__(self, words: dict[str, tuple[int | None, str | None]]):
        freq = {w: max(int(f if f is not None else FREQUENCY), 1) for w, (f, _) in words.items()}
        self.total = math.log(sum(freq.values()) + 1.0)
        self.score = {w: math.log(f) - self.total for w, f in freq.items()}
        self.pos = {w: p or "x" for w, (_, p) in words.items()}
        self.by_first: dict[str, list[int]] = {}
        for w in words:
            sizes = self.by_first.setdefault(w[0], [])
            if len(w) not in sizes:
                sizes.append(len(w))

    def _parts(self, s: str) -> list[str]:
        best, back = [0.0] + [-math.inf] * len(s), [0] * (len(s) + 1)
        for i, c in enumerate(s):
            for size in {1, *self.by_first.get(c, ())}:
                w = s[i : i + size]
                if len(w) == size and (size == 1 or w in self.score):
                    z = best[i] + self.score.get(w, -self.total)
                    if z > best[i + size]:
                        best[i + size], back[i + size] = z, i
        out, at = [], len(s)
        while at:
            out.append(s[back[at] : at])
            at = back[at]
        return out[::-1]

    def _shape(self, w: str) -> str:
        return "eng" if w[0].isascii() and w[0].isalpha() else "m" if w[0].isascii() and w[0].isdigit() else "n" if "ぁ" <= w[0] <= "ヿ" or "가" <= w[0] <= "힣" else "x"

    def __call__(self, text: str | None) -> list[dict[str, str]]:
        out = []
        # words of the lexicon may join what is of different scripts, so runs are looked for between them
        for m in re.finditer(r"\S+", text or ""):
            for w in self._joined(self._parts(m.group())):
                out.append({"word": w, "pos": self.pos[w] if w in self.pos else self._shape(w)})
        return out

    def _joined(self, parts: list[str]) -> Iterator[str]:
        """Characters that no word took, put together again by runs of one script (CJK characters stay single)."""
        rest = ""
        for w in [*parts, ""]:
            if w and w not in self.pos:
                rest += w
                continue
            for m in _RUN.finditer(rest):
                yield from (m.group() if "㐀" <= m.group()[0] <= "鿿" else [m.group()])
            rest = ""
            if w:
                yield w


def lexicon_words(lexicon: DataFrame) -> dict[str, tuple[int | None, str | None]]:
    """(word, freq, pos) rows, comments ('#') left out; of a repeated word the most frequent entry. Raises beyond ``MOST_WORDS``."""
    w = lexicon.where(F.col("word").isNotNull() & (F.col("word") != "") & ~F.col("word").startswith("#"))
    w = w.groupBy("word").agg(F.max(F.struct(F.coalesce("freq", F.lit(FREQUENCY)).alias("f"), "pos")).alias("e"))
    rows = w.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a lexicon may hold {MOST_WORDS} words")
    return {r.word: (r.e.f, r.e.pos) for r in rows}


def tagged(df: DataFrame, lexicon: DataFrame, text: str = "content") -> DataFrame:
    """Adds ``tagged``, the words of ``text`` with their parts of speech; empty for null and blank text. Arrow batches, no shuffle."""
    cut = Segmenter(lexicon_words(lexicon))
    schema = df.drop("tagged").schema.add("tagged", TAGGED)
    kind = pa.list_(pa.struct([("word", pa.string()), ("pos", pa.string())]))
    sent = df.sparkSession.sparkContext.broadcast(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([sent.value(t) for t in b.column(b.num_columns - 1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], words], [*b.schema.names[:-1], "tagged"])

    return df.drop("tagged").withColumn("_text", F.col(text).cast("string")).mapInArrow(run, schema)


def model_tagged(texts: list[str], backend: Backend, cut: Segmenter) -> list[list[dict[str, str]]]:
    """Words from a labelling model for texts of ``MODEL_FROM`` characters and more; a text whose answer fails, or leaves out letters of it,
    and every shorter one, is cut by the lexicon. Names of parts of speech are made one by their aliases."""
    bare = lambda s: re.sub(r"\s+", "", s)
    out = []
    for t in texts:
        got = None
        if t and len(t) >= MODEL_FROM and (answer := call(backend, 'Answer {"tokens": [{"word": "", "pos": ""}]} with all words of the text and their parts of speech.', t, 0.0)):
            got = [x for x in json.loads(answer).get("tokens") or [] if isinstance(x, dict) and isinstance(x.get("word"), str)]
            if bare("".join(x["word"] for x in got)) != bare(t):
                got = None
        out.append([{"word": x["word"], "pos": POS_ALIASES.get(str(x.get("pos", "x")).strip().lower(), str(x.get("pos", "x")).strip() or "x")} for x in got] if got else cut(t))
    return out
