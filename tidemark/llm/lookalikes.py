"""One form for texts that look the same (problem 1)."""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

# Letters of other scripts that are drawn as the Latin letter before the colon.
SAME_LETTERS = (
    "A:АΑ B:ВΒ C:СϹ E:ЕΕ H:НΗ I:ІΙӀ J:ЈͿ K:КΚ M:МΜ N:Ν O:ОΟ P:РΡ S:Ѕ T:ТΤ V:Ѵ X:ХΧ Y:ҮΥ Z:Ζ "
    "a:а c:сϲ d:ԁ e:е g:ɡ h:һ i:і j:јϳ o:оο p:рρ q:ԛ s:ѕ v:νѵ w:ԝ x:х y:уү"
)
# Simplified radicals without a decomposition, before the character they are drawn as.
SAME_RADICALS = "⺟母 ⺠民 ⻁虎 ⻄西 ⻅见 ⻆角 ⻋车 ⻓长 ⻔门 ⻚页 ⻛风 ⻜飞 ⻝食 ⻢马 ⻤鬼 ⻥鱼 ⻦鸟 ⻨麦 ⻩黄 ⻬齐 ⻮齿 ⻰龙"
#: Kinds of compatibility decomposition that keep the look. Raised, circled or stacked forms look different.
SAME_KINDS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _invisible(cp: int) -> bool:
    """Format characters without a look of their own, and variation selectors. Bidirectional and joining controls too."""
    return ud.category(chr(cp)) == "Cf" and not 0x600 <= cp <= 0x8E2 and cp < 0x110000 or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


def look_pairs() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look the same, from Unicode's own data and the fixed values above."""
    for entry in SAME_LETTERS.split():
        latin, others = entry.split(":")
        yield from ((o, latin) for o in others)
    yield from ((e[0], e[1]) for e in SAME_RADICALS.split())
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        if _invisible(cp):
            yield c, ""
        elif ud.category(c) == "Zs":
            yield c, " "
        elif 0xAC00 <= cp <= 0xD7A3:
            yield ud.normalize("NFD", c), c
        elif d := ud.decomposition(c):
            kind = d.split()[0] if d[0] == "<" else ""
            text = "".join(chr(int(x, 16)) for x in d.split()[bool(kind) :])
            radical = kind == "<compat>" and 0x2E80 <= cp <= 0x2FDF
            ligature = kind == "<compat>" and text.isalpha() and len(text) > 1
            dots = cp in (0x2025, 0x2026)
            if not kind or kind in SAME_KINDS or radical or ligature or dots:
                yield c, text
                if not kind and (full := ud.normalize("NFD", c)) != text:
                    yield c, full
    for cp in range(0xE0100, 0xE01F0):
        yield chr(cp), ""
    for base in map(chr, range(0xFF66, 0xFF9E)):  # half-width kana with a separate voicing mark
        for mark, joining in (("ﾞ", "゙"), ("ﾟ", "゚")):
            one = ud.normalize("NFC", ud.normalize("NFKC", base) + joining)
            if len(one) == 1:
                yield base + mark, one


@lru_cache(maxsize=1)
def look_classes() -> tuple[tuple[str, ...], ...]:
    """The transitive classes, by union-find over code points and strings."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in look_pairs():
        parent[root(a)] = root(b)
    strings, joined = [x for x in parent if len(x) > 1], True
    while joined:  # strings look the same if their code points do
        classes: dict[str, list[str]] = {}
        for x in parent:
            classes.setdefault(root(x), []).append(x)
        plain = {m: min(x for x in c if len(x) == 1) for c in classes.values() if "" not in c for m in c if len(m) == 1}
        joined = False
        for x in strings:
            same = "".join(plain.get(ch, ch) for ch in x)
            if root(x) != root(same):
                parent[root(x)], joined = root(same), True
    return tuple(tuple(sorted(c)) for c in classes.values() if len(c) > 1)


def _char_class(chars) -> str:
    """A character class of a regular expression, as ranges."""
    cps, out, i = sorted({ord(c) for c in chars}), [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\U{cps[i]:08x}-\\U{cps[j]:08x}")
        i = j + 1
    return "[" + "".join(out) + "]"


def _count_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    members = {m for c in look_classes() for m in c if m}
    long = ahocorasick.Automaton()
    for m in members:
        if len(m) > 1:
            long.add_word(m, m)
    long.make_automaton()
    counts: Counter = Counter()
    for b in batches:
        joined = "\n".join(t for t in b.column(0).to_pylist() if t)  # no member holds a line break
        for c, k in Counter(joined).items():
            if c in members:
                counts[c] += k
        counts.update(m for _, m in long.iter_long(joined))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["member", "k"])


def representatives(texts: DataFrame, column: str) -> dict[str, str]:
    """Member -> representative of its class: the member seen most often in all texts (ties: the shorter, then the
    smaller); the empty string stands for the class of invisible characters, the space for that of spaces. What is
    gathered at the driver is one count per member, bounded by the fixed table of classes."""
    got = texts.select(column).mapInArrow(_count_members, "member string, k bigint").groupBy("member").agg(F.sum("k").alias("k"))
    seen = {r["member"]: r["k"] for r in got.collect()}
    reps = {c: "" if "" in c else " " if " " in c else min(c, key=lambda m: (-seen.get(m, 0), len(m), m)) for c in look_classes()}
    single = {m: r for c, r in reps.items() for m in c if len(m) == 1 and m != r and len(r) < 2}
    out = dict(single)
    for c, r in reps.items():
        if any(len(m) > 1 for m in c):  # a string is also met with its code points already rewritten
            r = "".join(single.get(x, x) for x in r) if len(r) > 1 else r
            for m in c:
                out |= {x: r for x in (m, "".join(single.get(x, x) for x in m)) if x and x != r}
    return out


class Rewriter:
    """Greedy leftmost-longest rewriting by an automaton over all members, until nothing changes. It ends: representatives stand for themselves, so no
    round makes a text longer than its decomposition, and a form that comes again ends the search."""

    def __init__(self, table_: dict[str, str]):
        self.auto = ahocorasick.Automaton()
        for m, r in table_.items():
            self.auto.add_word(m, (len(m), r))
        self.auto.make_automaton()
        # a text without any of these code points stays as it is
        self.hint = re.compile(_char_class({m if len(m) == 1 else m[-1] for m in table_}))
        self.marks = re.compile("[̀-֑ͯ-ֽؐ-ًؚ-ٟऀ-෿᪰-᫿᷀-᷿⃐-⃿]{2}")

    def __call__(self, s: str) -> str:
        if not self.hint.search(s):
            return s
        seen: list[str] = []
        while True:
            if self.marks.search(s):
                s = ud.normalize("NFD", s)
            out, at = [], 0
            for end, (k, r) in self.auto.iter_long(s):
                out += (s[at : end - k + 1], r)
                at = end + 1
            if not out:
                return s
            out.append(s[at:])
            s = "".join(out)
            if s in seen:  # it turns to itself, or round and round: then the least form stands for all
                return min(seen[seen.index(s) :])
            seen.append(s)


def unify(df: DataFrame, column: str, table_: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``form``, the one form of ``column``. Null stays null, empty stays empty; whole texts of any
    length are rewritten. No shuffle; the table goes along with the function."""
    schema = df.select(*keep, F.col(column).cast("string").alias("form")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(table_)
        for b in batches:
            form = pa.array([s and rewrite(s) for s in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], form], [*keep, "form"])

    return df.select(*keep, F.col(column).cast("string").alias("form")).mapInArrow(run, schema)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    comments, phrases = table(spark, sf, "comments"), table(spark, sf, "watch_phrases")
    reps = representatives(comments, "content")
    c = unify(comments.where(F.col("content").isNotNull()).withColumn("own", F.col("content")), "content", reps, ["dm_id", "own"])
    p = unify(phrases.where(F.col("phrase").isNotNull()), "phrase", reps, ["phrase_id", "phrase"])
    return c.join(p, "form").where(F.col("own") != F.col("phrase")).select("phrase_id", "dm_id")


def p1_forms(spark: SparkSession, sf: str) -> DataFrame:
    """How many spellings and rows each form of ``content`` has, for forms with more than one spelling."""
    comments = table(spark, sf, "comments")
    forms = unify(comments.withColumn("own", F.col("content")), "content", representatives(comments, "content"), ["own"])
    spellings = forms.where(F.col("own").isNotNull()).groupBy("form", "own").agg(F.count("*").alias("n"))
    return spellings.groupBy("form").agg(F.count("*").alias("spellings"), F.sum("n").alias("row_count")).where(F.col("spellings") > 1)


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
SQL: dict[str, str] = {}
