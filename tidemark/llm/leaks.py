"""Documents that hold passages of evaluation items (problem 9)."""

from __future__ import annotations

import re
import unicodedata as ud
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

#: Share of an item's text that must stand in a document.
SHARE = 0.5
#: Words that may be changed, left out or put in within a passage, as a share of its words; a CJK character or a digit counts as a word. The one
#: budget cuts the pieces and bounds the distance. Where a passage has numbers, at least half of them must be the item's: a sentence in
#: the same words with other facts is no leak.
WORD_BUDGET = 0.1
#: An opening before a colon or line break that so many items share is an instruction.
SHARED_OPENING = 3
#: Items taken into one automaton; more items are searched in further passes.
ITEM_BLOCK = 20_000

_OPENING = re.compile(r"^([^:：\n]{4,})[:：\n]\s*")
_JUNK = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"\d+")
_WIDE = re.compile(r"[０-９Ａ-Ｚａ-ｚｦ-ﾟ]")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|\d|[^\W\d_぀-ヿ㐀-鿿豈-﫿]+")


def _plain(s: str) -> str:
    return (ud.normalize("NFKC", s) if _WIDE.search(s) else s).lower()


def letters(s: str) -> str:
    """Lower case, full-width letters and digits made narrow, nothing but letters and digits."""
    return _JUNK.sub("", _plain(s))


def words(s: str) -> list[str]:
    """The words of a text; joined, they are its ``letters``."""
    return _TOKEN.findall(_plain(s))


def without_openings(items: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The items without an opening instruction that at least three of them share. To be called with all items."""
    found = [(m.group(1).strip().lower() if (m := _OPENING.match(t)) else None) for _, t in items]
    shared = Counter(x for x in found if x)
    return [(i, t[_OPENING.match(t).end() :] if x and shared[x] >= SHARED_OPENING else t) for (i, t), x in zip(items, found, strict=True)]


def best_match(pattern: Sequence[str], text: Sequence[str], most: int) -> tuple[int, int] | None:
    """Myers' bit-parallel search: the least edit distance of the pattern to any piece of the text, if at most ``most``, and where the first such
    piece ends. Symbols may be characters or words."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    vp, vn, score, best, end = full, 0, m, m, 0
    get = eq.get
    left = len(text)
    for at, c in enumerate(text, 1):
        left -= 1
        e = get(c, 0)
        xv = e | vn
        xh = (((e & vp) + vp) ^ vp) | e
        ph = vn | (full & ~(xh | vp))
        mh = vp & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, at
        if score - left > most and best > most:
            return None
        ph <<= 1
        mh <<= 1
        vp = (mh | ~(xv | ph)) & full
        vn = ph & xv & full
    return (best, end) if best <= most else None


class Item:
    """An item's words, and its windows: passages of half its letters, one from each of its words on, as (first word, last word + 1, budget)."""

    __slots__ = ("ends", "text", "windows", "words")

    def __init__(self, body: str):
        self.words = words(body)
        self.text = "".join(self.words)
        self.ends = [0]
        for t in self.words:
            self.ends.append(self.ends[-1] + len(t))
        half, b, self.windows = SHARE * len(self.text), 0, []
        for a in range(len(self.words)):
            while b < len(self.words) and self.ends[b] - self.ends[a] < half:
                b += 1
            if self.ends[b] - self.ends[a] < half or not half:
                break
            self.windows.append((a, b, int(WORD_BUDGET * (b - a))))

    def pieces(self) -> set[tuple[int, int]]:
        """Every window cut into budget + 1 pieces of whole words: with at most that many edits one piece stands unchanged."""
        return {(a + (b - a) * k // (most + 1), a + (b - a) * (k + 1) // (most + 1)) for a, b, most in self.windows for k in range(most + 1)}

    def numbers(self, a: int, b: int) -> list[str]:
        return _NUMBER.findall(self.text, self.ends[a], self.ends[b])


def same_facts(wanted: list[str], found: list[str]) -> bool:
    """At least half of the numbers are there; of longer ones a part at either end is enough."""
    known = Counter(found)
    same = 0
    for n in wanted:
        if known[n] > 0:
            known[n] -= 1
            same += 1
        elif len(n) > 2 and any(len(m) > 1 and (n.startswith(m) or n.endswith(m) or m.startswith(n) or m.endswith(n)) for m in found):
            same += 1
    return 2 * same >= len(wanted)


class Searcher:
    """Exact hits of pieces by one automaton, then verification of windows by edit distance over words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: dict[int, Item] = {}
        places: dict[str, set[tuple[int, int, int]]] = defaultdict(set)
        for i, body in items:
            it = Item(body)
            if it.windows:
                self.items[i] = it
            for x, y in it.pieces():
                places[it.text[it.ends[x] : it.ends[y]]].add((i, x, y))
        self.auto = ahocorasick.Automaton()
        for p, where in places.items():
            self.auto.add_word(p, (len(p), tuple(where)))
        if places:
            self.auto.make_automaton()
        self.any = bool(places)

    def _holds(self, it: Item, doc: list[str], hits: list[tuple[int, int, int]]) -> bool:
        """Does a window of the item that holds a hit piece stand in the document? ``hits``: (first word and last + 1 in the item, first word in the document)."""
        hits.sort(key=lambda h: h[2] - h[0])
        n, widest = len(it.words), max(most for _, _, most in it.windows)
        groups: list[list[tuple[int, int, int]]] = []
        for h in hits:  # hits that one passage can explain lie on neighbouring diagonals
            if groups and h[2] - h[0] - (groups[-1][-1][2] - groups[-1][-1][0]) <= 2 * widest:
                groups[-1].append(h)
            else:
                groups.append([h])
        for g in groups:
            first, last = max(0, g[0][2] - g[0][0] - widest), g[-1][2] - g[-1][0] + n + widest
            region = doc[first:last]
            there = set(region)
            missing = [0]
            for w in it.words:
                missing.append(missing[-1] + (w not in there))
            begins = sorted((x, y) for x, y, _ in g)
            for a, b, most in it.windows:
                # a word that the region lacks costs an edit
                if missing[b] - missing[a] > most:
                    continue
                k = bisect_left(begins, (a, 0))
                if not any(y <= b for x, y in begins[k:] if x < b):
                    continue
                lo, hi = max(0, g[0][2] - g[0][0] + a - most - first), g[-1][2] - g[-1][0] + b + most - first
                part = region[max(0, lo) : hi]
                got = best_match(it.words[a:b], part, most)
                if got is None:
                    continue
                wanted = it.numbers(a, b)
                if not wanted or same_facts(wanted, _NUMBER.findall("".join(part[max(0, got[1] - (b - a) - got[0]) : got[1]]))):
                    return True
        return False

    def find(self, raw: str) -> list[int]:
        """Ids of the items that leaked into the text."""
        s = letters(raw)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        doc: list[str] = []
        at: dict[int, int] = {}
        for end, (k, where) in self.auto.iter(s):
            if not doc:
                doc, place = words(raw), 0
                for n, w in enumerate(doc):
                    at[place] = n
                    place += len(w)
                at[place] = len(doc)
            first = at.get(end - k + 1)
            if first is not None and end + 1 in at:  # whole words only
                for i, x, y in where:
                    hits.setdefault(i, []).append((x, y, first))
        return [i for i, h in hits.items() if self._holds(self.items[i], doc, h)]


@lru_cache(maxsize=2)
def _searcher(items: tuple[tuple[int, str], ...]) -> Searcher:
    return Searcher(list(items))


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(``item_id``, ``doc_id``) of every document that holds at least half of an item as a passage, apart from case,
    punctuation, line breaks and changed words within the budget; the item's shared opening instruction counts for nothing.

    Windows of half an item begin at each of its words; each is split into error-budget-plus-one pieces of whole words. The
    pieces of all items form one automaton that is run over each document's whole text; where a piece is hit, windows
    are verified with Myers' bit-parallel distance over words, with the same budget, so that no passage within it is missed.
    One pass over the documents without a shuffle for each 20,000 items, whose blocks change nothing in the result;
    only items, the stated query set, are brought to the driver. Null or empty texts and items give nothing; a
    document given twice is reported twice; an item that leaks several times into a document is reported once.
    """
    query = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    bodies = sorted(without_openings([(r["i"], r["t"]) for r in query.collect()]))
    out = None
    for k in range(0, max(len(bodies), 1), ITEM_BLOCK):
        block = tuple(bodies[k : k + ITEM_BLOCK])

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            search = _searcher(block)
            last: dict[str, list[int]] = {}
            for b in batches:
                a, d = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not t or not search.any:
                        continue
                    got = last.get(t)
                    if got is None:
                        got = last[t] = search.find(t)
                    a += got
                    d += [i] * len(got)
                last = {}
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(d, pa.int64())], ["item_id", "doc_id"])

        got = docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "item_id bigint, doc_id bigint")
        out = got if out is None else out.unionByName(got)
    return out


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per item, the number of documents it leaked into."""
    return p9_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
