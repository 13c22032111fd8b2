"""Occurrences and records of every term, n-gram or value, by sorted suffixes (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

#: A term held by at least this share of the records is too common.
COMMON_SHARE = 0.005
#: A term that occurs at most so often in all is too rare.
RARE_COUNT = 1
#: Distinct suffixes gathered in a task before they are sent on.
FLUSH = 200_000
#: Suffixes with one first term are spread over so many routes by their second term.
ROUTES = 32


def _suffixes(sigma: int, whole: bool):
    """Suffixes of each record, truncated to ``sigma`` terms and added up per task. ``d1..`` count, for each prefix length,
    the suffixes at which the prefix occurs for the first time in its record: summed over all suffixes that begin
    with a prefix they give the size of its set of records."""

    names = ["suffix", "c", *[f"d{k}" for k in range(1, sigma + 1)]]

    def emit(acc: dict) -> pa.RecordBatch:
        cols = list(zip(*acc.values(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(list(acc), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, list[int]] = {}
        for b in batches:
            for s in b.column(0).to_pylist():
                terms = [s] if whole else [t for t in s.split(" ") if t]
                if sigma == 1:
                    seen: set = set()
                    for t in terms:
                        a = acc.get(t)
                        if a is None:
                            a = acc[t] = [0, 0]
                        a[0] += 1
                        if t not in seen:
                            seen.add(t)
                            a[1] += 1
                    continue
                seen = set()
                for i in range(len(terms)):
                    part = terms[i : i + sigma]
                    key = " ".join(part)
                    a = acc.get(key)
                    if a is None:
                        a = acc[key] = [0] * (sigma + 1)
                    a[0] += 1
                    for k in range(1, len(part) + 1):
                        g = tuple(part[:k])
                        if g not in seen:
                            seen.add(g)
                            a[k] += 1
            if len(acc) >= FLUSH:
                yield emit(acc)
                acc = {}
        if acc:
            yield emit(acc)

    return run


def _stack(sigma: int, whole: bool):
    """Over suffixes in reverse lexicographic order: the stack holds the prefixes of the current suffix with their counts;
    a prefix is complete, and leaves, once a suffix without it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []
        counts: list[list[int]] = []  # per level: occurrences, records
        out: list[tuple] = []

        def pop(to: int):
            while len(path) > to:
                c, d = counts.pop()
                out.append((" ".join(path), len(path), c, d))
                path.pop()
                if counts:
                    counts[-1][0] += c

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["term", "n", "occurrences", "records"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for row in zip(*cols, strict=True):
                part = [row[0]] if whole else row[0].split(" ")
                same = 0
                while same < len(path) and same < len(part) and path[same] == part[same]:
                    same += 1
                pop(same)
                for t in part[same:]:
                    path.append(t)
                    counts.append([0, 0])
                counts[-1][0] += row[1]
                for k in range(len(part)):
                    counts[k][1] += row[2 + k]
            if len(out) >= 50_000:
                yield batch()
                out.clear()
        pop(0)
        yield batch()

    return run


def suffix_counts(df: DataFrame, column: str, sigma: int = 1, whole: bool = False) -> DataFrame:
    """(``term``, ``n``: its number of words, ``occurrences``, ``records``) of every n-gram of one to ``sigma`` terms.

    Terms are the non-empty pieces between spaces (U+0020), exactly as stored; ``whole`` takes each value as one term
    (then ``sigma`` is 1, and the empty value counts). Suffixes are added up in their task, routed by first term, with
    the second term where there is one, so that one very frequent term is spread over many tasks, and sorted in reverse
    lexicographic order; a stack then yields all prefix counts in one pass. Prefixes of two and more terms are
    complete in their task; of single terms the few parts are summed. Texts of any length count whole.
    Nulls, and texts without terms, give nothing; an empty table gives an empty result.
    """
    sigma = 1 if whole else sigma
    ds = [f"d{k}" for k in range(1, sigma + 1)]
    got = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string"))
    got = got.mapInArrow(_suffixes(sigma, whole), "suffix string, c bigint, " + ", ".join(f"{d} bigint" for d in ds))
    words = F.array(F.col("suffix")) if whole else F.split("suffix", " ")
    route: list[Column] = [words[0]]
    if sigma > 1:
        route.append(F.pmod(F.xxhash64(F.get(words, F.lit(1))), F.lit(ROUTES)))
    routed = got.repartition(*route).sortWithinPartitions(words.desc())
    schema = "term string, n int, occurrences bigint, records bigint"
    grams = routed.mapInArrow(_stack(sigma, whole), schema)
    if sigma == 1:
        return grams
    ones = grams.where(F.col("n") == 1).groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return grams.where(F.col("n") > 1).unionByName(ones)


def marked(counts: DataFrame, total: int) -> DataFrame:
    """Adds ``mark``: 'common', 'rare', 'common rare' (both can hold in a small collection) or ''."""
    common = F.col("records") >= F.lit(COMMON_SHARE) * F.lit(float(total))
    rare = F.col("occurrences") <= RARE_COUNT
    return counts.withColumn("mark", F.concat_ws(" ", F.when(common, "common"), F.when(rare, "rare")))


def _filled(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    c = table(spark, sf, "comments").select("content")
    return c, c.where(F.col("content").isNotNull()).count()


#: N-grams of up to so many terms.
SIGMA = 3


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The single terms of the n-gram run."""
    c, total = _filled(spark, sf)
    m = marked(suffix_counts(c, "content", SIGMA).where(F.col("n") == 1), total).where(F.col("mark") != "")
    return m.select("term", F.explode(F.split("mark", " ")).alias("mark"))


def p2_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Every n-gram of up to three terms."""
    c, total = _filled(spark, sf)
    return marked(suffix_counts(c, "content", SIGMA), total)


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct value of the column."""
    c, total = _filled(spark, sf)
    return marked(suffix_counts(c, "content", whole=True), total).select(F.col("term").alias("value"), "occurrences", "records", "mark")


QUERIES = {"p2_found": p2_found, "p2_ngrams": p2_ngrams, "p2_values": p2_values}

_MARK = "concat_ws(' ', CASE WHEN records >= 0.005e0 * (SELECT count(content) FROM comments) THEN 'common' END, CASE WHEN occurrences = 1 THEN 'rare' END)"
_WORDS = "words AS (SELECT dm_id, list_filter(string_split(content, ' '), lambda x: x <> '') AS w FROM comments WHERE content IS NOT NULL)"
_GRAMS = f"""{_WORDS}, grams AS (
  SELECT n, array_to_string(g, ' ') AS term, dm_id FROM (
    SELECT dm_id, n, unnest([w[i:i+n-1] FOR i IN range(1, CAST(len(w) - n + 2 AS BIGINT))]) AS g FROM words, range(1, 4) t(n))),
counted AS (SELECT term, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT dm_id) AS records FROM grams GROUP BY ALL)"""
SQL = {
    "p2_found": f"""WITH {_WORDS}, terms AS (SELECT dm_id, unnest(w) AS term FROM words),
counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT dm_id) AS records FROM terms GROUP BY term)
SELECT term, 'common' AS mark FROM counted WHERE records >= 0.005e0 * (SELECT count(content) FROM comments)
UNION ALL SELECT term, 'rare' FROM counted WHERE occurrences = 1""",
    "p2_ngrams": f"WITH {_GRAMS} SELECT term, n, occurrences, records, {_MARK} AS mark FROM counted",
    "p2_values": f"""SELECT value, occurrences, records, {_MARK} AS mark
FROM (SELECT content AS value, count(*) AS occurrences, count(*) AS records FROM comments WHERE content IS NOT NULL GROUP BY content)""",
}
