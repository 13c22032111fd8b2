"""Texts that were cut off, and the lengths at which their sources cut (problem 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import materialise, table

#: Neighbouring lengths that a length's hazard is tested against: this far to either side, leaving out the nearest, where
#: a limit in bytes also leaves texts, cut before a character that did not fit.
REACH, GAP = 40, 4
#: Share of false discoveries among the significant lengths.
FDR = 0.01
#: A significant length ends at least so many times the texts that its neighbours do.
RATIO = 4.0
#: A length needs so many different texts.
LEAST = 3
#: A last piece was cut if sentences that begin like it go on: at least this share of them by the lower Wilson bound at ``Z``.
GOES_ON, Z = 0.5, 1.96
#: A last piece is a closing if pieces that begin like it are unfinished last ones in at least this share, by the same bound.
CLOSES = 0.8
#: How many characters of a piece are its opening, longest first: of CJK text, of other text. A shorter last piece is looked up by what it has.
OPENINGS = ((3, 2, 1), (12, 8, 4))
#: The end of a piece: so many characters of CJK text, of other text.
ENDS = (5, 12)
#: Characters from here on are those of CJK text.
WIDE = "\u3000"
#: Patterns of endings look at so many last characters; none of them can match more.
TAIL = 200

_CJK = "[\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7a3]"
_CLOSERS = "[\"'”’」』）)\\]】]*"
#: Where a sentence or line ends.
_BREAK = f"[。．！？!?]+{_CLOSERS}\\s*|[.…]+{_CLOSERS}(?:\\s+|$)|\\n+"
_ENDED = f"[。．！？!?]{_CLOSERS}$|[.]{_CLOSERS}$"
#: A number that stops at its decimal point.
_OPEN_NUMBER = f"(?<!\\d)0\\.$|{_CJK}\\d+[.．]$"
_DOTS = "(?:…|\\.{3})[…. ]*$"
#: What a transfer leaves: half a character, entity, tag, escape or address.
_BROKEN = "\\ufffd$|&[A-Za-z#0-9]{0,7}$|<[a-z/][^<>]{0,20}$|\\\\u?[0-9a-f]{0,3}$|https?:\\S{0,60}$"
#: Forms of endings on purpose: end marks, tags, a dash and a name, symbols, credits.
_CLOSING = (
    "^(?:完|终|終|全文完|(?i)end|fin|over)$|^#\\S+(?:\\s+#\\S+)*$|^[—–]{1,2}\\s?\\S{1,24}(?: \\S{1,16})?$|^[(（\\[【<]\\s*(?:完|终|終|终わり|終わり|おわり|つづく|未完|全文完|end|fin|over|끝)\\s*[)）\\]】>]$"
    "|[\\p{So}\\x{1F000}-\\x{1FAFF}♪♥❤️]$|<3+$|^[\\p{L}]{1,8} [^/]{1,20}(?: / [\\p{L}]{1,8} [^/]{1,20})+$"
)


def _openings(piece: Column) -> Column:
    """The openings of a piece, longest first; those it is too short for are left out."""
    keys = lambda sizes: F.filter(F.array(*[F.when(F.length(piece) >= k, F.substring(piece, 1, k)) for k in sizes]), lambda x: x.isNotNull())
    return F.when(F.substring(piece, 1, 1) >= WIDE, keys(OPENINGS[0])).otherwise(keys(OPENINGS[1]))


def _end(piece: Column) -> Column:
    return F.when(F.substring(piece, -1, 1) >= WIDE, F.substring(piece, -ENDS[0], ENDS[0])).otherwise(F.substring(piece, -ENDS[1], ENDS[1]))


def endings(docs: DataFrame) -> DataFrame:
    """One row per document with non-null text: its lengths, a hash of the text (``same``), what its end looks like, and the
    openings and ends of its pieces (numbers are written as 0, letters small). ``state``: 'whole' (a finished sentence, a form of ending on
    purpose, or nothing but space), 'broken' (the rest of a character, entity or address), 'dots' (dots after something that may be
    unfinished), 'open'. The text is split once, whole; patterns of endings look at its last characters only."""
    t = F.regexp_replace(F.col("text"), "(?U)\\s+$", "")
    d = docs.where(F.col("text").isNotNull()).select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"),
                                                     F.xxhash64("text").alias("same"), t.alias("t"))
    tail = F.substring("t", -TAIL, TAIL)
    d = d.select("*", tail.rlike(_DOTS).alias("dots"), tail.alias("tail"))
    d = d.withColumn("base", F.when(F.col("dots"), F.regexp_replace("t", "[…. ]+$", "")).otherwise(F.col("t")))
    low = F.lower(F.regexp_replace("base", "\\d+", "0"))
    d = d.withColumn("pieces", F.transform(F.split(low, _BREAK), lambda x: F.trim(x)))
    d = d.withColumn("last", F.element_at("pieces", -1))
    end = F.substring("base", -TAIL, TAIL)
    ended = end.rlike(_ENDED)
    state = (
        F.when(F.col("t") == "", "whole")
        .when(F.col("tail").rlike(_BROKEN), "broken")
        .when(F.col("dots"), F.when(ended | (F.col("base") == ""), "whole").otherwise("dots"))
        .when(ended, F.when(F.col("tail").rlike(_OPEN_NUMBER), "open").otherwise("whole"))
        .when(F.col("last").rlike(_CLOSING), "whole")
        .otherwise("open")
    )
    inner = F.filter(F.slice("pieces", F.lit(1), F.size("pieces") - 1), lambda x: x != "")
    return d.select(
        "doc_id", "source", "chars", "bytes", "same", state.alias("state"), _openings(F.col("last")).alias("openings"), _end(F.col("last")).alias("end"),
        F.flatten(F.transform(inner, _openings)).alias("inner_openings"), F.transform(inner, _end).alias("inner_ends"))


def phrase_uses(ends: DataFrame) -> DataFrame:
    """How sentences and lines begin and end over all texts: (``kind``, ``key``, ``last``: uses as the last piece where that is not finished, ``inner``: other
    uses). Each text counts once, however often it was delivered."""
    once = ends.select("same", "state", "openings", "end", "inner_openings", "inner_ends").dropDuplicates(["same"])
    mark = lambda kind, final: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key"), F.lit(final).alias("final"))
    unfinished = F.when(F.col("state").isin("open", "dots"), F.transform("openings", mark("opening", True))).otherwise(F.array().cast("array<struct<kind:string,key:string,final:boolean>>"))
    uses = F.concat(unfinished, F.transform("inner_openings", mark("opening", False)), F.transform("inner_ends", mark("end", False)))
    return once.select(F.inline(uses)).groupBy("kind", "key").agg(F.count_if("final").alias("last"), F.count_if(~F.col("final")).alias("inner"))


def length_tests(ends: DataFrame) -> DataFrame:
    """(``source``, ``unit``, ``len``, ``texts``, ``p``, ``significant``): the hazard of ending at a length, of those texts at least so long,
    tested against the hazard of the neighbouring lengths. Each text counts once per source; a null source, and all sources
    together ('*'), are groups of their own. ``expected`` is what the neighbours' hazard gives for the texts alive here (null without neighbours).
    ``p`` is Chernoff's bound of the binomial tail: of the texts that end here or near, so many here. It holds for
    few neighbours too, whose hazard is itself uncertain. Significance is by Benjamini and Hochberg's procedure over all lengths of all groups."""
    groups = F.array(F.coalesce("source", F.lit("")), F.lit("*"))
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("long").alias("len")) for u in ("chars", "bytes")])
    once = ends.select(F.explode(groups).alias("source"), "chars", "bytes", "same").distinct()
    sizes = once.select("source", F.explode(units).alias("u")).groupBy("source", "u.unit", "u.len").agg(F.count("*").alias("texts"))
    by = W.partitionBy("source", "unit").orderBy("len")
    down = W.partitionBy("source", "unit").orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, 0)
    h = sizes.withColumn("alive", F.sum("texts").over(down))
    # texts that end near, and over the lengths near the texts alive there: a length that nobody reaches adds nothing, one at which nobody ends does
    over = lambda c, a, b: F.coalesce(F.sum(c).over(by.rangeBetween(a, b)), F.lit(0))
    # from so far on, as the whole less what lies before: a frame without end would be summed anew for every length
    whole = F.sum("texts").over(W.partitionBy("source", "unit"))
    since = lambda a: whole - over("texts", W.unboundedPreceding, a - 1)
    ends_near = over("texts", -REACH, -GAP) + over("texts", GAP, REACH)
    low = F.greatest(F.col("len") - REACH, F.lit(0))
    below = F.greatest(F.col("len") - GAP - low + 1, F.lit(0)) * since(-GAP) + over(F.col("texts") * F.col("len"), -REACH, -GAP - 1) - (low - 1) * over("texts", -REACH, -GAP - 1)
    above = (REACH - GAP + 1) * since(REACH) + over(F.col("texts") * F.col("len"), GAP, REACH - 1) - (F.col("len") + GAP - 1) * over("texts", GAP, REACH - 1)
    h = h.withColumn("near", ends_near).withColumn("alive_near", F.when(F.col("len") >= GAP, below).otherwise(0) + above)
    n, m = F.col("texts").cast("double"), F.col("near").cast("double")
    # of the texts that end here or near, the share that equal hazards would end here
    share = F.col("alive") / (F.col("alive") + F.col("alive_near"))
    part = n / (n + m)
    bound = F.exp(-n * F.log(part / share) - F.when(m > 0, m * F.log((1 - part) / (1 - share))).otherwise(0.0))
    p = F.when(part > share, bound).otherwise(F.lit(1.0))
    expected = F.when(F.col("alive_near") > 0, F.col("alive") * m / F.col("alive_near"))
    tests = h.withColumn("hazard", F.col("texts") / F.col("alive")).withColumn("expected", expected).withColumn("p", p).where(F.col("texts") >= LEAST)
    tests = materialise(tests, "length-tests")
    count = tests.count()
    # Benjamini and Hochberg's threshold is the largest t = FDR x (tests with p <= t) / tests; counting downwards from FDR reaches it
    found, last = tests.where(F.col("p") <= FDR).count(), -1
    while found != last:
        top, last = FDR * found / max(count, 1), found
        found = tests.where(F.col("p") <= top).count()
    return tests.withColumn("significant", (F.col("p") <= F.lit(top if found else -1.0)) & F.coalesce(F.col("texts") >= RATIO * F.col("expected"), F.lit(False)))


def _wilson_low(hits: Column, n: Column) -> Column:
    p, m = hits / n, n.cast("double")
    return (p + Z * Z / (2 * m) - Z * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))) / (1 + Z * Z / m)


def truncated(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``source``, ``cause``) of the documents that were cut off: 'limit' or 'transfer'.

    Limits: at a length, in characters or bytes, that is significant for the document's source or for all sources, a text whose end is not
    finished was cut, unless its last piece is a closing that other texts end with too (``CLOSES``). Cuts in transfer fall on any length, which no
    hazard can show, so away from significant lengths the text itself must tell: a broken character, entity or address; a last piece of fewer letters
    than any opening has; or a last piece that begins as sentences do that go on (``GOES_ON``), which sign-offs do not, since they stand last
    wherever they occur. Dots after a piece that ends as a sentence elsewhere are an omission. Shares and bounds do not depend on the size of the
    collection, and each different text counts once. Null, empty and blank texts are not cut. Ids that repeat are judged row by row, like texts in like way.
    """
    ends = materialise(endings(docs.select("doc_id", "source", "text")), "endings")
    limits = length_tests(ends).where("significant").select(F.col("source").alias("_s"), F.col("unit").alias("_u"), F.col("len").alias("_l")).distinct()
    cand = ends.where(F.col("state") != "whole").select("doc_id", "same", "source", "chars", "bytes", "state", F.get("openings", F.lit(0)).alias("opening"), "end")
    # at most a few lengths per source pass; each lookup below is an equi-join that Spark broadcasts only if it is small
    keys = F.array(*[F.struct(s.alias("s"), F.lit(u).alias("u"), F.col(u).cast("long").alias("l")) for u in ("chars", "bytes") for s in (F.coalesce("source", F.lit("")), F.lit("*"))])
    at = cand.select("same", "source", F.explode(keys).alias("k")).join(limits, (F.col("k.s") == F.col("_s")) & (F.col("k.u") == F.col("_u")) & (F.col("k.l") == F.col("_l")))
    at = at.select(F.col("same").alias("_same"), F.coalesce("source", F.lit("")).alias("_src")).distinct().withColumn("limited", F.lit(True))
    j = cand.join(at, (F.col("same") == F.col("_same")) & (F.coalesce("source", F.lit("")) == F.col("_src")), "left").withColumn("limited", F.coalesce("limited", F.lit(False)))
    j = materialise(j.select("doc_id", "source", "state", "opening", "end", "limited"), "unfinished")
    uses = materialise(phrase_uses(ends), "phrase-uses")
    seen = uses.where("kind = 'opening'").select(F.col("key").alias("_open"), F.col("last").alias("o_last"), F.col("inner").alias("o_inner"))
    closed = uses.where("kind = 'end'").select(F.col("key").alias("_end"), F.col("inner").alias("e_inner"))
    n = F.col("o_last") + F.col("o_inner")
    share = lambda x: F.coalesce(_wilson_low(F.col(x), n), F.lit(0.0))
    goes_on, closing, sentence = share("o_inner") >= GOES_ON, share("o_last") >= CLOSES, (F.col("state") == "dots") & F.col("e_inner").isNotNull()
    at_limit = ~closing & ~sentence
    away = (F.col("state") == "broken") | ~sentence & goes_on | (F.col("state") == "open") & F.col("opening").isNull()
    cut = F.when(F.col("limited"), at_limit | (F.col("state") == "broken")).otherwise(away)
    lost = j.join(seen, F.col("opening") == F.col("_open"), "left").join(closed, F.col("end") == F.col("_end"), "left").where(cut)
    return lost.select("doc_id", "source", F.when(F.col("limited"), "limit").otherwise("transfer").alias("cause"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncated(table(spark, sf, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, cut documents and their share per source (null and '' apart)."""
    docs = table(spark, sf, "documents")
    cut = truncated(docs).groupBy("source", "cause").agg(F.count("*").alias("k"))
    cut = cut.groupBy("source").agg(F.sum("k").alias("cut"), F.coalesce(F.sum(F.when(F.col("cause") == "limit", F.col("k"))), F.lit(0)).alias("cut_by_limit"))
    all_ = docs.groupBy(F.col("source").alias("_src")).agg(F.count("*").alias("documents"))
    return all_.join(cut, F.col("_src").eqNullSafe(F.col("source")), "left").select(
        F.col("_src").alias("source"), "documents", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("cut_by_limit", F.lit(0)).alias("cut_by_limit"),
        (F.coalesce("cut", F.lit(0)) / F.col("documents")).alias("rate"))


def p10_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """The significant lengths per source."""
    ends = materialise(endings(table(spark, sf, "documents").select("doc_id", "source", "text")), "endings")
    return length_tests(ends).where("significant").select("source", "unit", "len", "texts", "hazard", "expected", "p")


QUERIES = {"p10_found": p10_found, "p10_rates": p10_rates, "p10_lengths": p10_lengths}
SQL: dict[str, str] = {}
