"""Column functions over texts, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.session import trimmed

# Patterns and tables that results depend on.
EMPHASIS = "[!?~！？～]"
UPPER_RUN = "[A-Z]{2,}"
DIGIT_RUN = "\\d{2,}"
EMOTICON = "[（(][\\u4e00-\\u9fff\\w\\s・ω･｡]+[）)]"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}\\x{2B50}\\x{2B55}]"
POS_ALIASES = {
    "noun": "n", "verb": "v", "adjective": "a", "adj": "a", "adverb": "d", "adv": "d", "pronoun": "r", "auxiliary": "v", "preposition": "p",
    "prep": "p", "conjunction": "c", "conj": "c", "particle": "u", "interjection": "e", "modal": "y", "onomatopoeia": "o", "proper_noun": "nz", "proper noun": "nz",
}
TOKEN = "[A-Za-z]+|[0-9]+|[\\u3400-\\u9fff]{1,2}|[\\u3041-\\u3096\\u30a1-\\u30fa\\u30fc-\\u30fe]+|[\\uac00-\\ud7a3]+"


def period_bucket(pubdate: Column, granularity: str = "year") -> Column:
    """'2025', '2025-Q1' or '2025-03' of an ISO text; 'unknown' for null, blank or bad text."""
    t = F.try_to_timestamp(pubdate)
    form = {"year": F.date_format(t, "yyyy"), "quarter": F.concat(F.date_format(t, "yyyy"), F.lit("-Q"), F.quarter(t)), "month": F.date_format(t, "yyyy-MM")}
    return F.coalesce(form[granularity], F.lit("unknown"))


def has_emphasis(c: Column) -> Column:
    return c.rlike(EMPHASIS)


def has_emoji(c: Column) -> Column:
    """By explicit code-point ranges: an approximation of a full emoji table."""
    return c.rlike(EMOJI)


def upper_runs(c: Column) -> Column:
    return F.regexp_count(c, F.lit(UPPER_RUN))


def digit_runs(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?U)" + DIGIT_RUN))


def emoticons(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?U)" + EMOTICON))


def word_chars(c: Column) -> Column:
    """Length without anything but word characters and white space."""
    return F.length(F.regexp_replace(c, "(?U)[^\\w\\s]", ""))


def tokens(c: Column) -> Column:
    """The built-in tokeniser: Latin words, numbers, and CJK text by pieces of up to two characters."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def shape_pos(word: Column) -> Column:
    return F.when(word.rlike("^[A-Za-z]"), "eng").when(word.rlike("^[0-9]"), "m").otherwise("n")


def syllables(word: Column) -> Column:
    n = F.length(trimmed(word))
    return F.when(n == 1, "one").when(n == 2, "two").otherwise("three_plus")


def pos_alias(pos: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in POS_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(trimmed(pos))), trimmed(pos))


def token_estimate(c: Column) -> Column:
    """Half a token for a CJK character, three tenths for any other; at least one, 0 for null and empty text."""
    cjk = F.regexp_count(c, F.lit("[\\u4e00-\\u9fff]"))
    est = F.floor(cjk * F.lit(0.5) + (F.length(c) - cjk) * F.lit(0.3))
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.greatest(F.lit(1), est)).cast("long")


def uid_digest(uid: Column) -> Column:
    return F.substring(F.md5(uid.cast("string")), 1, 16)


def clean_title(c: Column) -> Column:
    """Without emphasis tags, basic entities resolved, trimmed."""
    c = F.regexp_replace(c, "</?em[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return trimmed(c)


def safe_file_name(c: Column, most_bytes: int = 150) -> Column:
    """Illegal characters become '_', no dots or spaces at the end, at most so many UTF-8 bytes, never half a character."""
    tail = lambda x: F.regexp_replace(x, "[. ]+$", "")
    c = tail(trimmed(F.translate(c, '\\/:*?"<>|', "_________")))
    sizes = F.transform(F.split(c, ""), lambda ch: F.octet_length(ch))
    kept = F.aggregate(
        sizes, F.struct(F.lit(0).alias("b"), F.lit(0).alias("n")),
        lambda a, x: F.struct((a.b + x).alias("b"), F.when(a.b + x <= most_bytes, a.n + 1).otherwise(a.n).alias("n")), lambda a: a.n)
    return F.when(F.octet_length(c) <= most_bytes, c).otherwise(tail(F.substring(c, F.lit(1), kept)))


def split_inputs(c: Column) -> Column:
    return F.filter(F.split(c, "[\\s,;，；]+"), lambda x: x != "")


def parse_input(c: Column) -> Column:
    """STRUCT(input_type, bvid, avid) of a video reference: an id, a number, a page address, or a short link, which has no id of its own."""
    t = trimmed(c)
    bv, av = t.rlike("(?i)^BV[a-zA-Z0-9]{10}$"), F.regexp_extract(t, "(?i)^av(\\d+)$", 1)
    site = "(?i)https?://www\\.bilibili\\.com/video/"
    url_bv = F.coalesce(F.nullif(F.regexp_extract(t, site + "(BV[a-zA-Z0-9]{10})", 1), F.lit("")),
                        F.nullif(F.regexp_extract(t, "(?i)https?://player\\.bilibili\\.com/player\\.html\\?.*?bvid=(BV[a-zA-Z0-9]{10})", 1), F.lit("")))
    url_av = F.coalesce(F.nullif(F.regexp_extract(t, site + "av(\\d+)", 1), F.lit("")),
                        F.nullif(F.regexp_extract(t, "(?i)https?://player\\.bilibili\\.com/player\\.html\\?.*?aid=(\\d+)", 1), F.lit("")))
    short = t.rlike("(?i)^https?://b23\\.tv/[a-zA-Z0-9]+")
    kind = F.when(bv, "bv").when(av != "", "av").when(url_bv.isNotNull() | url_av.isNotNull() | short, "url").otherwise("unknown")
    bvid = F.when(bv, F.concat(F.lit("BV"), F.substring(t, 3, 10))).when((av == "") & url_bv.isNotNull(), F.concat(F.lit("BV"), F.substring(url_bv, 3, 10)))
    avid = F.when(~bv & (av != ""), av).when(~bv & url_bv.isNull(), url_av)
    return F.struct(kind.alias("input_type"), bvid.alias("bvid"), avid.try_cast("long").alias("avid"))


def strip_fence(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(c, "^\\s*```[a-zA-Z]*\\s*", ""), "\\s*```\\s*$", ""))


def latex_escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\u0000"))
    c = F.regexp_replace(c, "([&%$#_{}])", "\\\\$1")
    for raw, out in (("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("\u0000", "\\textbackslash{}")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def html_escape(c: Column) -> Column:
    for raw, out in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def segment_label(start: Column, end: Column) -> Column:
    return F.format_string("%.1f-%.1f", start, end)
