"""Records that differ only in formatting, collapsed by Merkle digests (problem 7)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import blank_to_null, materialise, table

#: White space, punctuation, the two tildes and invisible format characters; they carry no meaning in a record.
_IGNORED_JAVA = r"(?U)[\s\p{P}\p{Cf}~～]+"
_IGNORED = regex.compile(r"[\s\p{P}\p{Cf}~～]+")
#: At most this many groups can each hold a 256th of all rows.
HEAVY = 256
#: The fields that make a record, and those of them that count as written; all others play no part.
FIELDS, EXACT = ("bvid", "time_sec", "uid_hash", "content"), frozenset({"bvid"})


def plain(c: Column) -> Column:
    """A text without white space, letter case and punctuation; null for null."""
    return F.lower(F.regexp_replace(c, _IGNORED_JAVA, ""))


def plain_text(s: str) -> str:
    return _IGNORED.sub("", s).lower()


def merkle_root(fields: dict[str, Column]) -> Column:
    """Digest of a flat record whose leaves are already normalised: every leaf is hashed with its field's name, the
    child digests are sorted (fields have no order) and hashed again."""
    leaves = [F.xxhash64(F.lit(name), F.col(c) if isinstance(c, str) else c) for name, c in fields.items()]
    return F.xxhash64(F.sort_array(F.array(*leaves)))


def _leaf(v) -> bytes:
    if v is None:
        tag = b"z"
    elif isinstance(v, bool):
        tag = b"b1" if v else b"b0"
    elif isinstance(v, (int, float)):
        tag = b"n" + (repr(float(v) + 0.0) if abs(v) < 2**53 else str(v)).encode()
    else:
        tag = b"s" + plain_text(v).encode("utf-8", "surrogatepass")
    return hashlib.blake2b(tag, digest_size=8).digest()


def merkle_json(v, exact: frozenset[str] = frozenset()) -> bytes:
    """Digest of any nested JSON value: normalised leaves, objects unordered, arrays in order. Texts in fields named in ``exact`` count as written."""
    if isinstance(v, dict):
        kids = sorted(hashlib.blake2b(k.encode("utf-8", "surrogatepass") + b"\0" + (_exact(x) if k in exact and isinstance(x, str) else merkle_json(x, exact)), digest_size=8).digest() for k, x in v.items())
        return hashlib.blake2b(b"{" + b"".join(kids), digest_size=8).digest()
    if isinstance(v, list):
        return hashlib.blake2b(b"[" + b"".join(merkle_json(x, exact) for x in v), digest_size=8).digest()
    return _leaf(v)


def _exact(s: str) -> bytes:
    return hashlib.blake2b(b"x" + s.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def canonical_json(v, exact: frozenset[str] = frozenset()):
    """The normalised value itself, for the full comparison."""
    if isinstance(v, dict):
        return {k: x if k in exact and isinstance(x, str) else canonical_json(x, exact) for k, x in v.items()}
    if isinstance(v, list):
        return [canonical_json(x, exact) for x in v]
    if isinstance(v, str):
        return plain_text(v)
    return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 2**53 else v


def _parse(raw: str | None):
    """The object, or None unless the text is one valid JSON object (no NaN or Infinity)."""
    try:
        v = json.loads(raw, parse_constant=lambda s: (_ for _ in ()).throw(ValueError(s)))
    except (ValueError, TypeError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _payload_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, digests, forms = [], [], []
        for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = _parse(raw)
            if v is None or v.get("identity_type") != "real_user":
                continue
            t, text = v.get("time_sec"), v.get("content")
            if isinstance(t, bool) or not isinstance(t, (int, float)) or not isinstance(text, str) or not text.strip():
                continue
            if not isinstance(v.get("uid_hash"), str) or not isinstance(v.get("bvid"), str):
                continue
            v = {k: v[k] for k in FIELDS}
            digests.append(int.from_bytes(merkle_json(v, EXACT), "big", signed=True))
            forms.append(json.dumps(canonical_json(v, EXACT), sort_keys=True, ensure_ascii=True))
            ids.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(forms, pa.string())], ["id", "digest", "form"])


def payload_records(raw: DataFrame) -> DataFrame:
    """(``id``, ``digest``, ``form``) of the payloads that are valid JSON objects of real users with non-blank content, a
    numeric time, a viewer and a video; the others take no part. Fields may come in any order; fields besides ``FIELDS`` play no part,
    and ``bvid`` counts as written."""
    return raw.select("raw_id", "payload").mapInArrow(_payload_batches, "id bigint, digest bigint, form string")


def usable_comments(comments: DataFrame) -> DataFrame:
    """Rows of real users with non-blank content and non-null time, viewer and video, with the normalised leaves
    ``u`` (viewer) and ``n`` (content), and their record's ``digest``."""
    ok = (F.col("identity_type") == "real_user") & blank_to_null(F.col("content")).isNotNull() & F.col("time_sec").isNotNull() & F.col("uid_hash").isNotNull() & F.col("bvid").isNotNull()
    d = comments.where(ok).select("dm_id", "bvid", "seq", (F.col("time_sec") + F.lit(0.0)).alias("time_sec"), plain(F.col("uid_hash")).alias("u"), plain(F.col("content")).alias("n"), "content")
    return d.withColumn("digest", merkle_root({"bvid": "bvid", "time_sec": "time_sec", "uid_hash": "u", "content": "n"}))


def comment_records(comments: DataFrame) -> DataFrame:
    form = F.struct("bvid", "time_sec", "u", "n")
    return usable_comments(comments).select(F.col("dm_id").alias("id"), "digest", form.alias("form"))


def collapse(records: DataFrame) -> DataFrame:
    """One row per record: (``digest``, ``form``, ``keep_id``, ``copies``). Grouping is by root digest and, as the full
    structural comparison, by the normalised record itself, so records whose digests collide stay apart.
    Copies are pre-aggregated before the shuffle: a group that holds a third of all rows is no burden."""
    return records.groupBy("digest", "form").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))


def copy_links(records: DataFrame) -> DataFrame:
    """(``keep_id``, ``copy_id``), one row for every row but the smallest id of its record.

    Groups with more than one copy are written out; rows are joined to them by digest and compared in full. Groups that
    hold a 256th or more of the copies are at most 256, so those are broadcast and their rows never shuffled;
    the others go through a shuffled join. Empty tables give no rows; ids that repeat count as one row each but
    never as a copy of themselves.
    """
    groups = materialise(collapse(records).where(F.col("copies") > 1), "copy-groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    heavy = groups.where(F.col("copies") * HEAVY >= F.lit(total))
    digests = [r[0] for r in heavy.select("digest").distinct().collect()]
    pick = lambda d, g: d.alias("r").join(g.alias("g"), (F.col("r.digest") == F.col("g.digest")) & (F.col("r.form") == F.col("g.form"))).where(
        F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"))
    if not digests:
        return pick(records, groups)
    hot = F.col("digest").isin(digests)
    return pick(records.where(hot), F.broadcast(heavy)).unionByName(pick(records.where(~hot), groups.where(~hot)))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    a = copy_links(comment_records(table(spark, sf, "comments"))).select(F.lit("comments").alias("tbl"), "*")
    b = copy_links(payload_records(table(spark, sf, "raw_comments"))).select(F.lit("raw_comments").alias("tbl"), "*")
    return a.unionByName(b)


def p7_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record of either table, with the number of its copies."""
    out = None
    for name, d in (("comments", comment_records(table(spark, sf, "comments"))), ("raw_comments", payload_records(table(spark, sf, "raw_comments")))):
        d = collapse(d).select(F.lit(name).alias("tbl"), "keep_id", "copies")
        out = d if out is None else out.unionByName(d)
    return out


QUERIES = {"p7_found": p7_found, "p7_collapsed": p7_collapsed}

PLAIN_SQL = r"lower(regexp_replace({0}, '[\t-\r\x{{85}}\p{{Z}}\p{{P}}\p{{Cf}}~～]+', '', 'g'))"
FILLED_SQL = r"regexp_replace({0}, '[\t-\r\x{{85}}\p{{Z}}]+', '', 'g') <> ''"
RECORDS_SQL = f"""
recs AS (
  SELECT 'comments' AS tbl, dm_id AS id, bvid, time_sec, {PLAIN_SQL.format("uid_hash")} AS u, {PLAIN_SQL.format("content")} AS n
  FROM comments WHERE identity_type = 'real_user' AND {FILLED_SQL.format("content")} AND time_sec IS NOT NULL AND uid_hash IS NOT NULL AND bvid IS NOT NULL
  UNION ALL
  SELECT 'raw_comments', raw_id, json_extract_string(payload, '$.bvid'), CAST(json_extract_string(payload, '$.time_sec') AS DOUBLE),
    {PLAIN_SQL.format("json_extract_string(payload, '$.uid_hash')")}, {PLAIN_SQL.format("json_extract_string(payload, '$.content')")}
  FROM (SELECT * FROM raw_comments WHERE json_valid(payload)) WHERE json_extract_string(payload, '$.identity_type') = 'real_user'
    AND {FILLED_SQL.format("json_extract_string(payload, '$.content')")} AND json_extract_string(payload, '$.time_sec') IS NOT NULL),
sized AS (SELECT *, min(id) OVER w AS keep_id, count(*) OVER w AS copies FROM recs WINDOW w AS (PARTITION BY tbl, bvid, time_sec, u, n))
"""
SQL = {
    "p7_found": f"WITH {RECORDS_SQL} SELECT tbl, keep_id, id AS copy_id FROM sized WHERE id <> keep_id",
    "p7_collapsed": f"WITH {RECORDS_SQL} SELECT tbl, keep_id, copies FROM sized WHERE id = keep_id",
}
