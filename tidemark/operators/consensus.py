"""Agreement of two annotation paths: divergence, level, merge, weight, kappa."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.settings import DEFAULT, Settings

# The label sets.
EMOTION = ("positive", "neutral", "negative")
INTERACTION = ("check_in", "identity_claim", "mocking", "info_request", "expression", "other")
ORTHOGRAPHY = ("standard", "community_variant", "non_standard_typo")
SENTENCE = ("declarative", "interrogative", "imperative", "exclamatory", "fragment")
MAXIMS = ("quantity", "quality", "relation", "manner")
OUTPUT_SCHEMA = (
    "emotion STRUCT<label STRING, confidence DOUBLE>, cooperative_principle STRUCT<violated BOOLEAN, maxim STRING>, interaction_type STRUCT<label STRING, confidence DOUBLE>, "
    "sentence_function STRUCT<label STRING, confidence DOUBLE>, orthography STRUCT<status STRING, confidence DOUBLE>"
)
EPS = 1e-10


def distribution(label: Column, confidence: Column, labels: Sequence[str]) -> Column:
    """The label's confidence, the rest shared by the others; an unknown label is uniform."""
    arr, n = F.array(*map(F.lit, labels)), len(labels)
    rest = (F.lit(1.0) - confidence) / F.lit(float(n - 1))
    known = F.transform(arr, lambda x: F.when(x == label, confidence).otherwise(rest))
    return F.when(F.coalesce(F.array_contains(arr, label), F.lit(False)), known).otherwise(F.array(*[F.lit(1.0 / n)] * n))


def normalised_jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two distributions over ln 2, smoothed."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x + EPS)
    norm = lambda a: F.transform(a, lambda x: (x + EPS) / total(a))
    terms = F.zip_with(norm(p), norm(q), lambda x, y: x * F.log(2.0 * x / (x + y)) + y * F.log(2.0 * y / (x + y)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.lit(2.0) / F.log(F.lit(2.0))


def categorical_jsd(la: Column, ca: Column, lb: Column, cb: Column, labels: Sequence[str]) -> Column:
    """``normalised_jsd`` of the distributions of two labels with confidences, in closed form: outside the labels named, all
    entries of a distribution are equal, so at most three terms differ and no array is needed."""
    n = len(labels)
    known = lambda x: F.coalesce(x.isin(*labels), F.lit(False))
    smooth = lambda x: (x + EPS) / (1.0 + n * EPS)
    top = lambda x, c: smooth(F.when(known(x), c).otherwise(F.lit(1.0 / n)))
    rest = lambda x, c: smooth(F.when(known(x), (F.lit(1.0) - c) / (n - 1.0)).otherwise(F.lit(1.0 / n)))
    term = lambda x, y: x * F.log(2.0 * x / (x + y)) + y * F.log(2.0 * y / (x + y))
    a, ra, b, rb = top(la, ca), rest(la, ca), top(lb, cb), rest(lb, cb)
    same = la.eqNullSafe(lb) | ~known(la) | ~known(lb)
    total = F.when(same, term(a, b) + (n - 1.0) * term(ra, rb)).otherwise(term(a, rb) + term(ra, b) + (n - 2.0) * term(ra, rb))
    # an unknown label is uniform: then the other's label decides which entry is the odd one
    total = F.when(known(la) & ~known(lb), term(a, rb) + (n - 1.0) * term(ra, rb)).when(~known(la) & known(lb), term(ra, b) + (n - 1.0) * term(ra, rb)).otherwise(total)
    return total / F.lit(2.0) / F.log(F.lit(2.0))


def jsd_score(a: str, b: str) -> Column:
    """Mean over emotion, interaction, orthography and violation of two output structs; with fewer than two outputs 0."""
    c = lambda s, f: F.col(f"{s}.{f}")
    conf = lambda s, dim: F.coalesce(c(s, f"{dim}.confidence"), F.lit(0.5))
    dims = [categorical_jsd(c(a, f"{dim}.{field}"), conf(a, dim), c(b, f"{dim}.{field}"), conf(b, dim), labels)
            for dim, field, labels in (("emotion", "label", EMOTION), ("interaction_type", "label", INTERACTION), ("orthography", "status", ORTHOGRAPHY))]
    word = lambda s: F.when(F.coalesce(c(s, "cooperative_principle.violated"), F.lit(False)), "y").otherwise("n")
    dims.append(categorical_jsd(word(a), F.lit(1.0), word(b), F.lit(1.0), ("y", "n")))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.0)).otherwise(sum(dims[1:], dims[0]) / 4.0)


def consensus_level(jsd: Column, s: Settings = DEFAULT) -> Column:
    return F.when(jsd < s.consensus_high_below, "high").when(jsd < s.consensus_medium_below, "medium").otherwise("low")


def weight_multiplier(level: Column, s: Settings = DEFAULT) -> Column:
    return F.when(level == "low", F.lit(s.low_consensus_weight)).otherwise(F.lit(1.0))


def confidence_sum(a: str) -> Column:
    return sum((F.coalesce(F.col(f"{a}.{d}.confidence"), F.lit(0.5)) for d in ("interaction_type", "orthography")), F.coalesce(F.col(f"{a}.emotion.confidence"), F.lit(0.5)))


def merged_output(a: str, b: str, level: Column) -> Column:
    """High consensus: the first path; else the one with the larger sum of confidences, the first on a tie; a lost path gives way."""
    return F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull() | (level == "high") | (confidence_sum(a) >= confidence_sum(b)), F.col(a)).otherwise(F.col(b))


def reconcile(paths: DataFrame, a: str = "path_a", b: str = "path_b", s: Settings = DEFAULT) -> DataFrame:
    """Adds jsd_score, consensus_level, weight_multiplier and the merged ``output``. Both paths lost: level low, default output null."""
    d = paths.withColumn("jsd_score", jsd_score(a, b))
    both_lost = F.col(a).isNull() & F.col(b).isNull()
    d = d.withColumn("consensus_level", F.when(both_lost, "low").otherwise(consensus_level(F.col("jsd_score"), s)))
    return d.withColumn("weight_multiplier", weight_multiplier(F.col("consensus_level"), s)).withColumn("output", merged_output(a, b, F.col("consensus_level")))


def parse_outputs(raw: DataFrame, column: str) -> DataFrame:
    """Adds ``output`` (null if the text is no JSON object) and ``valid``: known labels, confidences from 0 to 1; a maxim only with a violation."""
    out = F.from_json(F.col(column), OUTPUT_SCHEMA)
    d = raw.withColumn("_o", out)
    fixed = F.col("_o").withField("cooperative_principle.maxim", F.when(F.col("_o.cooperative_principle.violated"), F.col("_o.cooperative_principle.maxim")))
    known = lambda f, labels: F.coalesce(F.col(f).isin(*labels), F.lit(False))
    inside = lambda f: F.coalesce(F.col(f).between(0.0, 1.0), F.lit(True))
    ok = known("_o.emotion.label", EMOTION) & known("_o.interaction_type.label", INTERACTION) & known("_o.orthography.status", ORTHOGRAPHY) & inside("_o.emotion.confidence") & inside("_o.interaction_type.confidence") & inside("_o.orthography.confidence")
    return d.withColumn("output", fixed).withColumn("valid", ok).drop("_o")


def cohen_kappa(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Kappa of two label columns per group, 4 digits: null for no pairs; with certain chance agreement 1 if all agree, else null."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count("*").alias("c"))
    left = cells.groupBy(*keys, F.col("la").alias("lab")).agg(F.sum("c").alias("x")).withColumn("y", F.lit(0).cast("long"))
    right = cells.groupBy(*keys, F.col("lb").alias("lab")).agg(F.sum("c").alias("y")).withColumn("x", F.lit(0).cast("long"))
    m = left.unionByName(right).groupBy(*keys, "lab").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    pe = m.groupBy(*keys).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    po = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("c")).otherwise(0)).alias("same"))
    j = po.join(pe, list(keys)) if keys else po.crossJoin(pe)  # without keys both sides are one row
    p_o, p_e = F.col("same") / F.col("n"), F.col("xy") / (F.col("n").cast("double") * F.col("n"))
    k = F.when(p_e >= 1.0, F.when(p_o == 1.0, 1.0)).otherwise((p_o - p_e) / (F.lit(1.0) - p_e))
    return j.select(*keys, "n", F.round(k, 4).alias("kappa"))


def dual_path_kappa(paths: DataFrame, a: str = "path_a", b: str = "path_b") -> DataFrame:
    """Kappa per dimension over records with both outputs."""
    fields = (("emotion", "emotion.label"), ("interaction_type", "interaction_type.label"), ("sentence_function", "sentence_function.label"), ("orthography", "orthography.status"))
    both = paths.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"{a}.{f}").alias("la"), F.col(f"{b}.{f}").alias("lb")) for d, f in fields])
    return cohen_kappa(both.select(F.inline(dims)), "la", "lb", ["dim"])
