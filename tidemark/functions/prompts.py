"""Prompts for a labelling model, as column expressions, and the input of narrative reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.consensus import EMOTION, INTERACTION, MAXIMS, ORTHOGRAPHY, SENTENCE

DEFAULT_HINT = "everyday talk and feelings"
# Rows given to a narrative report.
GROUPS_SINGLE, GROUPS_CORPUS, TEST_ROWS = 3, 12, 80


def register_hint(tname: Column, hints: dict[str, str], default: str = DEFAULT_HINT) -> Column:
    pairs = [F.lit(x) for kv in hints.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), tname), F.lit(default)) if pairs else F.lit(default)


def system_prompt(tname: Column, tags: Column, hints: dict[str, str] | None = None) -> Column:
    """Names the category, its register and at most five tags, and the labels to choose from."""
    t = F.array_join(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 5), ", ")
    labels = f"emotion: {' | '.join(EMOTION)}; maxim: {' | '.join(MAXIMS)}; interaction_type: {' | '.join(INTERACTION)}; sentence_function: {' | '.join(SENTENCE)}; orthography: {' | '.join(ORTHOGRAPHY)}"
    return F.concat(F.lit("Label comments of category "), F.coalesce(tname, F.lit("unknown")), F.lit(". Register: "), register_hint(tname, hints or {}), F.lit(". Tags: "),
                    F.when(t == "", "none").otherwise(t), F.lit(f". Answer with one JSON object and confidences from 0 to 1. Labels: {labels}."))


def user_prompt(content: Column, context_text: Column) -> Column:
    return F.concat_ws("\n", F.lit("Comments around it:"), context_text, F.lit("Comment:"), content)


def batch_prompts(samples: DataFrame) -> DataFrame:
    """One request per segment: numbered comments of at most a sample's size, and how many answers are expected."""
    g = samples.groupBy("bvid", "segment_id").agg(F.array_sort(F.collect_list(F.struct("pick", "content"))).alias("a"))
    lines = F.transform("a", lambda x: F.concat(x.pick.cast("string"), F.lit(". "), x.content))
    return g.select("bvid", "segment_id", F.size("a").alias("expected"), F.concat(F.lit('Answer {"items": [...]} with one object per line:\n'), F.array_join(lines, "\n")).alias("prompt"))


def narrative_input(groups: DataFrame, order: str = "danmaku_count", limit: int = GROUPS_SINGLE) -> str:
    """The largest groups as a JSON list."""
    rows = groups.orderBy(F.desc(order)).limit(limit).select(F.to_json(F.struct("*")).alias("j")).collect()
    return "[" + ", ".join(r.j for r in rows) + "]"
