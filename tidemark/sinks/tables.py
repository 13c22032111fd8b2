"""Wide tables, archives and texts made of aggregates. What comes here is a few rows per category; only such results reach the driver."""

from __future__ import annotations

import html
import json
import os
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide(long: DataFrame, keys: Sequence[str], column: str, value: str, prefix: str = "", names: Sequence[str] | None = None) -> DataFrame:
    """Long to wide with ``names``, or else the observed ones, sorted, as columns; missing values are 0."""
    names = list(names) if names else sorted(r[0] for r in long.select(column).distinct().collect() if r[0] is not None)
    w = long.groupBy(*keys).pivot(column, names).agg(F.first(value))
    return w.select(*keys, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"{prefix}{n}") for n in names])


def heatmap_json(soft: DataFrame) -> DataFrame:
    """One JSON text: for each dimension a map 'tname_zone' -> {label: share}."""
    per = soft.groupBy("dim", F.concat_ws("_", "tname", "zone_type").alias("key")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "ratio")))).alias("m"))
    dims = per.groupBy("dim").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.to_json("m").alias("j"))))).alias("m"))
    return dims.select("dim", F.to_json("m").alias("json"))


def coder_rows(records: DataFrame) -> DataFrame:
    """One flat row per label record for inter-coder tests, with defaults."""
    d = lambda f, x: F.coalesce(F.col(f"output.{f}"), F.lit(x))
    return records.select(
        "bvid", "tname", "zone_type", "segment_id", "dm_id", d("emotion.label", "neutral").alias("emotion"), d("emotion.confidence", 0.5).alias("emotion_confidence"),
        d("cooperative_principle.violated", False).alias("violated"), F.col("output.cooperative_principle.maxim").alias("maxim"), d("interaction_type.label", "other").alias("interaction_type"),
        d("sentence_function.label", "fragment").alias("sentence_function"), d("orthography.status", "standard").alias("orthography"),
        "consensus_level", F.round("jsd_score", 6).alias("jsd_score"), "weight_multiplier")


def report_metadata(groups: DataFrame, **extra) -> dict:
    """Totals over groups (a video in two zones counts in both), distinct categories; given fields override."""
    r = groups.agg(F.count("*").alias("groups"), F.sum("danmaku_count").alias("total_danmaku"), F.sum("segments").alias("total_segments"), F.sort_array(F.collect_set("tname")).alias("partitions")).first()
    return r.asDict() | extra


def write_csv(df: DataFrame, path: str, renames: dict[str, str] | None = None) -> list[str]:
    """A small result as CSV with a byte order mark, and a twin with translated headers if names are given. A header stands even without rows."""
    p = df.toPandas()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    p.to_csv(path, index=False, encoding="utf-8-sig")
    if not renames:
        return [path]
    twin = path.removesuffix(".csv") + "_translated.csv"
    p.rename(columns=lambda c: translated(c, renames)).to_csv(twin, index=False, encoding="utf-8-sig")
    return [path, twin]


def translated(column: str, names: dict[str, str]) -> str:
    """Exact name, else the longest prefix ending in '_', else unchanged."""
    if column in names:
        return names[column]
    hits = [p for p in names if p.endswith("_") and column.startswith(p)]
    return names[max(hits, key=len)] + column[len(max(hits, key=len)) :] if hits else column


def pack_zip(files: Sequence[str], target: str, remove: bool = True, inside: dict[str, str] | None = None) -> bool:
    """Pack existing files (base names once, the first wins), verify, then remove them; on failure they stay."""
    have, names = [], set()
    for f in files:
        name = (inside or {}).get(f, os.path.basename(f))
        if os.path.isfile(f) and name not in names:
            have.append((f, name))
            names.add(name)
    tmp = target + ".tmp"
    try:
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f, name in have:
                z.write(f, name)
        with zipfile.ZipFile(tmp) as z:
            if not have or len(z.namelist()) != len(have) or z.testzip():
                raise zipfile.BadZipFile("incomplete")
        os.replace(tmp, target)
    except (OSError, zipfile.BadZipFile):
        if os.path.exists(tmp):
            os.remove(tmp)
        return False
    if remove:
        for f, _ in have:
            os.remove(f)
    return True


def optional(write, *args, **kw):
    """Run a writer whose failure must not fail the rest; its result, or None."""
    try:
        return write(*args, **kw)
    except Exception:  # noqa: BLE001
        return None


def number(v, digits: int = 4) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return "--"
    return (f"{v:.{digits}f}".rstrip("0").rstrip(".") or "0") if isinstance(v, float) else str(v)


def p_text(p: float) -> str:
    return "p < .001" if p < 0.001 else f"p = {p:.3f}".replace("0.", ".", 1)


def latex_table(df: pd.DataFrame, caption: str, label: str) -> str:
    esc = lambda s: "".join({"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}.get(c, "\\" + c if c in "&%$#_{}" else c) for c in s)
    rows = [" & ".join(esc(number(v)) if not isinstance(v, str) else esc(v) for v in r) + r" \\" for r in df.itertuples(index=False)]
    head = " & ".join(esc(str(c)) for c in df.columns) + r" \\"
    body = "\n".join([r"\toprule", head, r"\midrule", *rows, r"\bottomrule"])
    return f"\\begin{{table}}[htbp]\n\\caption{{{esc(caption)}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body}\n\\end{{tabular}}\n\\end{{table}}\n"


def apa_descriptives(df: pd.DataFrame) -> str:
    """One sentence per row: means with deviations, then other numbers."""
    out = []
    for r in df.to_dict("records"):
        pairs = [c[:-5] for c in df.columns if c.endswith("_mean") and f"{c[:-5]}_std" in df.columns]
        parts = [f"{m}: M = {r[m + '_mean']:.3f}, SD = {r[m + '_std']:.3f}" for m in pairs]
        out.append(f"{r.get('tname', '')} (k = {r.get('video_count', 0)}, N = {r.get('total_danmaku', 0)}): " + "; ".join(parts) + ".")
    return "\n".join(out)


def apa_tests(kruskal: pd.DataFrame, pairs: pd.DataFrame) -> str:
    out = [f"{r.metric}: H({r.k - 1}) = {r.h:.3f}, {p_text(r.p_value)}, epsilon squared = {r.epsilon_squared:.3f}." for r in kruskal.itertuples()]
    out += [f"{r.metric}, {r.group_a} vs {r.group_b}: U = {r.u:.3f}, {p_text(r.p_value)}, delta = {r.cliff_delta:.3f} ({r.magnitude})." for r in pairs.itertuples()]
    return "\n".join(out)


def html_report(title: str, tables: dict[str, pd.DataFrame], meta: dict) -> str:
    """A self-contained page: facts, tables, and bars for shares between 0 and 1."""
    bar = lambda v: f'<svg width="80" height="8"><rect width="{80 * min(1.0, max(0.0, v)):.1f}" height="8"/></svg> {v:.3f}' if isinstance(v, float) and v == v and 0 <= v <= 1 else html.escape(number(v) if not isinstance(v, str) else v)
    facts = "".join(f"<li>{html.escape(str(k))}: {html.escape(json.dumps(v, ensure_ascii=False, default=str))}</li>" for k, v in meta.items())
    parts = []
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(str(c))}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{bar(v)}</td>" for v in r) + "</tr>" for r in df.itertuples(index=False))
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{rows}</table>")
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{facts}</ul>{"".join(parts)}'


def reproducibility(settings, spark) -> dict:
    import platform
    from dataclasses import asdict

    return {"settings": asdict(settings), "python": platform.python_version(), "spark": spark.version, "conf": {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")}}


def methodology(settings, fixed: bool = False, tests: bool = False) -> str:
    """How the numbers were made, by the settings that were used."""
    s = settings
    cut = f"every {s.fixed_step} comments" if fixed else f"at change points of the per-second density (squared error, penalty {s.pelt_penalty:g}); segments under {s.min_segment_samples} comments were merged"
    text = [f"Each user counts once per video; anonymous comments all stay. Timelines were cut {cut}. Segments denser than the mean plus 1.5 median absolute deviations are hot.",
            f"Two annotation paths agree highly below a divergence of {s.consensus_high_below:g}, not at all from {s.consensus_medium_below:g} on; the latter weigh {s.low_consensus_weight:g}. Intervals are Wilson intervals at {s.confidence_level:g}."]
    if tests:
        text.append("Groups were compared by Kruskal-Wallis tests, pairs by Mann-Whitney tests with Cliff's delta, zones by paired Wilcoxon tests; no correction for multiple tests was made.")
    return "\n\n".join(text)

