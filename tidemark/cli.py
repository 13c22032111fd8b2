"""Command line: list and run queries, compare snapshots, export text."""

from __future__ import annotations

import argparse

from tidemark.session import build_session


def main(argv: list[str] | None = None, known: dict | None = None) -> int:
    """``known``: the queries by name; those of the core if not given."""
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("list")
    for verb in ("run", "export"):
        q = sub.add_parser(verb)
        q.add_argument("query")
        q.add_argument("data")
        q.add_argument("out")
        q.add_argument("--format", choices=("parquet", "csv", "json") if verb == "run" else ("latex", "apa", "html"), default="parquet" if verb == "run" else "latex")
    d = sub.add_parser("diff")
    d.add_argument("data")
    a = p.parse_args(argv)
    if known is None:
        from tidemark.plans.catalogue import queries

        known = queries()
    if a.verb == "list":
        print("\n".join(sorted(known)))
        return 0
    name = "p3_change_counts" if a.verb == "diff" else a.query
    if name not in known:
        print(f"no query {name}")
        return 2
    spark = build_session()
    df = known[name](spark, a.data)
    if a.verb == "diff":
        df.orderBy("snapshot_no", "change_type", "field").show(50, truncate=False)
    elif a.verb == "run":
        df.write.mode("overwrite").format(a.format).save(a.out)
    else:
        from tidemark.sinks import tables as S

        pdf = df.toPandas()
        text = {"latex": lambda: S.latex_table(pdf, name, f"tab:{name}"), "apa": lambda: S.apa_descriptives(pdf), "html": lambda: S.html_report(name, {name: pdf}, {"data": a.data})}[a.format]()
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
