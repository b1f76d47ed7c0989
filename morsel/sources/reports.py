"""Tables of measures as Markdown, text or JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from morsel.sources.files import write_bytes


def _cell(x: object) -> str:
    return "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)


def markdown(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = [[_cell(x) for x in r] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def console(df: DataFrame) -> str:
    rows = [df.columns, *[[_cell(x) for x in r] for r in df.collect()]]
    wide = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in rows)


def write_json(df: DataFrame, path: str) -> None:
    rows = [r.asDict(recursive=True) for r in df.collect()]
    write_bytes(df.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=1, default=str).encode())
