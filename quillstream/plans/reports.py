"""Reports: small results rendered as Markdown or JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a small result (a report's group counts), at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def markdown_report(title: str, parts: dict[str, DataFrame]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in parts.items())]) + "\n"


def json_report(parts: dict[str, DataFrame], limit: int = 1000) -> str:
    return json.dumps({name: [r.asDict(recursive=True) for r in df.limit(limit).collect()] for name, df in parts.items()}, ensure_ascii=False, default=str, sort_keys=True)


def write_partition(df: DataFrame, path: str, key: str = "session_id") -> None:
    """Replace only the sessions that ``df`` holds; readers never see half a session."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
