"""Reports, status files and certificates: small, ordered results rendered on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame


def markdown(df: DataFrame, title: str, group: str | None = None, most: int = 500) -> str:
    """A markdown table of at most `most` rows of an ordered result, by groups if asked."""
    rows = df.limit(most).collect()
    cols = [c for c in df.columns if c != group]
    out = [f"# {title}", ""]
    head = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    last = object()
    if not group:
        out += head
    for r in rows:
        if group and r[group] != last:
            last = r[group]
            out += ["", f"## {last}", "", *head]
        out.append("| " + " | ".join(str(r[c]).replace("|", "\\|").replace("\n", " ") for c in cols) + " |")
    return "\n".join(out if rows else [*out[:2], "Nothing found."]) + "\n"


def bars(df: DataFrame, label: str, value: str, width: int = 40, most: int = 200) -> str:
    """Rates as a bar chart of text."""
    rows = df.select(label, value).limit(most).collect()
    top = max((r[1] or 0 for r in rows), default=0) or 1
    return "\n".join(f"{r[0]!s:>20} {'#' * round(width * (r[1] or 0) / top)} {r[1] or 0:.2f}" for r in rows) + "\n"


def write_chapters(chapters: DataFrame, folder: str | Path) -> int:
    """Chapter files of a book, written as they stream to the driver."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for r in chapters.select("file_name", "header", "body").toLocalIterator():
        (Path(folder) / r["file_name"]).write_text("\n\n".join(x for x in (r["header"], r["body"]) if x) + "\n", encoding="utf-8")
        n += 1
    return n


def status_file(status: DataFrame, path: str | Path) -> None:
    """step -> icon as JSON; a file that can't be written is no failure of the run."""
    try:
        Path(path).write_text(json.dumps({r["step"]: r["icon"] for r in status.select("step", "icon").collect()}, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    except OSError:
        pass


def certificate(gate: DataFrame, title: str) -> str | None:
    """A text certificate if the gate is clean."""
    g = gate.first()
    return f"# Certificate\n\n{title}: all {g['steps']} steps are clean.\n" if g["clean"] else None
