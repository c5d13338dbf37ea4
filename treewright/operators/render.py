"""Diff rows as text: markers, branches, rails of back edges, colours. One tree is a reader's page, so a task renders it whole."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Glyphs by relation, for a node with later siblings and for the last one, and what its column goes on with.
GLYPHS = {"call": ("├─ ", "└─ ", "│  "), "dispatch_candidate": ("╠═ ", "╚═ ", "║  "), "back_edge": ("├─ ", "└─ ", "│  ")}
#: Fixed value: columns from the longest line to the first rail, and from rail to rail.
RAIL = 3
COLOURS = {"+": "\x1b[32m", "-": "\x1b[31m"}
RESET = "\x1b[0m"


def tree_lines(nodes: list[dict], ansi: bool = False) -> list[str]:
    """The lines of one tree; nodes in path order with path, key, label, relation, status, before_label, before_relation."""
    last, parents = {}, set()
    for n in nodes:
        path = tuple(n["path"])
        if path:
            last[path[:-1]] = path
            parents.add(path[:-1])
    indents: dict[tuple, str] = {(): ""}
    lines: list[tuple[str, str, str | None, str | None]] = []  # marker, text, anchor, target
    for n in nodes:
        path = tuple(n["path"])
        is_last = not path or last[path[:-1]] == path
        indent = indents[path[:-1]] if path else ""
        head = lambda relation: indent + (GLYPHS[relation][is_last] if path else "")  # noqa: B023, E731
        indents[path] = "" if not path else indent + ("   " if is_last else GLYPHS[n["relation"]][2])
        anchor = n["key"] if path in parents else None
        marker = {"same": " ", "added": "+", "removed": "-", "modified": "+"}[n["status"]]
        if n["relation"] == "back_edge":
            lines.append((marker, head("back_edge") + n["label"], None, n["key"]))
            continue
        if n["status"] == "modified":
            lines.append(("-", head(n["before_relation"] or n["relation"]) + n["before_label"], anchor, None))
        lines.append((marker, head(n["relation"]) + n["label"], anchor, None))
    texts = with_rails([f"{m} {t}" for m, t, _, _ in lines], [a for _, _, a, _ in lines], [t for _, _, _, t in lines])
    return [COLOURS[m] + t + RESET if ansi and m in COLOURS else t for (m, _, _, _), t in zip(lines, texts)]


def with_rails(texts: list[str], anchors: list[str | None], targets: list[str | None]) -> list[str]:
    """P5: each back edge is tied to the nearest earlier line with its key and children; ends of one anchor share a rail."""
    nearest: dict[str, int] = {}
    ends: dict[int, list[int]] = {}
    for k, (anchor, target) in enumerate(zip(anchors, targets)):
        if target in nearest:
            ends.setdefault(nearest[target], []).append(k)
        if anchor is not None:
            nearest[anchor] = k
    if not ends:
        return texts
    first = max(len(t.rstrip()) for t in texts) + RAIL
    spans = [(start, found[-1], first + RAIL * n) for n, (start, found) in enumerate(sorted(ends.items()))]
    tips = {}  # line: the rail it joins, what stands before the line to it, the glyph on the rail
    for start, stop, column in spans:
        tips |= {end: (column, " ", "┘" if end == stop else "┤") for end in ends[start]}
        tips[start] = column, " ◀", "┐"
    out = []
    for k, text in enumerate(texts):
        row = text.rstrip()
        passing = {column for start, stop, column in spans if start < k < stop}
        if k in tips:
            column, head, glyph = tips[k]
            row += head
            row += "".join("┼" if c in passing else "─" for c in range(len(row), column)) + glyph
        for column in sorted(c for c in passing if c >= len(row)):
            row = row.ljust(column) + "│"
        out.append(row)
    return out


def render(diff: DataFrame, ansi: bool = False) -> DataFrame:
    """(root, line_no, line) of every tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(rows.to_dict("records"), key=lambda n: list(n["path"]))
        for n in nodes:
            n["before_relation"] = n["before_relation"] if isinstance(n["before_relation"], str) else None
        lines = tree_lines(nodes, ansi)
        return pd.DataFrame({"root": nodes[0]["root"], "line_no": range(len(lines)), "line": lines})

    columns = ["root", "path", "key", "label", "relation", "before_label", "before_relation", "status"]
    return diff.select(*columns).groupBy("root").applyInPandas(run, "root string, line_no int, line string")


def as_diff(tree: DataFrame) -> DataFrame:
    """A forest as the diff of itself."""
    none = F.lit(None).cast("string")
    return tree.select("root", "path", F.size("path").alias("depth"), "key", "label", "relation", none.alias("before_label"), none.alias("before_relation"), F.lit("same").alias("status"), "callsite")


def report(language: str, before: str, after: str, trees: list[list[str]]) -> str:
    """A header, then the trees apart by blank lines, or a message if there are none."""
    body = "\n\n".join("\n".join(t) for t in trees) or f"No {language} call changes between {before} and {after}."
    return f"{language}diff {before} → {after}\n\n{body}\n"
