"""Citations in LaTeX sources: one row an occurrence, with its sentence and the ones around it."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CITE = re.compile(r"\\(?:[A-Za-z]*cite[A-Za-z]*)\*?\s*(?:\[[^\]]*\]\s*){0,2}\{([^{}]*)\}")
_STOP = re.compile(r"(?<!\b[A-Z])(?<!al)(?<!cf)(?<!Fig)(?<!Eq)(?<!e\.g)(?<!i\.e)[.!?]\s+(?=[A-Z\\])")
SCHEMA = "path string, line int, keys array<string>, context string"


def without_comments(text: str) -> str:
    return "\n".join(re.sub(r"((?:\\.|[^\\%])*)%.*", r"\1", line) for line in text.split("\n"))


def occurrences(path: str, text: str):
    clean = without_comments(text)
    edges = [0, *[m.end() for m in _STOP.finditer(clean)], len(clean)]
    ends = [m.start() for m in re.finditer("\n", clean)]
    for m in _CITE.finditer(clean):
        keys = [k.strip() for k in m[1].split(",") if k.strip() and not k.strip().startswith("#")]
        if keys:
            at = bisect.bisect_right(edges, m.start(), 0, len(edges) - 1) - 1
            lo, hi = edges[max(at - 1, 0)], edges[min(at + 2, len(edges) - 1)]
            yield path, bisect.bisect_left(ends, m.start()) + 1, keys, re.sub(r"\s+", " ", clean[lo:hi]).strip()


def citations(files: DataFrame) -> DataFrame:
    """(path, text) to (path, line, keys, context)."""

    def run(parts):
        for part in parts:
            rows = [row for path, text in zip(part["path"], part["text"]) for row in occurrences(path, text or "")]
            yield pd.DataFrame(rows, columns=["path", "line", "keys", "context"]).astype({"line": "int32"})

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def groups(found: DataFrame) -> DataFrame:
    """Distinct groups of keys that are cited together, at their first place."""
    return found.filter(F.size("keys") > 1).groupBy("keys").agg(F.min(F.struct("path", "line")).alias("at")).select("keys", "at.path", "at.line")
