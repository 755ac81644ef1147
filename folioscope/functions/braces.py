"""Rewriting titles so that braces protect terms; position-sensitive, so an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def protect(title: str, terms: list[str]) -> str:
    """Braces around each term that stands outside braces; the longest term wins where terms overlap."""
    depth, levels = 0, []
    for c in title:
        depth += c == "{"
        levels.append(depth)
        depth = max(depth - (c == "}"), 0)
    spans: list[tuple[int, int]] = []
    for term in sorted(set(terms), key=len, reverse=True):
        for m in re.finditer(rf"(?<![\w\\]){re.escape(term)}(?!\w)", title):
            if not any(levels[m.start() : m.end()]) and all(m.end() <= a or b <= m.start() for a, b in spans):
                spans.append(m.span())
    for a, b in sorted(spans, reverse=True):
        title = f"{title[:a]}{{{title[a:b]}}}{title[b:]}"
    return title


def protected(title: Column, terms: Column) -> Column:
    @F.pandas_udf("string")
    def run(titles: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else protect(t, [x for x in (w if w is not None else []) if x]) for t, w in zip(titles, lists)])

    return run(title, terms)
