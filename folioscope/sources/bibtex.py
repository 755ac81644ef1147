"""BibTeX files to entries and problems, one row a file in, whole files in parallel."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = (
    "file_id string, entry_seq int, key string, etype string, fields map<string,string>, "
    "occurrences array<struct<name:string,value:string>>, field_lines map<string,int>, lineno int, raw string, kind string, message string"
)
_COLUMNS = ["file_id", "entry_seq", "key", "etype", "fields", "occurrences", "field_lines", "lineno", "raw", "kind", "message"]
_HEAD = re.compile(r"@\s*([A-Za-z_]\w*)\s*([{(])")
_NAME = re.compile(r"[A-Za-z][\w:+.-]*")
_SKIPPED = {"comment", "preamble"}


def read_files(spark: SparkSession, path: str, pattern: str = "*.bib") -> DataFrame:
    """(file_id, text): UTF-8, else Latin-1; files that hold NUL bytes give a null text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select(F.col("path").alias("file_id"), F.when(F.instr(text, "\0") == 0, text).alias("text"))


def _uncommented(text: str) -> str:
    """Comments outside entries become blanks of equal length, so offsets and lines stay."""
    out, depth = [], 0
    for line in text.split("\n"):
        at = 0
        while at < len(line):
            c = line[at]
            if c == "\\":
                at += 2
                continue
            if c == "%" and depth == 0:
                line = line[:at] + " " * (len(line) - at)
                break
            depth += (c == "{") - (c == "}")
            depth = max(depth, 0)
            at += 1
        out.append(line)
    return "\n".join(out)


def _close(text: str, at: int, opener: str) -> int:
    """Place of the delimiter that closes the entry opened before ``at``; -1 if a new entry starts first."""
    closer, depth = ")" if opener == "(" else "}", 0
    for k in range(at, len(text)):
        c = text[k]
        if c == "@" and not text[text.rfind("\n", 0, k) + 1 : k].strip() and _HEAD.match(text, k):
            return -1
        if c == closer and depth == 0:
            return k
        depth += (c == "{") - (c == "}")
    return -1


class _Values:
    """Reads the right-hand sides of fields: braces, quotes, bare words and # between them."""

    def __init__(self, text: str, macros: dict[str, str]) -> None:
        self.text, self.macros = text, macros

    def atom(self, at: int) -> tuple[str, int]:
        text = self.text
        c = text[at] if at < len(text) else ""
        if c in '{"':
            depth, k = 0, at + 1
            while k < len(text):
                d = text[k]
                if d == "\\":
                    k += 2
                    continue
                if depth == 0 and d == ("}" if c == "{" else '"'):
                    return text[at + 1 : k], k + 1
                depth += (d == "{") - (d == "}")
                k += 1
            return text[at + 1 :], len(text)
        m = re.compile(r"[^\s,#]+").match(text, at)
        if not m:
            return "", at + 1
        return self.macros.get(m[0].lower(), m[0]), m.end()

    def value(self, at: int) -> tuple[str, int]:
        parts = []
        while True:
            at = _skip(self.text, at)
            part, at = self.atom(at)
            parts.append(part)
            after = _skip(self.text, at)
            if self.text[after : after + 1] != "#":
                return "".join(parts), at
            at = after + 1


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _fields(body: str, macros: dict[str, str]) -> tuple[list[tuple[str, str, int]], list[tuple[str, int]]]:
    """(name, value, offset) of every field, and (name, offset) of declarations without an equals sign."""
    found, broken, at, reader = [], [], 0, _Values(body, macros)
    while (at := _skip(body, at)) < len(body):
        if body[at] == ",":
            at += 1
            continue
        m = _NAME.match(body, at)
        if not m:
            at += 1
            continue
        after = _skip(body, m.end())
        if body[after : after + 1] == "=":
            value, end = reader.value(after + 1)
            found.append((m[0].lower(), re.sub(r"\s+", " ", value), m.start()))
            at = end
        elif body[after : after + 1] in ("{", '"'):
            broken.append((m[0].lower(), m.start()))
            _, at = reader.atom(after)
        else:
            at = m.end()
    return found, broken


def parse(text: str, file_id: str = "") -> Iterator[dict]:
    """Rows of one file: entries (``kind`` null) and problems (``kind`` names the sort)."""
    clean, at, seq, macros = _uncommented(text), 0, 0, {}
    ends = [m.start() for m in re.finditer("\n", clean)]
    line = lambda k: bisect.bisect_left(ends, k) + 1
    empty = {"file_id": file_id, "entry_seq": None, "key": None, "etype": None, "fields": None, "occurrences": None, "field_lines": None, "raw": None}

    def problem(kind: str, where: int, message: str) -> dict:
        return empty | {"lineno": line(where), "kind": kind, "message": message}

    while m := _HEAD.search(clean, at):
        kind, end = m[1].lower(), _close(clean, m.end(), m[2])
        if end < 0:
            following = _HEAD.search(clean, m.end())
            yield problem("unclosed", m.start(), f"the @{kind} that starts here is never closed")
            at = following.start() if following else len(clean)
            continue
        body, at = clean[m.end() : end], end + 1
        if kind == "string":
            macros |= {name: value for name, value, _ in _fields(body, macros)[0]}
        elif kind not in _SKIPPED:
            key, comma, rest = body.partition(",")
            if not comma and "=" in key:
                key, rest = "", key
            found, broken = _fields(rest, macros)
            base = m.end() + len(body) - len(rest)
            lines: dict[str, int] = {}
            for name, _, offset in found:
                lines.setdefault(name, line(base + offset))
            yield {
                "file_id": file_id, "entry_seq": seq, "key": key.strip(), "etype": kind, "fields": {n: v.strip() for n, v, _ in found},
                "occurrences": [{"name": n, "value": v.strip()} for n, v, _ in found], "field_lines": lines, "lineno": line(m.start()),
                "raw": text[m.start() : end + 1], "kind": None, "message": None,
            }
            seq += 1
            if not key.strip():
                yield problem("missing_key", m.start(), f"the @{kind} has no citation key")
            for name, offset in broken:
                yield problem("missing_equals", base + offset, f"field '{name}' has no equals sign")
    opened, closed = len(re.findall(r"(?<!\\)\{", clean)), len(re.findall(r"(?<!\\)\}", clean))
    if opened != closed:
        yield problem("unbalanced", 0, f"{opened} opening and {closed} closing braces in the file")


def parse_files(files: DataFrame) -> DataFrame:
    """Entries and problems of (file_id, text) rows; a null text gives one problem."""

    def run(parts):
        for part in parts:
            rows = []
            for file_id, text in zip(part["file_id"], part["text"]):
                if text is None:
                    rows.append({"file_id": file_id, "kind": "binary", "message": "the file isn't text", "lineno": 1})
                else:
                    rows.extend(parse(text, file_id))
            # columns of objects, so that a missing map stays null and a missing number doesn't become a fraction
            yield pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype=object) for c in _COLUMNS})

    return files.select("file_id", "text").mapInPandas(run, ENTRY_SCHEMA)


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind is null").drop("kind", "message")


def problems(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind is not null").select("file_id", "lineno", "kind", "message")
