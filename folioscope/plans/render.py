"""Text of a finished audit, made on the driver from ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import AuditResult


def ordered(findings: DataFrame) -> DataFrame:
    return findings.filter("suppressed_by is null").orderBy("file_id", "entry_seq", "rank", "category", F.col("field").asc_nulls_first(), "message")


def verdict(errors: int, warnings: int) -> str:
    return "needs attention" if errors else "fair" if warnings else "sound"


def lines(result: AuditResult):
    """The report line by line; findings are streamed to the driver, a partition at a time."""
    last = None
    for r in ordered(result.findings).toLocalIterator():
        if (r.file_id, r.entry_seq) != last:
            last = (r.file_id, r.entry_seq)
            yield f"{r.key}  ({r.file_id})"
        where = f" [{r.field}]" if r.field else ""
        yield f"  {r.severity:<8}{r.category}{where}: {r.message}" + (f" -> {r.suggested}" if r.suggested else "")
    counts = {r.severity: r.n for r in result.findings.filter("suppressed_by is null").groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    s = result.summary.first()
    yield f"{s.checked} entries: {verdict(counts.get('error', 0), counts.get('warning', 0))}"
    yield ", ".join(f"{counts.get(k, 0)} {k}s" for k in ("error", "warning", "note"))
    yield f"integrity {s.integrity_score}, confidence {s.confidence_score}, DOI coverage {s.doi_coverage}"


def as_json(result: AuditResult, path: str) -> None:
    """Findings, entries and summary as JSON folders below ``path``."""
    for name in ("findings", "entries", "summary"):
        getattr(result, name).write.mode("overwrite").json(f"{path}/{name}")
