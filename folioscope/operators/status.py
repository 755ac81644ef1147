"""Severity, suppression, status and scores over the findings table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as C

ID = ["file_id", "entry_seq"]


def pinned(findings: DataFrame, pins: dict | None = None) -> DataFrame:
    """Effective severity, its rank, the category's group and the action asked for."""
    groups = {c: g for c, g, _ in C.categories()}
    out = findings.withColumn("severity", C.effective(F.col("category"), F.col("severity"), pins))
    rank = F.element_at(C.map_of({s: k for k, s in enumerate(C.SEVERITIES)}), F.col("severity"))
    action = F.when(F.col("severity") == "note", "info").when(F.col("suggested").isNotNull(), "fix").otherwise("investigate")
    return out.withColumns({"rank": rank, "group": F.coalesce(F.element_at(C.map_of(groups), F.col("category")), F.lit("semantic")), "action": action})


def stamped(findings: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """``suppressed_by``: the layer whose evidence withdraws a finding of its entry; order plays no part.

    ``withdrawals`` is (file_id, entry_seq, category); only declared edges count.
    """
    edges = F.create_map(*[F.lit(x) for c, loser, winner in C.SUPERSEDES for x in (f"{c}/{loser}", winner)])
    known = withdrawals.select(*ID, "category").distinct().withColumn("withdrawn", F.lit(True))
    out = findings.join(known, [*ID, "category"], "left")
    return out.withColumn("suppressed_by", F.when(F.col("withdrawn"), F.try_element_at(edges, F.concat_ws("/", "category", "layer")))).drop("withdrawn")


def live(findings: DataFrame) -> DataFrame:
    return findings.filter("suppressed_by is null")


def classify(resolved: DataFrame, findings: DataFrame) -> DataFrame:
    """Status and confidence of each entry.

    ``resolved`` is (id, key, has_id, sources, found_by_search, doi_dead, arxiv_only); categories come from live findings.
    """
    kinds = findings.groupBy(*ID).agg(F.collect_set("category").alias("categories"))
    full = resolved.join(kinds, ID, "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    have = lambda c: F.array_contains("categories", c)
    none, mismatch = F.col("sources") == 0, have("id_resolves_wrong_record")
    status = F.when(mismatch, "mismatch").when(F.col("doi_dead") & none, "unverified").when(none, "unverified").otherwise("verified")
    confidence = (
        F.when(F.col("doi_dead") & none, 0.0)
        .when(none & F.col("has_id"), 0.1)
        .when(none, 0.2)
        .when(mismatch, 0.3)
        .when(F.col("doi_dead"), 0.6)
        .when(have("source_conflict"), 0.7)
        .when(have("metadata_mismatch"), 0.75)
        .when(F.col("arxiv_only"), 0.7)
        .when(F.col("found_by_search"), 0.85)
        .when(F.col("sources") == 1, 0.95)
        .otherwise(1.0)
    )
    return full.withColumns({"status": status, "confidence": confidence})


def integrity(classified: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: counts by status, coverage, and two scores of 0 to 100 (null where nothing was checked)."""
    have = lambda c: F.array_contains("categories", c)
    credit = (
        F.when(F.col("status") == "mismatch", 0.2)
        .when(F.col("status") == "unverified", 0.3)
        .when(have("dead_doi"), 0.65)
        .when(have("metadata_mismatch"), 0.8)
        .when(have("pid_missing"), 0.85)
        .otherwise(1.0)
    )
    trust = F.when(F.col("status") == "mismatch", 0.3).when(F.col("status") == "unverified", 0.1).when(F.col("doi_dead"), 0.8).when(F.col("found_by_search"), 0.85).when(F.col("arxiv_only"), 0.9).otherwise(1.0)
    caveat = (F.col("status") == "verified") & (have("metadata_mismatch") | have("source_conflict"))
    one = classified.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if((F.col("status") == "verified") & ~caveat).alias("verified"),
        F.count_if(caveat).alias("verified_with_caveat"),
        F.count_if(F.col("status") == "unverified").alias("unverified"),
        F.count_if(F.col("status") == "mismatch").alias("mismatch"),
        F.sum((credit * 100).cast("long")).alias("credit"),
        F.sum((trust * 100).cast("long")).alias("trust"),
        F.count_if("has_id").alias("with_id"),
    )
    two = findings.agg(
        F.count_if(F.col("category") == "duplicate").alias("duplicates"),
        F.count_if(F.col("category") == "source_conflict").alias("source_conflicts"),
        F.count_if(F.col("category").isin("syntax", "missing_entry_header")).alias("structural"),
    )
    # both sides are one row
    joined = one.join(F.broadcast(two), F.lit(True))
    raw = F.greatest(F.col("credit") / F.col("checked") - 10 * F.col("duplicates"), F.lit(0.0))
    score = F.when(F.col("checked") > 0, F.bround(F.when(F.col("structural") > 0, F.least(raw, F.lit(60.0))).otherwise(raw), 0).cast("int"))
    return joined.select(
        "checked", "verified", "verified_with_caveat", "unverified", "mismatch", "duplicates", "source_conflicts",
        F.when(F.col("checked") > 0, F.bround(F.col("with_id") / F.col("checked"), 3)).otherwise(1.0).alias("doi_coverage"),
        score.alias("integrity_score"),
        F.when(F.col("checked") > 0, F.bround(F.col("trust") / F.col("checked"), 0).cast("int")).alias("confidence_score"),
    )
