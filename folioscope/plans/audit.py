"""The audit as a function of tables: entries, records and citations in, findings, entry results and summary out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..operators import citations, compare, resolve, rules, status, windows
from ..store import stored

ID = ["file_id", "entry_seq"]
COLUMNS = [*ID, "key", "category", "severity", "field", "message", "suggested", "layer"]


@dataclass
class AuditResult:
    findings: DataFrame
    entries: DataFrame
    summary: DataFrame


def _row(df: DataFrame, category: str, severity: str, field, message: str, layer: str, suggested=None) -> DataFrame:
    text = lambda x: F.lit(None).cast("string") if x is None else x if not isinstance(x, str) else F.lit(x)
    return df.select(
        *ID, "key", F.lit(category).alias("category"), F.lit(severity).alias("severity"), text(field).alias("field"), F.lit(message).alias("message"),
        text(suggested).cast("string").alias("suggested"), F.lit(layer).alias("layer"),
    )


def file_findings(entries: DataFrame) -> DataFrame:
    parts = [
        _row(windows.duplicate_keys(entries), "duplicate", "error", "key", "the key was used before", "static"),
        _row(windows.duplicate_dois(entries), "duplicate", "warning", "doi", "the DOI was used before", "static"),
        _row(windows.duplicate_works(entries), "duplicate", "warning", "title", "the work seems to be listed before", "static"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _described(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries and their first registry's title, journal and kind, with a verdict on each; and whether the first authors differ."""
    kind = T.document_type(F.col("document_type")) if "document_type" in records.columns else F.lit(None).cast("string")
    theirs = records.filter("source = 'crossref'").select(*ID, F.col("title").alias("r_title"), F.col("journal").alias("r_journal"), kind.alias("r_type"))
    first = compare.author_diffs(entries, records.filter("source = 'crossref'")).select(*ID, "first_differs")
    mine = entries.select(*ID, "key", "etype", T.field("title").alias("o_title"), T.field("journal").alias("o_journal"))
    both = mine.join(theirs, ID).join(first, ID, "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    # equal texts need no comparison
    verdict = lambda f, a, b: F.when(F.col(a) != empty(b), f(F.col(a), empty(b)))
    return T.once(
        both, title=verdict(compare.title_verdict, "o_title", "r_title"), journal=verdict(compare.journal_verdict, "o_journal", "r_journal"), type=resolve.type_verdict(F.col("etype"), F.col("r_type")),
    ).drop("etype", "o_title", "o_journal", "r_type")


def description_findings(entries: DataFrame, records: DataFrame) -> DataFrame:
    """What title, journal and kind of the record say; a title and a first author that both differ mean another work.

    One pass: a row gives all its findings.
    """
    d = _described(entries, records)
    title, journal, kind, first = F.col("title"), F.col("journal"), F.col("type"), F.coalesce("first_differs", F.lit(False))
    other = title.isin("strong", "container")
    one = lambda when, category, severity, field, message, suggested=None: F.when(when, F.struct(
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field"), F.lit(message).alias("message"),
        (F.lit(None) if suggested is None else suggested).cast("string").alias("suggested"),
    ))
    ours = F.array(
        one(other & first, "id_resolves_wrong_record", "error", "doi", "the identifier leads to another work"),
        one(other & ~first, "metadata_mismatch", "warning", "title", "the titles differ", F.col("r_title")),
        one(title.isin("slight", "shortened", "spacing"), "metadata_mismatch", "warning", "title", "the titles differ in part", F.col("r_title")),
        one(title == "casing", "title_case", "note", "title", "the titles differ in case", F.col("r_title")),
        one(title == "punctuation", "title_style", "note", "title", "the titles differ in punctuation", F.col("r_title")),
        one(journal == "different", "wrong_journal", "warning", "journal", "the journals differ", F.col("r_journal")),
        one(journal == "spelling", "metadata_mismatch", "warning", "journal", "the journal is spelt otherwise", F.col("r_journal")),
        one(journal == "abbreviation", "journal_style", "note", "journal", "one of the journals is abbreviated", F.col("r_journal")),
        one(kind.isNotNull(), "entrytype_suggestion", "warning", None, "the record is of another type", kind),
    )
    return d.select(*ID, "key", F.inline(F.filter(ours, lambda x: x.isNotNull())), F.lit("record").alias("layer"))


def identifier_findings(entries: DataFrame, records: DataFrame, lookups: Lookups) -> DataFrame:
    """Identifiers that lack, could be had, or lead nowhere; withdrawn works, related ones, and published versions of preprints."""
    spark = entries.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    searched = lookups.searched if lookups.searched is not None else none("file_id string, entry_seq long, doi string")
    pid = resolve.pid_check(entries, records, searched)
    said = F.when(F.col("category") == "pid_missing", "no persistent identifier is given").otherwise("a DOI is known")
    parts = [pid.select(*ID, "key", "category", F.lit("warning").alias("severity"), "field", said.alias("message"), F.col("suggested").cast("string").alias("suggested"), F.lit("record").alias("layer"))]
    if lookups.dead is not None:
        gone = resolve.identifiers(entries).join(lookups.dead.select(F.col("id").alias("doi")), "doi", "left_semi")
        parts.append(_row(gone, "dead_doi", "error", "doi", "the registry doesn't know the DOI", "record"))
    if lookups.status is not None:
        parts.append(_row(resolve.retracted(entries, lookups.status), "retraction", "error", "doi", "the work has been withdrawn", "record"))
    if lookups.relations is not None or lookups.titles is not None:
        relations = lookups.relations if lookups.relations is not None else none("id string, label string, target string")
        titles = lookups.titles if lookups.titles is not None else none("target string, title string, surname string")
        related = resolve.related_works(entries, relations, titles)
        parts.append(_row(related, "related_work", "warning", F.col("label"), "another work speaks of this one", "record", F.col("target")))
    if lookups.published is not None:
        newer = resolve.superseded_preprints(entries, records, lookups.published).filter("agrees")
        parts.append(_row(newer, "preprint_superseded", "warning", "doi", "the preprint has been published", "record", F.col("doi")))
    return reduce(DataFrame.unionByName, parts)


def syntax_findings(entries: DataFrame, problems: DataFrame) -> DataFrame:
    """Problems of the parser as findings of the entry whose lines they fall into (the last that begins before)."""
    spans = entries.select(*ID, "key", "lineno", F.coalesce(F.lead("lineno").over(Window.partitionBy("file_id").orderBy("lineno")), F.lit(2**31 - 1)).alias("next"))
    met = problems.withColumnRenamed("lineno", "at").join(spans, "file_id", "left").filter(F.col("lineno").isNull() | ((F.col("at") >= F.col("lineno")) & (F.col("at") < F.col("next"))) | ((F.col("kind") == "unbalanced") & (F.col("entry_seq") == 0)))
    category = F.when(F.col("kind") == "missing_key", "missing_entry_header").when(F.col("kind") == "missing_equals", "dropped_field").otherwise("syntax")
    return met.select(
        *ID, "key", category.alias("category"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("field"), "message", F.lit(None).cast("string").alias("suggested"), F.lit("static").alias("layer"),
    )


def citation_findings(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups (keys, path, line) that are cited together out of the order of their years, at the first entry of each."""
    years = entries.select("key", T.year_of(F.coalesce(F.nullif(T.field("year"), F.lit("")), T.field("date"))).alias("year")).filter("year is not null")
    named = groups.withColumn("group_id", F.xxhash64("keys", "path", "line"))
    wrong = citations.out_of_order(named, years).join(named.select("group_id", F.element_at("keys", 1).alias("key")), "group_id")
    return _row(entries.join(wrong.select("key").distinct(), "key"), "citation_order", "note", None, "cited together out of the order of years", "static")


def record_findings(entries: DataFrame, records: DataFrame) -> DataFrame:
    # a preprint's year and locator are its own, and so are the pages of a book
    guarded = entries.filter(~T.preprint())
    soft = compare.soft_field_diffs(guarded, records, ("etype",)).filter(~(F.col("etype").isin("book", "mvbook", "collection", "proceedings") & (F.col("field") == "pages")))
    gaps = compare.missing_fields(entries, records.filter("source = 'crossref'"))
    names = compare.author_diffs(entries, records.filter("source = 'crossref'"))
    parts = [
        _row(soft, "metadata_mismatch", "warning", F.col("field"), "entry and record disagree", "record", F.col("theirs")),
        _row(gaps, "parity_suggestion", "note", F.col("field"), "the record has it", "record", F.col("suggested")),
        _row(names.filter("first_differs"), "metadata_mismatch", "warning", "author", "the first authors differ", "record"),
        _row(compare.cross_source_conflicts(entries, records), "source_conflict", "warning", F.col("field"), "two sources disagree", "record"),
    ]
    return reduce(DataFrame.unionByName, parts)


def withdrawals(entries: DataFrame, records: DataFrame) -> DataFrame:
    """A record's complete list of authors withdraws complaints of the text about truncation; its locator those about locators."""
    met = entries.join(records.filter("source = 'crossref'").select(*ID, F.size("authors").alias("n"), F.col("volume").alias("v")), ID)
    cut = met.filter(T.truncated(T.field("author")) & (F.col("n") > 0)).select(*ID, F.explode(F.array(F.lit("author_completeness"), F.lit("author_truncated_marker"))).alias("category"))
    return cut.unionByName(met.filter((T.field("volume") == "") & F.col("v").isNotNull()).select(*ID, F.lit("missing_locator").alias("category")))


@dataclass
class Lookups:
    """Snapshots besides the records, each left out where it is None.

    ``dead``: (id) DOIs the registry answered it doesn't know; ``searched``: (file_id, entry_seq, doi) accepted search
    hits; ``status``: (id, is_retracted); ``relations``: (id, label, target); ``titles``: (target, title, surname);
    ``published``: (doi, title, surname) of published versions.
    """

    dead: DataFrame | None = None
    searched: DataFrame | None = None
    status: DataFrame | None = None
    relations: DataFrame | None = None
    titles: DataFrame | None = None
    published: DataFrame | None = None


def audit(entries: DataFrame, records: DataFrame, settings: Settings | None = None, lookups: Lookups | None = None, problems: DataFrame | None = None, groups: DataFrame | None = None) -> AuditResult:
    """Findings with severity, suppression and action; entries with status and confidence; one summary row.

    ``problems`` are the parser's, ``groups`` the keys that are cited together.  Findings are written once to the
    shared folder; status and scores are read from there.
    """
    settings, lookups = settings or Settings(), lookups or Lookups()
    parts = [rules.entry_findings(entries, settings), file_findings(entries), record_findings(entries, records), description_findings(entries, records), identifier_findings(entries, records, lookups)]
    if problems is not None:
        parts.append(syntax_findings(entries, problems))
    if groups is not None:
        parts.append(citation_findings(entries, groups))
    found = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])
    findings = stored(status.stamped(status.pinned(found, settings.severity), withdrawals(entries, records)), "findings")
    count = records.groupBy(*ID).agg(F.countDistinct("source").alias("sources"), F.every(F.col("source") == "arxiv").alias("only"))
    hit = lookups.searched.select(*ID).distinct().withColumn("hit", F.lit(True)) if lookups.searched is not None else None
    resolved = entries.select(*ID, "key", T.filled("doi").alias("has_id")).join(count, ID, "left")
    resolved = resolved.withColumn("hit", F.lit(False)) if hit is None else resolved.join(hit, ID, "left")
    gone = findings.filter("category = 'dead_doi'").select(*ID).distinct().withColumn("gone", F.lit(True))
    resolved = resolved.join(gone, ID, "left").withColumns(
        {"sources": F.coalesce("sources", F.lit(0)), "found_by_search": F.coalesce("hit", F.lit(False)) & ~F.col("has_id"), "doi_dead": F.coalesce("gone", F.lit(False)), "arxiv_only": F.coalesce("only", F.lit(False))}
    ).drop("hit", "gone", "only")
    classified = stored(status.classify(resolved, status.live(findings)), "classified")
    return AuditResult(findings, classified, status.integrity(classified, status.live(findings)))
