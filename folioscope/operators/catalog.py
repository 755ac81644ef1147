"""Dimensions: categories with their group and pinned severity, suppression edges, mandatory fields by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severity by rank; the rank sorts.
SEVERITIES = ("error", "warning", "note")

_PINNED = {
    "error": "dead_doi id_resolves_wrong_record missing_entry_header missing_field retraction syntax",
    "warning": (
        "author_completeness doi_available dropped_field duplicate_field_conflict entrytype_suggestion identifier_format llm_config "
        "llm_relevance metadata_mismatch misplaced_field missing_recommended pid_missing preprint_superseded related_work "
        "source_conflict title_capitalization wrong_journal wrong_paper"
    ),
    "note": (
        "author_truncated_marker biblatex_validity citation_order container_granularity datamodel_recommended divergent_manifestation "
        "duplicate_field encoding identifier_placement isbn_unresolved journal_macro journal_style llm_ok llm_unavailable missing_locator "
        "parity_suggestion preprint_retitled preprint_version style title_case title_style"
    ),
    "": "author_format duplicate record_unresolved",
}
_GROUPS = {
    "syntax": "author_truncated_marker biblatex_validity dropped_field duplicate duplicate_field duplicate_field_conflict encoding identifier_format "
    "identifier_placement misplaced_field missing_entry_header style syntax",
    "context": "citation_order divergent_manifestation id_resolves_wrong_record llm_config llm_ok llm_relevance llm_unavailable preprint_retitled "
    "preprint_superseded preprint_version wrong_paper",
}
#: Losing category, the layer whose findings lose, and the layer whose evidence wins.
SUPERSEDES = [(c, "static", "record") for c in ("author_completeness", "author_truncated_marker", "missing_locator", "identifier_placement", "entrytype_suggestion", "title_case", "misplaced_field")]
SUPERSEDES.append(("preprint_retitled", "record", "preprint"))

#: Slots by entry type; the fields of a slot are alternatives.
MANDATORY = {
    t: [slot.split("/") for slot in slots.split(";")]
    for line in (
        "article=author;title|book mvbook=author;title|bookinbook inbook inproceedings suppbook=author;title;booktitle|booklet=author/editor;title",
        "collection mvcollection mvreference periodical reference=editor;title|dataset manual misc mvproceedings proceedings software=title",
        "incollection inreference suppcollection=author;editor;title;booktitle|online=title;url/doi/eprint|patent=author;title;number",
        "report thesis=author;title;type;institution|set=entryset|suppperiodical=date;year|unpublished=author;title",
    )
    for types, slots in (x.split("=") for x in line.split("|"))
    for t in types.split()
}
TYPE_ALIASES = {"conference": "inproceedings", "electronic": "online", "www": "online", "mastersthesis": "thesis", "phdthesis": "thesis", "techreport": "report"}
FIELD_ALIASES = {"journaltitle": "journal", "institution": "school", "date": "year", "location": "address", "eprinttype": "archiveprefix", "eprintclass": "primaryclass", "file": "pdf", "annotation": "annote"}
#: Slots that a type's alias supplies, and slots that are advice only.
SUPPLIED = {("phdthesis", "type"), ("mastersthesis", "type"), ("techreport", "type")}
ADVISED = {("incollection", "editor"), ("inreference", "editor"), ("suppcollection", "editor"), ("misc", "title"), ("software", "title")}

COMMON = set(
    "abstract addendum annotation crossref date day doi edition editor editora editorb entryset eprint eprintclass eprinttype file gender hyphenation ids "
    "keywords label langid language library location month note options origdate pubstate related relatedtype shorthand sortkey subtitle title titleaddon "
    "url urldate version xref year author archiveprefix primaryclass annote pdf address issn isbn orcid publisher series".split()
)
OWN = {
    "article": "journal journaltitle journalsubtitle issuetitle volume number issue pages eid translator annotator commentator",
    "book": "volume volumes number pages pagetotal chapter maintitle booktitle introduction foreword afterword translator",
    "inproceedings": "booktitle booksubtitle eventtitle eventdate venue volume number pages organization chapter",
    "incollection": "booktitle booksubtitle maintitle volume volumes number pages chapter introduction foreword",
    "inbook": "booktitle bookauthor volume volumes number pages chapter maintitle",
    "thesis": "type institution school chapter pages pagetotal",
    "report": "type institution school number chapter pages pagetotal isrn",
    "misc": "howpublished type organization",
    "online": "organization howpublished",
    "manual": "organization type number pages pagetotal chapter",
    "proceedings": "eventtitle eventdate venue volume volumes number pages pagetotal organization",
    "unpublished": "howpublished eventtitle eventdate venue type",
}
KNOWN_TYPES = sorted(set(MANDATORY) | set(TYPE_ALIASES) | {"customa", "customb", "audio", "video", "image", "movie", "music", "artwork", "jurisdiction", "legislation", "letter", "review", "standard", "performance", "mvbook"})


def categories() -> list[tuple[str, str, str | None]]:
    """(category, group, pinned severity or None), in the order of names."""
    groups = {c: g for g, names in _GROUPS.items() for c in names.split()}
    return sorted((c, groups.get(c, "semantic"), pin or None) for pin, names in _PINNED.items() for c in names.split())


def catalog(spark: SparkSession) -> DataFrame:
    """The category dimension with its suppression edge."""
    edges = {c: (loser, winner) for c, loser, winner in SUPERSEDES}
    rows = [(c, g, p, *edges.get(c, (None, None))) for c, g, p in categories()]
    return spark.createDataFrame(rows, "category string, group string, pinned string, losing_layer string, winning_layer string")


def map_of(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def effective(category: Column, coded: Column, pins: dict | None = None) -> Column:
    """Severity after pins: a caller's pin, then the category's own, then what the rule says."""
    own = {c: p for c, _, p in categories() if p}
    return F.coalesce(F.element_at(map_of({**own, **(pins or {})}), category), coded)
