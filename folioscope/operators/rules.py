"""Rules about one entry: each is a column of findings; all run in one projection of one scan.

A rule is data: a name and a builder that gives null, a finding, or an array of findings.  Findings are
structs (rule, category, severity, field, message, suggested); pins and suppression are applied at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from . import catalog as C

SHAPE = "array<struct<rule:string,category:string,severity:string,field:string,message:string,suggested:string>>"
RULES: dict[str, Callable[[Settings], list[Column]]] = {}


def rule(build: Callable[[Settings], list[Column]]):
    RULES[build.__name__] = build
    return build


def hit(when: Column, category: str, severity: str, field: str | None, message, suggested: Column | None = None) -> Column:
    """A finding where the condition holds, else null."""
    text = message if isinstance(message, Column) else F.lit(message)
    own = F.struct(
        F.lit(None).cast("string").alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field"),
        text.alias("message"), (suggested if suggested is not None else F.lit(None)).cast("string").alias("suggested"),
    )
    return F.when(F.coalesce(when, F.lit(False)), own)


class many:
    """Marks a column that is an array of findings already."""

    def __init__(self, column: Column) -> None:
        self.column = column


def filled(name: str) -> Column:
    """As T.filled; ``present`` and ``canonical`` are columns that entry_findings makes once an entry."""
    return F.array_contains("present", name)


def has(name: str) -> Column:
    """Filled under its own name or a legacy one."""
    names = {name} | {b for a, b in C.FIELD_ALIASES.items() if a == name} | {a for a, b in C.FIELD_ALIASES.items() if b == name}
    return reduce(lambda a, b: a | b, [filled(n) for n in sorted(names)])


def etype() -> Column:
    return F.col("etype")


def canonical() -> Column:
    return F.col("canonical")


def article() -> Column:
    return canonical() == "article"


@rule
def required_fields(s: Settings) -> list[Column]:
    inherits = filled("crossref") | filled("xref")
    out = []
    for kind, slots in {**C.MANDATORY, None: [["title"]]}.items():
        own = ~canonical().isin(*C.MANDATORY) if kind is None else canonical() == kind
        for slot in slots:
            lacks = own & ~inherits & ~reduce(lambda a, b: a | b, [has(f) for f in slot])
            shown = " or ".join(slot)
            supplied = [a for a, f in C.SUPPLIED if f in slot and C.TYPE_ALIASES.get(a) == kind]
            if supplied:
                lacks = lacks & ~etype().isin(*supplied)
            if (kind, slot[0]) in C.ADVISED:
                out.append(hit(lacks, "datamodel_recommended", "note", slot[0], f"a {kind} usually has the field {shown}"))
            elif kind in ("book", "mvbook") and slot == ["author"]:
                out.append(hit(lacks & has("editor"), "entrytype_suggestion", "warning", slot[0], "edited volume without an author: the type collection fits it"))
                out.append(hit(lacks & ~has("editor"), "missing_field", "error", slot[0], f"the mandatory field {shown} is empty"))
            else:
                out.append(hit(lacks, "missing_field", "error", slot[0], f"the mandatory field {shown} is empty"))
    dated = has("year") | has("date")
    out.append(hit(~inherits & ~dated & ~canonical().isin("misc", "online", "software", "dataset"), "missing_recommended", "warning", "year", "neither year nor date is given"))
    venue, linked = has("journaltitle") | filled("eprint"), filled("url") | filled("howpublished")
    url = T.field("url")
    isbn = filled("isbn")
    out.append(hit(~inherits & article() & isbn & ~has("journaltitle"), "entrytype_suggestion", "warning", "journal", "an ISBN and no journal: the type book may fit"))
    rest = ~inherits & article() & ~(isbn & ~has("journaltitle"))
    out.append(hit(rest & T.thesis_url(url), "entrytype_suggestion", "warning", "journal", "the address is that of a thesis: the type thesis may fit"))
    rest = rest & ~T.thesis_url(url)
    out.append(hit(rest & T.web_source(url), "entrytype_suggestion", "warning", "journal", "the address is a web or press item: the type online may fit"))
    rest = rest & ~T.web_source(url)
    out.append(hit(rest & ~venue & linked, "entrytype_suggestion", "warning", None, "a link and no journal: the type online may fit"))
    out.append(hit(rest & ~venue & ~linked, "missing_field", "error", "journal", "an article needs a journal or an eprint"))
    located = filled("pages") | filled("eid") | has("number") | filled("doi") | filled("eprint")
    out.append(hit(rest & has("journaltitle") & ~filled("volume") & ~filled("doi") & ~filled("eprint"), "missing_locator", "note", "volume", "a journal article without volume"))
    out.append(hit(rest & has("journaltitle") & filled("volume") & ~located, "missing_locator", "note", "pages", "a journal article without pages or article number"))
    return out


@rule
def misplaced_field(s: Settings) -> list[Column]:
    journal = T.field("journal")
    out = [hit(journal.rlike(r"^\s*[0-9]+\s*$"), "misplaced_field", "warning", "journal", "the journal is a number", journal)]
    for name in ("number", "issue"):
        v = F.trim(T.field(name))
        out.append(hit(v.rlike(r"^(?:19|20)[0-9]{2}$"), "misplaced_field", "warning", name, "a year stands in place of an issue", v))
        out.append(hit(v.rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "misplaced_field", "warning", name, "a date stands in place of an issue"))
    return out


@rule
def duplicate_field(s: Settings) -> list[Column]:
    names = F.array_sort(F.array_distinct(F.transform("occurrences", lambda o: o["name"])))
    norm = lambda v: F.lower(F.regexp_replace(F.trim(v), r"\s+", " "))

    def one(n: Column) -> Column:
        own = F.filter("occurrences", lambda o: o["name"] == n)
        kinds = F.size(F.array_distinct(F.transform(own, lambda o: norm(o["value"]))))
        make = lambda c, sev, m: F.struct(F.lit(None).cast("string").alias("rule"), F.lit(c).alias("category"), F.lit(sev).alias("severity"), n.alias("field"), F.lit(m).alias("message"), F.lit(None).cast("string").alias("suggested"))
        return F.when(F.size(own) > 1, F.when(kinds > 1, make("duplicate_field_conflict", "warning", "given more than once with unequal values")).otherwise(make("duplicate_field", "note", "given more than once")))

    return [many(F.transform(names, one))]


@rule
def entry_type_known(s: Settings) -> list[Column]:
    return [hit(~etype().isin(*C.KNOWN_TYPES), "syntax", "error", None, F.concat(F.lit("unknown entry type "), etype()))]


@rule
def biblatex_field_validity(s: Settings) -> list[Column]:
    table = {t: sorted(C.COMMON | set(f.split())) for t, f in C.OWN.items()}
    out = []
    for kind, legal in table.items():
        odd = F.array_sort(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, legal))))
        out.append(hit((canonical() == kind) & (F.size(odd) > 0), "biblatex_validity", "note", None, F.concat(F.lit("fields that this type doesn't have: "), F.array_join(odd, ", "))))
    return out


@rule
def legacy_month(s: Settings) -> list[Column]:
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    v = F.lower(F.trim(T.field("month")))
    quoted = F.col("raw").rlike(r"(?i)\bmonth\s*=\s*[{\"]\s*[a-z]")
    return [hit(filled("month") & F.substring(v, 1, 3).isin(names) & (quoted | (F.length(v) > 3)), "style", "note", "month", "write the month as a bare three-letter macro", F.substring(v, 1, 3))]


@rule
def year_sanity(s: Settings) -> list[Column]:
    out = []
    for name in ("year", "date"):
        v = F.trim(T.field(name))
        fine = F.exists(F.regexp_extract_all(v, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), 1), lambda y: y.cast("int").between(1500, s.as_of_year + 5))
        out.append(hit(filled(name) & ~fine, "identifier_format", "warning", name, f"no plausible {name}"))
        if name == "year":
            out.append(hit(filled(name) & fine & ~v.rlike("^[0-9]{4}$"), "style", "note", name, "more than four digits in the year", F.regexp_extract(v, "([0-9]{4})", 1)))
    return out


@rule
def title_caps(s: Settings) -> list[Column]:
    title = T.field("title")
    open_ = F.regexp_replace(title, r"\{[^{}]*\}", " ")
    found = F.array_distinct(F.regexp_extract_all(open_, F.lit(r"(?<![A-Za-z\\])([A-Z]{2,}[A-Za-z0-9]*|[A-Z]?[a-z]+[A-Z][A-Za-z]*)(?![A-Za-z])"), 1))
    terms = F.array_intersect(F.split(F.regexp_replace(open_, r"[^A-Za-z0-9]+", " "), " "), F.array(*map(F.lit, s.protected_terms)))
    every = F.array_sort(F.array_union(found, terms))
    big = F.filter(F.slice(T.words(F.regexp_replace(open_, r"[^A-Za-z]+", " ")), 2, 1000), lambda w: F.length(w) > 3)
    cased = (F.size(big) > 0) & F.forall(big, lambda w: w.rlike("^[A-Z]"))
    loud = T.miscased(title)
    finding = lambda w: F.struct(
        F.lit(None).cast("string").alias("rule"), F.lit("title_capitalization").alias("category"), F.lit("warning").alias("severity"), F.lit("title").alias("field"),
        F.concat(F.lit("unprotected capitals: "), w).alias("message"), F.concat(F.lit("{"), w, F.lit("}")).alias("suggested"),
    )
    return [
        hit(loud, "title_case", "note", "title", "the title is in capitals"),
        many(F.when(~loud & ~cased, F.transform(every, finding))),
    ]


@rule
def title_punctuation(s: Settings) -> list[Column]:
    t = F.trim(T.field("title"))
    return [hit(t.rlike(r"(?<!\.)\.\}*$") & ~t.rlike(r"(?i)\b(?:al|inc|etc|vs|jr)\.\}*$"), "style", "note", "title", "a period ends the title", F.regexp_replace(t, r"\.(\}*)$", "$1"))]


@rule
def truncated_authors(s: Settings) -> list[Column]:
    out = []
    for name in ("author", "editor"):
        v = T.field(name)
        literal = v.rlike(r"(?i)\bet\.?\s+al\b")
        out.append(hit(literal, "author_completeness", "warning", name, "the list of names is cut short by hand"))
        out.append(hit(~literal & v.rlike(r"(?i)\band\s+others\s*$"), "author_truncated_marker", "note", name, "the list of names ends in others"))
    return out


@rule
def glued_and_separator(s: Settings) -> list[Column]:
    glued = r"[a-z.]and\s+[A-Z][a-z]+\s*,|\.\s?and[A-Z]"
    return [hit(T.field(n).rlike(glued), "author_format", "warning", n, "the word and is glued to a name") for n in ("author", "editor")]


@rule
def shouted_authors(s: Settings) -> list[Column]:
    names = F.transform(T.authors(T.field("author")), T.surname)
    loud = F.filter(names, lambda n: n.rlike("^[A-Z]{3,}$"))
    return [hit((F.size(loud) >= 2) | ((F.size(loud) == 1) & (F.size(names) == 1)), "author_format", "note", "author", F.concat(F.lit("surnames in capitals: "), F.array_join(F.slice(loud, 1, 6), ", ")))]


@rule
def marker_in_author_name(s: Settings) -> list[Column]:
    names = T.authors(T.field("author"))

    def one(n: Column) -> Column:
        make = lambda sev, m: F.struct(F.lit(None).cast("string").alias("rule"), F.lit("author_format").alias("category"), F.lit(sev).alias("severity"), F.lit("author").alias("field"), F.concat(F.lit(m), n).alias("message"), F.trim(F.regexp_replace(n, r"\\[hv]space\*?\{[^}]*\}|[0-9*\u2020\u2021]+", " ")).alias("suggested"))
        return F.when(n.rlike(r"\\[hv]space"), make("note", "spacing macro in a name: ")).when(n.rlike(r"[0-9\u2020\u2021]|\*$"), make("warning", "footnote mark or digit in a name: "))

    return [many(F.transform(names, one))]


@rule
def encoding(s: Settings) -> list[Column]:
    broken = F.col("raw").rlike("\u00c3[\u0080-\u00bf]|\u00e2\u20ac[\u0080-\u2122]|\u00c2[\u00a0-\u00bf]|\ufffd")
    unseen = F.col("raw").rlike("[\u00a0\u2007\u202f\u200b-\u200d\u2060\ufeff\u200e\u200f\u2028\u2029\u00ad]")
    return [hit(broken, "encoding", "error", None, "text decoded with the wrong character set"), hit(~broken & unseen, "encoding", "note", None, "characters that can't be seen")]


@rule
def page_dashes(s: Settings) -> list[Column]:
    p = F.trim(T.field("pages"))
    fixed = F.regexp_replace(p, r"\s*[-\u2013\u2014]+\s*", "--")
    long = p.rlike("[\u2013\u2014]")
    return [hit(long, "style", "warning", "pages", "a typographic dash in pages", fixed), hit(~long & p.rlike(r"[0-9]\s*(?<!-)-(?!-)\s*[0-9]"), "style", "note", "pages", "a single hyphen in pages", fixed)]


def _ends() -> tuple[Column, Column, Column]:
    p = T.norm_pages(T.field("pages"))
    whole = p.rlike(r"^[0-9]{1,9}-[0-9]{1,9}$")
    return whole, F.try_to_number(F.substring_index(p, "-", 1), F.lit("999999999")), F.try_to_number(F.substring_index(p, "-", -1), F.lit("999999999"))


@rule
def page_sanity(s: Settings) -> list[Column]:
    whole, a, b = _ends()
    odd = filled("pages") & ~T.norm_pages(T.field("pages")).rlike(r"(?i)^[a-z]{0,3}[.:]?[0-9]+[a-z]?(?:-[a-z]{0,3}[.:]?[0-9]+[a-z]?)?(?:[,+].*)?$|^[ivxlc]+(?:-[ivxlc]+)?$")
    return [hit(whole & (b < a) & (F.length(b.cast("string")) >= F.length(a.cast("string"))), "style", "warning", "pages", "the range runs backwards"), hit(odd, "style", "note", "pages", "no page number or range")]


@rule
def numpages_agreement(s: Settings) -> list[Column]:
    whole, a, b = _ends()
    n = F.trim(T.field("numpages"))
    return [hit(whole & n.rlike("^[0-9]{1,9}$") & (F.try_to_number(n, F.lit("999999999")) != b - a + 1), "style", "warning", "numpages", "numpages and pages disagree", (b - a + 1).cast("int"))]


@rule
def arxiv_consistency(s: Settings) -> list[Column]:
    own = F.lower(T.field("journal"))
    j = F.when(F.contains(own, F.lit("arxiv")), T.arxiv_id(T.field("journal"))).otherwise("")
    d = F.when(F.contains(F.lower(T.field("doi")), F.lit("arxiv")), T.arxiv_id(F.regexp_replace(T.field("doi"), r"(?i)^.*arxiv\.", ""))).otherwise("")
    e = F.when(F.lower(T.field("archiveprefix")).isin("arxiv", ""), T.arxiv_id(T.field("eprint"))).otherwise("")
    ids = F.array_distinct(F.filter(F.array(j, d, e), lambda x: x != ""))
    return [
        hit(F.size(ids) > 1, "identifier_format", "error", "eprint", F.concat(F.lit("several arXiv numbers: "), F.array_join(F.array_sort(ids), ", "))),
        hit((j != "") & ~T.field("journal").rlike(r"^arXiv preprint arXiv:|^arXiv:"), "style", "note", "journal", "unusual form of an arXiv number", F.concat(F.lit("arXiv:"), j)),
        hit((j == "") & F.contains(own, F.lit("arxiv")) & ~filled("eprint"), "style", "note", "journal", "arXiv without a number"),
    ]


@rule
def identifier_in_url(s: Settings) -> list[Column]:
    url = T.field("url")
    doi = T.doi_in(F.when(url.rlike(r"(?i)doi\.org/"), url).otherwise(""))
    number = F.when(url.rlike(r"(?i)arxiv\.org/(?:abs|pdf)/"), T.arxiv_id(url)).otherwise("")
    return [
        hit((doi != "") & ~filled("doi"), "identifier_placement", "note", "doi", "the DOI stands in the address alone", doi),
        hit((number != "") & ~filled("eprint") & ~F.contains(F.lower(T.field("doi")), F.lit("arxiv")), "identifier_placement", "note", "eprint", "the arXiv number stands in the address alone", number),
    ]


@rule
def online_needs_urldate(s: Settings) -> list[Column]:
    online = canonical().isin("online") | T.web_source(T.field("url"))
    return [hit(online & filled("url") & ~filled("urldate") & ~filled("doi") & ~filled("eprint"), "style", "note", "urldate", "a web source without the day it was read")]


@rule
def doi_format(s: Settings) -> list[Column]:
    d = F.trim(T.field("doi"))
    bare = T.bare_doi(d)
    shaped = bare.rlike(r"^10\.[0-9]{4,9}/\S+$")
    return [
        hit(filled("doi") & (F.lower(d) != bare) & shaped, "style", "note", "doi", "the DOI is written as an address", bare),
        hit(filled("doi") & ~shaped, "identifier_format", "warning", "doi", "not the shape of a DOI"),
        hit(shaped & bare.rlike("[.,;]$"), "identifier_format", "warning", "doi", "punctuation ends the DOI", F.regexp_replace(bare, "[.,;]+$", "")),
    ]


@rule
def identifier_formats(s: Settings) -> list[Column]:
    out = []
    for name, other, valid, swapped in (("isbn", "issn", T.isbn_valid, T.issn_valid), ("issn", "isbn", T.issn_valid, T.isbn_valid)):
        tokens = F.filter(F.split(T.field(name), r"[,;\s]+(?=[0-9])"), lambda x: x.rlike("[0-9]"))
        swap, bad = F.exists(tokens, lambda x: swapped(x) & ~valid(x)), F.exists(tokens, lambda x: ~valid(x))
        out.append(hit(swap, "identifier_format", "warning", name, f"this is an {other.upper()}"))
        out.append(hit(~swap & bad, "identifier_format", "warning", name, "the check digit is wrong"))
    return [*out, hit(filled("orcid") & ~T.orcid_valid(T.field("orcid")), "identifier_format", "warning", "orcid", "the check character is wrong")]


def entry_findings(entries: DataFrame, settings: Settings | None = None, only: list[str] | None = None) -> DataFrame:
    """(file_id, entry_seq, key, lineno, emit_seq, rule, category, severity, field, message, suggested, layer)."""
    settings = settings or Settings()
    parts = []
    for name, build in RULES.items():
        if only is None or name in only:
            for c in build(settings):
                own = c.column if isinstance(c, many) else F.array(c)
                parts.append(F.transform(F.coalesce(own.cast(SHAPE), F.array().cast(SHAPE)), lambda x, n=name: F.when(x.isNotNull(), x.withField("rule", F.lit(n)))))
    every = F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())
    present = F.map_keys(F.map_filter("fields", lambda _, v: v.rlike(r"[^{}\s]")))
    made = T.once(entries, present=present, canonical=F.coalesce(F.element_at(C.map_of(C.TYPE_ALIASES), etype()), etype()))
    out = made.select("file_id", "entry_seq", "key", "lineno", "field_lines", F.posexplode(every).alias("emit_seq", "f"))
    line = F.coalesce(F.element_at("field_lines", F.col("f.field")), F.col("lineno"))
    return out.select("file_id", "entry_seq", "key", line.alias("lineno"), "emit_seq", "f.*", F.lit("static").alias("layer"))
