"""Column builders for bibliographic text: names, titles, identifiers, pages, checksums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FROM = "àáâãäåāăąçćčĉċďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž"
_TO = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijkllll" + "nnnn" + "ooooooooo" + "rrrsssstttuuuuuuuuuuwyyyzzz"
_LONG = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ð": "d"}


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with these columns, each computed once a row.

    A filter on a column of a plain projection is moved below it with the column's expression in place of each use;
    it isn't moved below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times and computes it once."""
    return F.element_at(F.transform(F.array(c), use), 1)


def deaccent(c: Column) -> Column:
    """Lower-cased letters without accents; ligatures written out."""
    out = F.translate(F.lower(c), _FROM, _TO)
    for a, b in _LONG.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def field(name: str) -> Column:
    return F.coalesce(F.element_at("fields", name), F.lit(""))


def filled(name: str) -> Column:
    return field(name).rlike(r"[^{}\s]")


def clean_tex(c: Column) -> Column:
    """TeX accents, macros, braces and dollars removed; spaces squeezed."""
    out = F.regexp_replace(c, r"&amp;|\\&", "&")
    out = F.regexp_replace(out, r"\\[`'^\"~=.]\s*\{?\s*\\?([A-Za-z])\}?", "$1")
    out = F.regexp_replace(out, r"\\[uvHckdbr]\s*\{([A-Za-z])\}", "$1")
    out = F.regexp_replace(out, r"\\ss(?![A-Za-z])", "ss")
    out = F.regexp_replace(out, r"\\(?:text|emph|mathrm)[a-z]*\s*\{", "{")
    out = F.regexp_replace(out, r"\\[A-Za-z]+\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[{}$]", ""), r"[\s~]+", " "))


def plain(c: Column) -> Column:
    """ASCII without TeX, markup and ampersands: clean_tex squeezes spaces alone, and deaccent lowers alone."""
    return ~c.rlike(r"[\\{}$~&<\x80-\x{10ffff}]")


def title_key(c: Column) -> Column:
    """Letters, digits and single spaces of a title, for comparison."""
    full = lambda x: F.replace(deaccent(F.regexp_replace(clean_tex(x), r"(?is)<[^<>]*>", "")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(let(c, lambda x: F.when(plain(x), F.lower(x)).otherwise(full(x))), "[^a-z0-9]+", " "))


def words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def shortened(a: Column, b: Column) -> Column:
    """One key is a proper prefix of the other on a word boundary."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.startswith(a, F.concat(b, F.lit(" "))) | F.startswith(b, F.concat(a, F.lit(" "))))


def fragment(a: Column, b: Column) -> Column:
    """One key holds the other, of at least four words, as neighbouring words."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (F.size(words(short)) >= 4) & F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))


def similar(a: Column, b: Column) -> Column:
    return (a == b) | shortened(a, b) | (overlap(words(a), words(b)) >= 0.9)


def miscased(c: Column) -> Column:
    """At least four words of two letters or more, of which 60 % are in capitals."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Za-z]{2,})"), 1)
    loud = F.filter(found, lambda w: w == F.upper(w))
    return (F.size(found) >= 4) & (F.size(loud) >= 0.6 * F.size(found))


def bare_doi(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))


def doi_in(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"(?i)(10\.[0-9]{4,9}/[^\s?#&\"<>]+)", 1), r"[.,;]+$", "")


def arxiv_id(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)((?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7}))(?:v[0-9]+)?", 1)


def _digits(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s-]", ""))


def _weighted(c: Column, weights: list[int]) -> Column:
    """Sum of digit times weight; X counts as ten."""
    total = F.lit(0)
    for k, w in enumerate(weights):
        d = F.substring(c, k + 1, 1)
        total = total + F.when(d == "X", 10).otherwise(F.try_to_number(d, F.lit("9")).cast("int")) * w
    return total


def isbn_valid(c: Column) -> Column:
    """ISBN-10 or ISBN-13 with a correct check digit; false for other shapes."""
    d = _digits(c)
    ten = F.when(d.rlike("^[0-9]{9}[0-9X]$"), _weighted(d, list(range(10, 0, -1))) % 11 == 0)
    thirteen = F.when(d.rlike("^[0-9]{13}$"), _weighted(d, [1, 3] * 6 + [1]) % 10 == 0)
    return F.coalesce(ten, thirteen, F.lit(False))


def issn_valid(c: Column) -> Column:
    d = _digits(c)
    return F.coalesce(F.when(d.rlike("^[0-9]{7}[0-9X]$"), _weighted(d, list(range(8, 0, -1))) % 11 == 0), F.lit(False))


def orcid_valid(c: Column) -> Column:
    """Sixteen characters with an ISO 7064 MOD 11-2 check character."""
    d = _digits(F.regexp_replace(c, r"(?i)^https?://orcid\.org/", ""))
    weights = [pow(2, 15 - k, 11) for k in range(15)]
    return F.coalesce(F.when(d.rlike("^[0-9]{15}[0-9X]$"), (_weighted(d, weights + [1])) % 11 == 1), F.lit(False))


def year_of(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{4}"), F.substring(c, 1, 4).cast("int"))


def norm_pages(c: Column) -> Column:
    """Pages with single hyphens and no spaces; an EP mark counts as a dash."""
    out = F.regexp_replace(F.trim(c), r"(?i)\s+EP\s*-?\s*", "-")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", ""), "[-\u2010-\u2015\u2212]+", "-")


def authors(c: Column) -> Column:
    """Names of a list that is joined by 'and'; an 'and' inside braces joins nothing."""
    return F.filter(F.transform(F.split(c, r"(?i)\s+and\s+(?![^{}]*\})"), F.trim), lambda x: x != "")


def surname(name: Column) -> Column:
    """Text before the comma, or the last part but for Jr and numerals."""
    bare = F.regexp_replace(name, r"(?i),?\s+(?:jr\.?|sr\.?|ii|iii|iv)$", "")
    last = lambda x: F.when(x.rlike(r"^\{.*\}$"), x).when(F.contains(x, F.lit(",")), F.trim(F.substring_index(x, ",", 1))).otherwise(F.regexp_extract(x, r"(\S+)$", 1))
    return let(bare, last)


def fold_surname(name: Column) -> Column:
    """Letters of a surname with umlauts and their transcriptions made equal."""
    folded = let(surname(name), lambda x: F.when(plain(x), F.lower(x)).otherwise(deaccent(clean_tex(x))))
    for two, one in (("oe", "o"), ("ue", "u"), ("ae", "a")):
        folded = F.replace(folded, F.lit(two), F.lit(one))
    return F.regexp_replace(folded, "[^a-z]+", "")


PARTICLES = ["van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "le", "ten", "ter", "vander", "vanden", "vonder", "dela", "al", "el"]


def surname_match(a: Column, b: Column) -> Column:
    """Equal, or equal once a particle is dropped from the front of one of them."""
    led = lambda x, y: F.endswith(x, y) & F.substring(x, F.lit(1), F.length(x) - F.length(y)).isin(PARTICLES)
    return (F.length(a) > 0) & (F.length(b) > 0) & ((a == b) | led(a, b) | led(b, a))


def truncated(c: Column) -> Column:
    return c.rlike(r"(?i)\bet\.?\s+al\b\.?|\band\s+others\b")


def collaboration(c: Column) -> Column:
    return c.rlike(r"(?i)\b(?:collaboration|consortium|working group|team)\b|\{[^{}]*\sand\s[^{}]*\}")


def iso4(short: Column, long: Column) -> Column:
    """Each word of the short form, in order, starts a word of the long one that isn't a function word."""
    stop = ["of", "the", "and", "for", "in", "on", "de", "der", "des", "la", "le"]
    full = F.filter(words(title_key(long)), lambda w: ~w.isin(stop))
    part = F.filter(words(title_key(short)), lambda w: ~w.isin(stop))
    paired = F.zip_with(part, full, lambda a, b: F.coalesce(F.startswith(b, a) & (F.length(a) >= 2), F.lit(False)))
    return (F.size(part) == F.size(full)) & (F.size(part) > 0) & F.forall(paired, lambda x: x)


def web_source(c: Column) -> Column:
    return c.rlike(r"(?i)/(?:news|newsroom|blog|press|events?)(?:/|$|-)|^https?://(?:[\w-]+\.)*blog\.|\.pdf(?:$|[?#])|slides")


def thesis_url(c: Column) -> Column:
    return c.rlike(r"(?i)(?:thes[ie]s|dissertation|etd)[^/]*(?:$|[/?#.])")


def isbn_in(c: Column) -> Column:
    """The first ISBN-13 of a text, digits only; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(c, r"(97[89](?:[\s-]?[0-9]){10})", 1), r"[\s-]", "")


def inspire_recid(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)inspirehep\.net/(?:literature|record|api/literature)/([0-9]+)", 1)


def arxiv_version(c: Column) -> Column:
    """The version that is cited with an arXiv number, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, r"(?i)(?:[0-9]{4}\.[0-9]{4,5}|/[0-9]{7})v([0-9]{1,3})", 1), F.lit("")), F.lit("999")).cast("int")


def placeholder_doi(c: Column) -> Column:
    return bare_doi(c).rlike(r"^10\.1103/physrev[a-z]*\.0+")


def book_series_doi(c: Column) -> Column:
    return bare_doi(c).rlike(r"^10\.(?:1007/978|1007/bfb|1016/b978|1142/978|1201/978)")


def release_title(c: Column) -> Column:
    """A software title without its repository prefix and version suffix."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[\w.-]+/[\w.-]+:\s*", ""), r"(?i)[\s,:(]+v?[0-9]+(?:\.[0-9]+)+\)?$", ""))


def transient(status: Column) -> Column:
    """HTTP results that may differ on another try: throttled, no answer, server errors."""
    return status.isin(429, -1) | status.between(500, 599)


_RELATED = (
    ("retraction", r"(?i)^(?:retract(?:ed|ion)|withdraw(?:n|al))\b|\bretraction (?:note|notice)\b"), ("erratum", r"(?i)^(?:erratum|errata)\b"), ("corrigendum", r"(?i)^(?:corrigendum|correction)\b"),
    ("addendum", r"(?i)^addendum\b"), ("concern", r"(?i)expression of concern"), ("reply", r"(?i)^(?:reply|response|author'?s? reply) (?:to|on)\b"), ("comment", r"(?i)^comments? on\b"), ("review", r"(?i)^review of\b"),
)


def related_label(title: Column) -> Column:
    """What a title says of its relation to another work; null if nothing."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(_RELATED):
        out = F.when(title.rlike(pattern), label).otherwise(out)
    return out


DOCUMENT_TYPES = {
    "journal-article": "article", "proceedings-article": "inproceedings", "book": "book", "monograph": "book", "edited-book": "collection", "book-chapter": "incollection", "dissertation": "thesis",
    "posted-content": "preprint", "report": "report", "dataset": "dataset", "software": "software", "text": "article", "preprint": "preprint", "conferencepaper": "inproceedings",
}


def document_type(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DOCUMENT_TYPES.items() for x in kv]), F.lower(c))


def preprint() -> Column:
    """An entry that cites a preprint: an eprint, or arXiv in its journal or DOI."""
    return filled("eprint") | F.contains(F.lower(field("journal")), F.lit("arxiv")) | F.contains(F.lower(field("doi")), F.lit("arxiv"))


def preprint_container(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "").isin("arxiv", "ssrn", "biorxiv", "medrxiv", "chemrxiv", "researchsquare", "preprints", "hal", "zenodo", "ssrnelectronicjournal")


def has_markup(c: Column) -> Column:
    return c.rlike(r"(?i)</?(?:i|b|sub|sup|scp|mml:[a-z]+|math)\b[^>]*>|&(?:lt|gt|amp);")


def without_markup(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)<[^<>]*>", ""), r"\s+", " "))


def given_verdict(a: Column, b: Column) -> Column:
    """same, abbreviates, refines, or differs: the first name against the second."""
    x, y = (F.regexp_replace(deaccent(clean_tex(c)), "[^a-z]", "") for c in (a, b))
    return F.when((x == "") | (y == ""), None).when(x == y, "same").when(F.startswith(y, x), "abbreviates").when(F.startswith(x, y), "refines").otherwise("differs")
